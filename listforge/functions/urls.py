"""URLs: normal and canonical forms, as SQL expressions over their parts.

Hosts are compared in lower case; default ports and internationalised hosts stay as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import chain, emails, let, or_null, rx, squeeze

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Query parameters that name where a click came from.
TRACKING = r"(?i)^(?:utm_.*|fbclid|gclid|ref|source)$"


def url_part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, PARTS, i)


def mail_recipients(c: Column) -> Column:
    """Recipients of a mailto link; none at all if one of them is no address."""
    path = F.try_url_decode(F.replace(F.regexp_extract(or_null(c), r"(?i)^mailto:([^?#]*)", 1), F.lit("+"), F.lit("%2B")))
    names = F.transform(F.split(path, ","), lambda x: F.lower(squeeze(x)))
    none = F.array().cast("array<string>")

    def checked(found: Column) -> Column:
        good = F.forall(found, lambda x: let(emails(x), lambda e: (F.size(e) == 1) & (F.get(e, F.lit(0)) == x)))
        return F.when(F.coalesce(good, F.lit(False)), F.slice(F.array_distinct(found), 1, 20)).otherwise(none)

    return F.coalesce(let(names, checked), none)


def normal_url(c: Column, aliases: tuple[tuple[str, str], ...] = ()) -> Column:
    """An http(s) url with a host, its scheme and host in lower case and at least "/" as path, or a mailto link; else null.

    ``aliases``: (pattern, replacement) pairs for routes that a site has renamed.
    """

    def built(raw: Column) -> Column:
        scheme, host, path = F.lower(url_part(raw, 1)), F.lower(url_part(raw, 2)), url_part(raw, 3)
        rest = F.regexp_extract(raw, r"^[^?#]*(.*)$", 1)
        web = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), rest)
        return F.when(scheme.isin("http", "https") & (host != "") & ~host.rlike(r"\s"), F.replace(web, F.lit(" "), F.lit("%20"))).when((scheme == "mailto") & (F.size(mail_recipients(raw)) > 0), raw)

    return let(chain(or_null(c), *aliases), built)


def canonical_url(c: Column) -> Column:
    """A url without fragment, tracking parameters and slashes at the path's end; what is no url only loses the slashes."""

    def built(raw: Column) -> Column:
        scheme, host, path = F.lower(url_part(raw, 1)), F.lower(url_part(raw, 2)), rx(url_part(raw, 3), "/+$", "")
        kept = F.array_join(F.filter(F.split(url_part(raw, 4), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING)), "&")
        query = let(kept, lambda k: F.when(k != "", F.concat(F.lit("?"), k)).otherwise(F.lit("")))
        whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), query)
        return F.when(scheme.isin("http", "https") & (host != ""), whole).otherwise(rx(raw, "/+$", ""))

    return let(squeeze(c), built)


def is_web(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def with_param(c: Column, key: str, value: Column) -> Column:
    """The url with a query parameter set, before its fragment."""
    base, fragment = F.regexp_extract(c, r"^([^#]*)", 1), F.regexp_extract(c, r"(#.*)$", 1)
    cleared = chain(base, (rf"([?&]){key}=[^&]*&?", "$1"), ("[?&]$", ""))
    return F.when(c.isNotNull(), F.concat(cleared, F.when(F.contains(cleared, F.lit("?")), "&").otherwise("?"), F.lit(f"{key}="), value, fragment))


def mail_link(address: Column, subject: Column, exact: Column) -> Column:
    """A mailto link; with the subject only where it is to be used as it stands."""
    encoded = F.replace(F.url_encode(subject), F.lit("+"), F.lit("%20"))
    return F.when(exact & subject.isNotNull(), F.concat(F.lit("mailto:"), address, F.lit("?subject="), encoded)).otherwise(F.concat(F.lit("mailto:"), address))


def links(html: Column) -> Column:
    """Targets of a document's links, in order, repeated ones too."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit('href="([^"]+)"'), F.lit(1))


def page_number(html: Column) -> Column:
    """The highest page number a document links to."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)(?:[?&]|&amp;)page=(\d{1,9})"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: x.cast("int")))
