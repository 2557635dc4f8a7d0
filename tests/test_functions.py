"""Scalar functions: texts, dates, numbers, urls, contacts, descriptions."""

import datetime

import pytest
from pyspark.sql import functions as F

from listforge.functions import contacts, dates, describe, numbers, text, urls
from listforge.sources import http


def check(spark, f, cases):
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(cases)], "i int, x string")
    got = [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [v for _, v in cases]


day = datetime.date


def test_texts(spark):
    check(spark, text.squeeze, [(" a \t b ", "a b"), (None, ""), ("﻿x", "x")])
    check(spark, text.or_null, [(" \n", None), (" a ", "a"), (None, None)])
    check(spark, text.clean_lines, [(" a \r\n  b\n\n\n\nc ", "a\nb\n\nc"), (" ", None), (None, None)])
    check(spark, text.html_lines, [("<p>a &amp;lt; b</p><br/><script>x</script><b>c</b> d", "a < b\nc d"), (None, "")])
    check(spark, text.emails, [("A@b.co, a@B.co; c@d", ["a@b.co"]), ("", []), (None, [])])
    check(spark, text.comparable, [("  Re-Announced: Ｄata كتاب ۱۲ (IT)!", "data کتاب 12 it"), ("Urgently new", "urgently"), (None, "")])
    check(spark, text.company_key, [("ACME (Kabul) Ltd.", "acme ltd")])
    check(spark, text.location_key, [("Kabul Province, Afghanistan", "kabul")])
    check(spark, text.phrase_tokens, [("ASP.NET & C++/C# dev, example.net .NET", "asp net and c plus plus c sharp dev example net dotnet")])
    check(spark, text.clauses, [("B.Sc. in IT. Two years; Python\n•  ", ["BSc in IT", "Two years", "Python"])])
    check(spark, text.key_text, [("Closing_Date--x", "closing date x")])
    check(spark, lambda c: text.slug(F.lit(2), c), [("Señor Dev / Ops!", "2-sen-or-dev-ops"), ("؟", "2-role")])
    check(spark, text.subject_text, [('"Apply now."', "Apply now"), ("x", None), ("y" * 221, None)])
    check(spark, text.metadata, [("N/A", None), (" x ", "x"), ("-", None)])
    check(spark, text.csv_cell, [("=1+1", "'=1+1"), ('a,"b"', '"a,""b"""'), (None, ""), ("a\nb", '"a\nb"')])
    check(spark, text.escape_html, [("<a&'\">", "&lt;a&amp;&#x27;&quot;&gt;")])
    check(spark, lambda c: text.tech_labels(F.array(c)), [("Python, python | SQL, a, b, c", ["Python", "SQL", "a", "b"])])
    check(spark, lambda c: text.phrases_in(c, ["it officer", "it"]), [("senior it officer", ["it officer", "it"]), ("digit officer", []), ("", [])])


def test_dates(spark):
    cases = [("2026-02-03", day(2026, 2, 3)), ("by 3 Feb, 2026", day(2026, 2, 3)), ("February 3 2026", day(2026, 2, 3)), ("03/02/2026", day(2026, 2, 3)), ("3.2.2026", day(2026, 2, 3)), ("2026-02-31 or 1/1/2026", None), ("1999-01-01", None), ("Foo 3 2026", None), (None, None), ("12 Marchy 2026", day(2026, 3, 12))]
    check(spark, dates.closing_day, cases)
    check(spark, dates.shown_day, [("2026/2/3 10:00", day(2026, 2, 3)), ("3-2-2026", day(2026, 2, 3)), ("Feb 3rd, 2026", day(2026, 2, 3)), ("3rd February 2026", day(2026, 2, 3)), ("2026-13-01", None), ("", None), (None, None)])
    check(spark, dates.seen_day, [("2026-01-01T20:00:00Z", day(2026, 1, 2)), ("2026-01-01T19:29:59Z", day(2026, 1, 1)), ("2026-01-01", day(2026, 1, 1)), ("never", None)])
    check(spark, dates.legacy_day_text, [("Feb 31, 2026", "2026-02-31"), ("x", None)])
    check(spark, lambda c: dates.instant_text(dates.instant(c)), [("2026-01-01T10:00:00.789Z", "2026-01-01T10:00:00Z"), ("2026-01-01T10:00:00+02:00", "2026-01-01T08:00:00Z"), ("x", None)])


def test_numbers(spark):
    check(spark, numbers.vacancy_count, [("3", 3), ("۱۲", 12), ("Two positions", 2), ("a twenty jobs", 20), ("No. of jobs: 4", 4), ("5 (five) openings", 5), ("0", None), ("-1", None), ("many", None), (None, None), ("thirty", None)])
    check(spark, lambda c: numbers.salary_kind(numbers.salary_text(c)), [("N/A", "undisclosed"), ("Negotiable", "negotiable"), ("as per company scale", "scale"), ("500 USD monthly", "numeric"), ("good", "listed"), (None, "undisclosed")])
    pay = lambda c: F.to_json(numbers.comparable_salary(c))
    check(spark, pay, [("AFN 10,000 - 20,000 per month", '{"minimum":10000.0,"maximum":20000.0,"currency":"AFN","period":"month"}'), ("$5 / hr", '{"minimum":5.0,"maximum":5.0,"currency":"USD","period":"hour"}'), ("20 - 10 USD monthly", None), ("10 USD or EUR monthly", None), ("10 USD", None), ("1 2 3 USD, 4 per month 5", None)])
    check(spark, lambda c: numbers.salary_from_fields(F.lit(1), F.lit(2), F.lit("USD"), c), [("month", "1-2 USD per month"), (None, "1-2 USD")])


def test_urls(spark):
    check(spark, urls.normal_url, [("HTTP://Ex.COM", "http://ex.com/"), ("ftp://x/", None), ("mailto:a@b.co", "mailto:a@b.co"), ("mailto:nobody", None), ("/rel", None), (None, None), ("https://e.com/A?q=1#f", "https://e.com/A?q=1#f")])
    check(spark, urls.canonical_url, [("https://E.com/a//?utm_x=1&b=2&REF=3#z", "https://e.com/a?b=2"), ("http://e.com", "http://e.com/"), ("not a url/", "not a url"), (None, "")])
    check(spark, urls.mail_recipients, [("mailto:A%40b.co,c@d.ef?subject=x", ["a@b.co", "c@d.ef"]), ("mailto:a@b.co,x", []), ("http://x", []), (None, [])])
    check(spark, lambda c: urls.with_param(c, "role", F.lit("1-x")), [("http://e/a?b=1#f", "http://e/a?b=1&role=1-x#f"), ("http://e/?role=2", "http://e/?role=1-x"), (None, None)])
    check(spark, urls.page_number, [('<a href="?page=2"><a href="x&amp;page=11">', 11), ("none", None), (None, None)])
    check(spark, lambda c: urls.mail_link(F.lit("a@b.co"), c, F.lit(True)), [("IT officer", "mailto:a@b.co?subject=IT%20officer"), (None, "mailto:a@b.co")])


def test_contacts(spark):
    check(spark, contacts.phone, [("0700 123 456", "+93700123456"), ("+93 (0)700123456", None), ("0093700123456 ext 5", "+93700123456"), ("0700123456\n1", None), ("10.0.0.1 0700123456", None), ("020 - 2300000", None), ("0100123456", None), (None, None)])
    check(spark, contacts.phones, [("id 0700123456", []), ("call 0700123456 or 0700123456", ["+93700123456"]), ("+93700123456", ["+93700123456"]), ("تماس: 0799 999 999", ["+93799999999"]), (None, [])])
    method = lambda c: contacts.declared_method(c, contacts.stated_method(F.lit("online form")), F.lit(True), F.lit(False), F.lit(True))
    check(spark, method, [("Phone", "phone"), ("web", "email"), (None, "email")])
    merged = lambda c: contacts.merged_method(c, F.lit(True), F.lit(False), F.lit(True), F.lit(False))
    check(spark, merged, [("web", "web"), ("phone", "email"), (None, "email")])


def test_description_blocks(spark):
    got = describe.blocks("About us\nWe build.\n\nDuties:\n- one\n- two\n  goes on\n1) first\n۲. second\nRequirements\nskill a.\nskill b.\n•\nlate item")
    assert [(b["type"], b["text"] or b["items"]) for b in got] == [("heading", "About us"), ("paragraph", "We build."), ("heading", "Duties:"), ("ul", ["one", "two goes on"]), ("ol", ["first", "second"]), ("heading", "Requirements"), ("ul", ["skill a.", "skill b.", "late item"])]
    assert describe.blocks(None) == [] == describe.blocks(" \n ")
    df = spark.createDataFrame([("Skills:\nx",), (None,)], "t string")
    assert df.select(F.size(describe.description_blocks(F.col("t"))).alias("n")).orderBy("n").collect()[1].n == 2


def test_http_retries():
    import io
    import urllib.error

    calls, slept = [], []

    def open_url(url, timeout):
        calls.append(url)
        if len(calls) == 1:
            raise urllib.error.HTTPError(url, 503, "busy", {"Retry-After": "2"}, None)
        if len(calls) == 2:
            raise urllib.error.URLError("down")
        return io.BytesIO(b"ok")

    assert http.fetch("u", open_url, slept.append, rand=lambda: 0.0) == "ok" and slept == [2.0, 1.0]

    def missing(url, timeout):
        raise urllib.error.HTTPError(url, 404, "no", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        http.fetch("u", missing, slept.append)
    assert [http.backoff(n, lambda: 1.0) for n in (1, 2, 9)] == [0.625, 1.25, 30.0]
    assert [http.concurrency(n) for n in (None, 0, 3, 99)] == [4, 4, 3, 8]
    assert http.retry_after("soon") is None
