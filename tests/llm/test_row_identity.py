"""Rows that share an id, with payloads and texts of their own."""

import hashlib
from collections import Counter

from listforge.llm import mixing, warc


def test_mixed_rows_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(500))
    rows = [(1, long, "s", 0), (1, "two words", "s", 1), (1, None, "s", 2), (1, "two words", "s", 1), (None, "a b c", "t", 3), (None, "a b d", "t", 4), (2, " ".join(f"z{i}" for i in range(900)), "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark int").repartition(3)
    plan = mixing.mix(docs).collect()
    mixed = mixing.mixed_documents(docs).collect()
    taken = Counter()
    for r in plan:
        taken[r["size"]] += r.taken
    got = Counter()
    for r in mixed:
        assert r.text is not None
        size = len(next(x[1] for x in rows if x[3] == r.mark).split())
        got[size] += len(r.text.split())
    assert got == Counter({k: v for k, v in taken.items() if v}) and got[500] > 500
    again = mixing.mixed_documents(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))


def test_pages_that_share_an_id(spark):
    a, b, c = ("<p>" + x * 200 for x in "abc")
    data = [(1, "u1", a), (1, "u2", b), (2, "u3", b), (2, "u4", c), (3, "u5", a), (None, "u6", c), (None, "u7", "x" * 150), (4, "u8", "d" * 99), (5, "u9", "d" * 99)]
    got = warc.records(warc.rewritten(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3))).collect()
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, u, h in data:
        ref = first.get(h) if len(h) >= 100 and first.get(h) != i else None
        want.append((i, len(h), hashlib.sha256(h.encode()).hexdigest(), "response" if ref is None else "revisit", ref, u))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert len({r.record_id for r in got}) == len(data)


def test_old_archives():
    lines = [("http://a/with a blank", "1.2.3.4", "20010203040506", "text/html; charset=x"), ("dns:a", "5.6.7.8", "20010203040507", "text/dns")]
    blocks = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello", b"20010203040507\na. 60 IN A 1.2.3.4\n"]
    body = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    arc = b"filedesc://x 0.0.0.0 20010203040506 text/plain %d\n" % len(body) + body
    for line, block in zip(lines, blocks, strict=True):
        arc += b"\n" + " ".join(line).encode() + b" %d\n" % len(block) + block
    info, page, dns = warc.read_warc(warc.convert("x.arc", arc + b"\n"))
    assert info[0]["WARC-Type"] == "warcinfo"
    assert page[0]["WARC-Target-URI"] == "http://a/with a blank" and page[0]["WARC-IP-Address"] == "1.2.3.4" and page[0]["WARC-Payload-Digest"] == warc.sha256(b"hello") and page[0]["WARC-Date"] == "2001-02-03T04:05:06Z"
    assert (dns[0]["WARC-Type"], dns[0]["Content-Type"], dns[1]) == ("resource", "text/dns", blocks[1])
