"""Records whose url looks like an archive's own first one."""

from listforge.llm import warc


def test_warc_keeps_pages_whose_url_looks_like_a_version_block(spark):
    pages = spark.createDataFrame([(1, "filedesc://x.arc", "<p>one"), (2, "http://a/", "<p>two")], "page_id long, url string, html string")
    for way in (warc.rewritten(pages), warc.converted(warc.archives(pages))):
        assert sorted((r.page_id, r.url, bytes(r.payload)) for r in warc.records(way).collect()) == [(1, "filedesc://x.arc", b"<p>one"), (2, "http://a/", b"<p>two")]
