"""Queries that leave out no row and no part of a text."""

from listforge.plans import catalog

PLAIN = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.*")


def test_mail_links_of_whole_texts(spark, tmp_path):
    texts = ["Plain words", "1. A & b=c? + 50%\n\tü ~*'()\U0001f600 " * 9, "x" * 500, "", None]
    data = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.turn: r.link for r in catalog.queries()["mail_links"](spark, str(tmp_path)).collect()}
    encode = lambda t: "".join(chr(b) if b in PLAIN else f"%{b:02X}" for b in t.encode())
    assert got == {i: "mailto:user@x.example" + ("" if t is None else "?subject=" + encode(t)) for _, i, _, t in data}
