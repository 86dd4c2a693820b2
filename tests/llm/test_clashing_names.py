"""Input columns named as operators name theirs: they stay, and nothing else changes."""

import pytest

from tactuslab.llm import decontaminate, fingerprint, line_dedup, url_filter, warc

LINE = " ".join(f"w{k}" for k in range(60))
DOCS = [(1, LINE + "\nown first"), (2, LINE + "\nown second"), (3, None), (None, "short"), (4, "")]


def _with(spark, names, rows=DOCS):
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names:
        plain = plain.selectExpr("*", f"concat('{n}', doc_id) AS `{n}`")
    return plain


def _same(plain, clashing, names, columns):
    key = lambda df: sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    assert key(plain) == key(clashing)
    for r in clashing.collect():
        for n in names:
            assert r[n] == (None if r["doc_id"] is None else f"{n}{r['doc_id']}")


@pytest.mark.parametrize("block_chars", [1 << 20, 40])
def test_decontamination(spark, block_chars):
    names = ["_text", "_spans", "_items", "_TEXT_"]
    items = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(5 * k, 5 * k + 12))) for k in range(9)], "item_id long, text string")
    run = lambda d: decontaminate.find_contamination(d, items, block_chars=block_chars)
    _same(run(_with(spark, [])), run(_with(spark, names)), names, ["doc_id", "text", "n_words", "spans", "items"])


def test_line_dedup(spark):
    names = ["_doc_id", "_th", "h", "p", "row", "_row"]
    out = line_dedup.dedup_lines(_with(spark, names))
    _same(line_dedup.dedup_lines(_with(spark, [])), out, names, ["doc_id", "text", "n_lines", "deleted"])
    assert out.columns == ["doc_id", "text", *names, "n_lines", "deleted"]


def test_next_documents(spark):
    names = ["_bucket", "_next", "_first", "_b", "_least", "_before"]
    run = lambda d: fingerprint.with_next(d, ["text"], buckets=3)
    _same(run(_with(spark, [])), run(_with(spark, names)), names, ["doc_id", "text", "next_text"])


def test_urls(spark):
    names = ["_best", "_site", "_token"]
    rows = [(k, f"http://example.org/{x}/1") for k, x in enumerate(("es", "en", "de"))]
    run = lambda d: url_filter.filter_urls(d, url="text")
    _same(run(_with(spark, [], rows)), run(_with(spark, names, rows)), names, ["doc_id", "host", "path", "rule", "verdict"])


def test_textual_page_ids_are_refused_before_writing(spark, tmp_path):
    pages = spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string")
    with pytest.raises(TypeError, match="not a whole number"):
        warc.write_archives(pages, f"file://{tmp_path}/x")
    assert not (tmp_path / "x").exists()


def test_a_hot_payload_is_a_join_that_can_be_split(spark, tmp_path):
    """Both sides of the join on digests are exchanges of tables, none an aggregate of the other."""
    pages = spark.createDataFrame([(k, "u", "same" if k % 3 else f"own {k}") for k in range(300)], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/y")
    back = {r["page_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}/y").collect()}
    assert len(back) == 300 and back[1]["record_type"] == "response" and all(back[k]["refers_to"] == 1 for k in range(2, 300) if k % 3)
