"""The near-dedup stage with repeated rows, null ids and an id with two texts."""

import corpus_pipeline


def test_each_document_stays_once(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, a), (1, a), (None, a), (2, a), (2, b), (3, c), (None, c), (None, "only here with a null id"), (None, "only here with a null id"), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (None, "only here with a null id"), (4, ""), (4, ""), (5, None)], key=repr)
