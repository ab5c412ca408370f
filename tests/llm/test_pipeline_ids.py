"""The near-duplicate stage with repeated and null ids."""

import corpus_pipeline


def test_one_row_of_each_group(spark):
    text, other, third = (" ".join(f"{p}{k}" for k in range(40)) for p in "abc")
    rows = [(1, text), (1, text), (2, text), (3, other), (3, other + " more"), (None, third), (None, third), (None, third + " more"), (None, text), (None, ""), (None, ""), (None, None), (4, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(got, key=repr)[:3] == [(1, text), (3, other), (4, None)]
    free = [t for k, t in got if k is None]
    assert len([t for t in free if t and t.startswith("c0")]) == 1 and text not in free
    assert sorted(free, key=repr)[:1] == [""] and free.count(None) == 1 and len(free) == 3
