from __future__ import annotations

import corpus_pipeline
from tests.llm.conftest import prose


def test_stages(spark, make, tmp_path):
    """Every decision takes effect, clean documents stay, and the last stage gives a row per drawn document."""
    spark.createDataFrame([(1, prose(900, 40))], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clean = [(k, prose(k, 30 + k), "en", f"s{k % 3}", 1) for k in range(40)]
    bad = [(100, "12 !! 34", "en", "s0", 1), (101, None, "en", "s0", 1), (102, prose(7, 37), "en", "s1", 1), (103, "x " + prose(900, 40), "en", "s2", 1)]
    docs = make(clean + bad).select("doc_id", "text", "lang", "source", "n_chars")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs.count()
        docs = stage(spark, docs, f"file://{tmp_path}")
        seen[name] = docs
        docs = corpus_pipeline.saved(docs, name)
    ids = lambda name: {r["doc_id"] for r in seen[name].collect()}
    assert ids("language_id") == {i for i, *_ in clean} | {102, 103}
    near = ids("near_duplicate_join")
    assert len(near & {7, 102}) == 1 and near | {7, 102} == ids("language_id")
    assert ids("decontamination") == near - {103}
    assert ids("mixing") <= ids("decontamination") and seen["mixing"].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen["token_output"].count() == seen["mixing"].count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicate_join", "decontamination", "mixing", "token_output"]


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {k.split("_")[0] for k in names if k.startswith("op")} >= {f"op{n}" for n in range(1, 11)} and "pipeline" in names
