"""The near dedup of the pipeline: texts stay where they are while few documents are kept, and repeated rows are one document."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark):
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(40))
    rows = [(i, text(i), "en", "s", 9) for i in range(6)] + [(2, text(2), "en", "s", 9), (9, text(2), "en", "s", 9), (None, text(7), "en", "s", 9), (None, text(7), "en", "s", 9), (5, text(8), "en", "s", 9)]
    return spark.createDataFrame(rows, SCHEMA)


WANTED = [(None, "w7x0"), (0, "w0x0"), (1, "w1x0"), (2, "w2x0"), (3, "w3x0"), (4, "w4x0"), (5, "w5x0"), (5, "w8x0")]


def _kept(df):
    return sorted(((r.doc_id, r.text.split()[0]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_repeated_rows(spark, monkeypatch):
    assert _kept(corpus_pipeline.near_dedup(spark, _docs(spark), "")) == WANTED
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 0)
    assert _kept(corpus_pipeline.near_dedup(spark, _docs(spark), "")) == WANTED


def test_texts_are_not_shuffled(spark):
    kept = corpus_pipeline.near_dedup(spark, _docs(spark).dropDuplicates(["text"]).localCheckpoint(), "")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "Aggregate" not in plan
