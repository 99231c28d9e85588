"""Linkage operators: golden values, small cases and invariants."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import blocking, channels, context, decide, features, keys, metrics, model, validate
from spindrift.operators.decide import Rule
from spindrift.sources import sinks, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def records(spark, rows):
    return frame(spark, rows, "source int, entity_id string, business_name string, business_address string, country string")


@pytest.mark.parametrize("probs,m", [([0.9, 0.8, 0.3], 2), ([0.3], 0), ([0.25, 0.22], 0), ([0.1], 0), ([0.9, 0.9, 0.9, 0.85, 0.8], 5), ([1.0], 1)])
def test_expected_f(spark, probs, m):
    scores = frame(spark, [("S1-1", f"S2-{k}", p) for k, p in enumerate(probs)], "s1_id string, cand_id string, prob double")
    assert decide.decide(scores, Rule("expf", r=0.9, s=1.0, floor=0.2)).count() == m


def test_fallback_and_ties(spark):
    scores = frame(spark, [("S1-1", "S2-1", 0.3), ("S1-1", "S2-2", 0.3), ("S1-2", "S2-1", 0.7), ("S1-2", "S2-3", 0.1)], "s1_id string, cand_id string, prob double")
    got = {(r.s1_id, r.cand_id) for r in decide.decide(scores, Rule("fallback", thr=0.5, lo=0.2)).collect()}
    assert got == {("S1-1", "S2-2"), ("S1-2", "S2-1")}
    assert Rule.parse("expf r=0.9 s=1.0 floor=0.2 exclusive=True") == Rule("expf", r=0.9, s=1.0, floor=0.2, exclusive=True)
    assert Rule.parse("thresh thr=0.4 top_n=None").top_n is None


def test_one_owner_before_and_after_deciding(spark):
    scores = frame(spark, [("S1-1", "S2-1", 0.9), ("S1-1", "S2-2", 0.95), ("S1-2", "S2-1", 0.8)], "s1_id string, cand_id string, prob double")
    after = decide.one_owner(decide.decide(scores, Rule("thresh", thr=0.5, top_n=1)))
    before = decide.decide(decide.one_owner(scores), Rule("thresh", thr=0.5, top_n=1))
    assert {r.s1_id for r in after.collect()} == {"S1-1", "S1-2"} and {r.s1_id for r in before.collect()} == {"S1-1"}


def test_patch(spark):
    schema = "s1_id string, cand_id string, prob double"
    scores = frame(spark, [("a", "x", 0.9), ("b", "x", 0.8), ("b", "y", 0.7), ("c", "z", 0.6)], schema)
    old = frame(spark, [("a", "x"), ("b", "x"), ("c", "z")], "s1_id string, cand_id string")
    ids = frame(spark, [("b",)], "s1_id string")
    new = decide.patch(old, scores, ids, Rule("thresh", thr=0.5))
    assert {(r.s1_id, r.cand_id) for r in new.collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
    assert decide.patch_report(old, new, ids).first().asDict() == {"changed": 1, "removed": 1, "added": 1, "filled": 0}


def test_f05(spark):
    pairs = lambda rows: frame(spark, rows, "s1_id string, cand_id string")
    universe = frame(spark, [("a",), ("b",), ("c",), ("d",)], "s1_id string")
    truth = pairs([("a", "S2-47"), ("a", "S3-812"), ("c", "x")])
    predicted = pairs([("a", "S2-47"), ("a", "S2-193"), ("a", "S3-812"), ("d", "y")])
    got = metrics.macro_f05(universe, truth, predicted).first()
    assert got.f05 == pytest.approx((0.7142857 + 1 + 0 + 0) / 4, abs=1e-6) and got.n == 4
    assert got.precision == pytest.approx((2 / 3) / 3, abs=1e-6) and got.recall == pytest.approx(1 / 3, abs=1e-6)
    assert metrics.conflicts(pairs([("a", "x"), ("b", "x"), ("c", "y")])).first().asDict() == {"targets": 1, "excess": 1, "most": 2, "entities": 2}
    assert metrics.conflicted_entities(predicted, universe).count() == 2


def test_keys_and_probe(spark):
    rows = records(spark, [(1, "S1-1", "Beta Alpha Ltd", "12345 Main Rd", "IN"), (2, "S2-1", "Alpha Beta", "9 Rd", "IN"), (2, "S2-2", "Gamma", "", "IN"), (3, "S3-1", "Beta Alpha", "12345", "US")])
    made = keys.blocking_keys(keys.normalized(rows))
    kinds = {(r.entity_id, r.key_type) for r in made.collect()}
    assert ("S1-1", "name_sorted") in kinds and ("S2-1", "name_sorted") not in kinds and ("S1-1", "postal_token") in kinds
    freq = keys.key_freq(made)
    assert freq.where("country = 'IN' and key_type = 'name_token' and key_value = 'alpha'").first().df == 1
    probe = keys.probe_table(made, freq, 3)
    assert probe.where("w <= 0").count() == 0 and {r.country for r in probe.collect()} == {"IN"}
    found = blocking.best(blocking.scored(probe, made))
    assert [r.cand_id for r in found.collect()] == ["S2-1"]
    assert keys.prune(made, freq, 0).where("source > 1").count() == 0


def test_exact_cap(spark):
    rows = [(1, "S1-1", "same name here", "", "X"), (1, "S1-2", "other name here", "", "X")]
    rows += [(2, f"S2-{k}", "same name here", "", "X") for k in range(201)] + [(2, f"S2-9{k}", "other name here", "", "X") for k in range(200)]
    found = channels.exact_channel(channels.linked_forms(records(spark, rows)))
    assert {r.q for r in found.select("q").distinct().collect()} == {"S1-2"} and found.count() == 200


def test_unknown_query_words_do_not_count(spark):
    rows = records(spark, [(1, "S1-1", "alpha zzz", "", "X"), (2, "S2-1", "alpha", "", "X")])
    got = features.word_features(frame(spark, [("S1-1", "S2-1")], "q string, t string"), channels.linked_forms(rows)).first()
    assert got.name_word_jac == 1.0 and got.n_name_words == 1.0


def test_context(spark):
    got = {r.t: r for r in context.context_base(frame(spark, [("q", "a", 0.9), ("q", "b", 0.4), ("r", "a", 0.0)], "q string, t string, p1 double")).collect() if r.q == "q"}
    assert got["a"].p1_gap == pytest.approx(0.5) and got["b"].p1_gap == pytest.approx(-0.5) and got["b"].p1_rank == 2 and got["a"].n_likely == 1


def test_files(spark, tmp_path):
    (tmp_path / "one.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a\t""b"""\taddr\tX\nS1-2\tshort\n', encoding="utf-8")
    got = {r.entity_id: r for r in tables.read_records(spark, {1: str(tmp_path / "one.tsv")}).collect()}
    assert got["S1-1"].business_name == 'a\t"b"' and got["S1-2"].country == ""
    assert tables.read_records(spark, {1: str(tmp_path / "one.tsv")}, "drop").count() == 1
    lists = sinks.id_lists(frame(spark, [("S1-1", "S2-2", 2), ("S1-1", "S2-1", 1)], "s1_id string, cand_id string, rank int"), frame(spark, [("S1-1",), ("S1-2",)], "s1_id string"))
    sinks.write_id_lists(lists.coalesce(1), str(tmp_path / "out"), ("source1_entity_id", "matched_entity_ids"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert sorted(text.splitlines()) == ["S1-1\tS2-1,S2-2", "S1-2\t", "source1_entity_id\tmatched_entity_ids"]
    back = {r.s1_id: r.ids for r in tables.read_id_lists(spark, str(tmp_path / "out")).collect()}
    assert back == {"S1-1": ["S2-1", "S2-2"], "S1-2": []}
    sinks.write_scores(frame(spark, [("S1-1", "S2-1", 0.123456), ("S1-1", "S2-2", 0.01)], "s1_id string, cand_id string, prob double"), str(tmp_path / "scores"), 0.02)
    assert [r.prob for r in tables.read_scores(spark, str(tmp_path / "scores")).collect()] == [0.12346]
    assert tables.read_universe(spark, str(tmp_path / "out")).count() == 2


def test_latest(spark):
    df = frame(spark, [(1, "a", 0, "old"), (1, "a", 5, "new"), (1, "b", 1, "x")], "source int, entity_id string, line int, business_name string")
    assert {r.business_name for r in tables.latest(df, "line").collect()} == {"new", "x"}


def test_shards(spark):
    universe = frame(spark, [("a",), ("b",)], "s1_id string")
    with pytest.raises(ValueError, match="missing"):
        sinks.merge_shards(frame(spark, [("a", "")], "s1_id string, ids string"), universe)
    double = frame(spark, [("a", ""), ("a", ""), ("b", "")], "s1_id string, ids string")
    assert sinks.merge_shards(double, universe, strict=False).count() == 3
    with pytest.raises(ValueError, match="duplicate"):
        sinks.merge_shards(double, universe)


CASES = {
    "header": ["a\tb", "S1-1\tS2-1"], "comma_instead_of_tab": ["source1_entity_id,matched_entity_ids", "S1-1\t"], "row_without_tab": ["H", "S1-1\tS2-1", "S1-9"],
    "duplicate_row": ["H", "S1-1\t", "S1-1\t"], "repeated_id": ["H", "S1-1\tS2-1,S2-1"], "self_match": ["H", "S1-1\tS1-1"], "bad_prefix": ["H", "S1-1\tX"],
    "unknown_id": ["H", "S1-1\tS2-9"], "missing_row": ["H"], "unexpected_row": ["H", "S1-1\t", "S1-2\t"], "not_utf8": ["H", "S1-1\tS2-1�"],
}


@pytest.mark.parametrize("rule", CASES)
def test_validator(spark, rule):
    head = ("source1_entity_id", "matched_entity_ids")
    lines = frame(spark, [(k, "\t".join(head) if x == "H" else x) for k, x in enumerate(CASES[rule])], "line_no int, line string")
    one = lambda name, value: frame(spark, [(value,)], f"{name} string")
    report = validate.validate_lines(lines, one("s1_id", "S1-1"), head, one("cand_id", "S2-1"))
    assert {r.rule for r in report.where("n > 0").collect()} >= {rule} and not validate.passes(report)


def test_validator_passes_and_warns(spark):
    head = ("source1_entity_id", "matched_entity_ids")
    lines = frame(spark, [(0, "\t".join(head)), (1, "S1-1\tS2-1")], "line_no int, line string")
    within = frame(spark, [("S1-1", "S2-2")], "s1_id string, cand_id string")
    report = validate.validate_lines(lines, frame(spark, [("S1-1",)], "s1_id string"), head, None, within)
    assert validate.passes(report) and report.where("rule = 'not_a_candidate' and n = 1").count() == 1


def test_two_stage_model(spark):
    rows = [(f"S1-{q}", f"S2-{t}", float((q + t) % 4 == 0) * 0.7 + 0.05 * ((q * 7 + t) % 5), float(t), float((q + t) % 4 == 0)) for q in range(40) for t in range(5)]
    df = frame(spark, rows, "q string, t string, a double, b double, label double")
    models = model.two_stages(df, ["a", "b"], rounds=3, depth=2)
    scores = model.score_pairs(models, df)
    assert scores.count() == 200
    right = scores.join(df, (F.col("s1_id") == F.col("q")) & (F.col("cand_id") == F.col("t"))).where("(prob > 0.5) = (label = 1)").count()
    assert right > 190 and model.importance(models[0], ["a", "b"])[0][0] == "a"
    parts = model.split(df.selectExpr("q as s1_id"), 3, 10)
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {"val": 3, "fit": 10}


def test_cosine_channel_in_many_cells(spark, monkeypatch):
    forms = channels.linked_forms(tables.from_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))).cache()
    rows = lambda: sorted(map(tuple, channels.tfidf_topk(forms, "name", "c2", True, max_df=0.5).collect()))
    whole = rows()
    monkeypatch.setattr(channels, "QUERIES", 7)
    monkeypatch.setattr(channels, "TARGETS", 20)
    assert rows() == whole and len(whole) > 100
    forms.unpersist()
