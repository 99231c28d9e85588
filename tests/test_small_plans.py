"""The union of the channels reads them from scratch tables: no plan holds several of them, which took the driver its memory and kept all shuffles at once."""

from spindrift.operators import features
from spindrift.plans import linkage

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_union_reads_its_channels(spark):
    plan = _plan(linkage.QUERIES["channel_union"](spark, SF))
    assert not any(x in plan for x in ("FlatMap", "MapInArrow", "Window", "Join", "Generate"))


def test_union_with_keys_reads_its_candidates(spark):
    plan = _plan(linkage.QUERIES["channel_union_keys"](spark, SF))
    assert not any(x in plan for x in ("FlatMap", "MapInArrow", "Window", "Join", "Generate"))


def test_pair_features_in_slices(spark, monkeypatch):
    run = linkage.Run(spark, SF)
    monkeypatch.setattr(features, "SLICE", 6)
    made = features.pair_features(run.stored_union, run.stored_forms)
    pairs = lambda df: sorted(map(tuple, df.select("q", "t").collect()))
    assert pairs(made) == pairs(run.stored_union) and len(pairs(made)) > 6
    assert not any(x in _plan(made) for x in ("Join", "ArrowEvalPython"))


def test_context_extra_makes_what_it_needs_only(spark):
    some = linkage.Run(spark, SF).rivals("cand_source", "r_phon")
    assert some.columns == ["q", "t", "p1", "cand_source", "r_phon"] and not any(x in _plan(some) for x in ("Join", "ArrowEvalPython"))
