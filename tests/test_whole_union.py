"""pair_features takes every pair of the union, those of a single channel too."""

import __spark_entry__ as entry
from spindrift.plans import linkage

SF = "/root/testdata/sf0.001"


def test_pair_features_takes_the_whole_union(spark):
    got = {(r.q, r.t): r for r in entry.queries()["pair_features"](spark, SF).collect()}
    run = linkage.Run(spark, SF)
    union = {(r.q, r.t): r for r in run.union().collect()}
    forms = {r.entity_id: r for r in run.forms.collect()}
    known = {(r.country, f, w) for r in forms.values() if r.source > 1 for f in ("name", "addr") for w in r[f].split(" ")}
    assert got.keys() == union.keys() and any(r.n_channels == 1 for r in got.values())
    for (q, t), r in got.items():
        a, b = forms[q], forms[t]
        assert r.n_channels == sum([r.c2_cos > 0, r.c2b_cos > 0, r.c3_cos > 0, r.c4_keys > 0]) == union[q, t].n_channels
        assert r.cand_source == b.source and r.name_exact == (a.name != "" and a.name == b.name)
        for f in ("name", "addr"):
            x, y = ({w for w in s[f].split(" ") if w and (s.country, f, w) in known} for s in (a, b))
            assert r[f"n_{f}_words"] == len(x & y) and abs(r[f"{f}_word_jac"] - len(x & y) / max(1, len(x | y))) < 1e-6
