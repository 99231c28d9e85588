"""Every starved record gets the second look, whatever its id."""

from spindrift.operators import blocking
from spindrift.plans import jobs


def test_every_starved_record_is_escalated(spark, tmp_path):
    ids = [f"S1-{k}" for k in range(20)]
    # One key within the cheap tier and one that only the expensive tier reaches.
    probe = [(i, "X", "name_token", f"{tier}{i}", 2.0, rank, rank) for i in ids for tier, rank in (("near", 1), ("far", 20))]
    keys = [(2, f"S2-{tier}-{i}", "X", "name_token", f"{tier}{i}") for i in ids for tier in ("near", "far")]
    made = {
        "probe": spark.createDataFrame(probe, "s1_id string, country string, key_type string, key_value string, w double, rank int, cum_df long"),
        "keys": spark.createDataFrame(keys, "source int, entity_id string, country string, key_type string, key_value string"),
        "records": spark.createDataFrame([(1, i, "", "", "X") for i in ids], "source int, entity_id string, business_name string, business_address string, country string"),
    }
    want = {(i, f"S2-{tier}-{i}") for i in ids for tier in ("near", "far")}
    universe = made["records"].selectExpr("entity_id as s1_id", "country")
    assert {(r.s1_id, r.cand_id) for r in blocking.escalated(made["probe"], made["keys"], universe).collect()} == want
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}")
    assert {(r.s1_id, r.cand_id) for r in jobs.key_candidates(jobs.Store(spark, str(tmp_path))).collect()} == want
