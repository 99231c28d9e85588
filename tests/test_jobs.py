"""Whole runs on a small corpus of made-up firms: build, train, predict, evaluate; and the jobs on result files."""

import random

import pytest

from spindrift.operators import validate
from spindrift.operators.decide import Rule
from spindrift.plans import cli, jobs
from spindrift.sources import tables


def test_run(spark, tmp_path):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghiklmnoprst", k=rnd.randint(4, 8)))
    firms = [(f"{word()} {word()}".title(), f"{rnd.randint(1, 99)}-{rnd.randint(1, 99)} {word()} Rd {rnd.randint(10000, 99999)}", rnd.choice(["IN", "US"])) for _ in range(120)]
    sources, truth = {1: [], 2: [], 3: []}, []
    for k, (name, addr, country) in enumerate(firms):
        sources[1].append((f"S1-{k}", f"{name} Ltd", addr, country))
        for s in (2, 3):
            if rnd.random() < 0.7:
                swapped = " ".join(name.split()[::-1]) if rnd.random() < 0.3 else name
                sources[s].append((f"S{s}-{k}", swapped.replace("a", "e", 1), addr.replace("Rd", "Road"), country))
                truth.append((f"S1-{k}", f"S{s}-{k}"))
    paths = {}
    for s, rows in sources.items():
        paths[s] = str(tmp_path / f"s{s}.tsv")
        (tmp_path / f"s{s}.tsv").write_text("\n".join("\t".join(r) for r in [("entity_id", "business_name", "business_address", "country"), *rows]))
    store = jobs.Store(spark, str(tmp_path / "store"))
    jobs.build(store, paths)
    jobs.refresh(store, stats=False)
    assert jobs.key_candidates(store).count() > 0
    gold = spark.createDataFrame(truth, "s1_id string, cand_id string")
    report = jobs.train(store, gold, str(tmp_path / "models"), 20, 100, max_df=0.5, rules=[Rule("thresh", thr=0.4), Rule("expf", exclusive=True)], rounds=2, depth=2)
    assert report["stage1_f05"] > 0.6 and "best" in report
    candidates, matches = jobs.predict(store, str(tmp_path / "models"), Rule("expf", r=0.9, s=1.0, floor=0.2, exclusive=True), max_df=0.5)
    assert candidates.count() == matches.count() == 120
    assert jobs.evaluate(store, gold, Rule("thresh", thr=0.5)).first().f05 > 0.6


def write(path, head, rows):
    path.write_text("\n".join("\t".join(r) for r in [head, *rows]) + "\n", encoding="utf-8")
    return str(path)


RECORD = ("entity_id", "business_name", "business_address", "country")
MATCHES, CANDIDATES, SCORES = ("source1_entity_id", "matched_entity_ids"), ("source1_entity_id", "candidate_entity_ids"), ("source1_entity_id", "candidate_entity_id", "prob")


def test_build_takes_last_rows_and_any_script(spark, tmp_path):
    rows = [("S2-1", "Old Name", "1 Old Rd", "IN"), ("S2-1", "कमल स्टोर", "9-2 रोड 50001", "IN")]
    paths = {1: write(tmp_path / "a.tsv", RECORD, [("S1-1", "Kamal Store", "9-2 Rod", "IN")]), 2: write(tmp_path / "b.tsv", RECORD, rows), 3: write(tmp_path / "c.tsv", RECORD, [("S3-1", '"two\nlines"', "x", "IN"), ("S3-2", "short")])}
    store = jobs.Store(spark, str(tmp_path / "store"))
    jobs.build(store, paths)
    records = {r.entity_id: r for r in store.table("records").collect()}
    assert set(records) == {"S1-1", "S2-1", "S3-1", "S3-2"} and records["S2-1"].business_name.startswith("कमल") and records["S3-1"].business_name == "two\nlines" and records["S3-2"].country == ""
    names = {r.entity_id: r.name for r in store.table("forms").collect()}
    assert names["S2-1"].startswith("kamala ") and names["S2-1"].isascii()
    # The keys of every row count, also of those that a later row replaced.
    kinds = {(r.key_type, r.key_value) for r in store.table("keys").where("entity_id = 'S2-1'").collect()}
    assert ("name_token", "old") in kinds and ("name_token", "kamala") in kinds
    with pytest.raises(Exception, match="(?i)header|column"):
        tables.read_records(spark, {1: write(tmp_path / "d.tsv", ("id", "name", "address", "land"), rows)}).collect()


def test_both_generations_write_results(spark, tmp_path):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghiklmnoprst", k=rnd.randint(4, 8)))
    firms = [(f"{word()} {word()}", f"{rnd.randint(1, 99)}-{rnd.randint(1, 99)} {word()} Rd {rnd.randint(10000, 99999)}", rnd.choice(["IN", "US"])) for _ in range(90)]
    paths = {s: write(tmp_path / f"s{s}.tsv", RECORD, [(f"S{s}-{k}", *f) for k, f in enumerate(firms) if s == 1 or (k + s) % 3]) for s in (1, 2, 3)}
    truth = write(tmp_path / "truth.tsv", MATCHES, [(f"S1-{k}", ",".join(f"S{s}-{k}" for s in (2, 3) if (k + s) % 3)) for k in range(90)])
    at = lambda name: str(tmp_path / name)
    run = lambda *argv: cli.run(spark, [str(x) for x in argv])
    assert run("build", "--store", at("store"), "--source1", paths[1], "--source2", paths[2], "--source3", paths[3]) == 0
    store, gold = jobs.Store(spark, at("store")), tables.exploded(tables.read_id_lists(spark, truth))
    report = jobs.train_keys(store, gold, at("keys"), 20, 70, rules=[Rule("thresh", thr=0.4), Rule("thresh", thr=0.6, top_n=2)], rounds=2, depth=2)
    assert report["recall_ceiling"] > 0.9 and report["best"]["f05"] > 0.7
    # In two shards, of which one again: results of a country stay unless forced.
    for shard in (0, 1):
        run("predict-keys", "--store", at("store"), "--models", at("keys"), "--out", at(f"keys_out/{shard}"), "--shard", shard, "--shards", 2)
    ids = [r.s1_id for shard in (0, 1) for r in tables.read_id_lists(spark, at(f"keys_out/{shard}/match")).collect()]
    assert sorted(ids) == sorted(f"S1-{k}" for k in range(90))
    assert {r.s1_id for r in tables.read_universe(spark, at("keys_out/0/scores")).collect()} <= set(ids)
    jobs.train(store, gold, at("models"), 20, 70, max_df=0.5, rules=[Rule("thresh", thr=0.4)], extra=True, with_keys=True, rounds=2, depth=2)
    assert store.table("union").where("c1_rank > 0").count() > 0
    rule = "thresh thr=0.4 exclusive=True"
    run("predict", "--store", at("store"), "--models", at("models"), "--out", at("out"), "--rule", rule, "--countries", "IN")
    with pytest.raises(ValueError, match="missing"):
        run("merge", "--store", at("store"), "--out", at("out"))
    run("predict", "--store", at("store"), "--models", at("models"), "--out", at("out"), "--rule", rule)
    assert run("merge", "--store", at("store"), "--out", at("out")) == 0
    files = ["--matching", at("out/matching_results"), "--candidates", at("out/candidate_pairs"), "--source1", paths[1], "--targets", paths[2], paths[3]]
    report = jobs.validate_files(spark, *(files[k] for k in (1, 5, 3)), [paths[2], paths[3]])
    assert report.where("n > 0").count() == 0 and run("validate", *files) == 0
    assert jobs.recall_check(store, gold).first().pair_recall > 0.9
    assert run("tune", "--scores", at("out/scores"), "--truth", truth, "--universe", paths[1]) == 0


def test_jobs_on_result_files(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    run = lambda *argv: cli.run(spark, list(argv))
    lists = lambda path: {r.s1_id: ",".join(r.ids) for r in tables.read_id_lists(spark, path).collect()}
    source = write(tmp_path / "s1.tsv", RECORD, [(f"S1-{k}", "n", "a", "IN" if k < 3 else "US") for k in range(5)])
    scores = write(tmp_path / "scores.tsv", SCORES, [("S1-0", "S2-1", "0.9"), ("S1-1", "S2-1", "0.8"), ("S1-1", "S2-2", "0.7"), ("S1-2", "S2-3", "0.4"), ("S1-3", "S2-4", "0.6"), ("S1-4", "S2-4", "0.3")])
    run("apply", "--scores", scores, "--universe", source, "--rule", "thresh thr=0.35", "--out", at("base"))
    assert lists(at("base")) == {"S1-0": "S2-1", "S1-1": "S2-1,S2-2", "S1-2": "S2-3", "S1-3": "S2-4", "S1-4": ""}
    run("apply", "--scores", scores, "--universe", source, "--rule", "thresh thr=0.35 exclusive=True", "--out", at("owned"))
    assert lists(at("owned"))["S1-1"] == "S2-2"
    run("conflicts", "--base", at("base"), "--out", at("again"), "--include-empty")
    again = {r.s1_id for r in tables.read_universe(spark, at("again")).collect()}
    assert again == {"S1-0", "S1-1", "S1-4"}
    rescored = write(tmp_path / "again.tsv", ("source1_entity_id",), [(i,) for i in sorted(again)])
    report = jobs.patch(at("base"), tables.read_scores(spark, scores), tables.read_universe(spark, rescored), Rule("fallback", thr=0.5, lo=0.1), at("patched"))
    # S2-4 is locked by a record that isn't decided anew.
    assert lists(at("patched")) == {"S1-0": "S2-1", "S1-1": "S2-2", "S1-2": "S2-3", "S1-3": "S2-4", "S1-4": ""}
    assert report.first().asDict() == {"changed": 1, "removed": 1, "added": 0, "filled": 0}
    new = write(tmp_path / "wide.tsv", CANDIDATES, [("S1-1", "S2-1,S2-2,S2-9"), ("S1-77", "S2-1")])
    run("patch-cands", "--base", at("patched"), "--rescored", new, "--out", at("cands"))
    assert lists(at("cands"))["S1-1"] == "S2-1,S2-2,S2-9" and "S1-77" not in lists(at("cands")) and lists(at("cands"))["S1-2"] == "S2-3"
    for kind, head in (("match", MATCHES), ("cand", CANDIDATES)):
        (tmp_path / "new" / kind).mkdir(parents=True)
        write(tmp_path / "new" / kind / "part.tsv", head, [("S1-0", "S3-1"), *([("S1-1", "")] if kind == "match" else [])])
    ids = tables.read_records(spark, {1: source}).selectExpr("entity_id as s1_id", "country")
    made = {(r.country, r.origin): r.n for r in jobs.hybrid(ids, at("new"), at("base"), at("hybrid"), at("cands")).collect()}
    assert made == {("IN", "new"): 2, ("IN", "old"): 1, ("US", "old"): 2} and lists(at("hybrid/matching_results"))["S1-0"] == "S3-1"
    assert not (tmp_path / "hybrid" / "candidate_pairs").exists()  # S1-1 has a new row of matches but none of candidates
    with pytest.raises(ValueError, match="2 rows are missing, such as S1-"):
        jobs.hybrid(ids, at("new"), write(tmp_path / "old.tsv", MATCHES, [("S1-2", "")]), at("hybrid2"))
    good = write(tmp_path / "good.tsv", MATCHES, [(f"S1-{k}", "S2-1") for k in range(5)])
    assert run("validate", "--matching", good, "--source1", source, "--candidates", at("nowhere")) == 0
    warned = jobs.validate_files(spark, good, source, at("nowhere")).where("rule = 'missing_file'").first()
    assert warned.severity == "warning" and run("validate", "--matching", at("nowhere"), "--source1", source) == 1
    (tmp_path / "latin.tsv").write_bytes("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-é\n".encode("latin-1"))
    bad = {r.rule: r for r in jobs.validate_files(spark, at("latin.tsv"), source).where("n > 0").collect()}
    assert {"not_utf8", "missing_row"} <= set(bad) and bad["missing_row"].n == 4 and bad["missing_row"].example == "S1-1, S1-2, S1-3, S1-4"
    (tmp_path / "empty.tsv").write_text("")
    assert [r.rule for r in jobs.validate_files(spark, at("empty.tsv"), source).collect()] == ["empty_file"] and not validate.passes(jobs.validate_files(spark, at("empty.tsv"), source))
