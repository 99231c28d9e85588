"""Quality rules, the mix and the site classifier against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from spindrift.llm import mixing, quality_rules, site_bayes

WORD = r"[^\x20\x09-\x0D]+"


def brute_rules(text):
    text = text or ""
    words = re.findall(WORD, text)
    at = defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    covered = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rules(spark):
    rnd = random.Random(4)
    prose = lambda n: " ".join(rnd.choice("the of and a to in house garden river walks slowly green über".split()) for _ in range(n))
    line = prose(9)
    texts = [None, "", " \n\t", "one", prose(19), prose(20), prose(400), prose(100) + " " + "x y z " * 30, "\n".join([line] * 5), "a " * 50, "\n".join([prose(30), "", line, "  ", line]), "| a |" * 40, prose(60) + " $ # *", "é " * 30, "x" * 100000, (prose(50) + "\n") * 2]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(6, texts[6], "x")], "doc_id long, text string, n_words string")
    got = defaultdict(list)
    for r in quality_rules.judge(docs).collect():
        q = r["__quality"]
        got[r.doc_id].append((q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed))
        assert not (q.base_failed and q.kept) and (q.kept == (not q.broken))
    for i, t in enumerate(texts):
        assert got[i] == [brute_rules(t)] * (2 if i == 6 else 1)
    assert quality_rules.judge(docs.limit(0)).count() == 0
    kept = {r.doc_id for r in quality_rules.judge(docs).where("__quality.kept").collect()}
    assert {5, 6} <= kept and not kept & {0, 1, 2, 3, 4, 7, 9, 11, 14}


def brute_fill(sizes, weights, cap):
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        over = {i for i in range(len(sizes)) if i not in full and rest * weights[i] / weight > cap * sizes[i]} if weight else set()
        if not over:
            return [cap * s if i in full else rest * weights[i] / weight for i, s in enumerate(sizes)]
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for s in [None, "B", "a", "é", "c", "d"]:
        for _ in range(rnd.choice([1, 3, 40, 300])):
            rows.append((len(rows), rnd.choice([None, "", " ".join("w" * rnd.randint(1, 60))]), s, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    sizes = {i: len(re.findall(WORD, t or "")) for i, t, _, _ in rows}
    order = sorted({s for *_, s, _ in rows if s is not None}, key=lambda s: s.encode()) + [None]
    per = [sum(sizes[i] for i, _, s, _ in rows if s == x) for x in order]
    want = dict(zip(order, brute_fill(per, [(5, 2, 1)[k % 3] for k in range(len(order))], 3), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.size == sizes[r.row.doc_id] and r.taken == r.repeats * r.size and r.taken <= 3 * r.size
        assert r.source_size == per[order.index(r.row.source)] and r.target == pytest.approx(want[r.row.source])
        taken[r.row.source] += r.taken
    largest = max(sizes.values())
    assert all(abs(taken[s] - want[s]) <= largest for s in order)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.row.doc_id, r.taken) for r in got) == sorted((r.row.doc_id, r.taken) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_takes_some_of_many_equal_rows(spark):
    rows = [(1, "w w w w", "a")] * 1000 + [(k, "w w", "b") for k in range(1000)] + [(2, "x y z", None)] * 700
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, at int").repartition(9)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and len({r.row.at for r in got}) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.row.source] += r.taken
        target[r.row.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 4 for s in target) and len({r.repeats for r in got if r.row.source == "a"}) == 2


def test_site_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = {r.doc_id: r for r in site_bayes.classify(docs, train).collect()}
    truth = {r.doc_id: r.quality for r in held.collect()}
    right = np.mean([got[i].kept == bool(q) for i, q in truth.items()])
    good = np.mean([got[i].kept for i, q in truth.items() if q])
    bad = np.mean([not got[i].kept for i, q in truth.items() if not q])
    assert right > 0.95 and good > 0.95 and bad > 0.8
    assert len(got) == docs.count()


def plain_features(text):
    stop = {w for words in quality_rules.STOP_WORDS.values() for w in words.split()}
    text = text or ""
    words = re.findall(WORD, text)
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return [
        min(sum(c in quality_rules.SYMBOLS for c in text) / n, 3), sum(w.strip(".,;:!?()\"'").lower() in stop for w in words) / n,
        min(sum(map(len, words)) / n, 30), len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), np.log1p(len(words)), sum(c in "0123456789" for c in text) / n,
    ]


def plain_classifier(rows, labels):
    """rows (text, host, path); labels {row: 0 or 1}: evidence, host share, path share and posterior of each row."""
    x = np.array([plain_features(t) for t, _, _ in rows])
    known = sorted(labels)
    weights, offset, prior = site_bayes.fit(x[known], np.array([labels[k] for k in known], float))
    evidence = np.clip(x @ weights + offset, -20, 20)
    p = np.round(1 / (1 + np.exp(-evidence - np.log(prior / (1 - prior)))), 6)
    share = lambda v, less, m, k: (sum(v) - less + k * m) / (len(v) - bool(less) + k)

    def strength(groups):
        groups = [(len(v), sum(v) / len(v), m) for v, m in groups if len(v) > 1]
        between = max(0, sum(n * (s - m) ** 2 for n, s, m in groups) - sum(m * (1 - m) for _, _, m in groups)) / sum(n * m * (1 - m) for n, _, m in groups)
        return min(1000, max(1, 1 / between - 1)) if between else 1000

    for _ in range(site_bayes.ROUNDS):
        last = p
        host, path = defaultdict(list), defaultdict(list)
        for k, (_, h, q) in enumerate(rows):
            host[h].append(p[k])
            path[h, q].append(p[k])
        corpus = p.mean()
        of_hosts = strength([(v, corpus) for v in host.values()])
        of_paths = strength([(v, share(host[h], 0, corpus, of_hosts)) for (h, _), v in path.items()])
        site = {(h, q): share(v, 0, share(host[h], 0, corpus, of_hosts), of_paths) for (h, q), v in path.items()}
        prior = np.array([site[h, q] for _, h, q in rows])
        p = np.round(1 / (1 + np.exp(-evidence - np.log(prior / (1 - prior)))), 6)
    out = []
    for k, (_, h, q) in enumerate(rows):
        a = share(host[h], last[k], corpus, of_hosts)
        b = share(path[h, q], last[k], a, of_paths)
        out.append((evidence[k], a, b, 1 / (1 + np.exp(-evidence[k] - np.log(b / (1 - b))))))
    return out


def test_site_classifier_against_plain_python(spark):
    rnd = random.Random(6)
    sites = [(h, q, rnd.random()) for h in (None, "a", "b", "é") for q in (None, "x", "y")]
    rows, truth = [], []
    for _ in range(2000):
        h, q, good = rnd.choice(sites)
        truth.append(int(rnd.random() < good))
        prose = " ".join(rnd.choice("the of and house garden river 12 walks".split()) for _ in range(rnd.randint(1, 80)))
        rows.append((prose if rnd.random() < (0.85 if truth[-1] else 0.25) else prose.replace("the", "$").replace("of", "# #") + " a a a\n\nx\nx", h, q))
    rows += [(None, "a", "x"), ("", None, None), (" \n", "b", "x"), ("word " * 60_000, "a", "y"), ("only", "one", "site"), rows[0], rows[0]]
    truth += [0, 0, 0, 0, 1, truth[0], truth[0]]
    labels = {k: truth[k] for k in range(0, 2000, 3)}
    docs = spark.createDataFrame([(k, *r, 0.5, 1) for k, r in enumerate(rows)], "doc_id long, text string, source string, lang string, quality double, n int")
    got = {r.doc_id: r for r in site_bayes.classify(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    for k, want in enumerate(plain_classifier(rows, labels)):
        assert [got[k].evidence, got[k].host_share, got[k].path_share, got[k].quality] == pytest.approx(want, abs=2e-5)
    # Calibrated: the mean posterior of the unlabelled rows of a site is near its share of good ones.
    off = []
    for h, q, _ in sites:
        mine = [k for k in range(2000) if rows[k][1:] == (h, q) and k not in labels]
        off.append(np.mean([got[k].quality for k in mine]) - np.mean([truth[k] for k in mine]))
    assert abs(np.mean(off)) < 0.03 and np.mean(np.abs(off)) < 0.08


def test_site_classifier_edges(spark):
    rows = [(i, t, s, p) for i, (t, s, p) in enumerate([(None, None, None), ("", "a", None), ("the cat and the dog", "a", "x"), ("### $$$", "b", "x")])]
    docs = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([(None, 1), (7, None)], "doc_id long, quality int")
    got = site_bayes.classify(docs, none).collect()
    assert len(got) == 5 and all(r.evidence == 0 for r in got)
    assert site_bayes.classify(docs.limit(0), none).count() == 0


def test_shares_shrink_towards_their_parents(spark):
    docs = spark.createDataFrame([(i, "the and of " * 10 if good else "### $$$ " * 10, s, "x") for i, (good, s) in enumerate([(1, "good")] * 30 + [(0, "bad")] * 30 + [(1, "small")])], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(0, 60, 3)], "doc_id long, quality int")
    got = {r.doc_id: r for r in site_bayes.classify(docs, labels).collect()}
    assert got[0].path_share > 0.8 and got[30].path_share < 0.2 and 0.3 < got[60].path_share < 0.7
