"""SimHash near-duplicates against brute force."""

import random
import time

import numpy as np
import xxhash

from spindrift.llm import simhash
from spindrift.llm.components import connected_components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_forest_finds_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for b in base for _ in range(3)]
    dense = [base[0] ^ np.uint64(m) for m in range(500)]
    fps = np.unique(np.concatenate([base, near, np.array(dense, np.uint64)]))
    got, want = simhash.forest(fps), brute_components([int(x) for x in fps])
    assert got.tolist() == want
    depth = 4
    index, shard = simhash.deal(fps, simhash.plant(fps[::5], depth), depth)
    assert len(index) < 3 * len(fps)
    label = np.arange(len(fps))
    for s in np.unique(shard):
        own = np.sort(index[shard == s])
        root = own[simhash.forest(fps[own])]
        simhash.join_labels(label, own, root)
    assert label.tolist() == want


def test_bands_deal_every_link_without_growing_copies():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for b in base[:600] for _ in range(2)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = brute_components([int(x) for x in fps])
    for depth in (7, 10):
        index, shard = simhash.deal_by_bands(fps, simhash.plant(fps[::3], 5)[0], depth)
        assert len(index) == 3 * len(fps) and np.bincount(np.unique(shard, return_inverse=True)[1]).max() < len(fps) / 2 ** (depth - 4)
        label = np.arange(len(fps))
        for s in np.unique(shard):
            own = np.sort(index[shard == s])
            simhash.join_labels(label, own, own[simhash.forest(fps[own])])
        assert label.tolist() == want


def test_forest_grows_little_faster_than_its_input():
    rng = np.random.default_rng(7)
    took = []
    for n in (1 << 16, 1 << 19):
        fps = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        began = time.process_time()
        simhash.forest(fps)
        took.append(time.process_time() - began)
    assert took[1] / took[0] < 8**1.25


def test_near_duplicates(spark):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(2, 6)))
    texts = ["", None, " \n", "one", "one two", "One TWO", "Éa b c"]
    for _ in range(25):
        words = [word() for _ in range(400)]
        texts.append(" ".join(words))
        for _ in range(3):
            words[random.randrange(400)] = word()
            texts.append(" ".join(words))
    texts += [texts[10]] * 5
    ids = list(range(100, 100 + len(texts)))
    random.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), strict=True)), "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp % 2**64 for i in ids] == fps
    roots = brute_components(fps)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    assert [got[i].component_id for i in ids] == [least[r] for r in roots]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 99), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 100: 99, 101: 99}


def test_scratch_can_be_cleared(spark):
    from spindrift.llm.common import clear_scratch, materialize

    kept = materialize(spark.range(3))
    assert kept.count() == 3
    clear_scratch(spark)
    assert materialize(spark.range(2)).count() == 2
