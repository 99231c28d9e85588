"""Both removals of repeats against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import blocks, suffix_array, suffix_trees


def brute_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    least = defaultdict(lambda: 2**64)
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least[key], i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdéfg", k=rnd.choice([1, 2, 3, 5, 9, 20])))
    passage = [[word() for _ in range(n)] for n in (12, 13, 14, 30, 90, 200)]
    texts = ["", None, " \t\n", "a " * 900, "x" * 1500, "one two"]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            parts += [word() for _ in range(rnd.randint(0, 60))]
            if rnd.random() < 0.6:
                p = rnd.choice(passage)
                a, b = sorted((rnd.randint(0, len(p)), rnd.randint(0, len(p))))
                parts += rnd.choice([p, p[a:b]])
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[20], texts[20], texts[21] + "!", "z" + texts[22], "a" * 700]
    return texts


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(blocks, "PART_BYTES", 9000)


def test_cover():
    assert {(a - b) % suffix_array.V for a in suffix_array.COVER for b in suffix_array.COVER} == set(range(suffix_array.V))


@pytest.mark.parametrize("length,v,cover", [(400, suffix_array.V, suffix_array.COVER), (60, 7, (0, 1, 3)), (31, 31, (1, 5, 11, 24, 25, 27))])
def test_suffix_array(spark, small_blocks, length, v, cover):
    texts = corpus(length)
    rows = list(zip(range(len(texts)), texts, range(len(texts)), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    got = {r.row.doc_id: r for r in suffix_array.remove_repeats(docs, length=length, v=v, cover=cover).collect()}
    want = brute_bytes(texts, length)
    assert len(got) == len(texts) and sum(w[1] for w in want) > 0
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    assert all(sum(b - a for a, b in got[i].spans) == got[i].n_removed for i in got)
    assert suffix_array.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("window,gram", [(13, 7), (3, 2), (5, 5)])
def test_suffix_trees(spark, small_blocks, window, gram):
    texts = corpus(window)
    ids = random.Random(1).sample(range(1000), len(texts))
    ids[9], ids[10], ids[11] = None, None, ids[12]
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, kept int")
    got = {r.row.kept: r for r in suffix_trees.remove_repeats(docs, window=window, gram=gram).collect()}
    want = brute_words(rows, window)
    assert sum(w[1] for w in want) > 0
    assert [(got[k].n_words, got[k].n_removed, got[k].kept_sha256) for k in range(len(rows))] == want
    assert suffix_trees.remove_repeats(docs.limit(0)).count() == 0


def test_clashing_names_remove_nothing(spark):
    """Two texts of equal names but different bytes, by the Thue-Morse sequence, which any such polynomial takes for its complement."""
    signs = [k.bit_count() % 2 for k in range(1024)]
    a, b = ("".join("xy"[s ^ flip] for s in signs) + "z" * 400 for flip in (0, 1))
    own = suffix_array.Bytes([a.encode(), b.encode()], 1424)
    names = suffix_array.ROLL.stretch(own.sums, np.array([0, 1424]), 1424)
    assert a != b and names[0] == names[1]
    docs = spark.createDataFrame([(1, a), (2, b), (3, a + "!")], "doc_id long, text string")
    got = {r.row.doc_id: r.n_removed for r in suffix_array.remove_repeats(docs, length=1424).collect()}
    assert got == {1: 1424, 2: 0, 3: 1424}


def test_suffix_order_and_repeated_windows():
    rnd = random.Random(1)
    for _ in range(200):
        text = np.array(rnd.choices(range(1, rnd.randint(3, 6)), k=rnd.randint(0, 60)), np.int64)
        assert suffix_array.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
    for _ in range(200):
        length = rnd.choice([1, 2, 5, 9, 12])
        base = [bytes(rnd.choices(b"ab\0", k=rnd.randint(length, 40))) for _ in range(3)]
        passages = list({rnd.choice(base) + bytes(rnd.choices(b"abc", k=rnd.randint(0, 8))) for _ in range(rnd.randint(1, 8))})
        twice = np.array([rnd.random() < 0.1 for _ in passages])
        seen = Counter(p[i : i + length] for p, t in zip(passages, twice, strict=True) for i in range(len(p) - length + 1) for _ in range(1 + t))
        want = [[seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in passages]
        assert [f.tolist() for f in suffix_array.repeated_windows(passages, twice, length)] == want


def test_packets_of_a_block_are_bounded_and_equal_rows_are_spread(spark):
    for size in (10**9, 10**11, 10**13, 10**14):
        n, parts = blocks.layout(size)
        keys = size / n * len(suffix_array.COVER) / suffix_array.V
        assert min(parts, keys) * 20 <= keys  # never near one key a packet
    docs = spark.range(100_000).selectExpr("7L AS doc_id", "repeat('equal ', 20) AS text")
    stored, _ = blocks.into_blocks(docs, "doc_id", "text")
    rows = [r["count"] for r in stored.groupBy("block").count().collect()]
    assert len(rows) > 2 and max(rows) < 60_000


def test_prefixes_split_and_agree():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 4, (4000, 13)).astype(np.uint8)
    symbols[:1500] = symbols[0]
    prefixes = suffix_trees.Prefixes(symbols[::3], 16)
    part = prefixes.part(symbols)
    assert len(prefixes.split) == 12 and len(set(part.tolist())) == 16
    assert len(set(part[:1500].tolist())) == 1 and np.bincount(part[1500:], minlength=16).max() < 700


def test_word_hashes():
    words = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefghj", b"x" * 300, b"x" * 301, b"x" * 256, b"\0", b"\0\0"]
    text = np.frombuffer(b" ".join(words) + b" " + b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words * 2]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    got = suffix_trees.word_hashes(text, starts, ends)
    assert got[:10].tolist() == got[10:].tolist() and len(set(got.tolist())) == 10


def test_words_of_one_hash_stay_apart():
    own = suffix_trees.Words(np.array([1, 2]), [b"a bb ccc a  bb", b"\tlonger-than-eight-bytes a\nlonger-than-eight-bytez"])
    every = np.arange(len(own.hash))
    for clash in (False, True):
        if clash:
            own.hash = own.hash & np.uint64(1)
        word, names = own.number(every)
        assert [names[k] for k in word.tolist()] == [w for t in own.texts for w in t.split()] and len(names) == 5


def test_deep_nodes_of_a_subtree():
    rnd = random.Random(3)
    words = np.array([rnd.choices(range(3), k=4) for _ in range(300)])
    ids = np.array(rnd.sample(range(1000), 300))
    order, common = suffix_trees.sorted_suffixes(words)
    rows = [tuple(r) for r in words[order].tolist()]
    assert rows == sorted(rows)
    assert common[1:].tolist() == [next((k for k in range(4) if a[k] != b[k]), 4) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    want = {r: min(i for i, w in zip(ids.tolist(), words.tolist(), strict=True) if w == list(r)) for r in set(rows)}
    assert suffix_trees.least_below(words, ids).tolist() == [want[tuple(w)] for w in words.tolist()]
    shallow = suffix_trees.deep_nodes(common, 2)
    assert len(shallow) == len({r[:2] for r in rows})
    assert len(suffix_trees.least_below(words[:0], ids[:0])) == 0
