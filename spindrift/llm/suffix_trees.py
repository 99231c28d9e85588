"""Removal of repeated word sequences through prefix-partitioned suffix trees.

Suffixes are sequences of words, and a repeat is a path of WINDOW words in their tree that suffixes of two documents
share. Of the GRAM-word starts within a window the one with the least hash is its anchor, and equal windows have equal
anchors, so the tree is cut by prefixes of the suffixes that begin at anchors: prefixes of variable length, where one
with too large a share of a bounded sample is split by its next word, until every group fits in memory; small ones
are packed together. Neighbouring windows of one anchor travel to its group as one passage of real words, numbers
into a list of words that comes with each packet. The group sorts all suffixes of its passages by word, takes the
common-prefix lengths of neighbours, and so has the internal nodes of its subtree; those as deep as a window are the
repeats, and each knows the least id below it. Words decide, never fingerprints. As no window looks further, suffixes end
at WINDOW words, and the repeats longer than that are the spans that the windows of a document make together.

Before that, anchors that only one document has are pruned by their hashes, with the windows that need them. A block sends
each different passage once with the least id it has for it, so a passage that a third of all documents share costs one
entry a block, and gets one bit a window back: whether a smaller id lies elsewhere.

A word is removed if a window over it also starts in a document with a smaller id; windows are judged on the input.
Null texts have no words. Null ids count as larger than any other. Rows that repeat an id don't remove each other.
Documents of fewer words than a window pass unchanged. A worker holds a block, or its longest text, some 30 times.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.blocks import ANSWER, SENT, Rolling, answered, answers, from_planes, into_blocks, lean, met_elsewhere, mix64, pack, planes, send_keys, sent, sizes_by_part, sliding_least, unpack
from spindrift.llm.common import materialize

WINDOW = 13
ANCHOR = 7
ANCHOR_WIDTH = 5
#: Documents and suffixes that the driver sees to choose prefixes, whatever the corpus.
SAMPLE_DOCS = 2000
SAMPLE_EACH = 64

ROLL = Rolling()
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words text[start:end], eight bytes at a time over all words at once."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    view = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,))
    mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    length = end - start
    hashes = mix64(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    left = np.flatnonzero(length > 0)
    done = 0
    while len(left):
        at, rest = start[left] + done, length[left] - done
        if done == 256:  # words that long are few
            hashes[left] = [int.from_bytes(hashlib.blake2b(text[a : a + n].tobytes(), digest_size=8).digest(), "little") ^ int(h) for a, n, h in zip(at.tolist(), rest.tolist(), hashes[left].tolist(), strict=True)]
            break
        hashes[left] = mix64(hashes[left] ^ (view[at] & mask[np.minimum(rest, 8)])) * np.uint64(0x9FB21C651E98DF25)
        done += 8
        left = left[rest > 8]
    return mix64(hashes)


class Words:
    """The texts of one block as one array of words, by hash."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.joined = b"\n".join(texts) + b"\n"
        joined = np.frombuffer(self.joined, np.uint8)
        white = (joined == 32) | ((joined >= 9) & (joined <= 13))
        edge = np.flatnonzero(np.diff(white.view(np.int8), prepend=1))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.begin, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))  # the first word of each document, and the end
        self.hash = word_hashes(joined, self.begin, self.end)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.sums = ROLL.sums(self.hash)

    def number(self, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Of the words at some places their numbers among the different ones of these (0 elsewhere), and these. Hashes sort them,
        bytes decide."""
        text = lambda k: self.joined[self.begin[k] : self.end[k]]
        out = np.zeros(len(self.hash), np.int64)
        _, one, word = np.unique(self.hash[at], return_index=True, return_inverse=True)
        if self._same(at, at[one][word]):
            out[at] = word
            return out, [text(k) for k in at[one].tolist()]
        numbers = defaultdict(count().__next__)
        out[at] = np.fromiter((numbers[text(k)] for k in at.tolist()), np.int64, len(at))
        return out, list(numbers)

    def _same(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the words at a have the bytes of those at b."""
        a, b = a[a != b], b[a != b]
        length = self.end[a] - self.begin[a]
        if (length != self.end[b] - self.begin[b]).any():
            return False
        padded = np.frombuffer(self.joined + bytes(8), np.uint8)
        view = np.ndarray((len(self.joined) + 1,), "<u8", padded, strides=(1,))
        mask = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        done, left = 0, np.arange(len(a))
        while len(left):
            if ((view[self.begin[a[left]] + done] ^ view[self.begin[b[left]] + done]) & mask[np.minimum(length[left] - done, 8)]).any():
                return False
            done += 8
            left = left[length[left] > done]
        return True

    def starts(self, length: int) -> np.ndarray:
        """Where a stretch of `length` words lies within one document."""
        n = max(0, len(self.hash) - length + 1)
        return self.doc[:n] == self.doc[length - 1 : length - 1 + n]

    def paths(self, at: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the stretches of `length` words at some starts."""
        return ROLL.stretch(self.sums, at, length)

    def anchors(self, window: int, gram: int):
        """Per gram start: its hash and whether it is an anchor; per window start: the hash of its anchor, NONE where there is no window."""
        n = max(0, len(self.hash) - window + 1)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
        width = window - gram + 1
        hashes = ROLL.stretch(self.sums, slice(0, n + width - 1), gram)
        least = sliding_least(hashes, width)
        valid = self.starts(window)
        chosen = np.zeros(len(hashes), bool)
        for k in range(width):
            chosen[k : k + n] |= valid & (hashes[k : k + n] == least)
        return hashes, chosen, np.where(valid, least, NONE)

    def passages(self, starts: np.ndarray, hashes: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows as passages, each of neighbours with one anchor: the first window, how many there are, the anchor."""
        anchor = np.full(len(starts), -1)
        for k in range(width):
            hit = (anchor < 0) & (hashes[starts + k] == least[starts]) if len(starts) else anchor < 0
            anchor[hit] = starts[hit] + k
        first = np.flatnonzero((np.diff(starts, prepend=-2) != 1) | (np.diff(anchor, prepend=-2) != 0))
        return starts[first], np.diff(np.append(first, len(starts))), anchor[first]

    def distinct(self, keys: np.ndarray, at: np.ndarray):
        """Distinct keys, where each of `keys` is among them, the least and the largest id of each."""
        ids = self.ids[self.doc[at]]
        names, where = np.unique(keys, return_inverse=True)
        least, most = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(least, where, ids)
        np.maximum.at(most, where, ids)
        return names, where, least, most


class Prefixes:
    """Prefixes of variable length that cut the suffixes into groups, and the part that each group goes to."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.parts = parts
        self.split: list[np.ndarray] = []  # by length less one: prefixes that go on, as 128-bit pairs
        heavy = max(1, len(sample) // (4 * parts))
        rest = sample
        for length in range(1, sample.shape[1] if len(sample) else 0):
            keys, where, count = np.unique(self._key(rest, length), return_inverse=True, return_counts=True)
            self.split.append(keys[count > heavy])
            rest = rest[(count > heavy)[where]]
            if not len(rest):
                break

    @staticmethod
    def _key(symbols: np.ndarray, length: int) -> np.ndarray:
        full = np.zeros((len(symbols), 16), np.uint8)
        full[:, :length] = symbols[:, :length]
        both = full.view("<u8")
        return mix64(mix64(both[:, 0] + np.uint64(length)) ^ both[:, 1])

    def part(self, symbols: np.ndarray) -> np.ndarray:
        key = self._key(symbols, 1)
        going = np.ones(len(symbols), bool)
        for length, split in enumerate(self.split, 1):
            at = np.flatnonzero(going)
            on = np.isin(self._key(symbols[at], length), split)
            going[at[~on]] = False
            key[at[on]] = self._key(symbols[at[on]], length + 1)
        return (mix64(key) % np.uint64(self.parts)).astype(np.int64)


def sorted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of some suffixes, given as rows of word numbers, and the common-prefix length of each with the one before."""
    order = np.lexsort(words.T[::-1]) if len(words) else np.zeros(0, np.int64)
    same = words[order][1:] == words[order][:-1]
    return order, np.concatenate([[0], np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))]).astype(np.int64)[: len(order)]


def deep_nodes(common: np.ndarray, depth: int) -> np.ndarray:
    """Where, in sorted order, the leaves of each node of at least `depth` words begin; a leaf that shares less is a node of its own."""
    return np.flatnonzero(common < depth)


def least_below(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each suffix the least id below its deep node."""
    order, common = sorted_suffixes(words)
    begin = deep_nodes(common, words.shape[1])
    out = np.zeros(len(ids), np.int64)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], begin), np.diff(np.append(begin, len(order))))
    return out


def _symbols(own: Words, at: np.ndarray, gram: int) -> np.ndarray:
    """The first words of the suffixes at anchors, as symbols of 8 bits that only choose a group."""
    return own.hash[at[:, None] + np.arange(gram)].astype(np.uint8)


def _first(own: Words, window: int, gram: int):
    hashes, chosen, least = own.anchors(window, gram)
    at = np.flatnonzero(chosen)
    names, where, low, high = own.distinct(mix64(hashes[at]), at)  # mixed again: least hashes crowd at the low end
    return hashes, at, least, names, where, low != high


class Passages:
    """What a block sends in the second round: its different passages of windows that may repeat, in the order of parts."""

    def __init__(self, own: Words, heard: pa.Table, parts: int, window: int, gram: int, prefixes: Prefixes):
        hashes, at, least, names, where, twice = _first(own, window, gram)
        repeated = (answered(heard, 1, sizes_by_part(names, parts)) | twice)[where]
        alive = np.full(len(hashes), NONE)
        alive[at[repeated]] = hashes[at[repeated]]
        width = window - gram + 1
        self.starts = np.flatnonzero((sliding_least(alive, width) == least) & (least != NONE)) if len(hashes) else np.zeros(0, np.int64)
        begin, count, anchor = own.passages(self.starts, hashes, least, width)
        marks = np.zeros(len(own.hash) + 1, np.int32)
        np.add.at(marks, begin, 1)
        np.add.at(marks, begin + count + window - 1, -1)
        self.word, self.names = own.number(np.flatnonzero(np.cumsum(marks[:-1]) > 0))
        words, seen = self.word.astype("<i4").tobytes(), {}
        where = np.array([seen.setdefault(words[4 * a : 4 * b], len(seen)) for a, b in zip(begin.tolist(), (begin + count + window - 1).tolist(), strict=True)], np.int64)
        one = np.zeros(len(seen), np.int64)
        one[where] = np.arange(len(begin))
        part = prefixes.part(_symbols(own, anchor[one], gram))
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.part, self.begin, self.count = part[order], begin[one][order], count[one][order]
        self.low = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(self.low, place[where], own.ids[own.doc[begin]])
        # Of each window: its passage, and its place among the windows of all passages.
        self.passage = np.repeat(place[where], count)
        ends = np.cumsum(self.count)
        self.window = (ends - self.count)[self.passage] + self.starts - np.repeat(begin, count)

    def sizes(self) -> dict[int, int]:
        """How many windows go to each part."""
        found, begin = np.unique(self.part, return_index=True)
        return dict(zip(found.tolist(), np.add.reduceat(self.count, begin).tolist(), strict=True)) if len(found) else {}

    def rows(self, block: int, window: int) -> list[tuple]:
        found, begin = np.unique(self.part, return_index=True)
        groups = np.split(np.arange(len(self.part)), begin[1:]) if len(found) else []
        return [(p, block, int(self.count[mine].sum()), self._packet(mine, window)) for p, mine in zip(found.tolist(), groups, strict=True)]

    def _packet(self, mine: np.ndarray, window: int) -> bytes:
        """Some passages as bytes: the words they have, their numbers, the passages' lengths and ids."""
        length = self.count[mine] + window - 1
        at = np.repeat(self.begin[mine] - np.cumsum(length) + length, length) + np.arange(length.sum())
        used, numbers = np.unique(self.word[at], return_inverse=True)
        names = [self.names[k] for k in used.tolist()]
        return pack(
            np.array([len(w) for w in names], "<u4").tobytes(), b"".join(names), numbers.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(),
            length.astype("<u4").tobytes(), planes(self.low[mine], 8),
        )


def _suffixes(packets: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of `window` words in the passages of some packets, as rows of numbers that sort as their words do, and their ids."""
    seen: dict[bytes, int] = {}
    words, starts, ids, at = [], [], [], 0
    for data in packets:
        lengths, joined, numbers, length, low = unpack(data)
        ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64).tolist()
        mine = np.array([seen.setdefault(joined[a:b], len(seen)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int32)
        words.append(mine[np.frombuffer(numbers, "<u2" if len(mine) <= 1 << 16 else "<u4")])
        length = np.frombuffer(length, "<u4").astype(np.int64)
        count = length - window + 1
        begin = at + np.cumsum(length) - length
        starts.append(np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum()))
        ids.append(np.repeat(from_planes(low, len(length), 8).view(np.int64), count))
        at += len(words[-1])
    names = list(seen)
    place = np.empty(len(names), np.int32)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return place[np.concatenate(words)][np.concatenate(starts)[:, None] + np.arange(window)], np.concatenate(ids)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = ANCHOR) -> DataFrame:
    """row (all columns but the text), kept (remaining words, joined by a space), spans (maximal runs of removed words, [from, to)), n_words, n_removed, kept_sha256."""
    blocks, parts = into_blocks(docs, id_col, text)
    slim = blocks.select("block", "id", "text")
    prefixes = Prefixes(_sample(docs, id_col, text, window, gram), parts)

    def load(table: pa.Table) -> Words:
        return Words(table.column("id").to_numpy(), table.column("text").to_pylist())

    def anchors(table: pa.Table) -> pa.Table:
        return send_keys(table.column("block")[0].as_py(), _first(load(table), window, gram)[3], parts, ANCHOR_WIDTH)

    def passages(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([])
        own = load(table)
        return sent(Passages(own, heard, parts, window, gram, prefixes).rows(table.column("block")[0].as_py(), window))

    def subtrees(table: pa.Table) -> pa.Table:
        words, low = _suffixes(table.column("data").to_pylist(), window)
        return answers(table.column("block").to_pylist(), 2, table.column("part")[0].as_py(), table.column("n").to_numpy(), least_below(words, low) < low)

    fields = [T.StructField("row", blocks.schema["row"].dataType), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))]
    fields += [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def cut(table: pa.Table, heard: pa.Table) -> pa.Table:
        own = load(table)
        asked = Passages(own, heard, parts, window, gram, prefixes)
        smaller = answered(heard, 2, asked.sizes())
        hit = asked.starts[smaller[asked.window] | (asked.low[asked.passage] < own.ids[own.doc[asked.starts]])]
        marks = np.zeros(len(own.hash) + 1, np.int32)
        np.add.at(marks, hit, 1)
        np.add.at(marks, hit + window, -1)
        gone = np.cumsum(marks[:-1]) > 0
        kept, spans, removed = [], [], []
        for t, a, b in zip(own.texts, own.first[:-1].tolist(), own.first[1:].tolist(), strict=True):
            words, inside = t.split(), gone[a:b]
            edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0)) if inside.any() else np.zeros(0, np.int64)
            spans.append(edge.reshape(-1, 2).tolist())
            removed.append(int(inside.sum()))
            kept.append(b" ".join(words if not len(edge) else [words[k] for k in np.flatnonzero(~inside).tolist()]))
        return pa.table(
            {
                "row": table.column("row"),
                "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                "n_words": pa.array(np.diff(own.first), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
        )

    first = materialize(slim.groupBy("block").applyInArrow(lean(anchors), SENT).groupBy("part").applyInArrow(lean(met_elsewhere(1, ANCHOR_WIDTH)), ANSWER))
    second = slim.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(lean(passages), SENT)
    second = materialize(second.groupBy("part").applyInArrow(lean(subtrees), ANSWER))
    return blocks.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(lean(cut), T.StructType(fields))


def _sample(docs: DataFrame, id_col: str, text: str, window: int, gram: int) -> np.ndarray:
    """Symbols of a bounded sample of the suffixes at anchors."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(every)) == 0).select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            own = Words(np.zeros(batch.num_rows, np.int64), batch.column(0).to_pylist())
            at = np.flatnonzero(own.anchors(window, gram)[1])
            at = at[np.argsort(mix64(own.paths(at, gram)), kind="stable")[: SAMPLE_EACH * batch.num_rows]]
            yield pa.RecordBatch.from_arrays([pa.array([_symbols(own, at, gram).tobytes()], pa.binary())], names=["symbols"])

    # Ordered by hash and limited: however the ids hash, the driver sees no more than this.
    rows = some.mapInArrow(run, "symbols binary").orderBy(F.xxhash64("symbols")).limit(SAMPLE_DOCS).collect()
    return np.frombuffer(b"".join(bytes(r[0]) for r in rows)[: SAMPLE_DOCS * SAMPLE_EACH * gram], np.uint8).reshape(-1, gram)
