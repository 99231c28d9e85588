"""Removal of long byte strings that repeat, by a distributed difference-cover algorithm.

The corpus is first sampled by a wide difference cover: any two positions can be shifted by one k < V so that both
residues fall in COVER. So if two places share LENGTH bytes, they share a tuple of LENGTH - V + 1 bytes that begins
at a sampled position in both. Blocks send names (fingerprints) of their sampled tuples to the parts that own them, and a
name that stands alone ends there. Windows within reach of a repeated name are named and sent in the same way, and
those met again remain. Equal strings have equal names, so this loses nothing, but what remains need not repeat.

The remaining suffixes are dealt anew, as real bytes: neighbouring windows of one anchor (the least hash of their
GRAM-byte strings, equal in equal windows) travel as one passage to the part that owns the anchor, which sorts the passages
of some anchors at a time: triples sampled by the difference cover {1, 2} modulo 3 are sorted and named by rank, names
that tie are sorted by recursion, the other suffixes are sorted by first byte and rank of the next and merged in,
and the prefixes of neighbours in that order are compared byte by byte. Only those that share LENGTH bytes are repeats:
no fingerprint decides.

Matches never cross documents, and are judged on the input. Null texts count as empty. Repeated rows are repeats of each
other. Texts shorter than LENGTH pass unchanged. A worker holds about 40 times its block, or its longest text, and
some 100 times GROUP_BYTES of passages, or all the different passages of one anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spindrift.llm.blocks import ANSWER, SENT, Rolling, answer, answered, into_blocks, lean, met_elsewhere, mix64, pack, part_of, send_keys, sent, sizes_by_part, sliding_least, unpack
from spindrift.llm.common import discard, materialize

LENGTH = 400
#: A perfect difference set: 14 residues whose differences are every number modulo 183 (Singer, 13**2 + 13 + 1).
V = 183
COVER = (0, 1, 8, 24, 37, 41, 59, 107, 119, 128, 134, 139, 153, 181)
#: Bytes of a name that travel, beside the bits that its part implies; a clash only adds candidates.
NAME_WIDTH = 5
GRAM = 24
#: Windows of one passage at most: a long run of one anchor (a run of one letter) makes several.
PASSAGE = 1 << 14
#: Bytes of passages that are sorted at once.
GROUP_BYTES = 1 << 20

LETTERS = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
ROLL = Rolling()


class Bytes:
    """The texts of one block as one array of bytes."""

    def __init__(self, texts: list[bytes], length: int):
        self.texts, self.length = texts, length
        self.joined = b"".join(texts)
        self.all = np.frombuffer(self.joined, np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.start, self.end = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends
        self._sums = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = ROLL.sums(LETTERS[self.all])
        return self._sums

    def sampled(self, cover: tuple[int, ...], v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions, and start and end of their documents. Residues count from a document's start."""
        span = self.length - v + 1
        long = self.end - self.start >= self.length
        longest = int((self.end - self.start).max(initial=0))
        grid = (np.arange(longest // v + 1)[:, None] * v + np.array(cover)).ravel()
        begin, stop = self.start[long], self.end[long]
        counts = np.searchsorted(grid, stop - begin - span, side="right")
        at = [grid[:n] + b for b, n in zip(begin.tolist(), counts.tolist(), strict=True)]
        return (np.concatenate(at) if at else np.zeros(0, np.int64)), np.repeat(begin, counts), np.repeat(stop, counts)

    def near(self, at: np.ndarray, begin: np.ndarray, stop: np.ndarray, v: int) -> np.ndarray:
        """Positions whose window holds one of the sampled tuples at `at`."""
        marks = np.zeros(len(self.all) + 1, np.int32)
        low, high = np.maximum(at - v + 1, begin), np.minimum(at, stop - self.length)
        some = low <= high
        np.add.at(marks, low[some], 1)
        np.add.at(marks, high[some] + 1, -1)
        return np.flatnonzero(np.cumsum(marks[:-1]) > 0)

    def passages(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows at `starts` as passages: first window, number of windows, anchor."""
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint64)
        gram = min(GRAM, self.length)
        least = sliding_least(ROLL.stretch(self.sums, slice(0, len(self.all) - gram + 1), gram), self.length - gram + 1)[starts]
        doc = np.searchsorted(self.end, starts, side="right")
        new = (np.diff(starts, prepend=-2) != 1) | (np.diff(doc, prepend=-1) != 0)
        new[1:] |= least[1:] != least[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        pieces = -(-count // PASSAGE)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[first].repeat(pieces) + step * PASSAGE
        return begin, np.minimum(count.repeat(pieces) - step * PASSAGE, PASSAGE), mix64(least[first]).repeat(pieces)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which bytes the windows at `starts` cover."""
        marks = np.zeros(len(self.all) + 1, np.int32)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + self.length, -1)
        return np.cumsum(marks[:-1]) > 0


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs, in their order."""
    return np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of positive numbers in lexicographic order, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda k: tuple(text[k:])), np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with an empty suffix where the last triple would have no end
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    # Sorted triples are named by rank.
    pair = _named(t[sample], t[sample + 1])
    names = _named(pair, t[sample + 2]) + 1
    rank = np.zeros(n + 3, np.int64)
    if names.max() < len(sample):  # names that tie are told apart by what follows: the suffixes of the sequence of names
        rank[sample[suffix_order(names)]] = np.arange(1, len(sample) + 1)
    else:
        rank[sample] = names
    # The other suffixes by their first letter and the rank of the next, which is sampled.
    zeros = np.arange(0, n, 3)
    one = lambda at: (t[at].astype(np.uint64) << np.uint64(32)) | rank[at + 1].astype(np.uint64)
    zeros = zeros[np.argsort(one(zeros), kind="stable")]
    ordered = sample[np.argsort(rank[sample], kind="stable")]
    first, second = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    # Merged: residues 0 and 1 compare at a shift of one, 0 and 2 at a shift of two, where both are sampled.
    both = np.concatenate([zeros, second])
    pair = _named(t[both], t[both + 1]).astype(np.uint64)
    two = (pair << np.uint64(32)) | rank[both + 2].astype(np.uint64)
    less = np.searchsorted(one(first), one(zeros)) + np.searchsorted(two[len(zeros) :], two[: len(zeros)])
    out = np.empty(len(zeros) + len(ordered), np.int64)
    place = np.arange(len(zeros)) + less
    out[place] = zeros
    free = np.ones(len(out), bool)
    free[place] = False
    out[free] = ordered
    return out[out < n]


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many letters text[a:] and text[b:] have in common, `most` at the most; eight at a time."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    view = np.ndarray((len(text) + 8,), "<u8", padded, strides=(1,))
    length, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while len(live):
        off = view[a[live] + length[live]] ^ view[b[live] + length[live]]
        same = np.where(off == 0, 8, np.bitwise_count((off & (~off + np.uint64(1))) - np.uint64(1)) >> 3)
        length[live] += same
        live = live[(same == 8) & (length[live] < most[live])]
    return np.minimum(length, most)


def repeated_windows(passages: list[bytes], twice: np.ndarray, length: int) -> list[np.ndarray]:
    """For each of some different passages, which of its windows of a length occur anywhere else in them. All windows of a
    passage that is there twice do."""
    joined = np.frombuffer(b"\0".join(passages) + b"\0", np.uint8)
    sizes = np.array([len(p) for p in passages], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_order(joined.astype(np.int64) + 1)
    end = np.repeat(begin + sizes, sizes + 1)  # of the passage that a position is in
    order = order[end[order] - order >= length]  # windows; those that share a prefix of `length` stay neighbours
    before = np.full(len(joined), -1, np.int64)
    before[order[1:]] = order[:-1]
    # A pair of neighbours that follows, letter by letter, another pair of neighbours shares one letter less than it.
    at = np.flatnonzero(before >= 0)
    prior = np.maximum(at - 1, 0)
    follows = (before[prior] >= 0) & (before[at] == before[prior] + 1) & (joined[prior] == joined[before[prior]]) & (at > 0) & (end[prior] == end[at]) & (end[np.maximum(before[at] - 1, 0)] == end[before[at]])
    heads = np.flatnonzero(~follows)
    run = np.diff(np.append(heads, len(at)))
    a, b = at[heads], before[at[heads]]
    common = np.repeat(shared_prefix(joined, a, b, np.minimum(end[a] - a, end[b] - b)), run) - (np.arange(len(at)) - np.repeat(heads, run))
    flags = np.zeros(len(joined), bool)
    hit = at[common >= length]
    flags[hit] = True
    flags[before[hit]] = True
    return [np.ones(n - length + 1, bool) if t else flags[s : s + n - length + 1] for s, n, t in zip(begin.tolist(), sizes.tolist(), twice.tolist(), strict=True)]


def _first(own: Bytes, v: int, cover: tuple[int, ...]):
    at, begin, stop = own.sampled(cover, v)
    names, where, count = np.unique(ROLL.stretch(own.sums, at, own.length - v + 1), return_inverse=True, return_counts=True)
    return at, begin, stop, names, where, count


def _second(own: Bytes, heard: pa.Table, parts: int, v: int, cover: tuple[int, ...]):
    at, begin, stop, names, where, count = _first(own, v, cover)
    repeated = answered(heard, 1, sizes_by_part(names, parts)) | (count > 1)
    kept = repeated[where]
    starts = own.near(at[kept], begin[kept], stop[kept], v)
    names, where, count = np.unique(ROLL.stretch(own.sums, starts, own.length), return_inverse=True, return_counts=True)
    return starts, names, where, count


def _third(block: int, own: Bytes, starts: np.ndarray, parts: int) -> list[tuple]:
    """The remaining windows as passages, different ones once for each part; and a row that tells the block itself, later,
    which windows the answers are about."""
    begin, count, anchor = own.passages(starts)
    part = part_of(anchor, parts)
    order = np.argsort(part, kind="stable")
    found, edge = np.unique(part[order], return_index=True)
    rows, place = [], np.zeros(len(begin), np.int64)
    for p, mine in zip(found.tolist(), np.split(order, edge[1:]) if len(found) else [], strict=True):
        seen: dict[bytes, int] = {}
        texts = [own.joined[a : a + c] for a, c in zip(begin[mine].tolist(), (count[mine] + own.length - 1).tolist(), strict=True)]
        where = np.array([seen.setdefault(t, len(seen)) for t in texts], np.int64)
        one = np.zeros(len(seen), np.int64)
        one[where] = mine
        place[mine] = where
        sizes = np.array([len(t) for t in seen], "<u4")
        twice = np.bincount(where) > 1
        rows.append((p, block, len(seen), pack(anchor[one].astype("<u8").tobytes(), sizes.tobytes(), twice.tobytes(), b"".join(seen))))
    rows.append((-1 - block, block, 0, pack(begin.astype("<u8").tobytes(), count.astype("<u4").tobytes(), part.astype("<i4").tobytes(), place.astype("<u4").tobytes())))
    return rows


def _groups(anchors: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Passages by anchor, in groups of about GROUP_BYTES that never split an anchor."""
    order = np.argsort(anchors, kind="stable")
    total = np.cumsum(sizes[order])
    new = np.flatnonzero(np.diff(anchors[order]) != 0) + 1
    cuts, last = [], 0
    for k in new.tolist():
        if total[k - 1] - last >= GROUP_BYTES:
            cuts.append(k)
            last = total[k - 1]
    return np.split(order, cuts) if len(order) else []


def _judge(length: int):
    """For one part: which windows of its passages repeat. Rows that a block sent to itself pass."""

    def judge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        blocks, packets = table.column("block").to_pylist(), table.column("data").to_pylist()
        if part < 0:
            return answer([(b, 0, part, d) for b, d in zip(blocks, packets, strict=True)])
        seen: dict[bytes, int] = {}
        anchors, twice, told = [], [], []
        for data in packets:
            anchor, sizes, double, whole = unpack(data)
            ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
            mine = []
            for name, a, b, d in zip(np.frombuffer(anchor, "<u8").tolist(), [0, *ends[:-1]], ends, np.frombuffer(double, bool).tolist(), strict=True):
                text = whole[a:b]
                k = seen.setdefault(text, len(seen))
                if k == len(anchors):
                    anchors.append(name)
                    twice.append(d)
                else:
                    twice[k] = True
                mine.append(k)
            told.append(mine)
        passages = list(seen)
        flags = [np.ones(len(p) - length + 1, bool) for p in passages]
        # Where all passages of an anchor are there twice, nothing is left to ask.
        names, double = np.array(anchors, np.uint64), np.array(twice, bool)
        asked = np.flatnonzero(np.isin(names, names[~double]))
        for group in _groups(names[asked], np.array([len(passages[k]) for k in asked.tolist()], np.int64)):
            mine = asked[group]
            for k, f in zip(mine.tolist(), repeated_windows([passages[k] for k in mine.tolist()], double[mine], length), strict=True):
                flags[k] = f
        return answer([(b, 3, part, np.packbits(np.concatenate([flags[k] for k in mine])).tobytes()) for b, mine in zip(blocks, told, strict=True)])

    return judge


def _repeats(own: Bytes, heard: pa.Table) -> np.ndarray:
    """The starts of the windows that repeat, from what the block told itself and the parts' answers."""
    rows = list(zip(*[heard.column(c).to_pylist() for c in ("round", "part", "bits")], strict=True))
    begin, count, part, place = unpack(next(bits for r, _, bits in rows if r == 0))
    begin, count, part, place = np.frombuffer(begin, "<u8").astype(np.int64), np.frombuffer(count, "<u4").astype(np.int64), np.frombuffer(part, "<i4"), np.frombuffer(place, "<u4").astype(np.int64)
    hits = [np.zeros(0, np.int64)]
    for r, p, bits in rows:
        if r == 3:
            mine = np.flatnonzero(part == p)
            windows = np.zeros(place[mine].max() + 1, np.int64)
            windows[place[mine]] = count[mine]
            ends = np.cumsum(windows)
            flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(ends[-1]))
            total = np.concatenate([[0], np.cumsum(flags)])
            for k in mine[total[ends[place[mine]]] > total[ends[place[mine]] - windows[place[mine]]]].tolist():
                e = ends[place[k]]
                hits.append(begin[k] + np.flatnonzero(flags[e - windows[place[k]] : e]))
    return np.concatenate(hits)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, v: int = V, cover: tuple[int, ...] = COVER, as_text: bool = False) -> DataFrame:
    """row (all columns but the text), kept (the remaining bytes), spans (maximal removed runs, [from, to)), n_bytes, n_removed, n_spans, kept_sha256.

    as_text: kept is a string, without what a cut leaves of a character.
    """
    if length < v or {(a - b) % v for a in cover for b in cover} != set(range(v)):
        raise ValueError("the residues must cover all differences, and the length their modulus")
    blocks, parts = into_blocks(docs, id_col, text)
    slim = blocks.select("block", "text")

    def load(table: pa.Table) -> tuple[int, Bytes]:
        return table.column("block")[0].as_py(), Bytes(table.column("text").to_pylist(), length)

    def tuples(table: pa.Table) -> pa.Table:
        block, own = load(table)
        return send_keys(block, _first(own, v, cover)[3], parts, NAME_WIDTH)

    def suffixes(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([])
        block, own = load(table)
        return send_keys(block, _second(own, heard, parts, v, cover)[1], parts, NAME_WIDTH)

    def passages(table: pa.Table, heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return sent([])
        block, own = load(table)
        starts, names, where, count = _second(own, heard, parts, v, cover)
        repeated = answered(heard, 2, sizes_by_part(names, parts)) | (count > 1)
        return sent(_third(block, own, starts[repeated[where]], parts))

    fields = [T.StructField("row", blocks.schema["row"].dataType), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))]
    fields += [T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]

    def cut(table: pa.Table, heard: pa.Table) -> pa.Table:
        own = Bytes(table.column("text").to_pylist(), length)
        gone = own.covered(_repeats(own, heard))
        kept, spans = [], []
        for t, a, b in zip(own.texts, own.start.tolist(), own.end.tolist(), strict=True):
            inside = gone[a:b]
            if not inside.any():
                kept.append(t)
                spans.append([])
                continue
            edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
            spans.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).tolist())
            kept.append(own.all[a:b][~inside].tobytes())
        n = [len(t) for t in own.texts]
        return pa.table(
            {
                "row": table.column("row"),
                "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
                "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                "n_bytes": pa.array(n, pa.int64()),
                "n_removed": pa.array([a - len(b) for a, b in zip(n, kept, strict=True)], pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
        )

    first = materialize(slim.groupBy("block").applyInArrow(lean(tuples), SENT).groupBy("part").applyInArrow(lean(met_elsewhere(1, NAME_WIDTH)), ANSWER))
    second = slim.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(lean(suffixes), SENT)
    second = materialize(second.groupBy("part").applyInArrow(lean(met_elsewhere(2, NAME_WIDTH)), ANSWER))
    third = slim.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(lean(passages), SENT)
    third = materialize(third.groupBy("part").applyInArrow(lean(_judge(length)), ANSWER))
    discard(first, second)
    return blocks.select("block", "text", "row").groupBy("block").cogroup(third.groupBy("block")).applyInArrow(lean(cut), T.StructType(fields))
