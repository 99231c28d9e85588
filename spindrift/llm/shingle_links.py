"""Near copies by the Jaccard similarity of word shingles: the wide notion that SimHash with few bits can't carry.

Texts whose sets of five-word shingles have a similarity of 4/5 or more are linked. SimHash fingerprints of these shingles
and their vantage-point trees (`simhash`) gather texts within a few bits; as 4/5 is up to 14 bits, a radius at which
no vantage point tells anything apart, MinHash bands gather the rest (a pair of exactly 4/5 shares none of the 32 bands of 5
with a chance of 3 in a million, a closer one less). In each band's bucket the least member is a vantage point: all others
are compared with it by their signatures, a byte for each of the 160 least hashes, and those that agree in LIKE bytes are of
one family (at 4/5 they agree in 128 on average; in fewer than LIKE with a chance of one in 10 thousand million). The rest
of a bucket, with those whose distance from the vantage point doesn't rule a link to them out, is searched among itself.

Every link is then decided by exact counts of whole sets. Again the least member of a family is its vantage point, and the others are
compared with it, in a plain join whose hot families Spark can split. Jaccard's distance obeys the triangle inequality, so
a text that isn't linked there can only be linked to texts no nearer the vantage point than its own distance less 1/5: only these
and it meet in one task, and search among themselves breadth first. A family of near copies of one text, however large,
thus ends with the join.

Words are lower-cased (ASCII). A text of fewer than five words is one shingle; null, empty and white texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from spindrift.llm import simhash
from spindrift.llm.blocks import lean
from spindrift.llm.common import materialize
from spindrift.llm.components import connected_components

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 32, 5
SEED = 42
SLICE = 1 << 10
#: Bytes of signatures that must agree for two texts to be of one family.
LIKE = 96
SLACK = 1e-9
#: The table of texts in families, 24 bytes a row, goes to the texts by broadcast up to so many only; beyond, texts are shuffled to it.
BROADCAST_ROWS = 2_000_000

_draw = np.random.default_rng(SEED)
_TURN = _draw.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _draw.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order; never none."""
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)], strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1))


def sketch(own: np.ndarray) -> tuple[list[int], bytes]:
    """A signed 64-bit key for each band, and the signature."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), SLICE):
        np.minimum(least, ((own[at : at + SLICE, None] ^ _TURN) * _TIMES).min(axis=0), out=least)
    keys = [xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist(), (least >> np.uint64(16)).astype(np.uint8).tobytes()


def alike(signatures: np.ndarray) -> np.ndarray:
    """For each signature (a row of bytes) the index of the first one that agreement in LIKE bytes reaches from it."""
    label, left, queue = np.arange(len(signatures)), np.arange(len(signatures)), []
    while len(left):
        if not queue:
            root, queue, left = left[0], [left[0]], left[1:]
        at = queue.pop()
        found = (signatures[left] == signatures[at]).sum(axis=1) >= LIKE
        label[left[found]] = root
        queue += left[found].tolist()
        left = left[~found]
    return label


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def reach(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the index of the first one that links of similarity LEAST reach from it."""
    up, down = LEAST
    label = np.arange(len(sets))
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    names, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    # A linked set shares at least LEAST of its members with others: what can't is left out, until nothing changes.
    while len(order):
        shared = np.add.reduceat((np.bincount(flat, minlength=len(names)) > 1)[flat].astype(np.int64), _starts(sizes)[:-1])
        live = shared * down >= up * sizes
        if live.all():
            break
        flat, order, sizes = flat[np.repeat(live, sizes)], order[live], sizes[live]
    mark, queue = np.zeros(len(names), bool), []
    starts = _starts(sizes)
    while queue or len(order):
        if not queue:
            root, found = order[0], np.arange(len(order)) == 0
        else:
            own, found = queue.pop(), np.zeros(len(order), bool)
            low = np.searchsorted(sizes, -(-up * len(own) // down))
            high = np.searchsorted(sizes, down * len(own) // up, "right")
            if low < high:
                mark[own] = True
                both = np.add.reduceat(mark[flat[starts[low] : starts[high]]].astype(np.int64), starts[low:high] - starts[low])
                mark[own] = False
                found[low:high] = both * down >= up * (sizes[low:high] + len(own) - both)
        if found.any():
            queue += [flat[starts[k] : starts[k + 1]].copy() for k in np.flatnonzero(found)]
            label[order[found]] = root
            flat, order, sizes = flat[np.repeat(~found, sizes)], order[~found], sizes[~found]
            starts = _starts(sizes)
    first = np.full(len(sets), len(sets))
    np.minimum.at(first, label, np.arange(len(sets)))
    return first[label]


def distances(a: np.ndarray, b: np.ndarray) -> tuple[float, bool]:
    """Jaccard's distance of two sets of numbers in order, and whether they are linked."""
    up, down = LEAST
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return 1 - both / either, both * down >= up * either


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _forest(kind):
    """Links that join the members of a group, given (content, members), as kind says they belong together."""

    def link(group: pa.Table) -> pa.Table:
        content, first = np.unique(group.column("content").to_numpy(), return_index=True)
        root = content[kind(group.column("members").take(pa.array(first)))]
        return pa.table({"a": content[root != content], "b": root[root != content]})

    return link


def families(keys: DataFrame, signatures: DataFrame) -> DataFrame:
    """Links (a, b) between contents that join all those of one bucket of keys(content, key) that are alike by signatures(content, members)."""
    heads = keys.groupBy("key").agg(F.min("content").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "head")
    met = materialize(keys.join(heads, "key").where("content <> head"))
    left = met.select("content", "head").distinct().join(signatures, "content")
    left = left.join(signatures.select(F.col("content").alias("head"), F.col("members").alias("other")), "head")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("members", "other"))
            far = BANDS * ROWS - (a == b).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("content"), batch.column("head"), pa.array(far, pa.int32())], names=["content", "head", "far"])

    far = materialize(left.select("content", "head", "members", "other").mapInArrow(compare, "content long, head long, far int"))
    most = BANDS * ROWS - LIKE
    star = far.where(F.col("far") <= most).select(F.col("content").alias("a"), F.col("head").alias("b"))
    # What isn't like the head of its bucket, and what the triangle inequality doesn't keep apart from that.
    placed = met.join(far, ["content", "head"])
    open_ = placed.where(F.col("far") > most).groupBy("key").agg(F.min("far").alias("least"))
    rest = placed.join(open_, "key").where(F.col("far") >= F.col("least") - most).select("key", "content")
    several = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rest = rest.join(several, "key").join(signatures, "content")
    like = _forest(lambda column: alike(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)))
    return star.unionByName(rest.groupBy("key").applyInArrow(like, "a long, b long"))


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all contents of one part of sets(part, head, content, members) that links of similarity LEAST join;
    head is one of the part's contents."""
    heads = sets.where("content = head").select("part", F.col("members").alias("other")).dropDuplicates(["part"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [distances(a, b) for a, b in zip(_sets(batch.column("members")), _sets(batch.column("other")), strict=True)]
            far, linked = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("part", "content", "head")], pa.array(far, pa.float64()), pa.array(linked, pa.bool_())], names=["part", "content", "head", "far", "linked"])

    met = sets.where("content <> head").join(heads, "part").select("part", "content", "head", "members", "other")
    far = materialize(met.mapInArrow(compare, "part long, content long, head long, far double, linked boolean"))
    star = far.where("linked").select(F.col("content").alias("a"), F.col("head").alias("b"))
    open_ = far.where("not linked").groupBy("part").agg(F.min("far").alias("least"))
    reach_of = (LEAST[1] - LEAST[0]) / LEAST[1] + SLACK
    rest = far.join(open_, "part").where(F.col("far") >= F.col("least") - reach_of).select("part", "content").distinct()
    several = rest.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
    rest = rest.join(several, "part", "left_semi")
    rest = rest.join(sets.select("part", "content", "members"), ["part", "content"]).dropDuplicates(["part", "content"])
    return star.unionByName(rest.groupBy("part").applyInArrow(lean(_forest(lambda column: reach(_sets(column)))), "a long, b long"))


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, content (a hash of the text), root: for each distinct text its least id (null ids last) and the least content linked with it."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys, signatures = zip(*[sketch(shingles(t)) for t in texts], strict=True) if texts else ((), ())
            made = [pa.array([simhash.fingerprint(t, SHINGLE) for t in texts], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["doc_id", "content", "fp", "bands", "members"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shingles(t).tobytes() for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], names=["part", "head", "content", "members"])

    signed = own.mapInArrow(sign, "doc_id long, content long, fp long, bands array<long>, members binary")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))
    first = [F.first(c).alias(c) for c in ("fp", "bands", "members")]
    signed = materialize(signed.groupBy("content").agg(F.min(rank).alias("rank"), *first).select("rank.id", "content", "fp", "bands", "members"))
    # One content for each fingerprint; the others of it, and those within the radius, are of its family.
    classes = materialize(signed.groupBy("fp").agg(F.min("content").alias("one")))
    near = simhash.classes_and_links(classes.select("fp"))
    one = lambda name: classes.select(F.col("fp").alias(name), F.col("one").alias(f"{name}_one"))
    near = near.join(one("a"), "a").join(one("b"), "b").select(F.col("a_one").alias("a"), F.col("b_one").alias("b"))
    near = near.unionByName(signed.join(classes, "fp").where("content <> one").select(F.col("content").alias("a"), F.col("one").alias("b")))
    banded = families(signed.select("content", F.explode("bands").alias("key")), signed.select("content", "members"))
    met = materialize(connected_components(banded.unionByName(near)))
    met = met.union(met.select(F.col("root").alias("node"), "root").distinct())
    # The root of a family is its least content, and its vantage point.
    chosen = signed.select("id", "content").join(met, F.col("content") == F.col("node"))
    chosen = materialize(chosen.select(F.col("id").alias("__id"), F.col("content").alias("__content"), F.col("root").alias("head")))
    small = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    found = own.join(small, (F.col("content") == F.col("__content")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    found = found.select(F.col("head").alias("part"), "head", "content", "text")
    sets = materialize(found.mapInArrow(cut, "part long, head long, content long, members binary"))
    roots = connected_components(links(sets))
    return signed.join(roots, F.col("content") == F.col("node"), "left").select(F.col("id").alias("doc_id"), "content", F.coalesce("root", "content").alias("root"))
