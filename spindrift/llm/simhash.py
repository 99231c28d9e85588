"""SimHash near-duplicates through vantage-point trees.

Fingerprints are made from whole texts in Arrow batches and reduced to classes of equal ones. A top tree of vantage
points, chosen from a bounded sample, deals the classes to shards by Hamming distance: a fingerprint within `radius`
of the vantage point goes left; one beyond it goes right, and left as well if the triangle bound can't exclude a partner
there. Up to WHOLE levels the distance is that of all bits, and the bound is `bits`. Random fingerprints lie in a dense
shell around any point, so copies would add up further down; deeper trees therefore see one band of the bits at a time.
Of `bits` + 1 bands, two fingerprints within `bits` agree in one entirely: there the distance is a distance too, the triangle
bound is 0, and the tree splits without copies, as deep as their number asks for. So every pair within `bits` meets in
some shard, each pair being compared only there. A shard groups its members by band in the same way; groups
of more than LEAF are split by vantage points with the full bound, and what none of these splits is compared in
blocks. Only a spanning forest of a shard's links leaves it, so a group of thousands of near copies gives thousands
of rows, not millions.

Null and empty texts, and those of white space, have fingerprint zero and link like any other. Repeated rows share a
fingerprint. Null ids count as larger than any other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from spindrift.llm.blocks import mix64
from spindrift.llm.common import materialize
from spindrift.llm.components import connected_components

SHINGLE = 3
BITS = 2
SEED = 42
#: Fingerprints that the driver sees to choose vantage points, whatever the corpus.
SAMPLE = 1 << 14
SHARD = 1 << 11
#: Levels of the tree by whole distances, with 1.2 copies a level; deeper ones go by bands. Levels that have points of the sample.
WHOLE, PLANTED = 6, 12
LEAF = 64
SLICE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return int(np.array(xxh64_intdigest(b" ".join(words), seed), np.uint64).view(np.int64))
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        part = hashes[at : at + SLICE]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """df without its text and with the fingerprint of it; a column of the same name is replaced."""
    df = df.drop(*[c for c in (out,) if c != text])
    at = df.columns.index(text)
    rest = [f for f in df.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(t) for t in batch.column(at).to_pylist()], pa.int64())
            keep = [batch.column(k) for k in range(batch.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*keep, made], names=[*[f.name for f in rest], out])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.LongType())]))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def plant(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete tree in heap order, from sampled fingerprints."""
    points, radii = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, 32, np.int16)
    own = {0: sample}
    for node in range(len(points)):
        here = own.pop(node, sample)
        here = here if len(here) else sample
        tried = here[:: max(1, len(here) // 8)][:8]
        far = [_far(here, p) for p in tried]
        best = max(range(len(tried)), key=lambda k: (int(far[k].std() * 1000), -k))
        points[node], radii[node] = tried[best], int(np.median(far[best]))
        left = far[best] <= radii[node]
        own[2 * node + 1], own[2 * node + 2] = here[left], here[~left]
    return points, radii


def deal(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index, shard) pairs: every shard in which a fingerprint must be present."""
    index, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    for _ in range(depth):
        far = _far(fps[index], tree[0][node])
        left, right = far <= tree[1][node] + bits, far > tree[1][node]
        index, node = np.concatenate([index[left], index[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return index, node


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins i and j in a forest of labels, each pointing at the least of its tree."""
    while len(i):
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            return
        i, j = i[open_], j[open_]
        np.minimum.at(label, high[open_], low[open_])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def bands(bits: int) -> list[np.uint64]:
    """Masks that cut 64 bits into bits + 1 bands: fingerprints that differ in no more than `bits` agree in one band."""
    edges = [64 * k // (bits + 1) for k in range(bits + 2)]
    return [np.uint64((1 << b) - (1 << a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def deal_by_bands(fps: np.ndarray, points: np.ndarray, depth: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index, shard) pairs: a shard a band for each fingerprint, by its band's distances from vantage points.

    The first levels have the sampled points; deeper ones have points drawn from the node's number. A bound of 0 needs no radius
    that suits the data to be right, only to be even.
    """
    shards = []
    for k, mask in enumerate(bands(bits)):
        node = np.zeros(len(fps), np.int64)
        radius = int(mask).bit_count() // 2
        for _ in range(depth):
            point = np.where(node < len(points), points[np.minimum(node, len(points) - 1)], mix64(node.astype(np.uint64) + np.uint64(SEED)))
            far = np.bitwise_count((fps ^ point) & mask)
            # A band of even width: one half of those at the middle distance goes with the nearer, by their first bit.
            left = (far < radius) | ((far == radius) & ((((fps ^ point) & mask & (~mask + np.uint64(1))) > 0) | (int(mask).bit_count() % 2 == 1)))
            node = 2 * node + np.where(left, 1, 2)
        shards.append(node * (bits + 1) + k)
    return np.tile(np.arange(len(fps)), bits + 1), np.concatenate(shards)


def forest(fps: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For distinct fingerprints, the index of the first one that links reach from each."""
    label = np.arange(len(fps))
    for mask in bands(bits):
        order = np.argsort(fps & mask, kind="stable")
        band = (fps & mask)[order]
        begin = np.flatnonzero(np.append(True, band[1:] != band[:-1])) if len(band) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(band)))
        small = np.repeat(size <= LEAF, size)
        # Small groups all at once: each member with the one k places on, as long as that is of its group.
        for k in range(1, int(size[size <= LEAF].max(initial=0))):
            at = np.flatnonzero(small[:-k] & (band[k:] == band[:-k]))
            near = _far(fps[order[at]], fps[order[at + k]]) <= bits
            join_labels(label, order[at[near]], order[at[near] + k])
        for s, n in zip(begin[size > LEAF].tolist(), size[size > LEAF].tolist(), strict=True):
            _grow(fps, np.sort(order[s : s + n]), label, bits)
    return label


def _grow(fps: np.ndarray, own: np.ndarray, label: np.ndarray, bits: int) -> None:
    """Joins the links among some fingerprints by a vantage-point tree."""
    stack = [own]
    while stack:
        own = stack.pop()
        if len(own) > LEAF:
            here = fps[own]
            for k in range(8):
                far = _far(here, here[(k * 7919 + len(own) // 2) % len(own)])
                radius = int(np.median(far))
                left, right = far <= radius + bits, far > radius
                if left.sum() + right.sum() < 1.6 * len(own) and 0 < right.sum() and left.sum() < len(own):
                    stack += [own[left], own[right]]
                    break
            else:
                _leaf(fps, own, label, bits)
        else:
            _leaf(fps, own, label, bits)


def _leaf(fps: np.ndarray, own: np.ndarray, label: np.ndarray, bits: int) -> None:
    step = max(1, (1 << 20) // max(1, len(own)))
    for at in range(0, len(own), step):
        rows = own[at : at + step]
        i, j = np.nonzero(_far(fps[rows][:, None], fps[own][None, :]) <= bits)
        join_labels(label, rows[i], own[j])


def classes_and_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of fps(fp) as all links within `bits` would."""
    n = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
    sample = np.array([r[0] for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = plant(sample, min(depth, PLANTED))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            index, shard = deal(own.view(np.uint64), tree, depth, bits) if depth <= WHOLE else deal_by_bands(own.view(np.uint64), tree[0], depth, bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(own[index])], names=["shard", "fp"])

    def links(group: pa.Table) -> pa.Table:
        own = np.unique(group.column("fp").to_numpy())
        root = own[forest(own.view(np.uint64), bits)]
        linked = root != own
        return pa.table({"a": own[linked], "b": root[linked]})

    dealt = fps.select("fp").mapInArrow(shards, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """doc_id, content (a hash of the text), fp, root (one fingerprint for each component), component_id (least id in it)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    slim = materialize(with_fingerprint(slim))
    classes = materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(classes_and_links(classes, bits))
    placed = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed)
    least = materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")))
    placed = materialize(placed.join(least, "root").select("fp", "root", "component_id"))
    return slim.join(placed, "fp").select("doc_id", "content", "fp", "root", "component_id")
