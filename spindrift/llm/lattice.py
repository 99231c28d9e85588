"""Embedding near-duplicates by lattice hashing: E8 cells in several tables, neighbouring cells probed, cosine verified.

Vectors of equal label are scaled to length 1 and turned by a seeded random rotation, whose coordinates, eight at a
time, are the random projections of T tables. Two vectors of cosine c differ by a squared distance of 2 - 2c in
all, so in one table at least by no more than a T-th of it. In each table a vector lives in the cell of its nearest E8
point and visits those cells with a smaller key that may hold a partner within that distance; two such vectors thus
meet in exactly one cell a table, and no pair above the threshold is lost. A pair counts in the first table that is close
enough, so no table of pairs is needed to count a pair once.

What travels first is short: each batch of vectors sends every part of the cell space one compressed packet, with its cells,
the members in each as numbers into the packet's list, and their eight coordinates from the cell's lattice point, a byte
each. Members that have a close partner by these are then verified by cosine in double precision, with their
vectors. Cells that a bounded sample of SAMPLE vectors expects to hold more than CELL members are split into blocks, and
pairs of blocks go to tasks of their own. Equal vectors are one class with a weight, and vectors that differ by a
factor are scaled first, so that none is too small to square. What leaves a cell is a count and one link for each vector,
not pairs.

Vectors that are null, zero, or hold null or non-finite components, or that have no label, link with nothing. Vectors of
different length never link. Rows that repeat an id are vectors of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.blocks import mix64, pack, planes, unpack, from_planes
from spindrift.llm.common import discard, materialize
from spindrift.llm.components import connected_components
from spindrift.llm.simhash import join_labels

COSINE = 0.98
#: The distance that a table must bridge, in units of the lattice with least distance sqrt(2). Larger: smaller cells, more visits.
REACH = 0.3
CELL = 4096
#: Vectors that the driver sees to find the cells to split, whatever their number.
SAMPLE = 1 << 12
#: Vectors of one packet, visits of a part, and rows of one Python call that verifies, at the most or about.
BATCH, VISITS, GROUP = 10_000, 400_000, 20_000
#: One step of a coordinate's byte, in units of the lattice, and what rounding can add to a distance there.
STEP = 0.0138
SLACK = 8**0.5 * STEP + 1e-3


@lru_cache(maxsize=1)
def shells() -> np.ndarray:
    """The E8 vectors of norm 2 and 4. Up to a reach of (sqrt(6) - 2), no cell beyond them can hold a partner."""
    whole = [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) in (2, 4)]
    whole += [tuple(2 * s * (k == i) for k in range(8)) for i in range(8) for s in (1, -1)]
    halves = [s for s in itertools.product((-0.5, 0.5), repeat=8)]
    halves += [tuple(3 * x if k == i else x for k, x in enumerate(s)) for s in list(halves) for i in range(8)]
    return np.array(whole + [v for v in halves if sum(v) % 2 == 0], np.float64)


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates and an even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    off = y[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    closer = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


def cell_key(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A key for each lattice point, from its doubled coordinates, and a salt."""
    packed = np.ascontiguousarray((points * 2).astype(np.int64).astype(np.int8)).view(np.uint64)[:, 0]
    return mix64(packed ^ salt)


def visits(y: np.ndarray, salt: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, cell, is home) of every cell that each row lives in or visits."""
    return visited(y, salt, reach)[:3]


def visited(y: np.ndarray, salt: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As visits, and the lattice point of each cell."""
    vectors = shells()
    norm = (vectors**2).sum(axis=1)
    home = nearest(y)
    key = cell_key(home, salt)
    index, cells, centre = [np.arange(len(y))], [key], [home]
    for at in range(0, len(y), 2048):
        rest = y[at : at + 2048] - home[at : at + 2048]
        i, v = np.nonzero((norm - 2 * rest @ vectors.T) / (2 * np.sqrt(norm)) <= reach + 1e-9)
        other = cell_key(home[at + i] + vectors[v], salt[at + i])
        smaller = other < key[at + i]
        index.append(at + i[smaller])
        cells.append(other[smaller])
        centre.append(home[at + i[smaller]] + vectors[v[smaller]])
    return np.concatenate(index), np.concatenate(cells), np.arange(sum(map(len, index))) < len(y), np.concatenate(centre)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, so that no square is too small or too large."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, padded to a multiple of eight and rotated: rows x tables x 8."""
    size = -(-vectors.shape[1] // 8) * 8
    full = np.zeros((len(vectors), size))
    full[:, : vectors.shape[1]] = unit(vectors)
    return (full @ rotation(size)).reshape(len(vectors), -1, 8)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _tables(batch: pa.RecordBatch, cosine: float, reach: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, cell, is home, table, coordinates) of all visits of a batch(k, salt, embedding), by length and table."""
    lengths = np.diff(batch.column("embedding").offsets.to_numpy())
    salts = mix64(batch.column("salt").to_numpy().view(np.uint64))
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == size)
        blocks = turned(_matrix(batch.column("embedding").take(pa.array(rows))))
        for t in range(blocks.shape[1]):
            scale = np.sqrt((2 - 2 * cosine) / blocks.shape[1]) / reach
            index, cell, home, centre = visited(blocks[:, t] / scale, mix64(salts[rows] + np.uint64(t) + (np.uint64(size) << np.uint64(32))), reach)
            coords = np.clip(np.rint((blocks[index, t] / scale - centre) / STEP), -127, 127).astype(np.int8)
            yield rows[index], cell, home, np.full(len(index), t, np.uint16), coords


def _crowded(vectors: DataFrame, n: int, cosine: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells that a bounded sample expects to hold more than CELL members, in order, and the blocks to split them into."""
    some = vectors.orderBy(F.xxhash64("k", F.lit(7)), "k").limit(SAMPLE).toArrow().combine_chunks()
    found = [cell for batch in some.to_batches() for _, cell, *_ in _tables(batch, cosine, reach)]
    cells, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    blocks = np.ceil(count * (n / max(1, min(n, SAMPLE))) / CELL).astype(np.int64)
    return cells[blocks > 1], blocks[blocks > 1]


#: What a visit's flags say: it is at home, it is on the second side of its task, the task has two sides; then the table.
HOME, SIDE, CROSS, TABLE = 1, 2, 4, 8


def _split(index, cell, home, t, coords, keys: np.ndarray, crowded: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, task, flags, coordinates): a visit's cell is its task, unless the cell is crowded; then it is one for each pair of blocks."""
    flags = home * HOME + t * TABLE
    if not len(crowded[0]):
        return index, cell, flags.astype(np.uint16), coords
    at = np.minimum(np.searchsorted(crowded[0], cell), len(crowded[0]) - 1)
    blocks = np.where(crowded[0][at] == cell, crowded[1][at], 1)
    own = (mix64(keys[index].view(np.uint64) + np.uint64(99)) % blocks.astype(np.uint64)).astype(np.int64)
    copy = np.repeat(np.arange(len(cell)), blocks)
    other = np.arange(len(copy)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low, high = np.minimum(own[copy], other), np.maximum(own[copy], other)
    task = np.where(blocks[copy] > 1, mix64(cell[copy] ^ mix64(((low << 32) | high).astype(np.uint64) + np.uint64(1))), cell[copy])
    flags = flags[copy] + (low != high) * (CROSS + (own[copy] == high) * SIDE)
    return index[copy], task, flags.astype(np.uint16), coords[copy]


def _packets(cosine: float, reach: float, crowded: tuple[np.ndarray, np.ndarray], parts: int):
    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column("k").to_numpy()
        made = [_split(*visit, keys, crowded) for visit in _tables(batch, cosine, reach)]
        if not made:
            return
        index, task, flags, coords = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.lexsort((task, task % np.uint64(parts)))
        part = (task[order] % np.uint64(parts)).astype(np.int64)
        found, begin = np.unique(part, return_index=True)
        out = []
        for mine in np.split(order, begin[1:]):
            members, number = np.unique(index[mine], return_inverse=True)
            tasks, count = np.unique(task[mine], return_counts=True)
            out.append(
                pack(
                    tasks.astype("<u8").tobytes(), count.astype("<u4").tobytes(), keys[members].astype("<i8").tobytes(), planes(number.astype(np.uint64), 3),
                    flags[mine].astype("<u2").tobytes(), np.ascontiguousarray(coords[mine].T).tobytes(),
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(out, pa.binary())], names=["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                held.append(batch.slice(at, BATCH))
                if sum(b.num_rows for b in held) >= BATCH:
                    yield from send(pa.concat_batches(held))
                    held = []
        if held:
            yield from send(pa.concat_batches(held))

    return run


def _pairs(home: np.ndarray, side: np.ndarray, cross: bool, close) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to look at in one task, in slices: not both visitors, and from side to side if the task has two."""
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(len(home)),) * 2
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        x, y = np.nonzero(close(rows, right) & (home[rows][:, None] | home[right][None, :]))
        x, y = rows[x], right[y]
        once = np.ones(len(x), bool) if cross else x < y
        yield x[once], y[once]


def _edges(task: np.ndarray) -> list[tuple[int, int]]:
    """Where each task of two rows or more begins and ends, in a sorted column of them."""
    begin = np.flatnonzero(np.append(True, task[1:] != task[:-1])) if len(task) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(task))
    return list(zip(begin[end - begin > 1].tolist(), end[end - begin > 1].tolist(), strict=True))


ACTIVE = "task long, k long, flags int"


def _active(reach: float):
    """The members with a partner that is close in this table, by their rounded coordinates."""
    limit = np.float32(((reach + SLACK) / STEP) ** 2)

    def run(group: pa.Table) -> pa.Table:
        columns = []
        for data in group.column("data").to_pylist():
            tasks, count, keys, number, flags, coords = unpack(data)
            flags = np.frombuffer(flags, "<u2")
            task = np.repeat(np.frombuffer(tasks, "<u8"), np.frombuffer(count, "<u4"))
            columns.append((task, np.frombuffer(keys, "<i8")[from_planes(number, len(flags), 3).astype(np.int64)], flags, np.frombuffer(coords, np.int8).reshape(8, -1).T))
        task, keys, flags, coords = (np.concatenate(x) for x in zip(*columns, strict=True))
        order = np.argsort(task, kind="stable")
        task, keys, flags, coords = task[order], keys[order], flags[order], coords[order].astype(np.float32)
        square, home, side = (coords**2).sum(axis=1), flags & HOME > 0, flags & SIDE > 0
        marked = np.zeros(len(task), bool)
        for s, e in _edges(task):
            if home[s:e].any():
                c, q = coords[s:e], square[s:e]
                for x, y in _pairs(home[s:e], side[s:e], bool(flags[s] & CROSS), lambda r, o, c=c, q=q: q[r][:, None] + q[o][None, :] - 2 * (c[r] @ c[o].T) <= limit):
                    marked[s + x] = marked[s + y] = True
        return pa.table({"task": pa.array(task[marked].view(np.int64)), "k": pa.array(keys[marked]), "flags": pa.array(flags[marked], pa.int32())})

    return run


def _verified(cosine: float):
    def same_length(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("task").to_numpy(), kind="stable")))
        task, keys, label, weight, flags = (group.column(c).to_numpy() for c in ("task", "k", "label", "weight", "flags"))
        home, side, t = flags & HOME > 0, flags & SIDE > 0, flags // TABLE
        vectors = unit(_matrix(group.column("embedding")))
        blocks = turned(vectors)
        near = (2 - 2 * cosine) / blocks.shape[1] * (1 + 1e-9)
        links, to = np.zeros(len(keys), np.int64), keys.copy()
        for s, e in _edges(task):
            v, root = vectors[s:e], np.arange(e - s)
            for x, y in _pairs(home[s:e], side[s:e], bool(flags[s] & CROSS), lambda r, o, v=v: v[r] @ v[o].T >= cosine - 1e-9):
                exact = np.einsum("ij,ij->i", v[x], v[y]) / np.sqrt(np.einsum("ij,ij->i", v[x], v[x]) * np.einsum("ij,ij->i", v[y], v[y])) >= cosine
                exact &= label[s + x] == label[s + y]
                x, y = x[exact], y[exact]
                first = (((blocks[s + x] - blocks[s + y]) ** 2).sum(axis=2) <= near).argmax(axis=1) == t[s]
                x, y = x[first], y[first]
                np.add.at(links, s + x, weight[s + y])
                np.add.at(links, s + y, weight[s + x])
                join_labels(root, x, y)
            to[s:e] = keys[s:e][root]
        some = links > 0
        return pa.table({"k": pa.array(keys[some]), "links": pa.array(links[some]), "to": pa.array(to[some])})

    def run(group: pa.Table) -> pa.Table:
        lengths = np.diff(group.column("embedding").combine_chunks().offsets.to_numpy())
        return pa.concat_tables([same_length(group.filter(pa.array(lengths == n))) for n in np.unique(lengths).tolist()])

    return run


def _classes(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own with k, and its classes of equal label and vector: k is a hash of both, with a salt by which no two classes share it."""
    for salt in range(64):
        keyed = own.withColumn("k", F.when(F.col("sound"), F.xxhash64("label", "embedding", F.lit(salt))))
        classes = keyed.where("sound").groupBy("k", "label", "embedding")
        classes = materialize(classes.agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight")))
        total = classes.agg(F.count(F.lit(1)), F.count_distinct("k")).first()
        if total[0] == total[1]:
            return keyed, classes
        discard(classes)
    raise RuntimeError("no salt tells all classes apart")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, reach: float = REACH) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    if not 0 < reach < 6**0.5 - 2:
        raise ValueError("the reach must lie between 0 and sqrt(6) - 2")
    kind = vectors.schema[embedding].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("embedding"), F.col(label).cast("long").alias("label"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    own, classes = _classes(own.withColumn("sound", F.coalesce(sound, F.lit(False))))
    spread, n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count()
    salted = classes.select("k", F.xxhash64("label").alias("salt"), "embedding")
    crowded = _crowded(salted, n, cosine, reach)
    tables = classes.agg(F.max(F.ceil(F.size("embedding") / 8))).first()[0] or 1
    packets = salted.mapInArrow(_packets(cosine, reach, crowded, max(spread, n * tables * 10 // VISITS)), "part int, data binary")
    active = materialize(packets.groupBy("part").applyInArrow(_active(reach), ACTIVE))
    groups = max(spread, active.count() // GROUP)
    packed = active.withColumn("g", F.pmod(F.xxhash64("task"), F.lit(groups)).cast("int"))
    found = packed.join(classes.select("k", "label", "weight", "embedding"), "k").groupBy("g").applyInArrow(_verified(cosine), "k long, links long, to long")
    found = materialize(found)
    discard(active)
    counts = materialize(found.groupBy("k").agg(F.sum("links").alias("links")))
    roots = connected_components(found.select(F.col("k").alias("a"), F.col("to").alias("b")))
    placed = classes.select("k", "first", "weight").join(roots, F.col("k") == F.col("node"), "left").join(counts, "k", "left")
    placed = materialize(placed.select("k", "first", "weight", F.coalesce("root", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    least = materialize(placed.groupBy("root").agg(F.min("first").alias("component")))
    placed = materialize(placed.join(least, "root").select("k", "weight", "links", "component"))
    done = own.select("vec_id", "k").join(placed, "k", "left")
    component = F.coalesce("component", "vec_id")
    return done.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
