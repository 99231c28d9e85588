"""Exchange of keys and passages between blocks of documents.

A block is a set of documents small enough for one worker. It sends, to the part of the key space that owns them, its
distinct keys once each, packed as bytes; the part answers with bits, in the order in which the keys came. Both
directions therefore move a few bytes a key, and a key that a third of all documents share costs one entry a block.

Sizes follow the corpus: blocks and parts keep their least size up to some 50 GB of text, and then grow with its square
root, so that a packet holds PACKET keys or more and a block sends a bounded number of packets, however many parts there
are. At 100 TB that means blocks of 64 MB, parts of some 1.1 GB of text (85 million keys of 8 bytes) and workers of 4 GB.

A row's block is a hash of its id, text and place in the input, so equal rows are spread too. The place is that of a
file scan, which a lost task repeats.
"""

from __future__ import annotations

import ctypes
import inspect
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import input_bytes, scratch_root, while_writing

BLOCK_BYTES, BLOCK_MOST = 3 << 20, 64 << 20
PART_BYTES = 8 << 20
#: Bytes of text in a block times those in a part, per byte of the corpus: about 50 sampled keys a packet.
SPREAD = 700
PACKET = 48
BUCKET_BYTES = 32 << 20
MOST_BUCKETS = 100_000
#: Null ids sort last.
LAST = (1 << 63) - 1

SENT = "part int, block int, n int, data binary"
ANSWER = "block int, round int, part int, bits binary"


def layout(size: int) -> tuple[int, int]:
    """How many blocks and parts (a power of two) a corpus of so many bytes makes."""
    block = min(BLOCK_MOST, max(BLOCK_BYTES, math.isqrt(SPREAD * size) // 2))
    part = max(PART_BYTES, SPREAD * size // block)
    return max(1, math.ceil(size / block)), 1 << max(1, math.ceil(math.log2(max(1, size / part))))


def into_blocks(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """block, id, text (as bytes) and row (a struct of all columns but the text); and the number of parts for their keys.

    The blocks are written once as a table bucketed by block, in the folder that driver and executors share. Every pass
    over them, and every join of answers to them, then finds its rows together: texts are shuffled once, not in each pass.
    """
    size = input_bytes(docs, text)
    n, parts = layout(size)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    blocks = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("block"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        F.struct(*rest).alias("row"),
    )
    spark, name = docs.sparkSession, f"spindrift_{uuid.uuid4().hex}"
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES)))
    writer = blocks.repartition(buckets, "block").write.format("parquet").bucketBy(buckets, "block")
    with while_writing(spark):
        writer.option("path", f"{scratch_root(spark)}/spindrift/{name}").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the frame keeps the files of an external table
    return stored, parts


def lean(work):
    """work, a function of one table or of two, after which freed memory goes back to the system: a Python worker that waits
    for its next task then holds little, however much the last one took."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    def one(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            trim()

    def two(table: pa.Table, heard: pa.Table) -> pa.Table:
        try:
            return work(table, heard)
        finally:
            trim()

    return one if len(inspect.signature(work).parameters) == 1 else two


def planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned values, byte by byte over all values: sorted or small ones then compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes | np.ndarray, n: int, width: int) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return full.reshape(-1).view("<u8")


def pack(*pieces: bytes) -> bytes:
    """Some byte strings as one, compressed."""
    whole = b"".join(pieces)
    head = np.array([len(whole), *map(len, pieces)], "<u8").tobytes()
    return len(pieces).to_bytes(8, "little") + head + pa.compress(whole, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    size, *lengths = np.frombuffer(data, "<u8", n + 1, 8).tolist()
    whole = pa.decompress(data[16 + 8 * n :], decompressed_size=size, codec="zstd", asbytes=True)
    ends = np.cumsum([0, *lengths]).tolist()
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that owns a key: its top bits."""
    return (keys >> np.uint64(64 - int(math.log2(parts)))).astype(np.int64)


def send_keys(block: int, keys: np.ndarray, parts: int, width: int) -> pa.Table:
    """keys: sorted and distinct. One row for each part that gets any; `width` bytes below the part's own bits are sent."""
    bits = int(math.log2(parts))
    found, begin = np.unique(part_of(keys, parts), return_index=True)
    below = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width)
    edges = np.append(begin, len(keys)).tolist()
    return sent([(p, block, b - a, planes(below[a:b], width)) for p, a, b in zip(found.tolist(), edges[:-1], edges[1:], strict=True)])


def sent(rows: list[tuple]) -> pa.Table:
    part, block, n, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"part": pa.array(part, pa.int32()), "block": pa.array(block, pa.int32()), "n": pa.array(n, pa.int32()), "data": pa.array(data, pa.binary())})


def answers(blocks: list[int], round_: int, part: int, sizes: np.ndarray, flags: np.ndarray) -> pa.Table:
    """One bit a key, in the order in which each block sent them."""
    bits = [np.packbits(x).tobytes() for x in np.split(flags, np.cumsum(sizes)[:-1])]
    return answer([(b, round_, part, x) for b, x in zip(blocks, bits, strict=True)])


def answer(rows: list[tuple]) -> pa.Table:
    block, round_, part, bits = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table({"block": pa.array(block, pa.int32()), "round": pa.array(round_, pa.int32()), "part": pa.array(part, pa.int32()), "bits": pa.array(bits, pa.binary())})


def met_elsewhere(round_: int, width: int):
    """For one part: which keys more than one block sent."""

    def meet(sent: pa.Table) -> pa.Table:
        sizes = sent.column("n").to_numpy()
        keys = np.concatenate([from_planes(x, n, width) for x, n in zip(sent.column("data").to_pylist(), sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        flags = np.zeros(len(keys), bool)
        flags[order[1:][same]] = True
        flags[order[:-1][same]] = True
        return answers(sent.column("block").to_pylist(), round_, sent.column("part")[0].as_py(), sizes, flags)

    return meet


def answered(table: pa.Table, round_: int, sizes: dict[int, int]) -> np.ndarray:
    """The bits of a round for a block that sent sizes[part] keys to each part, in the order of parts."""
    got = {p: b for r, p, b in zip(table.column("round").to_pylist(), table.column("part").to_pylist(), table.column("bits").to_pylist(), strict=True) if r == round_}
    bits = [np.unpackbits(np.frombuffer(got[p], np.uint8), count=n).astype(bool) for p, n in sorted(sizes.items()) if n]
    return np.concatenate(bits) if bits else np.zeros(0, bool)


def sizes_by_part(keys: np.ndarray, parts: int) -> dict[int, int]:
    found, count = np.unique(part_of(keys, parts), return_counts=True)
    return dict(zip(found.tolist(), count.tolist(), strict=True))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = x ^ (x >> np.uint64(33))
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from those of powers of two."""
    n, reach = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    least = values
    while 2 * reach <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    return np.minimum(least[:n], least[width - reach : width - reach + n])


class Rolling:
    """Fingerprints of any stretch of a sequence of 64-bit letters, from prefix sums of a polynomial modulo 2**64.

    Equal stretches have equal fingerprints; unequal ones may clash, on purpose even, so they only rule out.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers, out=powers))

    def sums(self, letters: np.ndarray) -> np.ndarray:
        self._grow(len(letters) + 1)
        out = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * self.up[: len(letters)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, at: np.ndarray | slice, length: int) -> np.ndarray:
        """Fingerprints of the stretches of a length that begin at `at`."""
        behind = slice(at.start + length, at.stop + length) if isinstance(at, slice) else at + length
        return mix64((sums[behind] - sums[at]) * self.down[at] + np.uint64(length))
