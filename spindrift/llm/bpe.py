"""Byte-level BPE by a rank file: encoding in overlapping chunks, and decoding.

A text is cut into overlapping chunks, each chunk is pre-tokenised alone, and two neighbours are stitched at the
first boundary in their overlap on which both agree: the pattern looks back at nothing, so from there on both see
the same pre-tokens. If an overlap holds no such boundary (one run of letters or spaces longer than the overlap), the
left chunk grows by another chunk until there is one, so the result never depends on the chunk size. The
pre-tokens are then merged by rank, repeated ones from a bounded cache. Decoding joins the tokens' bytes.

Null texts count as empty and give no tokens. Repeated rows are encoded each. Memory is bounded by the Arrow batch,
the longest text and the cache. There is no shuffle, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spindrift.llm.common import slices

CHUNK = 1 << 15
OVERLAP = 1 << 10
CACHE = 400_000
LONG = 64


def boundaries(pattern: regex.Pattern, text: str, start: int, stop: int) -> list[int]:
    """Ends of the pre-tokens of text[start:stop] that what follows stop can't change."""
    ends = [m.end() for m in pattern.finditer(text, start, stop)]
    if stop < len(text):
        # The last match may go on beyond stop, and one of white space looks at the character after it.
        while ends and ends[-1] >= stop - 1:
            ends.pop()
    return ends


def pre_tokens(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pattern's matches over the whole text, found in overlapping chunks."""
    n = len(text)
    if n <= chunk + overlap:
        return pattern.findall(text)
    ends: list[int] = []
    start, edge = 0, chunk  # the chunk begins at a true boundary, its neighbour at edge
    while True:
        if edge + overlap >= n:
            ends += boundaries(pattern, text, start, n)
            break
        mine = boundaries(pattern, text, start, edge + overlap)
        other = set(boundaries(pattern, text, edge, edge + overlap))
        meet = next((e for e in mine if e > edge and e in other), None)
        if meet is None:
            edge += chunk
            continue
        ends += [e for e in mine if e <= meet]
        start, edge = meet, meet + chunk
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Codec:
    """Encoder and decoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}

    def piece(self, token: str) -> bytes:
        ids = np.array(self.merge(token.encode()), "<u4").tobytes()
        if len(token) <= LONG:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, piece = self.cache.get, self.piece
        return b"".join([get(t) or piece(t) for t in pre_tokens(self.pattern, text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path, pattern)


def _over_text(df: DataFrame, column: str, fields: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    """df with columns made from one column, batch by batch; columns of the same names are replaced."""
    df = df.drop(*[name for name, _, _ in fields if name != column])
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind, _ in fields]])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = list(zip(*map(make, batch.column(at).to_pylist()), strict=True)) or [[] for _ in fields]
            arrays = [pa.array(values, kind) for values, (_, _, kind) in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *[f[0] for f in fields]])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df and a binary column of token ids (little-endian, 32 bits each)."""
    return _over_text(df, text, [(out, T.BinaryType(), pa.binary())], lambda t: (codec(path, pattern).encode(t or ""),))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df and a binary column of the decoded bytes."""
    return _over_text(df, ids, [(out, T.BinaryType(), pa.binary())], lambda t: (codec(path, pattern).decode(t or b""),))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """df and n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, keeping digests only."""

    def make(t: str | None):
        own = codec(path, pattern)
        ids = own.encode(t or "")
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _over_text(df, text, [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())], make)
