"""Token counts by a tokenizer file: batches of pieces are encoded in Arrow functions that return lengths only.

A text is split at safe boundaries: a space between two characters that are neither white nor invisible. A byte-level
pre-tokeniser always starts a pre-token there, so the pieces' counts add up. Pieces are counted once each and remembered
in a bounded cache; those not yet known go to the library in batches of about equal bytes. Tokenizers that don't
split so (another pre-tokeniser, a normaliser, special tokens with blanks, sentencepiece) get whole texts.

Null texts count as empty: no bytes, no tokens. Repeated rows are counted each. There is no shuffle.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spindrift.llm.common import slices

CACHE = 500_000
LONG = 64
BATCH_BYTES = 1 << 17
#: Characters beside which a space isn't a safe boundary: white, control, format and the like.
UNSAFE = r"\s\x00-\x20\x7f-\xa0\xad؀-؅؜ ᠎ -‏ -⁯　﻿"
UNSAFE_SPACE = re.compile(rf"(?:^|(?<=[{UNSAFE}])) | (?=[{UNSAFE}]|$)")
SAFE_SPACE = re.compile(rf"(?<=[^{UNSAFE}]) (?=[^{UNSAFE}])")


def safe_pieces(text: str) -> list[str]:
    """Pieces that join to the text, each but the first beginning with the space it was split at."""
    if UNSAFE_SPACE.search(text) is None:
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]
    cuts = [m.start() for m in SAFE_SPACE.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def balanced(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about limit bytes; a longer piece makes one of its own."""
    batch, size = [], 0
    for piece in pieces:
        if batch and size + len(piece) > limit:
            yield batch
            batch, size = [], 0
        batch.append(piece)
        size += len(piece)
    if batch:
        yield batch


class Counter:
    def __init__(self, path: str):
        self.cache: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.splits = False
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        first = about.get("pre_tokenizer") or {}
        self.splits = (
            about.get("normalizer") is None
            and first.get("type") == "ByteLevel"
            and not first.get("add_prefix_space")
            and first.get("use_regex", True)
            and not any(re.search(rf"[{UNSAFE}]", x["content"]) or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in about.get("added_tokens", []))
        )
        self.lengths = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split = [safe_pieces(t) for t in texts] if self.splits else [[t] for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        missing = list({p for pieces in split for p in pieces if p not in cache})
        long: dict[str, int] = {}
        for batch in balanced(missing):
            for piece, n in zip(batch, self.lengths(batch), strict=True):
                (cache if len(piece) <= LONG else long)[piece] = n
        if long:
            return [sum([long[p] if p in long else cache[p] for p in pieces]) for pieces in split]
        return [sum(map(cache.__getitem__, pieces)) for pieces in split]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each Python worker."""
    return Counter(path)


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """df and n_bytes, n_tokens, over_limit; columns of the same names are replaced."""
    df = df.drop("n_bytes", "n_tokens", "over_limit")
    schema = T.StructType([*df.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            counts: list[int] = []
            for group in balanced(texts, 1 << 20):
                counts += own.count(group)
            sizes = [len(t.encode()) for t in texts]
            made = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return df.mapInArrow(run, schema)
