"""What the operators of this subpackage share: scratch tables, word arrays, small column helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.sources.scratch import clear_scratch, discard, materialize, scratch_root, while_writing

__all__ = ["WHITE", "WORD", "clear_scratch", "discard", "input_bytes", "let", "materialize", "scratch_root", "slices", "while_writing", "words_of"]

#: White space of every contract here: space and the ASCII controls from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of texts that a Python function turns into objects at a time: their cost is that of memory that isn't near.
ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of no more than so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, where body names it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def input_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.select(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
