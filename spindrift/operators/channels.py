"""Retrieval channels: TF-IDF cosine over character n-grams, exact keys, and the union of their evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.sources.scratch import materialize

EXACT_CAP = 200
#: Queries and targets of one cell, and sums that are held at once.
QUERIES, TARGETS, CELLS = 16_000, 64_000, 1 << 20
#: Records whose n-grams are made at once; blocks of targets for each result wanted, whose largest sums bound it.
SOME, BLOCKS = 4_096, 4
#: Query n-grams kept and results returned, by channel.
KEEP = {"c2": 14, "c2b": 12, "c3": 22}
TOP = {"c2": 50, "c2b": 40, "c3": 50}
NUMBERS = {name: k for k, name in enumerate(("c1", "c2", "c2b", "c3", "c4"))}


def linked_forms(records: DataFrame, fold=X.fold) -> DataFrame:
    """source, entity_id, country and the second normal forms: name, addr, phon, phonc, sorted, house, postal."""
    out = records.withColumn("name", X.trade_name(F.col("business_name"), fold)).withColumn("addr", X.full_address(fold(F.col("business_address"))))
    return out.select(
        "source", "entity_id", "country", "name", "addr",
        X.sound_string(F.col("name")).alias("phon"), X.sound_compact(F.col("name")).alias("phonc"), X.sorted_tokens(F.col("name")).alias("sorted"),
        X.house(fold(F.col("business_address"))).alias("house"), X.postal(F.col("business_address")).alias("postal"),
    )


def tfidf_topk(forms: DataFrame, field: str, channel: str, pad_words: bool, min_df: int = 2, max_df: float = 0.02) -> DataFrame:
    """(q, t, cos, rank): for each record of source 1 its nearest targets of the same country.

    Frequencies are those of the targets. N-grams that are too common are dropped, and a query keeps its heaviest only. A
    country's queries and targets form a grid of cells of bounded size; each cell is a product of two sparse matrices
    that leaves a query's nearest only. What is shuffled is texts and the country's n-gram weights, as often as the grid has
    rows or columns; n-grams of records are made where they are needed, and neither they nor hits, of which common n-grams
    make many, ever travel.
    """
    texts = forms.where("country is not null").groupBy("source", "entity_id", "country").agg(F.collect_list(field).alias("texts"))
    queries, targets = texts.where("source = 1"), texts.where("source > 1")
    docs = forms.where("source > 1").groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = targets.select("country", "texts").mapInArrow(_frequencies(pad_words), "country string, code long, df long").groupBy("country", "code").agg(F.sum("df").alias("df")).join(docs, "country")
    df = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    idf = df.select("country", "code", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    sizes = forms.groupBy("country").agg(*[F.greatest(F.ceil(F.sum(cond.cast("long")) / most), F.lit(1)).cast("int").alias(name) for name, cond, most in (("rows", F.col("source") == 1, QUERIES), ("columns", F.col("source") > 1, TARGETS))])
    left = _dealt(queries, sizes, "q", ("row", "rows"), ("column", "columns"))
    right = _dealt(targets, sizes, "t", ("column", "columns"), ("row", "rows"))
    every = idf.join(sizes, "country").select("country", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), "rows", "code", "idf")
    every = every.select("country", "column", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "code", "idf")
    right = right.unionByName(every, allowMissingColumns=True).withColumnsRenamed({"country": "country_t", "row": "row_t", "column": "column_t", "texts": "texts_t"})
    near = left.groupBy("country", "row", "column").cogroup(right.groupBy("country_t", "row_t", "column_t")).applyInArrow(_nearest(KEEP[channel], TOP[channel], pad_words), "q string, t string, cos double")
    pairs = near.withColumn("cos", F.round("cos", 6))
    order = Window.partitionBy("q").orderBy(F.col("cos").desc(), "t")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP[channel])


def _dealt(texts: DataFrame, sizes: DataFrame, name: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """texts dealt to the cells of their country's grid: their own row or column by hash, and each of the other side's."""
    place = F.pmod(F.xxhash64("entity_id"), F.col(own[1])).cast("int").alias(own[0])
    each = F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)).alias(other[0])
    return texts.join(sizes, "country").select("country", F.col("entity_id").alias(name), "texts", place, each)


def _terms(texts: list[list[str]], pad_words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and its count for the n-grams of functions.text.grams, as numbers (three code points of 21 bits), in order."""
    flat = [t for own in texts for t in own]
    if pad_words:
        flat = [f" {' '.join(w for w in t.split(' ') if w)} " for t in flat]
    at = np.repeat(np.repeat(np.arange(len(texts)), [len(own) for own in texts]), [len(t) for t in flat])
    one = np.repeat(np.arange(len(flat)), [len(t) for t in flat])
    points = np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32).astype(np.int64)
    keep = one[2:] == one[:-2]
    if pad_words:
        keep &= points[1:-1] != ord(" ")  # else it is of two words
    row, code = at[2:][keep], (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[keep]
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[first], code[first], np.diff(np.append(first, len(row)))


def _frequencies(pad_words: bool):
    """How many of a batch's records have each n-gram, by country."""

    def count(batches):
        for batch in batches:
            countries = batch.column("country").to_pylist()
            names, own = np.unique(np.array(countries, object), return_inverse=True)
            row, code, _ = _terms(batch.column("texts").to_pylist(), pad_words)
            for k, name in enumerate(names):
                codes, n = np.unique(code[own[row] == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["country", "code", "df"])

    return count


def _weighed(texts: pa.ChunkedArray, known: np.ndarray, idf: np.ndarray, pad_words: bool, keep: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in known and weight of the n-grams of records' texts, or of each one's heaviest, a few records at a time."""
    out = []
    for low in range(0, len(texts), SOME):
        row, code, tf = _terms(texts.slice(low, SOME).to_pylist(), pad_words)
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = known[at] == code
        row, at, tf = row[hit], at[hit], tf[hit]
        w = (1.0 + np.log(tf)) * idf[at]
        w = np.round(w / np.sqrt(np.bincount(row, w * w, minlength=1))[row], 9)
        if keep is not None:
            order = np.lexsort((at, -w, row))
            row, at, w = row[order], at[order], w[order]
            heavy = np.arange(len(row)) - np.searchsorted(row, row) < keep
            row, at, w = row[heavy], at[heavy], w[heavy]
        out.append(((row + low).astype(np.int32), at.astype(np.int32), w))
    row, at, w = (np.concatenate(x) for x in zip(*out, strict=True))
    return row, at, w


def _nearest(keep: int, k: int, pad_words: bool):
    """For one cell of queries and targets: for each query the k targets of largest cosine, and any that rounding may put among them."""

    def near(queries: pa.Table, targets: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.string()), "t": pa.array([], pa.string()), "cos": pa.array([], pa.float64())})
        weights = targets.filter(pc.is_valid(targets.column("code")))
        targets = targets.filter(pc.is_null(targets.column("code")))
        if not queries.num_rows or not targets.num_rows or not weights.num_rows:
            return empty
        known, idf = weights.column("code").to_numpy(), weights.column("idf").to_numpy()
        order = np.argsort(known)
        known, idf = known[order], idf[order]
        column, term, held = _weighed(targets.column("texts_t"), known, idf, pad_words)
        order = np.argsort(term, kind="stable")
        column, held = column[order], held[order]
        begin = np.searchsorted(term[order], np.arange(len(known) + 1))
        row, asked, own = _weighed(queries.column("texts"), known, idf, pad_words, keep)
        count = np.diff(begin)[asked]
        out, n = [], targets.num_rows
        step = max(1, CELLS // n)
        blocks = BLOCKS * k if n >= 2 * BLOCKS * k else 0
        for low in range(0, queries.num_rows, step):
            mine = slice(*np.searchsorted(row, (low, low + step)))
            c, high = count[mine], min(step, queries.num_rows - low)
            post = np.repeat(begin[asked[mine]] - np.cumsum(c) + c, c) + np.arange(c.sum())
            sums = np.bincount(np.repeat((row[mine] - low).astype(np.int64) * n, c) + column[post], np.repeat(own[mine], c) * held[post], minlength=high * n)
            if blocks:
                # The k-th largest of the blocks' largest is no more than the k-th largest of all.
                most = sums.reshape(high, n)[:, : n // blocks * blocks].reshape(high, blocks, -1).max(2)
                least = np.maximum(np.partition(most, blocks - k, 1)[:, blocks - k] - 2e-6, 0)
                some = np.flatnonzero((sums.reshape(high, n) >= least[:, None]) & (sums.reshape(high, n) > 0))
            else:
                some = np.flatnonzero(sums)
            some = some[np.lexsort((-sums[some], some // n))]
            q, value = some // n, sums[some]
            first = np.searchsorted(q, q)  # where the query's own begin
            last = np.minimum(first + k, np.searchsorted(q, q, side="right")) - 1
            stay = value >= value[last] - 2e-6
            out.append((q[stay] + low, some[stay] % n, value[stay]))
        q, t, value = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"q": queries.column("q").take(pa.array(q)), "t": targets.column("t").take(pa.array(t)), "cos": pa.array(value)})

    return near


def _exact_keys(forms: DataFrame) -> DataFrame:
    typed = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("field"), v.alias("key")))
    keys = F.concat(
        typed("name", F.array("name")), typed("sorted", F.array("sorted")), typed("phon", F.array("phonc")),
        typed("house", F.col("house")), typed("postal", F.col("postal")),
    )
    out = forms.select("source", "entity_id", "country", F.explode(F.array_distinct(keys)).alias("k")).select("source", "entity_id", "country", "k.*")
    return out.where(F.length("key") >= 3)


def exact_channel(forms: DataFrame, cap: int = EXACT_CAP) -> DataFrame:
    """(q, t, c4): how many of five fields have a key in common that no more than `cap` targets have."""
    keys = _exact_keys(forms)
    on = ["country", "field", "key"]
    rare = keys.where("source > 1").groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap).select(*on)
    queries = keys.where("source = 1").select(*on, F.col("entity_id").alias("q")).join(rare, on)
    targets = keys.where("source > 1").select(*on, F.col("entity_id").alias("t"))
    return queries.join(targets, on).groupBy("q", "t").agg(F.count_distinct("field").cast("int").alias("c4"))


def channels(forms: DataFrame, max_df: float = 0.02) -> dict[str, DataFrame]:
    """The channels, each a scratch table: one plan of all of them takes the driver too much memory and keeps all shuffles at once."""
    return {
        "c2": materialize(tfidf_topk(forms, "name", "c2", True, max_df=max_df)),
        "c2b": materialize(tfidf_topk(forms, "phonc", "c2b", False, max_df=max_df)),
        "c3": materialize(tfidf_topk(forms, "addr", "c3", True, max_df=max_df)),
        "c4": materialize(exact_channel(forms)),
    }


def union(found: dict[str, DataFrame], c1: DataFrame | None = None) -> DataFrame:
    """One row for each pair that any channel found: scores and ranks by channel, 0 where it didn't, and how many did. One shuffle, by q."""
    long = None
    for name, df in found.items():
        value, rank = ("c4", F.lit(0)) if name == "c4" else ("cos", F.col("rank"))
        one = df.select("q", "t", F.lit(NUMBERS[name]).alias("channel"), F.col(value).cast("double").alias("score"), rank.cast("int").alias("rank"))
        long = one if long is None else long.unionByName(one)
    if c1 is not None:
        long = long.unionByName(c1.select(F.col("s1_id").alias("q"), F.col("cand_id").alias("t"), F.lit(NUMBERS["c1"]).alias("channel"), F.col("score"), F.col("rank").cast("int")))
    pick = lambda name, what: F.coalesce(F.max(F.when(F.col("channel") == NUMBERS[name], what)), F.lit(0)).cast("double")
    columns: list[Column] = []
    for name in ("c2", "c2b", "c3"):
        columns += [pick(name, F.col("score")).alias(f"{name}_cos"), pick(name, F.col("rank")).alias(f"{name}_rank")]
    columns += [pick("c4", F.col("score")).alias("c4"), pick("c1", F.col("score")).alias("c1_score"), pick("c1", F.col("rank")).alias("c1_rank")]
    columns.append(F.bit_count(F.bit_or(F.expr("shiftleft(1, channel)"))).cast("double").alias("n_channels"))
    return long.repartition("q").groupBy("q", "t").agg(*columns)
