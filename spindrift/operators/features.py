"""Features of candidate pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import fuzzy
from spindrift.functions import text as X
from spindrift.sources.scratch import discard, materialize


def _n(x: Column) -> Column:
    return F.size(x).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    union = _n(F.array_union(a, b))
    return F.when(union > 0, _n(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(_n(a), _n(b))
    return F.when(least > 0, _n(F.array_intersect(a, b)) / least).otherwise(0.0)


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.least(F.length(a), F.length(b)) / longest).otherwise(0.0)


def with_fields(pairs: DataFrame, records: DataFrame, fields: list[str], q: str = "s1_id", t: str = "cand_id") -> DataFrame:
    """pairs with q_ and t_ fields of their records; missing records have empty fields."""
    side = lambda key, p: records.select(F.col("entity_id").alias(key), *[F.col(f).alias(f"{p}_{f}") for f in fields])
    out = pairs.join(side(t, "t"), t, "left").join(side(q, "q"), q, "left")
    empty = {f"{p}_{f}": F.lit("") if kind == "string" else F.array().cast(kind) for f, kind in records.select(*fields).dtypes for p in "qt" if kind == "string" or kind.startswith("array")}
    return out.withColumns({c: F.coalesce(F.col(c), e) for c, e in empty.items()})


#: What a record has for its pairs: made once a record, not once a pair.
TOKENS = ("name_norm", "addr_norm", "nt", "at", "dt", "pt", "post", "prefix", "sorted", "sound")


def record_tokens(normal: DataFrame) -> DataFrame:
    """source, entity_id, country and TOKENS: the normal forms, token sets and keys that the first generation's features compare."""
    name, addr, raw = F.col("name_norm"), F.col("addr_norm"), F.col("business_address")
    return normal.select(
        "source", "entity_id", "country", "name_norm", "addr_norm", X.long_tokens(name).alias("nt"), X.long_tokens(addr).alias("at"), X.digits(raw).alias("dt"),
        X.sound_tokens(name).alias("pt"), X.postal(raw).alias("post"), X.prefix(name).alias("prefix"), X.sorted_tokens(name).alias("sorted"), X.name_sound(name).alias("sound"),
    )


def token_features(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The first generation's features that need no fuzzy matching, from record_tokens."""
    return _token_columns(with_fields(pairs, tokens, list(TOKENS)))


def _token_columns(x: DataFrame, *more: Column) -> DataFrame:
    both = lambda c: (F.col(f"q_{c}"), F.col(f"t_{c}"))
    same = lambda c: _flag((F.col(f"q_{c}") != "") & (F.col(f"q_{c}") == F.col(f"t_{c}")))
    return x.select(
        "s1_id", "cand_id", F.col("score").alias("blocking_score"), F.col("source").cast("double").alias("cand_source"),
        jaccard(*both("nt")).alias("name_jaccard"), overlap(*both("nt")).alias("name_overlap"), same("prefix").alias("name_prefix"),
        same("name_norm").alias("name_exact"), length_ratio(*both("name_norm")).alias("len_ratio"),
        jaccard(*both("at")).alias("addr_jaccard"), overlap(*both("at")).alias("addr_overlap"), jaccard(*both("dt")).alias("digit_jaccard"),
        _flag(F.col("q_addr_norm") == "").alias("s1_addr_empty"), _flag(F.col("t_addr_norm") == "").alias("cand_addr_empty"),
        same("sorted").alias("sorted_exact"), same("sound").alias("phon_exact"),
        jaccard(*both("pt")).alias("phon_jaccard"), _flag(F.arrays_overlap(*both("post"))).alias("postal_exact"),
        _n(F.array_intersect(*both("nt"))).alias("shared_name"), _n(F.array_intersect(*both("at"))).alias("shared_addr"), *more,
    )


#: The first generation's fuzzy features: kind and field.
KEY_FUZZY = {"name_ratio": ("ratio", "name_norm"), "name_token_sort": ("token_sort", "name_norm"), "name_token_set": ("token_set", "name_norm"), "name_partial": ("partial", "name_norm"), "addr_ratio": ("ratio", "addr_norm")}


def _spread(df: DataFrame) -> DataFrame:
    """df over all the shuffle partitions: pairs are small in bytes, but Python's share of their cost isn't."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _fuzzy_columns() -> list[Column]:
    bare = (F.col("q_addr_norm") == "") & (F.col("t_addr_norm") == "")
    value = {k: F.when(bare, 0.0).otherwise(F.col(f"f.{k}")) if k == "addr_ratio" else F.col(f"f.{k}") for k in KEY_FUZZY}
    return [F.round(v / 100, 6).alias(k) for k, v in value.items()]


def _with_fuzzy(x: DataFrame) -> DataFrame:
    return x.withColumn("f", fuzzy.scores({k: (kind, f"q_{c}", f"t_{c}") for k, (kind, c) in KEY_FUZZY.items()}))


def fuzzy_features(pairs: DataFrame, normal: DataFrame) -> DataFrame:
    """The first generation's fuzzy features, 0 to 1."""
    x = _with_fuzzy(_spread(with_fields(pairs, normal, ["name_norm", "addr_norm"])))
    return x.select("s1_id", "cand_id", *_fuzzy_columns())


def key_features(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """All of the first generation's features, from record_tokens."""
    return _token_columns(_with_fuzzy(_spread(with_fields(pairs, tokens, list(TOKENS)))), *_fuzzy_columns())


KEY_FEATURES = (
    "blocking_score cand_source name_jaccard name_overlap name_prefix name_exact len_ratio addr_jaccard addr_overlap digit_jaccard s1_addr_empty cand_addr_empty "
    "sorted_exact phon_exact phon_jaccard postal_exact shared_name shared_addr"
).split() + list(KEY_FUZZY)


def word_sets(forms: DataFrame) -> DataFrame:
    """entity_id, name_words, addr_words: distinct words but those that no target of the country has; records without any are missing."""
    words = lambda field: F.array_distinct(F.filter(F.split(field, " "), lambda t: t != ""))
    long = forms.select("source", "entity_id", "country", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(f).alias("words")) for f in ("name", "addr")])).alias("f"))
    long = long.select("source", "entity_id", "country", "f.field", F.explode("f.words").alias("word"))
    known = long.where("source > 1").select("country", "field", "word").distinct()
    kept = long.join(known, ["country", "field", "word"], "left_semi")
    return kept.groupBy("entity_id").agg(*[F.collect_set(F.when(F.col("field") == f, F.col("word"))).alias(f"{f}_words") for f in ("name", "addr")])


def _word_columns() -> list[Column]:
    """Sets have no word twice, so what both have tells the size of the union, too."""
    out = []
    for f in ("name", "addr"):
        a, b = F.col(f"q_{f}_words"), F.col(f"t_{f}_words")
        both, least = _n(F.array_intersect(a, b)), F.least(_n(a), _n(b))
        either = _n(a) + _n(b) - both
        out += [F.when(either > 0, both / either).otherwise(0.0).alias(f"{f}_word_jac"), F.when(least > 0, both / least).otherwise(0.0).alias(f"{f}_word_ovl"), both.alias(f"n_{f}_words")]
    return out


def word_features(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """Shared words of names and addresses, where words that no target of the country has don't count."""
    return with_fields(pairs, word_sets(forms), ["name_words", "addr_words"], "q", "t").select("q", "t", *_word_columns())


#: Pairs of a slice, and slices at most: so much of the pairs is joined with texts, and so on disk, at a time.
SLICE, SLICES = 250_000, 16

#: The second generation's fuzzy features: kind and fields.
PAIR_FUZZY = {
    "r_name": ("ratio", "q_name", "t_name"), "r_name_tsort": ("token_sort", "q_name", "t_name"), "r_name_tset": ("token_set", "q_name", "t_name"), "r_name_part": ("partial", "q_name", "t_name"),
    "r_phon": ("token_set", "q_phon", "t_phon"), "r_addr": ("ratio", "q_addr", "t_addr"), "r_addr_tset": ("token_set", "q_addr", "t_addr"),
}


def pair_features(union: DataFrame, forms: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The second generation's 32 features, or those wanted of them, fuzzy scores 0 to 100. union is a stored table.

    Pairs with the texts of both records take many times the bytes of the pairs. So the pairs are joined in slices by a hash
    of q, each written before the next begins; together they are all pairs.
    """
    wanted = wanted or PAIR_FEATURES
    side = materialize(forms.join(word_sets(forms), "entity_id", "left"))
    slices = min(SLICES, max(1, -(-union.count() // SLICE)))
    of = F.pmod(F.xxhash64("q"), F.lit(slices))
    made = [materialize(_pair_columns(union.where(of == k), side, wanted)) for k in range(slices)]
    discard(side)
    return reduce(DataFrame.unionAll, made)


def _pair_columns(union: DataFrame, side: DataFrame, wanted: list[str]) -> DataFrame:
    x = with_fields(union, side, ["source", "name", "addr", "phon", "phonc", "sorted", "house", "postal", "name_words", "addr_words"], "q", "t")
    col = lambda f: (F.col(f"q_{f}"), F.col(f"t_{f}"))
    same = lambda f: _flag((F.col(f"q_{f}") != "") & (F.col(f"q_{f}") == F.col(f"t_{f}")))
    asked = {k: v for k, v in PAIR_FUZZY.items() if k in wanted}
    all_ = x.withColumn("f", fuzzy.scores(asked)).select("*", "f.*") if asked else x
    return all_.withColumns({"c4_keys": F.col("c4"), "cand_source": F.col("t_source").cast("double")}).select(
        "q", "t", *asked, *_word_columns(),
        length_ratio(*col("name")).alias("len_ratio"), "cand_source",
        same("name").alias("name_exact"), same("sorted").alias("sorted_exact"), same("phonc").alias("phon_exact"),
        _flag(F.arrays_overlap(*col("house"))).alias("house_match"), _flag(F.arrays_overlap(*col("postal"))).alias("postal_match"),
        _flag(F.col("q_addr") == "").alias("s1_addr_empty"), _flag(F.col("t_addr") == "").alias("cand_addr_empty"),
        "c2_cos", "c2_rank", "c2b_cos", "c2b_rank", "c3_cos", "c3_rank", "c4_keys", "c1_score", "c1_rank", "n_channels",
    ).select("q", "t", *wanted)


PAIR_FEATURES = (
    "r_name r_name_tsort r_name_tset r_name_part r_phon r_addr r_addr_tset name_word_jac name_word_ovl n_name_words addr_word_jac addr_word_ovl n_addr_words "
    "len_ratio cand_source name_exact sorted_exact phon_exact house_match postal_match s1_addr_empty cand_addr_empty "
    "c2_cos c2_rank c2b_cos c2b_rank c3_cos c3_rank c4_keys c1_score c1_rank n_channels"
).split()
