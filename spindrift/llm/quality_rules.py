"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a built-in expression over one row, so there is no shuffle and no Python on the executors.
A null or empty text has no words and fails the length rule. Very long texts cost time and memory in
proportion to their length, but for the sort of a text's own 8-word windows, done only if any repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import WHITE, let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in is that for on with as are be was at by an it or this from not",
    "de": "der die das und zu den von mit ist im nicht für auf ein eine dem sich auch",
    "fr": "la le les et des du en un une que qui dans pour est sur au par pas avec",
    "es": "el los las una se es por con para del como no al lo más de y",
}


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Ratios are integers out of a thousand, so that every engine decides alike.
RULES = (
    Rule("enough_words", "n_words", low=20),
    Rule("few_repeats", "repeat_permille", high=300),
    Rule("word_length_low", "word_chars_permille", low=2000),
    Rule("word_length_high", "word_chars_permille", high=12000),
    Rule("few_symbols", "symbol_permille", high=200),
    Rule("stop_words", "stop_permille", low=20),
    Rule("few_dup_lines", "dup_line_permille", high=500),
)
BASE = ("enough_words", "few_repeats")


def _repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the window hashes in text order."""

    def covered(pairs: Column) -> Column:
        alike = lambda i, j: F.coalesce(F.get(pairs, i)["h"] == F.get(pairs, j)["h"], F.lit(False))
        marked = F.filter(pairs, lambda p, k: alike(k, k - 1) | alike(k, k + 1))
        starts = F.array_sort(F.transform(marked, lambda p: p["at"]))
        return let(
            starts,
            lambda s: F.aggregate(
                F.transform(s, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - at, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, more: total + more,
            ),
        )

    paired = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    none = F.size(hashes) == F.size(F.array_distinct(hashes))
    return F.when(hashes.isNull() | none, F.lit(0).cast("long")).otherwise(let(paired, covered))


def with_metrics(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds a struct column of the metrics that rules can name."""
    stop = sorted({w for words in STOP_WORDS.values() for w in words.split()})
    body = F.coalesce(F.col(text), F.lit(""))
    words, hashes = f"{out}_words", f"{out}_hashes"
    lines = F.filter(F.split(body, "\n"), lambda line: F.regexp_replace(line, WHITE, "") != "")
    df = df.withColumn(words, words_of(F.col(text)))
    window = let(
        F.transform(F.col(words), lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        ),
    )
    df = df.withColumn(hashes, F.when(F.size(words) >= WINDOW, window))
    n = F.size(words).cast("long")
    bare = lambda w: F.lower(F.btrim(w, F.lit(".,;:!?()\"'")))
    metrics = F.struct(
        n.alias("n_words"),
        F.length(F.regexp_replace(body, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _repeat_words(F.col(hashes)).alias("n_repeat_words"),
        F.size(F.filter(F.col(words), lambda w: bare(w).isin(stop))).cast("long").alias("n_stop_words"),
    )
    # A generator of one row: no filter on what follows is pushed through it, which would copy all of the above into itself.
    df = df.withColumn(out, F.explode(F.array(metrics))).drop(words, hashes)
    of = lambda part, whole: F.floor(F.col(f"{out}.{part}") * 1000 / F.greatest(F.col(f"{out}.{whole}"), F.lit(1))).cast("long")
    return df.withColumn(
        out,
        F.struct(
            F.col(f"{out}.*"),
            of("n_symbols", "n_words").alias("symbol_permille"),
            of("word_chars", "n_words").alias("word_chars_permille"),
            of("n_stop_words", "n_words").alias("stop_permille"),
            of("n_dup_lines", "n_lines").alias("dup_line_permille"),
            # Rounded up: the base rule is about exceeding 30 %, not about reaching it.
            F.ceil(F.col(f"{out}.n_repeat_words") * 1000 / F.greatest(F.col(f"{out}.n_words"), F.lit(1))).cast("long").alias("repeat_permille"),
        ),
    )


def compile_rules(rules: tuple[Rule, ...], metrics: str) -> Column:
    """The names of the rules that a document breaks, as one expression."""
    broken = []
    for rule in rules:
        value = F.col(f"{metrics}.{rule.metric}")
        fails = F.lit(False)
        if rule.low is not None:
            fails = fails | (value < rule.low)
        if rule.high is not None:
            fails = fails | (value > rule.high)
        broken.append(F.when(fails, F.lit(rule.name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "__quality") -> DataFrame:
    """docs and a struct column out: the metrics, broken (names of the rules broken), base_failed, kept.

    The other columns pass unchanged, whatever their names. Repeated rows are judged each on its own.
    """
    df = with_metrics(docs, text, out)
    df = df.withColumn(out, F.struct(F.col(f"{out}.*"), compile_rules(rules, out).alias("broken")))
    base = F.arrays_overlap(F.col(f"{out}.broken"), F.array(*[F.lit(x) for x in BASE]))
    return df.withColumn(out, F.struct(F.col(f"{out}.*"), base.alias("base_failed"), (F.size(f"{out}.broken") == 0).alias("kept")))
