"""Normalisation, phonetic keys and fuzzy ratios: golden values, and brute force where there is one."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spindrift.functions import fuzzy
from spindrift.functions import text as X
from spindrift.functions import words as W


def values(spark, expr, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string")
    return [r.v for r in df.select("k", expr(F.col("x")).alias("v")).orderBy("k").collect()]


def test_house_numbers(spark):
    raw = ["H.No 6-3-10/3, Opp SBI, Hyderabad 500016", "Plot # D - 2/2A, Sector 5", "well-known place", "", None]
    assert values(spark, lambda x: X.house(X.fold(x)), *raw) == [["6-3-10/3"], ["d-2/2a"], [], [], []]
    full = values(spark, lambda x: X.full_address(X.fold(x)), "6-3-10/3", "Plot # D - 2/2A null")
    assert full[0].split()[-1] == "h6x3x10x3" and full[1].split()[-1] == "hdx2x2a" and "null" not in full[1]


@pytest.mark.parametrize("word,first,second", [("shivshakti", "svskt", "svskt"), ("shivshakthi", "svskt", "svskt"), ("kumar", "kmr", "kmr"), ("koomar", "kmr", "kmr"), ("photo", "ft", "ft"), ("quick", "k", "k"), ("kwik", "kvk", "kvk"), ("energy", "enrg", "enrj"), ("center", "cntr", "sntr"), ("services", "srvcs", "srvs")])
def test_sounds(spark, word, first, second):
    assert values(spark, lambda x: X.sound(x), word) == [first]
    assert values(spark, lambda x: X.sound(x, W.SOUNDS_SOFT), word) == [second]


def test_legal_keys_follow_from_the_table(spark):
    made = {k for k in values(spark, lambda x: X.sound(x, W.SOUNDS_SOFT), *W.LEGAL) if len(k) >= 3}
    assert made | {"elp", "elelp", "pvtltd", "prvtlmtd"} == set(W.LEGAL_KEYS)


def test_names(spark):
    assert values(spark, lambda x: X.name(X.fold(x)), "Société Générale S.A. & Co.", None, "Straße GmbH") == ["societe generale s a and", "", "strasse"]
    trade = values(spark, lambda x: X.trade_name(x), "M/s. Rama Traders Pvt Ltd", "Foo Inc DBA Bar Baz", "Only dba", "Ra‍ma")
    assert trade == ["rama traders", "bar baz", "only dba", "rama"]
    assert values(spark, lambda x: X.sorted_tokens(x), "b a b") == ["a b b"]


def test_digits(spark):
    assert values(spark, lambda x: F.size(X.digits(x)), "१२३४५६ abc 110001 7") == [2]
    assert values(spark, lambda x: X.postal(x), "12345 1234567 123456") == [["12345", "123456"]]


def test_bucket(spark):
    assert values(spark, lambda x: X.bucket(x), "S1-00001") == [93]


def test_grams(spark):
    assert values(spark, lambda x: X.grams(x, True), "ab c", "", "a") == [[" ab", "ab ", " c "], [], [" a "]]
    assert values(spark, lambda x: X.grams(x, False), "abcd", "ab", "") == [["abc", "bcd"], [], []]


def test_transliteration(spark):
    assert X.to_ascii("Crème Brûlée") == "Creme Brulee"
    assert X.to_ascii("कमल") == "kamala" and X.to_ascii("कि").startswith("k")
    assert X.to_ascii("१२") == "12"
    assert values(spark, lambda x: X.name(X.transliterate(x)), "कमल Ltd", None) == ["kamala", ""]


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_ratios():
    assert round(fuzzy.ratio("kitten", "sitting"), 4) == 61.5385
    assert round(fuzzy.ratio("smith sons", "smith and sons"), 4) == 83.3333
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("a", "") == 0
    assert fuzzy.token_sort("b a", "a b") == 100
    assert fuzzy.token_set("a b", "b a c") == 100 and fuzzy.token_set("", "") == 0 and fuzzy.token_set("a", "b") == 0
    assert fuzzy.partial("abc", "xxabcxx") == 100 and fuzzy.partial("", "x") == 0
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choices("abc ", k=rnd.randint(0, 9))) for _ in range(2))
        assert fuzzy.common(a, b) == brute_common(a, b)
        short, long = sorted((a, b), key=len)
        if short:
            n = len(short)
            spans = [long[max(0, k) : k + n] for k in range(1 - n, len(long))]
            best = max(200 * brute_common(short, w) / (n + len(w)) for w in spans)
            if len(a) == len(b):
                best = max(best, *(200 * brute_common(long, short[max(0, k) : k + n]) / (n + len(short[max(0, k) : k + n])) for k in range(1 - n, n)))
            assert fuzzy.partial(a, b) == pytest.approx(best)


def test_replacement_order_matters():
    assert list(itertools.chain(*W.SOUNDS_SOFT))[-2:] == ["y", "i"]
