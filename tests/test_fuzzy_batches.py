"""Fuzzy scores of many pairs of few strings: the work on a string is done once, and the scores are those of the definitions."""

import random

import numpy as np
import pytest

from spindrift.functions import fuzzy
from spindrift.operators import features


def _pairs() -> tuple[list[str], list[str]]:
    draw = random.Random(5)
    some = ["".join(draw.choice("abcdé中 ") for _ in range(draw.choice((0, 3, 12, 63, 64, 65, 130)))) for _ in range(24)]
    some += [" ".join(t.split()[1:] + ["zz"]) for t in some[:8]]
    return [draw.choice(some) for _ in range(400)], [draw.choice(some) for _ in range(400)]


@pytest.mark.parametrize("kind", sorted(fuzzy.SCORERS))
def test_strings_are_taken_once(monkeypatch, kind):
    a, b = _pairs()
    seen, init = [], fuzzy.Letters.__init__
    monkeypatch.setattr(fuzzy.Letters, "__init__", lambda self, texts: seen.append(len(texts)) or init(self, texts))
    fuzzy.SCORERS[kind](a, b)
    assert seen and sum(seen) <= len({*a, *b})


def _common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for k, y in enumerate(b):
            row[k + 1] = last[k] + 1 if x == y else max(last[k + 1], row[k])
    return row[-1]


def _ratio(a: str, b: str) -> float:
    return 200 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {s}".strip() for s in (left, right))
    return max([_ratio(one, two)] + [_ratio(both, s) for s in (one, two) if both])


def _partial(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    one = lambda x, y: max(_ratio(x, y[max(0, k) : k + len(x)]) for k in range(1 - len(x), len(y)))
    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(a, b)


@pytest.mark.parametrize("kind,brute", [("ratio", _ratio), ("token_set", _token_set), ("partial", _partial)])
def test_scores_in_batches_are_those_of_pairs(kind, brute):
    a, b = (x[: 40 if kind == "partial" else 400] for x in _pairs())
    assert np.allclose(fuzzy.SCORERS[kind](a, b), [brute(x, y) for x, y in zip(a, b, strict=True)], rtol=0, atol=1e-9)


def test_small_chunks_agree(monkeypatch):
    a, b = _pairs()
    whole = {kind: f(a, b) for kind, f in fuzzy.SCORERS.items()}
    monkeypatch.setattr(fuzzy, "MASKS", 500)
    monkeypatch.setattr(fuzzy, "WINDOWS", 7)
    for kind, f in fuzzy.SCORERS.items():
        assert np.array_equal(f(a, b), whole[kind])


def test_word_columns(spark):
    rows = [(["a", "b"], ["b", "c", "d"], [], []), (["a"], [], ["x"], ["x"])]
    df = spark.createDataFrame(rows, "q_name_words array<string>, t_name_words array<string>, q_addr_words array<string>, t_addr_words array<string>")
    got = [tuple(r) for r in df.select(*features._word_columns()).collect()]
    assert got == [(0.25, 0.5, 1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    assert df.select(*features._word_columns())._jdf.queryExecution().optimizedPlan().toString().count("array_union") == 0
