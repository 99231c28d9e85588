"""String similarities that SQL lacks: Indel ratio and the token and partial forms of it, 0 to 100.

All scores of a pair come from one Arrow call. What depends on one string only (its letters, words and bit vectors) is made once for each
different string of a batch, and one NumPy operation advances the longest common subsequences of all pairs by a letter. What is decided by
equality or by containment takes no subsequence at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mask words, and windows, that are held at once.
MASKS, WINDOWS = 1 << 22, 1 << 17
#: The lowest k bits, k from 0 to 64.
LOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def _numbered(a: list[str], b: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different strings, and which of them each member of a and of b is."""
    names = {t: k for k, t in enumerate(dict.fromkeys(chain(a, b)))}
    i, j = (np.fromiter(map(names.__getitem__, side), np.int64, len(side)) for side in (a, b))
    return list(names), i, j


def _ragged(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of these lengths, all in a line: the row and the place in it of each member."""
    return np.repeat(np.arange(len(length)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)


class Letters:
    """Strings as letter numbers, all in a line, and the number of different letters."""

    def __init__(self, texts: list[str]):
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.length) - self.length
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        present = np.bincount(points, minlength=1) > 0
        self.codes, self.letters = (np.cumsum(present) - 1)[points], max(1, int(present.sum()))

    def backwards(self) -> Letters:
        out = Letters.__new__(Letters)
        row, place = _ragged(self.length)
        out.length, out.start, out.letters = self.length, self.start, self.letters
        out.codes = self.codes[(self.start + self.length - 1)[row] - place]
        return out

    def masks(self, own: np.ndarray, words: int) -> list[np.ndarray]:
        """For each string of own and each letter the places of the letter, as bits: an array for each word of 64."""
        row, place = _ragged(self.length[own])
        size = len(own) * self.letters
        out = np.zeros(words * size, np.uint64)
        np.add.at(out, (place >> 6) * size + row * self.letters + self.codes[self.start[own][row] + place], np.uint64(1) << (place & 63).astype(np.uint64))
        return list(out.reshape(words, size))

    def cells(self, i: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Pairs whose first string takes a like number of words, in bounded numbers: which, their different strings, which of these each has, and the words."""
        words = np.maximum(1, (self.length[i] + 63) >> 6)
        for w in np.unique(words).tolist():
            mine = np.flatnonzero(words == w)
            mine = mine[np.argsort(i[mine], kind="stable")]
            step = max(1, MASKS // (w * max(64, self.letters)))
            for low in range(0, len(mine), step):
                some = mine[low : low + step]
                own, at = np.unique(i[some], return_inverse=True)
                yield some, own, at, w


def _rows(masks: list[np.ndarray], base: np.ndarray, codes: np.ndarray, start: np.ndarray, length: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
    """For each pair the bits of the first string, with a 0 for each step of its longest common subsequence with the letters of the second:
    those below a place are the steps to there. masks, from base on, are of the first; without has bits of it that don't count."""
    order = np.argsort(-length, kind="stable")
    base, at = base[order], start[order]
    live = len(order) - np.searchsorted(np.sort(length), np.arange(int(length.max(initial=0))), "right")
    rows, last = np.full((len(masks), len(order)), ~np.uint64(0)), len(masks) - 1
    held = None if without is None else ~without[: len(masks), order]
    for n in live.tolist():
        index = codes.take(at[:n])
        index += base[:n]
        at[:n] += 1
        carry = over = None
        for w, mask in enumerate(masks):
            own, hit = rows[w, :n], mask.take(index)
            hit &= own
            if held is not None:
                hit &= held[w, :n]
            total = own + hit
            if w < last:
                over = total < own
            if carry is not None:
                total += carry
                if w < last:
                    over |= total < carry
            own ^= hit
            own |= total
            carry = over
    out = np.empty_like(rows)
    out[:, order] = rows
    return out


def _steps(rows: np.ndarray) -> np.ndarray:
    return 64 * len(rows) - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)


def _commons(s: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i), np.int64)
    for mine, own, at, words in s.cells(i):
        out[mine] = _steps(_rows(s.masks(own, words), at * s.letters, s.codes, s.start[j[mine]], s.length[j[mine]]))
    return out


def commons(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    names, i, j = _numbered(a, b)
    return _commons(Letters(names), i, j)


def ratios(a: list[str], b: list[str], form: Callable[[str], str] | None = None) -> np.ndarray:
    """Ratios of pairs, or of what form makes of their strings."""
    names, i, j = _numbered(a, b)
    s = Letters(names if form is None else [form(t) for t in names])
    total, out = s.length[i] + s.length[j], np.full(len(i), 100.0)
    open_ = np.flatnonzero((i != j) & (total > 0))
    out[open_] = 200.0 * _commons(s, i[open_], j[open_]) / total[open_]
    return out


def token_sorts(a: list[str], b: list[str]) -> np.ndarray:
    return ratios(a, b, lambda t: " ".join(sorted(t.split())))


def token_sets(a: list[str], b: list[str]) -> np.ndarray:
    """The best of three ratios: what both have and the rest of each, and either of these with what both have alone. The two
    strings begin alike, so only their rests need a subsequence, and the shared part is one of both.

    Strings are their different words in order, each behind a space; shared words are letters that don't count."""
    names, i, j = _numbered(a, b)
    words = [sorted(set(t.split())) for t in names]
    s = Letters([" " + " ".join(own) if own else "" for own in words])
    count = np.fromiter(map(len, words), np.int64, len(words))
    out, live = np.zeros(len(i)), np.flatnonzero((count[i] > 0) & (count[j] > 0))
    if not len(live):
        return out
    i, j, first = i[live], j[live], np.cumsum(count) - count
    flat = list(chain.from_iterable(words))
    known = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    word, size = (np.fromiter(map(f, flat), np.int64, len(flat)) for f in (known.__getitem__, len))
    size += 1  # the space before it
    begin = np.cumsum(size) - size - np.repeat(s.start, count)
    # The words of the second strings that are in the first: of which pair, and which words of both.
    own = np.unique(i)
    row, place = _ragged(count[own])
    slot = first[own][row] + place
    key = own[row] * len(known) + word[slot]
    order = np.argsort(key)
    key, slot = key[order], slot[order]
    pair, place = _ragged(count[j])
    theirs = first[j][pair] + place
    asked = i[pair] * len(known) + word[theirs]
    at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    hit = key[at] == asked
    pair, mine, theirs = pair[hit], slot[at[hit]], theirs[hit]
    shared = np.bincount(pair, size[theirs], len(i)).astype(np.int64)
    x, y, some = s.length[i] - shared, s.length[j] - shared, shared > 0
    most = np.full(len(i), 100.0)
    common, open_ = np.zeros(len(i), np.int64), ~some | (x > 0) & (y > 0)
    apart = np.flatnonzero(~some)
    common[apart] = _commons(s, i[apart], j[apart])
    both = np.flatnonzero(some & open_)
    if len(both):
        number = np.full(len(i), -1)
        number[both] = np.arange(len(both))
        there = number[pair] >= 0
        common[both] = _rest_commons(s, i[both], j[both], number[pair[there]], begin[mine[there]], begin[theirs[there]], size[theirs[there]])
    # The first space is one of the rest only behind what both have.
    n, gap = (shared - some)[open_].astype(np.float64), (~some)[open_]
    x, y = (x[open_] - gap).astype(np.float64), (y[open_] - gap).astype(np.float64)
    best = 200.0 * (n + (common[open_] - gap)) / (2 * n + x + y)
    some = n > 0
    for rest in (x, y):
        best[some] = np.maximum(best, 200.0 * n / (2 * n + rest))[some]
    most[open_] = best
    out[live] = most
    return out


def _rest_commons(s: Letters, i: np.ndarray, j: np.ndarray, pair: np.ndarray, mine: np.ndarray, theirs: np.ndarray, size: np.ndarray) -> np.ndarray:
    """commons without some words: of which pair, where they begin in both strings, and their size."""
    row, place = _ragged(s.length[j])
    edge = np.zeros(len(row) + 1, np.int64)
    low = (np.cumsum(s.length[j]) - s.length[j])[pair] + theirs
    np.add.at(edge, low, 1)
    np.add.at(edge, low + size, -1)
    keep = np.cumsum(edge[:-1]) == 0
    codes = s.codes[(s.start[j][row] + place)[keep]]
    length = np.bincount(row[keep], minlength=len(j))
    start = np.cumsum(length) - length
    without = np.zeros((int((s.length[i].max() + 63) >> 6), len(i)), np.uint64)
    for w in range(len(without)):
        np.add.at(without[w], pair, LOW[np.clip(mine + size - 64 * w, 0, 64)] ^ LOW[np.clip(mine - 64 * w, 0, 64)])
    out = np.zeros(len(i), np.int64)
    for some, own, at, words in s.cells(i):
        out[some] = _steps(_rows(s.masks(own, words), at * s.letters, codes, start[some], length[some], without[:, some]))
    return out


def partials(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of the shorter string with a window of the longer, windows clipped at both ends included."""
    names, i, j = _numbered(a, b)
    out, open_ = np.zeros(len(i)), []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        if len(names[x]) > len(names[y]):
            x, y = y, x
        if names[x] in names[y] if names[x] else not names[y]:
            out[k] = 100.0
        elif names[x]:
            open_.append((k, x, y))
            if len(names[x]) == len(names[y]):
                open_.append((k, y, x))
    if open_:
        at, x, y = np.array(open_, np.int64).T
        np.maximum.at(out, at, _windows(Letters(names), x, y))
    return out


def _windows(s: Letters, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The best ratio of the first string with a beginning or an end of the second that is shorter than it, and with any window of its length.

    One run of the first string over all of the second gives the subsequences with all beginnings, one backwards those with all ends. Their
    least bounds that of a window, and only windows that may beat the first and the last are run one by one."""
    back, out = s.backwards(), np.zeros(len(i))
    for mine, own, at, words in s.cells(j):
        n, m = s.length[i[mine]], s.length[j[mine]]
        steps, best = [], np.zeros(len(mine))
        for side in (s, back):
            rows = _rows(side.masks(own, words), at * s.letters, side.codes, side.start[i[mine]], n)
            bits = np.unpackbits(np.ascontiguousarray(~rows.T).view(np.uint8), axis=1, bitorder="little")
            steps.append(np.cumsum(bits, axis=1, dtype=np.int32))
            ends = np.arange(1, bits.shape[1] + 1)
            clipped = np.where(ends < n[:, None], 200.0 * steps[-1] / (n[:, None] + ends), 0.0)
            best = np.maximum(best, clipped.max(axis=1))
        left, right = steps
        rows = np.arange(len(mine))
        most = np.maximum(left[rows, n - 1], right[rows, n - 1]).astype(np.int64)
        pair, start = _ragged(np.maximum(m - n - 1, 0))
        start += 1
        useful = np.minimum(left[pair, start + n[pair] - 1], right[pair, m[pair] - start - 1]) > most[pair]
        pair, start = pair[useful], start[useful]
        for low in range(0, len(pair), WINDOWS):
            p, begin = pair[low : low + WINDOWS], start[low : low + WINDOWS]
            found = np.zeros(len(p), np.int64)
            for some, short, which, w in s.cells(i[mine[p]]):
                found[some] = _steps(_rows(s.masks(short, w), which * s.letters, s.codes, s.start[j[mine[p[some]]]] + begin[some], n[p[some]]))
            np.maximum.at(most, p, found)
        out[mine] = np.maximum(best, 100.0 * most / n)
    return out


def common(a: str, b: str) -> int:
    return int(commons([a], [b])[0])


def ratio(a: str, b: str) -> float:
    return float(ratios([a], [b])[0])


def token_sort(a: str, b: str) -> float:
    return float(token_sorts([a], [b])[0])


def token_set(a: str, b: str) -> float:
    return float(token_sets([a], [b])[0])


def partial(a: str, b: str) -> float:
    return float(partials([a], [b])[0])


SCORERS = {"ratio": ratios, "token_sort": token_sorts, "token_set": token_sets, "partial": partials}


def scores(wanted: dict[str, tuple[str, str, str]]) -> Column:
    """A struct of scores: {name: (kind of SCORERS, column, column)}, all in one Arrow call. Nulls count as empty."""
    columns = sorted({c for _, a, b in wanted.values() for c in (a, b)})
    plan = [(SCORERS[kind], columns.index(a), columns.index(b)) for kind, a, b in wanted.values()]

    @F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in wanted]))
    def scored(*series: pd.Series) -> pd.DataFrame:
        texts = [s.fillna("").tolist() for s in series]
        return pd.DataFrame({name: f(texts[a], texts[b]) for name, (f, a, b) in zip(wanted, plan, strict=True)})

    return scored(*[F.col(c) for c in columns])
