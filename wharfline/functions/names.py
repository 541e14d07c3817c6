"""Names: normal forms, similarity, tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_name(name: Column | str) -> Column:
    """ID-01: upper case, other characters than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.upper(F.trim(_c(name))), "[^A-Z0-9]+", " "))


def header_token(name: Column | str) -> Column:
    """ING-03: lower-case letters and digits, without a ``__duplicate_n`` ending."""
    return F.lower(F.regexp_replace(F.regexp_replace(_c(name), r"__duplicate_\d+$", ""), r"[^\p{L}\p{N}]", ""))


def is_blank(value: Column | str) -> Column:
    return _c(value).isNull() | (F.trim(_c(value)) == "")


@F.pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two strings (gestalt pattern matching), which no built-in gives; 4 decimals."""
    return pd.Series([round(SequenceMatcher(None, x, y).ratio(), 4) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def name_similarity(a: Column | str, b: Column | str) -> Column:
    """ID-02: 0 for a blank, 1 for equal, 0.99 for equal in normal form, else the matching ratio of the normal forms."""
    x, y = normalise_name(a), normalise_name(b)
    return F.when(is_blank(a) | is_blank(b), 0.0).when(_c(a) == _c(b), 1.0).when(x == y, 0.99).otherwise(matching_ratio(x, y))


TILE, KEPT, WORD = 1024, 4, 64  # names compared at once; occurrences of a character that count one by one; characters of a machine word


class _Tile:
    """Names of about one length: the codes of their characters, how often each has each character, and where, as bits."""

    def __init__(self, names: Sequence[str], points: np.ndarray) -> None:
        self.names, self.shortest, self.longest = names, len(names[0]), len(names[-1])
        self.codes = np.searchsorted(points, np.array(names, f"U{self.longest}").view(np.uint32).reshape(len(names), -1))
        self.counts = np.stack([(self.codes == c).sum(1) for c in range(1, len(points))], 1)
        self.sizes = self.counts.sum(1)
        if self.longest <= WORD:
            self.bits, rows = np.zeros((len(names), len(points)), np.uint64), np.arange(len(names))
            for k in range(self.longest):
                self.bits[rows, self.codes[:, k]] |= np.uint64(1 << k)
            self.bits[:, 0] = 0  # code 0 is no character
            self.whole = np.bitwise_or.reduce(self.bits, axis=1)

    def features(self, most: np.ndarray, t: float, first: bool) -> np.ndarray:
        """Vectors whose product bounds, for names of lengths m and n, the characters that both have, less t (m + n) / 2."""
        at, nth = np.repeat(np.arange(len(most)), most), np.concatenate([np.arange(x) for x in most])
        own = (np.maximum(self.counts - KEPT, 0).sum(1) - t * self.sizes) / 2  # of those not counted one by one, no more are common than their mean
        one = np.ones(len(own))
        return np.column_stack([self.counts[:, at] > nth, *((own, one) if first else (one, own))]).astype(np.float32)


def _tiles(names: Sequence[str], points: np.ndarray) -> list[_Tile]:
    by_size = sorted(names, key=len)
    return [_Tile(by_size[k : k + TILE], points) for k in range(0, len(by_size), TILE)]


def _common_of_words(x: _Tile, y: _Tile, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of names ``i`` of x, of at most 64 characters, and ``j`` of y, by carries of sums."""
    v, bits, row = np.full(len(i), ~np.uint64(0)), x.bits.ravel(), i * x.bits.shape[1]
    for codes in np.ascontiguousarray(y.codes.T):
        u = bits.take(codes.take(j) + row)
        u &= v
        s = v + u
        v -= u
        v |= s
    return np.bitwise_count(~v & x.whole[i])


def common_length(p: str, q: str) -> int:
    """Length of the longest common subsequence."""
    bits: dict[str, int] = {}
    for k, c in enumerate(p):
        bits[c] = bits.get(c, 0) | 1 << k
    v = whole = (1 << len(p)) - 1
    for c in q:
        u = v & bits.get(c, 0)
        v = ((v + u) | (v - u)) & whole
    return len(p) - v.bit_count()


def alike_names(left: Sequence[str], right: Sequence[str] | None, least: float) -> Iterator[tuple[str, str]]:
    """Pairs p < q of distinct, non-empty names, one of each side (no right side: both of the left one), with a matching ratio of ``least`` or more.

    A ratio of t needs t (m + n) / 2 common characters in order. One product of matrices bounds the characters that all names of
    two tiles have in common in any order, then machine words count those in order; few pairs are left whose ratio is taken.
    """
    t = least - 5e-5  # ratios are rounded to 4 digits
    points = np.array(sorted({0, *map(ord, set().union(*left, *(right or ())))}), np.uint32)
    xs = _tiles(left, points)
    ys = xs if right is None else _tiles(right, points)
    if not xs or not ys:
        return
    most = np.minimum(KEPT, np.minimum(*(np.max([z.counts.max(0) for z in zs], axis=0) for zs in (xs, ys))))
    others = [y.features(most, t, False) for y in ys]
    for at, x in enumerate(xs):
        own = x.features(most, t, True)
        for to, y in enumerate(ys):
            short, long = min(x.longest, y.longest), max(x.shortest, y.shortest)
            if (right is None and to < at) or 2 * short < t * (short + long) - 1e-9:
                continue
            bound = own @ others[to].T
            i, j = np.divmod(np.flatnonzero(bound > -1e-3 - 1e-6 * (x.longest + y.longest)), len(y.names))  # room for rounding
            if right is None and to == at:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 18):
                yield from _checked(x, y, i[k : k + (1 << 18)], j[k : k + (1 << 18)], t, least)


def _checked(x: _Tile, y: _Tile, i: np.ndarray, j: np.ndarray, t: float, least: float) -> Iterator[tuple[str, str]]:
    if x.longest > WORD >= y.longest:
        x, y, i, j = y, x, j, i
    need = t * (x.sizes[i] + y.sizes[j]) / 2 - 1e-9
    if x.longest <= WORD:
        fits = _common_of_words(x, y, i, j) >= need
    else:
        fits = np.array([common_length(x.names[a], y.names[b]) >= n for a, b, n in zip(i, j, need, strict=True)], bool)
    for a, b in zip(i[fits], j[fits], strict=True):
        p, q = sorted((x.names[a], y.names[b]))
        if round(SequenceMatcher(None, p, q).ratio(), 4) >= least:
            yield p, q
