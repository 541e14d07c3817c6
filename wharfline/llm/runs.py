"""Periodic runs of words, by a dictionary of basic factors.

Words are the texts' stretches of other characters than the space and U+0009 to U+000D. A run is a stretch of consecutive
words with smallest period q (words q apart are identical) and at least max(6, 4 q) words that no neighbouring word
extends keeping the period. For each power of two, equal factors of that many words get equal names, each level's from two
names of the level before. A factor and its next occurrence that starts before the factor ends lie in a window of twice
the length; there, successors form arithmetic progressions, and their common difference is proposed as a period.
Progressions that start at neighbouring words with the same difference are one stretch, which extends to a whole run: at
the level of length 2^k >= q each word of a run has its successor exactly q on, up to q + 2^k words before the run's end,
as a root that isn't itself a repetition differs from its rotations. So a stretch ends where the run does, and the same
run, found at several levels, is kept once.

Texts of a batch are named together, in numpy; only factors that recur in their text reach the next level. Null texts and
texts without words have no run and an empty collapsed text. Texts are read whole, however long: memory is proportional to
the longest. Rows are read one by one, so ties and repeated rows get the same result each; of runs in one text all are
returned, by start, then period. An empty table gives an empty one. ``analyse`` is a function of a column, so the other
columns of the table, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

LEAST_WORDS, LEAST_TIMES = 6, 4  # a run has at least so many words, and periods
WORDS = 1 << 20  # named together, or the words of one longer text


def _named(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of equal values; the order that sorts them, positions ascending; and which of the sorted equal the one before."""
    order = np.argsort(pairs, kind="stable")
    inside = pairs[order]
    equal = inside[1:] == inside[:-1]
    names = np.empty(len(pairs), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~equal)])
    return names, order, equal


def find_runs(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in texts that lie one behind the other, by start, then period.

    ``words``: an id for each word, equal for equal words; ``ends``: for each text the position behind its last word.
    """
    sizes = np.diff(ends, prepend=0)
    longest = int(sizes.max(initial=0))
    if longest < LEAST_WORDS:
        return (np.zeros(0, np.int64),) * 3
    text = np.repeat(np.arange(len(ends)), sizes)
    at = np.arange(len(words))  # words at which a factor of this level starts that recurs so far
    pairs = words * len(ends) + text  # factors of different texts differ
    found = []
    size = 1
    while len(at):
        names, order, equal = _named(pairs)
        places = at[order]
        step = places[1:] - places[:-1]
        near = np.flatnonzero(equal & (step <= size))
        starts, steps = places[near], step[near]
        by_place = np.argsort(starts, kind="stable")
        starts, steps = starts[by_place], steps[by_place]
        cut = np.flatnonzero((np.diff(starts, prepend=-2) != 1) | (np.diff(steps, prepend=0) != 0))  # a stretch begins
        last = np.append(cut[1:], len(starts)) - 1
        if len(cut):
            first, period = starts[cut], steps[cut]
            length = starts[last] - first + period + size
            whole = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
            found.append(np.stack([first[whole], length[whole], period[whole]]))
        if size * LEAST_TIMES >= longest:  # longer periods don't recur often enough
            break
        again = np.zeros(len(at), bool)
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        name_at = np.full(len(words) + size, -1, np.int64)
        name_at[at[again]] = names[again]
        at = at[again]
        right = name_at[at + size]
        on = (right >= 0) & (at + 2 * size <= ends[text[at]])
        pairs = name_at[at[on]] * (int(names.max()) + 1) + right[on]
        at = at[on]
        size *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    all_found = np.unique(np.concatenate(found, axis=1)[[0, 2, 1]], axis=1)  # by start, then period
    return all_found[0], all_found[2], all_found[1]


def _groups(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of texts, by groups of about ``WORDS`` words."""
    held, size = [], 0
    for t in texts:
        words = (t or "").encode().split()  # splits bytes at these six characters
        if held and size + len(words) > WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


_RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
_RESULT = StructType().add("runs", ArrayType(_RUN)).add("collapsed", StringType())


def _analysed(column: pa.Array) -> pa.Array:
    counts, parts, collapsed = [], [], []
    for group in _groups(column.to_pylist()):
        ends = np.cumsum([len(words) for words in group])
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter((numbers[w] for words in group for w in words), np.int64, int(ends[-1]))
        starts, lengths, periods = find_runs(ids, ends)
        owner = np.searchsorted(ends, starts, side="right")
        counts.append(np.bincount(owner, minlength=len(group)))
        heads = np.append(0, ends[:-1])
        parts.append(np.stack([starts - heads[owner], lengths, periods]))
        change = np.bincount(starts + periods, minlength=int(ends[-1]) + 1) - np.bincount(starts + lengths, minlength=int(ends[-1]) + 1)
        kept = np.cumsum(change) == 0
        for words, head, n in zip(group, heads.tolist(), counts[-1].tolist(), strict=True):
            collapsed.append(b" ".join([words[i] for i in np.flatnonzero(kept[head : head + len(words)])] if n else words).decode())
    each = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
    offsets = np.append(0, np.cumsum(np.concatenate(counts))) if counts else [0]
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in each], names=_RUN.names))
    return pa.StructArray.from_arrays([runs, pa.array(collapsed, pa.string())], names=_RESULT.names)


def analyse(text: Column | str) -> Column:
    """For a text column: (runs, collapsed); runs by start, then period, each (start, length, period) in words from 0.

    ``collapsed`` has the words, joined by one space, that no run contains behind its first period.
    """
    return F.arrow_udf(_analysed, _RESULT)(F.col(text) if isinstance(text, str) else text)


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, period): a row for each run; ``key`` keeps its type, null or not. Other columns aren't read."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), analyse(F.col(f"`{text}`")).alias("found"))
    return rows.select("doc_id", F.inline("found.runs"))


def longest(runs: Column) -> Column:
    """The run with the greatest length, of those the one that starts first, then the shortest period; null for no runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    return F.when(F.size(runs) > 0, F.struct((-best["back"]).alias("start"), best["length"].alias("length"), (-best["less"]).alias("period")))
