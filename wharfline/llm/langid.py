"""Language identification: word-first backoff.

A known word is scored by its frequency in each language; an unseen word falls back to its longest known character
n-grams, from ``MAX_GRAM`` letters down to one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, bounded_sample, release, texts

MAX_GRAM = 5
CACHE = 150_000  # words that a Python worker remembers

_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Maximal runs of letters, in lower case. \\w also has a few numerals that are no letters; they don't count."""
    found = _runs(text.lower())
    if not text.isascii():
        found = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in found]
        found = [w for w in found if w]
    return found


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Backoff:
    """Log posteriors by word and by n-gram, for the languages in ``langs``."""

    def __init__(self, langs: list[str], rows: list[tuple[int, str, str, int]], smooth: float = 0.5) -> None:
        """rows: (0 for a word or the n-gram's n, the string, language, count)."""
        self.langs = langs
        at = {lang: i for i, lang in enumerate(langs)}
        self.tables: list[dict[str, int]] = []
        scores: list[np.ndarray] = []
        for n in range(MAX_GRAM + 1):
            mine = [r for r in rows if r[0] == n]
            table: dict[str, int] = {}
            for _, gram, _, _ in mine:
                table.setdefault(gram, len(table))
            counts = np.zeros((len(table), len(langs)))
            np.add.at(counts, ([table[r[1]] for r in mine], [at[r[2]] for r in mine]), [r[3] for r in mine])
            p = (counts + smooth) / (counts.sum(axis=0) + 1 + smooth * len(table))
            first = sum(map(len, scores))
            scores.append(np.log(p / p.sum(axis=1, keepdims=True)))
            self.tables.append({gram: first + i for gram, i in table.items()})
        self.rows = np.concatenate([*scores, np.zeros((1, len(langs)))])  # the last: nothing known
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)))

    def evidence(self, word: str) -> list[int]:
        """Rows whose mean scores the word: its own, or those of its longest known n-grams."""
        if (own := self.tables[0].get(word)) is not None:
            return [own]
        padded = f"<{word}>"
        for n in range(min(MAX_GRAM, len(padded)), 0, -1):
            table = self.tables[n]
            if known := [table[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in table]:
                return known
        return [len(self.rows) - 1]

    def learn(self, words: list[str]) -> None:
        found = [self.evidence(w) for w in words]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        rows = np.add.reduceat(self.rows[list(chain.from_iterable(found))], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
        while len(self.seen) + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[len(self.seen) : len(self.seen) + len(words)] = rows
        self.seen.update(zip(words, range(len(self.seen), len(self.seen) + len(words)), strict=True))

    def predict(self, text: str) -> tuple[str, float]:
        """The language and its posterior probability; ('und', 0) without letters or without a model."""
        counts = Counter(words_of(text))
        if not counts or not self.langs:
            return "und", 0.0
        if new := [w for w in counts if w not in self.seen]:
            self.learn(new)
        at = np.fromiter(map(self.seen.__getitem__, counts), dtype=np.int64, count=len(counts))
        total = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) @ self.scores[at]
        if len(self.seen) > CACHE:
            self.forget()
        p = np.exp(total - total.max())
        best = int(np.argmax(p))
        return self.langs[best], float(p[best] / p.sum())


def _count(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(texts(batch, "label"), texts(batch), strict=True):
            by_lang.setdefault(lang, Counter()).update(words_of(text))
        out: list[tuple[int, str, str, int]] = []
        for lang, words in by_lang.items():
            out += [(0, w, lang, c) for w, c in words.items()]
            for n in range(1, MAX_GRAM + 1):
                grams: Counter = Counter()
                for w, c in words.items():
                    for g in grams_of(w, n):
                        grams[g] += c
                out += [(n, g, lang, c) for g, c in grams.items()]
        yield dict(zip(("kind", "gram", "label", "cnt"), map(list, zip(*out, strict=True)) if out else ([], [], [], []), strict=True))


def train(docs: DataFrame, *, text: str = "text", label: str = "lang", max_docs: int = 2000) -> Backoff:
    """Fit on a bounded sample: about ``max_docs`` rows with a label, each drawn by itself.

    The model keeps all words and n-grams of the sample. Rows with a null label or text are left out, repeated rows count
    each; without any row the model knows no language.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(label).alias("label")).filter("label is not null and text is not null")
    counted = arrow_map(bounded_sample(rows, max_docs), _count, "kind int, gram string, label string, cnt long")
    found = counted.groupBy("kind", "gram", "label").agg(F.sum("cnt").alias("cnt")).toArrow()  # what about max_docs texts hold
    columns = [found.column(c).to_pylist() for c in ("kind", "gram", "label", "cnt")]
    return Backoff(sorted(set(columns[2])), sorted(zip(*columns, strict=True)))


def identify(docs: DataFrame, model: Backoff, *, text: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` (but those named in ``out``, which are replaced) and the predicted language and its probability.

    A null or empty text, or one without a letter, is ``und`` with score 0. Long texts are read whole; repeated rows get
    the same answer; ties between languages go to the first in alphabetical order. An empty table gives an empty table.
    """
    docs = docs.drop(*out)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = [known.value.predict(t) for t in texts(part, text)]
                part = part.append_column(out[0], _array([f[0] for f in found], "string"))
                yield part.append_column(out[1], _array([f[1] for f in found], "float64"))
        release()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{out[0]}` string, `{out[1]}` double")


def _array(values: list, kind: str):  # noqa: ANN202
    import pyarrow as pa

    return pa.array(values, type=pa.type_for_alias(kind))
