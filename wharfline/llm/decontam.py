"""Benchmark decontamination: a BM25 inverted index of the test items, searched by every training passage with block-max WAND.

Impacts are divided by the item's score against itself, so that 1 means that a passage holds all of the item's terms. What
scores at least ``theta`` is verified: the item's question and its answer (the last sentence) must both overlap the passage.

Block maxima rule items out: the sum of a passage's terms' largest impacts in a block of items bounds the score of each of
them. Only blocks that may hold a hit are entered, by cursors that move to the next item whose terms' maxima reach ``theta``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, csr_take, materialise, texts

K1, B = 1.2, 0.75
BLOCK = 4  # items in a block
SPREAD = 4  # items of an index differ in length by less than this factor, so that passages fit them

words_of = re.compile(r"\w+").findall
_sentences = re.compile(r"(?<=[.!?])\s+|\n+").split


def shingles(words: list[str], width: int = 5) -> set[tuple[str, ...]]:
    """All runs of ``width`` words; all words, if there are fewer; none for no words."""
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence is a question without an answer."""
    parts = [w for s in _sentences(text) if (w := words_of(s.lower()))]
    return ([w for p in parts[:-1] for w in p], parts[-1]) if len(parts) > 1 else (parts[0] if parts else [], [])


class Index:
    """Postings (items in order, impacts) by term, and the largest impact of each term in each block of items."""

    def __init__(self, items: list[tuple[object, str]], frequency: dict[str, int] | None = None, n_items: int | None = None, mean: float | None = None, step: int | None = None) -> None:
        """frequency, n_items, mean: in how many items a term is, their number and mean length in the whole benchmark; step: words that no item exceeds (default: of these items)."""
        words = [(i, words_of(t.lower()), t) for i, t in items]
        words = [x for x in words if x[1]]
        self.items = [i for i, _, _ in words]
        own = [Counter(w) for _, w, _ in words]
        parts = [question_and_answer(t) for _, _, t in words]
        self.questions, self.answers = [shingles(q) for q, _ in parts], [shingles(a) for _, a in parts]
        sizes = [c.total() for c in own]
        self.step = step or max(sizes, default=1)
        if frequency is None:
            frequency, n_items, mean = Counter(t for c in own for t in c), len(own), sum(sizes) / max(1, len(sizes))
        idf = {t: math.log1p((n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) for c in own for t in c}
        self.postings: dict[str, tuple[list[int], list[float]]] = {}
        for at, c in enumerate(own):
            norm = K1 * (1 - B + B * sizes[at] / mean)
            impact = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in c.items()}
            total = sum(impact.values())
            for t, x in impact.items():
                ids, impacts = self.postings.setdefault(t, ([], []))
                ids.append(at)
                impacts.append(x / total)
        self.number = {t: i for i, t in enumerate(self.postings)}
        self.n_blocks = -(-len(own) // BLOCK)
        blocks, tops, many = [], [], []
        for ids, impacts in self.postings.values():
            best: dict[int, float] = {}
            for i, x in zip(ids, impacts, strict=True):
                best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), x)
            blocks += best
            tops += best.values()
            many.append(len(best))
        self.blocks, self.tops, self.many = np.array(blocks, np.int64), np.array(tops), np.array(many, np.int64)
        self.starts = np.cumsum(self.many) - self.many

    def open_blocks(self, terms: set[str], theta: float) -> np.ndarray:
        """Blocks of which some item may score theta: those where the terms' block maxima add up to it."""
        rows = np.fromiter(map(self.number.__getitem__, terms), dtype=np.int64, count=len(terms))
        at = csr_take(self.starts[rows], self.many[rows])
        return np.flatnonzero(np.bincount(self.blocks[at], self.tops[at], self.n_blocks) >= theta - 1e-6)

    def retrieve(self, terms: set[str], theta: float) -> list[tuple[int, float]]:
        """(item, score) of all items that score at least theta, by block-max WAND.

        Cursors stand in the postings of the terms, in order of their items. The pivot is the first item at which the maxima
        of the lists up to there reach theta: nothing before it can. In a block whose maxima can't reach it no item is scored.
        """
        out: list[tuple[int, float]] = []
        may = self.open_blocks(terms, theta).tolist()
        if not may:
            return out
        theta -= 1e-6  # sums in another order differ
        lists = [self.postings[t] for t in terms]
        # [items, impacts, position, largest impact]; a cursor enters at the first block that may hold a hit
        cursors = [[ids, impacts, bisect_left(ids, may[0] * BLOCK), max(impacts)] for ids, impacts in lists]
        while True:
            cursors = sorted((c for c in cursors if c[2] < len(c[0])), key=lambda c: c[0][c[2]])
            upper, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                upper += c[3]
                if upper >= theta:
                    pivot = i
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0][cursors[pivot][2]]
            at = bisect_left(may, item // BLOCK)
            if at == len(may):
                return out
            if may[at] != item // BLOCK:  # no item of this block, nor of those up to the next that may, can reach theta
                for c in cursors:
                    c[2] = bisect_left(c[0], may[at] * BLOCK, c[2])
            elif cursors[0][0][cursors[0][2]] == item:
                front = [c for c in cursors if c[0][c[2]] == item]
                score = sum(c[1][c[2]] for c in front)
                if score >= theta:
                    out.append((item, score))
                for c in front:
                    c[2] += 1
            else:
                for c in cursors[: pivot + 1]:
                    c[2] = bisect_left(c[0], item, c[2])

    def contaminated(self, words: list[str], theta: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """item: (score, question overlap, answer overlap), the best over the text's passages, for verified items.

        Passages are 2 * ``step`` words and start at each multiple of ``step``, so that one holds any copy of an item whole.
        """
        found: dict[int, tuple[float, float, float]] = {}
        if not len(self.open_blocks(self.number.keys() & set(words), theta)):  # bounds all passages
            return found
        for i in range(0, max(1, len(words) - self.step), self.step):
            passage = words[i : i + 2 * self.step]
            own: set[tuple[str, ...]] | None = None
            for item, score in self.retrieve(self.number.keys() & set(passage), theta):
                own = own if own is not None else shingles(passage)
                q, a = (self._held(s, own, passage) for s in (self.questions[item], self.answers[item]))
                if q >= overlap and a >= overlap:
                    found[item] = max(found.get(item, (0.0, 0.0, 0.0)), (score, q, a))
        return found

    @staticmethod
    def _held(wanted: set[tuple[str, ...]], own: set[tuple[str, ...]], passage: list[str]) -> float:
        """Share of the shingles that the passage has; 1 for none. A part of fewer than five words is one shingle of its own."""
        if not wanted:
            return 1.0
        width = len(next(iter(wanted)))
        return len(wanted & (own if width == 5 else shingles(passage, width))) / len(wanted)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each item's distinct terms, and its length under the null term."""
    for b in batches:
        term, many = [], []
        for t in texts(b):
            if words := words_of(t.lower()):
                own = set(words)
                term += [None, *own]
                many += [len(words), *[0] * len(own)]
        yield {"term": term, "words": many}


def find(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", theta: float = 0.6, overlap: float = 0.8, index_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) for each document and item that it contains.

    Every passage of the whole text is searched, however long. Null and empty texts and items without words or id match
    nothing; items of equal text are each found, as are those of equal id with different texts; repeated rows of either
    table give repeated results, and equal scores are no case: every item from ``theta`` on counts. Other columns are not
    read. An empty table of documents or items gives an empty table. Scores take term statistics of all items. Items are
    indexed by about ``index_bytes`` of text at a time: each index is broadcast and passed over the documents.
    """
    spark = docs.sparkSession
    keyed = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null")
    counted = materialise(arrow_map(keyed.select("text"), _terms, "term string, words long").groupBy("term").agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.max("words").alias("longest")), "item-terms")
    whole = counted.filter("term is null").first()
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // index_bytes))
    out = None
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, item_id {items.schema[item_key].dataType.simpleString()}, score double, question_overlap double, answer_overlap double"
    for b in range(blocks):
        some = keyed.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        used = arrow_map(some.select("text"), _terms, "term string, words long").select("term").distinct()
        frequency = {r.term: r.n for r in counted.join(used, "term").select("term", "n").collect()}  # terms of about index_bytes
        held = sorted((r.item_id, r.text) for r in some.collect())
        indexes = _by_length(held, frequency, whole.n, whole.words / whole.n, whole.longest) if whole else []
        found = arrow_map(rows, _search(spark.sparkContext.broadcast(indexes), theta, overlap), schema)
        out = found if out is None else out.union(found)
    return out


def _by_length(items: list[tuple[object, str]], frequency: dict[str, int], n_items: int, mean: float, longest: int) -> list[Index]:
    """An index for each class of lengths, the longest first; the classes are those of the whole benchmark, whose longest item is given."""
    classes: dict[int, list[tuple[object, str]]] = defaultdict(list)
    for i, t in items:
        if n := len(words_of(t.lower())):
            classes[int(math.log(longest / n, SPREAD) + 1e-9)].append((i, t))
    return [Index(classes[c], frequency, n_items, mean, longest // SPREAD**c) for c in sorted(classes)]


def _search(indexes, theta: float, overlap: float):  # noqa: ANN001, ANN202
    names = ("doc_id", "item_id", "score", "question_overlap", "answer_overlap")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = []
            for doc, t in zip(b.column(0).to_pylist(), texts(b), strict=True):
                words = words_of(t.lower())
                for index in indexes.value:
                    out += [(doc, index.items[item], *scores) for item, scores in sorted(index.contaminated(words, theta, overlap).items())]
            yield {n: [row[i] for row in out] for i, n in enumerate(names)}

    return rows
