"""Collocations by prefix-free parsing: exact counts of all phrases of 1 to ``most`` words, and the phrases whose parts meet more than by chance.

Texts are split into pieces at ``. , ; : ! ?`` and line ends, over which no phrase goes. A text is cut into chunks wherever
the hash of ``most - 1`` words of a piece has a given remainder, so equal content is cut alike everywhere. The words that trigger a cut end one chunk and begin the next;
a phrase belongs to the chunk that holds its first word before the closing overlap, so each is counted once and lies whole
in one chunk. Distinct chunks with their frequencies are the dictionary; phrases are counted inside distinct chunks,
weighted by the frequency.

Counting has two passes, both linear in the dictionary. Blocks of chunks send a hash and a count of each of their distinct
phrases to buckets by ranges of the hash; a bucket answers with a bit for each: whether the hash is frequent in all. Only
phrases with that bit are then counted by their text. A hash that several phrases share can only let a rare phrase through to
that exact count: no result depends on hashes. A block sends any phrase once, so common ones crowd no bucket.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, materialise, slices

MOST, LEAST, TOP, CONTAINED = 3, 10, 2000, 50
CHUNK = 16  # words between triggers, on average
GROUP = 4 << 20  # bytes of text that are parsed at a time
BLOCK = 4 << 20  # bytes of a block of the dictionary
BUCKET = 2 << 20  # hashes that a bucket holds, about
BITS = 48  # of a hash that travel
DRAWN = 16  # parts in which a language's first phrases are looked for

SPACE, PIECE, LINE = 32, 13, 10
_pieces = bytes.maketrans(b".,;:!?\n\x0b\x0c\t", b"\r\r\r\r\r\r\r\r\r ")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _B
    x = (x ^ x >> np.uint64(27)) * _C
    return x ^ x >> np.uint64(31)


class Parsed:
    """Words of lines of text, which CR parts into pieces: where each starts and ends, its line and piece and its hash."""

    def __init__(self, text: bytes) -> None:
        raw = np.frombuffer(text, np.uint8)
        gap = (raw == SPACE) | (raw == PIECE) | (raw == LINE)
        kept = np.ones(len(raw), bool)
        kept[1:] = ~((raw[1:] == SPACE) & gap[:-1] | (raw[1:] == PIECE) & (raw[:-1] == PIECE))  # one space between words
        raw, gap = raw[kept], gap[kept]
        self.text = raw.tobytes()
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        line_ends = np.flatnonzero(raw == LINE)
        self.line = np.searchsorted(line_ends, self.starts)
        self.lines = len(line_ends) + 1
        self.piece = np.searchsorted(np.flatnonzero((raw == PIECE) | (raw == LINE)), self.starts)
        self.hashes = np.zeros(len(self.starts), np.uint64)
        if len(self.starts):
            letters = raw[~gap].astype(np.uint64) + np.uint64(1)
            sizes = self.ends - self.starts
            heads = np.cumsum(sizes) - sizes
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), _A)]))
            letters *= power[np.arange(len(letters)) - np.repeat(heads, sizes)]
            self.hashes = _mixed(np.add.reduceat(letters, heads))


def cuts(parsed: Parsed, overlap: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word + 1, whether its line ends with it) of each chunk; words that trigger a cut stand in one piece."""
    n = len(parsed.starts)
    head = np.diff(parsed.line, prepend=-1) != 0  # a line's first word
    trigger = np.zeros(n, bool)
    if n >= overlap:
        window = np.zeros(n - overlap + 1, np.uint64)
        for i in range(overlap):
            window = _mixed(window * _A + parsed.hashes[i : n - overlap + 1 + i])
        trigger[: len(window)] = (window % np.uint64(every) == 0) & (parsed.piece[: len(window)] == parsed.piece[overlap - 1 :])
    first = np.flatnonzero(head | trigger)
    after = np.append(first[1:], n)
    last = np.append(head[first[1:]], True) if len(first) else np.zeros(0, bool)
    return first, np.where(last, after, after + overlap), last


def _chunks(docs: DataFrame, most: int, every: int) -> DataFrame:
    """(lang, chunk, last, words): every chunk of every text; ``words`` counts those that begin a phrase of its own."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            held, langs, size = [], [], 0
            for lang, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = (text or "").encode().lower().translate(_pieces)  # lowers A to Z only
                if held and size + len(raw) > GROUP:
                    yield chunked(held, langs)
                    held, langs, size = [], [], 0
                held.append(raw)
                langs.append(lang)
                size += len(raw)
            if held:
                yield chunked(held, langs)

    def chunked(held: list[bytes], langs: list[str]) -> dict:
        parsed = Parsed(b"\n".join(held))
        first, end, last = cuts(parsed, most - 1, every)
        begin, stop = parsed.starts[first].tolist(), parsed.ends[end - 1].tolist()
        lang = pa.array(langs, pa.string()).take(pa.array(parsed.line[first]))
        return {"lang": lang, "chunk": [parsed.text[s:e].decode() for s, e in zip(begin, stop, strict=True)], "last": last, "words": np.where(last, end - first, end - first - (most - 1))}

    return arrow_map(docs.select("lang", "text"), parse, "lang string, chunk string, last boolean, words long")


def _blocks(chunks: DataFrame) -> DataFrame:
    """The dictionary: distinct chunks with their frequencies, in blocks, and the words of each block by language."""
    distinct = chunks.groupBy("lang", "chunk", "last", "words").agg(F.count("*").alias("n"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        held, size, number = [], 0, 0

        def out() -> dict:
            lang, chunk, last, words, n = (pa.concat_arrays([b.column(i) for b in held]) for i in range(5))
            totals = pa.table({"lang": lang, "n": pc.multiply(words, n)}).group_by("lang").aggregate([("n", "sum")])
            of = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return {"block": [part << 32 | number], "chunks": ["\n".join(chunk.to_pylist())], "langs": of(lang), "lasts": of(last), "counts": of(n), "size": [pc.sum(words).as_py()], "totals": [[{"lang": k, "n": v} for k, v in zip(totals["lang"].to_pylist(), totals["n_sum"].to_pylist(), strict=True)]]}

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy() + 1)
            at = 0
            while at < batch.num_rows:  # as many rows as fit, one at least
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + BLOCK - size, side="right"))
                if to <= at and not held:
                    to = at + 1
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(ends[to - 1]) - before
                if to < batch.num_rows:
                    yield out()
                    held, size, number = [], 0, number + 1
                at = max(at, to)
        if held:
            yield out()

    return arrow_map(distinct, block, "block long, chunks string, langs array<string>, lasts array<boolean>, counts array<long>, size long, totals array<struct<lang:string,n:long>>")


class Counted:
    """The distinct phrases of a block: where each first stands, its words, its frequency and its hash, by hash."""

    def __init__(self, chunks: str, langs: list[str], lasts: list[bool], counts: list[int], most: int) -> None:
        self.parsed = parsed = Parsed(chunks.encode())
        self.langs = langs
        n = len(parsed.starts)
        behind = lambda of: np.searchsorted(of, of, side="right")  # noqa: E731 - of each word, where its chunk or piece ends
        limit, own = behind(parsed.piece), behind(parsed.line)
        own = np.where(np.array(lasts)[parsed.line], own, own - (most - 1))
        weight = np.array(counts, np.int64)[parsed.line]
        names: dict[str, int] = {}
        lang = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)[parsed.line]
        salt = np.array([xxhash.xxh3_64_intdigest(x) for x in names], np.uint64)[lang]
        words = parsed.text.split()
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter((numbers[w] for w in words), np.int64, n) * len(names) + lang
        key, hashes, at = ids, _mixed(parsed.hashes + salt), np.arange(n)
        found = []
        for size in range(1, most + 1):
            if size > 1:
                at = at[at + size <= limit[at]]
                key = key[at] * (int(ids.max(initial=0)) + 1) + ids[at + size - 1]
                hashes = hashes.copy()
                hashes[at] = _mixed(hashes[at] * _A + parsed.hashes[at + size - 1])
            order = np.argsort(key)
            inside = key[order]
            differs = np.append(True, inside[1:] != inside[:-1]) if len(inside) else np.zeros(0, bool)
            new = np.flatnonzero(differs)
            mine = at < own[at]
            first = at[order[new]]
            total = np.add.reduceat((weight[at] * mine)[order], new) if len(new) else np.zeros(0, np.int64)
            used = total > 0
            found.append(np.stack([first[used], np.full(int(used.sum()), size), total[used], hashes[first[used]].view(np.int64)]))
            if size < most:
                rank = np.empty(len(at), np.int64)
                rank[order] = np.cumsum(differs) - 1
                key = np.zeros(n, np.int64)
                key[at] = rank
        self.first, self.size, self.total, hashes = np.concatenate(found, axis=1)
        self.hashes = hashes.view(np.uint64) >> np.uint64(64 - BITS)
        order = np.argsort(self.hashes)  # phrases of one hash get the same answer, whatever their order
        self.first, self.size, self.total, self.hashes = (x[order] for x in (self.first, self.size, self.total, self.hashes))

    def buckets(self, many: int) -> list[tuple[int, int, int]]:
        """(bucket, from, to) for the phrases of each bucket."""
        of = ((self.hashes >> np.uint64(BITS - 32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)
        used, starts = np.unique(of, return_index=True)
        return [(int(u), s, e) for u, (s, e) in zip(used, slices(starts, len(of)), strict=True)]


def _packed(hashes: np.ndarray, counts: np.ndarray, least: int) -> bytes:
    """Ascending hashes by their differences, byte by byte, and counts up to ``least``."""
    planes = np.diff(hashes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T
    return zstandard.compress(planes.tobytes() + np.minimum(counts, least).astype("<u2").tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(raw)
    n = len(raw) // (BITS // 8 + 2)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, : BITS // 8] = np.frombuffer(raw, np.uint8, n * BITS // 8).reshape(-1, n).T
    return np.cumsum(steps.view("<u8").ravel()), np.frombuffer(raw, "<u2", n, n * BITS // 8)


def phrase_counts(docs: DataFrame, *, lang: str = "lang", text: str = "text", most: int = MOST, least: int = LEAST, every: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, n) of all phrases of 1 to ``most`` words that occur ``least`` times or more in a language, (lang, n) of all words)."""
    if not 2 <= most <= 8 or not 1 <= least < 1 << 16:
        raise ValueError("phrases have 2 to 8 words and at least 1 to 65,535 occurrences")
    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    blocks = materialise(_blocks(_chunks(own, most, every)), "phrase-blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    many = max(1, -(-size * most // BUCKET))  # buckets follow the input
    columns = ["block", "chunks", "langs", "lasts", "counts"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, *rest = (c[i].as_py() for c in batch.columns)
                known = Counted(*rest, most)
                to = known.buckets(many)
                yield {"bucket": [b for b, _, _ in to], "block": [block] * len(to), "hashes": [_packed(known.hashes[s:e], known.total[s:e], least) for _, s, e in to]}

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, []

        def out() -> dict:
            read = [_unpacked(raw) for _, raw in held]
            hashes, totals = (np.concatenate([r[i] for r in read]) for i in (0, 1))
            _, at = np.unique(hashes, return_inverse=True)
            frequent = np.bincount(at, totals)[at] >= least
            each = np.split(frequent, np.cumsum([len(r[0]) for r in read])[:-1])
            return {"block": [b for b, _ in held], "bucket": [now] * len(held), "frequent": [np.packbits(x).tobytes() for x in each]}

        for batch in batches:
            for bucket, block, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bucket != now and held:
                    yield out()
                    held = []
                now = bucket
                held.append((block, raw))
        if held:
            yield out()

    sent = arrow_map(blocks.select(*columns), send, "bucket long, block long, hashes binary")
    answers = arrow_map(sent.repartition(max(2, many), "bucket").sortWithinPartitions("bucket"), answer, "block long, bucket long, frequent binary")
    answers = materialise(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "frequent")).alias("answers")), "phrase-answers")  # a bit for each phrase of the block

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, *rest, answers = (c[i].as_py() for c in batch.columns)
                known = Counted(*rest, most)
                bits = {a["bucket"]: a["frequent"] for a in answers}
                frequent = np.concatenate([np.unpackbits(np.frombuffer(bits[b], np.uint8), count=e - s) for b, s, e in known.buckets(many)])
                at = np.flatnonzero(frequent)
                first, size = known.first[at], known.size[at]
                begin, stop = known.parsed.starts[first].tolist(), known.parsed.ends[first + size - 1].tolist()
                langs = pa.array(known.langs, pa.string()).take(pa.array(known.parsed.line[first]))
                yield {"lang": langs, "size": size, "phrase": [known.parsed.text[s:e].decode() for s, e in zip(begin, stop, strict=True)], "n": known.total[at]}

    told = arrow_map(blocks.join(answers, "block").select(*columns, "answers"), tell, "lang string, size int, phrase string, n long")
    counted = told.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    words = blocks.select(F.inline("totals")).groupBy("lang").agg(F.sum("n").alias("n"))
    return materialise(counted, "phrase-counts"), words


def collocations(counts: DataFrame, *, contained: int = CONTAINED) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more in ``counts`` that no longer one holds.

    Each cut of a phrase into two parts has the score floor(1,000,000 a a / (l r)), a, l and r being how often phrase and
    parts occur; the lowest counts, of equal ones the first. A phrase goes if a longer one, kept or not, that has its words
    in a row occurs at least ``contained`` hundredths as often. Arithmetic is in whole numbers of up to 38 digits.
    """
    words = F.split("phrase", " ")
    phrases = counts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("words"))
    cut = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("words", k + 1, F.col("size") - k), " ").alias("right")))
    both = phrases.select("lang", "phrase", "a", F.inline(cut))
    for part, n in (("left", "l"), ("right", "r")):  # a word may be part of very many phrases: Spark splits such joins
        both = both.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n)), ["lang", part])
    both = both.withColumn("score", F.expr("(1000000 * cast(a as decimal(16)) * cast(a as decimal(16))) div (cast(l as decimal(19)) * cast(r as decimal(19)))"))
    least = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")),
        )
    )
    longer = phrases.filter("size > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = least.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.lit(100) * F.col("longer") < F.lit(contained) * F.col("a"), F.lit(True)))
    return free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, *, lang: str = "lang", text: str = "text", most: int = MOST, least: int = LEAST, top: int = TOP, contained: int = CONTAINED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations by score, then a, then phrase.

    Words are what spaces and tabs part inside a piece, A to Z in lower case. A null language counts as ``und``, a null text
    as empty; texts without words add nothing, nor does an empty table. Repeated rows count each. Texts are read whole; one
    text is parsed at a time, or several short ones together. Ties end with the phrase, by its UTF-8 bytes, so order is
    total. Columns other than ``lang`` and ``text`` aren't read.
    """
    counts, words = phrase_counts(docs, lang=lang, text=text, most=most, least=least)
    found = collocations(counts, contained=contained)
    order = F.desc("score"), F.desc("a"), "phrase"
    first = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    some = first(found.withColumn("drawn", F.pmod(F.xxhash64("phrase"), F.lit(DRAWN))), "lang", "drawn")
    ranked = first(some.drop("drawn", "rank"), "lang").withColumn("rank", F.col("rank").cast("long"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
