"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target and of a background corpus, share vocabulary, order and smoothing: the vocabulary is every
word of both corpora and the end of a text. A document's score is its per-token loss under the target model less that under
the background model: low means like the target.

Words and bigrams are told apart by 64-bit hashes and counted where they meet. Each text sends its distinct bigrams to hash
buckets, which return sums by document. Three routes give the same sums and only differ in where a count is known:

* bigrams of two very common words are counted beforehand in a table of bounded size and scored where the text is;
* bigrams whose second word is in a list of the most frequent words, which carries their counts, meet by bigram;
* bigrams of any other second word meet by that word, so that its own count is known there as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, bounded_sample, drop, materialise, path_of, slices

BEGIN, END = 0, 1
COMMON = 510  # words whose bigrams are counted beforehand
LISTED = 1 << 18  # most frequent words whose counts are broadcast
ROWS, CHARS = 2000, 2 << 20  # documents and characters of a chunk
TARGET = 0xFFFF  # row number of all that comes from the target


class Words:
    """Numbers of words as they come, begin and end first: their hashes, places among the common ones and in the list."""

    def __init__(self, common: dict[str, int], listed: np.ndarray | None = None) -> None:
        self.common, self.listed = common, listed
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.hashes, self.near = np.zeros(2, np.uint64), np.arange(2)
        self.at = np.full(2, -1)

    def read(self, text: str) -> np.ndarray:
        """The numbers of a text's words, between begin and end."""
        words = text.lower().split()
        out = np.empty(len(words) + 2, np.int64)
        out[0], out[-1] = BEGIN, END
        out[1:-1] = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        return out

    def learn(self) -> None:
        """Look up the words that got numbers since the last time."""
        new, self.number.new = self.number.new, []
        if not new:
            return
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        self.hashes = np.concatenate([self.hashes, hashes])
        self.near = np.concatenate([self.near, np.fromiter((self.common.get(w, -1) for w in new), np.int64, len(new))])
        if self.listed is not None:
            at = np.searchsorted(self.listed, hashes)
            at[at == len(self.listed)] = 0
            found = self.listed[at] == hashes if len(self.listed) else np.zeros(len(new), bool)
            self.at = np.concatenate([self.at, np.where(found, at, -1)])


class _Numbers(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self) + 2
        return n


class Model:
    """What is known of both corpora: totals, the counts of listed words, and those of bigrams of common words."""

    def __init__(self, words: tuple[int, int], texts: tuple[int, int], types: int, listed: np.ndarray, counts: np.ndarray, common: dict[str, int], pairs: np.ndarray, mu: float) -> None:
        self.mu, self.texts = mu, np.array(texts, np.float64)
        self.predicted = np.array(words, np.float64) + self.texts + types + 1  # add-one over all words and the end
        order = np.argsort(listed)
        self.listed, self.counts = listed[order], counts[order].astype(np.float64)
        self.common = common
        width = COMMON + 2
        place = dict(zip(self.listed.tolist(), range(len(listed)), strict=True))
        unigram = np.zeros((width, 2))
        unigram[END] = self.texts
        for word, number in common.items():
            if (at := place.get(xxhash.xxh3_64_intdigest(word))) is not None:
                unigram[number] = self.counts[at]
        self.pairs = np.log(pairs + mu * self.unigram(unigram)[np.arange(width * width) % width])

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / self.predicted


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """(first row, columns) of runs of at most ``ROWS`` rows and about ``CHARS`` characters; the third column is the text."""
    row, held, size = 0, None, 0
    for b in batches:
        for values in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held is not None and (len(held[0]) == ROWS or size + len(values[2] or "") > CHARS):
                yield row, held
                row, held = row + len(held[0]), None
            if held is None:
                held, size = [[] for _ in values], 0
            for h, v in zip(held, values, strict=True):
                h.append(v)
            size += len(values[2] or "")
    if held:
        yield row, held


def _corpora(target: DataFrame, background: DataFrame) -> DataFrame:
    """(side, id, text, part); side 0: target, 1: background."""
    kind = background.schema["id"].dataType
    both = target.select(F.lit(0).alias("side"), F.lit(None).cast(kind).alias("id"), "text").unionByName(background.select(F.lit(1).alias("side"), "id", "text"))
    return both.withColumn("part", F.spark_partition_id())


def _common_words(target: DataFrame, background: DataFrame, sample: int) -> dict[str, int]:
    """Words that are frequent in a sample of both corpora, numbered after begin and end. They only choose the route of a bigram."""
    some = bounded_sample(target.select("text"), sample).union(bounded_sample(background.select("text"), sample))
    words = some.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).filter("word <> ''").groupBy("word").count()
    return {r.word: i + 2 for i, r in enumerate(words.orderBy(F.desc("count"), "word").limit(COMMON).collect())}


def model_of(target: DataFrame, background: DataFrame, *, mu: float = 100.0, sample: int = 4000, listed: int = LISTED) -> Model:
    """Counts over all texts of both corpora (id, text)."""
    common = _common_words(target, background, sample)
    width = COMMON + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words, pairs, texts = Words(common), np.zeros((width * width, 2), np.int64), np.zeros(2, np.int64)
        many = np.zeros((1 << 16, 2), np.int64)

        def flush() -> dict:
            n = len(words.hashes)
            used = np.flatnonzero(many[:n].any(axis=1))
            return {"kind": np.zeros(len(used), np.int32), "code": words.hashes[used].view(np.int64), "t": many[used, 0], "b": many[used, 1]}

        for _, (sides, _, own, _) in _chunks(batches):
            read = [words.read(t or "") for t in own]
            words.learn()
            while len(words.hashes) > len(many):
                many = np.concatenate([many, np.zeros_like(many)])
            for side in (0, 1):
                mine = [r for r, s in zip(read, sides, strict=True) if s == side]
                if not mine:
                    continue
                texts[side] += len(mine)
                ids = np.concatenate(mine)
                n = np.bincount(ids, minlength=len(words.hashes))
                n[:2] = 0
                many[: len(n), side] += n
                near = words.near[ids]
                at = np.flatnonzero((near[:-1] >= 0) & (near[1:] >= 0) & (ids[1:] != BEGIN))
                pairs[:, side] += np.bincount(near[at] * width + near[at + 1], minlength=width * width)
            if len(words.hashes) > 400_000:
                yield flush()
                words.forget()
                many[:] = 0
        yield flush()
        at = np.flatnonzero(pairs.any(axis=1))
        yield {"kind": np.ones(len(at), np.int32), "code": at, "t": pairs[at, 0], "b": pairs[at, 1]}
        yield {"kind": [2], "code": [0], "t": texts[:1], "b": texts[1:]}

    counted = arrow_map(_corpora(target, background), count, "kind int, code long, t long, b long")
    sums = materialise(counted.groupBy("kind", "code").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "counts")
    level = F.floor(F.log2(F.col("t") + F.col("b")) * 8).cast("int")
    by_kind = sums.groupBy("kind", F.when(F.col("kind") == 0, level).alias("level")).agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b")).collect()  # a few hundred levels
    levels = sorted(((r.level, r.n) for r in by_kind if r.kind == 0), reverse=True)
    reached = np.cumsum([n for _, n in levels])
    least = next((lv for (lv, _), n in zip(reversed(levels), reversed(reached.tolist()), strict=True) if n <= listed), 1 << 20)
    always = [xxhash.xxh3_64_intdigest(w) for w in common]
    always = [x - (1 << 64) if x >> 63 else x for x in always]
    chosen = sums.filter((F.col("kind") == 0) & ((level >= least) | F.col("code").isin(always))).select("code", "t", "b").toArrow()  # at most ``listed`` + COMMON rows
    table = sums.filter("kind = 1").select("code", "t", "b").toArrow()  # at most (COMMON + 2) squared rows
    columns = lambda x: np.stack([x.column(c).to_numpy() for c in ("t", "b")], axis=1)
    pairs = np.zeros((width * width, 2))
    pairs[table.column("code").to_numpy()] = columns(table)
    total = lambda kind: tuple(sum(getattr(r, side) for r in by_kind if r.kind == kind) for side in ("t", "b"))
    drop(background.sparkSession, [path_of(sums)])
    return Model(total(0), total(2), sum(n for _, n in levels), chosen.column("code").to_numpy().view(np.uint64), columns(chosen), common, pairs, mu)


def score(background: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", mu: float = 100.0, bucket_bytes: int = 16 << 20, sample: int = 4000, listed: int = LISTED) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score) for each row of ``background``; losses per token, in nats.

    Tokens are the white-space words in lower case and the end of the text. Both corpora are counted whole, the scored texts
    included. ``sample`` and ``listed`` bound what is broadcast and change no result. Null and empty texts have one token,
    the end. Texts are read whole, however long. Repeated rows, and rows of equal or null key, count, and are scored, each
    by itself; the key keeps its type. Other columns are not read. With an empty target its model is uniform; an empty
    background gives an empty table.
    """
    spark = background.sparkSession
    documents = background.select(F.col(key).alias("id"), F.col(text).alias("text"))
    target = target.select(F.col(text).alias("text"))
    known = model_of(target, documents, mu=mu, sample=sample, listed=listed)
    buckets = max(1, round(float(known.predicted.sum()) * 8 / bucket_bytes))
    model = spark.sparkContext.broadcast(known)
    width = COMMON + 2
    kind = documents.schema["id"].dataType.simpleString()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """To buckets: bigrams, second words, rows and counts; and with ids, what is known of each document of a chunk."""
        m = model.value
        words = Words(m.common, m.listed)
        context = np.zeros((0, 2))
        for first, (sides, keys, own, parts) in _chunks(batches):
            if len(words.hashes) > 300_000:
                words.forget()
                context = np.zeros((0, 2))
            read = [words.read(t or "") for t in own]
            words.learn()
            if len(context) < len(words.at):
                at = words.at[len(context) :]
                new = np.where(at[:, None] >= 0, -np.log(m.counts[at] + mu) if len(m.counts) else 0.0, 0.0)
                context = np.concatenate([context, new])
                context[BEGIN] = -np.log(m.texts + mu)
            sizes = np.fromiter(map(len, read), np.int64, len(read)) - 1
            ids = np.concatenate(read)
            heads = np.cumsum(sizes + 1) - (sizes + 1)
            is_context = np.ones(len(ids), bool)
            is_context[heads + sizes] = False
            at = np.flatnonzero(is_context)
            row = np.repeat(np.arange(len(read)), sizes)
            sums = np.add.reduceat(context[ids[at]], np.cumsum(sizes) - sizes, axis=0)
            pair, which = np.unique(ids[at] * len(words.hashes) + ids[at + 1], return_inverse=True)
            prev, word = pair // len(words.hashes), pair % len(words.hashes)
            scored = np.flatnonzero(np.array(sides, bool))
            number = np.full(len(read), TARGET)
            number[scored] = np.arange(len(scored))
            entry, many = np.unique(number[row] << 40 | which, return_counts=True)
            row, which = entry >> 40, entry & ((1 << 40) - 1)
            near = (words.near[prev] >= 0) & (words.near[word] >= 0)
            mine = np.flatnonzero(near[which] & (row != TARGET))
            odds = m.pairs[words.near[prev[which[mine]]] * width + words.near[word[which[mine]]]]
            sizes, sums = sizes[scored], sums[scored]
            for i in (0, 1):
                sums[:, i] += np.bincount(row[mine], many[mine] * odds[:, i], len(scored))
            is_listed = (words.at[word] >= 0) | (word == END)
            codes = _pair_hash(words.hashes[prev] + (prev == BEGIN), words.hashes[word])
            route = np.where(is_listed, codes, words.hashes[word]) % np.uint64(buckets)
            route = route.astype(np.int64) * 2 + ~is_listed
            base = parts[0] << 36 | first
            left = np.flatnonzero(~near[which])
            left = left[np.argsort(route[which[left]], kind="stable")]
            row, which, many = row[left].astype("<u2"), which[left], many[left]
            used, starts = np.unique(route[which], return_index=True)
            cuts = slices(starts, len(which))
            places = np.where(word == END, len(m.listed), words.at[word]).astype("<u4")
            names = [_packed(words.hashes[word[which[s:e]]]) if u & 1 else places[which[s:e]].tobytes() for u, (s, e) in zip(used.tolist(), cuts, strict=True)]
            none = [None] * len(used)
            yield {"bucket": used, "base": [base] * len(used), "pairs": [_packed(codes[which[s:e]]) for s, e in cuts], "words": names, "rows": [row[s:e].tobytes() for s, e in cuts], "many": [_short(many[s:e]) for s, e in cuts], "id": none, "n": none, "t": none, "b": none}
            if len(scored):
                yield {"bucket": [base % (2 * buckets)], "base": [base], "pairs": [None], "words": [None], "rows": [None], "many": [None], "id": [[keys[i] for i in scored]], "n": [sizes], "t": [sums[:, 0]], "b": [sums[:, 1]]}

    own = f"id array<{kind}>, n array<long>, t array<double>, b array<double>"
    sent = arrow_map(_corpora(target, documents), send, f"bucket int, base long, pairs binary, words binary, rows binary, many binary, {own}")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held = None, []
        for batch in batches:
            for bucket, base, pairs, words, rows, many, *own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own[0] is not None:
                    yield {"base": [base], "rows": [None], "rare_t": [None], "rare_b": [None]} | {name: [x] for name, x in zip(("id", "n", "t", "b"), own, strict=True)}
                    continue
                if bucket != now and held:
                    yield from sums(now & 1, held)
                    held = []
                now = bucket
                held.append((base, _unpacked(pairs), _unpacked(words) if bucket & 1 else np.frombuffer(words, "<u4"), np.frombuffer(rows, "<u2"), _long(many)))
        if held:
            yield from sums(now & 1, held)

    def sums(by_word: int, held: list) -> Iterator[dict]:
        m = model.value
        pairs, words, rows, many = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3, 4))
        message = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        target_row = rows == TARGET
        sides = np.stack([many * target_row, many * ~target_row])
        _, at = np.unique(pairs, return_inverse=True)
        pair_counts = np.stack([np.bincount(at, s) for s in sides], axis=1)
        if by_word:
            _, word = np.unique(words, return_inverse=True)
            counts = np.stack([np.bincount(word, s) for s in sides], axis=1)
            known, less = counts[word], np.log(counts + mu)[word]
        else:
            known, less = np.concatenate([m.counts, m.texts[None]])[words], 0.0
        value = np.log(pair_counts[at] + mu * m.unigram(known)) - less
        mine = np.flatnonzero(~target_row)
        keys, at = np.unique(message[mine] << 16 | rows[mine], return_inverse=True)
        t, b = (np.bincount(at, many[mine] * value[mine, i], len(keys)) for i in (0, 1))
        used, starts = np.unique(keys >> 16, return_index=True)
        cuts = slices(starts, len(keys))
        rows = (keys & 0xFFFF).astype("<u2")
        none = [None] * len(used)
        yield {"base": [held[u][0] for u in used], "rows": [rows[s:e].tobytes() for s, e in cuts], "rare_t": [t[s:e].tobytes() for s, e in cuts], "rare_b": [b[s:e].tobytes() for s, e in cuts], "id": none, "n": none, "t": none, "b": none}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, known, t, b = None, None, np.zeros(ROWS), np.zeros(ROWS)

        def out() -> dict:
            ids, n, own_t, own_b = known
            return {"id": ids, "n": n, "t": np.array(own_t) + t[: len(n)], "b": np.array(own_b) + b[: len(n)]}

        for batch in batches:
            for base, rows, more_t, more_b, *own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if base != now and now is not None:
                    yield out()
                if base != now:
                    now, t[:], b[:] = base, 0, 0
                if rows is None:
                    known = own
                else:
                    at = np.frombuffer(rows, "<u2")
                    t[at] += np.frombuffer(more_t)
                    b[at] += np.frombuffer(more_b)
        if now is not None:
            yield out()

    parts = max(2, min(2 * buckets, 2000))
    met = arrow_map(sent.repartition(parts, "bucket").sortWithinPartitions("bucket"), meet, f"base long, rows binary, rare_t binary, rare_b binary, {own}")
    summed = arrow_map(met.repartition(parts, "base").sortWithinPartitions("base"), gather, f"id {kind}, n long, t double, b double")
    loss = lambda side: F.round(-F.col(side) / F.col("n"), 6)
    scored = summed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), loss("t").alias("loss_target"), loss("b").alias("loss_background"))
    return scored.withColumn("score", F.round(F.col("loss_target") - F.col("loss_background"), 6))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ a >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x + b ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(31)


def _packed(hashes: np.ndarray) -> bytes:
    """48 bits of each hash: enough to tell the millions in a bucket apart."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _short(counts: np.ndarray) -> bytes:
    """Counts as bytes if they fit, else as 4 bytes each after an empty first byte."""
    return counts.astype(np.uint8).tobytes() if not len(counts) or counts.max() < 256 else b"\x00" + counts.astype("<u4").tobytes()


def _long(raw: bytes) -> np.ndarray:
    """Counts are at least 1, so a first byte of 0 marks the wide form."""
    return np.frombuffer(raw[1:], "<u4").astype(np.float64) if raw[:1] == b"\x00" else np.frombuffer(raw, np.uint8).astype(np.float64)
