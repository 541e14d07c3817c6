"""Quality classifier: supervised subword embeddings.

Each token adds the vector of its hashed form and those of its hashed character n-grams, and each two neighbouring tokens
that of their hashed bigram; a document is the average of its vectors; a softmax layer gives the class. Vectors and layer
are trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, bounded_sample, csr_take, texts

BUCKET_BITS = 17
REPEAT = 1 << BUCKET_BITS  # the bigram (w, w), whichever w: a bucket of its own
BUCKETS = REPEAT + 1
GRAMS = (3, 4)  # characters
CACHE = 200_000  # tokens that a Python worker remembers


def _spread(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKET_BITS)


def token_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((crc32(t.encode("utf-8", "replace")) for t in tokens), dtype=np.uint32, count=len(tokens))


def features_of(tokens: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each token and of its character n-grams with its borders, token by token, and how many each has."""
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 2
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(f"<{t}>" for t in tokens).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    buckets = [_spread(hashes)]
    owners = [np.arange(len(tokens))]
    for n in GRAMS:
        many = np.maximum(lengths - n + 1, 0)
        at = csr_take(starts, many)
        h = np.full(len(at), n, dtype=np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + codes[at + i]
        buckets.append(_spread(h))
        owners.append(np.repeat(np.arange(len(tokens)), many))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int32), np.bincount(owner, minlength=len(tokens))


def bigrams_of(hashes: np.ndarray) -> np.ndarray:
    """Hash buckets of neighbouring tokens, from the tokens' hashes in the order of the text; ``REPEAT`` where a token follows itself."""
    return np.where(hashes[:-1] == hashes[1:], REPEAT, _spread(hashes[:-1] * np.uint32(0x9E3779B1) + hashes[1:])).astype(np.int32)


class Embeddings:
    """vectors: one row for each bucket; layer and bias: the softmax over two classes."""

    def __init__(self, dim: int = 8, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
        self.layer = np.zeros((dim, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.hashes = np.zeros(1024, np.uint32)
        self.sums = np.zeros((1024, self.vectors.shape[1] + 1), np.float32)

    def fit(self, examples: list[tuple[int, np.ndarray, np.ndarray]], *, seen: int = 24_000, batch: int = 32, rate: float = 4.0, seed: int = 1) -> None:
        """examples: (class, buckets, their weights, which add up to 1); ``seen``: how many are read in all."""
        epochs = max(1, round(seen / max(1, len(examples))))  # a small sample is read more often
        rng = np.random.default_rng(seed)
        if examples:
            share = (np.bincount([c for c, _, _ in examples], minlength=2) + 1) / (len(examples) + 2)
            self.bias = np.log(share).astype(np.float32)
        steps, done = max(1, epochs * len(examples)), 0
        for _ in range(epochs):
            order = rng.permutation(len(examples))
            for i in range(0, len(order), batch):
                part = [examples[j] for j in order[i : i + batch] if len(examples[j][1])]
                done += batch
                if not part:
                    continue
                step = rate * max(0.05, 1 - done / steps)
                at, weight = np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part])[:, None]
                starts = np.cumsum([0, *(len(p[1]) for p in part[:-1])])
                mean = np.add.reduceat(self.vectors[at] * weight, starts, axis=0)
                p = _softmax(mean @ self.layer + self.bias)
                p[np.arange(len(part)), [c for c, _, _ in part]] -= 1
                back = p @ self.layer.T
                self.layer -= step / len(part) * mean.T @ p
                self.bias -= step / len(part) * p.sum(0) * 0.1
                np.add.at(self.vectors, at, -step * weight * np.repeat(back, [len(x[1]) for x in part], axis=0))

    def learn(self, tokens: list[str]) -> None:
        hashes = token_hashes(tokens)
        found, many = features_of(tokens, hashes)
        first, end = len(self.seen), len(self.seen) + len(tokens)
        while end > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.sums[first:end, :-1] = np.add.reduceat(self.vectors[found], np.cumsum(many) - many, axis=0)
        self.sums[first:end, -1] = many
        self.hashes[first:end] = hashes
        self.seen.update(zip(tokens, range(first, end), strict=True))

    def score(self, text: str) -> float:
        """The probability of class 1; from the bias alone for a text without tokens."""
        words = text.split()
        mean = np.zeros(self.vectors.shape[1], np.float64)
        if words:
            if new := [t for t in dict.fromkeys(words) if t not in self.seen]:
                self.learn(new)
            at = np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words))
            total = self.sums[at].sum(axis=0, dtype=np.float64)
            pairs = self.vectors[bigrams_of(self.hashes[at])].sum(axis=0, dtype=np.float64)
            mean = (total[:-1] + pairs) / (total[-1] + len(words) - 1)
            if len(self.seen) > CACHE:
                self.forget()
        return float(_softmax((mean @ self.layer + self.bias)[None])[0, 1])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(batches: Iterator) -> Iterator[dict]:
    for batch in batches:
        at, weights = [], []
        for text in texts(batch):
            words = text.split()
            number = {t: i for i, t in enumerate(dict.fromkeys(words))}
            w = np.zeros(BUCKETS)
            if words:
                order = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))
                hashes = token_hashes(list(number))
                found, many = features_of(list(number), hashes)
                w += np.bincount(found, np.repeat(np.bincount(order, minlength=len(number)), many), BUCKETS)
                w += np.bincount(bigrams_of(hashes[order]), minlength=BUCKETS)
            used = np.flatnonzero(w)
            at.append(used.astype("<i4").tobytes())
            weights.append((w[used] / max(1, w.sum())).astype("<f4").tobytes())
        yield {"label": batch.column(batch.schema.get_field_index("label")), "at": at, "weights": weights}


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = 4000) -> Embeddings:
    """Fit on a bounded sample: about ``max_docs`` labelled texts.

    Null and other labels than 0 and 1 and null keys are left out, as are keys with labels of both kinds; a key's repeated
    labels count once, its repeated texts each. Without an example the model gives 0.5 to all.
    """
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label in (0, 1)")
    rows = rows.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    chosen = F.broadcast(bounded_sample(rows, max_docs))  # about max_docs rows
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key").select("text", "label")
    got = arrow_map(bounded_sample(found, max_docs), _examples, "label int, at binary, weights binary").collect()  # about max_docs rows
    got.sort(key=lambda r: (r.label, bytes(r["at"])))
    model = Embeddings()
    model.fit([(r.label, np.frombuffer(r["at"], "<i4"), np.frombuffer(r.weights, "<f4")) for r in got])
    return model


def score(docs: DataFrame, model: Embeddings, *, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` (one named ``out`` is replaced) and the probability of class 1, from the whole text.

    A null or empty text gets the probability that the bias alone gives; texts are read whole, however long. Repeated rows
    get equal scores; an empty table gives an empty table.
    """
    docs = docs.drop(out)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.append_column(out, pa.array([known.value.score(t) for t in texts(batch, text)], type=pa.float64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{out}` double")
