"""SimHash near-duplicate detection by anchor-point covering.

The 64 bits are cut into two halves of 32. Fingerprints within the threshold differ, in one of the halves, in no more
than half the threshold. In each half, a covering code (the product of the perfect binary [23,12] code, the perfect
[7,4] code and two plain bits) gives the anchors. A fingerprint has one home anchor, within the covering radius, and is
replicated to each anchor within that radius plus the threshold. At an anchor, its homes are compared with all that came.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import arrow_map, csr_take, ints, local_components, materialise, texts

_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_words = re.compile(rb"[^\x20\x09-\x0D]+").findall


def fingerprint(text: str, *, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``width`` words (repeats count; fewer words make one shingle; none: 0)."""
    words = _words(text.encode("utf-8", "replace").translate(_lower))
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = (ends - lengths)[:n].tolist()
    ends = ends[-n:].tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), dtype="<u8", count=n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the 64-bit hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def rows(batches: Iterator) -> Iterator[dict]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, texts(batch)), dtype=np.uint64, count=batch.num_rows)
            yield {"doc_id": batch.column(0), "fp": fps.view(np.int64)}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), rows, f"doc_id {kind}, fp long")


class _Perfect:
    """A perfect cyclic code: error patterns by syndrome and by how far their weight exceeds the covering radius."""

    def __init__(self, length: int, poly: int, radius: int, beyond: int) -> None:
        self.checks = poly.bit_length() - 1
        self.bits = np.array([self._rest(1 << i, poly) for i in range(length)], dtype=np.int64)
        self.patterns = []
        for over in range(beyond + 1):
            weights = range(radius + 1) if not over else [radius + over]
            found = [sum(1 << i for i in c) for w in weights if w <= length for c in combinations(range(length), w)]
            errors = np.array(found, dtype=np.int64)
            syndromes = self.syndrome(errors)
            order = np.argsort(syndromes, kind="stable")
            many = np.bincount(syndromes, minlength=1 << self.checks)
            self.patterns.append((errors[order], np.cumsum(many) - many, many))

    def _rest(self, x: int, poly: int) -> int:
        while x.bit_length() > self.checks:
            x ^= poly << (x.bit_length() - poly.bit_length())
        return x

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for i, s in enumerate(self.bits):
            out ^= np.where(x >> i & 1, s, 0)
        return out

    def near(self, x: np.ndarray, over: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into x, number of a code word) for the code words that are ``over`` beyond the radius."""
        errors, starts, many = self.patterns[over]
        s = self.syndrome(x)
        return np.repeat(np.arange(len(x)), many[s]), (np.repeat(x, many[s]) ^ errors[csr_take(starts[s], many[s])]) >> self.checks


class AnchorCode:
    """Anchors of 64-bit fingerprints for links of up to ``threshold`` differing bits."""

    ANCHORS = 1 << 19  # 2 halves of 12 + 4 + 2 bits

    def __init__(self, threshold: int) -> None:
        self.beyond = threshold // 2
        self.long = _Perfect(23, 0b101011100011, 3, self.beyond)
        self.short = _Perfect(7, 0b1011, 1, self.beyond)
        self.plain = [np.array([e for e in range(4) if e.bit_count() == w], dtype=np.int64) for w in range(3)]

    def homes(self, fps: np.ndarray) -> np.ndarray:
        """The two home anchors of each fingerprint, one row for each half."""
        return np.stack([self._anchors(half, side, 0, 0, 0)[1] for side, half in enumerate(self._halves(fps))])

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, anchor, whether it is the home) for all anchors within reach."""
        out = [(*self._anchors(half, side, i, j, k), not i + j + k) for side, half in enumerate(self._halves(fps)) for i in range(self.beyond + 1) for j in range(self.beyond + 1 - i) for k in range(min(2, self.beyond - i - j) + 1)]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.concatenate([np.full(len(o[0]), o[2]) for o in out])

    def _halves(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return fps & 0xFFFFFFFF, fps >> 32 & 0xFFFFFFFF

    def _anchors(self, half: np.ndarray, side: int, i: int, j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        row, first = self.long.near(half & 0x7FFFFF, i)
        at, second = self.short.near((half >> 23 & 0x7F)[row], j)
        row, first = row[at], first[at]
        plain = (half >> 30)[row][:, None] ^ self.plain[k][None]
        anchors = (side << 18 | first << 6 | second << 2)[:, None] | plain
        return np.repeat(row, len(self.plain[k])), anchors.ravel()


def links(fps: DataFrame, *, threshold: int = 4, batch: int = 8192, bucket_rows: int = 300_000, homes_at_once: int = 4096, pairs_at_once: int = 1 << 20) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect just what links of up to ``threshold`` bits connect.

    Each anchor's rows meet in one bucket of about ``bucket_rows``. An anchor that is home to more than ``homes_at_once``
    has its homes dealt to several buckets, and all that come to it go to each of these, so that no task compares more than
    that many with the rows of one anchor. A bucket returns a spanning forest of its links, never all pairs.
    """
    spark = fps.sparkSession
    code = spark.sparkContext.broadcast(AnchorCode(threshold))
    n = fps.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-n // batch))
    fps = fps.repartition(parts)

    def home_rows(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            yield {"anchor": code.value.homes(ints(b, "fp")).ravel()}

    crowded = arrow_map(fps, home_rows, "anchor long").groupBy("anchor").count().filter(F.col("count") > homes_at_once).collect()  # at most AnchorCode.ANCHORS rows
    split = np.ones(AnchorCode.ANCHORS, np.int32)
    for r in crowded:
        split[r.anchor] = -(-r["count"] // homes_at_once)
    dealt = spark.sparkContext.broadcast(split)
    per_row = len(AnchorCode(threshold).near(np.zeros(1, np.int64))[0])
    buckets = max(1, -(-n * per_row // bucket_rows))

    def spread(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            whole = ints(b, "fp")
            for i in range(0, len(whole), batch):
                part = whole[i : i + batch]
                row, anchor, home = code.value.near(part)
                many = dealt.value[anchor].astype(np.int64)
                if many.max(initial=1) > 1:
                    at = np.repeat(np.arange(len(row)), many)
                    piece = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    own = (part[row[at]].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many[at]
                    row, anchor, home = row[at], anchor[at] + piece * AnchorCode.ANCHORS, home[at] & (piece == own)
                bucket = (anchor.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                codes, values = (anchor * 2 + np.where(home, 0, 1))[order], part[row][order]
                used, starts = np.unique(bucket[order], return_index=True)
                ends = [*starts[1:].tolist(), len(order)]
                yield {"bucket": used, "codes": [codes[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], "fps": [values[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]}

    def compare(codes: np.ndarray, values: np.ndarray) -> Iterator[dict]:
        order = np.argsort(codes)
        codes, values = codes[order], values[order]
        is_home = codes & 1 == 0
        home_keys, home_values = codes[is_home] >> 1, values[is_home]
        low = np.searchsorted(home_keys, codes >> 1, "left")
        many = np.searchsorted(home_keys, codes >> 1, "right") - low
        done = np.cumsum(many)
        i = 0
        while i < len(codes):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + pairs_at_once, "right")))
            theirs = home_values[csr_take(low[i:j], many[i:j])]
            mine = np.repeat(values[i:j], many[i:j])
            linked = (np.bitwise_count((theirs ^ mine).view(np.uint64)) <= threshold) & (theirs != mine)  # of signed numbers, bits of the absolute value would count
            if linked.any():
                a, b = local_components(theirs[linked], mine[linked])
                yield {"a": a, "b": b}
            i = j

    def meet(batches: Iterator) -> Iterator[dict]:
        now, codes, values = None, [], []
        for b in batches:
            for bucket, c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if bucket != now and codes:
                    yield from compare(np.concatenate(codes), np.concatenate(values))
                    codes, values = [], []
                now = bucket
                codes.append(np.frombuffer(c, np.int64))
                values.append(np.frombuffer(v, np.int64))
        if codes:
            yield from compare(np.concatenate(codes), np.concatenate(values))

    packed = arrow_map(fps, spread, "bucket long, codes binary, fps binary")
    met = packed.repartition(max(parts, min(buckets, 4 * parts)), "bucket").sortWithinPartitions("bucket")
    return arrow_map(met, meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``; the component is the smallest doc_id reachable by links.

    A null or empty text, or one of white space only, has fingerprint 0 and links like any other. Equal fingerprints link.
    Texts are read whole, however long. Repeated rows stay, as do different texts of one id. Ids keep their type; the
    smallest is that of their order. A null doc_id gets its component from the others; alone, null. Other columns are not
    read. Empty tables give an empty table.
    """
    fps = materialise(fingerprints(docs, key=key, text=text), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(links(distinct.select("fp"), threshold=threshold))
    class_of = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = class_of.groupBy("component").agg(F.min("first").alias("component_id"))
    return fps.join(class_of.join(smallest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
