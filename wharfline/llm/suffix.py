"""Removal of repeated byte strings with longest-previous-factor arrays over partitioned suffix arrays.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id. Two equal strings
of that length have the same minimiser (the smallest hash of their ``gram``-byte substrings), so:

1. each text sends its distinct minimisers to hash buckets, which tell those that several texts share; those that texts of
   a sample share are known to be and aren't sent;
2. each text is cut into the runs of string starts that have one shared minimiser;
3. the snippets of a minimiser meet in one task, where equal ones count once, with their smallest document; it sorts their
   suffixes and finds, from the previous and the next smaller document in suffix order, each suffix's longest factor of an
   earlier document;
4. the starts found go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import arrow_map, bounded_sample, csr_take, materialise, numbered, slices

_BASE = 0x100000001B3
RUN = 4096  # string starts in a snippet at most


def gram_hashes(text: bytes, gram: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``gram`` bytes, by doubling."""
    part = np.frombuffer(text, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    whole, done, size = None, 0, 1
    while True:
        power = np.uint64(pow(_BASE, size, 1 << 64))
        if gram & size:
            if whole is None:
                whole = part
            else:
                n = len(text) - done - size + 1
                whole = whole[:n] * power + part[done : done + n]
            done += size
        size *= 2
        if size > gram:
            break
        half = size // 2
        power = np.uint64(pow(_BASE, half, 1 << 64))
        part = part[: len(part) - half] * power + part[half:]
    whole = (whole ^ whole >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return whole ^ whole >> np.uint64(29)


def minimisers(text: bytes, length: int, gram: int) -> np.ndarray:
    """For each start of a string of ``length`` bytes, its smallest gram hash."""
    if len(text) < length:
        return np.zeros(0, np.uint64)
    low, width, size = gram_hashes(text, gram), length - gram + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[: len(low) - (width - size)], low[width - size :]) if size < width else low


def _text_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def previous_factors(suffixes: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Longest-previous-factor array, capped at ``length``: suffixes is a matrix of each suffix's first ``length`` bytes, docs their documents.

    For each suffix, the longest prefix that it shares with a suffix of a smaller document. That is the better of the
    previous and the next suffix of a smaller document in suffix order, found by pointer jumping over the sorted suffixes.
    """
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{length}").ravel(), kind="stable")
    rows, rank = suffixes[order], docs[order]
    differs = rows[1:] != rows[:-1]
    lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    out = np.zeros(len(order), np.int64)
    for flip in (False, True):
        r, common = (rank[::-1], lcp[::-1]) if flip else (rank, lcp)
        at = np.arange(len(r)) - 1  # candidate for the previous smaller
        best = np.concatenate([[0], common])
        open_ = np.flatnonzero((at >= 0) & (best > 0))
        while len(open_):
            open_ = open_[r[at[open_]] >= r[open_]]
            to = at[open_]
            best[open_] = np.minimum(best[open_], best[to])  # both read before this round's writes count
            at[open_] = at[to]
            open_ = open_[(at[open_] >= 0) & (best[open_] > 0)]  # nothing in common stays nothing
        best[at < 0] = 0
        out = np.maximum(out, best[::-1] if flip else best)
    back = np.empty_like(out)
    back[order] = out
    return back


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


def common_minimisers(docs: DataFrame, length: int, gram: int, sample: int, most: int = 1 << 18) -> np.ndarray:
    """Minimisers that several texts of a sample have, the most frequent ones, in order: these would crowd a bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            low, tk = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for text in b.column(0).to_pylist():
                low.append(np.unique(minimisers(text or b"", length, gram)))
                tk.append(np.full(len(low[-1]), _text_key(text or b""), np.uint64))
            yield {"low": np.concatenate(low).view(np.int64), "tk": np.concatenate(tk).view(np.int64)}

    found = arrow_map(bounded_sample(docs.select("text"), sample), rows, "low long, tk long")
    shared = found.groupBy("low").agg(F.min("tk").alias("a"), F.max("tk").alias("z"), F.count("*").alias("n")).filter("a <> z")
    top = shared.orderBy(F.desc("n"), "low").limit(most).select("low").toArrow()
    return np.sort(top.column("low").to_numpy().view(np.uint64))


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def shared_minimisers(docs: DataFrame, total_bytes: int, length: int, gram: int, bucket_bytes: int, common) -> tuple[DataFrame, int]:  # noqa: ANN001
    """(tk, codes): for each text key, the codes (bucket, hash) of its minimisers that other texts have, too, but for the common ones."""
    buckets = max(1, -(-total_bytes // bucket_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            hashes, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for text in b.column(0).to_pylist():
                low = minimisers(text or b"", length, gram)
                if len(low):
                    own = np.unique(low[np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))])
                    own = own[~_is_in(own, common.value)]
                    hashes.append(own)
                    keys.append(np.full(len(own), _text_key(text), np.uint64))
            h, k = np.concatenate(hashes), np.concatenate(keys)
            bucket = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            used, starts = np.unique(bucket[order], return_index=True)
            cuts = slices(starts, len(order))
            h, k = (h >> np.uint64(32)).astype(np.uint32)[order], k[order]
            yield {"bucket": used, "hashes": [h[s:e].tobytes() for s, e in cuts], "tks": [k[s:e].tobytes() for s, e in cuts]}

    def blobs(batches: Iterator[pa.RecordBatch], kinds: tuple) -> Iterator[tuple]:
        now, found = None, []
        for b in batches:
            for bucket, *columns in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if bucket != now and found:
                    yield now, [np.concatenate(x) for x in zip(*found, strict=True)]
                    found = []
                now = bucket
                found.append([np.frombuffer(c, kind) for c, kind in zip(columns, kinds, strict=True)])
        if found:
            yield now, [np.concatenate(x) for x in zip(*found, strict=True)]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for bucket, (h, k) in blobs(batches, (np.uint32, np.uint64)):
            order = np.argsort(h)
            h, k = h[order], k[order]
            starts = np.flatnonzero(np.concatenate([[len(h) > 0], h[1:] != h[:-1]]))
            if not len(starts):
                continue
            several = np.minimum.reduceat(k, starts) != np.maximum.reduceat(k, starts)
            keep = np.repeat(several, np.diff(np.append(starts, len(h))))
            h, k = h[keep], k[keep]
            to = (k % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            used, starts = np.unique(to[order], return_index=True)
            cuts = slices(starts, len(order))
            codes, k = (np.uint64(bucket) << np.uint64(32) | h.astype(np.uint64))[order], k[order]
            yield {"bucket": used, "codes": [codes[s:e].tobytes() for s, e in cuts], "tks": [k[s:e].tobytes() for s, e in cuts]}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, (codes, k) in blobs(batches, (np.uint64, np.uint64)):
            order = np.lexsort((codes, k))
            codes, k = codes[order], k[order]
            starts = np.flatnonzero(np.concatenate([[True] * (len(k) > 0), k[1:] != k[:-1]]))
            cuts = slices(starts, len(k))
            yield {"tk": k[starts].view(np.int64), "codes": [np.unique(codes[s:e]).tobytes() for s, e in cuts]}

    parts = max(2, min(buckets, 2000))
    sent = arrow_map(docs.select("text"), send, "bucket int, hashes binary, tks binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    told = arrow_map(sent, tell, "bucket int, codes binary, tks binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return arrow_map(told, gather, "tk long, codes binary"), buckets


def find_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 50, gram: int = 20, bucket_bytes: int = 8 << 20, crowd: int = 50_000, carry: Sequence[str] = (), whole_characters: bool = False, sample: int = 1 << 13) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept[, carried]): one row for each row of ``docs``; kept: what remains, as bytes.

    carry: columns of ``docs`` that come back as the struct ``carried``, without a join. whole_characters: a character of
    which a byte goes is left out of ``kept`` as a whole; the other columns are not touched by this.

    Null texts count as empty; texts under ``length`` bytes keep all; texts are read whole, however long. Rows of equal id
    and text get equal results and don't remove each other, nor do rows of equal id. A row with a null id keeps all and
    removes nothing. Ids may be of any type that has an order. Other columns than those carried are not read. Empty tables
    give an empty table. A text that a smaller id has, too, goes whole without entering the search. Minimisers with more
    than ``crowd`` snippets are searched string by string with grouped minima instead of in one task.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        number = "number"
        while number in docs.columns:
            number += "_"
        found = find_repeats(numbered(docs, key, number), key=number, text=text, length=length, gram=gram, bucket_bytes=bucket_bytes, crowd=crowd, carry=[key, *(c for c in carry if c != key)], whole_characters=whole_characters, sample=sample)
        found = found.select(F.col(f"carried.`{key}`").alias("doc_id"), *[c for c in found.columns if c not in ("doc_id", "carried")], *([F.struct(*[F.col(f"carried.`{c}`") for c in carry]).alias("carried")] if carry else []))
        return found
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            own = b.column(1).to_pylist()
            yield {"doc_id": b.column(0), "tk": np.fromiter(map(_text_key, own), dtype=np.uint64, count=len(own)).view(np.int64), "digest": [hashlib.md5(t).digest() for t in own], "size": np.fromiter(map(len, own), dtype=np.int64, count=len(own))}

    keys = materialise(arrow_map(rows, describe, "doc_id long, tk long, digest binary, size long"), "text-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    common = docs.sparkSession.sparkContext.broadcast(common_minimisers(rows, length, gram, sample))
    found, buckets = shared_minimisers(rows, total, length, gram, bucket_bytes, common)
    found = materialise(found, "shared-minimisers")
    firsts = keys.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("tk").alias("tk"))
    firsts = firsts.join(found, "tk", "left").select("doc_id", F.col("tk").alias("first_tk"), F.coalesce("codes", F.lit(b"")).alias("codes"))
    inner = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry) or "none: int"
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), carried.alias("carried"))
    hashed = arrow_map(whole, _with_key, f"doc_id long, tk long, n_bytes long, packed binary, carried struct<{inner}>")
    paired = hashed.join(firsts, (hashed["doc_id"] == firsts["doc_id"]) & (hashed["tk"] == firsts["first_tk"]), "left").select(hashed["doc_id"], "tk", "n_bytes", "packed", "carried", "codes")
    copy = F.col("codes").isNull() & F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length)
    nothing = F.lit(zstandard.ZstdCompressor(level=1).compress(b""))
    useful = F.when(F.col("n_bytes") >= length, F.col("codes"))
    sifted = materialise(paired.select("doc_id", "tk", "n_bytes", copy.alias("copy"), F.when(copy, nothing).otherwise(F.col("packed")).alias("packed"), "carried", useful.alias("codes")), "sifted-texts")

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for doc, tk, packed, codes in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own, shared = unpack(packed), np.frombuffer(codes, np.uint64)
                low = minimisers(own, length, gram)
                code = (low % np.uint64(buckets)) << np.uint64(32) | low >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                many = np.diff(np.append(starts, len(low)))
                hit = _is_in(code[starts], shared) | _is_in(low[starts], common.value)
                starts, many = starts[hit], many[hit]
                pieces = -(-many // RUN)
                offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
                first = np.repeat(starts, pieces) + offset
                count = np.minimum(np.repeat(many, pieces) - offset, RUN)
                cut = [own[s : s + n + length - 1] for s, n in zip(first.tolist(), count.tolist(), strict=True)]
                yield {"doc_id": [doc] * len(cut), "tk": [tk] * len(cut), "start": first, "low": low[first].view(np.int64), "snippet": cut}

    pieces = materialise(arrow_map(sifted.filter("codes is not null").select("doc_id", "tk", "packed", "codes"), _batched(snippets), "doc_id long, tk long, start long, low long, snippet binary"), "snippets")
    crowded = pieces.groupBy("low").count().filter(F.col("count") > crowd).select("low")
    ranges = None
    if not crowded.isEmpty():
        many = pieces.join(crowded, "low", "left_semi").select("doc_id", "tk", "start", "snippet", F.explode(F.sequence(F.lit(0), F.length("snippet") - length)).alias("s"))
        strings = many.select("doc_id", "tk", (F.col("start") + F.col("s")).alias("start"), F.substring(F.col("snippet"), F.col("s") + 1, F.lit(length)).alias("string"))
        least = strings.groupBy("string").agg(F.min("doc_id").alias("least"))
        ranges = strings.join(least, "string").filter("least < doc_id").select("doc_id", "tk", "start", F.lit(1).cast("long").alias("n"))
        pieces = pieces.join(crowded, "low", "left_anti")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for group in _groups(batches, 100_000):
            yield from _repeated(*group, length)

    in_order = pieces.select("low", "doc_id", "tk", "start", "snippet").repartition("low").sortWithinPartitions("low")
    found = arrow_map(in_order, search, "doc_id long, tk long, start long, n long")
    ranges = (found if ranges is None else found.union(ranges)).groupBy("doc_id", "tk").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    full = sifted.drop("codes").join(ranges, ["doc_id", "tk"], "left").select("doc_id", "n_bytes", "copy", "packed", "starts", "counts", "carried")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for doc, size, copy, packed, starts, counts, other in zip(*[c.to_pylist() for c in b.columns], strict=True):
                own, gone, spans = unpack(packed), size if copy else 0, int(copy)
                if starts:
                    depth = np.zeros(size + 1, np.int64)
                    np.add.at(depth, starts, 1)
                    np.add.at(depth, np.array(starts) + np.array(counts) + length - 1, -1)
                    cover = np.cumsum(depth)[:size] > 0
                    gone, spans = int(cover.sum()), len(_runs(cover)[0])
                    raw = np.frombuffer(own, np.uint8)
                    own = raw[~cover].tobytes()
                digest = hashlib.sha256(own).hexdigest()
                if starts and whole_characters:
                    character = np.cumsum(raw & 0xC0 != 0x80)
                    own = raw[np.bincount(character, cover)[character] == 0].tobytes()
                yield {"doc_id": [doc], "n_bytes": [size], "n_removed": [gone], "n_spans": [spans], "kept_sha256": [digest], "kept": [own], "carried": [other]}

    out = arrow_map(full, _batched(remove), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, carried struct<{inner}>")
    return out if carry else out.drop("carried")


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        own = b.column(1).to_pylist()
        yield {"doc_id": b.column(0), "tk": np.fromiter(map(_text_key, own), dtype=np.uint64, count=len(own)).view(np.int64), "n_bytes": np.fromiter(map(len, own), dtype=np.int64, count=len(own)), "packed": list(map(pack, own)), "carried": b.column(2)}


def _batched(rows, most: int = 16 << 20):  # noqa: ANN001, ANN202
    """The same rows in larger batches of about ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, list] = {}
        size = 0
        for row in rows(batches):
            for name, values in row.items():
                held.setdefault(name, []).extend(values.tolist() if isinstance(values, np.ndarray) else values)
                last = row[name]
                size += sum(map(len, last)) + 8 * len(last) if len(last) and isinstance(last[0], bytes) else 8 * len(last)
            if size > most:
                yield held
                held, size = {}, 0
        if held:
            yield held

    return run


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Whole groups of equal ``low`` (the first column), several at a time while they have under ``most`` rows."""
    held: list[list] = [[], [], [], [], []]
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for h, c in zip(held, columns, strict=True):
            h.extend(c)
        if len(held[0]) >= most // 10:
            end = len(held[0])
            while end and held[0][end - 1] == held[0][-1]:
                end -= 1
            if end:
                yield tuple(h[:end] for h in held)
                held = [h[end:] for h in held]
    if held[0]:
        yield tuple(held)


def _repeated(low: list[int], docs: list[int], tks: list[int], starts: list[int], own: list[bytes], length: int) -> Iterator[dict]:
    """Ranges (doc_id, tk, start, n) of string starts that an earlier document has; rows in order of ``low``, its groups whole."""
    number: dict[bytes, int] = {}
    at = np.fromiter((number.setdefault(x, len(number)) for x in own), dtype=np.int64, count=len(own))  # equal snippets have equal minimisers
    doc, tk, start = np.array(docs, np.int64), np.array(tks, np.int64), np.array(starts, np.int64)
    first = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(first, at, doc)
    sizes = np.fromiter(map(len, number), dtype=np.int64, count=len(number)) - (length - 1)
    later = doc > first[at]
    yield {"doc_id": doc[later], "tk": tk[later], "start": start[later], "n": sizes[at[later]]}
    lows = np.zeros(len(number), np.int64)
    lows[at] = np.array(low, np.int64)  # the snippets are numbered in order of low
    edges = np.flatnonzero(np.concatenate([[True], lows[1:] != lows[:-1]]))
    several = np.repeat(np.diff(np.append(edges, len(lows))) > 1, np.diff(np.append(edges, len(lows))))
    snippets = list(number)
    some = np.flatnonzero(several)
    if not len(some):
        return
    mine = np.flatnonzero(~later & several[at])
    mine = mine[np.argsort(at[mine], kind="stable")]
    many = np.bincount(at[mine], minlength=len(number))
    begin = np.cumsum(many) - many
    for found in _factors(lows[some].tolist(), some.tolist(), first[some].tolist(), [snippets[i] for i in some], length):
        rows = mine[csr_take(begin[found["sid"]], many[found["sid"]])]
        repeat = np.repeat(np.arange(len(found["sid"])), many[found["sid"]])
        yield {"doc_id": doc[rows], "tk": tk[rows], "start": start[rows] + found["s"][repeat], "n": found["n"][repeat]}


def _factors(low: list[int], sids: list[int], firsts: list[int], own: list[bytes], length: int, at_once: int = 1 << 18) -> Iterator[dict]:
    """Runs (s, n) of string starts in each snippet that an earlier document has; ``low`` is in order."""
    sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) - (length - 1)
    group = np.cumsum(np.concatenate([[0], np.diff(np.array(low, np.int64)) != 0]))
    done, i = np.cumsum(sizes), 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + at_once, "right")))
        j = int(np.searchsorted(group, group[j - 1], "right"))  # groups stay whole
        text = np.frombuffer(b"".join(own[i:j]), np.uint8)
        many = sizes[i:j]
        begin = np.cumsum(many + length - 1) - (many + length - 1)
        at = csr_take(begin, many)
        owner = np.repeat(np.arange(j - i), many)
        suffixes = np.lib.stride_tricks.sliding_window_view(text, length)[at]
        earlier = previous_factors(suffixes, np.array(firsts[i:j], np.int64)[owner], length) >= length
        edge = np.diff(np.concatenate([[0], earlier.astype(np.int8)])) == 1
        new = earlier & (edge | np.concatenate([[True], owner[1:] != owner[:-1]]))
        starts = np.flatnonzero(new)
        run = np.cumsum(new)[earlier] - 1
        inside = at - np.repeat(begin, many)
        if len(starts):
            yield {"sid": np.array(sids[i:j], np.int64)[owner[starts]], "s": inside[starts], "n": np.bincount(run)}
        i = j
