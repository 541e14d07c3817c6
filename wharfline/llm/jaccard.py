"""Near-duplicate classes of texts: SimHash links, completed to all pairs of a Jaccard similarity of 0.8 or more.

Each text is the set of its shingles of five words. First the anchors of ``simhash`` link sets whose fingerprints differ in
few bits: most near copies. Then a set-similarity join with prefix filter finds what they miss. Sets that are alike by 4/5
share one of their n // 5 + 1 first shingles in whatever common order; here rare shingles come first:

1. each text sends a third of its shingles, chosen by hash, to buckets, which tell it those that others have, and how many;
2. a text with enough shingles that no other has needs no candidates; others are posted under the first shared ones;
3. where sets of different components are under one shingle (of shingles with the same sets, one), their parity maps meet
   in a task: a map says of each place in it whether an odd number of shingles has it, so that two maps differ in no more
   places than the sets do in shingles. The task returns a spanning forest of the links that the maps allow, never all pairs;
4. these links are checked by the whole sets. Only where one fails, all sets under its shingle meet and are compared.

Shingles that are frequent in a sample aren't sent and come last; that and the choice by hash only decide the order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import arrow_map, bounded_sample, drop, ints, materialise, path_of, slices, texts
from .simhash import _lower, _words, links, majority

WIDTH = 5
ALIKE = 4, 5  # similarity: at least this fraction
ROW_BITS = 25  # of the map of rows whose sets are compared
SENT = 3  # one shingle in so many is sent
MAP_BITS = 6, 16  # a parity map has at least 2 ** 6 and at most 2 ** 16 places, else twice its set's size
ROWS, CHARS = 2000, 2 << 20  # texts and characters of a chunk
TOLD = 16  # parts of a bucket, by hash, that are counted one after the other
COMMON = 1 << 19  # shingles that are known to be common; others count as rare


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


def shingles(text: str, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles (fewer words make one shingle; none: no shingle)."""
    words = _words(text.encode("utf-8", "replace").translate(_lower))
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _identity(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes(), 7) - (1 << 63)


def _common(docs: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several texts of a sample share, and in how many: they only decide which shingles come first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = _WordHashes()
        for b in batches:
            own = texts(b)
            for i in range(0, len(own), 200):
                found = np.concatenate([np.zeros(0, np.uint64), *[shingles(t, hashes) for t in own[i : i + 200]]])
                used, many = np.unique(found, return_counts=True)
                yield {"token": used.view(np.int64), "many": many}

    some = bounded_sample(docs, sample).select("text")
    counted = arrow_map(some, rows, "token long, many long").groupBy("token").agg(F.sum("many").alias("many")).filter("many > 2")
    table = counted.orderBy(F.desc("many"), "token").limit(COMMON).toArrow()
    token, many = (table.column(c).to_numpy().astype(np.int64) for c in ("token", "many"))
    order = np.argsort(token.view(np.uint64))
    return token.view(np.uint64)[order], many[order]


def _first(n: np.ndarray | int) -> np.ndarray | int:
    """How many first shingles of n hold one that any alike set has."""
    return n * (ALIKE[1] - ALIKE[0]) // ALIKE[1] + 1


def _sent(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(13)) % np.uint64(SENT) == 0


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(key, rows) of rows that come sorted by the first column."""
    now, held = None, []
    for b in batches:
        for key, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """To each chunk: those of its shingles that others have, too, with the logarithm of how many."""
    for _, rows in _by_key(batches):
        chunk, ends = [r[0] for r in rows], np.cumsum([len(r[1]) // 8 for r in rows])
        token, at = np.frombuffer(b"".join([r[1] for r in rows]), np.uint64), np.frombuffer(b"".join([r[2] for r in rows]), "<u2")
        rows.clear()
        many = np.zeros(len(token), np.int32)
        for part in range(TOLD):
            own = np.flatnonzero((token >> np.uint64(32)) % np.uint64(TOLD) == part)
            _, where, often = np.unique(token[own], return_inverse=True, return_counts=True)
            many[own] = often[where]
        keep = np.flatnonzero(many > 1)
        level = np.log2(many[keep]).astype(np.uint8)
        used, starts = np.unique(np.searchsorted(ends, keep, "right"), return_index=True)
        cuts = slices(starts, len(keep))
        token, at = token[keep], at[keep]
        yield {"base": [chunk[u] for u in used], "tokens": [token[s:e].tobytes() for s, e in cuts], "at": [at[s:e].tobytes() for s, e in cuts], "levels": [level[s:e].tobytes() for s, e in cuts], "nodes": [None] * len(used)}


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """(token, node, n): each set under its first shingles, but for those that no other has."""
    for _, rows in _by_key(batches):
        nodes, sizes, sent, more, more_at = next([np.frombuffer(x, kind) for x, kind in zip((r[3], r[0], r[2], r[4], r[1]), (np.int64, np.uint64, np.int64, np.uint64, "<u2"), strict=True)] for r in rows if r[3] is not None)
        sizes = sizes.astype(np.int64)
        told = [r for r in rows if r[3] is None]
        token = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r[0], np.uint64) for r in told]])
        at = np.concatenate([np.zeros(0, "<u2"), *[np.frombuffer(r[1], "<u2") for r in told]]).astype(np.int64)
        level = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(r[2], np.uint8) for r in told]])
        alone = sent - np.bincount(at, minlength=len(nodes))
        order = np.lexsort((token, level, at))
        token, at = token[order], at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, "left")
        keep = place < (_first(sizes) - alone)[at]
        token, at = np.concatenate([token[keep], more]), np.concatenate([at[keep], more_at.astype(np.int64)])
        yield {"token": token.view(np.int64), "node": nodes[at], "n": sizes[at]}


def _parity(tokens: np.ndarray) -> bytes:
    """The parity map of a set: of twice as many places as it has shingles, or up to four times."""
    bits = 1 << max(MAP_BITS[0], min(MAP_BITS[1], (2 * len(tokens)).bit_length()))
    return np.packbits(np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _allowed(nodes: np.ndarray, components: np.ndarray, n: np.ndarray, maps: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest, over components, of the pairs that are alike as far as their maps tell."""
    order = np.lexsort((nodes, n))
    nodes, components, n, maps = nodes[order], components[order], n[order], [np.frombuffer(maps[i], np.uint64) for i in order]
    ends = np.searchsorted(n, n * ALIKE[1] // ALIKE[0], "right")
    width = np.fromiter(map(len, maps), np.int64, len(maps))  # ascends with n
    edges = np.flatnonzero(np.diff(width, prepend=0))
    own = {int(width[s]): (s, np.stack(maps[s:e])) for s, e in slices(edges, len(maps))}
    half = {w // 2: (s, m[:, : w // 2] ^ m[:, w // 2 :]) for w, (s, m) in own.items() if w > 1}
    _, label = np.unique(components, return_inverse=True)
    out: list[tuple[int, int]] = []
    for i in range(len(nodes) - 1):
        w = int(width[i])
        found = []
        for table in (own, half):  # alike sets have maps of one width, or of this and the next
            if w in table:
                start, rows = table[w]
                low, high = max(i + 1, start), min(int(ends[i]), start + len(rows))
                others = np.arange(low, high)
                others = others[label[low:high] != label[i]]
                far = np.bitwise_count(rows[others - start] ^ maps[i]).sum(axis=1, dtype=np.int64)
                found += others[far * (ALIKE[1] + ALIKE[0]) <= (n[others] + n[i]) * (ALIKE[1] - ALIKE[0])].tolist()
        for j in found:
            if label[j] != label[i]:
                out.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return out


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of the maps under one key, links between different components, with the key's shingle."""
    for _, rows in _by_key(batches):
        token, node, component, n, maps = zip(*rows, strict=True)
        found = _allowed(np.array(node), np.array(component), np.array(n), list(maps))
        yield {"token": [token[0]] * len(found), "a": [x for x, _ in found], "b": [x for _, x in found]}


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same * ALIKE[1] >= ALIKE[0] * (len(x) + len(y) - same)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        sets = zip(*[b.column(i).to_pylist() for i in (2, 3)], strict=True)
        yield {"a": b.column(0), "b": b.column(1), "holds": [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sets]}


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of the sets under one key, links between different components that connect what all their links connect."""
    for _, rows in _by_key(batches):
        found = _forest(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows])
        yield {"a": [x for x, _ in found], "b": [x for _, x in found]}


def _forest(nodes: np.ndarray, components: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.lexsort((nodes, n))
    nodes, components, n, sets = nodes[order], components[order], n[order], [sets[i] for i in order]
    ends = np.searchsorted(n, n * ALIKE[1] // ALIKE[0], "right")
    bits = 1 << max(6, min(13, 2 * int(n.max())).bit_length())
    marks = np.stack([np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.uint64) for s in sets])
    _, label = np.unique(components, return_inverse=True)
    out: list[tuple[int, int]] = []
    for i in range(len(nodes) - 1):
        others = np.arange(i + 1, ends[i])
        others = others[label[others] != label[i]]
        far = np.bitwise_count(marks[others] ^ marks[i]).sum(axis=1, dtype=np.int64)
        others = others[far * (ALIKE[1] + ALIKE[0]) <= (n[others] + n[i]) * (ALIKE[1] - ALIKE[0])]
        for j in others.tolist():
            if label[j] != label[i]:
                if _alike(sets[i], sets[j]):
                    out.append((int(nodes[i]), int(nodes[j])))
                    label[label == label[j]] = label[i]
    return out


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = 1 << 13, threshold: int = 4, bucket_bytes: int = 16 << 20, crowd: int = 2048, pass_bytes: int | None = None) -> DataFrame:
    """(doc_id, row, node, component): for each row its id, the hash of id and text, of its set, and the class of that set.

    Classes connect what SimHash links of up to ``threshold`` bits and links of similarity 4/5 or more connect. Texts without
    a word are one set, which links to no other; null texts are such. Very long texts are read whole. Repeated rows stay, ids
    keep their type and may be null or repeated. Other columns are not read. An empty table gives an empty table. Sets are
    told apart, and compared, by 64-bit hashes. More than ``crowd`` sets under one shingle are dealt to blocks, each two of
    which meet in a task of their own. Whole sets meet in passes of about ``pass_bytes`` (None: half the bytes of all texts),
    by shingle, so that no more of them are on disk at once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    common = spark.sparkContext.broadcast(_common(docs, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, round(total * 0.55 / bucket_bytes))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """A row for each text; of the sets of a chunk, the shingles that go to each bucket and, under bucket -1, what the chunk knows."""
        hashes, (known, many) = _WordHashes(), common.value
        seen: set[int] = set()
        count = 0
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                ids, own, rows, parts = (c.slice(i, ROWS).to_pylist() for c in b.columns)
                done = 0
                while done < len(own):
                    node, fps, size, sets, chars, at = [], [], [], [], 0, done
                    while at < len(own) and (at == done or chars + len(own[at]) <= CHARS):
                        tokens = shingles(own[at], hashes)
                        chars += len(own[at])
                        at += 1
                        node.append(_identity(tokens))
                        fps.append(majority(tokens))
                        size.append(len(tokens))
                        if node[-1] not in seen and len(tokens):
                            seen.add(node[-1])
                            sets.append((node[-1], tokens))
                    nothing = {c: [None] * len(node) for c in ("base", "bucket", "tokens", "at", "levels", "nodes", "more", "map")}
                    yield {"doc_id": ids[done:at], "row": rows[done:at], "node": node, "fp": np.array(fps, np.uint64).view(np.int64), "n": size} | nothing
                    if sets:
                        maps = {c: [None] * len(sets) for c in ("doc_id", "row", "node", "fp", "tokens", "at", "levels", "nodes", "more")}
                        yield maps | {"n": [len(t) for _, t in sets], "base": [x for x, _ in sets], "bucket": [-2] * len(sets), "map": [_parity(t) for _, t in sets]}
                        yield from messages(sets, parts[done] << 36 | count, known, many)
                    count += at - done
                    if len(seen) > 500_000:
                        seen.clear()
                    done = at

    def messages(sets: list[tuple[int, np.ndarray]], base: int, known: np.ndarray, many: np.ndarray) -> Iterator[dict]:
        sizes = np.array([len(t) for _, t in sets])
        token, at = np.concatenate([t for _, t in sets]), np.repeat(np.arange(len(sets)), sizes)
        place = np.searchsorted(known, token)
        place[place == len(known)] = 0
        often = np.where(known[place] == token, many[place], 0) if len(known) else np.zeros(len(token), np.int64)
        goes = _sent(token) & (often == 0)
        sent = np.bincount(at[goes], minlength=len(sets))
        lack = _first(sizes) - sent
        rest = np.flatnonzero(~goes & (lack > 0)[at])
        rest = rest[np.lexsort((token[rest], often[rest], at[rest]))]
        rest = rest[np.arange(len(rest)) - np.searchsorted(at[rest], at[rest], "left") < lack[at[rest]]]
        own = {"base": base, "bucket": -1, "tokens": sizes.astype(np.uint64).tobytes(), "at": at[rest].astype("<u2").tobytes(), "levels": sent.astype(np.int64).tobytes(), "nodes": np.array([x for x, _ in sets], np.int64).tobytes(), "more": token[rest].tobytes()}
        nothing = {c: [None] for c in ("doc_id", "row", "node", "fp", "n", "map")}
        yield nothing | {c: [x] for c, x in own.items()}
        token, at = token[goes], at[goes]
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        used, starts = np.unique(bucket[order], return_index=True)
        cuts, n = slices(starts, len(order)), len(used)
        token, at = token[order], at[order].astype("<u2")
        yield {c: [None] * n for c in ("doc_id", "row", "node", "fp", "n", "levels", "nodes", "more", "map")} | {"base": [base] * n, "bucket": used, "tokens": [token[s:e].tobytes() for s, e in cuts], "at": [at[s:e].tobytes() for s, e in cuts]}

    rows = docs.select("doc_id", "text", "row", F.spark_partition_id().alias("part"))
    out = materialise(arrow_map(rows, sketch, f"doc_id {kind}, row long, node long, fp long, n long, base long, bucket long, tokens binary, at binary, levels binary, nodes binary, more binary, map binary"), "sketches")
    sketches = materialise(out.filter("node is not null").select("doc_id", "row", "node", "fp", "n"), "texts")

    maps = materialise(out.filter("bucket = -2").select(F.col("base").alias("node"), "n", "map").dropDuplicates(["node"]), "maps")

    parts = max(2, buckets)
    sent = out.filter("bucket >= 0").select("bucket", "base", "tokens", "at").repartition(parts, "bucket").sortWithinPartitions("bucket")
    told = arrow_map(sent, _tell, "base long, tokens binary, at binary, levels binary, nodes binary").withColumn("more", F.lit(None).cast("binary"))
    chunks = out.filter("bucket = -1").select("base", "tokens", "at", "levels", "nodes", "more")
    postings = arrow_map(told.union(chunks).repartition(parts, "base").sortWithinPartitions("base"), _post, "token long, node long, n long").distinct()
    shared = materialise(postings.join(postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token"), "token", "left_semi"), "postings")
    drop(spark, [path_of(out)])

    first = sketches.filter("n > 0").groupBy("node").agg(F.min("row").alias("row"), F.min("fp").alias("fp"))
    by_print = first.groupBy("fp").agg(F.min("node").alias("node"))
    pairs = links(by_print.select("fp"), threshold=threshold)
    near = pairs.join(by_print.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(by_print.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = first.join(by_print.select("fp", F.col("node").alias("a")).hint("merge"), "fp").filter("node <> a").select("a", F.col("node").alias("b"))
    near = materialise(near.union(same), "fingerprint-links")
    joined = components(near)

    known = shared.join(joined.hint("merge"), "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("component"))
    known = materialise(known, "postings-by-component")
    alike_sets = F.count("*").alias("many"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("y")
    open_ = known.groupBy("token").agg(*alike_sets, F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    open_ = open_.groupBy("many", "x", "y").agg(F.min("token").alias("token")).select("token", "many")  # shingles with the same sets: one of them
    members = materialise(known.join(open_.hint("merge"), "token").select("token", "many", "node", "component"), "members")

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        """Rows under keys for tasks: one for each shingle, or for each two of its blocks."""
        k = F.ceil(F.col("many") / crowd)
        block = F.pmod(F.xxhash64("node"), k)
        tasks = F.transform(F.sequence(F.lit(0), k - 1), lambda x: F.xxhash64("token", F.least(x, block), F.greatest(x, block)))
        return rows.select(F.explode(tasks).alias("key"), *columns).repartition("key").sortWithinPartitions("key")

    with_maps = members.join(maps.hint("merge"), "node")
    proposed = materialise(arrow_map(dealt(with_maps, "token", "node", "component", "n", "map"), _propose, "token long, a long, b long"), "proposed-links")
    checked = _checked(docs, first, proposed.select("a", "b").distinct())
    drop(spark, [path_of(shared), path_of(known), path_of(maps)])
    good = checked.filter("holds").select("a", "b")
    failed = proposed.join(checked.filter("not holds").hint("merge"), ["a", "b"], "left_semi").select("token").distinct()
    if not good.isEmpty():
        near = materialise(near.union(good), "all-links")
        joined = components(near)
    if not failed.isEmpty():  # under these shingles, what the failed links stood for is still to be found
        left = members.select("token", "many", "node").join(failed.hint("merge"), "token", "left_semi").join(joined.hint("merge"), "node", "left").select("token", "many", "node", F.coalesce("component", "node").alias("component"))
        open_ = left.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
        left = materialise(left.join(open_.hint("merge"), "token", "left_semi"), "members-left")
        whole = _sets(docs, first.join(left.select("node").distinct().hint("merge"), "node", "left_semi"))
        sizes = whole.select("node", F.octet_length("tokens").alias("bytes"))
        sent = left.join(sizes.hint("merge"), "node").agg(F.sum(F.col("bytes") * F.ceil(F.col("many") / crowd))).first()[0] or 0
        passes = max(1, math.ceil(sent / (pass_bytes or max(bucket_bytes, total // 2))))
        alike = near.limit(0)
        for i in range(passes):
            some = left.filter(F.pmod(F.xxhash64("token"), F.lit(passes)) == i).join(whole.hint("merge"), "node")
            alike = alike.union(materialise(arrow_map(dealt(some, "node", "component", "tokens"), _meet, "a long, b long").distinct(), "links"))
        drop(spark, [path_of(left), path_of(whole)])
        if not alike.isEmpty():
            joined = components(near.union(alike))
    drop(spark, [path_of(members), path_of(proposed), path_of(checked)])
    return sketches.join(joined.hint("merge"), "node", "left").select("doc_id", "row", "node", F.coalesce("component", "node").alias("component"))


def _checked(docs: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with whether their whole sets are alike."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    whole = _sets(docs, first.join(nodes.hint("merge"), "node", "left_semi"))
    side = lambda c: whole.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "a_tokens", "b_tokens")
    checked = materialise(arrow_map(both, _check, "a long, b long, holds boolean"), "checked-links")
    drop(docs.sparkSession, [path_of(whole)])
    return checked


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens): sets of the wanted rows (node, row), read again. A map of a bounded number of bits says which texts may be wanted."""
    rows = wanted.select(F.shiftrightunsigned("row", 64 - ROW_BITS).alias("bit"))
    held = np.zeros(1 << ROW_BITS - 3, np.uint8)
    for r in rows.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits")).collect():  # at most 2 ** (ROW_BITS - 15) rows
        held[r.part << 12 : r.part + 1 << 12] = np.frombuffer(bytes(r.bits), np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, held, seen = _WordHashes(), sent.value, set()
        for b in batches:
            at = (ints(b, "row").view(np.uint64) >> np.uint64(64 - ROW_BITS)).astype(np.int64)
            chosen = np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            row = ints(b, "row")
            chosen = np.array([i for i in chosen.tolist() if not (row[i] in seen or seen.add(row[i]))], np.int64)
            for i in range(0, len(chosen), 500):
                found = [shingles(t, hashes) for t in texts(b.take(pa.array(chosen[i : i + 500])))]
                yield {"node": [_identity(t) for t in found], "tokens": [t.tobytes() for t in found]}

    whole = arrow_map(docs.select("row", "text"), read, "node long, tokens binary").join(wanted.select("node").hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens"))
    return materialise(whole, "sets")
