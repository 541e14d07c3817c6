"""Mixture-controlled packing of tokenised documents into windows.

Each source is a queue of its documents' tokens. Windows are filled by deficit round-robin: a source's credit grows by its
share of every window, whole tokens are granted at once and those left go to the sources whose next token is due first;
what a source is owed, or owes, is carried to the next window. After a cycle of windows all credits are zero, so the grants
of a cycle are a small table, and every task can tell, from a document's place in its queue, which windows its tokens fill.

A source that is due less than ``1 / SMALL`` of a window is served by whole documents, in turn with all others of its kind:
they are one queue, in the order in which each document is due by its own source's share. So there are at most ``SMALL``
queues, however many sources there are, and every source keeps its share, a small one up to a document.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, csr_take, ints, materialise, slices

SMALL = 256  # a source due less than this fraction of a window is served by whole documents
CYCLE = 1024  # windows in a cycle at most
WORDS = 400_000  # words that a task remembers
LEARN = 1 << 16  # words encoded at once
CHUNK = 2 << 20  # bytes of text encoded at once, and what the last text has beyond that

# The normalizer, the split and the spelling of bytes of the tokenizers that WordEncoder takes word by word.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}

LETTERS = "a-zß-öø-ÿ"  # small Latin letters, each a single character in every normal form C
ODD_SPACE = "[\x1c-\x1f]"  # white space for Python and Arrow only
BEYOND_LATIN = "[^\x00-\x7fÀ-ÖØ-öø-ÿ]"
AFTER_LETTER = f"([{LETTERS}])([!-&(-@\\[-`{{-~])"  # what always begins a new part; an apostrophe may go on with letters


def goes_by_words(path: str) -> bool:
    """Whether the tokenizer drops white space, knows no case and marks word ends, so that words can be encoded by themselves."""
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    first, *more = (stated.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = (first.get("pattern") or {}).get("Regex") == SPLIT and first.get("behavior") == "Removed" and first.get("invert") is True
    split = split and [{k: m.get(k) for k in BYTES} for m in more] == [BYTES]
    added = all(re.fullmatch(r"<\S+>", t["content"]) for t in stated.get("added_tokens") or [])  # never part of a run of letters
    return split and added and (stated.get("normalizer") or {}).get("normalizers") == NORMALIZERS and stated["model"].get("end_of_word_suffix") == "</w>"


def _column(texts: pa.Array | list[str]) -> pa.Array:
    """The texts with wide offsets; null counts as empty."""
    column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    return column.fill_null("")


class WholeEncoder:
    """Ids of whole texts, of any tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def forget(self) -> None:
        """Nothing is remembered."""

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(_column(texts).to_pylist(), add_special_tokens=False)]


class WordEncoder:
    """Ids of a tokenizer that ``goes_by_words``, remembered by word; equal to encoding the whole text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = str.maketrans({c: spell(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()})
        added = [f"(?i:{re.escape(t.content)})" for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_it_is = "|".join([BEYOND_LATIN, *added])
        self.forget()

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.lengths = self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, words: pa.Array) -> None:
        """Encode new words: those of small Latin letters by the model alone, as nothing else changes them, others by the whole tokenizer."""
        plain = pc.match_substring_regex(words, f"^[{LETTERS}]+$")
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(w if w.isascii() else w.translate(self.spelling))] for w in words.filter(plain).to_pylist()]
        found += [e.ids for e in self.tokenizer.encode_batch_fast(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        n = np.fromiter(map(len, found), np.int64, len(found))
        lengths, starts = np.empty_like(n), np.empty_like(n)
        lengths[order], starts[order] = n, len(self.ids) + np.cumsum(n) - n
        self.lengths, self.starts = np.concatenate([self.lengths, lengths]), np.concatenate([self.starts, starts])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(n.sum()))])

    def _split(self, texts: pa.Array) -> pa.Array:
        """Words at white space. Plain Latin text is put in lower case, as the tokenizer would, and split where letters end; text that an added token may be in is not."""
        lower = pc.replace_substring_regex(pc.utf8_lower(texts), AFTER_LETTER, r"\1 \2")
        return pc.utf8_split_whitespace(pc.if_else(pc.match_substring_regex(texts, self.as_it_is), texts, lower))

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        if not len(texts):
            return []
        if len(self.words) > WORDS:
            self.forget()
        column = _column(texts)
        odd = pc.match_substring_regex(column, ODD_SPACE)
        split = self._split(pc.if_else(odd, "", column))
        found = pa.chunked_array([self.words, split.values]).dictionary_encode()  # words known are numbered first, as before
        found = found.chunk(found.num_chunks - 1)
        known, self.words = len(self.words), found.dictionary
        for i in range(known, len(self.words), LEARN):
            self._learn(self.words.slice(i, LEARN))
        numbers = found.indices.to_numpy()
        lengths = self.lengths[numbers]
        ids = self.ids[csr_take(self.starts[numbers], lengths)]
        cuts = np.concatenate([[0], np.cumsum(lengths)])[split.offsets.to_numpy()]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


_encoders: dict[str, WordEncoder | WholeEncoder] = {}  # one for each Python worker; its words go with the task


def _encoder(path: str) -> WordEncoder | WholeEncoder:
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread; others would keep memory of their own
        _encoders[path] = (WordEncoder if goes_by_words(path) else WholeEncoder)(path)
    return _encoders[path]


@dataclass
class Phase:
    """Windows first_window, ... in which the same queues run. before: tokens each queue has given earlier; share: by cycle."""

    first_window: int
    queues: list[int]
    before: np.ndarray
    given: np.ndarray
    share: np.ndarray
    granted: np.ndarray  # (cycle + 1, queues): by window of the cycle, cumulative
    offsets: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        grants = np.diff(self.granted, axis=0)
        self.offsets = np.cumsum(grants, axis=1) - grants


def cycle_grants(share: np.ndarray, cycle: int, length: int) -> np.ndarray:
    """Cumulative grants by window: each between the floor and the ceiling of its due, ``length`` a window; share adds up to cycle * length."""
    now = np.zeros(len(share), np.int64)
    out = [now]
    for w in range(1, cycle + 1):
        due = share * w
        now = np.maximum(now, due // cycle)
        left = w * length - int(now.sum())
        while left > 0:
            open_ = np.flatnonzero(now < -(-due // cycle))
            deadline = (now[open_] + 1) * cycle / share[open_]
            chosen = open_[np.argsort(deadline, kind="stable")[:left]]
            now[chosen] += 1
            left -= len(chosen)
        if left < 0:
            raise AssertionError("grants exceed the window")
        out.append(now.copy())
    return np.stack(out)


def _apportion(weights: np.ndarray, total: int) -> np.ndarray:
    exact = weights * (total / weights.sum())
    out = np.floor(exact).astype(np.int64)
    out[np.argsort(out - exact, kind="stable")[: total - int(out.sum())]] += 1
    return out


def plan(totals: list[int], weights: list[float] | None, length: int) -> tuple[list[Phase], list[tuple[int, int, int]], int]:
    """Phases, the tail as (queue, tokens before, tokens) in order, and the number of full windows of the phases.

    totals: tokens by queue; weights: target shares (None: in proportion to the totals, so that all queues end together). A
    queue that can't fill its share of another window leaves what it has to the tail, and the others go on.
    """
    left, given = np.array(totals, np.int64), np.zeros(len(totals), np.int64)
    want = np.array(weights if weights is not None else totals, np.float64)
    phases: list[Phase] = []
    tail: list[tuple[int, int, int]] = []
    windows = 0
    active = (left > 0) & (want > 0)
    while (active & (left > 0)).any():
        queues = np.flatnonzero(active & (left > 0))
        rest = int(left[queues].sum())
        if rest < length:
            break
        cycle = max(1, min(CYCLE, rest // length))
        share = _apportion(want[queues], cycle * length)
        if (share == 0).any():
            active[queues[share == 0]] = False
            continue
        granted = cycle_grants(share, cycle, length)
        most = [int(left[q] // s) * cycle + int(np.searchsorted(granted[:, i], left[q] % s, "right")) - 1 for i, (q, s) in enumerate(zip(queues, share.tolist(), strict=True))]
        n = min(most)
        if not n:
            active[queues[int(np.argmin(left[queues] / want[queues]))]] = False
            continue
        used = n // cycle * share + granted[n % cycle]
        phases.append(Phase(windows, queues.tolist(), given[queues].copy(), used, share, granted))
        windows += n
        given[queues] += used
        left[queues] -= used
    for q in np.flatnonzero(left > 0).tolist():
        tail.append((q, int(given[q]), int(left[q])))
    return phases, tail, windows


def _tail_windows(total: int, length: int) -> np.ndarray:
    """Ends of the tail's sequences: full windows, then powers of two."""
    ends = list(range(length, total + 1, length))
    rest, at = total % length, total - total % length
    for bit in range(length.bit_length(), -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return np.array(ends, np.int64)


class Placer:
    """Pieces of the tokens [first, first + n) of a queue: (offset from first, length, sequence, offset in it)."""

    def __init__(self, totals: list[int], weights: list[float] | None, length: int) -> None:
        self.length = length
        self.phases, tail, self.windows = plan(totals, weights, length)
        self.by_queue: dict[int, list[tuple]] = {}
        for p in self.phases:
            for i, q in enumerate(p.queues):
                self.by_queue.setdefault(q, []).append((int(p.before[i]), int(p.given[i]), p, i))
        at = 0
        self.tail: dict[int, tuple[int, int]] = {}
        for q, before, n in tail:
            self.tail[q] = (before, at)
            at += n
        self.tail_ends = _tail_windows(at, length)

    def pieces(self, queue: int, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For documents at first..first + n of a queue: (document, offset in it, length, sequence, offset in the sequence)."""
        end = first + n
        for before, given, p, i in self.by_queue.get(queue, ()):
            a, b = np.maximum(first, before) - before, np.minimum(end, before + given) - before
            mine = np.flatnonzero(a < b)
            if not len(mine):
                continue
            cycle, share, column = len(p.granted) - 1, int(p.share[i]), p.granted[:, i]
            window = lambda x: x // share * cycle + np.searchsorted(column, x % share, "right") - 1  # noqa: B023, E731
            low = window(a[mine])
            many = window(b[mine] - 1) - low + 1
            row, w = np.repeat(mine, many), csr_take(low, many)
            opens = w // cycle * share + column[w % cycle]
            closes = (w + 1) // cycle * share + column[(w + 1) % cycle]
            s, e = np.maximum(opens, a[row]), np.minimum(closes, b[row])
            keep = s < e
            row, w, opens, s, e = row[keep], w[keep], opens[keep], s[keep], e[keep]
            yield row, s + before - first[row], e - s, w + p.first_window, p.offsets[w % cycle, i] + s - opens
        if queue in self.tail:
            before, at = self.tail[queue]
            a, b = np.maximum(first, before) - before + at, end - before + at
            mine = np.flatnonzero(a < b)
            low = np.searchsorted(self.tail_ends, a[mine], "right")
            many = np.searchsorted(self.tail_ends, b[mine] - 1, "right") - low + 1
            row, w = np.repeat(mine, many), csr_take(low, many)
            opens = np.where(w > 0, self.tail_ends[w - 1], 0)
            s, e = np.maximum(opens, a[row]), np.minimum(self.tail_ends[w], b[row])
            yield row, s - at + before - first[row], e - s, self.windows + w, s - opens


def queues_of(shares: dict[str, int | float], whole: int | float) -> list[str]:
    """The sources with queues of their own, largest first: those due ``1 / SMALL`` of a window or more.

    If those left are due less than half of that together, they take the smallest own queue in, so that no queue starves.
    """
    own = sorted((s for s, n in shares.items() if n * SMALL >= whole > 0), key=lambda s: (-shares[s], s))
    rest = whole - sum(shares[s] for s in own)
    if own and 1e-9 * whole < rest and rest * 2 * SMALL < whole:
        own.pop()
    return own


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", source: str = "source", length: int = 2048, end: int = 1, targets: dict[str, float] | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of every document.

    targets: share of each source in a window (null and unnamed sources: 0); None: each source's share of all tokens. Full
    windows come first; the tail, under one window for each source, is packed in order and ends in windows whose lengths are
    powers of two, so that nothing is padded. Null and empty texts are the end id alone; texts are tokenised whole, however
    long. A null source counts as the empty one. Repeated rows, and rows of equal or null key, are packed again. Sources of
    equal share are ordered by name. Other columns are not read. An empty table gives an empty table, with targets, too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(source), F.lit("")).alias("source"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, before, part, at = _encoder(tokenizer), {}, 0, 0
        for b in batches:
            text, sources, parts = b.column(1), b.column(2).to_pylist(), ints(b, "part")
            size = np.asarray(pc.binary_length(text).fill_null(0), dtype=np.int64)
            for i, j in slices(np.flatnonzero(np.diff((np.cumsum(size) - size) // CHUNK, prepend=-1)), b.num_rows):
                so_far, n, ids = [], [], []
                for found, s in zip(encoder.encode(text.slice(i, j - i)), sources[i:j], strict=True):
                    found = np.append(found, np.uint32(end))
                    so_far.append(before.get(s, 0))
                    before[s] = so_far[-1] + len(found)
                    n.append(len(found))
                    ids.append(found.astype("<u2" if found.max() < 1 << 16 else "<u4").tobytes())
                part = int(parts[i])
                yield {"part": [part] * len(n), "row": (part << 36) + np.arange(at, at + len(n)), "doc_id": b.column(0).slice(i, j - i), "source": sources[i:j], "before": so_far, "n": n, "ids": ids}
                at += len(n)
        encoder.forget()

    kind = docs.schema[key].dataType.simpleString()
    tokens = materialise(arrow_map(rows.withColumn("part", F.spark_partition_id()), tokenise, f"part int, row long, doc_id {kind}, source string, before long, n long, ids binary"), "tokens")
    sums = materialise(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-counts")
    totals = sums.groupBy("source").agg(F.sum("n").alias("total"))
    if targets is None:
        whole = totals.agg(F.sum("total")).first()[0] or 0
        shares = {r.source: r.total for r in totals.filter(F.col("total") * SMALL >= whole).collect()}  # at most SMALL rows
        weight, wanted = F.col("total").cast("double"), F.lit(True)
    else:
        whole, shares = sum(targets.values()), targets
        given = F.create_map(*[x for s, w in targets.items() for x in (F.lit(s), F.lit(float(w)))]) if targets else F.create_map().cast("map<string,double>")
        weight, wanted = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)), F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0)) > 0
    own = queues_of(shares, whole)
    number = {s: i + 1 for i, s in enumerate(own)}
    last = len(own) + 1  # the queue of sources that are not wanted; queue 0: the small ones
    numbers = F.create_map(*[F.lit(x) for kv in number.items() for x in kv]) if number else F.create_map().cast("map<string,int>")
    known = totals.select("source", "total", weight.alias("weight"), F.coalesce(F.try_element_at(numbers, F.col("source")), F.when(wanted, 0).otherwise(last)).alias("queue"))
    queue_totals = [0] * (last + 1)
    for r in known.groupBy("queue").agg(F.sum("total").alias("n")).collect():  # at most SMALL + 2 rows
        queue_totals[r.queue] = r.n
    weights = None
    if targets is not None:
        weights = [max(0.0, whole - sum(targets[s] for s in own)), *(float(targets[s]) for s in own), 0.0]
    placer = spark.sparkContext.broadcast(Placer(queue_totals, weights, length))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if sums.count() <= 1 << 18:
        bases = F.broadcast(bases)  # counted: at most 2^18 rows
    placed = tokens.join(bases, ["source", "part"]).withColumn("queue", F.coalesce(F.try_element_at(numbers, F.col("source")), F.lit(0)))
    found = placed.filter("queue > 0").select("doc_id", "source", F.col("queue").cast("long").alias("queue"), (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    if queue_totals[0] or queue_totals[last]:
        shared = placed.filter("queue = 0").select("row", "source", (F.col("base") + F.col("before")).alias("first"), "n").join(known.filter(F.col("queue").isin(0, last)), "source")
        turns = materialise(_turns(shared, queue_totals[0] + queue_totals[last]), "turns")
        found = found.union(tokens.join(turns.hint("merge"), "row").select("doc_id", "source", F.col("queue").cast("long"), "first", "n", "ids"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            queues, first, n = ints(b, "queue"), ints(b, "first"), ints(b, "n")
            ids = [np.frombuffer(x, "<u2" if len(x) == 2 * m else "<u4").astype("<u4").tobytes() for x, m in zip(b.column(5).to_pylist(), n.tolist(), strict=True)]
            for q in np.unique(queues).tolist():
                own = np.flatnonzero(queues == q)
                for row, start, size, window, offset in placer.value.pieces(q, first[own], n[own]):
                    row = own[row]
                    cut = [ids[r][4 * s : 4 * (s + m)] for r, s, m in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
                    out = {"doc_id": b.column(0).take(pa.array(row)), "source": b.column(1).take(pa.array(row)), "start": start, "length": size, "ids_crc32": np.fromiter(map(zlib.crc32, cut), np.int64, len(cut)), "doc_tokens": n[row], "sequence_id": window, "offset": offset}
                    yield out | {"ids": cut} if keep_ids else out

    return arrow_map(found, place, f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{', ids binary' * keep_ids}")


def _turns(rows: DataFrame, tokens: int, *, slot_tokens: int = 1 << 21) -> DataFrame:
    """(row, queue, first): where each document starts in the queue that its source shares with others.

    rows: (row, source, first, n, total, weight, queue), first being the place in the source's own tokens. A document is due
    when its source, by its weight (its total, in the queue of unwanted ones), has been given that many tokens; a hash of the
    source says where within its documents. Times are dealt to slots of about ``slot_tokens``, whose totals are added up.
    """
    weight = F.when(F.col("queue") == 0, F.col("weight")).otherwise(F.col("total"))
    phase = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20)
    due = rows.select("row", "queue", "n", ((F.col("first") + phase * F.col("n")) / weight).alias("due"), (F.col("total") / weight).alias("span"))
    longest = due.groupBy("queue").agg(F.max("span").alias("longest"))
    slots = max(1, tokens // slot_tokens)
    timed = due.join(F.broadcast(longest), "queue").withColumn("slot", F.floor(F.col("due") / F.col("longest") * slots))  # two rows at most
    timed = timed.select("row", "queue", "n", "due", "slot")
    before = Window.partitionBy("queue").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = timed.groupBy("queue", "slot").agg(F.sum("n").alias("n")).select("queue", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("queue", "slot").orderBy("due", "row").rowsBetween(Window.unboundedPreceding, -1)
    return timed.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["queue", "slot"]).select("row", "queue", (F.col("start") + F.col("inside")).alias("first"))
