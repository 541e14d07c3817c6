"""Duplicate calls: candidate pairs, scores with evidence, survivors, merges and their undoing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, saved
from ..functions.names import alike_names, is_blank, matching_ratio, normalise_name

#: Weights of the attributes and limits of the score.
WEIGHTS = {"name": 0.40, "vcn": 0.25, "imo": 0.20, "type": 0.05, "flag": 0.05, "dimensions": 0.05}
AUTO_MERGE, STEWARD_REVIEW, CANDIDATE = 0.98, 0.85, 0.70


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    """Pairs a < b of equal, non-blank key."""
    keyed = rows.filter(~is_blank(key)).select(key, "call_id")
    return keyed.alias("x").join(keyed.alias("y"), key).filter("x.call_id < y.call_id").select(F.col("x.call_id").alias("a"), F.col("y.call_id").alias("b"))


def _alike_keys(names: DataFrame, least: float) -> DataFrame:
    """(key, norm, size): names under keys such that two names with a matching ratio of ``least`` or more share one.

    A ratio of t needs M >= t (m + n) / 2 common characters in order, so a name's partners have at least t / (2 - t) of its
    length. Two matching blocks have a character between them that isn't matched, so there are at most m + n - 2 M + 1
    blocks, and 3 M - m - n - 1 pairs of neighbouring characters that both names have. Where that is 1 or more, they meet
    under a pair (of its pairs, rarest first, a name needs all but as many as the least number of common ones, less one).
    For the few sums m + n where it isn't, they meet under that sum and one of the rarest (character, occurrence) pairs, of
    which a name needs all but M - 1.
    """
    t = least - 5e-5  # ratios are rounded to 4 digits
    common, both = f"cast(ceil({t} * s / 2 - 1e-9) as int)", "transform(sequence(cast(ceil(size * {0} - 1e-9) as int), cast(floor(size / {0} + 1e-9) as int)), n -> size + n)".format(t / (2 - t))
    sizes = names.select("norm", F.length("norm").alias("size")).filter("size > 0").withColumn("sums", F.expr(both))
    sizes = sizes.withColumn("least_pairs", F.expr(f"array_min(filter(transform(sums, s -> 3 * {common} - s - 1), x -> x > 0))"))
    sizes = sizes.withColumn("loose", F.expr(f"filter(sums, s -> 3 * {common} - s - 1 <= 0)"))
    parts = F.expr("""array(struct('c' as kind, split(norm, '') as own), struct('p' as kind, transform(sequence(1, greatest(size - 1, 1)), i -> substring(norm, i, 2)) as own))""")
    each = sizes.select("norm", "size", F.inline(parts)).filter((F.col("kind") == "c") | (F.col("size") > 1)).select("norm", "kind", F.explode("own").alias("c")).filter("c <> ''")
    nth = each.groupBy("norm", "kind", "c").agg(F.count("*").cast("int").alias("n")).select("norm", "kind", "c", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    many = nth.groupBy("kind", "c", "k").agg(F.count("*").alias("many"))  # parts of the alphabet, times the longest name
    ranked = nth.join(many, ["kind", "c", "k"]).groupBy("norm", "kind").agg(F.sort_array(F.collect_list(F.struct("many", "c", "k"))).alias("rare")).join(sizes, "norm")
    pairs = ranked.filter("kind = 'p' and least_pairs is not null").select("norm", "size", F.explode(F.expr("slice(rare, 1, greatest(1, size(rare) - least_pairs + 1))")).alias("x")).select(F.concat(F.lit("p"), "x.c").alias("key"), "norm", "size").distinct()
    loose = ranked.filter("kind = 'c'").select("norm", "size", "rare", F.explode("loose").alias("s")).select("norm", "size", "s", F.explode(F.expr(f"slice(rare, 1, greatest(1, size(rare) - {common} + 1))")).alias("x"))
    return pairs.union(loose.select(F.concat_ws(" ", F.lit("c"), "x.c", F.col("x.k").cast("string"), F.col("s").cast("string")).alias("key"), "norm", "size"))


def _bag(name: str) -> Column:
    """Each character of a name with its occurrence: the overlap of two bags is that of the arrays."""
    return F.expr(f"transform(split({name}, ''), (c, i) -> concat(c, cast(length(replace(left({name}, i + 1), c, concat(c, c))) - i - 1 as string)))")


def _could_be_alike(least: float) -> Column:
    """What two names p < q that could have a matching ratio of ``least`` pass, by built-ins: enough common characters, few enough edits."""
    t, total = least - 5e-5, F.length("p") + F.length("q")
    need = F.ceil(t * total / 2 - 1e-9)
    few = F.levenshtein("p", "q") <= total - 2 * need
    return few & (F.size(F.array_intersect(_bag("p"), _bag("q"))) >= need)


def _named(calls: DataFrame, default: str) -> DataFrame:
    rows = calls.filter("not coalesce(is_merged, false)").withColumn("norm", normalise_name("vessel_name"))
    return rows.filter((F.col("norm") != "") & (F.col("norm") != default))


def _fits(least: float) -> Column:
    return 2.0 * F.least(F.length("p"), F.length("q")) >= least * (F.length("p") + F.length("q"))


def name_pairs(keys: DataFrame, least: float) -> DataFrame:
    """(p, q): names p < q that share a key and could be alike; the ratio itself remains to be taken."""
    met = keys.select("key", F.col("norm").alias("p")).join(keys.select("key", F.col("norm").alias("q")), "key").filter((F.col("p") < F.col("q")) & _fits(least))
    return met.select("p", "q").filter(_could_be_alike(least)).distinct()


def representatives(calls: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(call_id, representative): of the calls that agree in all ``fields``, null with null, the smallest id stands for all.

    Pairs between representatives and this table say what all pairs would: copies are not expanded into pairs.
    """
    keyed = calls.select("call_id", F.xxhash64(*[F.col(c) for c in fields]).alias("_h"), *fields)
    least = keyed.groupBy("_h", *fields).agg(F.min("call_id").alias("representative")).withColumnsRenamed({c: f"_{c}" for c in fields})
    return keyed.join(least, [keyed["_h"] == least["_h"], *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fields]]).select("call_id", "representative")


def alike_pairs(names: DataFrame, least: float, *, block: int = 32_768, side: int = 24) -> DataFrame:
    """(p, q): of distinct names ``norm`` those p < q with a matching ratio of ``least`` or more.

    Every name is compared with every other: at a ratio of 0.7 nearly all names of a common length share the parts that alike ones
    must share, so meeting under such parts makes more pairs, not fewer. Names are dealt to blocks of at most about ``block``, each
    two of which meet in a task, read from where they were written; no pair is shuffled and a task holds two blocks.
    """
    many = names.count()
    blocks = max(1, -(-many // block), min(side, many // 4096))
    dealt = saved(names.groupBy(F.pmod(F.xxhash64("norm"), F.lit(blocks)).alias("i")).agg(F.collect_list("norm").alias("x"))).repartitionByRange(blocks, "i")
    met = dealt.join(dealt.select(F.col("i").alias("j"), F.col("x").alias("y")).hint("shuffle_replicate_nl"), F.col("i") <= F.col("j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, y in zip(*(batch.column(c) for c in ("i", "j", "x", "y")), strict=True):
                found = list(alike_names(x.as_py(), None if i == j else y.as_py(), least))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["p", "q"])

    return met.mapInArrow(compare, "p string, q string")


def candidate_pairs(calls: DataFrame, *, least: float = CANDIDATE, default: str = "UNKNOWN") -> DataFrame:
    """ID-03: (a, b) of unmerged calls that share VCN or IMO, or whose names are alike; no pair is left out.

    Blank names and the ``default`` name are like none. Normal forms are compared once for each two (``alike_pairs``); then
    the calls of like names are joined. All pairs can be many: ``name_classes`` gives their classes.
    """
    rows = calls.filter("not coalesce(is_merged, false)")
    named = _named(calls, default)
    names = saved(named.select("norm").distinct())
    like = saved(alike_pairs(names, least))
    alike = like.unionByName(like.select(F.col("q").alias("p"), F.col("p").alias("q"))).unionByName(names.select(F.col("norm").alias("p"), F.col("norm").alias("q")))
    by_name = named.select(F.col("call_id").alias("a"), F.col("norm").alias("p")).join(alike, "p").join(named.select(F.col("call_id").alias("b"), F.col("norm").alias("q")), "q").filter("a < b").select("a", "b")
    return by_name.union(_pairs(rows, "vcn")).union(_pairs(rows, "imo")).distinct()


def _forests(least: float):  # noqa: ANN202
    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of alike names under one key that connect what all its links connect."""
        rows = rows.drop_duplicates("norm").sort_values("norm")
        names, label = rows["norm"].tolist(), rows["leader"].tolist()
        bags = [Counter(n) for n in names]
        found: list[tuple[str, str]] = []
        for i, p in enumerate(names):
            for j in range(i + 1, len(names)):
                if label[j] == label[i] or 2 * (bags[i] & bags[j]).total() < least * (len(p) + len(names[j])):
                    continue
                if round(SequenceMatcher(None, p, names[j]).ratio(), 4) >= least:
                    found.append((p, names[j]))
                    old, new = label[j], label[i]
                    label = [new if x == old else x for x in label]
        return pd.DataFrame(found, columns=["a", "b"])

    return forest


def name_classes(calls: DataFrame, *, least: float = CANDIDATE, default: str = "UNKNOWN", crowd: int = 500) -> DataFrame:
    """ID-03: (call_id, class_id): each unmerged call and the smallest call that names alike lead to; no link is lost, no pairs are listed.

    First every name is compared with one of each of its keys; then, under keys whose names are in several classes, names of
    different classes are, in blocks of about ``crowd``, each two of which meet in a task. Blank and default names are alone.
    """
    named = _named(calls, default)
    keys = cut(_alike_keys(named.select("norm").distinct(), least))
    centre = F.min("norm").over(Window.partitionBy("key"))
    stars = keys.select(centre.alias("p"), F.col("norm").alias("q")).distinct().filter((F.col("p") < F.col("q")) & _fits(least) & _could_be_alike(least)).filter(matching_ratio("p", "q") >= least)
    links = cut(stars.select(F.col("p").alias("a"), F.col("q").alias("b")))
    labelled = keys.join(connected(links), F.col("norm") == F.col("node"), "left").select("key", "norm", F.coalesce("leader", "norm").alias("leader"))
    open_ = labelled.groupBy("key").agg(F.count("*").alias("many"), F.min("leader").alias("lo"), F.max("leader").alias("hi")).filter("lo <> hi").select("key", F.ceil(F.col("many") / crowd).alias("k"))
    block = F.pmod(F.xxhash64("norm"), F.col("k"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: F.concat_ws(" ", "key", F.least(x, block).cast("string"), F.greatest(x, block).cast("string")))
    dealt = labelled.join(open_, "key").select(F.explode(tasks).alias("task"), "norm", "leader")
    more = cut(dealt.groupBy("task").applyInPandas(_forests(least), "a string, b string").distinct())
    leaders = connected(links.union(more))
    whole = calls.filter("not coalesce(is_merged, false)").select("call_id", normalise_name("vessel_name").alias("norm"))
    groups = named.select("call_id", "norm").join(leaders.withColumnRenamed("node", "norm"), "norm", "left").select("call_id", F.coalesce("leader", "norm").alias("leader"))
    smallest = groups.groupBy("leader").agg(F.min("call_id").alias("class_id"))
    alone = whole.filter((F.col("norm") == "") | (F.col("norm") == default) | F.col("norm").isNull()).select("call_id", F.col("call_id").alias("class_id"))
    return groups.join(smallest, "leader").select("call_id", "class_id").union(alone)


def _agree(c: str) -> Column:
    return F.coalesce(F.col(f"x.{c}") == F.col(f"y.{c}"), F.lit(False))


def _both(c: str) -> Column:
    return ~is_blank(f"x.{c}") & ~is_blank(f"y.{c}")


def score_pairs(pairs: DataFrame, calls: DataFrame) -> DataFrame:
    """ID-02, ID-04 to ID-07: similarity, weighted score, conflicts, uplift, disposition and evidence of each pair.

    Different VCNs or IMOs block a merge whatever the score. Equal ones without a conflict lift it to 0.99, or 0.98 for names under 0.98 similarity.
    """
    rows = pairs.join(calls.alias("x"), F.col("a") == F.col("x.call_id")).join(calls.alias("y"), F.col("b") == F.col("y.call_id"))
    p, q = normalise_name("x.vessel_name"), normalise_name("y.vessel_name")
    known = F.when(is_blank("x.vessel_name") | is_blank("y.vessel_name"), 0.0).when(_agree("vessel_name"), 1.0).when(p == q, 0.99)
    rows = rows.withColumn("similarity", known)
    rest = rows.filter("similarity is null").drop("similarity").withColumn("similarity", matching_ratio(p, q))  # only these go through Python
    rows = rows.filter("similarity is not null").union(rest)
    close = lambda c: (F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) <= 0.01)
    sizes = [(close("loa"), F.col("x.loa").isNotNull() & F.col("y.loa").isNotNull()), (close("grt"), F.col("x.grt").isNotNull() & F.col("y.grt").isNotNull()), (_agree("teu"), F.col("x.teu").isNotNull() & F.col("y.teu").isNotNull())]
    had = sum((h.cast("int") for _, h in sizes), F.lit(0))
    dimension = F.coalesce(F.try_divide(sum((F.when(h & m, 1).otherwise(0) for m, h in sizes), F.lit(0)), F.nullif(had, F.lit(0))), F.lit(0.0))
    parts = {"name": F.col("similarity"), "vcn": (_both("vcn") & _agree("vcn")).cast("double"), "imo": (_both("imo") & _agree("imo")).cast("double"), "type": (_both("vessel_type") & _agree("vessel_type")).cast("double"), "flag": (_both("flag") & _agree("flag")).cast("double"), "dimensions": dimension}
    raw = F.round(sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)), 4)
    conflict = (_both("vcn") & ~_agree("vcn")) | (_both("imo") & ~_agree("imo"))
    same = (_both("vcn") & _agree("vcn")) | (_both("imo") & _agree("imo"))
    score = F.when(same & ~conflict, F.greatest(raw, F.when(F.col("similarity") >= 0.98, 0.99).otherwise(0.98))).otherwise(raw)
    disposition = F.when(conflict, "BLOCKED_BY_CONFLICT").when(score >= AUTO_MERGE, "AUTO_MERGE").when(score >= STEWARD_REVIEW, "STEWARD_REVIEW").otherwise("SEPARATE")
    grade = lambda k: F.when(parts[k] >= 0.98, "AGREED").when(parts[k] > 0, "PARTIAL").otherwise("DISAGREED")
    missing = {"name": is_blank("x.vessel_name") | is_blank("y.vessel_name"), "vcn": ~_both("vcn"), "imo": ~_both("imo"), "type": ~_both("vessel_type"), "flag": ~_both("flag"), "dimensions": had == 0}
    evidence = F.array(*[F.struct(F.lit(k).alias("attribute"), F.when(missing[k], "MISSING").otherwise(grade(k)).alias("outcome"), F.lit(w).alias("weight"), F.round(parts[k] * w, 4).alias("contribution")) for k, w in WEIGHTS.items()])
    return rows.select("a", "b", "similarity", raw.alias("raw_score"), score.alias("score"), _agree("vessel_name").alias("same_name"), (_both("vcn") & _agree("vcn")).alias("same_vcn"), conflict.alias("is_conflict"), disposition.alias("disposition"), evidence.alias("evidence"))


def evidence_rows(scored: DataFrame) -> DataFrame:
    """ID-07: a row for each pair and attribute."""
    return scored.select("a", "b", F.inline("evidence"))


def connected(pairs: DataFrame) -> DataFrame:
    """(node, leader): the smallest node that the pairs (a, b) lead to, for each node of them. Labels spread and jump until nothing changes."""
    both = cut(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("leader"))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "leader"), "b").groupBy("a").agg(F.min("leader").alias("m"))
        next_ = labels.join(near, "a").select("a", F.least("leader", "m").alias("leader"))
        jumped = next_.alias("x").join(next_.alias("y"), F.col("x.leader") == F.col("y.a"), "left").select(F.col("x.a").alias("a"), F.least("x.leader", F.coalesce("y.leader", "x.leader")).alias("leader"))
        jumped = cut(jumped)
        if jumped.join(labels, ["a", "leader"], "left_anti").isEmpty():
            return jumped.select(F.col("a").alias("node"), "leader")
        labels = jumped


def merge_groups(scored: DataFrame) -> DataFrame:
    """ID-12: (call_id, leader) of the groups that AUTO_MERGE pairs make."""
    return connected(scored.filter("disposition = 'AUTO_MERGE'").select("a", "b")).select(F.col("node").alias("call_id"), "leader")


def key_links(calls: DataFrame) -> DataFrame:
    """ID-12 without pairs: (a, b) links of unmerged calls that connect what all AUTO_MERGE pairs of calls with a common VCN or IMO connect.

    Such a pair merges unless both have the other key and differ in it. So under a VCN all calls of one IMO merge, and if a
    call without IMO is there, all of them through it; and the other way round. Each call has at most four links, however
    many calls share its keys.
    """
    rows = calls.filter("not coalesce(is_merged, false)").select("call_id", *[F.when(~is_blank(k), F.col(k)).alias(k) for k in ("vcn", "imo")])
    out = None
    for key, other in (("vcn", "imo"), ("imo", "vcn")):
        held = rows.filter(F.col(key).isNotNull())
        centres = held.groupBy(key, other).agg(F.min("call_id").alias("b"))
        stars = held.withColumnsRenamed({"call_id": "a", other: "_o"}).join(centres, (F.col("_o").eqNullSafe(F.col(other))) & (held[key] == centres[key])).select("a", "b")
        open_ = centres.filter(F.col(other).isNull()).select(key, F.col("b").alias("a"))
        for one in (stars, open_.join(centres.select(key, "b"), key).select("a", "b")):
            out = one if out is None else out.union(one)
    return out.filter("a <> b")


def merge_groups_by_key(calls: DataFrame) -> DataFrame:
    """ID-12: (call_id, leader) as ``merge_groups`` gives for the scored pairs of all calls with a common VCN or IMO; no pair is made."""
    return connected(key_links(calls)).select(F.col("node").alias("call_id"), "leader")


def unmerge(groups: DataFrame, taken_back: DataFrame) -> DataFrame:
    """ID-11: the groups (call_id, survivor_id) without the merges that decisions took back (call_id): these calls stand alone again.

    ``apply_merges``, ``consolidate`` and ``rekey_events`` over what remains give calls and events as they were.
    """
    back = taken_back.select("call_id", F.lit(True).alias("_back")).distinct()
    alone = F.when(F.col("_back"), F.col("call_id")).otherwise(F.col("survivor_id"))
    return groups.join(back, "call_id", "left").select("call_id", alone.alias("survivor_id"))


def replay(decisions: DataFrame) -> DataFrame:
    """ID-10, ID-11: (call_id, survivor_id, path) of the calls that are merged once all decisions are done, those that were undone left out.

    decisions: (seq, decision_id, action, call_id, survivor_id, undoes): MERGE puts ``call_id`` into ``survivor_id``, UNMERGE
    takes back the merge whose decision_id is in ``undoes``, if it came before. Everything is as if the merges that were taken back had
    never been, also for what they moved and a later merge moved on. Of several standing merges of one call the first
    counts. What a call holds moves with each later merge of its survivor; a survivor that was merged before stays where it is.
    ``path``: the numbers of the merges from the last survivor to the call, the order in which its rows came in.
    """
    undone = decisions.filter("action = 'UNMERGE'").groupBy(F.col("undoes").alias("decision_id")).agg(F.max("seq").alias("_undone"))
    merges = decisions.filter("action = 'MERGE' and call_id <> survivor_id").join(undone, "decision_id", "left").filter("_undone is null or _undone < seq")
    standing = merges.groupBy("call_id").agg(F.min(F.struct("seq", "survivor_id")).alias("m")).select("call_id", "m.survivor_id", "m.seq")
    steps = cut(standing.select("call_id", "survivor_id", F.col("seq").alias("last"), F.array("seq").alias("path")))
    while True:  # each round doubles how far a call has followed its survivors
        next_ = steps.select(F.col("call_id").alias("survivor_id"), F.col("survivor_id").alias("_on"), F.col("last").alias("_last"), F.col("path").alias("_path"))
        goes = F.coalesce(F.element_at("_path", -1) > F.col("last"), F.lit(False))  # that merge came after
        further = cut(
            steps.join(next_, "survivor_id", "left").select(
                "call_id",
                F.when(goes, F.col("_on")).otherwise(F.col("survivor_id")).alias("survivor_id"),
                F.when(goes, F.col("_last")).otherwise(F.col("last")).alias("last"),
                F.when(goes, F.concat("_path", "path")).otherwise(F.col("path")).alias("path"),
                goes.alias("went"),
            )
        )
        steps = further.drop("went")
        if further.filter("went").isEmpty():
            return steps.select("call_id", "survivor_id", "path")


def with_owner(children: DataFrame, merged: DataFrame) -> DataFrame:
    """ID-10, ID-11: rows of calls (events, services, cargo, delays) under the call that ``replay`` leaves them with; ``own_id`` is the call they came with."""
    owners = merged.select("call_id", F.col("survivor_id").alias("_owner"))
    return children.join(owners, "call_id", "left").withColumns({"own_id": F.col("call_id"), "call_id": F.coalesce("_owner", "call_id")}).drop("_owner")


def replayed_calls(calls: DataFrame, merged: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """ID-09 to ID-11: calls after ``replay``: what survivors have taken over, merged ones as they were and marked.

    A survivor's numbers are the largest of its members', its texts its own, else the first that came in; calls that no
    standing merge touches, and those it was taken back from, are as they were before.
    """
    every = calls.select("call_id", *numeric, *text).join(merged, "call_id", "left")
    order = F.coalesce("path", F.array().cast("array<long>"))
    held = every.groupBy(F.coalesce("survivor_id", "call_id").alias("call_id")).agg(
        F.count("*").alias("n_members"), *[F.max(c).alias(c) for c in numeric], *[F.min_by(c, F.when(~is_blank(c), order)).alias(c) for c in text]
    )
    kept = every.filter("survivor_id is not null").select("call_id", F.lit(1).cast("long").alias("n_members"), *numeric, *text, F.col("survivor_id").alias("merged_into"))
    return held.withColumn("merged_into", F.lit(None).cast(calls.schema["call_id"].dataType)).unionByName(kept)


def survivors(groups: DataFrame, calls: DataFrame, fields: Sequence[str]) -> DataFrame:
    """ID-08: of each group the most complete call, two fields less for a name with ``-`` or ``.``; ties to the smallest id. (call_id, survivor_id)"""
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0)) - F.when(F.col("vessel_name").rlike("[-.]"), 2).otherwise(0)
    rows = groups.join(calls, "call_id").withColumn("_f", filled)
    first = F.first("call_id").over(Window.partitionBy("leader").orderBy(F.desc("_f"), "call_id"))
    return rows.select("call_id", first.alias("survivor_id"))


def consolidate(groups: DataFrame, calls: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """ID-09: one row for each survivor: the largest number; of texts the survivor's, else the first there is by id; with how each came about."""
    rows = groups.join(calls, "call_id").withColumn("_own", (F.col("call_id") != F.col("survivor_id")).cast("int"))
    order = F.struct("_own", "call_id")
    aggs = [F.max(c).alias(c) for c in numeric] + [F.min_by(c, F.when(~is_blank(c), order)).alias(c) for c in text]
    rule = lambda c, kind: F.when(F.count_distinct(c) == 0, "MISSING").when(F.count_distinct(c) == 1, "UNANIMOUS").otherwise(kind).alias(f"{c}_rule")
    aggs += [rule(c, "MAX_NUMERIC") for c in numeric] + [rule(c, "SURVIVOR_FIRST") for c in text]
    return rows.groupBy("survivor_id").agg(F.count("*").alias("n_members"), *aggs)


def rekey_events(events: DataFrame, groups: DataFrame) -> DataFrame:
    """ID-10: events under their survivor, but for slots (event, index) that it has already; of several movers the smallest call's."""
    moved = events.join(groups.filter("call_id <> survivor_id"), "call_id", "left").withColumns({"to": F.coalesce("survivor_id", "call_id"), "_m": F.col("survivor_id").isNotNull().cast("int")})
    slot = Window.partitionBy("to", "event_name", "occurrence_index").orderBy("_m", "call_id", "event_id")
    return moved.withColumn("_n", F.when(F.col("_m") == 1, F.row_number().over(slot)).otherwise(1)).filter("_n = 1").withColumn("call_id", F.col("to")).drop("to", "_m", "_n", "survivor_id")


def apply_merges(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """ID-10: calls with ``is_merged`` and ``merged_into``."""
    joined = calls.drop("is_merged", "merged_into").join(groups, "call_id", "left")
    merged = F.coalesce(F.col("survivor_id") != F.col("call_id"), F.lit(False))
    return joined.withColumns({"is_merged": merged, "merged_into": F.when(merged, F.col("survivor_id"))}).drop("survivor_id")


def population(calls: DataFrame) -> DataFrame:
    """ID-13: all calls, the merged and the consolidated ones."""
    return calls.agg(F.count("*").alias("n_total"), F.count_if("is_merged").alias("n_merged"), F.count_if(~F.col("is_merged")).alias("n_consolidated"))


def queue(scored: DataFrame, calls: DataFrame) -> DataFrame:
    """ID-14: pairs for a steward with their names, highest score first."""
    rows = scored.filter("disposition = 'STEWARD_REVIEW'")
    named = rows.join(calls.select(F.col("call_id").alias("a"), F.col("vessel_name").alias("name_a")), "a").join(calls.select(F.col("call_id").alias("b"), F.col("vessel_name").alias("name_b")), "b")
    return named.select("a", "b", "name_a", "name_b", "score").orderBy(F.desc("score"), "a", "b")


def decision_history(decisions: DataFrame, calls: DataFrame) -> DataFrame:
    """ID-14: decisions (call_id, survivor_id, action, actor, decided_at) with both names and their place in the survivor's history, newest first."""
    name = lambda c: calls.select(F.col("call_id").alias(c), F.col("vessel_name").alias(f"{c}_name"))
    named = decisions.join(name("call_id"), "call_id", "left").join(name("survivor_id"), "survivor_id", "left")
    order = Window.partitionBy("survivor_id").orderBy(F.desc("decided_at"), "call_id", "action")
    return named.withColumn("position", F.row_number().over(order))
