"""Statistics of durations: exact percentiles, spread, outliers, histograms, paging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import saved, small

ACCURACY = 10_000  # of the sketch that finds where a quantile lies


def _beside(df: DataFrame, keys: Sequence[str], table: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` with the columns that ``table`` has for its keys; null keys meet null keys."""
    renamed = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    fits = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return df.join(renamed, fits, how).drop(*[f"_key_{k}" for k in keys])


def with_quantiles(df: DataFrame, keys: Sequence[str], value: str, picks: Mapping[str, tuple[float, str]], aggs: Sequence[Column] = ()) -> DataFrame:
    """By key: ``aggs``, ``n`` (values that aren't null) and exact quantiles, however many values, or equal values, a key has.

    picks: name to (q, rule): ``linear`` interpolates at q (n - 1), ``nearest`` is the value at rank ceil(q n), ``upper``
    the one at floor(q n) + 1. A first pass bounds each quantile with a sketch. The second one counts: equal values between
    the bounds together, and all values of a gap between bounds together. So a key's ranks are found among its distinct
    values between the bounds, at most about 4 / ``ACCURACY`` of its values for each quantile, and a few gaps. Keys without
    a value have null quantiles. The sketch's rows are written, counted and, if few, broadcast: no pass deals rows by key.
    """
    if not keys:
        return with_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, picks, aggs).drop("_all")
    df, v, wide = saved(df), F.col(value), 2.0 / ACCURACY  # read twice
    qs = sorted({q for q, _ in picks.values()})
    low, high = (F.percentile_approx(v, F.array(*[F.lit(min(1.0, max(0.0, q + side * wide))) for q in qs]), F.lit(ACCURACY)) for side in (-1, 1))
    first = saved(df.groupBy(*keys).agg(*aggs, F.count(v).alias("n"), low.alias("_low"), high.alias("_high")))
    few = small(first)

    ranks = {}
    for name, (q, rule) in picks.items():
        if rule == "linear":
            exact = F.lit(q) * (F.col("n") - 1)
            ranks[f"{name}_0"], ranks[f"{name}_1"] = F.floor(exact), F.ceil(exact)
        elif rule == "nearest":
            ranks[f"{name}_0"] = F.greatest(F.lit(1), F.ceil(F.round(F.lit(q) * F.col("n"), 9))) - 1
        else:
            ranks[f"{name}_0"] = F.floor(F.round(F.lit(q) * F.col("n"), 9))
    known = few.select(*keys, "_low", "_high")
    rows = _beside(df.select(*keys, v.alias("_v")).filter("_v is not null"), keys, known)
    inside = F.exists(F.arrays_zip("_low", "_high"), lambda b: (F.col("_v") >= b["_low"]) & (F.col("_v") <= b["_high"]))
    gap = F.size(F.filter("_high", lambda b: b < F.col("_v")))
    rows = rows.withColumn("_in", inside).select(*keys, "_v", F.when(F.col("_in"), F.col("_v")).alias("_one"), F.when(~F.col("_in"), gap).alias("_gap"))
    groups = rows.groupBy(*keys, "_one", "_gap").agg(F.count("*").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    groups = groups.withColumn("_until", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_from").rowsBetween(Window.unboundedPreceding, 0)))
    groups = _beside(groups, keys, few.select(*keys, *[rank.alias(f"_{name}") for name, rank in ranks.items()]))
    start = F.col("_until") - F.col("_n")
    at = lambda k: F.max(F.when((k >= start) & (k < F.col("_until")), F.when(k == start, F.col("_from")).when(k == F.col("_until") - 1, F.col("_to")).when(F.col("_one").isNotNull(), F.col("_one"))))
    found = groups.groupBy(*keys).agg(*[at(F.col(f"_{name}")).alias(f"_at_{name}") for name in ranks])
    both = _beside(first, keys, found, "left")
    out = {}
    for name, (q, rule) in picks.items():
        a = F.col(f"_at_{name}_0")
        exact = F.lit(q) * (F.col("n") - 1)
        out[name] = a + (F.col(f"_at_{name}_1") - a) * (exact - F.floor(exact)) if rule == "linear" else a
    return both.withColumns(out).select(*first.drop("_low", "_high").columns, *picks)


def duration_stats(df: DataFrame, keys: Sequence[str], value: str, entity: str | None = None) -> DataFrame:
    """TM-17 to TM-19: counts, mean, sample deviation (0 for one value), range, linear percentiles, ratios and extremes by key.

    Null values count as missing. CV is null for a mean within 0.001 of 0, the tail ratio for a median that isn't positive.
    """
    aggs = [
        (F.count("*") - F.count(value)).alias("n_missing"),
        F.avg(value).alias("mean"),
        F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    if entity:
        valued = F.when(F.col(value).isNotNull(), F.col(entity))
        aggs += [F.min_by(valued, F.struct(F.col(value).isNull(), value, entity)).alias("fastest"), F.max_by(valued, F.struct(F.col(value).isNotNull(), value, F.negative(F.col(entity)) if dict(df.dtypes)[entity] in ("int", "bigint") else F.col(entity))).alias("slowest")]
    df = saved(df.select(*keys, value, *([entity] if entity else [])))
    linear = {name: (q, "linear") for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))}
    got = with_quantiles(df, keys, value, linear, aggs)
    got = got.withColumns(
        {
            "cv": F.when(F.abs("mean") >= 0.001, F.col("sd") / F.col("mean")),
            "tail_ratio": F.when(F.col("median") > 0, F.col("p90") / F.col("median")),
            "right_skew": F.col("mean") > 1.2 * F.col("median"),
            "small_sample": F.col("n") < 5,
        }
    )
    columns = [*keys, "n", "n_missing", "mean", "median", "sd", "min", "max", "p25", "p75", "p90", "p95", "cv", "tail_ratio", "right_skew", "small_sample", *(["fastest", "slowest"] if entity else [])]
    doubles = {"mean", "median", "sd", "min", "max", "p25", "p75", "p90", "p95", "cv", "tail_ratio"}
    return got.select(*[F.round(c, 4).alias(c) if c in doubles else F.col(c) for c in columns])


def tukey_outliers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """TM-20: rows beyond the fences P25 - 1.5 IQR and P75 + 1.5 IQR of their key, with the fences."""
    df = saved(df)
    p = with_quantiles(df, keys, value, {"p25": (0.25, "linear"), "p75": (0.75, "linear")})
    low, high = F.col("p25"), F.col("p75")
    fences = p.select(*keys, (low - 1.5 * (high - low)).alias("lower_fence"), (high + 1.5 * (high - low)).alias("upper_fence"))
    return _beside(df, keys, small(fences)).filter((F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence")))


def _severity() -> Column:
    return F.when((F.col("threshold") > 0) & (F.col("value_") > 1.5 * F.col("threshold")), "CRITICAL").otherwise("HIGH")


def above_percentile(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """OL-HI: non-negative values strictly above the linear percentile; CRITICAL above 1.5 times a positive threshold, else HIGH."""
    rows = saved(df.filter(F.col(value) >= 0))
    limits = small(with_quantiles(rows, keys, value, {"threshold": (q, "linear")}).select(*keys, "threshold"))
    return _beside(rows, keys, limits).filter(F.col(value) > F.col("threshold")).withColumn("value_", F.col(value)).withColumn("severity", _severity()).drop("value_")


def below_percentile(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """OL-LO: values strictly below the linear percentile, MEDIUM."""
    df = saved(df)
    limits = small(with_quantiles(df, keys, value, {"threshold": (q, "linear")}).select(*keys, "threshold"))
    return _beside(df, keys, limits).filter(F.col(value) < F.col("threshold")).withColumn("severity", F.lit("MEDIUM"))


def above_deviations(df: DataFrame, keys: Sequence[str], value: str, k: float) -> DataFrame:
    """OL-SD: values above mean + k sample deviations, negative ones included, for keys of two values or more."""
    rows = saved(df.filter(F.col(value).isNotNull()))
    limits = rows.groupBy(*keys).agg((F.avg(value) + k * F.stddev_samp(value)).alias("threshold"))
    return _beside(rows, keys, small(limits)).filter(F.col(value) > F.col("threshold")).withColumn("value_", F.col(value)).withColumn("severity", _severity()).drop("value_")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """BN-03: the value at rank ceil(q n) of each key that has values."""
    return with_quantiles(saved(df.filter(F.col(value).isNotNull())), keys, value, {"rank_value": (q, "nearest")}).select(*keys, "rank_value")


def histogram(df: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """TM-23: equal bins between least and greatest, edges to 2 decimals, half-open; the last one closed."""
    ends = df.filter(F.col(value).isNotNull()).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    edges = ends.filter("lo is not null").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi").select("bin", F.round(F.col("lo") + F.col("bin") * step, 2).alias("bin_start"), F.round(F.col("lo") + (F.col("bin") + 1) * step, 2).alias("bin_end"))
    v = F.col(value)
    inside = (v >= F.col("bin_start")) & ((v < F.col("bin_end")) | ((F.col("bin") == bins - 1) & (v == F.col("bin_end"))))
    hits = df.select(value).join(F.broadcast(edges), inside).groupBy("bin").count()  # at most ``bins`` rows are broadcast
    return edges.join(hits, "bin", "left").select("bin", "bin_start", "bin_end", F.coalesce("count", F.lit(0)).alias("n")).orderBy("bin")


def page(df: DataFrame, order: Sequence[Column | str], skip: int, limit: int, *, total: bool = False) -> DataFrame:
    """TM-26: one page in order; with ``total``, each row has the number of all rows."""
    rows = df.orderBy(*order).offset(skip).limit(limit)
    return rows.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))) if total else rows  # one row
