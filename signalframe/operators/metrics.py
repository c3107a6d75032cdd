"""Time-series operators over ``samples`` (see ``schemas.SAMPLES``).

A group is a set of label values; a label that a series lacks counts as empty
for grouping, and is left out of the group's labels.  ``NaN`` stands for what
can't be computed until ``finish`` turns it into null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import matcher
from ..functions.values import nan_to_null

POINTWISE = ("abs", "ceil", "floor", "sqrt")
TEMPORAL = ("rate", "increase", "irate", "delta")
SIMPLE = ("sum", "avg", "min", "max", "count", "last")
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
NAN = float("nan")
TICKS_PER_SECOND = {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}


def select_series(samples: DataFrame, metric: str, matchers: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """The samples of the matching series: all filters reach the scan."""
    out = samples.where(F.col("metric") == metric)
    for key, op, value in matchers:
        out = out.where(matcher("labels", key, op, value))
    return out


def in_range(samples: DataFrame, start: int, end: int) -> DataFrame:
    """Both ends belong to the range."""
    return samples.where(F.col("ts_ns").between(start, end))


def series_dimension(samples: DataFrame) -> DataFrame:
    return samples.select("series_id", "metric", "labels").dropDuplicates(["series_id"])


def with_group(samples: DataFrame, by: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """Adds the columns g0, g1, ... of the group's label values (none: one group of all)."""
    names = [f"g{i}" for i in range(len(by or ()))]
    return samples.withColumns({n: F.coalesce(F.element_at("labels", F.lit(k)), F.lit("")) for n, k in zip(names, by or (), strict=True)}), names


def group_labels(names: Sequence[str], by: Sequence[str] | None, metric: str) -> Column:
    """The labels of a group: the metric's name and its values, less the empty ones."""
    pairs: list[Column] = [F.lit("__name__"), F.lit(metric)]
    for n, k in zip(names, by or (), strict=True):
        pairs += [F.lit(k), F.col(n)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")


def pointwise(samples: DataFrame, fn: str) -> DataFrame:
    f = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt}[fn]
    v = F.col("value")
    # NaN and infinity have no whole number; they stay as they are
    out = F.when(F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(f(v).cast("double")) if fn in ("ceil", "floor") else f(v)
    return samples.withColumn("value", out)


def temporal(samples: DataFrame, fn: str, unit: str = "ns") -> DataFrame:
    """Each sample against the one before it in its series; the first has none and is NaN."""
    w = W.partitionBy("series_id").orderBy("ts_ns", "seq")
    v, before = F.col("value"), F.lag("value").over(w)
    change = v - before
    grown = F.when(change >= 0, change).otherwise(v)
    seconds = (F.col("ts_ns") - F.lag("ts_ns").over(w)) / F.lit(TICKS_PER_SECOND[unit])
    if fn == "delta":
        out = change
    elif fn == "increase":
        out = grown
    elif fn in ("rate", "irate"):
        out = F.when(seconds > 0, grown / F.nullif(seconds, F.lit(0.0))).otherwise(NAN)
    else:
        raise ValueError(f"unknown transform {fn!r}")
    return samples.withColumn("value", F.when(before.isNull(), NAN).otherwise(out))


def fold(fn: str, value: str = "value") -> Column:
    """The aggregate of a bucket.  NaN makes sums and averages NaN, and is passed over by min and max."""
    v = F.col(value)
    if fn in PERCENTILES:
        return F.expr(f"percentile_disc({PERCENTILES[fn]}) WITHIN GROUP (ORDER BY `{value}`)")
    return {
        "sum": F.sum(v),
        "avg": F.avg(v),
        "min": F.min(nan_to_null(v)),
        "max": F.max(nan_to_null(v)),
        "count": F.count(v).cast("double"),
        "last": F.max_by(v, F.struct("ts_ns", "seq")),
    }[fn]


def fold_temporal(fn: str, unit: str = "ns") -> Column:
    """rate, increase and delta of a bucket from its first and last sample; under two samples NaN."""
    order = F.struct("ts_ns", "seq")
    # of equally late samples the later scanned is last; of equally early ones the earlier is first
    first, last = F.min_by("value", order), F.max_by("value", order)
    change = last - first
    grown = F.when(change >= 0, change).otherwise(last)
    seconds = (F.max("ts_ns") - F.min("ts_ns")) / F.lit(TICKS_PER_SECOND[unit])
    out = {"delta": change, "increase": grown, "rate": F.when(seconds > 0, grown / F.nullif(seconds, F.lit(0.0))).otherwise(NAN)}[fn]
    return F.when(F.count("value") < 2, NAN).otherwise(out)


def bucketed_irate(samples: DataFrame, keys: Sequence[str], unit: str = "ns") -> DataFrame:
    """irate of each bucket from its two latest distinct times; ``samples`` has the column bucket."""
    per_time = samples.groupBy(*keys, "bucket", "ts_ns").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    order = W.partitionBy(*keys, "bucket").orderBy(F.desc("ts_ns"))
    two = per_time.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    at = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    change = at("value", 1) - at("value", 2)
    seconds = (at("ts_ns", 1) - at("ts_ns", 2)) / F.lit(TICKS_PER_SECOND[unit])
    value = F.when(F.count("*") < 2, NAN).otherwise(F.when(change >= 0, change).otherwise(at("value", 1)) / seconds)
    return two.groupBy(*keys, "bucket").agg(value.alias("value"))


def dense(buckets: DataFrame, grid: DataFrame, keys: Sequence[str], fn: str) -> DataFrame:
    """``buckets`` on all rows of ``grid`` (keys, bucket): sums and counts of nothing are 0, else NaN."""
    empty = 0.0 if fn in ("sum", "count") else NAN
    out = grid.join(buckets.withColumn("there", F.lit(True)), [*keys, "bucket"], "left")
    return out.select(*keys, "bucket", F.when(F.col("there"), F.col("value")).otherwise(empty).alias("value"))


def step_from_start(samples: DataFrame, groups: DataFrame, keys: Sequence[str], fn: str, start: int, end: int, step: int) -> DataFrame:
    """Buckets anchored at the query's start, one for every step of the range and every group."""
    buckets = samples.withColumn("bucket", F.lit(start) + F.expr(f"(ts_ns - {start}L) div {step}L") * F.lit(step)).groupBy(*keys, "bucket").agg(fold(fn).alias("value"))
    grid = groups.select(*keys, F.explode(F.sequence(F.lit(start), F.lit(start + (end - start) // step * step), F.lit(step))).alias("bucket"))
    return dense(buckets, grid, keys, fn)


def step_from_data(samples: DataFrame, keys: Sequence[str], fn: str, step: int, unit: str = "ns") -> DataFrame:
    """Buckets anchored at the first sample of each group and ending with its last one."""
    bounds = samples.groupBy(*keys).agg(F.min("ts_ns").alias("anchor"), F.max("ts_ns").alias("end"))
    both = samples.join(bounds.select(*keys, "anchor"), list(keys)) if keys else samples.crossJoin(F.broadcast(bounds.select("anchor")))
    both = both.withColumn("bucket", F.col("anchor") + F.expr(f"(ts_ns - anchor) div {step}L") * F.lit(step))
    if fn == "irate":
        buckets = bucketed_irate(both, keys, unit)
    else:
        buckets = both.groupBy(*keys, "bucket").agg((fold_temporal(fn, unit) if fn in TEMPORAL else fold(fn)).alias("value"))
    grid = bounds.where("anchor is not null").select(*keys, F.explode(F.sequence("anchor", "end", F.lit(step))).alias("bucket"))
    return dense(buckets, grid, keys, fn)


def positional(samples: DataFrame, keys: Sequence[str], fn: str) -> DataFrame:
    """Aggregates the i-th samples of a group's series; times are those of the longest series (of equals the first seen)."""
    order = W.partitionBy("series_id").orderBy("ts_ns", "seq")
    own = W.partitionBy("series_id")
    rows = samples.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(own), "born": F.min("seq").over(own)})
    longest = rows.groupBy(*keys).agg(F.max(F.struct("n", -F.col("born"))).alias("longest"))
    rows = rows.join(longest, list(keys)) if keys else rows.crossJoin(F.broadcast(longest))
    base = F.struct("n", -F.col("born")) == F.col("longest")
    at = F.max(F.when(base, F.col("ts_ns")))
    value = F.max_by("value", "born") if fn == "last" else fold(fn)
    return rows.groupBy(*keys, "i").agg(at.alias("bucket"), value.alias("value")).drop("i")


def resolve_step(step: int | None, start: int, end: int, max_points: int | None, unit: str = "ns") -> int | None:
    """The larger of the given step and the one that gives ``max_points``; without a step, one under a millisecond means raw."""
    if not max_points:
        return step
    if max_points < 2 or end <= start:
        derived = max(1, end - start)
    else:
        derived = -(-(end - start) // (max_points - 1))
    if step is None:
        return None if derived < TICKS_PER_SECOND[unit] / 1000 else derived
    return max(step, derived)


def chunk_stats(samples: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """min, max, sum, count, first, last, sum of squares and resets of each key."""
    w = W.partitionBy(*keys).orderBy("ts_ns", "seq")
    rows = samples.withColumn("reset", (F.col("value") < F.lag("value").over(w)).cast("long"))
    order, v = F.struct("ts_ns", "seq"), F.col("value")
    return rows.groupBy(*keys).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum("value").alias("sum_value"), F.count("*").alias("n"),
        F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), F.sum(v * v).alias("sum_of_squares"),
        F.coalesce(F.sum("reset"), F.lit(0)).alias("resets"),
    )


def merge_partitions(parts: Sequence[DataFrame]) -> DataFrame:
    """Samples of several partitions as one: of samples of one series and time that of the later (higher) partition wins."""
    out = None
    for priority, part in enumerate(parts):
        rows = part.withColumn("priority", F.lit(priority))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("there are no partitions")
    best = out.groupBy("series_id", "ts_ns").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("series_id", "ts_ns")]), F.struct("priority", "seq")).alias("x"))
    return best.select("series_id", "ts_ns", *[F.col(f"x.{c}") for c in out.columns if c not in ("series_id", "ts_ns", "priority")])


def quantised(samples: DataFrame, digits: int, half_even: bool = False) -> DataFrame:
    """Values rounded at ingest; whole numbers are left alone."""
    v, scale = F.col("value"), 10.0**digits
    rounded = F.bround(v, digits) if half_even else F.floor(v * scale + 0.5) / scale
    return samples.withColumn("value", F.when(F.isnan(v) | (F.abs(v) > 9e15) | (v == F.floor(v)), v).otherwise(rounded))


def metadata(samples: DataFrame) -> DataFrame:
    """Each metric's labels with their numbers of values, series and samples, best to group by first: few values, many series."""
    each = samples.select("metric", "series_id", F.explode("labels").alias("label", "label_value"))
    return each.groupBy("metric", "label").agg(F.countDistinct("label_value").alias("n_values"), F.countDistinct("series_id").alias("n_series"), F.count("*").alias("n_samples"))


def counter_like(metric: str | Column) -> Column:
    m = F.col(metric) if isinstance(metric, str) else metric
    return m.rlike(r"(_total|_count|_sum|_bucket|\.total|\.count)$")


def rollup(samples: DataFrame, interval: int) -> DataFrame:
    """Statistics of each series and interval (aligned to the epoch): what whole buckets of a step can be answered from without the samples.

    Values that are NaN make the sum NaN and are passed over by least and greatest.
    """
    order = F.struct("ts_ns", "seq")
    slot = (F.col("ts_ns") - F.pmod("ts_ns", F.lit(interval))).alias("slot")
    return samples.groupBy("metric", "series_id", slot).agg(
        F.any_value("labels").alias("labels"), F.min(nan_to_null("value")).alias("min_value"), F.max(nan_to_null("value")).alias("max_value"), F.sum("value").alias("sum_value"),
        F.count("value").alias("n"), F.count("*").alias("n_rows"), F.max_by("value", order).alias("last_value"), F.max(order).alias("last_at"),
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
    )


def step_from_rollup(rolled: DataFrame, samples: DataFrame, interval: int, keys: Sequence[str], fn: str, start: int, end: int, step: int) -> DataFrame:
    """The sparse buckets of ``step_from_start``, of intervals that lie in one bucket from ``rolled``, of all others from ``samples``.

    ``rolled`` and ``samples`` hold the group columns ``keys``.  Where step and start
    are multiples of the interval, the samples are read at the range's end only, or
    not at all.
    """
    if fn not in ("sum", "avg", "min", "max", "count"):
        raise ValueError(f"{fn!r} can't be answered from a rollup")
    bucket = lambda c: F.lit(start) + F.expr(f"({c} - {start}L) div {step}L") * F.lit(step)
    inside = (F.col("slot") >= start) & (F.col("slot") + interval - 1 <= end) & (bucket("slot") == bucket(f"(slot + {interval - 1}L)"))
    whole = rolled.where(inside).select(*keys, bucket("slot").alias("bucket"), "min_value", "max_value", "sum_value", "n")
    slot = F.col("ts_ns") - F.pmod("ts_ns", F.lit(interval))
    rest = samples.where(F.col("ts_ns").between(start, end))
    edges = rest.withColumn("slot", slot).where(~inside)
    own = edges.select(*keys, bucket("ts_ns").alias("bucket"), nan_to_null("value").alias("min_value"), nan_to_null("value").alias("max_value"), F.col("value").alias("sum_value"), F.col("value").isNotNull().cast("long").alias("n"))
    parts = whole.unionByName(own)
    value = {"sum": F.sum("sum_value"), "avg": F.sum("sum_value") / F.nullif(F.sum("n"), F.lit(0)), "min": F.min("min_value"), "max": F.max("max_value"), "count": F.sum("n").cast("double")}[fn]
    return parts.groupBy(*keys, "bucket").agg(value.alias("value"))


def topk(points: DataFrame, k: int, by: Sequence[str] = ("ts_ns",), largest: bool = True) -> DataFrame:
    """The ``k`` series of greatest (or least) value at each time; of equal ones those of the first series."""
    if k <= 0:
        raise ValueError("k is greater than 0")
    order = W.partitionBy(*by).orderBy(F.desc("value") if largest else F.asc("value"), "series_id")
    return points.where(nan_to_null("value").isNotNull()).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def from_vectors(rows: DataFrame) -> DataFrame:
    """Samples of rows (times, series), where series is an array of (series_id, values): each series' values stand at the shared times."""
    each = rows.select("times", F.explode("series").alias("s"))
    return each.select(F.col("s.series_id").alias("series_id"), F.explode(F.arrays_zip("times", F.col("s.values").alias("values"))).alias("p")).select("series_id", F.col("p.times").alias("ts_ns"), F.col("p.values").alias("value"))


def accounted(frame: DataFrame, scanned: DataFrame) -> DataFrame:
    """(scanned_series, scanned_samples, emitted): what a query read and what it gave."""
    seen = scanned.agg(F.countDistinct("series_id").alias("scanned_series"), F.count("*").alias("scanned_samples"))
    return seen.crossJoin(F.broadcast(frame.agg(F.count("*").alias("emitted"))))


def observed(samples: DataFrame, name: str, observation=None) -> DataFrame:
    """``samples`` that count themselves while a query reads them: ``scanned_samples`` of an Observation (or of the query's metrics under ``name``), at no extra scan."""
    return samples.observe(name if observation is None else observation, F.count("*").alias("scanned_samples"))


def group_by_advice(meta: DataFrame) -> DataFrame:
    """(metric, label, score, rank): the labels of ``metadata`` best to group by first; those with one value, or a value for each series, come last."""
    score = F.when(F.col("n_values") <= 1, 0.0).when(F.col("n_values") >= F.col("n_series"), 1.0 / F.col("n_values")).otherwise(F.col("n_series") / F.col("n_values"))
    return meta.select("metric", "label", score.alias("score"), F.row_number().over(W.partitionBy("metric").orderBy(F.desc(score), "label")).alias("rank"))


def suggested_step(start: int, end: int, points: int = 120, unit: str = "ns") -> int:
    """A round step (1, 2, 5, 10, 15 or 30 seconds, minutes or so on) that gives about ``points`` buckets at most."""
    second = int(TICKS_PER_SECOND[unit])
    steps = [n * m * second for m in (1, 60, 3600) for n in (1, 2, 5, 10, 15, 30)] + [n * 3600 * second for n in (1, 6, 12, 24, 24 * 7)]
    wanted = max(1, -(-(end - start) // points))
    return min((s for s in steps if s >= wanted), default=max(steps))
