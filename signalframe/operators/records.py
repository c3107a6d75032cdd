"""Helpers over telemetry records of any signal, and the frames that views show.

A record has signal, name, ts_ns (null if unknown), value, attributes, resource,
scope and seq.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import matches_value
from ..functions.values import canonical_key, finite, iso_text
from ..storage import materialised

REDUCERS = ("sum", "avg", "min", "max", "last", "count")


def record_filter(*, signal: str | None = None, from_ns: int | None = None, to_ns: int | None = None, name: object = None, trace_id: str | None = None, resource: Mapping[str, object] | None = None, attributes: Mapping[str, object] | None = None, scope: object = None) -> Column:
    """A condition on records; both ends of the range count, and records without a time pass it."""
    out = F.lit(True)
    if signal is not None:
        out = out & (F.col("signal") == signal)
    if from_ns is not None:
        out = out & (F.col("ts_ns").isNull() | (F.col("ts_ns") >= from_ns))
    if to_ns is not None:
        out = out & (F.col("ts_ns").isNull() | (F.col("ts_ns") <= to_ns))
    if trace_id is not None:
        out = out & F.coalesce(F.col("trace_id") == trace_id, F.lit(False))
    out = out & matches_value("name", name)
    if scope is not None:
        out = out & matches_value("scope_name", scope)
    for column, wanted in (("resource", resource), ("attributes", attributes)):
        for key, value in (wanted or {}).items():
            out = out & matches_value(F.element_at(column, F.lit(key)), value)
    return out


def split_key(by: str | None, default: str = "unknown") -> Column:
    """The series of a record by resource.<key>, scope.name or <key> of its attributes."""
    if by is None:
        return F.lit("all")
    if by.startswith("resource."):
        found = F.element_at("resource", F.lit(by.removeprefix("resource.")))
    elif by == "scope.name":
        found = F.col("scope_name")
    else:
        found = F.element_at("attributes", F.lit(by.removeprefix("attributes.")))
    return F.coalesce(found, F.lit(default))


def bucket_series(records: DataFrame, interval_ns: int, reduce: str = "avg", key: Column | None = None) -> DataFrame:
    """(key, bucket_ns, value): sparse buckets from the epoch on; values that are null or NaN are passed over, and last is the last to arrive."""
    if reduce not in REDUCERS:
        raise ValueError(f"a reducer is one of {', '.join(REDUCERS)}")
    if interval_ns <= 0:
        raise ValueError("an interval is greater than 0")
    rows = records.withColumn("key", key if key is not None else F.lit("all")).where(F.col("ts_ns").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    value = {"last": F.max_by("value", "seq"), "count": F.count("*").cast("double")}.get(reduce)
    if value is None:
        value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[reduce]("value")
    return rows.groupBy("key", (F.col("ts_ns") - F.pmod("ts_ns", F.lit(interval_ns))).alias("bucket_ns")).agg(value.alias("value"))


def latest_by(records: DataFrame, key: Column) -> DataFrame:
    """The latest record of each key; of equally late ones the first to arrive, and no time counts as 0."""
    rows = records.withColumn("key", key)
    order = F.struct(F.coalesce("ts_ns", F.lit(0)), -F.col("seq"))
    best = rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), order).alias("r"))
    return best.select("key", *[F.col(f"r.{c}") for c in rows.columns if c != "key"])


def latest_values(records: DataFrame, key: Column, limit: int | None = None) -> DataFrame:
    """Each key's latest value, largest first; values that are not finite are left out."""
    out = latest_by(records, key).withColumn("value", finite("value")).where("value is not null").select("key", "ts_ns", "value")
    out = out.orderBy(F.desc("value"), "key")
    return out if limit is None else out.limit(limit)


def histogram(values: DataFrame, bins: int = 10, column: str = "value") -> DataFrame:
    """(bin, low, high, n): bins of equal width from the least to the greatest value, which falls in the last; of one value alone the width is 1."""
    if bins < 1:
        raise ValueError("a histogram has a bin at least")
    v = values.select(finite(column).alias("v")).where("v is not null")
    bounds = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    bounds = F.broadcast(bounds.select("lo", width.alias("w")))
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - F.col("lo")) / F.col("w")))).cast("int")
    counts = v.crossJoin(bounds).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    grid = bounds.select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def merge_frames(old: DataFrame, new: DataFrame, keep_existing: bool = False) -> DataFrame:
    """Points (key, bucket_ns, value) of both; where both have one, the new one's (or the old one's)."""
    a, b = old.withColumnRenamed("value", "old"), new.withColumnRenamed("value", "new")
    value = F.coalesce("old", "new") if keep_existing else F.coalesce("new", "old")
    return a.join(b, ["key", "bucket_ns"], "full").select("key", "bucket_ns", value.alias("value"))


def wide(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each time with a column for each of ``keys``; times without a value have null."""
    return points.groupBy("bucket_ns").pivot("key", list(keys)).agg(F.first("value", ignorenulls=True))


def event_timeline(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """(source, ts_ns, name, trace_id): log records and span events by time; no time comes first, as 0."""
    own = logs.select(F.lit("log").alias("source"), F.col("time_ns").alias("ts_ns"), F.col("body").alias("name"), "trace_id", "seq")
    events = spans.select("trace_id", "seq", F.explode("events").alias("e")).select(F.lit("span").alias("source"), F.col("e.time_ns").alias("ts_ns"), F.col("e.name").alias("name"), "trace_id", "seq")
    return own.unionByName(events).orderBy(F.coalesce("ts_ns", F.lit(0)), "source", "seq")


def retained(records: DataFrame, max_age_ns: int | None = None, max_points: int | None = None) -> DataFrame:
    """What a store keeps: per signal what is not older than the newest by more than ``max_age_ns`` (no time: kept), then the last ``max_points`` to arrive."""
    out = records
    if max_age_ns is not None:
        newest = F.broadcast(records.groupBy("signal").agg(F.max("ts_ns").alias("newest")))
        out = out.join(newest, "signal").where(F.col("ts_ns").isNull() | F.col("newest").isNull() | (F.col("ts_ns") >= F.col("newest") - max_age_ns)).drop("newest")
    if max_points is not None:
        signals = [r.signal for r in out.select("signal").distinct().collect()]  # three at most
        parts = [out.where(F.col("signal").eqNullSafe(s)).orderBy(F.desc("seq")).limit(max_points) for s in signals]
        out = reduce(DataFrame.unionByName, parts) if parts else out
    return out


def evicted(rows: DataFrame, max_bytes: int, size: Column, unit: Column, at: Column) -> DataFrame:
    """What a store with room for ``max_bytes`` keeps: whole units (traces, chunks), the newest first, as long as they fit; the oldest go first.

    Sizes are summed in units, which are ordered by range and prefix-summed part by
    part, so no task sees them all.
    """
    units = rows.groupBy(unit.alias("unit")).agg(F.sum(size).alias("bytes"), F.max(at).alias("newest"))
    placed = units.repartitionByRange(F.desc("newest"), F.desc("unit")).withColumn("part", F.spark_partition_id())
    placed = materialised(placed)
    parts = F.broadcast(placed.groupBy("part").agg(F.sum("bytes").alias("total")))  # one row for each part
    before = parts.select(F.col("part").alias("other"), F.col("total").alias("other_total"))
    offsets = parts.join(before, F.col("other") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("other_total"), F.lit(0)).alias("offset"))
    own = F.sum("bytes").over(W.partitionBy("part").orderBy(F.desc("newest"), F.desc("unit")))
    kept = placed.withColumn("within", own).join(F.broadcast(offsets), "part").where(F.col("within") + F.col("offset") <= max_bytes)
    return rows.withColumn("unit", unit).join(kept.select("unit"), "unit", "left_semi").drop("unit")


def thinned(points: DataFrame, max_points: int) -> DataFrame:
    """At most ``max_points`` of each key's points at an even stride, the last one always."""
    order = W.partitionBy("key").orderBy("bucket_ns")
    rows = points.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(W.partitionBy("key"))})
    # i is picked where it is floor(j * n / max_points) for some j, and n - 1 takes the last one's place
    j = F.ceil(F.col("i") * max_points / F.col("n"))
    picked = (F.floor(j * F.col("n") / max_points) == F.col("i")) & (j < max_points)
    last_j = F.floor(F.lit(max_points - 1) * F.col("n") / max_points)
    keep = (F.col("n") <= max_points) | (F.col("i") == F.col("n") - 1) | (picked & (F.col("i") != last_j))
    return rows.where(keep).drop("i", "n")


def tail(points: DataFrame, n: int) -> DataFrame:
    """The last ``n`` points of each key."""
    return points.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("bucket_ns")))).where(F.col("r") <= n).drop("r")


def extremes(points: DataFrame, chunks: int, max_points: int | None = None) -> DataFrame:
    """For each key and chunk of its points the first, last, least and greatest; of more than ``max_points`` in all, those at an even stride."""
    order = W.partitionBy("key").orderBy("bucket_ns")
    rows = points.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(W.partitionBy("key"))}).withColumn("chunk", F.floor(F.col("i") * chunks / F.col("n")))
    p = F.struct("bucket_ns", "value")
    g = rows.groupBy("key", "chunk").agg(F.array_distinct(F.array(F.min_by(p, "i"), F.max_by(p, "i"), F.min_by(p, F.struct("value", "i")), F.max_by(p, F.struct("value", "i")))).alias("p"))
    out = g.select("key", F.explode("p").alias("p")).select("key", "p.bucket_ns", "p.value")
    return out if max_points is None else thinned(out, max_points)


def correlate(records: DataFrame, windows: DataFrame) -> DataFrame:
    """(trace_id, n, avg_value) of the records in each of ``windows`` (trace_id, from_ns, to_ns), ends included.

    A range join without a slot size to choose: the whole slots of 2**20 ns inside a
    window are cut into the fewest aligned ones of 1, 2, 4, ... times that (about twice
    the log of its length), which meet the sums of their records; only records of the
    slots of a window's two ends are met one by one.  So the work grows with records
    and windows, not with the pairs of them.
    """
    w = windows.where("from_ns <= to_ns").withColumns({"a": F.shiftright("from_ns", 20) + 1, "b": F.shiftright("to_ns", 20) - 1})
    # the slots of level k: an odd left end, and an even right end, as in a segment tree
    levels = F.sequence(F.lit(0), F.lit(43))
    steps = F.aggregate(
        levels,
        F.struct("a", "b", F.array().cast("array<struct<level:int,slot:bigint>>").alias("out")),
        lambda s, k: F.struct(
            F.when(s["a"] > s["b"], s["a"]).otherwise(F.shiftright(s["a"] + 1, 1)).alias("a"),
            F.when(s["a"] > s["b"], s["b"]).otherwise(F.shiftright(s["b"] + 1, 1) - 1).alias("b"),
            F.when(s["a"] > s["b"], s["out"]).otherwise(
                F.array_distinct(F.array_compact(F.concat(s["out"], F.array(
                    F.when(F.pmod(s["a"], F.lit(2)) == 1, F.struct(k.cast("int").alias("level"), s["a"].alias("slot"))),
                    F.when(F.pmod(s["b"], F.lit(2)) == 0, F.struct(k.cast("int").alias("level"), s["b"].alias("slot"))),
                ))))
            ).alias("out"),
        ),
        lambda s: s["out"],
    )
    inner = w.withColumn("s", F.explode(steps)).select("trace_id", "s.level", "s.slot")
    met = F.broadcast(inner.select("level").distinct())  # 44 at most
    rows = records.where("ts_ns is not null").select("ts_ns", "value", F.shiftright("ts_ns", 20).alias("base"))
    least = rows.groupBy("base").agg(F.count("*").alias("n"), F.count("value").alias("valued"), F.sum("value").alias("total"))
    cells = least.crossJoin(met).groupBy("level", F.expr("shiftright(base, level)").alias("slot")).agg(*[F.sum(c).alias(c) for c in ("n", "valued", "total")])
    whole = inner.join(cells, ["level", "slot"]).select("trace_id", "n", "valued", "total")
    ends = F.explode(F.array_distinct(F.array(F.shiftright("from_ns", 20), F.shiftright("to_ns", 20)))).alias("base")
    edges = windows.where("from_ns <= to_ns").select("trace_id", "from_ns", "to_ns", ends).join(rows, "base").where("ts_ns between from_ns and to_ns")
    parts = whole.unionByName(edges.select("trace_id", F.lit(1).cast("long").alias("n"), F.col("value").isNotNull().cast("long").alias("valued"), F.col("value").alias("total")))
    return parts.groupBy("trace_id").agg(F.sum("n").alias("n"), (F.sum("total") / F.nullif(F.sum("valued"), F.lit(0))).alias("avg_value"))


COMMON = ("signal", "name", "ts_ns", "value", "attributes", "resource", "scope_name", "seq")


def point_value() -> Column:
    """A point's number: its own, or sum over count where it counts something; of no count, null."""
    mean = F.when(F.col("count") > 0, F.col("sum") / F.nullif("count", F.lit(0.0)))
    return F.when(F.col("kind").isin("gauge", "sum"), F.col("value")).otherwise(mean)


def from_points(points: DataFrame) -> DataFrame:
    """Records of metric points: time is the point's, else its start."""
    return points.select(F.lit("metrics").alias("signal"), "name", F.coalesce("ts_ns", "start_ns").alias("ts_ns"), point_value().alias("value"), "attributes", "resource", "scope_name", F.col("ordinal.seq").alias("seq"))


def from_spans(spans: DataFrame) -> DataFrame:
    """Records of spans: the value is the duration in whole milliseconds."""
    scope = F.col("scope_name") if "scope_name" in spans.columns else F.lit(None).cast("string")
    return spans.select(F.lit("traces").alias("signal"), "name", F.coalesce("start_ns", "end_ns").alias("ts_ns"), F.expr("duration_ns div 1000000").cast("double").alias("value"), "attributes", "resource", scope.alias("scope_name"), "seq")


def from_logs(logs: DataFrame) -> DataFrame:
    """Records of logs: they have neither name nor value."""
    observed = F.coalesce("time_ns", "observed_ns") if "observed_ns" in logs.columns else F.col("time_ns")
    scope = F.col("scope_name") if "scope_name" in logs.columns else F.lit(None).cast("string")
    return logs.select(F.lit("logs").alias("signal"), F.lit(None).cast("string").alias("name"), observed.alias("ts_ns"), F.lit(None).cast("double").alias("value"), "attributes", "resource", scope.alias("scope_name"), "seq")


def collected(*inputs: DataFrame | Sequence[DataFrame]) -> DataFrame:
    """One table of records, points, spans and logs, or of nested lists of them; each is told by its columns."""
    out = None
    for x in inputs:
        if not isinstance(x, DataFrame):
            rows = collected(*x)
        elif set(COMMON) <= set(x.columns):
            rows = x.select(*COMMON)
        elif "ordinal" in x.columns and "kind" in x.columns and "quantiles" in x.columns:
            rows = from_points(x)
        elif "span_id" in x.columns and "duration_ns" in x.columns:
            rows = from_spans(x)
        elif "severity_number" in x.columns:
            rows = from_logs(x)
        else:
            raise ValueError(f"not a table of records, points, spans or logs: {', '.join(x.columns)}")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("there is nothing to collect")
    return out


def series_key() -> Column:
    """The default series of a record: its name (or signal), and its attributes as JSON by key."""
    base = F.coalesce("name", "signal")
    return F.when(F.size("attributes") > 0, F.concat(base, F.lit(":"), canonical_key("attributes"))).otherwise(base)


def series_label() -> Column:
    """name (k=v, ...) of a record, by key."""
    base = F.coalesce("name", "signal")
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ", ")
    return F.when(F.size("attributes") > 0, F.concat(base, F.lit(" ("), pairs, F.lit(")"))).otherwise(base)


def align(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(x, baseline, current) of two curves of (x, y): every x of either, with null where a side has none."""
    return baseline.select("x", F.col("y").alias("baseline")).join(current.select("x", F.col("y").alias("current")), "x", "full")


def partition_by(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that meet the condition, and all others (also where it is null)."""
    met = F.coalesce(condition, F.lit(False))
    return rows.where(met), rows.where(~met)


def distinct_tags(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, tag_value) met, each once."""
    return rows.select(F.explode(tags).alias("tag", "tag_value")).distinct()


def line_series(points: DataFrame) -> DataFrame:
    """(labels, series_id, points) of a chart of lines: points (time_ms, value) by time, values that are not finite are null."""
    p = F.struct((F.col("ts_ns") / 1_000_000).alias("time_ms"), finite("value").alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts_ns", "seq", p.alias("p")))), lambda x: x["p"])
    return points.groupBy("series_id").agg(F.any_value("labels").alias("labels"), ordered.alias("points"))


def chart_rows(points: DataFrame) -> DataFrame:
    """The tidy rows that any chart library reads: (id, label, time_ms, iso_time, value)."""
    return points.select(F.col("key").alias("id"), F.col("key").alias("label"), (F.col("bucket_ns") / 1_000_000).alias("time_ms"), iso_text("bucket_ns").alias("iso_time"), finite("value").alias("value"))


def whole_safe(ns: str) -> Column:
    """The number as text where a double can't hold it, else null: what a view must not read as a number."""
    return F.when(F.abs(F.col(ns)) > 9_007_199_254_740_991, F.col(ns).cast("string"))


def latest_rows(latest: DataFrame) -> DataFrame:
    """(id, label, value) of the keys that have a latest value."""
    return latest.where(finite("value").isNotNull()).select(F.col("key").alias("id"), F.col("key").alias("label"), "value")


def gauge_value(latest: DataFrame, low: float = 0.0, high: float = 200.0) -> DataFrame:
    """One number for a gauge: the mean of the latest values, kept within ``low`` and ``high`` and rounded; 0 without any."""
    mean = F.coalesce(F.avg(finite("value")), F.lit(0.0))
    return latest.agg(F.floor(F.greatest(F.lit(low), F.least(F.lit(high), mean)) + 0.5).cast("long").alias("gauge"))


def histogram_rows(bins: DataFrame) -> DataFrame:
    """(label, start, end, count) of ``histogram``."""
    return bins.select(F.concat(F.round("low", 3).cast("string"), F.lit(" to "), F.round("high", 3).cast("string")).alias("label"), F.col("low").alias("start"), F.col("high").alias("end"), F.col("n").alias("count"))
