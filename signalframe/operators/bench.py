"""Benchmark histories over ``bench_points`` (see ``schemas.BENCH_POINTS``)."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import round_half_up

BIGGER, SMALLER = "bigger_is_better", "smaller_is_better"
MONITOR = "_monitor/"
MAX_LANES = 10_000
#: Parts of units whose values are better when bigger, in the two dialects of benchmark parsers, and those better when smaller in the lenient one.
BIGGER_UNITS = ("ops/s", "op/s", "/sec", "mb/s", "throughput", "events")
LENIENT_BIGGER_UNITS = ("ops/s", "rps", "throughput")
LENIENT_SMALLER_UNITS = ("ns/op", "ms/op", "s/op", "b/op", "allocs/op", "latency", "time")
UNIT_NAMES = {"B/op": "bytes_per_op", "MB/s": "mb_per_s", "ns/iter": "ns_per_iter"}
LENIENT_UNIT_NAMES = {"ns/op": "ns_per_op", "ms/op": "ms_per_op", "b/op": "bytes_per_op", "allocs/op": "allocs_per_op"}


def _has_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, p: a | text.contains(p), parts, F.lit(False))


def infer_direction(unit: str | Column, lenient: bool = False) -> Column:
    u = F.lower(F.col(unit) if isinstance(unit, str) else unit)
    if lenient:
        return F.when(_has_any(F.trim(u), LENIENT_SMALLER_UNITS), SMALLER).when(_has_any(F.trim(u), LENIENT_BIGGER_UNITS), BIGGER)
    return F.when(_has_any(u, BIGGER_UNITS), BIGGER).otherwise(SMALLER)


def metric_name(unit: str | Column, lenient: bool = False) -> Column:
    """A metric's name from its unit."""
    u = F.col(unit) if isinstance(unit, str) else unit
    if lenient:
        u = F.lower(F.trim(u))
        made = F.regexp_replace(F.replace(F.replace(u, F.lit("/"), F.lit("_per_")), F.lit("%"), F.lit("pct")), "[^a-z0-9_]+", "_")
        made, names = F.regexp_replace(made, "^_+|_+$", ""), LENIENT_UNIT_NAMES
    else:
        made, names = F.lower(F.regexp_replace(F.replace(u, F.lit("/"), F.lit("_per_")), r"\s+", "_")), UNIT_NAMES
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), u), made)


def tags_text(tags: str | Column = "tags") -> Column:
    """k=v pairs by key, joined by commas."""
    t = F.col(tags) if isinstance(tags, str) else tags
    return F.array_join(F.transform(F.array_sort(F.map_entries(t)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def lane_key() -> Column:
    """The lane that runs are compared in: scenario and tags."""
    return F.when(F.size("tags") > 0, F.concat("scenario", F.lit(" ["), tags_text(), F.lit("]"))).otherwise(F.col("scenario"))


def series_key() -> Column:
    """The name of a series: its own, else the scenario's, with the tags."""
    base = F.coalesce("series", "scenario")
    return F.when(F.size("tags") > 0, F.concat(base, F.lit(" ["), tags_text(), F.lit("]"))).otherwise(base)


def resolve_metric(scenario: str | Column = "scenario", metric: str | Column = "metric") -> Column:
    """The metric's name, after ``_monitor/`` for monitors' scenarios."""
    s, m = (F.col(x) if isinstance(x, str) else x for x in (scenario, metric))
    return F.when(s.startswith(MONITOR) & ~m.startswith(MONITOR), F.concat(F.lit(MONITOR), m)).otherwise(m)


def compare_runs(current: DataFrame, baseline: DataFrame, threshold: float = 5.0, keys: Sequence[str] = ("scenario", "series", "metric")) -> DataFrame:
    """Each current point against the mean of its baseline points: change in percent and improved, stable, regressed, or skipped where the mean is 0.

    Points without a baseline are left out.
    """
    tags = tags_text().alias("tags_text")
    base = baseline.select(*keys, tags, "value").groupBy(*keys, "tags_text").agg(F.avg("value").alias("baseline"))
    direction = F.coalesce("direction", infer_direction(F.when(F.coalesce("unit", F.lit("")) != "", F.col("unit")).otherwise(F.col("metric"))))
    now = current.select(*keys, tags, "unit", direction.alias("direction"), F.col("value").alias("current"))
    change = (F.col("current") - F.col("baseline")) / F.nullif("baseline", F.lit(0.0)) * 100
    worse = F.when(F.col("direction") == SMALLER, change > 0).otherwise(change < 0)
    status = F.when(F.col("baseline") == 0, "skipped").when(F.abs(change) <= threshold, "stable").when(worse, "regressed").otherwise("improved")
    return now.join(base, [*keys, "tags_text"]).select(*keys, "tags_text", "unit", "direction", "baseline", "current", round_half_up(change).alias("percent_change"), status.alias("status"))


def by_severity(comparison: DataFrame) -> DataFrame:
    """Regressions first, then the rest, each by the size of the change; of equal ones by name."""
    place = F.when(F.col("status") == "regressed", 0).when(F.col("status") == "improved", 1).otherwise(2)
    names = [c for c in ("scenario", "series", "metric", "tags_text") if c in comparison.columns]
    return comparison.orderBy(place, F.desc(F.abs("percent_change")), *names)


def matches(column: str | Column, rule: object) -> Column:
    """A matcher of a tag's value: a value, a list of values, or {eq, in, notIn, lt, lte, gt, gte}; the last four compare values that read as numbers."""
    v = F.col(column) if isinstance(column, str) else column
    if not isinstance(rule, Mapping):
        rule = {"in": rule} if isinstance(rule, (list, tuple)) else {"eq": rule}
    number = F.when(v.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(v).try_cast("double"))
    out = F.lit(True)
    for op, value in rule.items():
        texts = [str(x) for x in value] if isinstance(value, (list, tuple)) else None
        condition = {
            "eq": lambda x=value: v == str(x), "in": lambda t=texts: v.isin(t), "notIn": lambda t=texts: ~v.isin(t),
            "lt": lambda x=value: number < x, "lte": lambda x=value: number <= x, "gt": lambda x=value: number > x, "gte": lambda x=value: number >= x,
        }.get(op)
        if condition is None:
            raise ValueError(f"unknown matcher {op!r}")
        out = out & F.coalesce(condition(), F.lit(False))
    return out


def matrix(spark: SparkSession, observed: DataFrame, dimensions: Mapping[str, Sequence[str]], exclude: Sequence[Mapping[str, object]] = (), probe: Sequence[Mapping[str, object]] = ()) -> DataFrame:
    """Every combination of the dimensions' values but the excluded ones, with its class (required or probe) and its result.

    ``observed`` has a column for each dimension and status; a lane without
    observations is missing, one with a regression failed, else passed.
    """
    total = reduce(lambda a, values: a * len(values), dimensions.values(), 1)
    if total > MAX_LANES:
        raise ValueError(f"a matrix has at most {MAX_LANES} lanes, not {total}")
    lanes = spark.createDataFrame(list(itertools.product(*dimensions.values())), ", ".join(f"`{name}` string" for name in dimensions))
    any_of = lambda rules: reduce(lambda a, rule: a | reduce(lambda x, kv: x & matches(kv[0], kv[1]), rule.items(), F.lit(True)), rules, F.lit(False))
    lanes = lanes.where(~any_of(exclude)).withColumn("lane_class", F.when(any_of(probe), "probe").otherwise("required"))
    seen = observed.groupBy(*dimensions).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "regressed").alias("regressed"))
    result = F.when(F.col("n").isNull(), "missing").when(F.col("regressed") > 0, "failed").otherwise("passed")
    return F.broadcast(lanes).join(seen, list(dimensions), "left").select(*dimensions, "lane_class", F.coalesce("n", F.lit(0)).alias("n"), result.alias("result"))


def run_series(points: DataFrame) -> DataFrame:
    """One point per run, lane and metric: the average and, of several points, the range, to two digits."""
    return points.groupBy("run_id", "run_ts", "commit", lane_key().alias("lane"), resolve_metric().alias("metric")).agg(
        round_half_up(F.avg("value")).alias("value"), F.when(F.count("*") > 1, round_half_up(F.max("value") - F.min("value"))).alias("range"),
        F.min("unit").alias("unit"), F.min("direction").alias("direction"), F.count("*").alias("n"),
    )


def runs(points: DataFrame) -> DataFrame:
    return points.groupBy("run_id", "run_ts", "commit", "ref").agg(F.count("*").alias("n_points"), F.array_sort(F.collect_set(resolve_metric())).alias("metrics"))


def run_index(points: DataFrame, max_runs: int | None = None) -> DataFrame:
    """Runs, newest first; with ``max_runs`` the newest only."""
    out = runs(points).orderBy(F.desc("run_ts"), F.desc("run_id"))
    return out if max_runs is None else out.limit(max_runs)


def ref_index(points: DataFrame) -> DataFrame:
    """Each ref's latest run and number of runs, latest ref first."""
    r = runs(points).withColumn("ref", F.coalesce("ref", F.lit("unknown")))
    last = F.max_by(F.struct("run_id", "commit"), F.struct("run_ts", "run_id"))
    return r.groupBy("ref").agg(last.alias("r"), F.max("run_ts").alias("latest_ts"), F.count("*").alias("n_runs")).select("ref", F.col("r.run_id").alias("latest_run"), F.col("r.commit").alias("latest_commit"), "latest_ts", "n_runs").orderBy(F.desc("latest_ts"))


def pr_number(ref: str | Column = "ref") -> Column:
    r = F.col(ref) if isinstance(ref, str) else ref
    return F.regexp_extract(r, r"\Arefs/pull/(\d+)/merge\z", 1).try_cast("bigint")


def pr_index(points: DataFrame) -> DataFrame:
    r = runs(points).withColumn("pr", pr_number()).where("pr is not null")
    last = F.max_by(F.struct("run_id", "commit"), F.struct("run_ts", "run_id"))
    return r.groupBy("pr").agg(last.alias("r"), F.max("run_ts").alias("latest_ts"), F.count("*").alias("n_runs")).select("pr", F.col("r.run_id").alias("latest_run"), "latest_ts", "n_runs").orderBy(F.desc("latest_ts"))


def run_detail(points: DataFrame, run_id: str) -> DataFrame:
    """The metrics of a run with their values."""
    p = F.struct(lane_key().alias("lane"), "value")
    return points.where(F.col("run_id") == run_id).groupBy(resolve_metric().alias("metric")).agg(F.min("unit").alias("unit"), F.min("direction").alias("direction"), F.array_sort(F.collect_list(p)).alias("values"))


def metric_summary(series: DataFrame) -> DataFrame:
    """Each metric's number of lanes and its latest run."""
    return series.groupBy("metric").agg(F.countDistinct("lane").alias("n_lanes"), F.max("run_ts").alias("latest_ts"), F.max_by("run_id", F.struct("run_ts", "run_id")).alias("latest_run"), F.min("unit").alias("unit"))


def badges(series: DataFrame, band: float = 3.0) -> DataFrame:
    """Each metric's mean over the lanes of the latest run, and a colour against as many values before it."""
    s = series.where(~F.col("metric").startswith(MONITOR))
    order = W.partitionBy("metric").orderBy(F.desc("run_ts"), F.desc("run_id"), "lane")
    last = F.first("run_id").over(order)
    s = s.withColumn("is_last", F.col("run_id") == last)
    s = s.withColumns({"n_last": F.count_if("is_last").over(W.partitionBy("metric")), "place": F.row_number().over(W.partitionBy("metric", "is_last").orderBy(F.desc("run_ts"), F.desc("run_id"), "lane"))})
    g = s.groupBy("metric").agg(F.min("unit").alias("unit"), F.min("direction").alias("direction"), F.avg(F.when(F.col("is_last"), F.col("value"))).alias("latest"), F.avg(F.when(~F.col("is_last") & (F.col("place") <= F.col("n_last")), F.col("value"))).alias("previous"))
    change = (F.col("latest") - F.col("previous")) / F.nullif(F.abs("previous"), F.lit(0.0)) * 100
    better = F.when(F.col("direction") == SMALLER, change < 0).when(F.col("direction") == BIGGER, change > 0)
    colour = F.when(change.isNull() | (F.abs(change) < band) | better.isNull(), "blue").when(better, "brightgreen").otherwise("red")
    return g.select(F.replace("metric", F.lit("_"), F.lit(" ")).alias("label"), "latest", "unit", colour.alias("colour"))


def baseline_runs(points: DataFrame, n: int = 5, before: str | None = None) -> DataFrame:
    """The points of the ``n`` newest runs (before a run, where one is given)."""
    r = points.groupBy("run_id").agg(F.max("run_ts").alias("ts"))
    if before is not None:
        own = F.broadcast(r.where(F.col("run_id") == before).select(F.col("ts").alias("own")))
        r = r.join(own, r.ts < own.own, "left_semi")
    return points.join(F.broadcast(r.orderBy(F.desc("ts"), F.desc("run_id")).limit(n).select("run_id")), "run_id", "left_semi")


def rolling_regressions(series: DataFrame, threshold: float = 10.0, window: int = 5) -> DataFrame:
    """Points that are worse by ``threshold`` percent or more than the mean of the ``window`` points before them."""
    order = W.partitionBy("metric", "lane").orderBy("run_ts", "run_id")
    rows = series.withColumns({"i": F.row_number().over(order), "baseline": F.avg("value").over(order.rowsBetween(-window, -1))}).where(F.col("i") > window)
    change = (F.col("value") - F.col("baseline")) / F.nullif("baseline", F.lit(0.0)) * 100
    bigger = F.col("value") > F.col("baseline")
    bad = F.when(F.coalesce("direction", F.lit(SMALLER)) == SMALLER, bigger & (change >= threshold)).otherwise(~bigger & (F.abs(change) >= threshold))
    return rows.withColumn("percent_change", change).where(bad).select("metric", "lane", "run_id", "value", "baseline", "percent_change")


def latest_regressions(series: DataFrame, threshold: float = 10.0, window: int = 5) -> DataFrame:
    """Lanes whose latest point is worse by more than ``threshold`` percent than the mean of the ``window`` points before it; means of about 0 are passed over."""
    order = W.partitionBy("metric", "lane").orderBy("run_ts", "run_id")
    rows = series.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(W.partitionBy("metric", "lane")), "baseline": F.avg("value").over(order.rowsBetween(-window, -1))})
    rows = rows.where((F.col("i") == F.col("n")) & (F.col("n") > window) & (F.col("baseline") >= 1e-10))
    change = (F.col("value") - F.col("baseline")) / F.nullif("baseline", F.lit(0.0)) * 100
    bad = F.when(F.coalesce("direction", F.lit(SMALLER)) == SMALLER, change > threshold).otherwise(change < -threshold)
    return rows.withColumn("percent_change", change).where(bad).select("metric", "lane", "run_id", "value", "baseline", "percent_change")


def leaderboard(series: DataFrame) -> DataFrame:
    """Lanes of each metric by their latest value, the better first (unknown: the smaller); with the change from the value before."""
    order = W.partitionBy("metric", "lane").orderBy(F.desc("run_ts"), F.desc("run_id"))
    latest = series.withColumns({"r": F.row_number().over(order), "previous": F.lead("value").over(order)}).where("r = 1")
    better = F.when(F.col("direction") == BIGGER, -F.col("value")).otherwise(F.col("value"))
    place = F.row_number().over(W.partitionBy("metric").orderBy(better, "lane"))
    return latest.select("metric", "lane", "value", "previous", (F.col("value") - F.col("previous")).alias("delta"), place.alias("rank"), (place == 1).alias("is_winner"))


def normalised(series: DataFrame) -> DataFrame:
    """Values from 0 to 100 between the least and greatest of a lane; constant lanes are 50."""
    w = W.partitionBy("metric", "lane")
    low, high = F.min("value").over(w), F.max("value").over(w)
    return series.withColumn("value", F.when(high == low, 50.0).otherwise((F.col("value") - low) / F.nullif(high - low, F.lit(0.0)) * 100))


def aggregate_by_tag(points: DataFrame, tag: str, how: str = "avg") -> DataFrame:
    """Values of each run and tag value as one (sum, avg or max)."""
    f = {"sum": F.sum, "avg": F.avg, "max": F.max}[how]
    return points.groupBy("run_id", "metric", F.coalesce(F.element_at("tags", F.lit(tag)), F.lit("unknown")).alias("tag_value")).agg(f("value").alias("value"))


def in_dates(points: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    out = points
    if start is not None:
        out = out.where(F.col("run_ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("run_ts") <= F.lit(end).cast("timestamp_ntz"))
    return out


def too_few_points(points: DataFrame, least: int = 1) -> DataFrame:
    """The guard on a run's points: a row for each run with fewer than ``least``."""
    return points.groupBy("run_id").agg(F.count("value").alias("n")).where(F.col("n") < least)


def violations(points: DataFrame, required: Sequence[str] = ("run_id", "scenario", "metric"), directions: Sequence[str] = (BIGGER, SMALLER), roles: Sequence[str] = ("outcome", "diagnostic")) -> DataFrame:
    """(run_id, scenario, metric, problem): points that break the contract."""
    checks = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in required]
    checks.append(F.when(~F.coalesce("direction", F.lit(SMALLER)).isin(list(directions)), F.lit("direction is unknown")))
    checks.append(F.when(~F.coalesce("role", F.lit("outcome")).isin(list(roles)), F.lit("role is unknown")))
    checks.append(F.when(F.col("value").isNull() | F.isnan("value"), F.lit("value is missing")))
    return points.select("run_id", "scenario", "metric", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


#: Days of the presets of a date range; None is all.
PRESETS = {"7d": 7, "30d": 30, "90d": 90, "all": None}


def selected(points: DataFrame, *, scenario: str | None = None, metric: str | None = None, monitor: bool | None = None) -> DataFrame:
    """The points of a scenario or a metric; ``monitor`` True keeps monitors' points only, False all others."""
    out = points
    if scenario is not None:
        out = out.where(F.col("scenario") == scenario)
    if metric is not None:
        out = out.where(F.col("metric") == metric)
    if monitor is not None:
        own = F.col("scenario").startswith(MONITOR) | F.col("metric").startswith(MONITOR)
        out = out.where(own if monitor else ~own)
    return out


def merged(batches: Sequence[DataFrame]) -> DataFrame:
    """All points of several batches; where they name their context, the columns of the first batch count and others are filled with null."""
    if not batches:
        raise ValueError("there are no batches")
    first = batches[0]
    out = first
    for more in batches[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.select(*first.columns)


def in_preset(points: DataFrame, preset: str, now: Column | None = None) -> DataFrame:
    """The points of the last 7, 30 or 90 days before ``now``, or all."""
    if preset not in PRESETS:
        raise ValueError(f"a preset is one of {', '.join(PRESETS)}")
    days = PRESETS[preset]
    if days is None:
        return points
    return points.where(F.col("run_ts") >= (F.current_timestamp() if now is None else now) - F.expr(f"interval {days} days"))


def sample_points(samples: DataFrame, metric: str, time: str = "t") -> DataFrame:
    """(x, y) of a metric of samples that hold a map of values; samples without it are left out."""
    return samples.where(F.map_contains_key("values", metric)).select(F.col(time).alias("x"), F.element_at("values", F.lit(metric)).alias("y"))


def sample_metrics(samples: DataFrame) -> DataFrame:
    """The metrics that any sample has."""
    return samples.select(F.explode(F.map_keys("values")).alias("metric")).distinct()


def latest_first(series: DataFrame, limit: int | None = None, ascending: bool = False) -> DataFrame:
    """Lanes of a metric by their latest value, at most ``limit`` of them; of equal values the first lane."""
    last = series.groupBy("metric", "lane").agg(F.max_by("value", F.struct("run_ts", "run_id")).alias("latest"))
    out = last.orderBy(F.asc("latest") if ascending else F.desc("latest"), "metric", "lane")
    return out if limit is None else out.limit(limit)


def interpolated_median(value: str | Column, digits: int = 1) -> Column:
    """The median, between the two middle values of an even number; 0 of none."""
    return round_half_up(F.coalesce(F.percentile(F.col(value) if isinstance(value, str) else value, F.lit(0.5)), F.lit(0.0)), digits)


def velocity(items: DataFrame, opened: str, closed: str, unit_seconds: int) -> DataFrame:
    """(average, median) of the time from opening to closing in units, to one digit; items that are open, or closed before they were opened, are left out."""
    length = (F.unix_micros(F.col(closed).cast("timestamp")) - F.unix_micros(F.col(opened).cast("timestamp"))) / F.lit(1e6 * unit_seconds)
    rows = items.select(length.alias("length")).where("length >= 0")
    return rows.agg(round_half_up(F.coalesce(F.avg("length"), F.lit(0.0)), 1).alias("average"), interpolated_median("length").alias("median"))


def write_aggregates(points: DataFrame, path: str, max_runs: int | None = None) -> dict[str, str]:
    """Write what a dashboard reads as JSON tables: index, refs, prs, metrics, badges, series (a folder for each metric) and runs (one for each run); gives their paths."""
    series = run_series(points)
    detail = points.groupBy("run_id", resolve_metric().alias("metric")).agg(F.min("unit").alias("unit"), F.min("direction").alias("direction"), F.array_sort(F.collect_list(F.struct(lane_key().alias("lane"), "value"))).alias("values"))
    tables = {"index": run_index(points, max_runs), "refs": ref_index(points), "prs": pr_index(points), "metrics": metric_summary(series), "badges": badges(series)}
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
    series.write.mode("overwrite").partitionBy("metric").json(f"{path}/series")
    detail.write.mode("overwrite").partitionBy("run_id").json(f"{path}/runs")
    return {name: f"{path}/{name}" for name in (*tables, "series", "runs")}


def comparison_lines(comparison: DataFrame, title: str = "Benchmark comparison") -> DataFrame:
    """(place, line): a Markdown report of ``compare_runs``: title, counts, and a table, the regressions first."""
    place = F.when(F.col("status") == "regressed", 0).when(F.col("status") == "improved", 1).otherwise(2)
    change = F.when(F.col("percent_change").isNull(), "n/a").otherwise(F.concat(F.when(F.col("percent_change") > 0, "+").otherwise(""), F.format_number("percent_change", 2), F.lit("%")))
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", cell("scenario"), cell("metric"), cell("baseline"), cell("current"), change, cell("status")), F.lit(" |"))
    body = comparison.select(F.struct(F.lit(3).alias("part"), place.alias("status"), (-F.abs(F.coalesce("percent_change", F.lit(0.0)))).alias("change"), F.concat_ws("|", cell("scenario"), cell("tags_text"), cell("metric")).alias("name")).alias("place"), row.alias("line"))
    fixed = lambda part, line: F.struct(F.struct(F.lit(part).alias("part"), F.lit(0).alias("status"), F.lit(0.0).alias("change"), F.lit("").alias("name")).alias("place"), line.alias("line"))
    count = lambda s: F.count_if(F.col("status") == s).cast("string")
    counts = F.concat(F.lit("Regressed: "), count("regressed"), F.lit(", improved: "), count("improved"), F.lit(", stable: "), count("stable"))
    top = comparison.agg(counts.alias("counts")).select(F.explode(F.array(fixed(0, F.lit(f"## {title}")), fixed(1, F.col("counts")), fixed(2, F.lit("| Scenario | Metric | Baseline | Current | Change | Status |\n| --- | --- | --- | --- | --- | --- |")))).alias("x")).select("x.place", "x.line")
    return top.unionByName(body)
