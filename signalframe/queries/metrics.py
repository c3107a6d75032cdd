"""Metric queries over the events table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as ops
from ..plans.metric_query import MetricQuery
from ..sources.derived import event_counters, event_samples

START, DAY = 1_704_067_200_000_000_000, 86_400_000_000_000
END = START + 30 * DAY - 1
HOUR6 = DAY // 4
BY = ("event_type",)

SAMPLES = """samples AS (
    SELECT event_type, CAST(user_id % 10 AS VARCHAR) AS user_bucket, coalesce(json_extract_string(props, '$.k'), '') AS k,
           epoch_us(ts) * 1000 AS ts_ns, value, event_id AS seq FROM events)"""
COUNTERS = """numbered AS (
    SELECT event_type, epoch_us(ts) * 1000 AS ts_ns, value, event_id AS seq,
           (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 40 AS run FROM events WHERE value IS NOT NULL),
counters AS (
    SELECT event_type, ts_ns, seq, sum(value) OVER (PARTITION BY event_type, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS value FROM numbered)"""

QUERIES: dict = {}
ORACLES: dict = {}


def events() -> MetricQuery:
    return MetricQuery().metric("event_value").range(START, END)


def counters() -> MetricQuery:
    return MetricQuery().metric("event_total").range(START, END)


def add(name: str, query, sql: str, source=event_samples, by=BY, digits: int = 9, raw: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query.frame(source(spark, sf_dir))
        columns = [F.coalesce(F.element_at("labels", F.lit(k)), F.lit("")).alias(k) for k in by]
        if raw:
            columns.append("seq")
        return out.select(*columns, "ts_ns", F.round("value", digits).alias("value"))

    QUERIES[name], ORACLES[name] = run, sql


# selection: raw samples by matchers
def raw_sql(where: str) -> str:
    return f"WITH {SAMPLES} SELECT event_type, user_bucket, k, seq, ts_ns, round(value, 9) AS value FROM samples WHERE ts_ns BETWEEN {START} AND {END} AND {where}"


ALL = ("event_type", "user_bucket", "k")
add("metric_raw", events(), raw_sql("true"), by=ALL, raw=True)
add("metric_eq", events().where("event_type", "=", "error"), raw_sql("event_type = 'error'"), by=ALL, raw=True)
add("metric_neq", events().where("event_type", "!=", "error"), raw_sql("event_type <> 'error'"), by=ALL, raw=True)
add("metric_neq_missing_label", events().where("no_such_label", "!=", "x"), raw_sql("true"), by=ALL, raw=True)
add("metric_regex", events().where("event_type", "=~", "v.*|click"), raw_sql("regexp_full_match(event_type, 'v.*|click')"), by=ALL, raw=True)
add("metric_regex_missing_label", events().where("no_such_label", "=~", ".*"), raw_sql("false"), by=ALL, raw=True)
add("metric_not_regex", events().where("event_type", "!~", "p.*").where("k", "!~", "[0-4].?"), raw_sql("NOT regexp_full_match(event_type, 'p.*') AND NOT regexp_full_match(k, '[0-4].?')"), by=ALL, raw=True)
add("metric_range", MetricQuery().metric("event_value").range(START + DAY, START + 2 * DAY), raw_sql(f"ts_ns BETWEEN {START + DAY} AND {START + 2 * DAY}"), by=ALL, raw=True)
for fn in ops.POINTWISE:
    add(f"transform_{fn}", getattr(events(), fn)(), raw_sql("true").replace("round(value, 9)", f"round(CAST({fn}(value) AS DOUBLE), 9)"), by=ALL, raw=True)

# dense steps from the query's start
AGG = {"sum": "sum(value)", "avg": "avg(value)", "min": "min(value)", "max": "max(value)", "count": "CAST(count(value) AS DOUBLE)", "last": "arg_max(value, {'t': ts_ns, 's': seq})"}


def start_sql(fn: str, grouped: bool, step: int = DAY, where: str = "true") -> str:
    empty = "0" if fn in ("sum", "count") else "NULL"
    group = "event_type" if grouped else "''"
    return f"""WITH {SAMPLES},
        chosen AS (SELECT {group} AS g, ts_ns, value, seq FROM samples WHERE {where}),
        cells AS (SELECT DISTINCT g, unnest(range({START}, {END} + 1, {step})) AS b FROM (SELECT DISTINCT g FROM chosen)),
        folded AS (SELECT g, {START} + (ts_ns - {START}) // {step} * {step} AS b, {AGG[fn]} AS v FROM chosen WHERE ts_ns BETWEEN {START} AND {END} GROUP BY ALL)
        SELECT {"g AS event_type," if grouped else ""} b AS ts_ns, round(CASE WHEN folded.b IS NULL THEN {empty} ELSE v END, 9) AS value
        FROM cells LEFT JOIN folded USING (g, b)"""


for fn in ops.SIMPLE:
    add(f"step_{fn}", getattr(events().step(DAY), fn)(), start_sql(fn, False), by=())
    add(f"step_{fn}_by", getattr(events().where("event_type", "!=", "error").step(DAY), f"{fn}_by")(*BY), start_sql(fn, True, where="event_type <> 'error'"))
add("step_max_points", events().max_points(16).avg_by(*BY), start_sql("avg", True, step=-(-(END - START) // 15)))


# steps from each group's first sample
def data_sql(value: str, fold: str, empty: str = "NULL", step: int = DAY, grouped: bool = True) -> str:
    group = "event_type" if grouped else "''"
    return f"""WITH {SAMPLES}, {COUNTERS},
        chosen AS (SELECT {group} AS g, ts_ns, value, seq FROM {value} WHERE ts_ns BETWEEN {START} AND {END}),
        bounds AS (SELECT g, min(ts_ns) AS lo, max(ts_ns) AS hi FROM chosen GROUP BY g),
        cells AS (SELECT g, unnest(range(lo, hi + 1, {step})) AS b FROM bounds),
        folded AS (SELECT g, lo + (ts_ns - lo) // {step} * {step} AS b, {fold} AS v FROM chosen JOIN bounds USING (g) GROUP BY ALL)
        SELECT {"g AS event_type," if grouped else ""} b AS ts_ns, round(CASE WHEN folded.b IS NULL THEN {empty} ELSE v END, 9) AS value
        FROM cells LEFT JOIN folded USING (g, b)"""


for fn, p in ops.PERCENTILES.items():
    add(f"step_{fn}", getattr(events().step(DAY), fn)(), data_sql("samples", f"quantile_disc(value, {p})", grouped=False), by=())
    add(f"step_{fn}_by", getattr(events().step(HOUR6), f"{fn}_by")(*BY), data_sql("samples", f"quantile_disc(value, {p})", step=HOUR6))
add("step_sum_from_data", events().step(DAY).anchor("data").sum_by(*BY), data_sql("samples", "sum(value)", "0"))

FIRST, LAST = "arg_min(value, {'t': ts_ns, 's': seq})", "arg_max(value, {'t': ts_ns, 's': seq})"
GROWN = f"CASE WHEN {LAST} >= {FIRST} THEN {LAST} - {FIRST} ELSE {LAST} END"
STEP_TEMPORAL = {
    "rate": f"CASE WHEN count(*) < 2 THEN NULL WHEN max(ts_ns) > min(ts_ns) THEN ({GROWN}) / ((max(ts_ns) - min(ts_ns)) / 1e9) END",
    "increase": f"CASE WHEN count(*) < 2 THEN NULL ELSE {GROWN} END",
    "delta": f"CASE WHEN count(*) < 2 THEN NULL ELSE {LAST} - {FIRST} END",
}
for fn, fold in STEP_TEMPORAL.items():
    add(f"{fn}_step", getattr(counters(), fn)().step(DAY), data_sql("counters", fold), source=event_counters)
add("irate_step", counters().irate().step(DAY), f"""WITH {COUNTERS},
        chosen AS (SELECT event_type AS g, ts_ns, value, seq FROM counters WHERE ts_ns BETWEEN {START} AND {END}),
        bounds AS (SELECT g, min(ts_ns) AS lo, max(ts_ns) AS hi FROM chosen GROUP BY g),
        cells AS (SELECT g, unnest(range(lo, hi + 1, {DAY})) AS b FROM bounds),
        ranked AS (
            SELECT g, lo + (ts_ns - lo) // {DAY} * {DAY} AS b, ts_ns, value,
                   row_number() OVER (PARTITION BY g, (ts_ns - lo) // {DAY} ORDER BY ts_ns DESC) AS r FROM chosen JOIN bounds USING (g)),
        two AS (
            SELECT g, b, max(value) FILTER (r = 1) AS v1, max(value) FILTER (r = 2) AS v2, max(ts_ns) FILTER (r = 1) AS t1, max(ts_ns) FILTER (r = 2) AS t2
            FROM ranked WHERE r <= 2 GROUP BY ALL)
        SELECT g AS event_type, b AS ts_ns, round((CASE WHEN v1 >= v2 THEN v1 - v2 WHEN v2 IS NOT NULL THEN v1 END) / ((t1 - t2) / 1e9), 9) AS value
        FROM cells LEFT JOIN two USING (g, b)""", source=event_counters)  # fmt: skip

POINT = {
    "delta": "value - before",
    "increase": "CASE WHEN value >= before THEN value - before ELSE value END",
    "rate": "CASE WHEN ts_ns > t_before THEN (CASE WHEN value >= before THEN value - before ELSE value END) / ((ts_ns - t_before) / 1e9) END",
}
POINT["irate"] = POINT["rate"]
for fn, value in POINT.items():
    add(f"{fn}_point", getattr(counters(), fn)(), f"""WITH {COUNTERS},
        lagged AS (SELECT *, lag(value) OVER w AS before, lag(ts_ns) OVER w AS t_before FROM counters
                   WHERE ts_ns BETWEEN {START} AND {END} WINDOW w AS (PARTITION BY event_type ORDER BY ts_ns, seq))
        SELECT event_type, seq, ts_ns, round(CASE WHEN before IS NOT NULL THEN {value} END, 9) AS value FROM lagged""", source=event_counters, raw=True)  # fmt: skip

# a transform of each series, then an aggregate of the group: each stage has its own anchor
for fn, outer in (("rate", "sum"), ("increase", "sum"), ("increase", "max"), ("delta", "avg")):
    fold = {"sum": "CASE WHEN count(v) < count(*) THEN NULL ELSE sum(v) END", "avg": "CASE WHEN count(v) < count(*) THEN NULL ELSE avg(v) END", "max": "max(v)"}[outer]
    add(f"{fn}_{outer}_by", getattr(getattr(counters(), fn)().step(DAY), f"{outer}_by")("event_class"), f"""WITH {COUNTERS},
        chosen AS (SELECT event_type AS g, ts_ns, value, seq FROM counters WHERE ts_ns BETWEEN {START} AND {END}),
        bounds AS (SELECT g, min(ts_ns) AS lo, max(ts_ns) AS hi FROM chosen GROUP BY g),
        cells AS (SELECT g, unnest(range(lo, hi + 1, {DAY})) AS b FROM bounds),
        folded AS (SELECT g, lo + (ts_ns - lo) // {DAY} * {DAY} AS b, {STEP_TEMPORAL[fn]} AS v FROM chosen JOIN bounds USING (g) GROUP BY ALL),
        series AS (SELECT g, b, v FROM cells LEFT JOIN folded USING (g, b)),
        outer_bounds AS (SELECT min(b) AS lo, max(b) AS hi FROM series),
        outer_cells AS (SELECT unnest(range(lo, hi + 1, {DAY})) AS b FROM outer_bounds),
        outer_folded AS (SELECT lo + (series.b - lo) // {DAY} * {DAY} AS b, {fold} AS v FROM series, outer_bounds GROUP BY ALL)
        SELECT '' AS event_class, b AS ts_ns, round(CASE WHEN outer_folded.b IS NULL THEN {"0" if outer == "sum" else "NULL"} ELSE v END, 9) AS value
        FROM outer_cells LEFT JOIN outer_folded USING (b)""", source=event_counters, by=("event_class",))  # fmt: skip

# without a step: by position in the series
for fn in ops.SIMPLE:
    last = "arg_max(value, born)" if fn == "last" else AGG[fn]
    add(f"point_{fn}", getattr(events(), f"{fn}_by")(*BY), f"""WITH {SAMPLES},
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY event_type, user_bucket, k ORDER BY ts_ns, seq) AS i,
                   count(*) OVER (PARTITION BY event_type, user_bucket, k) AS n, min(seq) OVER (PARTITION BY event_type, user_bucket, k) AS born
            FROM samples WHERE ts_ns BETWEEN {START} AND {END}),
        base AS (SELECT event_type, arg_max(born, {{'n': n, 'b': -born}}) AS base FROM placed GROUP BY event_type)
        SELECT event_type, max(ts_ns) FILTER (born = base) AS ts_ns, round({last}, 9) AS value FROM placed JOIN base USING (event_type) GROUP BY event_type, i""")  # fmt: skip


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.chunk_stats(event_counters(spark, sf_dir))
    return out.select(F.col("series_id").alias("event_type"), *[F.round(c, 4).alias(c) for c in ("min_value", "max_value", "sum_value", "first_value", "last_value")], F.round("sum_of_squares", 1).alias("sum_of_squares"), "n", F.col("resets").cast("long").alias("resets"))


QUERIES["chunk_stats"] = chunk_stats
ORACLES["chunk_stats"] = f"""WITH {COUNTERS}, lagged AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts_ns, seq) AS before FROM counters)
    SELECT event_type, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value, round(sum(value), 4) AS sum_value,
           round({FIRST}, 4) AS first_value, round({LAST}, 4) AS last_value, round(sum(value * value), 1) AS sum_of_squares, count(*) AS n,
           CAST(count(*) FILTER (value < before) AS BIGINT) AS resets FROM lagged GROUP BY event_type"""


def merged_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cold partition and a hot one that overlap by five days; the hot one's values (doubled here) win."""
    s = event_samples(spark, sf_dir)
    cold = s.where(F.col("ts_ns") < START + 20 * DAY)
    hot = s.where(F.col("ts_ns") >= START + 15 * DAY).withColumn("value", F.col("value") * 2)
    out = ops.merge_partitions([cold, hot])
    return out.select("series_id", "ts_ns", F.round("value", 4).alias("value"), "seq").drop("series_id")


QUERIES["partition_merge"] = merged_partitions
ORACLES["partition_merge"] = f"WITH {SAMPLES} SELECT ts_ns, seq, round(CASE WHEN ts_ns >= {START + 15 * DAY} THEN value * 2 ELSE value END, 4) AS value FROM samples"


def label_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.metadata(event_samples(spark, sf_dir))


QUERIES["label_metadata"] = label_metadata
ORACLES["label_metadata"] = f"""WITH {SAMPLES},
    long AS (
        SELECT event_type || '|' || user_bucket || '|' || k AS series, unnest(['event_type', 'user_bucket', 'k']) AS label, unnest([event_type, user_bucket, k]) AS v FROM samples)
    SELECT 'event_value' AS metric, label, count(DISTINCT v) AS n_values, count(DISTINCT series) AS n_series, count(*) AS n_samples FROM long GROUP BY label"""


def series_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.series_dimension(event_samples(spark, sf_dir))
    return s.select(*[F.element_at("labels", F.lit(k)).alias(k) for k in ALL])


QUERIES["series_labels"] = series_dimension
ORACLES["series_labels"] = f"WITH {SAMPLES} SELECT DISTINCT event_type, user_bucket, k FROM samples"
