"""Benchmark history queries over lineitem read as runs by month, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bench as ops
from ..sources import benchmarks as src
from ..sources.derived import lineitem_points as points

POINTS = """months AS (SELECT strftime(l_shipdate, '%Y-%m') AS run_id, l_returnflag AS scenario, l_linestatus AS status, avg(l_extendedprice) AS avg_price, avg(l_quantity) AS avg_qty FROM lineitem GROUP BY ALL),
points AS (
    SELECT run_id, strptime(run_id || '-01', '%Y-%m-%d') AS run_ts, substr(sha1(run_id), 1, 7) AS commit,
           CASE WHEN CAST(substr(run_id, 6, 2) AS INTEGER) % 3 = 0 THEN 'refs/pull/' || CAST(substr(run_id, 6, 2) AS INTEGER) || '/merge' ELSE 'refs/heads/main' END AS ref,
           scenario, scenario || '/' || status AS series, metric, floor(v * 100 + 0.5) / 100 AS value, unit, direction, status, scenario || ' [status=' || status || ']' AS lane
    FROM (SELECT run_id, scenario, status, 'avg_price' AS metric, avg_price AS v, 'usd' AS unit, 'smaller_is_better' AS direction FROM months
          UNION ALL SELECT run_id, scenario, status, 'avg_qty', avg_qty, 'items', 'bigger_is_better' FROM months))"""
LAST = "1998-12"
BASE = "base_runs AS (SELECT DISTINCT run_id FROM points WHERE run_id < '1998-12' ORDER BY 1 DESC LIMIT 5)"
CHANGE = "(p.value - b.baseline) / b.baseline * 100"
COMPARED = f"""compared AS (SELECT p.scenario, p.series, p.metric, 'status=' || p.status AS tags_text, p.unit, p.direction, round(b.baseline, 6) AS baseline, p.value AS current, floor({CHANGE} * 100 + 0.5) / 100 AS percent_change,
    CASE WHEN abs({CHANGE}) <= 1.0 THEN 'stable' WHEN ({CHANGE} > 0) = (p.direction = 'smaller_is_better') THEN 'regressed' ELSE 'improved' END AS status
    FROM points p JOIN (SELECT lane, metric, avg(value) AS baseline FROM points WHERE run_id IN (SELECT run_id FROM base_runs) GROUP BY ALL) b ON b.lane = p.lane AND b.metric = p.metric WHERE p.run_id = '{LAST}')"""

QUERIES: dict = {}
ORACLES: dict = {}


def simple(name: str, query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def compared(s: SparkSession, d: str) -> DataFrame:
    p = points(s, d)
    out = ops.compare_runs(p.where(F.col("run_id") == LAST), ops.baseline_runs(p, 5, before=LAST), 1.0)
    return out.withColumn("baseline", F.round("baseline", 6))


def series(s: SparkSession, d: str) -> DataFrame:
    return ops.run_series(points(s, d))


simple("bench_compare", compared, f"WITH {POINTS}, {BASE}, {COMPARED} SELECT * FROM compared")
simple("bench_regressed_first", lambda s, d: ops.by_severity(compared(s, d)).limit(3).select("scenario", "series", "metric", "status", "percent_change"), f"""WITH {POINTS}, {BASE}, {COMPARED}
    SELECT scenario, series, metric, status, percent_change FROM compared ORDER BY CASE status WHEN 'regressed' THEN 0 WHEN 'improved' THEN 1 ELSE 2 END, abs(percent_change) DESC LIMIT 3""")  # fmt: skip


def matrix(s: SparkSession, d: str) -> DataFrame:
    seen = compared(s, d).select("scenario", F.substring_index("series", "/", -1).alias("line"), "metric", "status")
    return ops.matrix(s, seen, {"scenario": ["A", "N", "R", "X"], "line": ["F", "O"], "metric": ["avg_price", "avg_qty"]}, exclude=[{"scenario": "R", "line": "O"}], probe=[{"scenario": {"in": ["X", "N"]}, "metric": "avg_qty"}])


simple("bench_matrix", matrix, f"""WITH {POINTS}, {BASE}, {COMPARED}, lanes AS (
        SELECT * FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS scenario), (SELECT unnest(['F', 'O']) AS line), (SELECT unnest(['avg_price', 'avg_qty']) AS metric) WHERE NOT (scenario = 'R' AND line = 'O')),
    seen AS (SELECT scenario, split_part(series, '/', 2) AS line, metric, count(*) AS n, count(*) FILTER (status = 'regressed') AS regressed FROM compared GROUP BY ALL)
    SELECT scenario, line, metric, CASE WHEN scenario IN ('X', 'N') AND metric = 'avg_qty' THEN 'probe' ELSE 'required' END AS lane_class, coalesce(n, 0) AS n,
           CASE WHEN n IS NULL THEN 'missing' WHEN regressed > 0 THEN 'failed' ELSE 'passed' END AS result FROM lanes LEFT JOIN seen USING (scenario, line, metric)""")  # fmt: skip
simple("bench_series", lambda s, d: series(s, d).select("run_id", "lane", "metric", "value", "range", "n"), f"WITH {POINTS} SELECT run_id, lane, metric, floor(avg(value) * 100 + 0.5) / 100 AS value, CASE WHEN count(*) > 1 THEN floor((max(value) - min(value)) * 100 + 0.5) / 100 END AS range, count(*) AS n FROM points GROUP BY ALL")
simple("bench_index", lambda s, d: ops.run_index(points(s, d), 20).select("run_id", "commit", "n_points", F.array_join("metrics", ",").alias("metrics")), f"WITH {POINTS} SELECT run_id, any_value(commit) AS commit, count(*) AS n_points, 'avg_price,avg_qty' AS metrics FROM points GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
REFS = "r AS (SELECT DISTINCT run_id, run_ts, commit, ref FROM points)"
simple("bench_refs", lambda s, d: ops.ref_index(points(s, d)).drop("latest_ts"), f"WITH {POINTS}, {REFS} SELECT ref, max(run_id) AS latest_run, arg_max(commit, run_id) AS latest_commit, count(*) AS n_runs FROM r GROUP BY 1")
simple("bench_prs", lambda s, d: ops.pr_index(points(s, d)).drop("latest_ts"), f"WITH {POINTS}, {REFS} SELECT CAST(regexp_extract(ref, '^refs/pull/(\\d+)/merge$', 1) AS BIGINT) AS pr, max(run_id) AS latest_run, count(*) AS n_runs FROM r WHERE ref LIKE 'refs/pull/%' GROUP BY 1")
simple("bench_run_detail", lambda s, d: ops.run_detail(points(s, d), LAST).select("metric", "unit", "direction", F.explode("values").alias("v")).select("metric", "unit", "direction", "v.lane", "v.value"), f"WITH {POINTS} SELECT metric, unit, direction, lane, value FROM points WHERE run_id = '{LAST}'")
simple("bench_metric_summary", lambda s, d: ops.metric_summary(series(s, d)).drop("latest_ts"), f"WITH {POINTS} SELECT metric, count(DISTINCT lane) AS n_lanes, max(run_id) AS latest_run, min(unit) AS unit FROM points GROUP BY 1")
simple("bench_badges", lambda s, d: ops.badges(series(s, d)).withColumn("latest", F.round("latest", 6)), f"""WITH {POINTS}, l AS (SELECT *, run_id = max(run_id) OVER (PARTITION BY metric) AS is_last FROM points),
    n AS (SELECT *, count(*) FILTER (is_last) OVER (PARTITION BY metric) AS n_last, row_number() OVER (PARTITION BY metric, is_last ORDER BY run_id DESC, lane) AS place FROM l),
    g AS (SELECT metric, min(unit) AS unit, min(direction) AS direction, avg(value) FILTER (is_last) AS latest, avg(value) FILTER (NOT is_last AND place <= n_last) AS previous FROM n GROUP BY 1)
    SELECT replace(metric, '_', ' ') AS label, round(latest, 6) AS latest, unit, CASE WHEN previous IS NULL OR abs((latest - previous) / abs(previous) * 100) < 3 THEN 'blue' WHEN (latest < previous) = (direction = 'smaller_is_better') THEN 'brightgreen' ELSE 'red' END AS colour FROM g""")  # fmt: skip
ROLLED = "rolled AS (SELECT metric, lane, run_id, value, direction, avg(value) OVER w AS baseline, row_number() OVER (PARTITION BY metric, lane ORDER BY run_id) AS i, count(*) OVER (PARTITION BY metric, lane) AS n FROM points WINDOW w AS (PARTITION BY metric, lane ORDER BY run_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"
PCT = "(value - baseline) / baseline * 100"
ROUNDED = "metric, lane, run_id, value, round(baseline, 6) AS baseline, round(" + PCT + ", 6) AS percent_change"
rounded = lambda df: df.withColumns({"baseline": F.round("baseline", 6), "percent_change": F.round("percent_change", 6)})
simple("bench_regress_rolling", lambda s, d: rounded(ops.rolling_regressions(series(s, d), 5.0)), f"WITH {POINTS}, {ROLLED} SELECT {ROUNDED} FROM rolled WHERE i > 5 AND CASE direction WHEN 'smaller_is_better' THEN value > baseline AND {PCT} >= 5 ELSE value <= baseline AND abs({PCT}) >= 5 END")
simple("bench_regress_latest", lambda s, d: rounded(ops.latest_regressions(series(s, d), 0.5)), f"WITH {POINTS}, {ROLLED} SELECT {ROUNDED} FROM rolled WHERE i = n AND n > 5 AND CASE direction WHEN 'smaller_is_better' THEN {PCT} > 0.5 ELSE {PCT} < -0.5 END")
simple("bench_leaderboard", lambda s, d: ops.leaderboard(series(s, d)).withColumn("delta", F.round("delta", 6)), f"""WITH {POINTS}, o AS (SELECT *, row_number() OVER w AS r, lead(value) OVER w AS previous FROM points WINDOW w AS (PARTITION BY metric, lane ORDER BY run_id DESC))
    SELECT metric, lane, value, previous, round(value - previous, 6) AS delta, CAST(row_number() OVER p AS INTEGER) AS rank, row_number() OVER p = 1 AS is_winner FROM o WHERE r = 1
    WINDOW p AS (PARTITION BY metric ORDER BY CASE direction WHEN 'bigger_is_better' THEN -value ELSE value END, lane)""")  # fmt: skip
simple("bench_normalised", lambda s, d: ops.normalised(series(s, d)).select("metric", "lane", "run_id", F.round("value", 6).alias("value")), f"WITH {POINTS}, m AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM points WINDOW w AS (PARTITION BY metric, lane)) SELECT metric, lane, run_id, round(CASE WHEN hi = lo THEN 50 ELSE (value - lo) / (hi - lo) * 100 END, 6) AS value FROM m")
simple("bench_by_tag", lambda s, d: ops.aggregate_by_tag(points(s, d), "status", "max"), f"WITH {POINTS} SELECT run_id, metric, status AS tag_value, max(value) AS value FROM points GROUP BY ALL")
simple("bench_dates", lambda s, d: ops.in_dates(points(s, d), "1997-01-01", "1997-06-30").select("run_id", "series", "metric", "value"), f"WITH {POINTS} SELECT run_id, series, metric, value FROM points WHERE run_ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
simple("bench_too_few", lambda s, d: ops.too_few_points(points(s, d), 8), f"WITH {POINTS} SELECT run_id, count(value) AS n FROM points GROUP BY 1 HAVING count(value) < 8")
simple("bench_violations", lambda s, d: ops.violations(points(s, d).withColumn("direction", F.when(F.col("scenario") == "N", "sideways").otherwise(F.col("direction")))).groupBy("scenario", "problem").agg(F.count("*").alias("n")), f"WITH {POINTS} SELECT scenario, 'direction is unknown' AS problem, count(*) AS n FROM points WHERE scenario = 'N' GROUP BY 1")
UNITS = ["ns/op", "ops/s", "MB/s", "B/op", "req/sec", "ns/iter", "Allocs/op", "p99 latency", "%", "events", "RPS"]
simple("bench_units", lambda s, d: s.createDataFrame([(u,) for u in UNITS], "unit string").select("unit", ops.infer_direction("unit").alias("direction"), ops.metric_name("unit").alias("name"), ops.infer_direction("unit", True).alias("lenient_direction"), ops.metric_name("unit", True).alias("lenient_name")), "SELECT * FROM (VALUES " + ", ".join((
    "('ns/op', 'smaller_is_better', 'ns_per_op', 'smaller_is_better', 'ns_per_op')", "('ops/s', 'bigger_is_better', 'ops_per_s', 'bigger_is_better', 'ops_per_s')", "('MB/s', 'bigger_is_better', 'mb_per_s', NULL, 'mb_per_s')",
    "('B/op', 'smaller_is_better', 'bytes_per_op', 'smaller_is_better', 'bytes_per_op')", "('req/sec', 'bigger_is_better', 'req_per_sec', NULL, 'req_per_sec')", "('ns/iter', 'smaller_is_better', 'ns_per_iter', NULL, 'ns_per_iter')",
    "('Allocs/op', 'smaller_is_better', 'allocs_per_op', 'smaller_is_better', 'allocs_per_op')", "('p99 latency', 'smaller_is_better', 'p99_latency', 'smaller_is_better', 'p99_latency')", "('%', 'smaller_is_better', '%', NULL, 'pct')",
    "('events', 'bigger_is_better', 'events', NULL, 'events')", "('RPS', 'smaller_is_better', 'rps', 'bigger_is_better', 'rps')")) + ") t(unit, direction, name, lenient_direction, lenient_name)")


def parsed_go(s: SparkSession, d: str) -> DataFrame:
    """Lines in the go format made from lineitem, read again."""
    from ..sources.derived import table

    li = table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.floor(F.sum("l_quantity")).cast("long").alias("q"))
    line = F.concat(F.lit("BenchmarkShip/"), "l_returnflag", F.lit("-8 \t"), F.col("n").cast("string"), F.lit("\t "), F.col("q").cast("string"), F.lit(" ns/op\t 12 B/op"))
    return src.parse_go(li.select(F.lit("run").alias("file"), line.alias("line"))).select("scenario", F.element_at("tags", F.lit("procs")).alias("procs"), "metric", "value", "unit", "direction")


simple("bench_parse_go", parsed_go, """WITH g AS (SELECT l_returnflag, l_linestatus, floor(sum(l_quantity)) AS q FROM lineitem GROUP BY ALL)
    SELECT 'BenchmarkShip/' || l_returnflag AS scenario, '8' AS procs, unnest(['ns_per_op', 'bytes_per_op']) AS metric, unnest([q, 12.0::DOUBLE]) AS value, unnest(['ns/op', 'B/op']) AS unit, 'smaller_is_better' AS direction FROM g""")  # fmt: skip
