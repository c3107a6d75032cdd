"""Trace queries over conversations and events read as spans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces as ops
from ..plans.trace_query import TraceQuery
from ..sources.derived import conversation_spans, event_spans

SPANS = """spans AS (
    SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(conv_id * 1000 + turn AS VARCHAR) AS span_id,
           CASE WHEN turn > 0 THEN CAST(conv_id * 1000 + (turn - 1) // 2 AS VARCHAR) END AS parent_span_id, role || '-turn' AS name,
           CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END AS kind,
           conv_id * 1000000000 + turn * 1000000 AS start_ns, conv_id * 1000000000 + turn * 1000000 + CAST(length(coalesce(text, '')) AS BIGINT) * 20000 AS end_ns,
           CAST(length(coalesce(text, '')) AS BIGINT) * 20000 AS duration_ns, CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 2 ELSE 1 END AS status_code,
           role, CAST(length(coalesce(text, '')) AS BIGINT) AS size, role || '-' || CAST(conv_id % 4 AS VARCHAR) AS service_name, conv_id * 1000 + turn AS seq
    FROM conversations)"""
FLAT = """flat AS (
    SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id, event_type AS name, epoch_us(ts) * 1000 AS start_ns,
           epoch_us(ts) * 1000 + CAST(floor(value * 1000) AS BIGINT) AS end_ns, CAST(floor(value * 1000) AS BIGINT) AS duration_ns,
           CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status_code, 'svc-' || CAST(user_id % 5 AS VARCHAR) AS service_name, event_id AS seq FROM events)"""
ASSEMBLED = """assembled AS (
    SELECT trace_id, min(start_ns) AS start_ns, max(end_ns) AS end_ns, CAST(max(end_ns) - min(start_ns) AS BIGINT) AS duration_ns, count(*) AS span_count,
           count(*) FILTER (status_code = 2) AS error_count, arg_min(name, {'a': start_ns, 'b': seq}) FILTER (parent_span_id IS NULL) AS root_name,
           arg_min(service_name, {'a': start_ns, 'b': seq}) FILTER (parent_span_id IS NULL) AS root_service, min(seq) AS first_seq
    FROM found GROUP BY trace_id)"""
TRACES = "SELECT trace_id, start_ns, end_ns, duration_ns, span_count, error_count, root_name, root_service, first_seq FROM assembled"
UNDER = """closure AS (
    SELECT trace_id, parent_span_id AS above, span_id AS below, 1 AS far FROM spans WHERE parent_span_id IS NOT NULL
    UNION ALL SELECT c.trace_id, s.parent_span_id, c.below, c.far + 1 FROM closure c JOIN spans s ON s.trace_id = c.trace_id AND s.span_id = c.above WHERE s.parent_span_id IS NOT NULL)"""

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query: TraceQuery, where: str = "true", having: str = "true", tail: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.frame(conversation_spans(spark, sf_dir))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {SPANS}, found AS (SELECT * FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE {where})), {ASSEMBLED} {TRACES} WHERE {having} {tail}"


Q = TraceQuery()
add("trace_all", Q)
add("trace_by_id", Q.trace_id("7"), "trace_id = '7'")
add("trace_search_status", Q.status(2), "status_code = 2")
add("trace_search_name", Q.span_name("assistant-turn").duration(least_ns=10_000_000), "name = 'assistant-turn' AND duration_ns >= 10000000")
add("trace_search_name_regex", Q.span_name_matches("^sys"), "regexp_matches(name, '^sys')")
add("trace_search_time", Q.time_range(10_000_000_000, 20_000_000_000), "end_ns >= 10000000000 AND start_ns <= 20000000000")
add("trace_search_service", Q.service("user-1").kind(3), "service_name = 'user-1' AND kind = 3")
add("trace_search_duration", Q.duration(5_000_000, 8_000_000), "duration_ns BETWEEN 5000000 AND 8000000")
for op, value, sql in (
    ("eq", 300, "size = 300"), ("neq", 300, "size <> 300"), ("gt", 600, "size > 600"), ("gte", 600, "size >= 600"), ("lt", 60, "size < 60"), ("lte", 60, "size <= 60"),
    ("in", [*range(200, 230)], "size BETWEEN 200 AND 229"), ("exists", None, "true"), ("notExists", None, "false"),
):
    add(f"trace_attr_{op}", Q.attribute("size", op, value), sql)
add("trace_attr_regex", Q.attribute("role", "regex", "^(user|system)$"), "role IN ('user', 'system')")
add("trace_attr_contains", Q.attribute("role", "contains", "yst"), "contains(role, 'yst')")
add("trace_attr_startsWith", Q.attribute("role", "startsWith", "ass"), "starts_with(role, 'ass')")
add("trace_attr_unsafe_regex", Q.attribute("role", "regex", "(a+)+b"), "false")
add("trace_missing_attribute", Q.missing_attribute("no_such"), "true")
add("trace_duration", Q.trace_duration(20_000_000, 60_000_000), having="duration_ns BETWEEN 20000000 AND 60000000")
add("trace_span_count", Q.span_count(4, 6), having="span_count BETWEEN 4 AND 6")
add("trace_root", Q.root_service("system-2").root_span_name("system-turn"), having="root_service = 'system-2' AND root_name = 'system-turn'")
add("trace_page", Q.sort_by("duration").offset(5).limit(10), tail="ORDER BY duration_ns DESC, first_seq LIMIT 10 OFFSET 5")
add("trace_page_ascending", Q.sort_by("spanCount", ascending=True).limit(12), tail="ORDER BY span_count, first_seq LIMIT 12")

ERROR, USER, SYSTEM, LONG = "status_code = 2", "kind = 3", "kind = 1", "duration_ns > 8000000"
RELATED = {
    "child": "SELECT b.trace_id FROM spans a JOIN spans b ON a.trace_id = b.trace_id AND b.parent_span_id = a.span_id WHERE {a} AND {b}",
    "parent": "SELECT b.trace_id FROM spans a JOIN spans b ON a.trace_id = b.trace_id AND a.parent_span_id = b.span_id WHERE {a} AND {b}",
    "sibling": "SELECT b.trace_id FROM spans a JOIN spans b ON a.trace_id = b.trace_id AND a.parent_span_id = b.parent_span_id AND a.span_id <> b.span_id WHERE {a} AND {b}",
    "descendant": "SELECT c.trace_id FROM closure c JOIN spans a ON a.trace_id = c.trace_id AND a.span_id = c.above JOIN spans b ON b.trace_id = c.trace_id AND b.span_id = c.below WHERE {a} AND {b}",
    "ancestor": "SELECT c.trace_id FROM closure c JOIN spans b ON b.trace_id = c.trace_id AND b.span_id = c.above JOIN spans a ON a.trace_id = c.trace_id AND a.span_id = c.below WHERE {a} AND {b}",
}
PAIRS = {
    "child": (USER, ERROR, "a.kind = 3", "b.status_code = 2"), "parent": (ERROR, USER, "a.status_code = 2", "b.kind = 3"), "sibling": (ERROR, LONG, "a.status_code = 2", "b.duration_ns > 8000000"),
    "descendant": (LONG, ERROR, "a.duration_ns > 8000000", "b.status_code = 2"), "ancestor": (ERROR, SYSTEM, "a.status_code = 2", "b.kind = 1"),
}


def add_relation(relation: str) -> None:
    left, right, a, b = PAIRS[relation]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.related(left, relation, right).frame(conversation_spans(spark, sf_dir))

    QUERIES[f"struct_{relation}"] = run
    body = f"{SPANS}, found AS (SELECT * FROM spans WHERE trace_id IN ({RELATED[relation].format(a=a, b=b)})), {ASSEMBLED} {TRACES}"
    ORACLES[f"struct_{relation}"] = f"WITH RECURSIVE " + body.replace("found AS", UNDER + ", found AS", 1) if "closure" in RELATED[relation] else f"WITH {body}"


for _relation in RELATED:
    add_relation(_relation)


def simple(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


simple("trace_total", lambda s, d: Q.status(2).total(conversation_spans(s, d)), f"WITH {SPANS} SELECT count(DISTINCT trace_id) AS total_traces FROM spans WHERE status_code = 2")
simple("trace_spans", lambda s, d: Q.status(2).spans(conversation_spans(s, d)).select("trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns", "status_code"),
       f"WITH {SPANS} SELECT trace_id, span_id, parent_span_id, name, start_ns, end_ns, status_code FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE status_code = 2)")
simple("tree_depth", lambda s, d: ops.depths(conversation_spans(s, d)),
       f"WITH RECURSIVE {SPANS}, {UNDER} SELECT s.trace_id, s.span_id, count(c.above) AS depth FROM spans s LEFT JOIN closure c ON c.trace_id = s.trace_id AND c.below = s.span_id GROUP BY ALL")
simple("tree_self_time", lambda s, d: ops.self_times(conversation_spans(s, d)).select("trace_id", "span_id", "duration_ns", "self_ns"), f"""WITH {SPANS},
    cut AS (SELECT s.trace_id, s.parent_span_id AS p, greatest(s.start_ns, q.start_ns) AS a, least(s.end_ns, q.end_ns) AS e, s.seq
            FROM spans s JOIN spans q ON q.trace_id = s.trace_id AND q.span_id = s.parent_span_id WHERE least(s.end_ns, q.end_ns) > greatest(s.start_ns, q.start_ns)),
    far AS (SELECT *, max(e) OVER (PARTITION BY trace_id, p ORDER BY a, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cut),
    covered AS (SELECT trace_id, p, sum(greatest(0, e - greatest(a, coalesce(before, a)))) AS c FROM far GROUP BY ALL)
    SELECT s.trace_id, s.span_id, duration_ns, CAST(greatest(0, duration_ns - coalesce(c, 0)) AS BIGINT) AS self_ns FROM spans s LEFT JOIN covered ON covered.trace_id = s.trace_id AND p = s.span_id""")  # fmt: skip
simple("tree_critical_path", lambda s, d: ops.critical_path(conversation_spans(s, d)), f"""WITH RECURSIVE {SPANS},
    best AS (SELECT *, row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY CASE WHEN parent_span_id IS NULL THEN duration_ns ELSE end_ns END DESC, start_ns, seq) AS r FROM spans),
    walk AS (SELECT trace_id, span_id, CAST(0 AS BIGINT) AS depth FROM best WHERE parent_span_id IS NULL AND r = 1
             UNION ALL SELECT b.trace_id, b.span_id, w.depth + 1 FROM walk w JOIN best b ON b.trace_id = w.trace_id AND b.parent_span_id = w.span_id AND b.r = 1)
    SELECT trace_id, span_id, depth FROM walk""")  # fmt: skip


def nested_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a span and one below it, read off the nested sets."""
    n = ops.nested_sets(conversation_spans(spark, sf_dir))
    a = n.select("trace_id", F.col("span_id").alias("above"), F.col("nested_left").alias("a_left"), F.col("nested_right").alias("a_right"))
    b = n.select("trace_id", F.col("span_id").alias("below"), F.col("nested_left").alias("b_left"), F.col("nested_right").alias("b_right"))
    return a.join(b, "trace_id").where(ops.is_ancestor()).select("trace_id", "above", "below")


simple("nested_set_pairs", nested_closure, f"WITH RECURSIVE {SPANS}, {UNDER} SELECT trace_id, above, below FROM closure")
simple("waterfall", lambda s, d: ops.waterfall(conversation_spans(s, d)), f"""WITH RECURSIVE {SPANS}, {UNDER},
    deep AS (SELECT s.trace_id, s.span_id, count(c.above) AS depth FROM spans s LEFT JOIN closure c ON c.trace_id = s.trace_id AND c.below = s.span_id GROUP BY ALL)
    SELECT trace_id, span_id, name, CAST(start_ns - min(start_ns) OVER (PARTITION BY trace_id) AS BIGINT) AS offset_ns, duration_ns, depth, status_code FROM spans JOIN deep USING (trace_id, span_id)""")  # fmt: skip

RED = """count(*) AS rate, count(*) FILTER (status_code = 2) AS errors, count(*) FILTER (status_code = 2) / count(*) AS error_rate, min(duration_ns) AS min_ns, max(duration_ns) AS max_ns,
    CAST(sum(duration_ns) AS BIGINT) AS sum_ns, quantile_disc(duration_ns, 0.5) AS p50_ns, quantile_disc(duration_ns, 0.95) AS p95_ns, quantile_disc(duration_ns, 0.99) AS p99_ns"""
simple("red_metrics", lambda s, d: ops.red_metrics(event_spans(s, d), 3_600_000_000_000 * 6), f"WITH {FLAT} SELECT name, start_ns - start_ns % 21600000000000 AS bucket_ns, {RED} FROM flat GROUP BY ALL")
simple("service_graph", lambda s, d: ops.service_graph(conversation_spans(s, d)), f"""WITH {SPANS}
    SELECT c.service_name AS source, s.service_name AS target, count(*) AS calls, count(*) FILTER (s.status_code = 2) AS errors, CAST(sum(s.duration_ns) AS BIGINT) AS total_ns
    FROM spans s JOIN spans c ON c.trace_id = s.trace_id AND c.span_id = s.parent_span_id WHERE s.kind = 2 AND c.kind = 3 AND s.service_name <> c.service_name GROUP BY ALL""")  # fmt: skip
simple("agg_spans_grouped", lambda s, d: ops.aggregate(event_spans(s, d), ["name", "service_name"], [("avg", "duration_ns"), ("p50", "duration_ns"), ("p99", "duration_ns"), ("max", "duration_ns")]).withColumn("avg_duration_ns", F.round("avg_duration_ns", 4)),
       f"WITH {FLAT} SELECT name, service_name, count(*) AS n, round(avg(duration_ns), 4) AS avg_duration_ns, quantile_disc(duration_ns, 0.5) AS p50_duration_ns, quantile_disc(duration_ns, 0.99) AS p99_duration_ns, max(duration_ns) AS max_duration_ns FROM flat GROUP BY ALL")
simple("agg_traces_grouped", lambda s, d: ops.aggregate(ops.assemble(conversation_spans(s, d)), ["root_service"], [("sum", "span_count"), ("p95", "duration_ns"), ("min", "duration_ns")]),
       f"WITH {SPANS}, found AS (SELECT * FROM spans), {ASSEMBLED} SELECT root_service, count(*) AS n, CAST(sum(span_count) AS BIGINT) AS sum_span_count, quantile_disc(duration_ns, 0.95) AS p95_duration_ns, min(duration_ns) AS min_duration_ns FROM assembled GROUP BY ALL")
SUMMARY = """summary AS (SELECT service_name, count(*) AS spans, count(*) FILTER (status_code = 2) AS errors, count(*) FILTER (status_code = 2) / count(*) AS error_rate, round(avg(duration_ns), 4) AS avg_ns,
    quantile_disc(duration_ns, 0.5) AS p50_ns, quantile_disc(duration_ns, 0.95) AS p95_ns, quantile_disc(duration_ns, 0.99) AS p99_ns, max(duration_ns) AS max_ns FROM spans GROUP BY 1)"""
simple("service_summary", lambda s, d: ops.service_summary(conversation_spans(s, d)).withColumn("avg_ns", F.round("avg_ns", 4)), f"WITH {SPANS}, {SUMMARY} SELECT * FROM summary")
simple("service_buckets", lambda s, d: ops.service_metrics(conversation_spans(s, d)).select("service_name", "bucket", "spans", "errors"), f"""WITH {SPANS}, b AS (SELECT min(start_ns) AS lo, max(start_ns) AS hi FROM spans)
    SELECT service_name, CAST(least(19, floor((start_ns - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END / 20.0::DOUBLE))) AS INTEGER) AS bucket, count(*) AS spans, count(*) FILTER (status_code = 2) AS errors FROM spans, b GROUP BY ALL""")  # fmt: skip
simple("trace_insights", lambda s, d: ops.insights(ops.service_summary(conversation_spans(s, d))), f"""WITH {SPANS}, {SUMMARY}
    SELECT service_name, 'error_rate' AS kind, CASE WHEN error_rate > 0.15 THEN 'high' ELSE 'medium' END AS severity FROM summary WHERE error_rate > 0.05
    UNION ALL SELECT service_name, 'latency', CASE WHEN p99_ns > 2000000000 THEN 'high' ELSE 'medium' END FROM summary WHERE p99_ns > 500000000
    UNION ALL SELECT service_name, 'variance', 'medium' FROM summary WHERE p99_ns > p50_ns * 10""")  # fmt: skip
simple("trace_problems", lambda s, d: ops.problematic_traces(conversation_spans(s, d)), f"""WITH {SPANS}, p AS (SELECT service_name, quantile_disc(duration_ns, 0.99) AS p99 FROM spans GROUP BY 1),
    t AS (SELECT trace_id, count(*) AS span_count, count(*) FILTER (status_code = 2) AS error_count, bool_or(duration_ns > p99 * 1.5::DOUBLE) AS outlier, min(seq) AS first,
                 arg_min(service_name, seq) FILTER (parent_span_id IS NULL) AS root_service, arg_min(name, seq) FILTER (parent_span_id IS NULL) AS root_name,
                 coalesce(arg_min(end_ns - start_ns, seq) FILTER (parent_span_id IS NULL), max(end_ns - start_ns)) AS duration_ns FROM spans JOIN p USING (service_name) GROUP BY 1)
    SELECT trace_id, coalesce(root_service, 'unknown') AS root_service, coalesce(root_name, 'unknown') AS root_name, span_count, error_count, CAST(duration_ns AS BIGINT) AS duration_ns, outlier, duration_ns > 1000000000 AS slow,
           CASE WHEN error_count > 3 OR duration_ns > 5000000000 THEN 'high' ELSE 'medium' END AS severity FROM t WHERE error_count > 0 OR duration_ns > 1000000000 OR outlier
    ORDER BY CASE WHEN error_count > 3 OR duration_ns > 5000000000 THEN 2 ELSE 1 END, error_count DESC, first LIMIT 50""")  # fmt: skip
simple("trace_windows", lambda s, d: ops.time_windows(conversation_spans(s, d), 1000), f"WITH {SPANS} SELECT trace_id, CAST(min(start_ns) - 1000 AS BIGINT) AS from_ns, CAST(max(end_ns) + 1000 AS BIGINT) AS to_ns FROM spans GROUP BY 1")
simple("distinct_services", lambda s, d: conversation_spans(s, d).select("service_name").distinct(), f"WITH {SPANS} SELECT DISTINCT service_name FROM spans")
