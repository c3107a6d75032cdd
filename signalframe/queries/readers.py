"""Queries of readers, writers, layouts and views that work on files or documents, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import values
from ..operators import bench, drain, logs, metrics, records, traces
from ..plans.log_query import LogQuery
from ..plans.metric_query import MetricQuery, recipes
from ..sources import benchmarks, otlp
from ..sources.derived import conversation_spans, document_logs, event_logs, event_samples, event_spans, lineitem_points, table
from .bench import POINTS, series
from .metrics import DAY, SAMPLES, START
from .records import event_records
from .streams import _text, event_documents

HOUR = DAY // 24
QUERIES: dict = {}
ORACLES: dict = {}


def simple(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def folder(s: SparkSession) -> str:
    return f"{storage.shared_folder(s)}/files/{uuid.uuid4().hex}"


# OTLP readers
def _documents(s: SparkSession, rows: DataFrame, *parts) -> DataFrame:
    return otlp.parse(rows.select(_text(*parts).alias("value"), F.col("seq")))


def document_file(s: SparkSession, d: str) -> DataFrame:
    """Event documents as lines of files, with carriage returns and blank lines, read again."""
    path = folder(s)
    rows = event_documents(s, d).select(F.explode(F.array(F.concat("value", F.lit("\r")), F.lit(""), F.lit("  \r"))).alias("value"))
    rows.write.text(path, compression="gzip")
    points = otlp.metric_points(otlp.read_documents(s, path))
    return points.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


simple("otlp_file", document_file, """SELECT event_type || '_value' AS name, count(*) AS n, round(sum(CASE WHEN event_id % 3 = 0 THEN floor(value) ELSE value END), 4) AS total FROM events GROUP BY 1""")


def lenient_documents(s: SparkSession, d: str) -> DataFrame:
    """Every fourth line is broken or of no signal; the lenient reader passes over them."""
    texts = event_documents(s, d).select("seq", F.when(F.col("seq") % 8 == 0, "{broken").when(F.col("seq") % 8 == 4, '{"other":1}').otherwise(F.col("value")).alias("value"))
    return otlp.parse(texts, strict=False).groupBy("signal").agg(F.count("*").alias("n"))


simple("otlp_lenient", lenient_documents, "SELECT 'metrics' AS signal, count(*) AS n FROM events WHERE event_id % 4 <> 0")
simple("otlp_envelope", lambda s, d: otlp.envelope(event_documents(s, d), F.lit("2024-01-01T00:00:00Z").cast("timestamp"), "test").select("seq", "envelope.signal", "envelope.source", F.unix_micros("envelope.received_at").alias("received_us"), F.size("envelope.document.resourceMetrics").alias("resources")),
       "SELECT event_id AS seq, 'metrics' AS signal, 'test' AS source, 1704067200000000 AS received_us, 1 AS resources FROM events")
simple("otlp_raw_points", lambda s, d: otlp.raw_points(event_documents(s, d)).select(F.col("ordinal.seq").alias("seq"), "name", "kind", F.get("point_attributes", F.lit(0))["key"].alias("first_key"), F.get("resource_attributes", F.lit(0))["value"]["stringValue"].alias("service")),
       "SELECT event_id AS seq, event_type || '_value' AS name, 'gauge' AS kind, 'user.bucket' AS first_key, 'shop' AS service FROM events")


def summaries(s: SparkSession, d: str) -> DataFrame:
    """A summary of each event type's values: count, sum, and two quantiles; as samples."""
    g = table(s, d, "events").groupBy("event_type").agg(F.count("value").cast("string").alias("n"), F.floor(F.sum("value")).cast("string").alias("total"), F.floor(F.min("value")).cast("string").alias("low"), F.floor(F.max("value")).cast("string").alias("high")).withColumn("seq", F.lit(0).cast("long"))
    docs = _documents(s, g, '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"', F.col("event_type"), '","summary":{"dataPoints":[{"timeUnixNano":"1704067200000000000","count":"', F.col("n"), '","sum":', F.col("total"),
                      ',"quantileValues":[{"quantile":0,"value":', F.col("low"), '},{"quantile":0.5},{"quantile":1,"value":', F.col("high"), "}]}]}}]}]}]}")
    return otlp.to_samples(otlp.metric_points(docs)).select("metric", "value", F.element_at("labels", F.lit("quantile")).alias("quantile"))


simple("otlp_summary", summaries, """WITH g AS (SELECT event_type AS t, count(value) AS n, floor(sum(value)) AS total, floor(min(value)) AS low, floor(max(value)) AS high FROM events GROUP BY 1)
    SELECT unnest([t, t, t || '_count', t || '_sum']) AS metric, unnest([low, high, CAST(n AS DOUBLE), total]) AS value, unnest(['0', '1', NULL, NULL]) AS quantile FROM g""")  # fmt: skip


def exponentials(s: SparkSession, d: str) -> DataFrame:
    """Exponential histograms of lineitem by return flag: two positive buckets, one negative and zeros; as samples."""
    g = table(s, d, "lineitem").groupBy("l_returnflag").agg(*[F.count_if(c).cast("string").alias(n) for n, c in (("a", F.col("l_quantity") <= 20), ("b", F.col("l_quantity") > 20), ("z", F.col("l_discount") == 0), ("m", F.col("l_tax") == 0))], F.count("*").cast("string").alias("n")).withColumn("seq", F.lit(0).cast("long"))
    docs = _documents(s, g, '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"', F.col("l_returnflag"), '","exponentialHistogram":{"aggregationTemporality":2,"dataPoints":[{"timeUnixNano":"1704067200000000000","count":"', F.col("n"), '","sum":1.5,"scale":2,"zeroCount":"', F.col("z"),
                      '","positive":{"offset":3,"bucketCounts":["', F.col("a"), '","', F.col("b"), '"]},"negative":{"bucketCounts":["', F.col("m"), '"]}}]}}]}]}]}')
    out = otlp.to_samples(otlp.metric_points(docs))
    return out.select("metric", "value", *[F.element_at("labels", F.lit(k)).alias(k) for k in ("exp_side", "exp_bucket", "exp_scale")])


simple("otlp_exponential", exponentials, """WITH g AS (SELECT l_returnflag AS f, count(*) FILTER (l_quantity <= 20) AS a, count(*) FILTER (l_quantity > 20) AS b, count(*) FILTER (l_discount = 0) AS z, count(*) FILTER (l_tax = 0) AS m, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT unnest([f || '_bucket', f || '_bucket', f || '_bucket', f || '_bucket', f || '_count', f || '_sum']) AS metric, unnest([CAST(a AS DOUBLE), b, m, z, n, 1.5]) AS value,
           unnest(['positive', 'positive', 'negative', NULL, NULL, NULL]) AS exp_side, unnest(['3', '4', '0', 'zero', NULL, NULL]) AS exp_bucket, unnest(['2', '2', '2', '2', NULL, NULL]) AS exp_scale FROM g""")  # fmt: skip


def temporalities(s: SparkSession, d: str) -> DataFrame:
    """Sums of events, delta ones for even ids; those that are delta, by kind."""
    e = table(s, d, "events").select(F.col("event_id").alias("seq"))
    docs = _documents(s, e, '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"x","sum":{"isMonotonic":true,"aggregationTemporality":', F.when(F.col("seq") % 2 == 0, "1").otherwise("2"), ',"dataPoints":[{"asInt":"', F.col("seq").cast("string"), '","timeUnixNano":"1"}]}}]}]}]}')
    return otlp.metric_points(docs).where(otlp.is_delta()).select(F.col("ordinal.seq").alias("seq"), "value", "is_monotonic")


simple("otlp_delta", temporalities, "SELECT event_id AS seq, CAST(event_id AS DOUBLE) AS value, true AS is_monotonic FROM events WHERE event_id % 2 = 0")


def span_documents(s: SparkSession, d: str) -> DataFrame:
    """Spans of conversations written as documents and read again, with a span event each."""
    c = conversation_spans(s, d)
    parent = F.when(F.col("parent_span_id").isNotNull(), F.concat(F.lit('"parentSpanId":"'), "parent_span_id", F.lit('",'))).otherwise("")
    docs = _documents(s, c, '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"', F.col("service_name"), '"}}]},"scopeSpans":[{"scope":{"name":"lib","version":"1"},"spans":[{"traceId":"', F.col("trace_id"), '","spanId":"', F.col("span_id"), '",', parent,
                      '"name":"', F.col("name"), '","kind":', F.col("kind").cast("string"), ',"startTimeUnixNano":"', F.col("start_ns").cast("string"), '","endTimeUnixNano":"', F.col("end_ns").cast("string"), '","status":{"code":', F.col("status_code").cast("string"),
                      '},"attributes":[{"key":"size","value":{"intValue":"', F.element_at("attributes", F.lit("size")), '"}}],"events":[{"timeUnixNano":"', F.col("start_ns").cast("string"), '","name":"begin"}]}]}]}]}')
    return otlp.spans(docs)


simple("otlp_spans", lambda s, d: span_documents(s, d).select("trace_id", "span_id", "parent_span_id", "name", "kind", "start_ns", "duration_ns", "status_code", "service_name", "scope_name", F.element_at("attributes", F.lit("size")).alias("size"), F.get("events", F.lit(0))["name"].alias("event")),
       """SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(conv_id * 1000 + turn AS VARCHAR) AS span_id, CASE WHEN turn > 0 THEN CAST(conv_id * 1000 + (turn - 1) // 2 AS VARCHAR) END AS parent_span_id, role || '-turn' AS name,
          CAST(CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 2 ELSE 1 END AS INTEGER) AS kind, conv_id * 1000000000 + turn * 1000000 AS start_ns, length(coalesce(text, '')) * 20000 AS duration_ns,
          CAST(CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS status_code, role || '-' || (conv_id % 4) AS service_name, 'lib' AS scope_name, CAST(length(coalesce(text, '')) AS VARCHAR) AS size, 'begin' AS event FROM conversations""")  # fmt: skip


def log_documents(s: SparkSession, d: str) -> DataFrame:
    e = event_logs(s, d)
    docs = _documents(s, e, '{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"', F.col("stream"), '"}}]},"scopeLogs":[{"scope":{"name":"app"},"logRecords":[{"timeUnixNano":"', F.col("time_ns").cast("string"), '","severityNumber":', F.col("severity_number").cast("string"),
                      ',"severityText":"S","body":{"stringValue":"', F.col("body"), '"},"traceId":"', F.col("trace_id"), '","flags":1}]}]}]}')
    return otlp.logs(docs)


EVENT_LOGS = """SELECT event_id AS seq, epoch_us(ts) * 1000 AS time_ns, CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 ELSE 9 END AS severity_number,
    event_type || ' by user ' || user_id || ' k=' || coalesce(json_extract_string(props, '$.k'), '?') AS body, CAST(user_id AS VARCHAR) AS trace_id, 'svc-' || (user_id % 5) AS service FROM events"""
simple("otlp_logs", lambda s, d: log_documents(s, d).select(F.col("ordinal.seq").alias("seq"), "time_ns", "severity_number", "severity_text", "body", "body_kind", "trace_id", "flags", F.element_at("resource", F.lit("service.name")).alias("service")),
       f"SELECT seq, time_ns, CAST(severity_number AS INTEGER) AS severity_number, 'S' AS severity_text, body, 'string' AS body_kind, trace_id, CAST(1 AS INTEGER) AS flags, service FROM ({EVENT_LOGS})")


def payloads(s: SparkSession, d: str) -> DataFrame:
    """One-point documents of events, sums for purchases and gauges for the rest, read again."""
    e = table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.lit("").alias("unit"), "value", values.epoch_ns("ts").alias("ts_ns"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("attributes"), F.create_map(F.lit("service.name"), F.lit("emit")).alias("resource"))
    sums, gauges = (otlp.metric_payload(rows, kind, "delta", True) for rows, kind in ((e.where("name = 'purchase'"), "sum"), (e.where("name <> 'purchase'"), "gauge")))
    docs = otlp.parse(sums.unionByName(gauges).select(F.col("document").alias("value"), "seq"))
    return otlp.metric_points(docs).select(F.col("ordinal.seq").alias("seq"), "name", "kind", "value", "ts_ns", "temporality", "is_monotonic", F.element_at("attributes", F.lit("user")).alias("user"))


simple("otlp_metric_payload", payloads, """SELECT event_id AS seq, event_type AS name, CASE event_type WHEN 'purchase' THEN 'sum' ELSE 'gauge' END AS kind, value, epoch_us(ts) * 1000 AS ts_ns,
    CAST(CASE event_type WHEN 'purchase' THEN 1 END AS INTEGER) AS temporality, CASE event_type WHEN 'purchase' THEN true END AS is_monotonic, CAST(user_id AS VARCHAR) AS "user" FROM events""")  # fmt: skip
simple("otlp_context", lambda s, d: otlp.metric_points(otlp.parse(otlp.points_to_documents(lineitem_points(s, d).withColumn("point_ts_ns", F.lit(1).cast("long")), {"ci.branch": "main"}).withColumn("seq", F.lit(0).cast("long")))).groupBy(F.element_at("resource", F.lit("run.id")).alias("run_id"), F.element_at("resource", F.lit("ci.branch")).alias("branch")).agg(F.count("*").alias("n")),
       f"WITH {POINTS} SELECT run_id, 'main' AS branch, count(*) AS n FROM points GROUP BY 1")


def storage_report(s: SparkSession, d: str) -> DataFrame:
    rows = event_samples(s, d)
    return otlp.storage_report(rows, rows.where(F.col("seq") % 50 == 0))


simple("otlp_storage_report", storage_report, f"""WITH {SAMPLES}, ids AS (SELECT event_type || '|' || user_bucket || '|' || k AS id, * FROM samples)
    SELECT count(value) AS samples_inserted, count(*) - count(value) AS dropped, (SELECT count(DISTINCT id) FROM ids WHERE value IS NOT NULL AND id NOT IN (SELECT id FROM ids WHERE seq % 50 = 0)) AS series_created FROM ids""")  # fmt: skip

# layouts
def stored_samples(s: SparkSession, d: str) -> DataFrame:
    """Samples written in their layout, compacted, and read with a metric and a day pruned."""
    first, second = folder(s), folder(s)
    storage.write_samples(event_samples(s, d), first, files=6)
    storage.compact(s, first, second, ["metric", "day"])
    rows = s.read.parquet(second).where((F.col("metric") == "event_value") & (F.col("day") >= START // DAY + 3))
    return rows.groupBy(F.col("day").cast("long").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


simple("stored_samples", stored_samples, f"WITH {SAMPLES} SELECT ts_ns // {DAY} AS day, count(*) AS n, round(sum(value), 4) AS total FROM samples WHERE ts_ns // {DAY} >= {START // DAY + 3} GROUP BY 1")


def chunk_policy(s: SparkSession, d: str) -> DataFrame:
    """Samples in files of at most 40 rows."""
    path = folder(s)
    storage.write_samples(event_samples(s, d), path, files=1, max_rows=40, group_mb=8)
    return storage.table_stats(s.read.parquet(path)).select("files", "rows")


simple("stored_chunks", chunk_policy, f"WITH {SAMPLES}, n AS (SELECT count(*) AS n FROM samples GROUP BY ts_ns // {DAY}) SELECT CAST(sum(ceil(n / 40.0)) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS rows FROM n")


def stored_steps(s: SparkSession, d: str) -> DataFrame:
    """Averages by type over a store that was filled in two parts."""
    store, rows = storage.SampleStore(s, folder(s)), event_samples(s, d)
    for part in (0, 1):
        store.append(rows.where(F.col("seq") % 2 == part), files=2)
    q = MetricQuery().metric("event_value").range(START, START + 6 * DAY).step(DAY).avg_by("event_type")
    return q.over(store).select(F.element_at("labels", F.lit("event_type")).alias("event_type"), "ts_ns", F.round("value", 9).alias("value"))


simple("stored_steps", stored_steps, f"""WITH {SAMPLES}, grid AS (SELECT event_type, {START} + i * {DAY} AS ts_ns FROM (SELECT DISTINCT event_type FROM samples), range(7) r(i)),
    c AS (SELECT event_type, {START} + (ts_ns - {START}) // {DAY} * {DAY} AS ts_ns, avg(value) AS v FROM samples WHERE ts_ns BETWEEN {START} AND {START + 6 * DAY} GROUP BY 1, 2)
    SELECT event_type, ts_ns, round(v, 9) AS value FROM grid LEFT JOIN c USING (event_type, ts_ns)""")  # fmt: skip


def stored_spans(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    storage.write_spans(event_spans(s, d), path)
    return s.read.parquet(path).where("trace_id = '7'").select("span_id", "name", "duration_ns")


simple("stored_spans", stored_spans, "SELECT CAST(event_id AS VARCHAR) AS span_id, event_type AS name, CAST(floor(value * 1000) AS BIGINT) AS duration_ns FROM events WHERE user_id = 7")


def stored_logs(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    storage.write_logs(event_logs(s, d), path)
    return s.read.parquet(path).where("severity_number >= 17").groupBy("stream").agg(F.count("*").alias("n"), F.max("time_ns").alias("last_ns"))


simple("stored_logs", stored_logs, f"SELECT service AS stream, count(*) AS n, max(time_ns) AS last_ns FROM ({EVENT_LOGS}) WHERE severity_number >= 17 GROUP BY 1")
simple("stored_stats", lambda s, d: _stats(s, d), "SELECT 5 AS files, count(*) AS rows FROM events")


def _stats(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    event_samples(s, d).repartition(5).write.parquet(path)
    return storage.table_stats(s.read.parquet(path)).select("files", "rows")


simple("evicted_traces", lambda s, d: records.evicted(event_spans(s, d), 20_000, F.length("name"), F.col("trace_id"), F.col("start_ns")).groupBy("trace_id").agg(F.count("*").alias("n")),
       """WITH t AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, count(*) AS n, sum(length(event_type)) AS bytes, max(epoch_us(ts)) AS newest FROM events GROUP BY 1),
          k AS (SELECT *, sum(bytes) OVER (ORDER BY newest DESC, trace_id DESC) AS total FROM t) SELECT trace_id, n FROM k WHERE total <= 20000""")  # fmt: skip

# ingest and metric queries
simple("quantised", lambda s, d: metrics.quantised(event_samples(s, d), 1).select("seq", "value"), f"WITH {SAMPLES} SELECT seq, CASE WHEN value = floor(value) THEN value ELSE floor(value * 10 + 0.5) / 10 END AS value FROM samples")


def vectors(s: SparkSession, d: str) -> DataFrame:
    """Rows of one vector of times and several series of values."""
    t = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("times"))
    each = lambda name, k: F.struct(F.concat(F.lit(name), F.col("user_id").cast("string")).alias("series_id"), F.transform("times", lambda x: (x * k).cast("double")).alias("values"))
    return metrics.from_vectors(t.select("times", F.array(each("a", 2), each("b", -1)).alias("series")))


simple("vector_append", vectors, "SELECT unnest(['a' || user_id, 'b' || user_id]) AS series_id, event_id AS ts_ns, unnest([CAST(event_id * 2 AS DOUBLE), -event_id]) AS value FROM events")


def _rolled(s: SparkSession, d: str, fn: str) -> DataFrame:
    """Steps of seven hours from an odd start, answered from a rollup of hours and, at the edges, from samples."""
    rows = event_samples(s, d).where("value is not null")
    rolled, keys = metrics.with_group(metrics.rollup(rows, HOUR), ("event_type",))
    samples, _ = metrics.with_group(rows, ("event_type",))
    start = START + 3 * DAY + HOUR // 2
    out = metrics.step_from_rollup(rolled, samples, HOUR, keys, fn, start, START + 12 * DAY, 7 * HOUR)
    return out.select(F.col("g0").alias("event_type"), F.col("bucket").alias("ts_ns"), F.round("value", 6).alias("value"))


for _fn in ("sum", "avg", "min", "max", "count"):
    simple(f"rollup_{_fn}", lambda s, d, fn=_fn: _rolled(s, d, fn), f"""WITH {SAMPLES} SELECT event_type, {START + 3 * DAY + HOUR // 2} + (ts_ns - {START + 3 * DAY + HOUR // 2}) // {7 * HOUR} * {7 * HOUR} AS ts_ns, round(CAST({_fn}(value) AS DOUBLE), 6) AS value
        FROM samples WHERE value IS NOT NULL AND ts_ns BETWEEN {START + 3 * DAY + HOUR // 2} AND {START + 12 * DAY} GROUP BY 1, 2""")  # fmt: skip


def daily(s: SparkSession, d: str) -> DataFrame:
    day = (F.col("ts_ns") - F.pmod("ts_ns", F.lit(DAY))).alias("ts_ns")
    return event_samples(s, d).groupBy(F.element_at("labels", F.lit("user_bucket")).alias("series_id"), day).agg(F.round(F.sum("value"), 6).alias("value"))


DAILY = f"daily AS (SELECT user_bucket AS series_id, ts_ns - ts_ns % {DAY} AS ts_ns, round(sum(value), 6) AS value FROM samples GROUP BY 1, 2)"
for _name, _large in (("topk", True), ("bottomk", False)):
    simple(_name, lambda s, d, g=_large: metrics.topk(daily(s, d), 3, largest=g), f"WITH {SAMPLES}, {DAILY} SELECT * FROM daily WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts_ns ORDER BY value {'DESC' if _large else 'ASC'}, series_id) <= 3")
simple("metric_accounting", lambda s, d: _accounting(s, d), f"WITH {SAMPLES} SELECT count(DISTINCT user_bucket || '|' || k) AS scanned_series, count(*) AS scanned_samples, count(*) AS emitted FROM samples WHERE event_type = 'view'")


def _accounting(s: SparkSession, d: str) -> DataFrame:
    scanned = metrics.observed(metrics.select_series(event_samples(s, d), "event_value", [("event_type", "=", "view")]), "scan")
    return metrics.accounted(MetricQuery().metric("event_value").range(START - DAY, START + 4000 * DAY).frame(scanned), scanned)


simple("metric_mapped", lambda s, d: MetricQuery().metric("event_value").where("event_type", "=", "view").range(START, START + 10 * DAY).map_points(lambda v: v * 2 + 1).filter_series(lambda m: F.element_at(m, F.lit("user_bucket")) == "3").map_series(lambda m: F.map_filter(m, lambda k, _: k == "k")).frame(event_samples(s, d)).select("seq", "ts_ns", F.round("value", 6).alias("value"), F.array_join(F.map_keys("labels"), ",").alias("keys")),
       f"WITH {SAMPLES} SELECT seq, ts_ns, round(value * 2 + 1, 6) AS value, 'k' AS keys FROM samples WHERE event_type = 'view' AND user_bucket = '3' AND ts_ns BETWEEN {START} AND {START + 10 * DAY}")
simple("metric_recipe", lambda s, d: recipes("event_value", START, START + 5 * DAY, DAY, ("event_type",))["count"].frame(event_samples(s, d)).select(F.element_at("labels", F.lit("event_type")).alias("event_type"), "ts_ns", "value"),
       f"""WITH {SAMPLES}, grid AS (SELECT event_type, {START} + i * {DAY} AS ts_ns FROM (SELECT DISTINCT event_type FROM samples), range(6) r(i)),
           c AS (SELECT event_type, {START} + (ts_ns - {START}) // {DAY} * {DAY} AS ts_ns, count(value) AS n FROM samples WHERE ts_ns BETWEEN {START} AND {START + 5 * DAY} GROUP BY 1, 2)
           SELECT event_type, ts_ns, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM grid LEFT JOIN c USING (event_type, ts_ns)""")  # fmt: skip
simple("group_by_advice", lambda s, d: metrics.group_by_advice(metrics.metadata(event_samples(s, d))).select("label", "rank"), f"""WITH {SAMPLES}, l AS (SELECT unnest(['event_type', 'user_bucket', 'k']) AS label, unnest([event_type, user_bucket, k]) AS v, event_type || '|' || user_bucket || '|' || k AS id FROM samples),
    m AS (SELECT label, count(DISTINCT v) AS nv, count(DISTINCT id) AS ns FROM l GROUP BY 1),
    sc AS (SELECT label, CASE WHEN nv <= 1 THEN 0.0 WHEN nv >= ns THEN 1.0 / nv ELSE ns / nv END AS score FROM m) SELECT label, CAST(row_number() OVER (ORDER BY score DESC, label) AS INTEGER) AS rank FROM sc""")  # fmt: skip


def refused(s: SparkSession, d: str) -> DataFrame:
    """Queries that a builder refuses, each with whether it did."""
    q = MetricQuery().metric("m").range(0, 10)
    tries = {
        "no step": lambda: q.step(0), "two transforms": lambda: q.rate().delta(), "transform after aggregate": lambda: q.sum().rate(), "step alone": lambda: q.step(5).plan(), "two aggregates": lambda: q.sum().max(),
        "percentile without step": lambda: q.p95().plan(), "long pattern": lambda: q.where("a", "=~", "x" * 201), "unknown matcher": lambda: q.where("a", "~", "x"), "fine": lambda: q.step(5).sum().plan(),
    }
    rows = []
    for name, attempt in tries.items():
        try:
            attempt()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return s.createDataFrame(rows, "attempt string, refused boolean")


simple("refused_queries", refused, "SELECT * FROM (VALUES ('no step', true), ('two transforms', true), ('transform after aggregate', true), ('step alone', true), ('two aggregates', true), ('percentile without step', true), ('long pattern', true), ('unknown matcher', true), ('fine', false)) v(attempt, refused)")

# records and views
ALL_RECORDS = f"""SELECT 'metrics' AS signal, 'event_value' AS name, ts_ns, value, seq FROM samples UNION ALL
    SELECT 'traces', event_type, epoch_us(ts) * 1000, CAST(CAST(floor(value * 1000) AS BIGINT) // 1000000 AS DOUBLE), event_id FROM events UNION ALL SELECT 'logs', NULL, epoch_us(ts) * 1000, NULL, event_id FROM events"""
simple("collected_records", lambda s, d: records.collected(event_records(s, d), [event_spans(s, d), [event_logs(s, d)]]).select("signal", "name", "ts_ns", "value", "seq"), f"WITH {SAMPLES} {ALL_RECORDS}")
simple("record_values", lambda s, d: records.from_points(otlp.metric_points(_histograms(s, d))).select("name", "value", "ts_ns"), "SELECT l_returnflag AS name, CAST(floor(sum(l_quantity)) AS DOUBLE) / count(*) AS value, 5 AS ts_ns FROM lineitem GROUP BY 1")


def _histograms(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").cast("string").alias("n"), F.floor(F.sum("l_quantity")).cast("string").alias("q")).withColumn("seq", F.lit(0).cast("long"))
    return _documents(s, g, '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"', F.col("l_returnflag"), '","histogram":{"dataPoints":[{"startTimeUnixNano":"5","count":"', F.col("n"), '","sum":', F.col("q"), "}]}}]}]}]}")


simple("series_keys", lambda s, d: event_records(s, d).select("seq", records.series_key().alias("series"), records.series_label().alias("label")), f"""WITH {SAMPLES} SELECT seq, 'event_value:{{"event_type":"' || event_type || '","k":"' || k || '","user_bucket":"' || user_bucket || '"}}' AS series,
    'event_value (event_type=' || event_type || ', k=' || k || ', user_bucket=' || user_bucket || ')' AS label FROM samples""")  # fmt: skip
simple("aligned_curves", lambda s, d: records.align(*(daily(s, d).where(F.col("series_id") == b).where(c).select(F.col("ts_ns").alias("x"), F.col("value").alias("y")) for b, c in (("1", f"ts_ns < {START + 20 * DAY}"), ("2", f"ts_ns >= {START + 10 * DAY}")))),
       f"WITH {SAMPLES}, {DAILY} SELECT coalesce(a.ts_ns, b.ts_ns) AS x, a.value AS baseline, b.value AS current FROM (SELECT * FROM daily WHERE series_id = '1' AND ts_ns < {START + 20 * DAY}) a FULL JOIN (SELECT * FROM daily WHERE series_id = '2' AND ts_ns >= {START + 10 * DAY}) b USING (ts_ns)")
simple("split_rows", lambda s, d: _split(s, d), f"WITH {POINTS} SELECT metric LIKE 'avg_p%' AS matched, count(*) AS n FROM points GROUP BY 1")


def _split(s: SparkSession, d: str) -> DataFrame:
    met, rest = records.partition_by(lineitem_points(s, d), F.col("metric").startswith("avg_p"))
    return met.withColumn("matched", F.lit(True)).unionByName(rest.withColumn("matched", F.lit(False))).groupBy("matched").agg(F.count("*").alias("n"))


simple("distinct_tags", lambda s, d: records.distinct_tags(lineitem_points(s, d)), "SELECT DISTINCT 'status' AS tag, l_linestatus AS tag_value FROM lineitem")
simple("line_series", lambda s, d: records.line_series(daily(s, d).withColumns({"labels": F.create_map(F.lit("bucket"), "series_id"), "seq": F.lit(0)})).select("series_id", F.element_at("labels", F.lit("bucket")).alias("bucket"), F.size("points").cast("long").alias("n"), F.get("points", F.lit(0))["time_ms"].alias("first_ms"), F.element_at("points", -1)["value"].alias("last_value")),
       f"WITH {SAMPLES}, {DAILY} SELECT series_id, series_id AS bucket, count(*) AS n, CAST(min(ts_ns) / 1000000 AS DOUBLE) AS first_ms, arg_max(value, ts_ns) AS last_value FROM daily GROUP BY 1")


def frame_of(s: SparkSession, d: str) -> DataFrame:
    return daily(s, d).select(F.col("series_id").alias("key"), F.col("ts_ns").alias("bucket_ns"), "value")


simple("chart_rows", lambda s, d: records.chart_rows(frame_of(s, d)).withColumn("exact", F.lit(True)), f"WITH {SAMPLES}, {DAILY} SELECT series_id AS id, series_id AS label, CAST(ts_ns / 1000000 AS DOUBLE) AS time_ms, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.') || '000Z' AS iso_time, value, true AS exact FROM daily")


def latest(s: SparkSession, d: str) -> DataFrame:
    return frame_of(s, d).groupBy("key").agg(F.max_by("value", "bucket_ns").alias("value"))


simple("latest_rows", lambda s, d: records.latest_rows(latest(s, d)), f"WITH {SAMPLES}, {DAILY} SELECT series_id AS id, series_id AS label, arg_max(value, ts_ns) AS value FROM daily GROUP BY 1")
simple("gauge", lambda s, d: records.gauge_value(latest(s, d)), f"WITH {SAMPLES}, {DAILY}, l AS (SELECT arg_max(value, ts_ns) AS v FROM daily GROUP BY series_id) SELECT CAST(floor(greatest(0, least(200, avg(v))) + 0.5) AS BIGINT) AS gauge FROM l")
simple("histogram_rows", lambda s, d: records.histogram_rows(records.histogram(event_samples(s, d), 5)).select(F.round("start", 9).alias("start"), F.round("end", 9).alias("end"), "count"),
       """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 5 AS w FROM events), c AS (SELECT CAST(least(4, greatest(0, floor((value - lo) / w))) AS INTEGER) AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1)
          SELECT round(lo + g * w, 9) AS start, round(lo + (g + 1) * w, 9) AS "end", coalesce(n, 0) AS count FROM b, range(5) r(g) LEFT JOIN c ON c.bin = g""")  # fmt: skip
simple("event_timeline", lambda s, d: records.event_timeline(event_logs(s, d), event_spans(s, d).withColumn("events", F.array(F.struct(F.col("start_ns").alias("time_ns"), F.lit("start").alias("name"))))).select("source", "ts_ns", "name", "trace_id", "seq"),
       f"SELECT 'log' AS source, time_ns AS ts_ns, body AS name, trace_id, seq FROM ({EVENT_LOGS}) UNION ALL SELECT 'span', time_ns, 'start', trace_id, seq FROM ({EVENT_LOGS})")
simple("value_functions", lambda s, d: _values(s, d), """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CASE WHEN value = 0 THEN 0.0 ELSE 100.0 END ELSE round((value - user_id % 3) / (user_id % 3) * 100, 6) END AS change, lower(hex(event_type)) AS hex, event_type AS back,
    substr(md5(event_type), 1, 8) || '-' || substr(md5(event_type), 9, 4) || '-' || substr(md5(event_type), 13, 4) || '-' || substr(md5(event_type), 17, 4) || '-' || substr(md5(event_type), 21, 12) AS uuid,
    strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, true AS same FROM events""")  # fmt: skip


def _values(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    before = (F.col("user_id") % 3).cast("double")
    return e.select("event_id", F.round(values.percent_change(before, "value"), 6).alias("change"), values.hex_text(F.col("event_type").cast("binary")).alias("hex"), values.hex_bytes(values.hex_text(F.col("event_type").cast("binary"))).cast("string").alias("back"),
                    values.uuid_text(values.uuid_bytes(values.uuid_text(F.unhex(F.md5("event_type"))))).alias("uuid"), values.iso_text(values.epoch_ns("ts")).alias("iso"), values.json_equal(F.lit('{"a":1,"b":[2]}'), F.lit('{"b":[2],"a":1}')).alias("same"))


# traces
SPANS = "spans AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS size, CASE WHEN length(coalesce(text, '')) % 7 = 0 THEN 2 ELSE 1 END AS status, conv_id * 1000 + turn AS seq FROM conversations)"
simple("span_fields", lambda s, d: conversation_spans(s, d).groupBy(traces.span_group("status").alias("status"), traces.span_group("kind").alias("kind"), traces.span_group("span.role").alias("role"), traces.span_group("other").alias("other")).agg(F.sum(traces.span_number("span.size")).alias("size"), F.max(traces.span_number("startTime")).alias("start_ms"), F.min(traces.span_number("duration")).alias("least"), F.count(traces.span_number("role")).alias("none")),
       f"WITH {SPANS} SELECT CASE status WHEN 1 THEN 'OK' ELSE 'ERROR' END AS status, CASE role WHEN 'user' THEN 'CLIENT' WHEN 'assistant' THEN 'SERVER' ELSE 'INTERNAL' END AS kind, role, '<missing>' AS other, CAST(sum(size) AS DOUBLE) AS size, CAST(max(conv_id * 1000 + turn) AS DOUBLE) AS start_ms, CAST(min(size * 20000) AS DOUBLE) AS least, 0 AS none FROM spans GROUP BY 1, 2, 3")
simple("trace_fields", lambda s, d: traces.trace_rows(_rootless(s, d)).select("trace_id", "spanCount", "duration", "rootService", "rootName"),
       f"WITH {SPANS}, s AS (SELECT * FROM spans WHERE NOT (turn = 0 AND conv_id % 3 = 0)) SELECT CAST(conv_id AS VARCHAR) AS trace_id, count(*) AS spanCount, coalesce(max(CASE WHEN turn = 0 THEN size * 20000 END), max(size * 20000)) AS duration, coalesce(max(CASE WHEN turn = 0 THEN role || '-' || (conv_id % 4) END), '<no root>') AS rootService, coalesce(max(CASE WHEN turn = 0 THEN role || '-turn' END), '<no root>') AS rootName FROM s GROUP BY conv_id")


def _rootless(s: SparkSession, d: str) -> DataFrame:
    return conversation_spans(s, d).where(~(F.col("parent_span_id").isNull() & (F.col("trace_id").cast("long") % 3 == 0)))


simple("trace_ids", lambda s, d: traces.trace_ids(conversation_spans(s, d)), "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS trace_id FROM conversations")
simple("trace_services", lambda s, d: traces.service_names(conversation_spans(s, d)), "SELECT DISTINCT role || '-' || (conv_id % 4) AS service_name FROM conversations")
simple("trace_lenient", lambda s, d: conversation_spans(s, d).where(traces.lenient_filter(name="USER|assist", kind=-1, min_ms=0.1, attributes=[("size", ">", "20"), ("absent", "!=", "x"), ("", "=", "y")])).select("span_id"),
       f"WITH {SPANS} SELECT CAST(seq AS VARCHAR) AS span_id FROM spans WHERE role IN ('user', 'assistant') AND size * 20000 >= 100000 AND size > 20")
simple("service_durations", lambda s, d: traces.service_metrics(event_spans(s, d), 10).withColumn("avg_ns", F.round("avg_ns", 4)), """WITH e AS (SELECT 'svc-' || (user_id % 5) AS service_name, epoch_us(ts) * 1000 AS t, CAST(floor(value * 1000) AS BIGINT) AS d, event_type = 'error' AS err FROM events),
    b AS (SELECT min(t) AS lo, (max(t) - min(t)) / 10.0 AS w FROM e)
    SELECT service_name, CAST(least(9, floor((t - lo) / w)) AS INTEGER) AS bucket, count(*) AS spans, count(*) FILTER (err) AS errors, round(avg(d), 4) AS avg_ns, quantile_disc(d, 0.5) AS p50_ns, quantile_disc(d, 0.95) AS p95_ns, quantile_disc(d, 0.99) AS p99_ns FROM e, b GROUP BY 1, 2""")  # fmt: skip
simple("span_lanes", lambda s, d: traces.lane_rows(traces.waterfall(conversation_spans(s, d))).select("trace_id", "label", F.round("start_ms", 6).alias("start_ms"), F.round("end_ms", 6).alias("end_ms")),
       f"WITH {SPANS} SELECT CAST(conv_id AS VARCHAR) AS trace_id, role || '-turn' AS label, round(CAST(turn - min(turn) OVER (PARTITION BY conv_id) AS DOUBLE), 6) AS start_ms, round(turn - min(turn) OVER (PARTITION BY conv_id) + size * 20000 / 1000000.0, 6) AS end_ms FROM spans")
simple("service_graph_by_role", lambda s, d: traces.service_graph(conversation_spans(s, d), F.element_at("attributes", F.lit("role"))).select("source", "target", "calls"),
       f"WITH {SPANS} SELECT p.role AS source, c.role AS target, count(*) AS calls FROM spans c JOIN spans p ON p.conv_id = c.conv_id AND p.turn = (c.turn - 1) // 2 AND c.turn > 0 WHERE p.role = 'user' AND c.role = 'assistant' GROUP BY 1, 2")

# logs
simple("log_iterated", lambda s, d: s.createDataFrame([(r.seq, r.severity_number) for r in LogQuery(severity_gte=17, limit=40).iterate(document_logs(s, d))], "seq long, severity_number int"), "SELECT doc_id AS seq, CAST(doc_id % 24 + 1 AS INTEGER) AS severity_number FROM documents WHERE doc_id % 24 + 1 >= 17 ORDER BY source || '/' || lang, doc_id LIMIT 40")
simple("log_overview", lambda s, d: logs.analysis(event_logs(s, d))["services"], f"SELECT service, count(*) AS n, count(*) FILTER (severity_number >= 17) AS errors, count(*) FILTER (severity_number >= 17) / count(*) AS error_rate FROM ({EVENT_LOGS}) GROUP BY 1")


simple("log_query_stats", lambda s, d: logs.query_stats(event_logs(s, d), logs.log_filter(severity_gte=17)), f"SELECT count(DISTINCT service) AS streams, count(DISTINCT service) FILTER (severity_number >= 17) AS streams_hit, count(*) AS scanned, count(*) FILTER (severity_number >= 17) AS emitted FROM ({EVENT_LOGS})")


class _FirstWord:
    """A template extractor that tells lines apart by their first word alone."""

    def __init__(self) -> None:
        self.templates: list[list[str]] = []
        self.ids: dict[tuple, int] = {}

    def add(self, line: str) -> tuple[int]:
        words = drain.tokens_of(line)
        key = (len(words), *words[:1])
        if key not in self.ids:
            self.templates.append([*words[:1], *[drain.WILDCARD] * (len(words) - 1)])
            self.ids[key] = len(self.templates)
        return (self.ids[key],)


simple("log_own_miner", lambda s, d: drain.mine(event_logs(s, d), miner=_FirstWord).groupBy("stream", "template").agg(F.count("*").alias("n"), F.max(F.element_at("variables", 3)).alias("greatest")),
       f"SELECT service AS stream, split_part(body, ' ', 1) || repeat(' <*>', 4) AS template, count(*) AS n, max(split_part(body, ' ', 4)) AS greatest FROM ({EVENT_LOGS}) GROUP BY 1, 2")


def uuid_slots(s: SparkSession, d: str) -> DataFrame:
    """Lines with a number, a prefixed number and a prefixed UUID."""
    h = F.md5(F.col("event_id").cast("string"))
    body = F.concat(F.lit("start of the job "), F.col("event_id").cast("string"), F.lit(" by u"), F.col("user_id").cast("string"), F.lit(" with id-"), F.substring(h, 1, 8), F.lit("-1111-2222-3333-"), F.substring(h, 1, 12))
    rows = table(s, d, "events").select(F.lit("one").alias("stream"), F.col("event_id").alias("seq"), body.alias("body"))
    return drain.slot_types(drain.mine(rows)).select("slot", "n", "kind")


simple("log_slot_kinds", uuid_slots, "SELECT CAST(slot AS INTEGER) AS slot, n, kind FROM (SELECT count(*) AS n FROM events), (VALUES (0, 'integer'), (1, 'prefixed_integer'), (2, 'prefixed_uuid')) v(slot, kind)")
simple("record_predicate", lambda s, d: event_records(s, d).where(records.record_filter(attributes={"event_type": lambda v: v.startswith("c"), "user_bucket": lambda v: v.cast("int") > 6})).select("seq"), f"WITH {SAMPLES} SELECT seq FROM samples WHERE event_type LIKE 'c%' AND CAST(user_bucket AS INTEGER) > 6")
simple("extremes_thinned", lambda s, d: records.extremes(frame_of(s, d), 4, 6).groupBy("key").agg(F.count("*").alias("n")), f"WITH {SAMPLES}, {DAILY} SELECT series_id AS key, 6 AS n FROM daily GROUP BY 1")

# benchmark results
def go_lines(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_id").cast("string").alias("file"), F.floor(F.col("value") * 100).cast("long").alias("v"), "user_id")
    return e.select("file", F.concat(F.lit("test bench_"), F.col("user_id").cast("string"), F.lit(" ... bench: "), F.format_number("v", 0), F.lit(" ns/iter (+/- 5)")).alias("line"))


RUST = "SELECT CAST(event_id AS VARCHAR) AS file, 'bench_' || user_id AS scenario, '{}' AS metric, CAST(floor(value * 100) AS DOUBLE) AS value, 'ns/iter' AS unit, 'smaller_is_better' AS direction FROM events WHERE value IS NOT NULL"
NAMES = ["file", "scenario", "metric", "value", "unit", "direction"]
simple("bench_parse_rust", lambda s, d: benchmarks.parse_rust(go_lines(s, d)).select(*NAMES), RUST.format("ns_per_iter"))
simple("bench_lenient_rust", lambda s, d: benchmarks.lenient_rust(go_lines(s, d).withColumn("line", F.concat(F.lit("\u001b[32m"), "line", F.lit("\u001b[0m")))).select(*NAMES), RUST.format("ns_per_iter"))


def json_files(s: SparkSession, d: str, *parts) -> DataFrame:
    e = table(s, d, "events").where("value is not null").withColumn("v", F.round("value", 3).cast("string"))
    return e.select(F.col("event_id").cast("string").alias("file"), _text(*parts).alias("content"))


def hyperfine() -> tuple:
    return ('{"results":[{"command":"', F.col("event_type"), '","mean":', F.col("v"), ',"min":1}]}')


simple("bench_parse_hyperfine", lambda s, d: benchmarks.parse_hyperfine(json_files(s, d, *hyperfine())).select(*NAMES), """SELECT CAST(event_id AS VARCHAR) AS file, event_type AS scenario, unnest(['mean', 'min']) AS metric, unnest([round(value, 3), 1.0]) AS value, 's' AS unit, 'smaller_is_better' AS direction FROM events WHERE value IS NOT NULL""")
simple("bench_lenient_hyperfine", lambda s, d: benchmarks.lenient_hyperfine(json_files(s, d, *hyperfine())).select(*NAMES), """SELECT CAST(event_id AS VARCHAR) AS file, event_type AS scenario, unnest(['mean', 'stddev', 'median', 'min', 'max']) AS metric, unnest([round(value, 3), 0.0, 0.0, 1.0, 0.0]) AS value, 's' AS unit, 'smaller_is_better' AS direction FROM events WHERE value IS NOT NULL""")
def pytest() -> tuple:
    return ('{"benchmarks":[{"name":"', F.col("event_type"), '","stats":{"mean":', F.col("v"), ',"ops":4}},{"name":"empty"}]}')


simple("bench_parse_pytest", lambda s, d: benchmarks.parse_pytest(json_files(s, d, *pytest())).select(*NAMES), """SELECT CAST(event_id AS VARCHAR) AS file, event_type AS scenario, unnest(['mean', 'ops']) AS metric, unnest([round(value, 3), 4.0]) AS value, unnest(['s', 'ops/s']) AS unit, unnest(['smaller_is_better', 'bigger_is_better']) AS direction FROM events WHERE value IS NOT NULL""")
simple("bench_lenient_pytest", lambda s, d: benchmarks.lenient_pytest(json_files(s, d, *pytest())).where("metric in ('mean', 'max', 'ops', 'rounds')").select(*NAMES), """SELECT CAST(event_id AS VARCHAR) AS file, event_type AS scenario, unnest(['mean', 'max', 'ops', 'rounds']) AS metric, unnest([round(value, 3), 0.0, 4.0, 0.0]) AS value, unnest(['s', 's', 'ops/s', NULL]) AS unit,
    unnest(['smaller_is_better', 'smaller_is_better', 'bigger_is_better', 'bigger_is_better']) AS direction FROM events WHERE value IS NOT NULL""")  # fmt: skip
def named() -> tuple:
    return ('[{"name":"', F.col("event_type"), '","value":', F.col("v"), ',"unit":"ops/s"},{"name":"x","unit":"ms"},{"name":"", "value":1,"unit":"q"}]')


simple("bench_lenient_named", lambda s, d: benchmarks.lenient_named_values(json_files(s, d, *named())).select(*NAMES), "SELECT CAST(event_id AS VARCHAR) AS file, event_type AS scenario, 'value' AS metric, round(value, 3) AS value, 'ops/s' AS unit, 'bigger_is_better' AS direction FROM events WHERE value IS NOT NULL")
simple("bench_parse_named", lambda s, d: benchmarks.parse_named_values(json_files(s, d, '[{"name":"', F.col("event_type"), '","value":', F.col("v"), ',"unit":"ms"}]')).select(*NAMES), "SELECT CAST(event_id AS VARCHAR) AS file, event_type AS scenario, 'value' AS metric, round(value, 3) AS value, 'ms' AS unit, 'smaller_is_better' AS direction FROM events WHERE value IS NOT NULL")


def mixed_files(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("value is not null").withColumn("v", F.round("value", 3).cast("string"))
    k = F.col("event_id") % 4
    content = F.when(k == 0, _text(*hyperfine())).when(k == 1, _text('[{"name":"a","value":', F.col("v"), ',"unit":"ms"}]')).when(k == 2, _text("goos: linux\nBenchmarkX-4 10 ", F.col("v"), " ns/op\n")).otherwise(_text("test t ... bench: 7 ns/iter (+/- 1)"))
    return e.select(F.col("event_id").cast("string").alias("file"), content.alias("content"))


simple("bench_detected", lambda s, d: mixed_files(s, d).groupBy(benchmarks.detected().alias("format")).agg(F.count("*").alias("n")), "SELECT (['hyperfine', 'named', 'go', 'rust'])[event_id % 4 + 1] AS format, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
simple("bench_parse_any", lambda s, d: benchmarks.parse_any(mixed_files(s, d)).select("file", "scenario", "metric", "value"), """SELECT CAST(event_id AS VARCHAR) AS file, unnest(CASE event_id % 4 WHEN 0 THEN [event_type, event_type] WHEN 1 THEN ['a'] WHEN 2 THEN ['BenchmarkX'] ELSE ['t'] END) AS scenario,
    unnest(CASE event_id % 4 WHEN 0 THEN ['mean', 'min'] WHEN 1 THEN ['value'] WHEN 2 THEN ['ns/op'] ELSE ['ns_per_iter'] END) AS metric, unnest(CASE event_id % 4 WHEN 0 THEN [round(value, 3), 1.0] WHEN 3 THEN [7.0] ELSE [round(value, 3)] END) AS value FROM events WHERE value IS NOT NULL""".replace("'ns/op'", "'ns_per_op'"))  # fmt: skip


def run_files(s: SparkSession, d: str) -> DataFrame:
    """A folder of runs: a JSON file for each event type, and a folder with two files for each user bucket."""
    path = folder(s)
    e = table(s, d, "events")
    flat = e.select("event_type").distinct().select(F.concat("event_type", F.lit(".json")).alias("name"), F.lit('{"a":1}').alias("value"))
    nested = e.select((F.col("user_id") % 3).cast("string").alias("b")).distinct().select(F.explode(F.array(F.concat(F.lit("run-"), "b", F.lit("/x.otlp.json")), F.concat(F.lit("run-"), "b", F.lit("/y.otlp.jsonl")), F.concat(F.lit("run-"), "b", F.lit("/note.txt")))).alias("name"), F.lit('{"b":2}\n{"c":3}\nbroken').alias("value"))
    conf = s._jsparkSession.sessionState().newHadoopConf()
    for row in flat.unionByName(nested).collect():  # some twenty fixture files
        at = s._jvm.org.apache.hadoop.fs.Path(f"{path}/{row.name}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(row.value.encode()))
        out.close()
    return benchmarks.read_runs(s, path)


simple("bench_run_files", lambda s, d: run_files(s, d).groupBy("run_id").agg(F.count("*").alias("files")), "SELECT event_type AS run_id, 1 AS files FROM events GROUP BY 1 UNION ALL SELECT 'run-' || (user_id % 3), 2 FROM events GROUP BY 1")
simple("bench_run_errors", lambda s, d: benchmarks.run_lines(run_files(s, d), strict=False).groupBy("run_id").agg(F.count("*").alias("lines"), F.count("error").alias("errors"), F.max(F.when(F.col("error").isNotNull(), F.regexp_extract("error", ":([0-9]+)$", 1))).alias("at")),
       "SELECT event_type AS run_id, 1 AS lines, 0 AS errors, NULL AS at FROM events GROUP BY 1 UNION ALL SELECT 'run-' || (user_id % 3), 6, 2, '3' FROM events GROUP BY 1")
simple("bench_context", lambda s, d: benchmarks.merged_context(table(s, d, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("seq"), F.when(F.col("user_id") % 4 == 1, F.col("user_id").cast("string")).alias("branch"), F.when(F.col("user_id") % 9 == 2, F.col("event_id").cast("string")).alias("commit")), ["branch", "commit"]),
       'SELECT event_type AS run_id, arg_min(CAST(user_id AS VARCHAR), event_id) FILTER (user_id % 4 = 1) AS branch, arg_min(CAST(event_id AS VARCHAR), event_id) FILTER (user_id % 9 = 2) AS "commit" FROM events GROUP BY 1')
simple("bench_monitor_points", lambda s, d: benchmarks.monitor_points(lineitem_points(s, d).withColumn("metric", F.when(F.col("scenario") == "A", F.concat(F.lit("_monitor/"), "metric")).otherwise(F.col("metric")))).groupBy("scenario", "role", "metric").agg(F.count("*").alias("n")),
       f"WITH {POINTS} SELECT CASE scenario WHEN 'A' THEN '_monitor/A' ELSE scenario END AS scenario, CASE scenario WHEN 'A' THEN 'diagnostic' ELSE 'outcome' END AS role, CASE scenario WHEN 'A' THEN '_monitor/' || metric ELSE metric END AS metric, count(*) AS n FROM points GROUP BY 1, 2, 3")


def ci(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("workflow"), F.col("o_orderstatus").alias("conclusion"), F.lit("push").alias("event"), (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, 0, cast(o_orderkey % 86400 as int))")).cast("timestamp").alias("created_at"))


simple("ci_runs", lambda s, d: benchmarks.ci_runs(ci(s, d), workflows=["1-URGENT"], events=["push"], conclusions=["F", "O"], max_runs=25).select("id"), "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O') ORDER BY o_orderdate + to_seconds(o_orderkey % 86400) DESC LIMIT 25")
simple("ci_since", lambda s, d: s.range(3).select("id", F.unix_seconds(benchmarks.resolve_since(F.when(F.col("id") == 0, "2024-05-01T00:00:00Z").otherwise("nothing"), F.when(F.col("id") == 1, "2024-04-01T00:00:00Z"), "2024-06-01T00:00:00Z", 24)).alias("since")), "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(1714521600 AS BIGINT)), (1, 1711929600), (2, 1717113600)) v(id, since)")
simple("process_descendants", lambda s, d: benchmarks.descendants(s.range(1, 200).select(F.col("id").cast("int").alias("pid"), F.expr("case when id = 1 then 128 else id div 2 end").cast("int").alias("ppid")), 3).select("pid"), "WITH RECURSIVE p AS (SELECT i AS pid, CASE WHEN i = 1 THEN 128 ELSE i // 2 END AS ppid FROM range(1, 200) r(i)), w AS (SELECT 3 AS pid UNION SELECT p.pid FROM p JOIN w ON p.ppid = w.pid) SELECT CAST(pid AS INTEGER) AS pid FROM w")

# benchmark histories
simple("bench_selected", lambda s, d: bench.selected(lineitem_points(s, d), scenario="A", metric="avg_qty", monitor=False).select("run_id", "series", "value"), f"WITH {POINTS} SELECT run_id, series, value FROM points WHERE scenario = 'A' AND metric = 'avg_qty'")
simple("bench_merged", lambda s, d: bench.merged([lineitem_points(s, d), lineitem_points(s, d).where("scenario = 'A'").withColumn("more", F.lit(1))]).groupBy("scenario").agg(F.count("*").alias("n")), f"WITH {POINTS} SELECT scenario, count(*) * CASE scenario WHEN 'A' THEN 2 ELSE 1 END AS n FROM points GROUP BY 1")
simple("bench_preset", lambda s, d: bench.in_preset(lineitem_points(s, d), "90d", F.lit("1998-12-01").cast("timestamp_ntz")).select("run_id").distinct(), f"WITH {POINTS} SELECT DISTINCT run_id FROM points WHERE run_ts >= TIMESTAMP '1998-12-01' - INTERVAL 90 DAY")
simple("bench_samples", lambda s, d: bench.sample_points(_samples(s, d), "value"), "SELECT epoch_us(ts) AS x, value AS y FROM events WHERE event_id % 2 = 0")
simple("bench_sample_metrics", lambda s, d: bench.sample_metrics(_samples(s, d)), "SELECT unnest(['value', 'user']) AS metric")


def _samples(s: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("value"), "value", F.lit("user"), F.col("user_id").cast("double"))).otherwise(F.create_map(F.lit("user"), F.col("user_id").cast("double")))
    return table(s, d, "events").select(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("t"), own.alias("values"))


simple("bench_latest_first", lambda s, d: bench.latest_first(series(s, d).where("metric = 'avg_price'"), 3).select("lane", "latest"), f"WITH {POINTS} SELECT lane, arg_max(value, run_id) AS latest FROM points WHERE metric = 'avg_price' GROUP BY 1 ORDER BY latest DESC, lane LIMIT 3")
simple("repo_velocity", lambda s, d: bench.velocity(table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), "o_orderdate", "l_shipdate", 86_400), """WITH x AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)
    SELECT coalesce(floor(avg(v) * 10 + 0.5) / 10, 0) AS average, coalesce(floor(quantile_cont(v, 0.5) * 10 + 0.5) / 10, 0) AS median FROM x""")  # fmt: skip


def aggregates(s: SparkSession, d: str) -> DataFrame:
    """What a dashboard reads, written as JSON and read again: rows by table."""
    paths = bench.write_aggregates(lineitem_points(s, d), folder(s), 12)
    out = None
    for name, path in paths.items():
        n = s.read.json(path).agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


simple("bench_aggregates", aggregates, f"""WITH {POINTS} SELECT 'index' AS part, least(12, count(DISTINCT run_id)) AS n FROM points UNION ALL SELECT 'refs', count(DISTINCT ref) FROM points UNION ALL SELECT 'prs', count(DISTINCT ref) FROM points WHERE ref LIKE 'refs/pull/%'
    UNION ALL SELECT 'metrics', 2 UNION ALL SELECT 'badges', 2 UNION ALL SELECT 'series', count(*) FROM (SELECT DISTINCT run_id, lane, metric FROM points) UNION ALL SELECT 'runs', count(*) FROM (SELECT DISTINCT run_id, metric FROM points)""")  # fmt: skip
simple("bench_report", lambda s, d: _report(s, d), f"WITH {POINTS} SELECT count(*) + 3 AS lines, count(*) AS rows FROM points WHERE run_id = '1998-12'")


def _report(s: SparkSession, d: str) -> DataFrame:
    from .bench import compared

    lines = bench.comparison_lines(compared(s, d))
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.col("place.part") == 3).alias("rows"))
