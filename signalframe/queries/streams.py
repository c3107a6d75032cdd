"""Queries of OTLP readers and of streams, each held against plain SQL where there is one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import epoch_ns
from ..sources import otlp
from ..sources.derived import event_logs, lineitem_points, table
from ..storage import shared_folder
from ..streaming import append as streams
from .bench import POINTS

QUERIES: dict = {}
ORACLES: dict = {}


def simple(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _text(*parts: str | object) -> F.col:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def event_documents(s: SparkSession, d: str) -> DataFrame:
    """An OTLP document for each event: a gauge point, with the time as a string and every third value as an integer string."""
    e = table(s, d, "events")
    value = F.when(F.col("event_id") % 3 == 0, _text('"asInt":"', F.floor("value").cast("string"), '"')).otherwise(_text('"asDouble":', F.col("value").cast("string")))
    body = _text(
        '{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeMetrics":[{"scope":{"name":"web"},"metrics":[{"name":"',
        F.col("event_type"), '_value","unit":"ms","gauge":{"dataPoints":[{"timeUnixNano":"', epoch_ns("ts").cast("string"), '",', value,
        ',"attributes":[{"key":"user.bucket","value":{"intValue":"', (F.col("user_id") % 10).cast("string"), '"}}]}]}}]}]}]}',
    )
    return otlp.parse(e.select(body.alias("value"), F.col("event_id").alias("seq")))


GAUGES = "SELECT event_id AS seq, event_type || '_value' AS name, epoch_us(ts) * 1000 AS ts_ns, CASE WHEN event_id % 3 = 0 THEN floor(value) ELSE value END AS value, CAST(user_id % 10 AS VARCHAR) AS bucket FROM events"
simple("otlp_points", lambda s, d: otlp.metric_points(event_documents(s, d)).select(F.col("ordinal.seq").alias("seq"), "name", "ts_ns", "value", F.element_at("attributes", F.lit("user.bucket")).alias("bucket")), GAUGES)
simple("otlp_samples", lambda s, d: otlp.to_samples(otlp.metric_points(event_documents(s, d))).select(F.col("ordinal.seq").alias("seq"), "metric", "ts_ns", "value", *[F.element_at("labels", F.lit(k)).alias(k.replace(".", "_")) for k in ("resource.service_name", "attr.user_bucket", "otel.scope.name", "otel.scope.version")]),
       f"SELECT seq, name AS metric, ts_ns // 1000000 * 1000000 AS ts_ns, value, 'shop' AS resource_service_name, bucket AS attr_user_bucket, 'web' AS otel_scope_name, '' AS otel_scope_version FROM ({GAUGES})")
simple("otlp_signals", lambda s, d: event_documents(s, d).groupBy("signal").agg(F.count("*").alias("n")), "SELECT 'metrics' AS signal, count(*) AS n FROM events")


def histogram_samples(s: SparkSession, d: str) -> DataFrame:
    """Histograms of quantity by ship mode made from lineitem: per-bucket counts in, cumulative series out."""
    li = table(s, d, "lineitem")
    counts = [F.count_if(F.col("l_quantity") <= 10), F.count_if((F.col("l_quantity") > 10) & (F.col("l_quantity") <= 25.5)), F.count_if(F.col("l_quantity") > 25.5)]
    g = li.groupBy("l_returnflag").agg(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(counts)], F.count("*").cast("string").alias("n"), F.sum("l_quantity").cast("long").cast("string").alias("q"))
    body = _text(
        '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"qty","histogram":{"aggregationTemporality":2,"dataPoints":[{"timeUnixNano":"1704067200000000000","count":"', F.col("n"), '","sum":', F.col("q"),
        ',"bucketCounts":["', F.col("c0"), '","', F.col("c1"), '",', F.col("c2"), '],"explicitBounds":[10,25.5],"attributes":[{"key":"flag","value":{"stringValue":"', F.col("l_returnflag"), '"}}]}]}}]}]}]}',
    )
    docs = otlp.parse(g.select(body.alias("value"), F.lit(0).cast("long").alias("seq")))
    out = otlp.to_samples(otlp.metric_points(docs))
    return out.select("metric", "ts_ns", "value", F.element_at("labels", F.lit("attr.flag")).alias("flag"), F.element_at("labels", F.lit("le")).alias("le"))


simple("otlp_histogram", histogram_samples, """WITH g AS (SELECT l_returnflag AS flag, count(*) FILTER (l_quantity <= 10) AS a, count(*) FILTER (l_quantity <= 25.5) AS b, count(*) AS n, floor(sum(l_quantity)) AS q FROM lineitem GROUP BY 1)
    SELECT unnest(['qty_bucket', 'qty_bucket', 'qty_bucket', 'qty_count', 'qty_sum']) AS metric, 1704067200000000000 AS ts_ns, unnest([CAST(a AS DOUBLE), b, n, n, q]) AS value, flag, unnest(['10', '25.5000000000', '+Inf', NULL, NULL]) AS le FROM g""")  # fmt: skip
simple("otlp_ingest_report", lambda s, d: otlp.ingest_report(otlp.metric_points(event_documents(s, d))), "SELECT 'gauge' AS kind, count(*) AS points_seen, count(value) AS points_accepted, count(*) - count(value) AS errors FROM events")


def round_trip(s: SparkSession, d: str) -> DataFrame:
    """Benchmark points written as OTLP documents and read again."""
    p = lineitem_points(s, d).withColumn("point_ts_ns", F.lit(1_000_000_000).cast("long"))
    docs = otlp.parse(otlp.points_to_documents(p).withColumn("seq", F.lit(0).cast("long")))
    return otlp.points_from(otlp.metric_points(docs)).select("run_id", "scenario", "series", "metric", "value", "unit", F.element_at("tags", F.lit("status")).alias("status"))


simple("otlp_round_trip", round_trip, f"WITH {POINTS} SELECT run_id, scenario, series, metric, value, unit, status FROM points")


def _stream_of(s: SparkSession, rows: DataFrame, parts: int) -> DataFrame:
    folder = f"{shared_folder(s)}/streams/{uuid.uuid4().hex}"
    rows.repartition(parts).write.parquet(folder)
    return streams.file_stream(s, folder, rows.schema, max_files=1)


def stream_append(s: SparkSession, d: str) -> DataFrame:
    """Events streamed in four batches and appended; the table is their sum by type."""
    e = table(s, d, "events").select("event_id", "event_type", "value")
    target = f"{shared_folder(s)}/streams/{uuid.uuid4().hex}"
    streams.append_available(_stream_of(s, e, 4), target)
    return s.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


simple("stream_append", stream_append, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")


def stream_buckets(s: SparkSession, d: str) -> DataFrame:
    """Daily sums of a stream, each update merged over the one before."""
    e = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    frame = streams.FrameTable(s)
    streams.run_available(streams.bucket_stream(_stream_of(s, e, 3), "1 day", "40 days", "event_type"), frame.merge)
    out = frame.frame(["key", "bucket"])
    return out.select("key", F.unix_micros("bucket").alias("bucket_us"), F.round("sum", 4).alias("total"), "n")


simple("stream_buckets", stream_buckets, "SELECT event_type AS key, epoch_us(date_trunc('day', ts)) AS bucket_us, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY 1, 2")


def _newest(s: SparkSession, d: str, op) -> DataFrame:
    e = table(s, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), epoch_ns("ts").alias("ts_ns"), "value")
    batches = f"{shared_folder(s)}/streams/{uuid.uuid4().hex}"
    streams.run_available(op(_stream_of(s, e, 3)), lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{batches}/b={i}"))
    rows = s.read.option("recursiveFileLookup", "true").parquet(batches)
    last = rows.groupBy("key").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["key", "batch"]).select("key", "seq", "ts_ns", "value")


simple("stream_newest", lambda s, d: _newest(s, d, lambda r: streams.newest(r, "key", 20)), "SELECT event_type AS key, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 20")
simple("stream_within_age", lambda s, d: _newest(s, d, lambda r: streams.within_age(r, "key", 86_400_000_000_000)), "SELECT event_type AS key, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, value FROM events QUALIFY epoch_us(ts) >= max(epoch_us(ts)) OVER (PARTITION BY event_type) - 86400000000")


def stream_templates(s: SparkSession, d: str) -> DataFrame:
    """Templates of a stream of log lines: their number by stream."""
    logs = event_logs(s, d).select("stream", "seq", "body")
    target = f"{shared_folder(s)}/streams/{uuid.uuid4().hex}"
    streams.append_available(streams.mine_stream(_stream_of(s, logs, 2)), target)
    return s.read.parquet(target).groupBy("stream").agg(F.countDistinct("template_id").alias("templates"), F.count("*").alias("n"))


simple("stream_templates", stream_templates)
