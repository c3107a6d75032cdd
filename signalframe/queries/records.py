"""Queries of record helpers and frames, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as ops
from ..operators import traces
from ..sources.derived import conversation_spans, event_samples, event_spans
from .metrics import DAY, SAMPLES, START

HOUR = DAY // 24
QUERIES: dict = {}
ORACLES: dict = {}


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir)
    return s.select(F.lit("metrics").alias("signal"), F.col("metric").alias("name"), "ts_ns", "value", F.col("labels").alias("attributes"), F.create_map(F.lit("service.name"), F.concat(F.lit("svc-"), F.element_at("labels", F.lit("user_bucket")))).alias("resource"), F.lit("scope").alias("scope_name"), "seq")


def simple(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql




def by_type():
    return ops.split_key("event_type")


for reduce in ops.REDUCERS:
    sql = {"last": "arg_max(value, seq)", "count": "CAST(count(*) AS DOUBLE)"}.get(reduce, f"{reduce}(value)")
    simple(f"bucket_{reduce}", lambda s, d, r=reduce: ops.bucket_series(event_records(s, d), HOUR * 6, r, by_type()).withColumn("value", F.round("value", 9)),
           f"WITH {SAMPLES} SELECT event_type AS key, ts_ns - ts_ns % {HOUR * 6} AS bucket_ns, round({sql}, 9) AS value FROM samples WHERE value IS NOT NULL GROUP BY ALL")
simple("record_filter", lambda s, d: event_records(s, d).where(ops.record_filter(signal="metrics", from_ns=START + DAY, to_ns=START + 9 * DAY, name="event_value", attributes={"event_type": ["view", "click"]}, resource={"service.name": "svc-3"})).select("ts_ns", "value", "seq"),
       f"WITH {SAMPLES} SELECT ts_ns, value, seq FROM samples WHERE ts_ns BETWEEN {START + DAY} AND {START + 9 * DAY} AND event_type IN ('view', 'click') AND user_bucket = '3'")
simple("latest_by", lambda s, d: ops.latest_by(event_records(s, d), ops.split_key("resource.service.name")).select("key", "ts_ns", "value", "seq"),
       f"WITH {SAMPLES} SELECT 'svc-' || user_bucket AS key, max(ts_ns) AS ts_ns, arg_max(value, {{'t': ts_ns, 's': -seq}}) AS value, arg_max(seq, {{'t': ts_ns, 's': -seq}}) AS seq FROM samples GROUP BY 1")
simple("latest_values", lambda s, d: ops.latest_values(event_records(s, d), ops.split_key("k"), 12),
       f"WITH {SAMPLES} SELECT k AS key, max(ts_ns) AS ts_ns, arg_max(value, {{'t': ts_ns, 's': -seq}}) AS value FROM samples GROUP BY 1 ORDER BY value DESC, key LIMIT 12")
simple("split_by_missing", lambda s, d: ops.bucket_series(event_records(s, d), DAY, "count", ops.split_key("no.such.key")), f"WITH {SAMPLES} SELECT 'unknown' AS key, ts_ns - ts_ns % {DAY} AS bucket_ns, CAST(count(*) AS DOUBLE) AS value FROM samples WHERE value IS NOT NULL GROUP BY ALL")


def histogram_sql(bins: int) -> str:
    return f"""WITH b AS (SELECT min(value) AS lo, CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) / {bins} ELSE 1.0 END AS w FROM events),
        c AS (SELECT CAST(least({bins - 1}, greatest(0, floor((value - lo) / w))) AS INTEGER) AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1)
        SELECT CAST(g AS INTEGER) AS bin, round(lo + g * w, 9) AS low, round(lo + (g + 1) * w, 9) AS high, coalesce(n, 0) AS n FROM b, range({bins}) r(g) LEFT JOIN c ON c.bin = g"""


for _bins in (7, 10):
    simple(f"histogram_{_bins}", lambda s, d, b=_bins: ops.histogram(event_samples(s, d), b).withColumns({"low": F.round("low", 9), "high": F.round("high", 9)}), histogram_sql(_bins))

PER_DAY = f"per_day AS (SELECT event_type AS key, ts_ns - ts_ns % {DAY} AS bucket_ns, avg(value) AS value FROM samples WHERE value IS NOT NULL GROUP BY ALL)"


def per_day(s: SparkSession, d: str) -> DataFrame:
    return ops.bucket_series(event_records(s, d), DAY, "avg", by_type())


KINDS = ("click", "error", "purchase", "signup", "view")
simple("wide_table", lambda s, d: ops.wide(per_day(s, d).withColumn("value", F.round("value", 9)), KINDS), f"WITH {SAMPLES}, {PER_DAY} SELECT bucket_ns, " + ", ".join(f"max(round(value, 9)) FILTER (key = '{k}') AS {k}" for k in KINDS) + " FROM per_day GROUP BY 1")
for _keep in (False, True):
    simple(f"merge_frames_{'keep' if _keep else 'replace'}", lambda s, d, k=_keep: ops.merge_frames(per_day(s, d).where(F.col("bucket_ns") < START + 20 * DAY), per_day(s, d).where(F.col("bucket_ns") >= START + 10 * DAY).withColumn("value", -F.col("value")), k).withColumn("value", F.round("value", 9)),
           f"WITH {SAMPLES}, {PER_DAY} SELECT key, bucket_ns, round(CASE WHEN bucket_ns >= {START + (20 if _keep else 10) * DAY} THEN -value ELSE value END, 9) AS value FROM per_day")
simple("thinned", lambda s, d: ops.thinned(per_day(s, d), 8).withColumn("value", F.round("value", 9)), f"""WITH {SAMPLES}, {PER_DAY},
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bucket_ns) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM per_day),
    j AS (SELECT key, unnest(range(8)) AS j, max(n) AS n FROM n GROUP BY key),
    picks AS (SELECT DISTINCT key, CASE WHEN j = 7 THEN n - 1 ELSE CAST(floor(j * n / 8) AS BIGINT) END AS i FROM j)
    SELECT key, bucket_ns, round(value, 9) AS value FROM n JOIN picks USING (key, i)""")  # fmt: skip
simple("tail_points", lambda s, d: ops.tail(per_day(s, d), 5).withColumn("value", F.round("value", 9)), f"WITH {SAMPLES}, {PER_DAY} SELECT key, bucket_ns, round(value, 9) AS value FROM per_day QUALIFY row_number() OVER (PARTITION BY key ORDER BY bucket_ns DESC) <= 5")
simple("extremes", lambda s, d: ops.extremes(per_day(s, d), 4).withColumn("value", F.round("value", 9)), f"""WITH {SAMPLES}, {PER_DAY},
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bucket_ns) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM per_day),
    c AS (SELECT *, floor(i * 4 / n) AS chunk FROM n),
    p AS (SELECT key, unnest([arg_min(bucket_ns, i), arg_max(bucket_ns, i), arg_min(bucket_ns, {{'v': value, 'i': i}}), arg_max(bucket_ns, {{'v': value, 'i': i}})]) AS bucket_ns FROM c GROUP BY key, chunk)
    SELECT DISTINCT key, bucket_ns, round(value, 9) AS value FROM p JOIN per_day USING (key, bucket_ns)""")  # fmt: skip
simple("retained", lambda s, d: ops.retained(event_records(s, d), 10 * DAY, 500).select("signal", "ts_ns", "seq"), f"""WITH {SAMPLES}
    SELECT 'metrics' AS signal, ts_ns, seq FROM samples WHERE ts_ns >= (SELECT max(ts_ns) FROM samples) - {10 * DAY} ORDER BY seq DESC LIMIT 500""")  # fmt: skip


def correlated(s: SparkSession, d: str) -> DataFrame:
    """The events during each user's spans: samples in the windows of long error spans."""
    errors = event_spans(s, d).where("name = 'error' and duration_ns > 100000")
    windows = errors.select(F.col("span_id").alias("trace_id"), (F.col("start_ns") - HOUR).alias("from_ns"), (F.col("end_ns") + HOUR).alias("to_ns"))
    return ops.correlate(event_samples(s, d), windows).withColumn("avg_value", F.round("avg_value", 9))


simple("correlate_window", correlated, f"""WITH {SAMPLES},
    w AS (SELECT CAST(event_id AS VARCHAR) AS trace_id, epoch_us(ts) * 1000 - {HOUR} AS a, epoch_us(ts) * 1000 + CAST(floor(value * 1000) AS BIGINT) + {HOUR} AS b FROM events WHERE event_type = 'error' AND floor(value * 1000) > 100000)
    SELECT trace_id, count(*) AS n, round(avg(value), 9) AS avg_value FROM w JOIN samples ON ts_ns BETWEEN a AND b GROUP BY 1""")  # fmt: skip
simple("correlate_trace_logs", lambda s, d: _trace_logs(s, d), """SELECT CAST(doc_id % 100 AS VARCHAR) AS trace_id, doc_id AS seq FROM documents
    WHERE CAST(doc_id % 100 AS VARCHAR) IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations WHERE length(coalesce(text, '')) % 7 = 0)""")  # fmt: skip


def _trace_logs(s: SparkSession, d: str) -> DataFrame:
    from ..sources.derived import document_logs

    ids = conversation_spans(s, d).where(F.col("status_code") == traces.ERROR).select("trace_id").distinct()
    return document_logs(s, d).join(ids, "trace_id", "left_semi").select("trace_id", "seq")


