"""Log queries over documents and events read as logs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drain
from ..operators import logs as ops
from ..plans.log_query import LogQuery
from ..sources.derived import document_logs, event_logs

DOCS = """docs AS (SELECT doc_id * 1000000000 AS time_ns, CAST(doc_id % 24 + 1 AS INTEGER) AS severity_number, text AS body, source AS service, source || '/' || lang AS stream, doc_id AS seq FROM documents)"""
EVENTS = """ev AS (SELECT epoch_us(ts) * 1000 AS time_ns, CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 ELSE 9 END AS severity_number,
    event_type || ' by user ' || user_id || ' k=' || coalesce(json_extract_string(props, '$.k'), '?') AS body, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    'svc-' || (user_id % 5) AS stream, 'svc-' || (user_id % 5) AS service, event_id AS seq FROM events)"""
COLUMNS = ["time_ns", "severity_number", "body", "seq"]
SELECT = "SELECT time_ns, severity_number, body, seq"
SECOND = 1_000_000_000
MID = 1_704_067_200 * SECOND + 10 * 86_400 * SECOND

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query: LogQuery, where: str, source=event_logs, tail: str = "") -> None:
    QUERIES[name] = lambda s, d: query.frame(source(s, d)).select(*COLUMNS)
    ORACLES[name] = f"WITH {EVENTS if source is event_logs else DOCS} {SELECT} FROM {'ev' if source is event_logs else 'docs'} WHERE {where} {tail}"


add("log_range", LogQuery(from_ns=MID, to_ns=MID + 3 * 86_400 * SECOND), f"time_ns >= {MID} AND time_ns < {MID + 3 * 86_400 * SECOND}")
add("log_range_half_open", LogQuery(from_ns=100 * SECOND, to_ns=200 * SECOND), f"time_ns >= {100 * SECOND} AND time_ns < {200 * SECOND}", document_logs)
add("log_severity", LogQuery(severity_gte=17), "severity_number >= 17", document_logs)
add("log_contains", LogQuery(body_contains="of the"), "contains(body, 'of the')", document_logs)
add("log_contains_all", LogQuery(body_contains="", severity_gte=21), "severity_number >= 21 AND body IS NOT NULL", document_logs)
add("log_contains_none", LogQuery(body_contains="no such text anywhere"), "false", document_logs)
add("log_combined", LogQuery(from_ns=MID, severity_gte=13, body_contains="purchase"), f"time_ns >= {MID} AND severity_number >= 13 AND contains(body, 'purchase')")
add("log_leaf", LogQuery(body_equals=("body.k", 7)), "k = 7")
add("log_leaf_wrong_type", LogQuery(body_equals=("k", "7")), "false")
add("log_resource", LogQuery(resource={"service.name": ["svc-1", "svc-3"]}), "service IN ('svc-1', 'svc-3')")
add("log_limit", LogQuery(severity_gte=17, limit=25), "severity_number >= 17", tail="ORDER BY stream, seq LIMIT 25")
add("log_recent", LogQuery(limit=40), "true", document_logs, tail="ORDER BY stream, seq LIMIT 40")


def simple(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


simple("log_severity_dist", lambda s, d: ops.severity_distribution(event_logs(s, d)), f"""WITH {EVENTS}, names AS (SELECT unnest(['TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL']) AS severity),
    c AS (SELECT CASE WHEN severity_number >= 21 THEN 'FATAL' WHEN severity_number >= 17 THEN 'ERROR' WHEN severity_number >= 13 THEN 'WARN' WHEN severity_number >= 9 THEN 'INFO' WHEN severity_number >= 5 THEN 'DEBUG' ELSE 'TRACE' END AS severity, count(*) AS n FROM ev GROUP BY 1)
    SELECT severity, coalesce(n, 0) AS n FROM names LEFT JOIN c USING (severity)""")  # fmt: skip
simple("log_timeline", lambda s, d: ops.timeline(event_logs(s, d)), f"""WITH {EVENTS} SELECT time_ns - time_ns % 60000000000 AS bucket_ns, count(*) AS total, count(*) FILTER (severity_number >= 17) AS errors,
    count(*) FILTER (severity_number BETWEEN 13 AND 16) AS warnings FROM ev GROUP BY 1""")  # fmt: skip
simple("log_services", lambda s, d: ops.by_service(event_logs(s, d)), f"WITH {EVENTS} SELECT service, count(*) AS n, count(*) FILTER (severity_number >= 17) AS errors, count(*) FILTER (severity_number >= 17) / count(*) AS error_rate FROM ev GROUP BY 1")
simple("log_error_clusters", lambda s, d: ops.clusters(document_logs(s, d).where("severity_number >= 17")), f"""WITH {DOCS}
    SELECT substr(body, 1, 60) AS prefix, count(*) AS n, arg_min(body, seq) AS sample, arg_min(severity_number, seq) AS severity_number, arg_min(time_ns, seq) AS first_ns, count(DISTINCT service) AS services
    FROM docs WHERE severity_number >= 17 GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT 20""")  # fmt: skip
simple("log_warning_clusters", lambda s, d: ops.clusters(event_logs(s, d).where("severity_number between 13 and 16"), 10), f"""WITH {EVENTS}
    SELECT substr(body, 1, 60) AS prefix, count(*) AS n, arg_min(body, seq) AS sample, arg_min(severity_number, seq) AS severity_number, arg_min(time_ns, seq) AS first_ns, count(DISTINCT service) AS services
    FROM ev WHERE severity_number BETWEEN 13 AND 16 GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT 10""")  # fmt: skip
simple("log_masked_templates", lambda s, d: ops.masked_templates(event_logs(s, d).withColumn("body", F.concat("body", F.lit(" from 10.0.0."), F.expr("seq % 7"), F.lit(" at "), F.expr("100000 + seq"))), 40), f"""WITH {EVENTS},
    b AS (SELECT seq, body || ' from 10.0.0.' || (seq % 7) || ' at ' || (100000 + seq) AS body FROM ev),
    m AS (SELECT seq, body, regexp_replace(regexp_replace(regexp_replace(body, '\\b\\d+\\.\\d+\\.\\d+\\.\\d+\\b', '{{ip}}', 'g'), '\\b\\d{{4,}}\\b', '{{num}}', 'g'), '\\b[0-9a-f]{{8}}\\b', '{{id}}', 'g') AS pattern FROM b)
    SELECT pattern, count(*) AS n, arg_min(body, seq) AS sample FROM m GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT 40""")  # fmt: skip
simple("log_classified", lambda s, d: ops.classified(event_logs(s, d), ["^error by user"]).groupBy("body_class").agg(F.count("*").alias("n")), f"""WITH {EVENTS}
    SELECT CASE WHEN starts_with(body, 'error by user') THEN 'templated' ELSE 'freetext' END AS body_class, count(*) AS n FROM ev GROUP BY 1""")  # fmt: skip
simple("log_stream_stats", lambda s, d: document_logs(s, d).groupBy("stream").agg(F.count("*").alias("n"), F.min("time_ns").alias("min_ns"), F.max("time_ns").alias("max_ns"), F.max("severity_number").alias("max_severity")),
       f"WITH {DOCS} SELECT stream, count(*) AS n, min(time_ns) AS min_ns, max(time_ns) AS max_ns, max(severity_number) AS max_severity FROM docs GROUP BY 1")


def drain_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = drain.mine(event_logs(spark, sf_dir))
    return mined.groupBy("stream", "template").agg(F.count("*").alias("n"), F.max(F.size("variables")).cast("int").alias("slots"))


def drain_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain.slot_types(drain.mine(event_logs(spark, sf_dir)))


QUERIES["log_drain_templates"] = drain_templates
QUERIES["log_drain_slots"] = drain_slots
