"""Telemetry read off the relational tables: samples, counters, spans, logs and benchmark points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import canonical_key, epoch_ns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of events as the metric event_value with the labels event_type, user_bucket and k."""
    e = table(spark, sf_dir, "events")
    labels = F.create_map(
        F.lit("event_type"), F.col("event_type"),
        F.lit("user_bucket"), F.pmod("user_id", F.lit(10)).cast("string"),
        F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")),
    )
    rows = e.select(F.lit("event_value").alias("metric"), labels.alias("labels"), epoch_ns("ts").alias("ts_ns"), "value", F.col("event_id").alias("seq"))
    return rows.select(canonical_key("labels").alias("series_id"), "metric", "labels", "ts_ns", "value", "seq")


def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter for each event_type that adds up the values and starts again after every 40 events."""
    e = table(spark, sf_dir, "events").where("value is not null")
    rank = F.row_number().over(W.partitionBy("event_type").orderBy("event_id")) - 1
    rows = e.withColumn("run", F.floor(rank / 40))
    total = F.sum("value").over(W.partitionBy("event_type", "run").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    labels = F.create_map(F.lit("event_type"), F.col("event_type"))
    return rows.select(F.col("event_type").alias("series_id"), F.lit("event_total").alias("metric"), labels.alias("labels"), epoch_ns("ts").alias("ts_ns"), total.alias("value"), F.col("event_id").alias("seq"))


def conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each conversation; turns form a binary tree."""
    c = table(spark, sf_dir, "conversations")
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    start = F.col("conv_id") * 1_000_000_000 + F.col("turn") * 1_000_000
    kind = F.when(F.col("role") == "user", 3).when(F.col("role") == "assistant", 2).otherwise(1)
    span = lambda turn: (F.col("conv_id") * 1000 + turn).cast("string")
    service = F.concat("role", F.lit("-"), (F.col("conv_id") % 4).cast("string"))
    return c.select(
        F.col("conv_id").cast("string").alias("trace_id"),
        span(F.col("turn")).alias("span_id"),
        F.when(F.col("turn") > 0, span(F.expr("(turn - 1) div 2"))).alias("parent_span_id"),
        F.concat("role", F.lit("-turn")).alias("name"),
        kind.cast("int").alias("kind"),
        start.alias("start_ns"),
        (start + size * 20_000).alias("end_ns"),
        (size * 20_000).alias("duration_ns"),
        F.when(size % 7 == 0, 2).otherwise(1).cast("int").alias("status_code"),
        F.create_map(F.lit("role"), F.col("role"), F.lit("size"), size.cast("string")).alias("attributes"),
        F.create_map(F.lit("service.name"), service).alias("resource"),
        service.alias("service_name"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat trace for each user; a span for each of the user's events."""
    e = table(spark, sf_dir, "events")
    start = epoch_ns("ts")
    length = F.floor(F.col("value") * 1000).cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.col("event_type").alias("name"),
        F.lit(1).alias("kind"),
        start.alias("start_ns"),
        (start + length).alias("end_ns"),
        length.alias("duration_ns"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status_code"),
        F.create_map(F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("attributes"),
        F.create_map(F.lit("service.name"), F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))).alias("resource"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service_name"),
        F.col("event_id").alias("seq"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log record for each document; streams are (source, lang)."""
    d = table(spark, sf_dir, "documents")
    severity = (F.col("doc_id") % 24 + 1).cast("int")
    return d.select(
        (F.col("doc_id") * 1_000_000_000).alias("time_ns"),
        severity.alias("severity_number"),
        F.col("text").alias("body"),
        F.lit("string").alias("body_kind"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("attributes"),
        (F.col("doc_id") % 100).cast("string").alias("trace_id"),
        F.create_map(F.lit("service.name"), F.col("source")).alias("resource"),
        F.concat("source", F.lit("/"), "lang").alias("stream"),
        F.col("doc_id").alias("seq"),
    )


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log record for each event, with a templated body and a JSON body."""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", 17).when(F.col("event_type") == "purchase", 13).otherwise(9)
    return e.select(
        epoch_ns("ts").alias("time_ns"),
        severity.cast("int").alias("severity_number"),
        F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id").cast("string"), F.lit(" k="), F.coalesce(F.get_json_object("props", "$.k"), F.lit("?"))).alias("body"),
        F.lit("string").alias("body_kind"),
        F.col("props").alias("body_json"),
        F.create_map(F.lit("event_type"), F.col("event_type")).alias("attributes"),
        F.col("user_id").cast("string").alias("trace_id"),
        F.create_map(F.lit("service.name"), F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"))).alias("resource"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("stream"),
        F.col("event_id").alias("seq"),
    )


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark points: a run for each ship month, a lane for each return flag and line status, averages of price and quantity."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("run_id"), F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("status")).agg(
        F.avg("l_extendedprice").alias("avg_price"), F.avg("l_quantity").alias("avg_qty")
    )
    long = rows.select("run_id", "scenario", "status", F.expr("stack(2, 'avg_price', avg_price, 'usd', 'smaller_is_better', 'avg_qty', avg_qty, 'items', 'bigger_is_better') as (metric, value, unit, direction)"))
    return long.select(
        "run_id",
        F.to_timestamp_ntz(F.concat("run_id", F.lit("-01")), F.lit("yyyy-MM-dd")).alias("run_ts"),
        F.substring(F.sha1("run_id"), 1, 7).alias("commit"),
        F.when(F.substring("run_id", 6, 2).cast("int") % 3 == 0, F.concat(F.lit("refs/pull/"), F.substring("run_id", 6, 2).cast("int").cast("string"), F.lit("/merge"))).otherwise("refs/heads/main").alias("ref"),
        "scenario",
        F.concat_ws("/", "scenario", "status").alias("series"),
        "metric",
        F.floor(F.col("value") * 100 + 0.5).cast("double").alias("value_cents"),
        (F.floor(F.col("value") * 100 + 0.5) / 100).alias("value"),
        "unit",
        "direction",
        F.lit("outcome").alias("role"),
        F.create_map(F.lit("status"), F.col("status")).alias("tags"),
        "status",
    ).drop("value_cents")
