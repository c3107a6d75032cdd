"""Log operators over ``logs`` (see ``schemas.LOGS``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITIES


def log_filter(*, from_ns: int | None = None, to_ns: int | None = None, severity_gte: int | None = None, body_contains: str | None = None, body_equals: tuple[str, object] | None = None, resource: Mapping[str, object] | None = None, body_json: str = "body_json") -> Column:
    """A condition on log records: times in [from, to), text in string bodies, a value in map bodies, resource attributes that are one of some values."""
    out = F.lit(True)
    if from_ns is not None:
        out = out & (F.col("time_ns") >= from_ns)
    if to_ns is not None:
        out = out & (F.col("time_ns") < to_ns)
    if severity_gte is not None:
        out = out & (F.col("severity_number") >= severity_gte)
    if body_contains is not None:
        out = out & (F.col("body_kind") == "string") & F.col("body").isNotNull() & F.col("body").contains(body_contains)
    if body_equals is not None:
        out = out & body_leaf_equals(body_json, *body_equals)
    for key, values in (resource or {}).items():
        wanted = [values] if isinstance(values, str) else list(values)
        out = out & F.coalesce(F.element_at("resource", F.lit(key)).isin(wanted), F.lit(False))
    return out


def body_leaf_equals(body: str, path: str, value: object) -> Column:
    """Whether the JSON body has ``value`` at a path of keys joined by dots (``body.`` before it may stand), of the same type."""
    keys = path.removeprefix("body.").split(".")
    at = "$" + "".join(f"['{k}']" for k in keys)
    raw = f"try_variant_get(try_parse_json(`{body}`), \"{at}\", 'variant')"
    if value is None:
        return F.coalesce(F.expr(f"is_variant_null({raw})"), F.lit(False))
    kinds = {bool: ("BOOLEAN",), int: ("BIGINT",), float: ("DOUBLE", "DECIMAL", "BIGINT"), str: ("STRING",)}[type(value)]
    schema = F.expr(f"schema_of_variant({raw})")
    fits = F.lit(False)
    for kind in kinds:
        fits = fits | schema.startswith(kind)
    target = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(value)]
    return F.coalesce(fits & (F.expr(f"try_variant_get(try_parse_json(`{body}`), \"{at}\", '{target}')") == value), F.lit(False))


def in_order(logs: DataFrame, limit: int | None = None, stream: str = "stream") -> DataFrame:
    """Records in the order of streams, within them as they came; ``limit`` takes the first of that order, not the earliest."""
    out = logs.orderBy(stream, "seq")
    return out if limit is None else out.limit(limit)


def severity_name(number: str | Column = "severity_number") -> Column:
    n = F.col(number) if isinstance(number, str) else number
    out = None
    for name, least in sorted(SEVERITIES.items(), key=lambda x: -x[1]):
        out = F.when(n >= least, name) if out is None else out.when(n >= least, name)
    return out.otherwise("UNKNOWN")


def severity_distribution(logs: DataFrame) -> DataFrame:
    """Records of each severity; severities without any have 0."""
    names = logs.sparkSession.createDataFrame([(n, i) for i, n in enumerate(SEVERITIES)], "severity string, place int")
    counts = logs.groupBy(severity_name().alias("severity")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def timeline(logs: DataFrame, bucket_ns: int = 60_000_000_000) -> DataFrame:
    """Records, errors (severity 17 on) and warnings (13 to 16) of each bucket."""
    n = F.col("severity_number")
    return logs.groupBy((F.col("time_ns") - F.pmod("time_ns", F.lit(bucket_ns))).alias("bucket_ns")).agg(F.count("*").alias("total"), F.count_if(n >= 17).alias("errors"), F.count_if((n >= 13) & (n < 17)).alias("warnings"))


def by_service(logs: DataFrame) -> DataFrame:
    service = F.coalesce(F.element_at("resource", F.lit("service.name")), F.lit("unknown"))
    errors = F.count_if(F.col("severity_number") >= 17)
    return logs.groupBy(service.alias("service")).agg(F.count("*").alias("n"), errors.alias("errors"), (errors / F.count("*")).alias("error_rate"))


def clusters(logs: DataFrame, top: int = 20, prefix: int = 60) -> DataFrame:
    """Records that begin alike, largest first; the first of each as sample."""
    first = F.min_by(F.struct("body", "severity_number", "time_ns"), "seq")
    out = logs.where("body is not null").groupBy(F.substring("body", 1, prefix).alias("prefix")).agg(F.count("*").alias("n"), first.alias("s"), F.min("seq").alias("first_seq"), F.countDistinct(F.element_at("resource", F.lit("service.name"))).alias("services"))
    return out.orderBy(F.desc("n"), "first_seq").limit(top).select("prefix", "n", F.col("s.body").alias("sample"), F.col("s.severity_number").alias("severity_number"), F.col("s.time_ns").alias("first_ns"), "services")


#: What is masked in bodies, in this order.
MASKS = (
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "{uuid}"),
    (r"\b\d+\.\d+\.\d+\.\d+\b", "{ip}"),
    (r"\b\d{4,}\b", "{num}"),
    (r"\b[0-9a-f]{8}\b", "{id}"),
)


def masked(body: str | Column) -> Column:
    out = F.col(body) if isinstance(body, str) else body
    for pattern, name in MASKS:
        out = F.regexp_replace(out, pattern, F.lit(name))
    return out


def masked_templates(logs: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent masked bodies, with the first record of each."""
    strings = logs.where((F.col("body_kind") == "string") & F.col("body").isNotNull())
    out = strings.groupBy(masked("body").alias("pattern")).agg(F.count("*").alias("n"), F.min_by("body", "seq").alias("sample"), F.min("seq").alias("first_seq"))
    return out.orderBy(F.desc("n"), "first_seq").limit(top).drop("first_seq")


def classified(logs: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """``logs`` with body_class: templated where a pattern of ``known`` matches, freetext, kvlist, bytes or primitive."""
    body = F.col("body")
    templated = F.lit(False)
    for pattern in known:
        templated = templated | body.rlike(pattern)
    kind = F.when(F.col("body_kind").isin("kvlist", "map"), "kvlist").when(F.col("body_kind") == "bytes", "bytes").when(F.col("body_kind") != "string", "primitive")
    return logs.withColumn("body_class", kind.when(templated, "templated").otherwise("freetext"))


def analysis(logs: DataFrame) -> dict[str, DataFrame]:
    """The parts of an overview of a log store."""
    return {
        "severities": severity_distribution(logs),
        "services": by_service(logs),
        "timeline": timeline(logs),
        "errors": clusters(logs.where("severity_number >= 17"), 20),
        "warnings": clusters(logs.where("severity_number between 13 and 16"), 10),
        "templates": masked_templates(logs),
    }


def query_stats(logs: DataFrame, condition: Column, stream: str = "stream") -> DataFrame:
    """(streams, streams_hit, scanned, emitted): what a query over ``logs`` reads and gives."""
    hit = F.coalesce(condition, F.lit(False))
    return logs.agg(F.countDistinct(stream).alias("streams"), F.countDistinct(F.when(hit, F.col(stream))).alias("streams_hit"), F.count("*").alias("scanned"), F.count_if(hit).alias("emitted"))
