"""OTLP JSON: documents to rows of metric points, spans and logs, points to samples, and back.

Numbers may come as strings or numbers, so they are read as text and cast.  All
of it is one plan of explodes over an explicit schema; positions give ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import numeric_label, sanitized
from ..functions.values import canonical_key

_KV = "array<struct<key:string,value:struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>>>"
_SCOPE = f"scope:struct<name:string,version:string,attributes:{_KV}>"
_RESOURCE = f"resource:struct<attributes:{_KV}>"
_BASE = f"attributes:{_KV},startTimeUnixNano:string,timeUnixNano:string"
_NUMBER = f"struct<{_BASE},asDouble:string,asInt:string,flags:string>"
_SIDE = "struct<offset:string,bucketCounts:array<string>>"
_HISTOGRAM = f"struct<{_BASE},count:string,sum:string,min:string,max:string,bucketCounts:array<string>,explicitBounds:array<string>>"
_SUMMARY = f"struct<{_BASE},count:string,sum:string,quantileValues:array<struct<quantile:string,value:string>>>"
_EXPONENTIAL = f"struct<{_BASE},count:string,sum:string,scale:string,zeroCount:string,positive:{_SIDE},negative:{_SIDE}>"
_METRIC = (
    f"struct<name:string,unit:string,description:string,gauge:struct<dataPoints:array<{_NUMBER}>>,"
    f"sum:struct<dataPoints:array<{_NUMBER}>,aggregationTemporality:string,isMonotonic:boolean>,"
    f"histogram:struct<dataPoints:array<{_HISTOGRAM}>,aggregationTemporality:string>,summary:struct<dataPoints:array<{_SUMMARY}>>,"
    f"exponentialHistogram:struct<dataPoints:array<{_EXPONENTIAL}>,aggregationTemporality:string>>"
)
_SPAN = (
    f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},"
    f"events:array<struct<timeUnixNano:string,name:string,attributes:{_KV}>>,links:array<struct<traceId:string,spanId:string,attributes:{_KV}>>,status:struct<code:string,message:string>>"
)
_LOG = "struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string>," + f"attributes:{_KV},traceId:string,spanId:string,flags:string,eventName:string>"
DOCUMENT = (
    f"struct<resourceMetrics:array<struct<{_RESOURCE},scopeMetrics:array<struct<{_SCOPE},metrics:array<{_METRIC}>>>>>,"
    f"resourceSpans:array<struct<{_RESOURCE},scopeSpans:array<struct<{_SCOPE},spans:array<{_SPAN}>>>>>,"
    f"resourceLogs:array<struct<{_RESOURCE},scopeLogs:array<struct<{_SCOPE},logRecords:array<{_LOG}>>>>>>"
)
KINDS = ("gauge", "sum", "histogram", "summary", "exponentialHistogram")


def parse(texts: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """``texts`` with doc (the document) and signal; strict parsing stops at a document of no signal, else such rows are dropped."""
    out = texts.withColumn("doc", F.from_json(column, DOCUMENT, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
    out = out.withColumn("signal", detect_signal("doc"))
    if strict:
        wrong = F.raise_error(F.lit("the input has none of resourceMetrics, resourceSpans and resourceLogs")).cast("string")
        return out.withColumn("signal", F.when(F.col("signal").isNull(), wrong).otherwise(F.col("signal")))
    return out.where("signal is not null")


def detect_signal(doc: str = "doc") -> Column:
    """metrics, traces or logs by the first array there is, in this order."""
    return F.when(F.col(f"{doc}.resourceMetrics").isNotNull(), "metrics").when(F.col(f"{doc}.resourceSpans").isNotNull(), "traces").when(F.col(f"{doc}.resourceLogs").isNotNull(), "logs")


def read_documents(spark: SparkSession, path: str, lines: bool = True, strict: bool = True) -> DataFrame:
    """Documents of files: one a line (blank lines and carriage returns are passed over) or one a file; with seq and file."""
    rows = spark.read.text(path, wholetext=not lines).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    rows = rows.where(F.trim("value") != "").withColumn("seq", F.monotonically_increasing_id())
    return parse(rows, "value", strict)


def envelope(docs: DataFrame, received_at: Column | None = None, source: str | None = None) -> DataFrame:
    """``docs`` with the struct envelope: signal, document, time received and source."""
    at = received_at if received_at is not None else F.current_timestamp()
    return docs.withColumn("envelope", F.struct("signal", F.col("doc").alias("document"), at.alias("received_at"), F.lit(source).alias("source")))


def any_value(v: str | Column) -> Column:
    """The text of an attribute's value, by the first alternative there is; whole fractions read as whole numbers."""
    c = F.col(v) if isinstance(v, str) else v
    number = c["doubleValue"].try_cast("double")
    double = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), F.floor(number).cast("string")).otherwise(c["doubleValue"])
    return F.coalesce(c["stringValue"], F.lower(c["boolValue"]), c["intValue"], double, c["bytesValue"], c["arrayValue"], c["kvlistValue"])


def attributes_map(kv: str | Column) -> Column:
    """Attributes as a map; of equal keys the last counts."""
    c = F.coalesce(F.col(kv) if isinstance(kv, str) else kv, F.array().cast(_KV))
    entries = F.filter(c, lambda e: e["key"].isNotNull())
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda y: y["key"] == e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], any_value(e["value"]))))


def unix_nanos(text: str | Column) -> Column:
    """Nanoseconds of a string of digits, or of a date."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.rlike(r"^\d+$"), t.try_cast("bigint")).otherwise(F.unix_micros(F.try_to_timestamp(t)) * 1000)


def ingest_nanos(text: str | Column) -> Column:
    """Nanoseconds, cut to milliseconds: of digits the first 13 count as milliseconds."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.rlike(r"^\d+$"), F.left(t, F.lit(13)).try_cast("bigint") * 1_000_000).otherwise(F.unix_millis(F.try_to_timestamp(t)) * 1_000_000)


def _scoped(docs: DataFrame, group: str, scopes: str, items: str) -> DataFrame:
    """(seq, r, s, i, own_resource, own_scope, item): the items of each document with their positions."""
    # what a generator gives is computed once; without it each use of the document, filters too, would parse its text again
    rows = docs.select("seq", F.explode(F.array("doc")).alias("doc")).select("seq", F.posexplode(f"doc.{group}").alias("r", "rm"))
    rows = rows.select("seq", "r", F.col("rm.resource").alias("own_resource"), F.posexplode(f"rm.{scopes}").alias("s", "sm"))
    return rows.select("seq", "r", "s", "own_resource", F.col("sm.scope").alias("own_scope"), F.posexplode(f"sm.{items}").alias("i", "item"))


def _ordinal(*columns: str) -> Column:
    """A key that keeps the order of documents and of positions within them."""
    return F.struct(*columns)


def metric_points(docs: DataFrame) -> DataFrame:
    """One row per point of any kind: name, unit, kind, times, value (of number points), the point's own fields, attributes, resource and scope.

    The points of all kinds are made alike and exploded together, so documents are read and parsed once.
    """
    metrics = _scoped(docs, "resourceMetrics", "scopeMetrics", "metrics")
    null = lambda t: F.lit(None).cast(t)
    numbers = "array<double>"
    quantiles = "array<struct<quantile:double,value:double>>"

    def alike(order: int, kind: str) -> Column:
        number, exp, counted = kind in ("gauge", "sum"), kind == "exponentialHistogram", kind not in ("gauge", "sum")
        side = lambda p, name: F.struct(p[name]["offset"].try_cast("int").alias("offset"), p[name]["bucketCounts"].cast(numbers).alias("counts")) if exp else null(f"struct<offset:int,counts:{numbers}>")
        field = lambda p, name, there: p[name].try_cast("double") if there else null("double")
        point = lambda p, i: F.struct(
            F.lit(order).alias("k"), i.alias("p"), F.lit(kind).alias("kind"), p["timeUnixNano"].alias("time_text"), p["startTimeUnixNano"].alias("start_text"),
            (F.coalesce(p["asDouble"].try_cast("double"), p["asInt"].try_cast("double")) if number else null("double")).alias("value"),
            field(p, "count", counted).alias("count"), field(p, "sum", counted).alias("sum"),
            (p["bucketCounts"].cast(numbers) if kind == "histogram" else null(numbers)).alias("bucket_counts"), (p["explicitBounds"].cast(numbers) if kind == "histogram" else null(numbers)).alias("bounds"),
            (p["quantileValues"].cast(quantiles) if kind == "summary" else null(quantiles)).alias("quantiles"), field(p, "scale", exp).alias("scale"), field(p, "zeroCount", exp).alias("zero_count"),
            side(p, "positive").alias("positive"), side(p, "negative").alias("negative"),
            (F.col(f"item.{kind}.aggregationTemporality").try_cast("int") if kind in ("sum", "histogram", "exponentialHistogram") else null("int")).alias("temporality"),
            (F.col("item.sum.isMonotonic") if kind == "sum" else null("boolean")).alias("is_monotonic"), p["attributes"].alias("own_attributes"),
        )
        return F.transform(f"item.{kind}.dataPoints", point)

    kinds = F.array_compact(F.array(*[alike(order, kind) for order, kind in enumerate(KINDS)]))
    rows = metrics.select("seq", "r", "s", "i", "own_resource", "own_scope", F.col("item.name").alias("name"), F.col("item.unit").alias("unit"), F.col("item.description").alias("description"), F.explode(F.flatten(kinds)).alias("x"))
    fields = ("bucket_counts", "bounds", "quantiles", "scale", "zero_count", "positive", "negative", "temporality", "is_monotonic")
    return rows.select(
        F.struct("seq", "r", "s", "i", "x.k", "x.p").alias("ordinal"), "name", "unit", "description", "x.kind",
        "x.time_text", unix_nanos("x.time_text").alias("ts_ns"), unix_nanos("x.start_text").alias("start_ns"), "x.value", "x.count", "x.sum", *[f"x.{f}" for f in fields],
        attributes_map("x.own_attributes").alias("attributes"), attributes_map("own_resource.attributes").alias("resource"),
        F.col("own_scope.name").alias("scope_name"), F.col("own_scope.version").alias("scope_version"), attributes_map("own_scope.attributes").alias("scope_attributes"),
    )


def is_delta(temporality: str | Column = "temporality") -> Column:
    return (F.col(temporality) if isinstance(temporality, str) else temporality) == 1


def spans(docs: DataFrame) -> DataFrame:
    """Span rows (see ``schemas.SPANS``); durations are end less start, an absent status is 0."""
    rows = _scoped(docs, "resourceSpans", "scopeSpans", "spans")
    events = F.transform("item.events", lambda e: F.struct(unix_nanos(e["timeUnixNano"]).alias("time_ns"), e["name"].alias("name"), attributes_map(e["attributes"]).alias("attributes")))
    links = F.transform("item.links", lambda e: F.struct(e["traceId"].alias("trace_id"), e["spanId"].alias("span_id"), attributes_map(e["attributes"]).alias("attributes")))
    rows = rows.withColumns({"events": events, "links": links})
    start, end = unix_nanos("item.startTimeUnixNano"), unix_nanos("item.endTimeUnixNano")
    resource = attributes_map("own_resource.attributes")
    return rows.select(
        F.col("item.traceId").alias("trace_id"), F.col("item.spanId").alias("span_id"), F.nullif("item.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("item.name").alias("name"),
        F.coalesce(F.col("item.kind").try_cast("int"), F.lit(0)).alias("kind"), start.alias("start_ns"), end.alias("end_ns"), (end - start).alias("duration_ns"),
        F.coalesce(F.col("item.status.code").try_cast("int"), F.lit(0)).alias("status_code"), F.col("item.status.message").alias("status_message"), attributes_map("item.attributes").alias("attributes"),
        "events", "links",
        resource.alias("resource"), F.element_at(resource, F.lit("service.name")).alias("service_name"), F.col("own_scope.name").alias("scope_name"), F.col("own_scope.version").alias("scope_version"),
        _ordinal("seq", "r", "s", "i").alias("ordinal"),
    )


def logs(docs: DataFrame) -> DataFrame:
    """Log rows (see ``schemas.LOGS``)."""
    rows = _scoped(docs, "resourceLogs", "scopeLogs", "logRecords")
    body = F.col("item.body")
    kind = F.when(body["stringValue"].isNotNull(), "string").when(body["kvlistValue"].isNotNull(), "kvlist").when(body["bytesValue"].isNotNull(), "bytes").when(body.isNotNull(), "primitive")
    return rows.select(
        unix_nanos("item.timeUnixNano").alias("time_ns"), unix_nanos("item.observedTimeUnixNano").alias("observed_ns"), F.col("item.severityNumber").try_cast("int").alias("severity_number"), F.col("item.severityText").alias("severity_text"),
        any_value(body).alias("body"), kind.alias("body_kind"), attributes_map("item.attributes").alias("attributes"), F.col("item.traceId").alias("trace_id"), F.col("item.spanId").alias("span_id"),
        F.coalesce(F.col("item.flags").try_cast("int"), F.lit(0)).alias("flags"), F.col("item.eventName").alias("event_name"), attributes_map("own_resource.attributes").alias("resource"),
        F.col("own_scope.name").alias("scope_name"), F.col("own_scope.version").alias("scope_version"), F.xxhash64(F.to_json("own_resource"), F.to_json("own_scope")).alias("stream_id"), _ordinal("seq", "r", "s", "i").alias("ordinal"),
    )


def _prefixed(m: str, prefix: str) -> Column:
    return F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), sanitized(k)))


def to_samples(points: DataFrame) -> DataFrame:
    """Samples of points: numbers as they are; histograms as cumulative _bucket series by ``le``, _count and _sum; summaries by ``quantile``; exponential ones by side, scale and bucket.

    Points without a time, or without anything to count, are left out (see ``ingest_report``).
    """
    rows = points.withColumn("at", ingest_nanos("time_text")).where("at is not null")
    base = F.map_concat(
        F.create_map(F.lit("otel.scope.name"), F.coalesce("scope_name", F.lit("")), F.lit("otel.scope.version"), F.coalesce("scope_version", F.lit(""))),
        _prefixed("resource", "resource."), _prefixed("scope_attributes", "scope_attr."), _prefixed("attributes", "attr."),
    )
    rows = rows.withColumn("base", base)
    numbers = rows.where("kind in ('gauge', 'sum')").select(F.col("name").alias("metric"), F.col("base").alias("labels"), F.col("at").alias("ts_ns"), "value", "ordinal", F.lit(0).alias("place"))
    # all else in one pass: (suffix, value, labels, a label of a number with its name, place); numbers are formatted after the explode, as that is a Python function
    none = F.expr("cast(map() as map<string,string>)")

    def one(suffix: str, value: Column, place: Column | None = None, extra: Column = none, key: str | None = None, number: Column | None = None) -> Column:
        at = (place + 1).cast("int") if place is not None else F.lit(0)
        return F.struct(F.lit(suffix).alias("suffix"), value.alias("value"), extra.alias("extra"), F.lit(key).cast("string").alias("key"), (number if number is not None else F.lit(None)).cast("double").alias("number"), at.alias("place"))

    def listed(items: Column, f) -> Column:
        return F.coalesce(F.transform(items, f), F.array().cast("array<struct<suffix:string,value:double,extra:map<string,string>,key:string,number:double,place:int>>"))

    n = F.least(F.size("bucket_counts"), F.size("bounds") + 1)
    sums = F.when(n > 0, F.aggregate(F.slice("bucket_counts", 1, n), F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + F.coalesce(x, F.lit(0.0)))))
    buckets = listed(sums, lambda c, b: one("_bucket", c, b, key="le", number=F.get("bounds", b)))
    marks = listed(F.col("quantiles"), lambda q, b: one("", F.when(q["quantile"].isNotNull(), q["value"]), b, key="quantile", number=q["quantile"]))

    def side(name: str) -> Column:
        label = lambda b: F.create_map(F.lit("exp_side"), F.lit(name), F.lit("exp_bucket"), (F.coalesce(F.col(f"{name}.offset"), F.lit(0)) + b).cast("string"))
        return listed(F.col(f"{name}.counts"), lambda c, b: one("_bucket", c, b, label(b), "exp_scale", F.col("scale")))

    zero = F.array(one("_bucket", F.col("zero_count"), extra=F.create_map(F.lit("exp_bucket"), F.lit("zero")), key="exp_scale", number=F.col("scale")))
    total = F.array(one("_count", F.col("count")), one("_sum", F.col("sum")))
    each = F.when(F.col("kind") == "histogram", F.concat(buckets, total)).when(F.col("kind") == "summary", F.concat(marks, total)).otherwise(F.concat(side("positive"), side("negative"), zero, total))
    many = rows.where("kind in ('histogram', 'summary', 'exponentialHistogram')").select("name", "at", "ordinal", "base", F.explode(each).alias("x"))
    many = many.where("x.value is not null").withColumn("text", numeric_label(F.col("x.number")))
    label = F.when(F.col("x.key") == "le", F.create_map(F.lit("le"), F.coalesce("text", F.lit("+Inf")))).when(F.col("x.number").isNotNull(), F.create_map(F.col("x.key"), F.col("text"))).otherwise(none)
    many = many.select(F.concat("name", "x.suffix").alias("metric"), F.map_concat("base", "x.extra", label).alias("labels"), F.col("at").alias("ts_ns"), "x.value", "ordinal", "x.place")
    return numbers.where("value is not null").unionByName(many).withColumn("series_id", canonical_key("labels"))


def ingest_report(points: DataFrame) -> DataFrame:
    """Points seen and dropped, by kind: those without a time or a value count as errors."""
    empty = (
        F.when(F.col("kind").isin("gauge", "sum"), F.col("value").isNull())
        .when(F.col("kind") == "histogram", F.col("count").isNull() & F.col("sum").isNull() & (F.coalesce(F.size("bucket_counts"), F.lit(0)) <= 0))
        .otherwise(F.col("count").isNull() & F.col("sum").isNull() & F.col("quantiles").isNull() & F.col("zero_count").isNull())
    )
    bad = ingest_nanos("time_text").isNull() | empty
    return points.groupBy("kind").agg(F.count("*").alias("points_seen"), F.count_if(~bad).alias("points_accepted"), F.count_if(bad).alias("errors"))


def _kv(m: str | Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


def points_to_documents(points: DataFrame, context: dict[str, str] | None = None) -> DataFrame:
    """Benchmark points (run_id, scenario, series, metric, value, unit, tags, ...) as one OTLP document (text) for each run, a gauge for each metric.

    ``context`` adds resource attributes to those of the run.
    """
    tags = F.map_concat(F.create_map(F.lit("scenario"), "scenario", F.lit("series"), F.coalesce("series", "scenario")), "tags")
    point = F.struct(F.col("value").alias("asDouble"), _kv(tags).alias("attributes"), F.coalesce(F.col("point_ts_ns").cast("string"), F.lit("0")).alias("timeUnixNano"))
    gauges = points.groupBy("run_id", "metric").agg(F.first("unit", True).alias("unit"), F.array_sort(F.collect_list(point)).alias("dataPoints"))
    metric = F.struct(F.col("metric").alias("name"), "unit", F.struct("dataPoints").alias("gauge"))
    runs = gauges.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("metric", metric.alias("m")))).alias("ms"))
    pairs = {"run.id": F.col("run_id")} | {k: F.lit(v) for k, v in (context or {}).items()}
    resource = F.struct(F.array(*[F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value")) for k, v in pairs.items()]).alias("attributes"))
    doc = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.transform("ms", lambda x: x["m"]).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return runs.select("run_id", F.to_json(doc).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One document a line."""
    documents.select("value").write.mode("append").text(path, compression="gzip")


def points_from(metric_rows: DataFrame) -> DataFrame:
    """Benchmark points of metric points: gauges and sums as they are, histograms as .count and .sum; string tags less the reserved ones."""
    reserved = ("scenario", "series", "direction", "role")
    tags = F.map_filter("attributes", lambda k, _: ~k.isin(*reserved))
    attribute = lambda k: F.element_at("attributes", F.lit(k))
    common = [F.element_at("resource", F.lit("run.id")).alias("run_id"), F.coalesce(attribute("scenario"), F.col("name")).alias("scenario"), attribute("series").alias("series"), "unit", attribute("direction").alias("direction"), F.coalesce(attribute("role"), F.lit("outcome")).alias("role"), tags.alias("tags"), F.col("ts_ns").alias("point_ts_ns")]
    numbers = metric_rows.where("kind in ('gauge', 'sum') and value is not null").select(*common, F.col("name").alias("metric"), "value")
    histograms = metric_rows.where("kind = 'histogram'").select(*common, "name", F.explode(F.array(F.struct(F.lit(".count").alias("s"), F.col("count").alias("v")), F.struct(F.lit(".sum").alias("s"), F.col("sum").alias("v")))).alias("x"))
    return numbers.unionByName(histograms.where("x.v is not null").select(*[c if isinstance(c, str) else c for c in ("run_id", "scenario", "series", "unit", "direction", "role", "tags", "point_ts_ns")], F.concat("name", "x.s").alias("metric"), F.col("x.v").alias("value")))


def raw_points(docs: DataFrame) -> DataFrame:
    """(ordinal, name, kind, point_attributes, resource_attributes): metric points with their attributes as they stand, not yet read into maps."""
    metrics = _scoped(docs, "resourceMetrics", "scopeMetrics", "metrics")
    alike = lambda order, kind: F.transform(f"item.{kind}.dataPoints", lambda p, i: F.struct(F.lit(order).alias("k"), i.alias("p"), F.lit(kind).alias("kind"), p["attributes"].alias("own")))
    kinds = [alike(order, kind) for order, kind in enumerate(KINDS)]
    rows = metrics.select("seq", "r", "s", "i", "own_resource", F.col("item.name").alias("name"), F.explode(F.flatten(F.array_compact(F.array(*kinds)))).alias("x"))
    return rows.select(F.struct("seq", "r", "s", "i", "x.k", "x.p").alias("ordinal"), "name", "x.kind", F.col("x.own").alias("point_attributes"), F.col("own_resource.attributes").alias("resource_attributes"))


def storage_report(samples: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(samples_inserted, series_created, dropped): of ``samples`` to be written, those without a value are dropped; series that ``stored`` has are not new."""
    own = samples.where("value is not null")
    counts = samples.agg(F.count("value").alias("samples_inserted"), F.count_if(F.col("value").isNull()).alias("dropped"))
    series = own.select("series_id").distinct()
    if stored is not None:
        series = series.join(stored.select("series_id").distinct(), "series_id", "left_anti")
    return counts.crossJoin(F.broadcast(series.agg(F.count("*").alias("series_created"))))


def metric_payload(rows: DataFrame, kind: str = "gauge", temporality: str = "cumulative", monotonic: bool = False) -> DataFrame:
    """``rows`` (name, unit, value, ts_ns, attributes, resource) with value: a document of one point for each, a gauge or a sum."""
    if kind not in ("gauge", "sum") or temporality not in ("delta", "cumulative"):
        raise ValueError("a metric is a gauge or a sum, delta or cumulative")
    whole = (F.col("value") == F.floor("value")) & (F.abs("value") < 1e15)
    point = F.struct(F.col("ts_ns").cast("string").alias("timeUnixNano"), _kv("attributes").alias("attributes"), F.when(whole, F.floor("value").cast("string")).alias("asInt"), F.when(~whole, F.col("value")).alias("asDouble"))
    points = F.array(point).alias("dataPoints")
    data = F.struct(points).alias("gauge") if kind == "gauge" else F.struct(F.lit(1 if temporality == "delta" else 2).alias("aggregationTemporality"), F.lit(monotonic).alias("isMonotonic"), points).alias("sum")
    metric = F.struct("name", F.nullif("unit", F.lit("")).alias("unit"), data)
    scope = F.struct(F.array(metric).alias("metrics"))
    return rows.withColumn("document", F.to_json(F.struct(F.array(F.struct(F.struct(_kv("resource").alias("attributes")).alias("resource"), F.array(scope).alias("scopeMetrics"))).alias("resourceMetrics"))))
