import json

import pytest

from signalframe.sources import otlp
from signalframe.storage import write_samples

T = "1704067200123456789"


def metrics_document():
    point = {"timeUnixNano": T, "attributes": [{"key": "a.b", "value": {"stringValue": "x"}}]}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [point | {"asInt": "5"}, point | {"asDouble": 2.5}, {"asDouble": 1}]}},
        {"name": "s", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [point | {"asDouble": 7}]}},
        {"name": "h", "histogram": {"dataPoints": [point | {"count": "2", "sum": 14, "bucketCounts": ["1", "1"], "explicitBounds": [5, 10]}]}},
        {"name": "q", "summary": {"dataPoints": [point | {"count": 3, "sum": 6, "quantileValues": [{"quantile": 0.5, "value": 2}, {"quantile": 0.99, "value": 3}]}]}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [point | {"count": 4, "scale": "1", "zeroCount": "0", "positive": {"offset": "1", "bucketCounts": ["1", 2]}, "negative": {}}]}},
    ]
    return {"resourceMetrics": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeMetrics": [{"scope": {"name": "sc"}, "metrics": metrics}]}]}


def docs(spark, *documents):
    return otlp.parse(spark.createDataFrame([(json.dumps(d), i) for i, d in enumerate(documents)], "value string, seq long"))


def test_metric_points_and_samples(spark):
    points = otlp.metric_points(docs(spark, metrics_document()))
    assert [(r.name, r.kind) for r in points.orderBy("ordinal").collect()] == [("g", "gauge")] * 3 + [("s", "sum"), ("h", "histogram"), ("q", "summary"), ("e", "exponentialHistogram")]
    got = {}
    for r in otlp.to_samples(points).collect():
        extra = {k: v for k, v in r.labels.items() if k in ("le", "quantile", "exp_bucket", "exp_side", "exp_scale")}
        got.setdefault(r.metric, []).append((extra, r.value))
        assert r.ts_ns == 1704067200123000000 and r.labels["resource.service_name"] == "svc" and r.labels["attr.a_b"] == "x" and r.labels["otel.scope.version"] == ""
    assert sorted(v for _, v in got["g"]) == [2.5, 5.0] and got["h_count"] == [({}, 2.0)] and got["h_sum"] == [({}, 14.0)]
    assert {(e["le"], v) for e, v in got["h_bucket"]} == {("5", 1.0), ("10", 2.0)}
    assert {(e["quantile"], v) for e, v in got["q"]} == {("0.500000000000", 2.0), ("0.990000000000", 3.0)}
    assert {(e.get("exp_side"), e["exp_bucket"], v) for e, v in got["e_bucket"]} == {("positive", "1", 1.0), ("positive", "2", 2.0), (None, "zero", 0.0)}
    report = {r.kind: (r.points_seen, r.errors) for r in otlp.ingest_report(points).collect()}
    assert report["gauge"] == (3, 1) and report["histogram"] == (1, 0)


def test_spans_and_logs(spark):
    spans = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "t", "spanId": "a", "name": "n", "kind": 1, "startTimeUnixNano": "4000000000", "endTimeUnixNano": 9000000000, "status": {"code": 1}, "events": [{"timeUnixNano": "5", "name": "ev"}], "links": [{"traceId": "x", "spanId": "y"}]}, {"traceId": "t", "spanId": "b", "parentSpanId": "a", "name": "m"}]}]}]}
    logs = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "7", "severityNumber": 13, "body": {"stringValue": "hello"}, "flags": 1}]}]}]}
    d = docs(spark, spans, logs)
    assert [r.signal for r in d.orderBy("seq").collect()] == ["traces", "logs"]
    rows = {r.span_id: r for r in otlp.spans(d).collect()}
    assert rows["a"].duration_ns == 5_000_000_000 and rows["a"].events[0].name == "ev" and rows["b"].status_code == 0 and rows["b"].parent_span_id == "a"
    log = otlp.logs(d).first()
    assert (log.time_ns, log.severity_number, log.body, log.body_kind, log.flags) == (7, 13, "hello", "string", 1)


def test_bad_documents(spark):
    with pytest.raises(Exception, match="none of"):
        docs(spark, {"other": 1}).collect()
    lenient = otlp.parse(spark.createDataFrame([("{}", 0), ("not json", 1), (json.dumps(metrics_document()), 2)], "value string, seq long"), strict=False)
    assert lenient.count() == 1


def test_written_samples_are_pruned_by_metric(spark, tmp_path):
    samples = otlp.to_samples(otlp.metric_points(docs(spark, metrics_document()))).selectExpr("series_id", "metric", "labels", "ts_ns", "value", "0L as seq")
    write_samples(samples, str(tmp_path / "s"))
    read = spark.read.parquet(str(tmp_path / "s"))
    assert read.count() == samples.count()
    plan = read.where("metric = 'g' and ts_ns > 5")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan and "GreaterThan(ts_ns,5)" in plan


SMOKE = ["step_avg_by", "rate_sum_by", "point_last", "trace_search_status", "struct_descendant", "log_limit", "histogram_10", "bench_compare", "otlp_histogram", "stream_newest"]


@pytest.mark.parametrize("name", SMOKE)
def test_queries_agree_with_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("events", "conversations", "documents", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, folder)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    clean = lambda rows: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert clean(map(tuple, df.select(*names).collect())) == clean(cursor.fetchall())
