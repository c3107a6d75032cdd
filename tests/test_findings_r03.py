"""What the findings of round 3 named, each on a few rows."""

import random

from pyspark.sql import functions as F

from signalframe import storage
from signalframe.functions import values
from signalframe.operators import records
from signalframe.sources import otlp

DAY = 86_400_000_000_000


def samples(spark, n, days):
    rows = spark.range(n).select(F.col("id").cast("string").alias("series_id"), F.lit("m").alias("metric"), (F.col("id") % days * DAY).alias("ts_ns"), F.col("id").cast("double").alias("value"), F.col("id").alias("seq"))
    return rows.withColumn("labels", F.create_map(F.lit("a"), "series_id"))


def test_folders_of_small_files_are_written_side_by_side(spark, tmp_path):
    path = str(tmp_path / "s")
    storage.write_samples(samples(spark, 330, 4), path, files=1, max_rows=40)
    # a file's name has the number of the task that wrote it
    files = spark.read.parquet(path).groupBy("day", F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in files) == [2, 2, 3, 3] + [40] * 8
    assert len({r.name.split("-")[1] for r in files}) > 1


def test_times_read_to_the_millisecond(spark):
    ns = [1704154120618000000, 1706028500225999999, 1706028500226000000, -1, 0]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in ns], "ns long").select(values.iso_text("ns")).collect()]
    assert got == ["2024-01-02T00:08:40.618Z", "2024-01-23T16:48:20.225Z", "2024-01-23T16:48:20.226Z", "1969-12-31T23:59:59.999Z", "1970-01-01T00:00:00.000Z"]


def test_no_task_takes_the_whole_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "TASK_ROWS", 50, raising=False)
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    storage.write_samples(samples(spark, 600, 2), first, files=2)
    storage.compact(spark, first, second, ["metric", "day"])
    for path in (first, second):
        rows = spark.read.parquet(path)
        by_task = rows.groupBy(F.split(F.col("_metadata.file_name"), "-")[1].alias("task")).agg(F.count("*").alias("n")).collect()
        assert len(by_task) >= 6 and max(r.n for r in by_task) < 200
        assert sorted((r.seq, r.series_id, r.labels["a"], r.value) for r in rows.collect()) == [(i, str(i), str(i), float(i)) for i in range(600)]


def test_documents_are_read_once_for_points_and_twice_for_samples(spark, tmp_path):
    path = str(tmp_path / "d")
    point = '{"timeUnixNano":"1704067200000000000","asInt":"%d","count":2,"sum":3,"bucketCounts":["1","1"],"explicitBounds":[5]}'
    metrics = ",".join('{"name":"%s","%s":{"dataPoints":[%s,%s]}}' % (k, k, point % 1, point % 2) for k in otlp.KINDS)
    spark.createDataFrame([('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[%s,{"name":"none"}]}]}]}' % metrics,)], "value string").write.text(path)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    points = otlp.metric_points(otlp.read_documents(spark, path))
    assert scans(points) == 1 and scans(otlp.raw_points(otlp.read_documents(spark, path))) == 1 and scans(otlp.to_samples(points)) == 2
    assert [(r.kind, r.ordinal.i, r.ordinal.k, r.ordinal.p, r.value) for r in points.orderBy("ordinal").collect()] == [(k, i, i, p, p + 1.0 if i < 2 else None) for i, k in enumerate(otlp.KINDS) for p in (0, 1)]
    names = [r.metric for r in otlp.to_samples(points).collect()]
    assert {n: names.count(n) for n in names} == {"gauge": 2, "sum": 2, "histogram_bucket": 4} | {f"{k}_{f}": 2 for k in otlp.KINDS[2:] for f in ("count", "sum")}


def test_windows_meet_sums_of_slots(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-(1 << 26), 1 << 26), rng.choice([None, float(rng.randrange(100))])) for _ in range(400)] + [(None, 1.0)]
    windows = [(str(i), a, a + rng.choice([-1, 0, 5, 1 << 20, 1 << 22, 1 << 25])) for i in range(60) for a in [rng.choice(rows[:-1])[0]]]
    out = records.correlate(spark.createDataFrame(rows, "ts_ns long, value double"), spark.createDataFrame(windows, "trace_id string, from_ns long, to_ns long"))
    want = {}
    for i, a, b in windows:
        met = [v for t, v in rows if t is not None and a <= t <= b]
        some = [v for v in met if v is not None]
        if met:
            want[i] = (len(met), round(sum(some) / len(some), 6) if some else None)
    assert {r.trace_id: (r.n, r.avg_value if r.avg_value is None else round(r.avg_value, 6)) for r in out.collect()} == want
