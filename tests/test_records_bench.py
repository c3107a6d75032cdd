import pytest
from pyspark.sql import functions as F

from signalframe.operators import bench, records
from signalframe.sources import benchmarks as src

RECORDS = "signal string, name string, ts_ns bigint, value double, attributes map<string,string>, resource map<string,string>, scope_name string, seq bigint"


def rows(spark, points):
    return spark.createDataFrame([("metrics", "m", t, v, {"k": k}, {}, None, i) for i, (k, t, v) in enumerate(points)], RECORDS)


def test_buckets_ties_and_histograms(spark):
    r = rows(spark, [("a", 5, 1.0), ("a", 5, 3.0), ("a", 12, 5.0), ("b", None, 9.0), ("a", 13, float("nan"))])
    key = records.split_key("k")
    assert {(x.bucket_ns, x.value) for x in records.bucket_series(r, 10, "last", key).collect()} == {(0, 3.0), (10, 5.0)}
    assert {(x.key, x.value) for x in records.latest_by(rows(spark, [("a", 5, 1.0), ("a", 5, 3.0)]), key).collect()} == {("a", 1.0)}
    assert [x.n for x in records.histogram(rows(spark, [("a", 0, 0.0), ("a", 0, 10.0), ("a", 0, 5.0)]), 2).orderBy("bin").collect()] == [1, 2]
    constant = records.histogram(rows(spark, [("a", 0, 4.0)]), 3).orderBy("bin").collect()
    assert [x.n for x in constant] == [1, 0, 0] and constant[0].low == 4.0 and constant[0].high == 5.0
    assert records.histogram(rows(spark, [("a", 0, None)]), 3).count() == 0
    kept = records.retained(r, max_age_ns=5, max_points=10)
    assert {x.seq for x in kept.collect()} == {2, 3, 4}
    with pytest.raises(ValueError):
        records.bucket_series(r, 0)


POINTS = "run_id string, run_ts timestamp_ntz, commit string, ref string, scenario string, series string, metric string, value double, unit string, direction string, role string, tags map<string,string>"


def points(spark, values):
    import datetime

    return spark.createDataFrame([(f"r{run}", datetime.datetime(2024, 1, 1 + run), "c", "refs/pull/7/merge", s, None, m, float(v), u, None, None, {}) for run, s, m, v, u in values], POINTS)


def test_compare(spark):
    base = points(spark, [(0, s, "t", 100.0, "ns/op") for s in "abc"] + [(0, "z", "t", 0.0, "ns/op"), (0, "o", "t", 100.0, "ops/s")])
    now = points(spark, [(1, "a", "t", 104.0, "ns/op"), (1, "b", "t", 120.0, "ns/op"), (1, "c", "t", 80.0, "ns/op"), (1, "z", "t", 1.0, "ns/op"), (1, "new", "t", 1.0, "ns/op"), (1, "o", "t", 80.0, "ops/s")])
    got = {r.scenario: (r.status, r.percent_change) for r in bench.compare_runs(now, base, keys=("scenario", "metric")).collect()}
    assert got == {"a": ("stable", 4.0), "b": ("regressed", 20.0), "c": ("improved", -20.0), "z": ("skipped", None), "o": ("regressed", -20.0)}


def test_history(spark):
    p = points(spark, [(i, "s", "t", v, "ns/op") for i, v in enumerate([10, 10, 10, 10, 10, 12.0])])
    series = bench.run_series(p)
    assert [r.run_id for r in bench.latest_regressions(series).collect()] == ["r5"]
    assert bench.latest_regressions(series, 20.0).count() == 0
    assert [r.run_id for r in bench.rolling_regressions(series, 20.0).collect()] == ["r5"]
    assert bench.pr_index(p).first().pr == 7 and bench.run_index(p, 2).count() == 2
    assert bench.leaderboard(series).first().is_winner
    assert {r.run_id for r in bench.baseline_runs(p, 2, before="r4").select("run_id").distinct().collect()} == {"r3", "r2"}
    with pytest.raises(ValueError):
        bench.matrix(spark, p.withColumn("status", F.lit("stable")), {"a": [str(i) for i in range(101)], "b": [str(i) for i in range(100)]})


def test_parsers(spark):
    text = "goos: linux\nBenchmarkSort-8   1000   12.5 ns/op   3 B/op\r\nBenchmarkBad x\nPASS"
    files = spark.createDataFrame(
        [
            ("go", text),
            ("rust", "test bench_a ... bench:   1,234 ns/iter (+/- 56)\nignored"),
            ("hyperfine", '{"results":[{"command":"ls","mean":0.1,"stddev":0.01,"median":0.1,"min":0.05,"max":0.2}]}'),
            ("pytest", '{"benchmarks":[{"name":"t","stats":{"mean":1,"median":1,"min":1,"max":2,"stddev":0,"ops":5.5,"rounds":3}}]}'),
            ("named", '[{"name":"n","value":3,"unit":"ops/s"}]'),
        ],
        "file string, content string",
    )
    got = {(r.file, r.scenario, r.metric): (r.value, r.direction) for r in src.parse_any(files).collect()}
    assert got["go", "BenchmarkSort", "ns_per_op"] == (12.5, bench.SMALLER) and got["go", "BenchmarkSort", "bytes_per_op"] == (3.0, bench.SMALLER)
    assert got["rust", "bench_a", "ns_per_iter"] == (1234.0, bench.SMALLER)
    assert got["hyperfine", "ls", "min"][0] == 0.05 and got["pytest", "t", "ops"] == (5.5, bench.BIGGER) and got["named", "n", "value"] == (3.0, bench.BIGGER)
    assert sum(k[0] == "pytest" for k in got) == 7


def test_descendants(spark):
    p = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 9), (9, 4)], "pid int, ppid int")
    assert {r.pid for r in src.descendants(p, 1).collect()} == {1, 2, 3}
