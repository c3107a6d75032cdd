import math

import pytest
from pyspark.sql import functions as F

from signalframe.functions.labels import format_numeric
from signalframe.operators import metrics as ops
from signalframe.plans.metric_query import MetricQuery

SCHEMA = "series_id string, metric string, labels map<string,string>, ts_ns bigint, value double, seq bigint"


def frame(spark, series):
    rows, seq = [], 0
    for name, labels, points in series:
        for t, v in points:
            rows.append((name + str(sorted(labels.items())), name, labels, t, float(v), seq))
            seq += 1
    return spark.createDataFrame(rows, SCHEMA)


def small(spark):
    start = 1_000_000
    series = [("cpu", {"host": h, "region": "us-east"}, [(start + i * 15_000, 10 + 10 * k + 0.1 * i) for i in range(100)]) for k, h in enumerate("abc")]
    series.append(("mem", {"host": "a"}, [(start + i * 15_000, 8192 + i) for i in range(50)]))
    return frame(spark, series)


def q(metric="cpu"):
    return MetricQuery(unit="ms").metric(metric).range(0, 10**9)


def values(df):
    return [r.value for r in df.orderBy("ts_ns").collect()]


def test_selection_and_positional_sum(spark):
    s = small(spark).cache()
    raw = q().frame(s)
    assert raw.count() == 300 and raw.select("series_id").distinct().count() == 3
    assert values(q().sum().frame(s))[0] == pytest.approx(60)
    assert q("no_such").frame(s).count() == 0
    assert q().where("host", "=", "a").frame(s).count() == 100
    assert q().where("host", "!=", "a").frame(s).count() == 200
    assert q().where("zone", "!=", "x").frame(s).count() == 300
    assert q().where("zone", "=~", ".*").frame(s).count() == 0
    assert q().where("host", "=~", "a|b").frame(s).count() == 200
    assert q().where("host", "!~", "a|b").frame(s).count() == 100


def test_dense_grid_from_start_and_from_data(spark):
    s = frame(spark, [("m", {}, [(100, 1), (130, 3)])])
    query = MetricQuery(unit="ms").metric("m").range(90, 149).step(10)
    got = [(r.ts_ns, r.value) for r in query.avg().frame(s).orderBy("ts_ns").collect()]
    assert got == [(90, None), (100, 1.0), (110, None), (120, None), (130, 3.0), (140, None)]
    assert [r.value for r in query.sum().frame(s).orderBy("ts_ns").collect()] == [0.0, 1.0, 0.0, 0.0, 3.0, 0.0]
    got = [(r.ts_ns, r.value) for r in query.anchor("data").max().frame(s).orderBy("ts_ns").collect()]
    assert got == [(100, 1.0), (110, None), (120, None), (130, 3.0)]


def test_resets_and_rates(spark):
    s = frame(spark, [("c", {}, [(0, 10), (1000, 20), (2000, 5), (3000, 8)])])
    base = MetricQuery(unit="ms").metric("c").range(0, 10_000)
    assert values(base.increase().frame(s)) == [None, 10, 5, 3]
    assert values(base.delta().frame(s)) == [None, 10, -15, 3]
    assert values(base.rate().frame(s)) == [None, 10, 5, 3]
    assert values(base.rate().step(10_000).frame(s)) == [pytest.approx(8 / 3)]  # 8 after a reset from 10, over 3 s
    assert values(base.irate().step(10_000).frame(s)) == [3]
    assert values(base.increase().step(2000).frame(s)) == [10, 3]
    single = frame(spark, [("c", {}, [(0, 10)])])
    assert values(base.rate().step(1000).frame(single)) == [None]


def test_nan_is_passed_over_by_min_and_max_only(spark):
    s = frame(spark, [("m", {}, [(0, 1), (1, math.nan), (2, 3)])])
    query = MetricQuery(unit="ms").metric("m").range(0, 9).step(10)
    assert values(query.max().frame(s)) == [3] and values(query.min().frame(s)) == [1]
    assert values(query.sum().frame(s)) == [None] and values(query.count().frame(s)) == [3]


def test_grouping_leaves_out_empty_labels(spark):
    s = frame(spark, [("m", {"a": "x"}, [(0, 1)]), ("m", {}, [(0, 2)]), ("m", {"a": ""}, [(0, 4)])])
    got = {tuple(sorted(r.labels.items())): r.value for r in MetricQuery(unit="ms").metric("m").range(0, 9).step(10).sum_by("a").frame(s).collect()}
    assert got == {(("__name__", "m"), ("a", "x")): 1.0, (("__name__", "m"),): 6.0}


def test_percentiles_take_the_nearest_rank(spark):
    s = frame(spark, [("m", {}, [(i, i + 1) for i in range(10)])])
    query = MetricQuery(unit="ms").metric("m").range(0, 9).step(100)
    assert values(query.p50().frame(s)) == [5] and values(query.p90().frame(s)) == [9] and values(query.p99().frame(s)) == [10]


def test_partitions_do_not_matter(spark):
    s = small(spark)
    query = q().rate().step(60_000).avg_by("host")
    one = sorted(map(str, query.frame(s.coalesce(1)).collect()))
    assert one == sorted(map(str, query.frame(s.repartition(16)).collect()))


def test_builder_errors():
    for bad in (
        lambda: MetricQuery().range(0, 1).plan(),
        lambda: MetricQuery().metric("m").plan(),
        lambda: MetricQuery().step(0),
        lambda: MetricQuery().metric("m").range(0, 1).step(5).plan(),
        lambda: MetricQuery().metric("m").range(0, 1).p50().plan(),
        lambda: MetricQuery().rate().delta(),
        lambda: MetricQuery().sum().sum(),
        lambda: MetricQuery().where("a", "~", "b"),
        lambda: MetricQuery().where("a", "=~", "x" * 201),
    ):
        with pytest.raises(ValueError):
            bad()


def test_max_points_and_stats(spark):
    assert ops.resolve_step(None, 0, 100, 11, "s") == 10
    assert ops.resolve_step(50, 0, 100, 11, "s") == 50
    assert ops.resolve_step(None, 0, 100, 11, "ns") is None
    row = ops.chunk_stats(frame(spark, [("m", {}, [(0, 5), (1, 2), (2, 9)])])).first()
    assert (row.min_value, row.max_value, row.first_value, row.last_value, row.resets, row.n) == (2, 9, 5, 9, 1, 3)


def test_later_partition_wins(spark):
    a = frame(spark, [("m", {}, [(0, 1), (1, 1)])])
    b = frame(spark, [("m", {}, [(1, 7), (2, 7)])])
    assert values(ops.merge_partitions([a, b])) == [1, 7, 7]


def test_numeric_labels():
    assert [format_numeric(x) for x in (5.0, 0.5, 2.5, 1e-7, 10.0, 0.1)] == ["5", "0.500000000000", "2.50000000000", "1.00000000000e-7", "10", "0.100000000000"]


def test_quantised(spark):
    s = frame(spark, [("m", {}, [(0, 1.005), (1, -2.5), (2, 3)])])
    assert values(ops.quantised(s, 0)) == [1.0, -2.0, 3.0]
    assert ops.pointwise(s, "floor").agg(F.sum("value")).first()[0] == 1.0
