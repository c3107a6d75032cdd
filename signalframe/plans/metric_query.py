"""A fluent metric query that compiles to one DataFrame plan.

    MetricQuery().metric("http_requests").where("code", "!=", "500").range(a, b).rate().step(s).sum_by("host").frame(samples)

gives (labels, ts_ns, value), with null for what can't be computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import checked
from ..operators import metrics as ops
from ..storage import SampleStore

OPS = ("=", "!=", "=~", "!~")


@dataclass(frozen=True)
class Plan:
    """What a query asks for, checked: the nodes select, time range, transform and aggregate."""

    metric: str
    matchers: tuple[tuple[str, str, str], ...]
    start: int
    end: int
    transform: str | None
    aggregate: str | None
    by: tuple[str, ...] | None
    step: int | None
    max_points: int | None
    anchor: str


@dataclass(frozen=True)
class MetricQuery:
    name: str | None = None
    matchers: tuple[tuple[str, str, str], ...] = ()
    bounds: tuple[int, int] | None = None
    transform: str | None = None
    aggregate: str | None = None
    by: tuple[str, ...] | None = None
    step_size: int | None = None
    points: int | None = None
    anchor_at: str | None = None
    unit: str = "ns"
    mappers: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())

    def metric(self, name: str) -> MetricQuery:
        return replace(self, name=name)

    def where(self, label: str, op: str, value: str) -> MetricQuery:
        if op not in OPS:
            raise ValueError(f"a matcher is one of {', '.join(OPS)}, not {op!r}")
        if op in ("=~", "!~"):
            checked(value)
        return replace(self, matchers=(*self.matchers, (label, op, value)))

    def range(self, start: int, end: int) -> MetricQuery:
        return replace(self, bounds=(start, end))

    def step(self, size: int) -> MetricQuery:
        if size <= 0:
            raise ValueError("a step is greater than 0")
        return replace(self, step_size=size)

    def max_points(self, n: int) -> MetricQuery:
        if n <= 0:
            raise ValueError("max_points is greater than 0")
        return replace(self, points=n)

    def anchor(self, where: str) -> MetricQuery:
        """"start": buckets from the query's start on; "data": from each group's first sample on."""
        if where not in ("start", "data"):
            raise ValueError("an anchor is 'start' or 'data'")
        return replace(self, anchor_at=where)

    def _transformed(self, fn: str) -> MetricQuery:
        if self.transform is not None:
            raise ValueError(f"a query has one transform; it has {self.transform} already")
        if self.aggregate is not None:
            raise ValueError("a transform comes before the aggregate")
        return replace(self, transform=fn)

    def _aggregated(self, fn: str, by: tuple[str, ...] | None = None) -> MetricQuery:
        if self.aggregate is not None:
            raise ValueError(f"a query has one aggregate; it has {self.aggregate} already")
        return replace(self, aggregate=fn, by=by)

    def plan(self) -> Plan:
        if self.name is None:
            raise ValueError("a query needs a metric")
        if self.bounds is None:
            raise ValueError("a query needs a range")
        step = ops.resolve_step(self.step_size, *self.bounds, self.points, self.unit)
        if self.step_size is not None and self.aggregate is None and self.transform not in ops.TEMPORAL:
            raise ValueError("a step needs an aggregate, or rate, increase, irate or delta")
        if self.aggregate in ops.PERCENTILES and step is None:
            raise ValueError("a percentile needs a step")
        simple = self.aggregate in ops.SIMPLE and self.transform is None
        return Plan(self.name, self.matchers, *self.bounds, self.transform, self.aggregate, self.by, step, self.points, self.anchor_at or ("start" if simple else "data"))

    def frame(self, samples: DataFrame, series: DataFrame | None = None) -> DataFrame:
        """The result over ``samples``; ``series`` (with labels and metric) may name the groups where a scan of all samples for them is too much."""
        p = self.plan()
        chosen = ops.select_series(samples, p.metric, p.matchers)
        ranged = ops.in_range(chosen, p.start, p.end)
        if p.aggregate is None:
            out = self._series(ranged, p)
        else:
            out = self._groups(chosen if series is None else ops.select_series(series, p.metric, p.matchers), ranged, p)
        out = out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
        for f in self.mappers:
            out = f(out)
        return out

    def over(self, store: SampleStore) -> DataFrame:
        """The result over a store (of nanoseconds): the series and their groups come from its table of series, the samples of the range from its days."""
        if self.unit != "ns":
            raise ValueError("a store holds nanoseconds")
        p = self.plan()
        series = ops.select_series(store.series(), p.metric, p.matchers)
        bare = replace(self, matchers=())  # the join with the chosen series has applied them
        return bare.frame(store.samples(series, p.metric, p.start, p.end), series)

    def _series(self, ranged: DataFrame, p: Plan) -> DataFrame:
        if p.transform in ops.TEMPORAL and p.step is not None:
            rows = ops.step_from_data(ranged, ["series_id"], p.transform, p.step, self.unit)
            labels = ranged.groupBy("series_id").agg(F.any_value("labels").alias("labels"))
            return rows.join(labels, "series_id").select("labels", "series_id", F.col("bucket").alias("ts_ns"), "value")
        rows = ranged
        if p.transform in ops.POINTWISE:
            rows = ops.pointwise(rows, p.transform)
        elif p.transform is not None:
            rows = ops.temporal(rows, p.transform, self.unit)
        return rows.select("labels", "series_id", "ts_ns", "value", "seq")

    def _groups(self, universe: DataFrame, ranged: DataFrame, p: Plan) -> DataFrame:
        rows = ranged
        if p.transform in ops.POINTWISE:
            rows = ops.pointwise(rows, p.transform)
        elif p.transform is not None:
            if p.step is None:
                rows = ops.temporal(rows, p.transform, self.unit)
            else:
                stepped = ops.step_from_data(rows, ["series_id"], p.transform, p.step, self.unit)
                born = rows.groupBy("series_id").agg(F.any_value("labels").alias("labels"), F.min("seq").alias("seq"))
                rows = stepped.join(born, "series_id").withColumnRenamed("bucket", "ts_ns")
        rows, keys = ops.with_group(rows, p.by)
        if p.step is None:
            out = ops.positional(rows, keys, p.aggregate)
        elif p.anchor == "start":
            groups = ops.with_group(universe, p.by)[0].select(*keys).distinct() if keys else ranged.sparkSession.range(1).select()
            out = ops.step_from_start(rows, groups, keys, p.aggregate, p.start, p.end, p.step)
        else:
            out = ops.step_from_data(rows, keys, p.aggregate, p.step, self.unit)
        return out.select(ops.group_labels(keys, p.by, p.metric).alias("labels"), F.col("bucket").alias("ts_ns"), "value")

    def map_points(self, value: Callable[[Column], Column]) -> MetricQuery:
        return replace(self, mappers=(*self.mappers, lambda df: df.withColumn("value", value(F.col("value")))))

    def map_series(self, labels: Callable[[Column], Column]) -> MetricQuery:
        return replace(self, mappers=(*self.mappers, lambda df: df.withColumn("labels", labels(F.col("labels")))))

    def filter_series(self, keep: Callable[[Column], Column]) -> MetricQuery:
        return replace(self, mappers=(*self.mappers, lambda df: df.where(keep(F.col("labels")))))


def _add_methods() -> None:
    """rate() ..., sum() ... and sum_by(labels) ... for every transform and aggregate."""

    def transform(fn: str):
        return lambda self: self._transformed(fn)

    def aggregate(fn: str):
        return lambda self: self._aggregated(fn)

    def grouped(fn: str):
        return lambda self, *labels: self._aggregated(fn, labels)

    for fn in (*ops.POINTWISE, *ops.TEMPORAL):
        setattr(MetricQuery, fn, transform(fn))
    for fn in (*ops.SIMPLE, *ops.PERCENTILES):
        setattr(MetricQuery, fn, aggregate(fn))
        setattr(MetricQuery, f"{fn}_by", grouped(fn))


_add_methods()


def recipes(metric: str, start: int, end: int, step: int, by: tuple[str, ...] = ()) -> dict[str, MetricQuery]:
    """Ready-made queries of a metric."""
    q = MetricQuery().metric(metric).range(start, end)
    return {
        "raw": q,
        "rate_sum": q.rate().step(step).sum_by(*by),
        "p95": q.step(step).p95_by(*by),
        "count": q.step(step).count_by(*by),
        "last": q.step(step).last_by(*by),
    }
