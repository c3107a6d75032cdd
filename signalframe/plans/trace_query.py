"""A fluent trace search that compiles to one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import attribute
from ..operators import traces as ops


@dataclass(frozen=True)
class TraceQuery:
    span: tuple[tuple[str, object], ...] = ()
    attributes: tuple[tuple[str, str, object], ...] = ()
    trace: tuple[tuple[str, object], ...] = ()
    relations: tuple[tuple[Column | str, str, Column | str], ...] = ()
    sorted_by: tuple[str, bool] = ("startTime", False)
    skip: int = 0
    most: int | None = None

    def _span(self, **given: object) -> TraceQuery:
        return replace(self, span=(*self.span, *given.items()))

    def _trace(self, **given: object) -> TraceQuery:
        return replace(self, trace=(*self.trace, *given.items()))

    def trace_id(self, value: str) -> TraceQuery:
        return self._span(trace_id=value)

    def time_range(self, start_ns: int, end_ns: int) -> TraceQuery:
        return self._span(start_ns=start_ns, end_ns=end_ns)

    def service(self, name: str) -> TraceQuery:
        return self._span(service=name)

    def span_name(self, name: str) -> TraceQuery:
        return self._span(name=name)

    def span_name_matches(self, pattern: str) -> TraceQuery:
        return self._span(name_regex=pattern)

    def kind(self, kind: int) -> TraceQuery:
        return self._span(kind=kind)

    def status(self, code: int) -> TraceQuery:
        return self._span(status_code=code)

    def duration(self, least_ns: int | None = None, most_ns: int | None = None) -> TraceQuery:
        return self._span(min_duration_ns=least_ns, max_duration_ns=most_ns)

    def attribute(self, key: str, op: str, value: object = None) -> TraceQuery:
        return replace(self, attributes=(*self.attributes, (op, key, value)))

    def has_attribute(self, key: str) -> TraceQuery:
        return self.attribute(key, "exists")

    def missing_attribute(self, key: str) -> TraceQuery:
        return self.attribute(key, "notExists")

    def trace_duration(self, least_ns: int | None = None, most_ns: int | None = None) -> TraceQuery:
        return self._trace(min_duration_ns=least_ns, max_duration_ns=most_ns)

    def span_count(self, least: int | None = None, most: int | None = None) -> TraceQuery:
        return self._trace(min_spans=least, max_spans=most)

    def root_service(self, name: str) -> TraceQuery:
        return self._trace(root_service=name)

    def root_span_name(self, name: str) -> TraceQuery:
        return self._trace(root_name=name)

    def related(self, left: Column | str, relation: str, right: Column | str) -> TraceQuery:
        """Traces in which a span with ``right`` is the ``relation`` of one with ``left``; conditions are Columns or SQL."""
        if relation not in ops.RELATIONS:
            raise ValueError(f"a relation is one of {', '.join(ops.RELATIONS)}")
        return replace(self, relations=(*self.relations, (left, relation, right)))

    def has_descendant(self, left: Column | str, right: Column | str) -> TraceQuery:
        return self.related(left, "descendant", right)

    def has_ancestor(self, left: Column | str, right: Column | str) -> TraceQuery:
        return self.related(left, "ancestor", right)

    def has_child(self, left: Column | str, right: Column | str) -> TraceQuery:
        return self.related(left, "child", right)

    def has_parent(self, left: Column | str, right: Column | str) -> TraceQuery:
        return self.related(left, "parent", right)

    def has_sibling(self, left: Column | str, right: Column | str) -> TraceQuery:
        return self.related(left, "sibling", right)

    def sort_by(self, field: str, ascending: bool = False) -> TraceQuery:
        if field not in ("startTime", "duration", "spanCount"):
            raise ValueError("traces are sorted by startTime, duration or spanCount")
        return replace(self, sorted_by=(field, ascending))

    def offset(self, n: int) -> TraceQuery:
        return replace(self, skip=n)

    def limit(self, n: int) -> TraceQuery:
        return replace(self, most=n)

    def condition(self) -> Column:
        return ops.span_filter(**dict(self.span), attributes=[attribute(op, "attributes", key, value) for op, key, value in self.attributes])

    def spans(self, spans: DataFrame) -> DataFrame:
        """All spans of the traces found, before paging."""
        found = ops.two_phase(spans, self.condition()) if self.span or self.attributes else spans
        for left, relation, right in self.relations:
            found = found.join(ops.structural(found, left, relation, right), "trace_id", "left_semi")
        if self.trace:
            ids = ops.assemble(found).where(ops.trace_filter(**dict(self.trace))).select("trace_id")
            found = found.join(ids, "trace_id", "left_semi")
        return found

    def frame(self, spans: DataFrame) -> DataFrame:
        """The traces found, one row each, sorted and paged."""
        field, ascending = self.sorted_by
        return ops.page(ops.assemble(self.spans(spans)), field, ascending, self.skip, self.most)

    def total(self, spans: DataFrame) -> DataFrame:
        """The number of traces before paging."""
        return ops.assemble(self.spans(spans)).agg(F.count("*").alias("total_traces"))
