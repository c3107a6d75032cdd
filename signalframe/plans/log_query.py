"""A log query: a set of predicates and a limit."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from ..operators.logs import in_order, log_filter


@dataclass(frozen=True)
class LogQuery:
    from_ns: int | None = None
    to_ns: int | None = None
    severity_gte: int | None = None
    body_contains: str | None = None
    body_equals: tuple[str, object] | None = None
    resource: Mapping[str, object] | None = None
    limit: int | None = None
    stream: str = "stream"

    def frame(self, logs: DataFrame) -> DataFrame:
        """The records in stream order."""
        condition = log_filter(from_ns=self.from_ns, to_ns=self.to_ns, severity_gte=self.severity_gte, body_contains=self.body_contains, body_equals=self.body_equals, resource=self.resource)
        return in_order(logs.where(condition), self.limit, self.stream)

    def iterate(self, logs: DataFrame) -> Iterator[Row]:
        """The records one by one; only a part at a time comes to the driver."""
        return self.frame(logs).toLocalIterator(prefetchPartitions=True)
