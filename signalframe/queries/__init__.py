"""Every registered query with its SQL: ``QUERIES`` and ``ORACLES``."""

from . import bench, logs, metrics, readers, records, streams, traces

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (metrics, records, traces, logs, bench, streams, readers):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
