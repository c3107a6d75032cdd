"""The canonical schemas, as DDL.

``seq`` is the ordinal of a row at ingest; whatever is first, last or stable
is so by (time, seq).  Times are nanoseconds since the epoch.
"""

from __future__ import annotations

SAMPLES = "series_id string, metric string, labels map<string,string>, ts_ns bigint, value double, seq bigint"

EVENT = "struct<time_ns:bigint,name:string,attributes:map<string,string>>"
LINK = "struct<trace_id:string,span_id:string,attributes:map<string,string>>"
SPANS = (
    "trace_id string, span_id string, parent_span_id string, name string, kind int, start_ns bigint, end_ns bigint, duration_ns bigint, "
    f"status_code int, status_message string, attributes map<string,string>, events array<{EVENT}>, links array<{LINK}>, "
    "resource map<string,string>, service_name string, scope_name string, scope_version string, seq bigint"
)
LOGS = (
    "time_ns bigint, observed_ns bigint, severity_number int, severity_text string, body string, body_kind string, attributes map<string,string>, "
    "trace_id string, span_id string, flags int, event_name string, resource map<string,string>, scope_name string, scope_version string, stream_id bigint, seq bigint"
)
BENCH_POINTS = (
    "run_id string, run_ts timestamp, commit string, ref string, scenario string, series string, metric string, value double, unit string, "
    "direction string, role string, tags map<string,string>, point_ts_ns bigint"
)

SPAN_KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
STATUS_CODES = ("UNSET", "OK", "ERROR")
#: The least severity number of each name.
SEVERITIES = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
