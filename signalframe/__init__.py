"""A telemetry analytics engine on Spark DataFrames: metrics, traces, logs, records and benchmark histories."""
