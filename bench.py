"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and is then timed over three runs, of which the
median counts; results go to Spark's no-op sink, so all columns are computed.
``throughput`` has the samples a second of metric queries over a store of the same
events many times over (COPIES, each with 50 series of its own), where the fixed cost of
a query fades; ``samples_stored`` is their number.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from signalframe.functions.values import canonical_key
from signalframe.plans.metric_query import MetricQuery
from signalframe.queries import QUERIES
from signalframe.session import build_session
from signalframe.sources.derived import event_samples
from signalframe.storage import SampleStore

HEADLINE = {
    "raw": "metric_raw",
    "sum_step": "step_sum",
    "avg_step_by": "step_avg_by",
    "rate_step": "rate_step",
    "rate_sum_by": "rate_sum_by",
    "p50_step": "step_p50",
    "p99_step": "step_p99",
    "regex": "metric_regex",
    "trace_by_id": "trace_by_id",
    "trace_search": "trace_search_status",
    "trace_self_time": "tree_self_time",
    "red_metrics": "red_metrics",
    "service_graph": "service_graph",
    "log_severity": "log_severity",
    "log_contains": "log_contains",
    "log_masked_templates": "log_masked_templates",
    "bench_compare": "bench_compare",
}
COPIES = int(os.environ.get("BENCH_COPIES", "100"))
STEP = 3_600_000_000_000


def timed(query, runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        query().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return statistics.median(times[1:])


def throughput(spark, folder: str) -> tuple[int, dict[str, float]]:
    """Samples a second of queries over the whole of a store."""
    path = tempfile.mkdtemp(prefix="bench-store-")
    try:
        rows = event_samples(spark, folder).where("value is not null").crossJoin(spark.range(COPIES).withColumnRenamed("id", "copy"))
        labels = F.map_concat(F.map_filter("labels", lambda k, _: k != "k"), F.create_map(F.lit("copy"), F.col("copy").cast("string")))
        rows = rows.withColumns({"labels": labels, "seq": F.col("seq") * COPIES + F.col("copy")}).withColumn("series_id", canonical_key("labels")).drop("copy")
        store = SampleStore(spark, path)
        store.append(rows)
        bounds = spark.read.parquet(f"{path}/samples").agg(F.count("*").alias("n"), F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi")).first()
        q = MetricQuery().metric("event_value").range(bounds.lo, bounds.hi)
        queries = {
            "raw": q, "sum_step": q.step(STEP).sum(), "avg_step_by": q.step(STEP).avg_by("event_type"), "rate_step": q.rate().step(STEP), "rate_sum_by": q.rate().step(STEP).sum_by("event_type"),
            "p50_step": q.step(STEP).p50(), "p99_step": q.step(STEP).p99(), "regex": q.where("user_bucket", "=~", "[0-9]"),
        }
        return bounds.n, {name: round(bounds.n / timed(lambda x=x: x.over(store), 1)) for name, x in queries.items()}
    finally:
        shutil.rmtree(path, ignore_errors=True)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__host="127.0.0.1")
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: round(timed(lambda q=query: QUERIES[q](spark, folder), 3), 4) for name, query in HEADLINE.items()}
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    samples = spark.read.parquet(f"{folder}/events.parquet").count()
    stored, speeds = throughput(spark, folder)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "samples": samples, "samples_stored": stored, "throughput": speeds}))


if __name__ == "__main__":
    main()
