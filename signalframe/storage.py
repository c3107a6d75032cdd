"""Tables in the folder that the cluster shares, and how tables are laid out on disk."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The most rows that a task sorts for its files, about: what bounds its memory whatever the size of the table.
TASK_ROWS = 1 << 20


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: loops over it keep short plans, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunked(writer: DataFrameWriter, codec: str, max_rows: int | None = None, group_mb: int | None = None) -> DataFrameWriter:
    """The policy by which a table is cut: its codec, the most rows of a file, and the size of a row group."""
    writer = writer.option("compression", codec)
    if max_rows is not None:
        writer = writer.option("maxRecordsPerFile", max_rows)
    return writer if group_mb is None else writer.option("parquet.block.size", group_mb << 20)


def write_samples(samples: DataFrame, path: str, files: int | None = None, codec: str = "zstd", **policy) -> None:
    """Samples by metric and day, sorted by series and time, so selectors and ranges prune folders and row groups; see ``chunked`` for the policy.

    With ``max_rows`` a folder is written by one task, so that all of its files but the
    last are full, and folders are written side by side; else ``files`` is the least
    number of tasks, and there are more where each would have more than TASK_ROWS rows.
    """
    rows = samples.withColumn("day", F.expr("cast(ts_ns div 86400000000000L as int)"))
    columns = ["metric", "day", "series_id", "ts_ns"]
    if policy.get("max_rows") is not None:
        tasks = max(files or 1, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartitionByRange(tasks, "metric", "day")
    else:
        rows = rows.repartitionByRange(max(files, -(-samples.count() // TASK_ROWS)), *columns) if files else rows.repartitionByRange(*columns)
    chunked(rows.sortWithinPartitions(*columns).write.mode("append").partitionBy("metric", "day"), codec, **policy).parquet(path)


def write_spans(spans: DataFrame, path: str, codec: str = "zstd") -> None:
    """Spans by day and trace, with a Bloom filter on the trace id for look-ups."""
    rows = spans.withColumn("day", F.expr("cast(start_ns div 86400000000000L as int)"))
    (
        rows.repartitionByRange("day", "trace_id")
        .sortWithinPartitions("day", "trace_id", "start_ns")
        .write.mode("append")
        .partitionBy("day")
        .option("compression", codec)
        .option("parquet.bloom.filter.enabled#trace_id", "true")
        .parquet(path)
    )


def write_logs(logs: DataFrame, path: str, codec: str = "zstd") -> None:
    """Logs by day, within files by stream and time, so severity and time prune row groups."""
    rows = logs.withColumn("day", F.expr("cast(time_ns div 86400000000000L as int)"))
    stream = "stream" if "stream" in logs.columns else "stream_id"
    rows.repartitionByRange("day", stream, "time_ns").sortWithinPartitions("day", stream, "time_ns").write.mode("append").partitionBy("day").option("compression", codec).parquet(path)


def compact(spark: SparkSession, source: str, target: str, partition_by: list[str], file_mb: int = 256, codec: str = "zstd") -> None:
    """Rewrite small files as fewer larger ones, with a stronger codec.

    Rows of a file stay in order; a folder too large for one task is cut.
    """
    df = spark.read.parquet(source)
    stats = table_stats(df).first()
    tasks = max(1, -(-(stats.bytes or 0) // (file_mb << 20)), -(-(stats.rows or 0) // TASK_ROWS))
    # where a row stands in the source cuts a folder, so that no task has to take the whole of one
    place = {"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
    dealt = df.select("*", *[c.alias(n) for n, c in place.items()]).repartitionByRange(tasks, *partition_by, *place)
    dealt.sortWithinPartitions(*partition_by, *place).drop(*place).write.mode("overwrite").partitionBy(*partition_by).option("compression", codec).parquet(target)


def table_stats(df: DataFrame) -> DataFrame:
    """Files, bytes and rows of a table read from files."""
    per_file = df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).count()
    return per_file.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("count").alias("rows"))


class SampleStore:
    """Samples beside a table of their series.

    A sample has the 64-bit hash of its series, not its labels; a query picks the
    series it wants from their table, which is small beside the samples, and joins
    them to the samples of its days by that number.  Groups come from the table of
    series as well, so nothing outside the range is read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, part: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def append(self, samples: DataFrame, files: int | None = None) -> None:
        """Add samples, and those of their series that are new."""
        number = F.xxhash64("series_id").alias("sid")
        own = samples.groupBy(number).agg(F.any_value("series_id").alias("series_id"), F.any_value("metric").alias("metric"), F.any_value("labels").alias("labels"))
        new = materialised(own.join(self.series().select("sid"), "sid", "left_anti") if self._there("series") else own)
        rows = samples.select("metric", F.expr("cast(ts_ns div 86400000000000L as int)").alias("day"), number, "ts_ns", "value", "seq")
        columns = ["metric", "day", "sid", "ts_ns"]
        dealt = rows.repartitionByRange(max(files, -(-rows.count() // TASK_ROWS)), *columns) if files else rows.repartitionByRange(*columns)
        dealt.sortWithinPartitions(*columns).write.mode("append").partitionBy("metric", "day").option("compression", "zstd").parquet(f"{self.path}/samples")
        new.write.mode("append").parquet(f"{self.path}/series")

    def series(self) -> DataFrame:
        """(sid, series_id, metric, labels)."""
        return self.spark.read.parquet(f"{self.path}/series")

    def samples(self, series: DataFrame | None = None, metric: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """Samples with the labels of their series: of ``series`` (rows of its table), of one metric, from ``start`` to ``end`` (ns), where given."""
        rows = self.spark.read.parquet(f"{self.path}/samples")
        if metric is not None:
            rows = rows.where(F.col("metric") == metric)
        if start is not None:
            rows = rows.where((F.col("day") >= start // 86_400_000_000_000) & (F.col("ts_ns") >= start))
        if end is not None:
            rows = rows.where((F.col("day") <= end // 86_400_000_000_000) & (F.col("ts_ns") <= end))
        own = (self.series() if series is None else series).select("sid", "series_id", "labels")
        return rows.join(own, "sid").select("series_id", "metric", "labels", "ts_ns", "value", "seq")
