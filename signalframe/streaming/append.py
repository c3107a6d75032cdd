"""Structured Streaming twins of the batch operators.

Files dropped in a folder are the stream; ``run_available`` processes what is
there and stops, so a stream can be held against its batch twin.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.drain import Drain
from ..storage import shared_folder


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 64) -> DataFrame:
    """Parquet files of a folder as they come, at most ``max_files`` a batch (the ingest's back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet").parquet(path)


def run_available(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Hand every batch of what is there to ``on_batch``, in update mode, and wait for the end."""
    folder = checkpoint or f"{shared_folder(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(on_batch).start()
    query.awaitTermination()


def append_available(stream: DataFrame, target: str, checkpoint: str | None = None) -> None:
    """Append every batch of what is there to a Parquet table, each once."""
    folder = checkpoint or f"{shared_folder(stream.sparkSession)}/streams/{uuid.uuid4().hex}"
    stream.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def bucket_stream(records: DataFrame, interval: str, delay: str, key: str) -> DataFrame:
    """Sums and counts of each key and time window of a stream with the timestamp column ``ts``; windows close ``delay`` after the latest time."""
    w = F.window("ts", interval)
    return records.withWatermark("ts", delay).groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.sum("value").alias("sum"), F.count("value").alias("n")).select("key", F.col("w.start").alias("bucket"), "sum", "n")


class FrameTable:
    """A keyed frame that batches of updates are merged into: of points of one key and bucket the last batch's stays (or the first's)."""

    def __init__(self, spark: SparkSession, keep_existing: bool = False) -> None:
        self.path, self.spark, self.keep_existing = f"{shared_folder(spark)}/frames/{uuid.uuid4().hex}", spark, keep_existing

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Written once for each batch id, so a repeated batch replaces itself."""
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def frame(self, keys: list[str]) -> DataFrame:
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(self.path)
        others = [c for c in rows.columns if c not in (*keys, "batch")]
        pick = F.min_by if self.keep_existing else F.max_by
        return rows.groupBy(*keys).agg(pick(F.struct(*others), "batch").alias("x")).select(*keys, *[F.col(f"x.{c}") for c in others])


def newest(records: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` records (key, seq, ts_ns, value) to arrive of each key, given anew whenever the key changes."""
    kind = records.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, seq long, ts_ns long, value double"

    def keep(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        for part in parts:
            held += list(zip(part["seq"].tolist(), part["ts_ns"].tolist(), part["value"].tolist(), strict=True))
        held = sorted(held)[-n:]
        state.update((json.dumps(held),))
        yield pd.DataFrame({key: [group[0]] * len(held), "seq": [h[0] for h in held], "ts_ns": [h[1] for h in held], "value": [h[2] for h in held]})

    return records.select(key, "seq", "ts_ns", "value").groupBy(key).applyInPandasWithState(keep, schema, "held string", "update", GroupStateTimeout.NoTimeout)


def within_age(records: DataFrame, key: str, max_age_ns: int) -> DataFrame:
    """The records of each key that are not older than its newest by more than ``max_age_ns``, given anew whenever the key changes."""
    kind = records.schema[key].dataType.simpleString()

    def keep(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        for part in parts:
            held += list(zip(part["seq"].tolist(), part["ts_ns"].tolist(), part["value"].tolist(), strict=True))
        last = max(h[1] for h in held)
        held = sorted(h for h in held if h[1] >= last - max_age_ns)
        state.update((json.dumps(held),))
        yield pd.DataFrame({key: [group[0]] * len(held), "seq": [h[0] for h in held], "ts_ns": [h[1] for h in held], "value": [h[2] for h in held]})

    return records.select(key, "seq", "ts_ns", "value").groupBy(key).applyInPandasWithState(keep, f"`{key}` {kind}, seq long, ts_ns long, value double", "held string", "update", GroupStateTimeout.NoTimeout)


def mine_stream(logs: DataFrame, stream: str = "stream", **settings) -> DataFrame:
    """(stream, seq, template_id, is_new) of each line as it comes; a stream's templates are its state."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        drain = Drain(**settings)
        if state.exists:
            for tokens, size in json.loads(state.get[0]):
                drain.restore(tokens, size)
        for part in parts:
            part = part.sort_values("seq", kind="stable")
            found = [drain.add(body) for body in part["body"]]
            yield pd.DataFrame({stream: group[0], "seq": part["seq"].tolist(), "template_id": [f[0] for f in found], "is_new": [f[2] for f in found]})
        state.update((json.dumps(list(zip(drain.templates, drain.sizes, strict=True))),))

    rows = logs.where("body is not null").select(stream, "seq", "body")
    return rows.groupBy(stream).applyInPandasWithState(run, f"{stream} string, seq bigint, template_id int, is_new boolean", "templates string", "append", GroupStateTimeout.NoTimeout)
