"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over the windows of training texts.

Words are lower-cased (A-Z) and cut at ASCII characters that are neither
letters nor digits.  A window is ``n`` consecutive words of an item; an item of
fewer words, but at least one, is one window.  Rolling hashes over the words
that the benchmark has find candidates, and each candidate is compared word by
word.  The benchmark is broadcast in blocks of a checked size: one block as a
rule; a larger benchmark takes one scan a block, and each row's hits are joined.

Null or empty texts have no words and are never hit; repeated items and
documents are kept as they are; an empty benchmark hits nothing.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, plain_words, portions, settled, stored

_ODD = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(64)], np.uint64)


class WindowSet:
    """The windows of some benchmark items, ready to be found in texts; about 20 bytes a window besides the distinct words."""

    def __init__(self, items: list[tuple[str, bytes | None]], n: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in plain_words(text)], np.int32) for _, text in items]
        length = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([np.empty(0, np.int32), *ids])
        begin, size = np.cumsum(length) - length, np.minimum(n, length)
        #: For each window size: the hashes of the windows ascending, where each starts in ``ids``, and its item.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == k)
            many = length[own] - k + 1
            start = np.arange(many.sum()) + np.repeat(begin[own] - (np.cumsum(many) - many), many)
            h = self._hash([self.ids[start + j] for j in range(k)])
            order = np.argsort(h, kind="stable")
            self.windows[k] = h[order], start[order], np.repeat(own, many)[order]

    @staticmethod
    def _hash(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for j, column in enumerate(columns):
            out = (out + column.astype(np.uint64) + np.uint64(1)) * _ODD[j % 64]
            out ^= out >> np.uint64(29)
        return out

    def find(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int, list[str]]]]]:
        """For each text its number of words and its hits (first word, number of words, items)."""
        words, counts = [], []
        for text in texts:
            own = plain_words(text)
            words += own
            words.append(b"")  # in no window, so none runs on into the next text
            counts.append(len(own))
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        known = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(ids >= 0, out=known[1:])
        starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
        found: list[list[tuple[int, int, list[str]]]] = [[] for _ in texts]
        for size, (table, begin, item) in self.windows.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            h = self._hash([ids[at + j] for j in range(size)])
            lo, hi = np.searchsorted(table, h), np.searchsorted(table, h, "right")
            for i in np.flatnonzero(lo < hi).tolist():
                p, near = int(at[i]), np.arange(lo[i], hi[i])
                same = (self.ids[begin[near][:, None] + np.arange(size)] == ids[p : p + size]).all(1)
                if same.any():
                    doc = int(np.searchsorted(starts, p, "right")) - 1
                    found[doc].append((p - int(starts[doc]), size, [self.items[k] for k in np.unique(item[near[same]]).tolist()]))
        return list(zip(counts, found, strict=True))


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[list[tuple[str, bytes | None]]]:
    """The items in blocks of about ``block_bytes`` of text at most (one item at least), read one by one."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    if parts == 1:
        yield [(r.item, r.text) for r in rows.collect()]
        return
    for part in range(2 * parts):
        yield [(r.item, r.text) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(2 * parts)) == part).collect()]


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: ``key``, n_words, n_hit, item_ids (sorted as strings), hits (array of first word and length).

    A word inside any occurrence of a window is hit; item_ids are those with an
    occurring window, null ids aside: their words are hit all the same.  Every row
    has its own result, whatever its key, and the result is the same for any
    ``block_bytes``: where there are several blocks, the scans' hits meet by the
    row's place in its files (other sources are written to a table first).
    """
    spark, docs = docs.sparkSession, settled(docs)
    schema = f"row__ long, `{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_hit long, item_ids array<string>, hits array<struct<first:int,size:int>>"
    scans = []
    for items in _blocks(benchmark, item, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def scan(batches, shared=shared):
            windows = WindowSet(shared.value, n)
            for whole in batches:
                for batch in portions(whole, 2):
                    n_words, n_hit, ids, hits = [], [], [], []
                    for count, found in windows.find(batch.column(2).to_pylist()):
                        runs: list[list[int]] = []
                        for first, size, _ in sorted(found, key=lambda x: x[:2]):
                            if runs and first <= runs[-1][0] + runs[-1][1]:
                                runs[-1][1] = max(runs[-1][1], first + size - runs[-1][0])
                            else:
                                runs.append([first, size])
                        n_words.append(count)
                        n_hit.append(sum(r[1] for r in runs))
                        ids.append(sorted({i for f in found for i in f[2] if i is not None}))
                        hits.append([{"first": a, "size": b} for a, b in runs])
                    yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32())])))], names=["row__", key, "n_words", "n_hit", "item_ids", "hits"])

        scans.append(docs.select(F.monotonically_increasing_id().alias("row__"), F.col(key), F.col(text).cast("binary").alias("text")).mapInArrow(scan, schema))
    if len(scans) == 1:
        return scans[0].drop("row__")
    out = scans[0]
    for more in scans[1:]:
        out = out.unionByName(more)
    merged = out.groupBy("row__").agg(F.first(key).alias(key), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["first"] + h["size"] - F.greatest(a["end"], h["first"]))).alias("n"), F.greatest(a["end"], h["first"] + h["size"]).alias("end")))["n"]
    return merged.select(key, "n_words", covered.cast("long").alias("n_hit"), "item_ids", "hits")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, *, key: str = "doc_id", text: str = "text", mode: str = "documents", **names) -> DataFrame:
    """``docs`` without benchmark passages, with its own columns.

    mode "documents": every document with a hit goes.  mode "spans": the hit
    words go, with what stands between the words of one hit, and n_chars is
    counted anew where the table has it.  Rows are told apart by content, so
    documents with the same key are judged each on its own.
    """
    spark = docs.sparkSession
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    shared = [spark.sparkContext.broadcast(x) for x in _blocks(benchmark, names.get("item", "item_id"), names.get("item_text", "text"), names.get("block_bytes", 16 << 20))]
    place, schema = docs.columns.index(text), docs.schema

    def keep(block):
        def run(batches):
            windows = WindowSet(block.value, n)
            for whole in batches:
                for batch in portions(whole, place):
                    texts = batch.column(place).cast(pa.binary()).to_pylist()
                    found = windows.find(texts)
                    if mode == "documents":
                        yield batch.filter(pa.array([not hits for _, hits in found], pa.bool_()))
                        continue
                    new = [cut_words(t, [(a, b) for a, b, _ in hits]) if hits else t for t, (_, hits) in zip(texts, found, strict=True)]
                    out = pa.array(new, pa.binary()).cast(batch.column(place).type)
                    columns = [out if i == place else c for i, c in enumerate(batch.columns)]
                    yield pa.record_batch(columns, names=batch.schema.names)

        return run

    out = docs
    for i, block in enumerate(shared):
        out = (stored(out) if i else out).mapInArrow(keep(block), schema)
    if mode == "spans" and "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(schema["n_chars"].dataType))
    return out


def cut_words(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of each run (first word, number of words) and what stands between them."""
    blank = np.frombuffer(b" " + text.translate(PLAIN) + b" ", np.uint8) == 0x20
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[0::2], edge[1::2]
    gone = np.zeros(len(text), bool)
    for first, size in runs:
        gone[start[first] : end[first + size - 1]] = True
    return np.frombuffer(text, np.uint8)[~gone].tobytes()


def digest(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the op8 query from those of ``find_hits``."""
    return hits.select(key, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


