"""Helpers shared by the text operators: shared folder, tokens, hashes, filters."""

from __future__ import annotations

import functools
import gc
import itertools
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For words without punctuation: A-Z in lower case, 0-9, a-z and bytes of other scripts kept, the rest blank.
PLAIN = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and nothing needs any more."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    released(spark)


def released(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark removes the shuffle files of steps that are over."""
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself where it is read in the same parts each time (files, with no shuffle above), else a stored copy."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df if "FileScan" in plan and "Exchange" not in plan and "AdaptiveSparkPlan" not in plan else stored(df)


def portions(batch: pa.RecordBatch, place: int, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in portions of at most ``rows`` rows and about ``size`` bytes of the text in column ``place``, or one row."""
    column = batch.column(place)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        reach = (int(ends[lo - 1]) if lo else 0) + size
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, reach, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % modulus, F.lit(0))


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after A-Z to lower case; null has none."""
    return text.lower().split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z to lower case; null has none."""
    return text.translate(PLAIN).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of byte words, the same in every process.

    The hash of a word is a polynomial over a random table of its bytes, taken
    for all words of a text at once from prefix sums.
    """

    STEP = 1 << 20

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(0x5EED))
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 2**62)) * 8 + 5
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up, self.down = self._powers(self.base), self._powers(self.inverse)

    def _powers(self, base: int) -> np.ndarray:
        out = np.full(self.STEP + 1, base & (2**64 - 1), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def spans(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of buf[start:end] for each pair, ``buf`` of bytes."""
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):  # in steps, as the powers reach so far only
            lo = int(start[i])
            j = int(np.searchsorted(end, lo + self.STEP, "right"))
            if j <= i:  # one span longer than a step: fold its pieces
                h, at = 0, lo
                while at < end[i]:
                    piece = buf[at : min(at + self.STEP, int(end[i]))]
                    h = (h * 0x9E3779B97F4A7C15 + int((self.table[piece] * self.up[: len(piece)]).sum(dtype=np.uint64)) + 1) & (2**64 - 1)
                    at += self.STEP
                out[i] = h
                i += 1
                continue
            hi = int(end[j - 1])
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.table[buf[lo:hi]] * self.up[: hi - lo], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * self.down[s]
            i = j
        return mix(out ^ (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def spaced_spans(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one array, A-Z folded; start and end of each of the words that ``spaced_words`` gives; and where each text's words begin (one more than there are texts)."""
    buf = _LOWER[np.frombuffer(b" ".join([t or b"" for t in texts]), np.uint8)]
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = _SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    text_end = np.cumsum(np.array([len(t or b"") + 1 for t in texts], np.int64))
    return buf, edge[0::2], edge[1::2], np.concatenate([[0], np.searchsorted(edge[0::2], text_end)])


def word_hashes(hasher: WordHash, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words that ``spaced_words`` gives for all texts in order, and where each text's begin (one more than there are texts)."""
    buf, start, end, at = spaced_spans(texts)
    return hasher.spans(buf, start, end), at


def numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``h``, ascending, and the place of each value among them."""
    found = pa.array(h).dictionary_encode()
    known = found.dictionary.to_numpy()
    order = np.argsort(known, kind="stable")
    rank = np.empty(len(known), np.int32)
    rank[order] = np.arange(len(known), dtype=np.int32)
    return known[order], rank[found.indices.to_numpy()]


def bounds(buckets: int) -> np.ndarray:
    """The edges that cut ascending 64-bit hashes into so many ranges, for searchsorted; the last is the greatest hash."""
    return np.array([(b << 64) // buckets for b in range(buckets)] + [2**64 - 1], np.uint64)


@functools.cache
def _coders() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(data: bytes) -> bytes:
    return _coders()[0].compress(data)


def loosened(data: bytes) -> bytes:
    return _coders()[1].decompress(data)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """The bytes of some arrays, compressed."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return squeezed(b"".join([struct.pack(f"<{len(raw)}q", *map(len, raw)), *raw]))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays that ``pack`` was given, of these kinds."""
    data, out = loosened(data), []
    at = 8 * len(kinds)
    for kind, size in zip(kinds, struct.unpack_from(f"<{len(kinds)}q", data), strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones and so on, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)


def unplanes(x: np.ndarray, kind: type = np.int32) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(x.reshape(size, -1).T).view(kind).reshape(-1)


def input_bytes(df: DataFrame) -> int:
    """The size of the files that ``df`` reads, as the planner has it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def dealt(rows: DataFrame, by: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` dealt out by the whole number in ``by`` (of a slice: its part times 2**24 plus its place in the part) and sorted within the parts, which are as many as the session's shuffle partitions or ``parts``."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.pmod(F.shiftright(by, 24) + F.col(by).bitwiseAND(0xFFFFFF) * 7919, F.lit(parts)).cast("int")
    return rows.repartitionById(parts, number).sortWithinPartitions(*order)


def met(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The runs of rows that agree in the first ``keys`` columns (whole numbers, none null)."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            key = tuple(columns[:, lo].tolist())
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, held


class Bloom:
    """A Bloom filter over 64-bit keys with a fixed number of bits: what it lets through must still be joined exactly.

    Its size, 2**log2_bits / 8 bytes, does not depend on the data; over too many
    keys it only lets more rows through.
    """

    HASHES = 3

    def __init__(self, bits: np.ndarray, log2_bits: int) -> None:
        self.bits, self.log2_bits = bits, log2_bits

    @classmethod
    def places(cls, keys: np.ndarray, log2_bits: int) -> list[np.ndarray]:
        keys = keys.astype(np.uint64, copy=False)
        return [mix(keys + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))) >> np.uint64(64 - log2_bits) for i in range(cls.HASHES)]

    @classmethod
    def over(cls, keys: DataFrame, key: str, log2_bits: int = 24) -> Bloom:
        def marks(batches):
            for batch in batches:
                at = np.concatenate(cls.places(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), log2_bits))
                word, place = np.unique(at >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(bits, place, np.uint64(1) << (at & np.uint64(63)))
                yield pa.record_batch([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

        rows = keys.select(key).mapInArrow(marks, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        out = np.zeros(1 << (log2_bits - 6), np.int64)
        out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        return cls(out.view(np.uint64), log2_bits)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For each key, whether it may be in the filter."""
        out = np.ones(len(keys), bool)
        for at in self.places(keys, self.log2_bits):
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out
