"""BPE encoding and decoding over a table of distinct words.

Each slice of the texts (``SLICE`` bytes or so of one part) is cut into words, told
apart by hash within the slice, and sends its distinct words to buckets by hash,
packed.  A bucket encodes each of its distinct words once and sends the ids back
to the slices that asked; every slice lays the ids of its words side by side in the
order of their positions.  Words of more than ``GROUP`` slices are encoded once for
each group of so many slices, so that no bucket grows with the number of slices.

Decoding joins each id with its piece (a table as long as the vocabulary) and
reads the bytes as UTF-8, with U+FFFD where they are not.  As byte-level BPE loses
nothing, a text whose ids don't decode to itself shows a fault (two words of one
hash, or a slice that was cut otherwise when it was read again); it is then encoded
on its own.

Null and empty texts have no ids and decode to the empty text.  Rows with equal
keys or texts are encoded each on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, bounds, dealt, input_bytes, loosened, met, numbered, pack, planes, portions, settled, squeezed, unpack, unplanes
from .pretokens import SPECIAL, cut_bytes, decode_ids, default_path, encode_words, gathered

SLICE = 8 << 20
GROUP = 1024
#: Bytes of a slice that are cut and hashed at once: what is made of each byte takes many times its room.
PIECE = 1 << 18


class SliceWords:
    """The words of some texts, told apart by hash; what stands between two specials is cut as a text of its own."""

    def __init__(self, texts: list[bytes], special: bytes | None, hasher: WordHash) -> None:
        segments, owner = [], []
        for i, text in enumerate(texts):
            held = [text]
            if special is not None and special in text:
                held = [part for own in text.split(special) for part in (own, special)][:-1]
            segments += held
            owner += [i] * len(held)
        kind = np.int32 if sum(map(len, segments)) + len(segments) < 2**31 else np.int64
        counts, base, lo = np.zeros(len(texts), np.int64), 0, 0
        bufs, starts, sizes, hashes = [np.empty(0, np.uint8)], [np.empty(0, kind)], [np.empty(0, kind)], [np.empty(0, np.uint64)]
        while lo < len(segments):
            hi, size = lo + 1, len(segments[lo])
            while hi < len(segments) and size + len(segments[hi]) <= PIECE:
                size += len(segments[hi])
                hi += 1
            buf, start, end, segment = cut_bytes(segments[lo:hi])
            np.add.at(counts, owner[lo:hi], np.bincount(segment, minlength=hi - lo))
            hashes.append(hasher.spans(buf, start, end))
            bufs.append(buf)
            starts.append((start + base).astype(kind))
            sizes.append((end - start).astype(kind))
            base, lo = base + len(buf), hi
        self.buf, self.start, self.size = np.concatenate(bufs), np.concatenate(starts), np.concatenate(sizes)
        del bufs, starts, sizes
        self.known, self.local = numbered(np.concatenate(hashes))
        self.offset = np.concatenate([[0], np.cumsum(counts)])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The length of each distinct word in bytes, and the bytes of all, in the order of ``known``."""
        first = np.empty(len(self.known), np.int64)
        first[self.local[::-1]] = np.arange(len(self.local) - 1, -1, -1)
        start, size = self.start[first].astype(np.int64), self.size[first].astype(np.int64)
        return size.astype(np.int32), gathered(self.buf, start, size)


def _clean(text: bytes | None) -> bytes:
    """The text in valid UTF-8; null is empty."""
    if not text:
        return b""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def _strings(size: np.ndarray, flat: bytes) -> list[str]:
    ends = np.cumsum(size).tolist()
    return [flat[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch, bool]]:
    """(part, number in the part, rows, whether they end the slice) of portions of rows (part, text, ...)."""
    n = size = 0
    for whole in batches:
        for batch in portions(whole, 1):
            size += sum(len(t) for t in batch.column(1).to_pylist() if t)
            yield batch.column(0)[0].as_py(), n, batch, size >= SLICE
            if size >= SLICE:
                n, size = n + 1, 0


def _number(part: int, n: int) -> int:
    return (part << 24) + n


class Layout:
    """How many buckets a group of slices has, and the number of a slice's group, by the size of the files."""

    def __init__(self, size: int, parts: int) -> None:
        self.buckets = min(GROUP, max(1, size // SLICE))
        self.parts_in_group = max(1, GROUP * SLICE * parts // max(size, 1))

    def first_bucket(self, part: int) -> int:
        return part // self.parts_in_group * self.buckets


def word_requests(rows: DataFrame, layout: Layout, special: bytes | None) -> DataFrame:
    """(bucket, slice, data): the distinct words of each slice, by bucket."""
    edges = bounds(layout.buckets)

    def run(batches):
        hasher, texts = WordHash(), []
        last = None

        def asked(part: int, n: int) -> pa.RecordBatch:
            words = SliceWords(texts, special, hasher)
            size, flat = words.words()
            at = np.searchsorted(words.known, edges)
            begin = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            there = np.flatnonzero(at[1:] > at[:-1])
            data = [pack(size[at[b] : at[b + 1]], flat[begin[at[b]] : begin[at[b + 1]]]) for b in there.tolist()]
            return pa.record_batch([pa.array(there + layout.first_bucket(part)), pa.array(np.full(len(there), _number(part, n))), pa.array(data, pa.binary())], names=["bucket", "slice", "data"])

        for part, n, batch, ends in _slices(batches):
            texts += map(_clean, batch.column(1).to_pylist())
            last = part, n
            if ends:
                yield asked(*last)
                texts, last = [], None
        if last is not None:
            yield asked(*last)

    return rows.select("part", "text").mapInArrow(run, "bucket long, slice long, data binary")


def encode_distinct(requests: DataFrame, path: str, special: bool = True) -> DataFrame:
    """(slice, bucket, data): the ids of the words of each request; each distinct word of a bucket is encoded once."""

    def run(batches):
        hasher = WordHash()
        for (bucket,), held in met(batches, 1):
            numbers = [x for b in held for x in b.column(1).to_pylist()]
            parts = [unpack(x, np.int32, np.uint8) for b in held for x in b.column(2).to_pylist()]
            size, flat = np.concatenate([x[0] for x in parts]).astype(np.int64), np.concatenate([x[1] for x in parts])
            start = np.cumsum(size) - size
            known, local = numbered(hasher.spans(flat, start, start + size))
            first = np.empty(len(known), np.int64)
            first[local[::-1]] = np.arange(len(local) - 1, -1, -1)
            n_ids, ids = encode_words(_strings(size[first], gathered(flat, start[first], size[first]).tobytes()), path, special)
            begin, data, lo = np.cumsum(n_ids) - n_ids, [], 0
            for x in parts:
                own = local[lo : lo + len(x[0])]
                data.append(pack(n_ids[own].astype(np.int32), planes(gathered(ids, begin[own], n_ids[own]))))
                lo += len(own)
            yield pa.record_batch([pa.array(numbers), pa.array([bucket] * len(data)), pa.array(data, pa.binary())], names=["slice", "bucket", "data"])

    return dealt(requests, "bucket", ["bucket"]).mapInArrow(run, "slice long, bucket long, data binary")


def _encoded_rows(docs: DataFrame, path: str | None, key: str, text: str, special: bool, finish, fields: list[T.StructField]) -> DataFrame:
    """A row of ``key`` and the columns that ``finish(texts, path)`` gives for each portion of texts.

    ``texts`` are (bytes, ids, places of its words, ids as decimal text of each word), one by one.
    """
    path = path or default_path()
    cut = SPECIAL.encode() if special else None
    kind = docs.schema[key].dataType
    docs = settled(docs)
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(text).cast("binary").alias("text"), F.col(key).alias("key"))
    layout = Layout(input_bytes(docs), docs.rdd.getNumPartitions())
    edges = bounds(layout.buckets)

    def packed(batches):
        for part, n, batch, _ in _slices(batches):
            data = [squeezed(_clean(t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([pa.array(np.full(len(data), _number(part, n))), pa.array(np.full(len(data), 2**62)), batch.column(2), pa.array(data, pa.binary())], names=["slice", "bucket", "key", "data"])

    def lay(batches):
        hasher = WordHash()
        for (_,), held in met(batches, 1):
            words = start = ids = n_ids = None  # the last slice's go before the next one's come
            key_type = held[0].schema.field(2).type
            texts, keys, answers = [], [], []
            for batch in held:
                for bucket, k, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if bucket == 2**62:
                        keys.append(k)
                        texts.append(loosened(data))
                    else:
                        answers.append(unpack(data, np.int32, np.uint8))
            words = SliceWords(texts, cut, hasher)
            at = np.searchsorted(words.known, edges)
            expected = [n for n in np.diff(at).tolist() if n]
            if expected == [len(x[0]) for x in answers]:
                n_ids = np.concatenate([np.empty(0, np.int32), *(x[0] for x in answers)]).astype(np.int64)
                ids = np.concatenate([np.empty(0, np.int32), *(unplanes(x[1]) for x in answers)])
            else:
                size, flat = words.words()
                n_ids, ids = encode_words(_strings(size, flat.tobytes()), path, special)
            start = np.cumsum(n_ids) - n_ids
            for lo in range(0, len(texts), 256):
                out = []
                for i in range(lo, min(lo + 256, len(texts))):
                    own = words.local[words.offset[i] : words.offset[i + 1]]
                    mine = gathered(ids, start[own], n_ids[own])
                    if decode_ids(mine, path) != texts[i]:
                        again = SliceWords([texts[i]], cut, hasher)
                        every = [again.buf[a : a + n].tobytes().decode() for a, n in zip(again.start.tolist(), again.size.tolist(), strict=True)]
                        mine = encode_words(every, path, special)[1]
                    out.append(mine)
                yield pa.record_batch([pa.array(keys[lo : lo + 256], key_type), *finish(out, path)], names=[key, *(f.name for f in fields)])

    asked = encode_distinct(word_requests(rows, layout, cut), path, special)
    answers = asked.select("slice", "bucket", F.lit(None).cast(kind).alias("key"), "data")
    own = rows.mapInArrow(packed, T.StructType([T.StructField("slice", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("key", kind), T.StructField("data", T.BinaryType())]))
    return dealt(own.unionAll(answers), "slice", ["slice", "bucket"]).mapInArrow(lay, T.StructType([T.StructField(key, kind), *fields]))


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def encode(docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """One row per document: ``key`` and ids (array of int), as the tokenizers library gives them without added specials."""
    return _encoded_rows(docs, path, key, text, special, lambda ids, _: [_lists(ids)], [_IDS])


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_and_digest(docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``digest`` of ``decode`` of ``encode`` in one pass: each document's ids are joined with their pieces where they are laid together."""

    def finish(ids: list[np.ndarray], path: str) -> list[pa.Array]:
        columns = [
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([_sha256(",".join(map(str, x.tolist())).encode()) for x in ids], pa.string()),
            pa.array([_sha256(decode_ids(x, path).decode("utf-8", "replace").encode()) for x in ids], pa.string()),
        ]
        return columns + [_lists(ids)] * keep_ids

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *[_IDS] * keep_ids]
    return _encoded_rows(docs, path, key, text, True, finish, fields)


def decode(encoded: DataFrame, path: str | None = None, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``encoded`` with the column text: its ids joined with their pieces and read as UTF-8; null ids are none."""
    path, place = path or default_path(), encoded.columns.index(ids)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                out = [decode_ids(np.array(x or [], np.int64), path).decode("utf-8", "replace") for x in batch.column(place).to_pylist()]
                yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
