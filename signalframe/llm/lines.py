"""Line deduplication by winnowing over word hashes.

A gram is ``gram`` words in a row; of the grams that start at ``window`` words
in a row the one with the least hash is a fingerprint.  Words are compared as
they stand, the white space between them is not, so a passage is found wherever
it begins and ends, inside a line or sentence too.  Two texts that share a
passage of ``gram + window - 1`` words share a fingerprint inside it, and at most
``window - 1`` words of the passage stand before its first fingerprint or after
its last.

Spark counts the fingerprints of all documents, keeps those met more than once
(a Bloom filter of fixed size thins the rows before an exact join), and gives
each occurrence the first one, by document id and place.  A match is extended
both ways, word by word, while the words before and after agree with those of
the first occurrence, up to ``window - 1`` words: as far as the ends of the passage
or the next fingerprint.  Where the first occurrence of the outermost gram
stands in another text than the rest of the passage, it is that one the words
beside it are held against, so up to ``window - 1`` words may stay at an end.
Matches that overlap or touch form one run; runs of at least ``min_words`` words
are deleted, so the first occurrence stays.  With ``window`` up to ``gram`` the
matches inside a passage leave no gap, and a passage of ``min_words + 2 * (window
- 1)`` words (50 by default) is always cut.  A document sends each of its fingerprints once, however often it has it: what it repeats of
itself, and further places of a gram met elsewhere before, it knows alone.

Every row is a document of its own.  The first occurrence is that in the row with
the least id, null before all, and of rows with one id in the first as they are
read; the column name row__ is reserved.  Null and empty texts have no words and
are returned as they are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Bloom, WordHash, dropped, loosened, mix, portions, released, settled, squeezed, stored

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)
#: Bytes of text that are worked on at once: what is made of them stays in a core's cache.
PORTION = 1 << 18


class Words:
    """The words of some texts, one text after the other."""

    def __init__(self, texts: list[bytes | None], hasher: WordHash) -> None:
        buf = np.frombuffer(b"\n\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        sizes = np.array([len(t or b"") for t in texts], np.int64)
        self.buf, self.text_start = buf, np.cumsum(sizes + 2) - sizes - 2
        space = np.ones(len(buf) + 1, bool)
        space[1:] = (buf == 0x20) | ((buf >= 9) & (buf <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = hasher.spans(buf, self.start, self.end)
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        self.offset = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def lines(self) -> np.ndarray:
        """The number of lines with a word of each text: what stands between line breaks, and within those between the ends of sentences."""
        buf = self.buf
        cut = buf == 0x0A
        cut[1:] |= (buf[1:] == 0x20) & ((buf[:-1] == 0x2E) | (buf[:-1] == 0x21) | (buf[:-1] == 0x3F))
        line = np.cumsum(cut)[self.start]
        first = np.ones(len(line), bool)
        first[1:] = line[1:] != line[:-1]
        return np.bincount(self.text[first], minlength=len(self.text_start))

    def grams(self, gram: int) -> np.ndarray:
        """The hash of the gram that starts at each word; 2**64 - 1 where its text has no whole gram."""
        n, out, length, part, size = len(self.hash), None, 0, self.hash, 1
        while size <= gram and gram <= n:
            if gram & size:
                out = part if out is None else mix(out[: len(part) - length] * _ODD + part[length:])
                length += size
            part = mix(part[:-size] * _ODD + part[size:]) if len(part) > size else part[:0]
            size *= 2
        key = np.full(n, _NONE, np.uint64)
        if out is not None:
            there = self.text[: n - gram + 1] == self.text[gram - 1 :]
            key[: n - gram + 1][there] = out[: n - gram + 1][there]
        return key

    def fingerprints(self, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each fingerprint."""
        key = self.grams(gram)
        # room between texts, so that no window reaches over
        at = np.arange(len(key)) + self.text * window
        value = np.full(len(key) + len(self.text_start) * window + window, _NONE, np.uint64)
        word = np.zeros(len(value), np.int64)
        value[at], word[at] = key, np.arange(len(key))
        least, best, size = value, np.arange(len(value)), 1

        def lower(step: int) -> tuple[np.ndarray, np.ndarray]:
            """Of two windows, the second ``step`` on, the least value and its place, the left one of equals."""
            a, b = least[: len(least) - step], least[step:]
            return np.minimum(a, b), np.where(b < a, best[step:], best[: len(best) - step])

        while 2 * size <= window:
            least, best = lower(size)
            size *= 2
        if size < window:
            least, best = lower(window - size)
        whole = value[at + window - 1] != _NONE
        begins = np.zeros(len(at), bool)
        begins[self.offset[:-1][self.offset[:-1] < self.offset[1:]]] = True
        picked = best[at[(key != _NONE) & (whole | begins)]]  # ascending, as windows are
        new = np.ones(len(picked), bool)
        new[1:] = picked[1:] != picked[:-1]
        return word[picked[new]], value[picked[new]]

    def margins(self, first: np.ndarray, gram: int, reach: int) -> np.ndarray:
        """The hashes (24 bits as 3 bytes, 0 past the text) of ``reach`` words before and after each gram, outwards: as many as may stand between an end of a passage and a fingerprint."""
        steps = np.arange(reach)
        at = np.concatenate([first[:, None] - 1 - steps, first[:, None] + gram + steps], 1)
        own = self.text[first]
        ok = (at >= self.offset[own][:, None]) & (at < self.offset[own + 1][:, None])
        low = np.maximum(self.hash & np.uint64(0xFFFFFF), np.uint64(1)).astype("<u4")
        out = np.where(ok, low[np.where(ok, at, first[:, None])], np.uint32(0)).astype("<u4")
        return np.ascontiguousarray(out.view(np.uint8).reshape(len(first), 2 * reach, 4)[:, :, :3])


def _leaders(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each fingerprint the first of its text with the same value; both are in the order of places."""
    order = np.argsort(value, kind="stable")  # the places of equal values ascend, and so do their texts
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (value[order][1:] != value[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    return out


def _fingerprint_rows(docs: DataFrame, key: str, text: str, gram: int, window: int, only: Bloom | None) -> DataFrame:
    """The gram of each fingerprint of a document; with ``only``, (key, row__, gram, first, margins) of those that it lets through."""
    spark = docs.sparkSession
    shared = None if only is None else spark.sparkContext.broadcast(only)

    def run(batches):
        hasher = WordHash()
        for whole in batches:
            for batch in portions(whole, 2, size=PORTION):
                words = Words(batch.column(2).to_pylist(), hasher)
                first, value = words.fingerprints(gram, window)
                keep = _leaders(words.text[first], value) == np.arange(len(first))
                if shared is not None:
                    keep &= shared.value.has(value)
                first, value = first[keep], value[keep]
                if shared is None:
                    yield pa.record_batch([pa.array(value.view(np.int64))], names=["gram"])
                    continue
                own = pa.array(words.text[first])
                at = first - words.offset[words.text[first]]
                columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(value.view(np.int64)), pa.array(at.astype(np.int32))]
                columns.append(pa.array([m.tobytes() for m in words.margins(first, gram, window - 1)], pa.binary()))
                yield pa.record_batch(columns, names=["key", "row__", "gram", "first", "margins"])

    schema = "gram long" if only is None else f"key {docs.schema[key].dataType.simpleString()}, row__ long, gram long, first int, margins binary"
    return docs.select(F.col(key), "row__", F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


def find_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", gram: int = 16, window: int = 11) -> DataFrame:
    """(row__, matches): for each document (of ``docs`` with the column row__) its grams that came before elsewhere, with the margins of their first occurrence."""
    spark = docs.sparkSession
    repeated = _fingerprint_rows(docs, key, text, gram, window, None).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    filter_of_repeated = Bloom.over(repeated, "gram")
    del repeated
    released(spark)
    rows = stored(_fingerprint_rows(docs, key, text, gram, window, filter_of_repeated))
    # stored, so that both sides of the join come straight from their exchanges and hot grams can be split
    firsts = stored(
        rows.groupBy("gram")
        .agg(F.min(F.struct("key", "row__", "first", "margins")).alias("least"), F.count("*").alias("n"))
        .where("n > 1")
        .select("gram", F.col("least.row__").alias("first_row"), F.col("least.margins").alias("first_margins"))
    )
    places = stored(rows.select("row__", "gram"))
    dropped(rows)  # with the margins, which are the most of it
    later = places.join(firsts, "gram").where("row__ <> first_row")
    return later.groupBy("row__").agg(F.collect_set(F.struct("gram", F.col("first_margins").alias("margins"))).alias("matches"))


def _by_gram(matches: pa.ListArray) -> list[dict[int, bytes] | None]:
    """For each list of matches the margins by gram; null lists are None."""
    every, sizes = matches.flatten(), pc.list_value_length(matches).to_pylist()
    pairs = zip(every.field("gram").to_pylist(), every.field("margins").to_pylist(), strict=True)
    return [None if n is None else dict(itertools.islice(pairs, n)) for n in sizes]


def cut_repeats(texts: list[bytes | None], matches: list[dict[int, bytes] | None], gram: int, window: int, min_words: int, hasher: WordHash) -> list[tuple[bytes | None, int, int, int]]:
    """For each text: the text without its repeated runs, and the numbers of its lines, of runs deleted, and of words deleted.

    ``matches`` holds, for each text, the grams met elsewhere before, each with the margins of its first occurrence.
    """
    words, reach = Words(texts, hasher), window - 1
    first, value = words.fingerprints(gram, window)
    text = words.text[first]
    leader = _leaders(text, value)
    again = leader != np.arange(len(first))
    has = np.array([bool(m) for m in matches], bool)
    signed = value.view(np.int64)
    # of the grams of texts with matches, those that agree in 16 bits with one that any has
    mark = np.zeros(1 << 16, bool)
    for m in matches:
        if m:
            mark[np.fromiter(m, np.int64, len(m)) & 0xFFFF] = True
    at = np.flatnonzero(again | (has[text] & mark[signed & 0xFFFF]))
    theirs, kept, own_first = [], [], []
    for i, t, g in zip(at.tolist(), text[at].tolist(), signed[at].tolist(), strict=True):
        found = matches[t].get(g) if matches[t] else None
        if found is not None:
            theirs.append(found)
            kept.append(i)
        elif again[i]:
            own_first.append(len(kept))
            theirs.append(b"")
            kept.append(i)
    out = [(t, int(n), 0, 0) for t, n in zip(texts, words.lines(), strict=True)]
    if not kept:
        return out
    at, place = np.array(kept), np.array(own_first, np.int64)
    for i, m in zip(own_first, words.margins(first[leader[at[place]]], gram, reach), strict=True):
        theirs[i] = m.tobytes()
    own_margins = words.margins(first[at], gram, reach)
    same = (np.frombuffer(b"".join(theirs), np.uint8).reshape(own_margins.shape) == own_margins).all(2) & own_margins.any(2)
    left, right = np.cumprod(same[:, :reach], 1).sum(1), np.cumprod(same[:, reach:], 1).sum(1)
    runs: dict[int, list[list[int]]] = {}
    for a, b, t in sorted(zip((first[at] - left).tolist(), (first[at] + gram + right).tolist(), text[at].tolist(), strict=True)):
        own = runs.setdefault(t, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    for t, own in runs.items():
        data = texts[t]
        gone, deleted, count, base = np.zeros(len(data), bool), 0, 0, int(words.text_start[t])
        begin, stop = int(words.offset[t]), int(words.offset[t + 1])
        for a, b in own:
            if b - a >= min_words:
                # with the white space after it, or at the end of the text before it
                lo = int(words.start[a]) - base if b < stop else (int(words.end[a - 1]) - base if a > begin else 0)
                gone[lo : int(words.start[b]) - base if b < stop else len(data)] = True
                deleted += b - a
                count += 1
        if count:
            out[t] = (np.frombuffer(data, np.uint8)[~gone].tobytes(), out[t][1], count, deleted)
    return out


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", gram: int = 16, window: int = 11, min_words: int = 30, report: bool = False) -> DataFrame:
    """``docs`` with its own columns and its later repeated runs deleted; n_chars, where there, is counted anew.

    With ``report`` the columns are instead: key, text, n_lines, n_runs (deleted), n_words (deleted).
    """
    rows = settled(docs).withColumn("row__", F.monotonically_increasing_id())
    found = find_repeats(rows, key=key, text=text, gram=gram, window=window).withColumnRenamed("matches", "matches__")
    place, kinds = docs.columns.index(text), docs.schema
    names = docs.columns

    def squeeze(batches):
        """Texts are compressed on their way to their matches."""
        for whole in batches:
            for batch in portions(whole, place):
                new = pa.array([None if t is None else squeezed(t) for t in batch.column(place).to_pylist()], pa.binary())
                yield pa.record_batch([new if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    rows = rows.withColumn(text, F.col(text).cast("binary"))
    both = rows.mapInArrow(squeeze, rows.schema).join(found, "row__", "left").drop("row__")

    def run(batches):
        hasher = WordHash()
        for whole in batches:
            for batch in portions(whole, place, size=PORTION):
                held = _by_gram(batch.column(len(names)))
                done = cut_repeats([None if t is None else loosened(t) for t in batch.column(place).to_pylist()], held, gram, window, min_words, hasher)
                new = pa.array([x[0] for x in done], pa.binary()).cast(pa.string())
                if report:
                    yield pa.record_batch([batch.column(names.index(key)), new, *(pa.array([x[i] for x in done], pa.int64()) for i in (1, 2, 3))], names=[key, "text", "n_lines", "n_runs", "n_words"])
                else:
                    yield pa.record_batch([new if i == place else batch.column(i) for i in range(len(names))], names=names)

    if report:
        return both.mapInArrow(run, T.StructType([kinds[key], T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_runs", "n_words"))]))
    out = both.mapInArrow(run, kinds)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text).cast(kinds["n_chars"].dataType))
    return out
