"""Brown class-based bigram language model, learned by exchange clustering.

Tokens are the words of a text (A-Z folded, cut at white space) and one end, told
apart by 64-bit hashes.  Clustering has two steps.

1. The ``units`` most frequent words, the end, and ``tails`` groups of all other
   words (by their last three bytes) are the units.  Each round counts, in Spark, the transitions of
   every unit to and from the classes, over all training texts; the driver moves
   units one after the other to the class that raises the likelihood most.  Its
   matrices are units by classes: their size is set by parameters alone.  Half of
   the units may move in each round, as transitions between units that move
   together are known only after the next count; rounds go on, ``rounds`` at least,
   until two of them raise the likelihood by less than a thousandth (64 at most),
   and the best classes seen stay.
2. Every other training word leaves its group for the class that makes its own
   transitions, gathered from all training texts, likeliest, in Spark; and so again,
   ``turns`` times in all, with the classes of the words around it as they then are.
   As all of them choose at once, the shares of the classes are smoothed as they
   are in scoring: by the bare likelihood each alone would take an empty class.
   Words that are not met in training keep the class of their group.

A text's probability is the product of P(class | class before) * P(word |
class), both smoothed by adding one: an unseen word has the place that each
class keeps for one more word.  All counts cover every training text.

The texts are read once: each slice of them (``SLICE`` bytes or so) becomes a row of
a stored table with its distinct words and the places of its tokens.  What is told
of a word goes to the bucket of its hash and from there back to the slices that
have it, packed, so no text and no word is shuffled as such.

Null and empty texts are one end.  Without training texts every word is unseen.
Rows with equal keys are scored each on its own.  Words of equal count are taken
into the head in the order of their hashes; of equally good classes a word stays
in its own or takes the first.
"""

from __future__ import annotations

from itertools import count as counting

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, bounds, dealt, dropped, input_bytes, met, mix, numbered, pack, planes, portions, settled, spaced_spans, stored, unpack, unplanes

SLICE = 8 << 20
BUCKET = 16 << 20  # bytes of input for each bucket of words
_CHUNK = 1 << 15  # cells of a sum in one row


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(n: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes, from their transition counts."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(1)).sum() - _xlogx(n.sum(0)).sum())


def exchange(after: np.ndarray, before: np.ndarray, same: np.ndarray, classes: np.ndarray, movable: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """Move each movable unit to its best class; ``after`` and ``before`` hold units by classes, ``same`` a unit's transitions to itself, ``n`` the classes' transitions where other units have some too."""
    count = after.shape[1]
    classes = classes.copy()
    if n is None:
        n = np.zeros((count, count))
        np.add.at(n, classes, after)
    else:
        n = n.copy()
    every = np.arange(count)
    for u in movable:
        a, s = classes[u], same[u]
        r, l = after[u].astype(float), before[u].astype(float)
        if not r.any() and not l.any():
            continue
        n[a, :] -= r
        n[:, a] -= l
        n[a, a] += s
        r[a] -= s
        l[a] -= s
        np.maximum(n, 0, out=n)
        left, right = n.sum(1), n.sum(0)
        rs, ls = r.sum() + s, l.sum() + s
        # for each class b: row b gains r, column b gains l, and the corner both and s
        gain = (_xlogx(n + r) - _xlogx(n)).sum(1) + (_xlogx(n + l[:, None]) - _xlogx(n)).sum(0)
        corner = n[every, every]
        gain += _xlogx(corner + r + l + s) - _xlogx(corner + r) - _xlogx(corner + l) + _xlogx(corner)
        gain -= _xlogx(left + rs) - _xlogx(left) + _xlogx(right + ls) - _xlogx(right)
        b = int(np.argmax(gain + 1e-9 * (every == a)))
        classes[u] = b
        n[b, :] += r
        n[:, b] += l
        n[b, b] += s
    return classes


def favoured(after: np.ndarray, before: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each word that makes its transitions likeliest, all other words staying: by the smoothed shares of the classes after and before it, without what the word itself adds to its own class."""
    count, every = len(n), np.arange(len(own))
    after, before = after.astype(float), before.astype(float)
    left, right = n.sum(1), n.sum(0)
    value = after @ np.log((n + 1) / (left[:, None] + count)).T + before @ np.log((n.T + 1) / (right[:, None] + count)).T
    for mine, table, total in ((after, n, left), (before, n.T, right)):
        rest = np.maximum(table[own] - mine, 0) + 1
        value[every, own] -= (mine * (np.log((table[own] + 1) / (total[own] + count)[:, None]) - np.log(rest / (np.maximum(total[own] - mine.sum(1), 0) + count)[:, None]))).sum(1)
    return np.argmax(value + 1e-9 * (np.arange(count) == own[:, None]), 1)


class BrownModel:
    """What scoring needs besides the counts of words; its size is set by parameters."""

    def __init__(self, transitions: np.ndarray, class_count: np.ndarray, class_words: np.ndarray) -> None:
        smooth = transitions + 1.0
        self.log_step = np.log10(smooth / smooth.sum(1, keepdims=True))
        self.log_class = np.log10(class_count + class_words + 1.0)


def _blocks(docs: DataFrame, training: str, key: str, text: str, tails: int) -> DataFrame:
    """A row for each slice: its number, the keys of its texts, the number of tokens and the fold of each, its distinct words ascending (the end is 0), their groups and training counts, and the places of its tokens among them."""
    kind = docs.schema[key].dataType

    def run(batches):
        hasher = WordHash()
        keys, texts, learn, size, n = [], [], [], 0, 0
        part = key_type = None

        def block():
            buf, start, end, at = spaced_spans(texts)
            h = hasher.spans(buf, start, end)
            tokens = (np.diff(at) + 1).astype(np.int32)
            ends = np.cumsum(tokens)
            every = np.zeros(int(ends[-1]), np.uint64)
            word = np.ones(len(every), bool)
            word[ends - 1] = False
            every[word] = h
            known, local = numbered(every)
            fold = np.array(learn, np.uint8)
            counts = np.bincount(local[np.repeat(fold, tokens) > 0], minlength=len(known)).astype(np.int32)
            ending = sum(np.where(end - k >= start, buf[np.maximum(end - k, 0)], 0).astype(np.uint64) << np.uint64(8 * k) for k in (1, 2, 3))
            groups = np.zeros(len(known), np.uint16)
            groups[local[word]] = mix(ending) % np.uint64(tails)
            columns = [pa.array([(part << 24) + n], pa.int64()), pa.array([keys], pa.list_(key_type)), *(pa.array([x], pa.binary()) for x in (pack(tokens, fold), pack(known), pack(groups), pack(counts), pack(planes(local))))]
            return pa.record_batch(columns, names=["slice", "keys", "texts", "known", "groups", "counts", "seq"])

        for whole in batches:
            key_type = whole.schema.field(1).type
            for batch in portions(whole, 2):
                part = batch.column(0)[0].as_py()
                keys += batch.column(1).to_pylist()
                texts += batch.column(2).to_pylist()
                learn += [bool(x) for x in batch.column(3).to_pylist()]
                size += batch.column(2).nbytes
                if size >= SLICE:
                    yield block()
                    keys, texts, learn, size, n = [], [], [], 0, n + 1
        if texts:
            yield block()

    rows = docs.select(F.spark_partition_id().alias("part"), F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), F.col(training).alias("training"))
    return rows.mapInArrow(run, T.StructType([T.StructField("slice", T.LongType()), T.StructField("keys", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("texts", "known", "groups", "counts", "seq"))]))


def _answers(bucket: int, numbers: list[int], parts: list, values: np.ndarray, sums: bytes) -> pa.RecordBatch:
    """Rows (slice, bucket, data) of the values for each slice's part of a bucket, and one of the bucket's sums with slice -1."""
    ends = np.cumsum([len(x[0]) for x in parts]).tolist()
    data = [pack(values[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.record_batch([pa.array([*numbers, -1], pa.int64()), pa.array([bucket] * (len(data) + 1), pa.int64()), pa.array([*data, sums], pa.binary())], names=["slice", "bucket", "data"])


def _counted(blocks: DataFrame, buckets: int, units: int) -> DataFrame:
    """Rows (slice, bucket, data) with the training counts over all of a slice's words in a bucket; and, with slice -1, for each bucket its sums and most frequent words."""
    edges = bounds(buckets)

    def ask(batches):
        for batch in batches:
            for number, known, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                (known,), (counts,) = unpack(known, np.uint64), unpack(counts, np.int32)
                at = np.searchsorted(known, edges)
                there = np.flatnonzero(at[1:] > at[:-1])
                data = [pack(known[at[b] : at[b + 1]], counts[at[b] : at[b + 1]]) for b in there.tolist()]
                yield pa.record_batch([pa.array(there), pa.array(np.full(len(there), number)), pa.array(data, pa.binary())], names=["bucket", "slice", "data"])

    def answer(batches):
        for (bucket,), held in met(batches, 1):
            numbers = [x for b in held for x in b.column(1).to_pylist()]
            parts = [unpack(x, np.uint64, np.int32) for b in held for x in b.column(2).to_pylist()]
            known, local = numbered(np.concatenate([x[0] for x in parts]))
            n = np.zeros(len(known), np.int64)
            np.add.at(n, local, np.concatenate([x[1] for x in parts]))
            words = np.flatnonzero((known > 0) & (n > 0))
            words = words[np.argsort(-n[words], kind="stable")[:units]]
            yield _answers(bucket, numbers, parts, n[local], pack(np.array([n.sum(), (n > 0).sum()]), known[words], n[words]))

    asked = blocks.select("slice", "known", "counts").mapInArrow(ask, "bucket long, slice long, data binary")
    return dealt(asked, "bucket", ["bucket"]).mapInArrow(answer, "slice long, bucket long, data binary")


def _head(counted: DataFrame, units: int) -> tuple[np.ndarray, int, int]:
    """The hashes of the most frequent words, ascending; the number of tokens and of distinct ones."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                sums, words, n = unpack(data, np.int64, np.uint64, np.int64)
                yield pa.record_batch([pa.array([0]), pa.array([sums[0]]), pa.array([sums[1]])], names=["h", "n", "distinct"])
                yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n), pa.array(np.zeros(len(n), np.int64))], names=["h", "n", "distinct"])

    rows = counted.where("slice = -1").select("data").mapInArrow(run, "h long, n long, distinct long")
    total, distinct = rows.where("h = 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    found = rows.where("h <> 0").orderBy(F.desc("n"), "h").limit(units).select("h").toArrow()["h"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64)), total, distinct


def _units(known: np.ndarray, group: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The unit of each word: 0 for the end, 1 and on for the head, and then the groups of the others."""
    out = (len(head) + 1 + group.astype(np.int64)).astype(np.int32)
    if len(head):
        place = np.minimum(np.searchsorted(head, known), len(head) - 1)
        there = head[place] == known
        out[there] = place[there] + 1
    out[known == 0] = 0
    return out


def _trained(texts: bytes, seq: bytes) -> np.ndarray:
    """The places of the tokens of a slice's training texts."""
    tokens, fold = unpack(texts, np.int32, np.uint8)
    return unplanes(unpack(seq, np.uint8)[0])[np.repeat(fold, tokens) > 0]


def _streams(blocks: DataFrame, head: np.ndarray) -> DataFrame:
    """The units of the training tokens of each slice, in order."""
    shared = blocks.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        for batch in batches:
            for texts, known, groups, seq in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                unit = _units(unpack(known, np.uint64)[0], unpack(groups, np.uint16)[0], shared.value)
                yield pa.record_batch([pa.array([pack(planes(unit[_trained(texts, seq)]))], pa.binary())], names=["units"])

    return blocks.select("texts", "known", "groups", "seq").mapInArrow(run, "units binary")


def summed(rows: DataFrame, cells: int) -> np.ndarray:
    """The sum of the arrays (data: an array of long, packed) of each chunk of ``cells`` cells."""

    def run(batches):
        for (chunk,), held in met(batches, 1):
            total = np.zeros(_CHUNK, np.int64)
            for batch in held:
                for data in batch.column(1).to_pylist():
                    x = unplanes(unpack(data, np.uint8)[0], np.int64)
                    total[: len(x)] += x
            yield pa.record_batch([pa.array([chunk]), pa.array([pack(total)], pa.binary())], names=["chunk", "data"])

    out = np.zeros(-(-cells // _CHUNK) * _CHUNK, np.int64)
    for row in dealt(rows, "chunk", ["chunk"], -(-cells // _CHUNK)).mapInArrow(run, "chunk long, data binary").collect():
        (out[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK],) = unpack(bytes(row.data), np.int64)
    return out[:cells]


def _chunks(sums: np.ndarray):
    for chunk in range(0, len(sums), _CHUNK):
        yield pa.record_batch([pa.array([chunk // _CHUNK]), pa.array([pack(planes(sums[chunk : chunk + _CHUNK]))], pa.binary())], names=["chunk", "data"])


def unit_sums(streams: DataFrame, own: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transitions of each unit to the classes, from the classes, and to itself."""
    size = len(own)
    shared = streams.sparkSession.sparkContext.broadcast(own.astype(np.int32))

    def run(batches):
        own, after, before, same = shared.value, np.zeros(size * count, np.int64), np.zeros(size * count, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                b = unplanes(unpack(data, np.uint8)[0])
                if not len(b):
                    continue
                a = np.concatenate([np.zeros(1, np.int32), b[:-1]])  # a text begins after an end, unit 0
                c = own[b]
                after += np.bincount(a * np.int32(count) + c, minlength=size * count)
                before += np.bincount(b * np.int32(count) + np.concatenate([own[:1], c[:-1]]), minlength=size * count)
                same += np.bincount(a[a == b], minlength=size)
        yield from _chunks(np.concatenate([after, before, same]))

    sums = summed(streams.mapInArrow(run, "chunk long, data binary"), 2 * size * count + size)
    return sums[: size * count].reshape(size, count), sums[size * count : -size].reshape(size, count), sums[-size:]


def cluster(streams: DataFrame, size: int, count: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the transitions between classes."""
    own = np.arange(size) % count
    best, best_value, best_n, values = own, -np.inf, np.zeros((count, count)), []
    for turn in counting():
        after, before, same = unit_sums(streams, own, count)
        n = np.zeros((count, count))
        np.add.at(n, own, after)
        values.append(likelihood(n))
        if values[-1] > best_value:
            best, best_value, best_n = own, values[-1], n
        if turn >= rounds and (turn >= 64 or turn < 2 or values[-1] - values[-3] < 1e-3 * abs(values[-3])):
            return best, best_n
        order = np.argsort(-after.sum(1), kind="stable")
        own = exchange(after, before, same, own, order[(np.arange(size) + turn) % 2 == 0], n)


def _best_of_each(code: np.ndarray, word: np.ndarray, times: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The favoured class of each word from its transitions: ``code`` is a class after, or ``count`` and a class before; a word without any stays."""
    count, best = len(n), own.copy()
    order = np.argsort(word, kind="stable")
    edge = np.searchsorted(word[order], np.arange(0, len(own) + 4096, 4096))
    for i in range(len(edge) - 1):
        lo, some = i * 4096, order[edge[i] : edge[i + 1]]
        now = own[lo : lo + 4096]
        if len(some):
            sums = np.bincount((word[some] - lo) * 2 * count + code[some], times[some], len(now) * 2 * count).reshape(len(now), 2 * count)
            best[lo : lo + 4096] = np.where(sums.any(1), favoured(sums[:, :count], sums[:, count:], now, n), now)
    return best


def _moves(number: int, texts: bytes, known: bytes, seq: bytes, classes: np.ndarray, head: np.ndarray, count: int, edges: np.ndarray) -> pa.RecordBatch:
    """(bucket, slice, data): the words of a slice with their classes and, but for the head's, their transitions in training."""
    (known,) = unpack(known, np.uint64)
    b, width = _trained(texts, seq), 2 * count
    tail = _units(known, np.zeros(len(known), np.uint16), head) > len(head)
    a = np.concatenate([np.zeros(1, b.dtype), b])[: len(b)]  # the end is the first word of all
    of_a, of_b = tail[a], tail[b]
    entry = np.concatenate([a[of_a].astype(np.int64) * width + classes[b[of_a]], b[of_b].astype(np.int64) * width + count + classes[a[of_b]]])
    entry, times = np.unique(entry, return_counts=True)
    word = entry // width
    code, times, per_word = (entry % width).astype(np.uint16), times.astype(np.int32), np.bincount(word, minlength=len(known)).astype(np.int32)
    at = np.searchsorted(known, edges)
    cut = np.searchsorted(word, at)
    there = np.flatnonzero(at[1:] > at[:-1])
    data = [pack(known[at[k] : at[k + 1]], classes[at[k] : at[k + 1]], per_word[at[k] : at[k + 1]], planes(code[cut[k] : cut[k + 1]]), planes(times[cut[k] : cut[k + 1]])) for k in there.tolist()]
    return pa.record_batch([pa.array(there), pa.array(np.full(len(there), number)), pa.array(data, pa.binary())], names=["bucket", "slice", "data"])


def _chosen(blocks: DataFrame, head: np.ndarray, own: np.ndarray | None, n: np.ndarray, buckets: int) -> DataFrame:
    """Rows (slice, bucket, data) with the new classes of a slice's words in a bucket; and, with slice -1, the words of each class. ``own`` has the units' classes; without it the blocks have their words'."""
    count, edges = len(n), bounds(buckets)
    shared = blocks.sparkSession.sparkContext.broadcast((head, own, n))

    def ask(batches):
        head, own, _ = shared.value
        for batch in batches:
            for number, texts, known, seq, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = unpack(last, np.uint8)[0] if own is None else own[_units(unpack(known, np.uint64)[0], unpack(last, np.uint16)[0], head)].astype(np.uint8)
                yield _moves(number, texts, known, seq, now, head, count, edges)

    def answer(batches):
        _, _, n = shared.value
        for (bucket,), held in met(batches, 1):
            numbers = [x for b in held for x in b.column(1).to_pylist()]
            parts = [unpack(x, np.uint64, np.uint8, np.int32, np.uint8, np.uint8) for b in held for x in b.column(2).to_pylist()]
            known, local = numbered(np.concatenate([x[0] for x in parts]))
            own = np.empty(len(known), np.int64)
            own[local] = np.concatenate([x[1] for x in parts])
            word = np.repeat(local, np.concatenate([x[2] for x in parts])).astype(np.int64)
            code, times = (np.concatenate([unplanes(x[i], t) for x in parts]).astype(np.int64) for i, t in ((3, np.uint16), (4, np.int32)))
            best = _best_of_each(code, word, times, own, n).astype(np.uint8)
            in_training = np.zeros(len(known), bool)
            in_training[word] = True
            yield _answers(bucket, numbers, parts, best[local], pack(np.bincount(best[in_training], minlength=count)))

    asked = blocks.select("slice", "texts", "known", "seq", "classes" if own is None else "groups").mapInArrow(ask, "bucket long, slice long, data binary")
    return dealt(asked, "bucket", ["bucket"]).mapInArrow(answer, "slice long, bucket long, data binary")


def _answered(blocks: DataFrame, answers: list[DataFrame], *columns: str) -> DataFrame:
    """``columns`` of each block, after the answers for it: rows (slice, kind, bucket, data, ...) dealt by slice; kinds count from 0 and the block's own is last."""
    kinds = {c: blocks.schema[c].dataType for c in columns}
    rows = None
    for i, x in enumerate(answers):
        own = x.where("slice >= 0").select("slice", F.lit(i).alias("kind"), "bucket", "data", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()))
        rows = own if rows is None else rows.unionAll(own)
    rows = rows.unionAll(blocks.select("slice", F.lit(len(answers)).alias("kind"), F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data"), *columns))
    return dealt(rows, "slice", ["slice", "kind", "bucket"])


def _answer(table: pa.Table, which: int, kind: type) -> np.ndarray:
    """The values of an answer for all words of a block."""
    rows = zip(table.column(1).to_pylist(), table.column(3).to_pylist(), strict=True)
    return np.concatenate([np.zeros(0, kind), *(unpack(d, kind)[0] for k, d in rows if k == which)])


def _moved(blocks: DataFrame, chosen: DataFrame, count: int) -> DataFrame:
    """The blocks with the classes that their words have chosen, and the transitions between these in training."""

    def run(batches):
        for (number,), held in met(batches, 1):
            table = pa.Table.from_batches(held)
            texts, known, seq = (table.column(i)[-1].as_py() for i in (4, 5, 6))
            classes = _answer(table, 0, np.uint8)
            learn = classes[_trained(texts, seq)].astype(np.int64)
            before = np.concatenate([classes[:1], learn])[: len(learn)].astype(np.int64)
            sums = np.bincount(before * count + learn, minlength=count * count)
            columns = [pa.array([number]), *(pa.array([x], pa.binary()) for x in (texts, known, seq, pack(classes), pack(planes(sums))))]
            yield pa.record_batch(columns, names=["slice", "texts", "known", "seq", "classes", "sums"])

    return _answered(blocks, [chosen], "texts", "known", "seq").mapInArrow(run, "slice long, texts binary, known binary, seq binary, classes binary, sums binary")


def _matrix(rows: DataFrame, count: int) -> np.ndarray:
    """The sum of the transitions in the column sums."""
    return summed(rows.where("sums is not null").select(F.lit(0).cast("long").alias("chunk"), F.col("sums").alias("data")), count * count).reshape(count, count)


def _joined(blocks: DataFrame, counted: DataFrame, chosen: DataFrame, count: int) -> DataFrame:
    """Counts and classes laid by position: a row for each slice with the keys, the sums of each text and the classes of its tokens; and a row for each task with the transitions between classes in its training texts."""
    def run(batches):
        transitions = np.zeros(count * count, np.int64)
        key_type = None
        for (_,), held in met(batches, 1):
            table = pa.Table.from_batches(held)
            key_type = table.schema.field(4).type
            n, own = _answer(table, 0, np.int64), _answer(table, 1, np.uint8)
            tokens, fold = unpack(table.column(5)[-1].as_py(), np.int32, np.uint8)
            local = unplanes(unpack(table.column(6)[-1].as_py(), np.uint8)[0])
            classes, times = own[local], n[local]
            first = np.cumsum(tokens) - tokens
            logs = np.log10(times + 1.0)
            seen, plain = np.add.reduceat((times > 0).astype(np.int64), first), np.add.reduceat(logs, first)
            learn = classes[np.repeat(fold, tokens) > 0].astype(np.int64)
            if len(learn):
                transitions += np.bincount(np.concatenate([own[:1], learn[:-1]]).astype(np.int64) * count + learn, minlength=count * count)
            yield pa.record_batch([table.column(4).combine_chunks().slice(len(table) - 1, 1), pa.array([pack(tokens, seen, plain, classes)], pa.binary()), pa.nulls(1, pa.binary())], names=["keys", "data", "sums"])
        if key_type is not None:
            yield pa.record_batch([pa.nulls(1, key_type), pa.nulls(1, pa.binary()), pa.array([pack(planes(transitions))], pa.binary())], names=["keys", "data", "sums"])

    schema = T.StructType([blocks.schema["keys"], T.StructField("data", T.BinaryType()), T.StructField("sums", T.BinaryType())])
    return _answered(blocks, [counted, chosen], "keys", "texts", "seq").mapInArrow(run, schema)


def fit_and_score(docs: DataFrame, training: str, *, key: str = "doc_id", text: str = "text", units: int = 4096, tails: int = 1024, classes: int = 64, rounds: int = 8, turns: int = 2) -> DataFrame:
    """Learn from the rows whose boolean column ``training`` is true and score every row; ``classes`` is 127 at most.

    Returns ``key``, n_tokens, n_known (tokens met in training), train_tokens,
    base_score (add-one unigram, log10) and score (the class model, log10).
    """
    spark, docs = docs.sparkSession, settled(docs)
    buckets = max(1, input_bytes(docs) // BUCKET)
    blocks = stored(_blocks(docs, training, key, text, tails))
    counted = stored(_counted(blocks, buckets, units))
    head, total, distinct = _head(counted, units)
    size = 1 + len(head) + tails
    own, n = np.arange(size) % classes, np.zeros((classes, classes))
    if total:
        streams = stored(_streams(blocks, head))
        own, n = cluster(streams, size, classes, rounds)
        dropped(streams)
    chosen = stored(_chosen(blocks, head, own, n, buckets))
    for _ in range(turns - 1 if total else 0):
        moved = stored(_moved(blocks, chosen, classes))
        chosen = stored(_chosen(moved, head, None, _matrix(moved, classes), buckets))
        dropped(moved)
    joined = stored(_joined(blocks, counted, chosen, classes))

    def plain(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield from _chunks(unpack(data, np.int64)[0])

    class_words = summed(chosen.where("slice = -1").select("data").mapInArrow(plain, "chunk long, data binary"), classes)
    if total:
        class_words += np.bincount(own[: 1 + len(head)], minlength=classes)
    n = _matrix(joined, classes)
    shared = spark.sparkContext.broadcast(BrownModel(n, n.sum(0), class_words))
    end, each = int(own[0]), float(np.log10(total + distinct + 1))

    def score(batches):
        model = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, seen, logs, own = unpack(batch.column(1)[i].as_py(), np.int32, np.int64, np.float64, np.uint8)
                before = np.concatenate([np.array([end], np.uint8), own[:-1]])
                before[np.cumsum(tokens)[:-1]] = end
                steps = np.add.reduceat(model.log_step[before, own] - model.log_class[own], np.cumsum(tokens) - tokens)
                columns = [batch.column(0).slice(i, 1).flatten(), pa.array(tokens.astype(np.int64)), pa.array(seen), pa.array(logs - tokens * each), pa.array(steps + logs)]
                yield pa.record_batch(columns, names=[key, "n_tokens", "n_known", "base_score", "score"])

    kinds = [T.StructField(key, docs.schema[key].dataType), *(T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())))]
    return joined.where("keys is not null").select("keys", "data").mapInArrow(score, T.StructType(kinds)).withColumn("train_tokens", F.lit(total).cast("long"))
