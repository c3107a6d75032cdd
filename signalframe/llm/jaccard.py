"""N-gram Jaccard join: exact links of similarity 0.9 and more between shingle sets, by universe partition and pigeonhole.

A document's set is its distinct word shingles as 64-bit hashes (two sets are
told apart but for a hash collision, of chance 2**-64 a pair of shingles).
Documents with equal sets are one class, named by its least id.  For sets r and
s, similarity >= t means a symmetric difference of at most (1-t)/(1+t) * (r+s):
at most H in a band of sizes.  The band's scheme cuts the hash universe into
H + 1 segments, so two similar sets agree in a whole segment; each set is indexed
by its segments under its own band's scheme and, where smaller partners may lie
in the band below, under that one's too.

Allocation is by cost.  Most segments must match exactly (cost: one row).  An
empty segment would match every set of the band that has it empty, so it counts
nothing, and the segment to its right may differ by one element instead: it is
indexed with its one-deletion neighbourhood (cost: its size and one rows).  Sets
that both have the segment empty then still meet, as the sum of allowances
stays H + 1.  A signature that many sets have (a passage that stands in many
texts) costs as many rows; as a band has segments for its largest sets, most sets
have some to spare, and a set passes over its frequent signatures if it can spare
them all (see ``Bands.spare``).

Buckets of up to ``small`` sets give all their pairs.  A larger one pairs its
members with its least only, its leader; where some are not linked to it, all are
held against the member nearest to the leader, the centre, as well.  Two members
that neither joins are found by their differences from the centre: where a is not
linked, b shares more than about half of its difference with a, so only that
prefix of b's difference, the rarest elements first, meets a's, and only where
enough of both is left after the element they meet in.  No bucket is ever paired
with itself.

Pairs of small buckets and of prefixes are first held against parity sketches (a
pair whose sketches differ in more than H bits differs in more elements), then
all are verified on whole sets.  Components are joined by least labels with
pointer jumping, in Spark.

Null and empty texts have an empty set and link with nothing, as no pair of
equal empty sets is a link.  Rows with equal ids count as copies of one another
where their texts are the same; ids are taken to be unique otherwise, and null
ids are left out of joins (such rows are their own component, null).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, WordHash, bounds, dealt, input_bytes, loosened, met, mix, pack, planes, portions, released, settled, squeezed, stored, unpack, unplanes, word_hashes

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_SCHEME = np.uint64(1 << 8)  # the bit of a signature that holds the parity of its band, the last of the upper 56
_SALTS = 64
_WANTED = 1 << 14
SLICE = 8 << 20
BUCKET = 8 << 20  # bytes of input for each bucket of signatures


def shingles(hasher: WordHash, texts: list[bytes | None], size: int = 3) -> list[np.ndarray]:
    """The set of each text, ascending: its distinct shingles of ``size`` words; with fewer words the whole sequence."""
    h, at = word_hashes(hasher, texts)

    def hashed(first: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(first), n, np.uint64)
        for i in range(n):
            out = mix(out * _ODD[0] + h[first + i] * _ODD[i % 3] + np.uint64(i))
        return out

    whole = hashed(np.arange(max(0, len(h) - size + 1)), size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        else:
            out.append(hashed(np.array([a]), b - a) if b > a else np.empty(0, np.uint64))
    return out


class Bands:
    """The size bands and the number of segments of each; t = num / den."""

    def __init__(self, num: int = 9, den: int = 10, ratio: float = 1.5) -> None:
        self.num, self.den = num, den
        self.top = [2]  # sizes under it
        while self.top[-1] < 1 << 40:
            self.top.append(max(self.top[-1] + 1, int(self.top[-1] * ratio)))
        self.tops = np.array(self.top)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.tops, n, "right"))

    def errors(self, total: int) -> int:
        """The most elements in which two sets of ``total`` elements together may differ."""
        return total * (self.den - self.num) // (self.den + self.num)

    def segments(self, band: int) -> int:
        most = self.top[band] - 1
        return self.errors(most + most * self.den // self.num) + 1

    def spare(self, n: int, odd: int) -> int:
        """How many signatures of a set of ``n`` elements under the scheme of that parity may be passed over without losing a partner.

        Two sets that differ in D elements share at least (segments - D) signatures: a
        segment that is equal in both and not empty, or, of one that both have empty,
        the signature of its neighbour unless they differ there in two elements or more,
        each of which leaves one more segment equal.
        """
        band = self.of(n)
        if band & 1 == odd:
            return self.segments(band) - self.errors(n + n * self.den // self.num) - 1
        return self.segments(band - 1) - self.errors(n + self.top[band - 1] - 1) - 1

    def schemes(self, n: int) -> list[int]:
        """The bands under whose schemes a set of ``n`` elements is indexed."""
        band = self.of(n)
        least = -(-n * self.num // self.den)
        return [band, band - 1] if band and least < self.top[band - 1] else [band]


def signatures(x: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of an ascending set under its schemes; one bit of each tells the two schemes apart."""
    out = []
    spread = mix(x)
    for band in bands.schemes(len(x)):
        m = bands.segments(band)
        if m == 1:  # no error is allowed: equal sets only, which are one class
            continue
        own = []
        edges = np.searchsorted((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32), np.arange(m + 1))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(spread, dtype=np.uint64)])
        value = sums[edges[1:]] - sums[edges[:-1]]
        full = edges[1:] > edges[:-1]
        tag = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 40))
        own.append(mix(value[full] ^ tag[full]))
        for i in np.flatnonzero(~full).tolist():
            j = (i + 1) % m
            near = np.concatenate([value[j : j + 1], value[j] - spread[edges[j] : edges[j + 1]]])
            own.append(mix(near ^ mix(tag[i : i + 1] + np.uint64(1))))
        out.append((np.concatenate(own) & ~_SCHEME) | (np.uint64(band & 1) * _SCHEME))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def sketch(x: np.ndarray) -> bytes:
    """The parities of the numbers of elements in 2**k cells, at least as many cells as elements."""
    cells = 1 << max(6, (max(1, len(x)) - 1).bit_length())
    at = (mix(x ^ np.uint64(0x5555555555555555)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound on the symmetric difference of two sets, from their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, d1, d2, sketch) of each document; d1 and d2 are the set's 128-bit digest."""

    def run(batches):
        hasher = WordHash()
        for whole in batches:
            for batch in portions(whole, 1):
                sets = shingles(hasher, batch.column(1).to_pylist(), size)
                digests = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), "<i8").reshape(-1, 2)
                yield pa.record_batch([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.array([sketch(x) for x in sets], pa.binary())], names=["id", "n", "d1", "d2", "sketch"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, sketch binary")


def _repeated_signatures(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """(sig, id): the signatures that two rows or more have, each with its rows; copies within a slice count once.

    Each slice of the texts sends its signatures to the buckets of their ranges,
    packed; a bucket keeps those that it has more than once.  A signature is the
    upper 56 bits of its hash.
    """
    edges = bounds(max(1, input_bytes(docs) // BUCKET))

    def send(batches):
        hasher, found, ids, seen, read, n, part = WordHash(), [], [], set(), 0, 0, 0

        def sent() -> pa.RecordBatch:
            sig = np.concatenate(found)
            order = np.argsort(sig, kind="stable")
            sig, owner = sig[order], np.repeat(np.array(ids, np.int64), [len(x) for x in found])[order]
            at = np.searchsorted(sig, edges)
            there = np.flatnonzero(at[1:] > at[:-1])
            data = [pack(planes(np.diff(sig[at[b] : at[b + 1]] >> np.uint64(8), prepend=np.uint64(0))), planes(owner[at[b] : at[b + 1]])) for b in there.tolist()]
            return pa.record_batch([pa.array(there), pa.array(np.full(len(there), (part << 24) + n)), pa.array(data, pa.binary())], names=["bucket", "slice", "data"])

        for whole in batches:
            for batch in portions(whole, 1, 128):
                part, new, texts = batch.column(2)[0].as_py(), [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    digest = hashlib.blake2b(t or b"", digest_size=16).digest()
                    read += len(t or b"")
                    if i is not None and digest not in seen:  # a copy's class is known from its digest
                        seen.add(digest)
                        new.append(i)
                        texts.append(t)
                found += [signatures(x, bands) for x in shingles(hasher, texts, size)]
                ids += new
                if read >= SLICE:
                    yield sent()
                    found, ids, seen, read, n = [], [], set(), 0, n + 1
        if found:
            yield sent()

    def keep(batches):
        for _, held in met(batches, 1):
            parts = [unpack(x, np.uint8, np.uint8) for b in held for x in b.column(2).to_pylist()]
            sig = np.concatenate([np.cumsum(unplanes(x[0], np.uint64), dtype=np.uint64) for x in parts])
            order = np.argsort(sig, kind="stable")
            sig, owner = sig[order], np.concatenate([unplanes(x[1], np.int64) for x in parts])[order]
            same = sig[1:] == sig[:-1]
            kept = np.append(same, False) | np.insert(same, 0, False)
            yield pa.record_batch([pa.array(sig[kept].view(np.int64)), pa.array(owner[kept])], names=["sig", "id"])

    asked = docs.select("id", "text", F.spark_partition_id().alias("part")).mapInArrow(send, "bucket long, slice long, data binary")
    return dealt(asked, "bucket", ["bucket"]).mapInArrow(keep, "sig long, id long")


def _near(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out."""
    own = sets.select("id", "n", "sketch")
    both = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b")
    both = both.where((F.least("na", "nb") * bands.den >= F.greatest("na", "nb") * bands.num) & (F.col("na") > 0))

    def run(batches):
        for batch in batches:
            a, na, sa, b, nb, sb = (batch.column(c).to_pylist() for c in ("a", "na", "sa", "b", "nb", "sb"))
            keep = [least_difference(sa[i], sb[i]) <= bands.errors(na[i] + nb[i]) for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "na", "sa", "b", "nb", "sb").mapInArrow(run, "a long, b long")


def _compare(docs: DataFrame, pairs: DataFrame, size: int, bands: Bands, differences: bool) -> DataFrame:
    """Verify pairs (a, b) on their whole sets.

    Gives (a, b) of the links; with ``differences`` a row (a, b, linked, na, nb,
    lacked, gone) for each pair: what b has and a lacks, and the reverse.  The
    text of a goes to at most _SALTS places, each of which reads a share of its
    partners one by one.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.over(ids, "id", 23))

    def pack(batches):
        for batch in batches:
            here = batch.column(0).drop_null()
            if len(here) < batch.num_rows:
                batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(shared.value.has(here.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), pa.bool_()))
            yield pa.record_batch([batch.column(0), pa.array([squeezed(t or b"") for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "packed"])

    texts = docs.mapInArrow(pack, "id long, packed binary").dropDuplicates(["id"])
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(_SALTS)).cast("int").alias("salt"))
    heads = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "salt", "packed")
    members = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "salt", "packed")
    rows = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    schema = "a long, b long" + (", linked boolean, na long, nb long, lacked array<long>, gone array<long>" if differences else "")

    def run(batches):
        hasher, head = WordHash(), np.empty(0, np.uint64)
        for whole in batches:
            for batch in portions(whole, 3, 256, 1 << 19):
                out = []
                sets = shingles(hasher, [loosened(p) for p in batch.column(3).to_pylist()], size)
                for a, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True):
                    if b is None:
                        head = x
                        continue
                    common = np.intersect1d(head, x, assume_unique=True)
                    linked = bool(len(x)) and bands.den * len(common) >= bands.num * (len(head) + len(x) - len(common))
                    if differences:
                        out.append((a, b, linked, len(head), len(x), np.setdiff1d(x, head, assume_unique=True).view(np.int64), np.setdiff1d(head, x, assume_unique=True).view(np.int64)))
                    elif linked:
                        out.append((a, b))
                columns = list(zip(*out, strict=True)) if out else [()] * (7 if differences else 2)
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = ["a", "b", "linked", "na", "nb", "lacked", "gone"]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return rows.select("a", "b", "salt", "packed").mapInArrow(run, schema)


def prefix_size(n_difference: int, n_center: int, n_own: int, bands: Bands) -> int:
    """How many of b's difference elements, in any order, must be looked up to meet every link with a set that is not linked to the centre.

    With u = den + num and v = den - num, a pair links where u * d <= v * (na +
    nb) for the difference d; a is not linked to the centre, so u * |Da| > v *
    (na + nC).  Then 2 * u * |Da and Db| > u * |Db| + v * (nC - nb).
    """
    u, v = bands.den + bands.num, bands.den - bands.num
    shared = max(1, (u * n_difference + v * (n_center - n_own)) // (2 * u) + 1)
    return max(0, n_difference - shared + 1)


def _centred(compared: DataFrame, bands: Bands) -> DataFrame:
    """(leader, center, id, n, nc, linked, alone, difference) of the members of each large bucket that has members not linked to its leader, seen from its centre.

    The centre is the member nearest to the leader, if possible one linked to it;
    with the leader's own changes out of the way, few members are far from it.  The
    difference of a member from the centre is the symmetric difference of what
    each differs in from the leader, so no text is read again.  A member is alone
    if neither the centre nor, where these two are linked, the leader has it.
    """
    sizes = compared.select("a", "b", "linked", (F.size("lacked") + F.size("gone")).alias("d"))
    centers = sizes.groupBy("a").agg(F.min(F.struct(~F.col("linked"), "d", "b")).alias("m"), F.min("linked").alias("whole")).where("not whole")
    centers = centers.select("a", F.col("m.b").alias("center"))
    own = compared.select("a", F.col("b").alias("center"), F.col("linked").alias("joined"), F.col("nb").alias("nc"), F.concat("lacked", "gone").alias("from_leader"))
    centers = centers.join(own, ["a", "center"])
    rows = compared.select("a", "b", "linked", "nb", F.concat("lacked", "gone").alias("difference")).join(centers, "a").where("b <> center")

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                out = []
                for r in whole.slice(lo, 64).to_pylist():
                    x = np.setxor1d(np.array(r["difference"], np.int64), np.array(r["from_leader"], np.int64), assume_unique=True)
                    linked = (bands.den + bands.num) * len(x) <= (bands.den - bands.num) * (r["nb"] + r["nc"])
                    out.append((r["a"], r["center"], r["b"], r["nb"], r["nc"], linked, not linked and not (r["joined"] and r["linked"]), x))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["leader", "center", "id", "n", "nc", "linked", "alone", "difference"])

    schema = "leader long, center long, id long, n long, nc long, linked boolean, alone boolean, difference array<long>"
    return rows.select("a", "center", "b", "nb", "nc", "linked", "joined", "difference", "from_leader").mapInArrow(run, schema)


def _through_centers(centred: DataFrame, bands: Bands) -> DataFrame:
    """Candidate pairs (a, b) among the members of large buckets, of which one is alone."""
    # only what sets have that are alone can be met: where that is little, it goes to all members of the bucket
    alone = centred.where("alone").groupBy("leader").agg(F.sum(F.size("difference")).alias("size"))
    few = alone.where(F.col("size") <= _WANTED).select("leader")
    wanted = centred.where("alone").join(few, "leader", "left_semi").groupBy("leader").agg(F.array_distinct(F.flatten(F.collect_list("difference"))).alias("wanted"))
    own = ("leader", "id", "n", "nc", "alone", F.size("difference").alias("d"))
    rows = centred.join(wanted, "leader").select(*own, F.explode(F.array_intersect("difference", "wanted")).alias("element"))
    rows = rows.unionAll(centred.join(alone.where(F.col("size") > _WANTED), "leader", "left_semi").select(*own, F.explode("difference").alias("element")))
    # an element that no set has that is alone, or one set only, meets nothing
    shared = rows.groupBy("leader", "element").agg(F.count("*").alias("often"), F.bool_or("alone").alias("wanted")).where("wanted and often > 1").select("leader", "element", "often")
    held = rows.join(shared, ["leader", "element"]).groupBy("leader", "id").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("elements"), F.first("n").alias("n"), F.first("nc").alias("nc"), F.first("alone").alias("alone"), F.first("d").alias("d"))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                columns: list[list[np.ndarray]] = [[] for _ in range(7)]
                for r in whole.slice(lo, 64).to_pylist():
                    # the rarest elements first, those that no other set has before all
                    values = np.array([e["element"] for e in r["elements"]], np.int64)
                    rest = np.arange(len(values), 0, -1)
                    first = max(0, prefix_size(r["d"], r["nc"], r["n"], bands) - (r["d"] - len(values)))
                    for probe, k in ((True, first), (False, len(values) if r["alone"] else 0)):
                        for column, x in zip(columns, (values[:k], rest[:k], np.full(k, probe), *(np.full(k, v) for v in (r["leader"], r["id"], r["n"], r["d"]))), strict=True):
                            column.append(x)
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in columns], names=["element", "rest", "probe", "leader", "id", "n", "d"])

    rows = stored(held.select("leader", "id", "n", "nc", "alone", "d", "elements").mapInArrow(run, "element long, rest long, probe boolean, leader long, id long, n long, d long"))
    a = rows.where("not probe").select("leader", "element", *[F.col(c).alias(f"{c}_a") for c in ("id", "rest", "n", "d")])
    b = rows.where("probe").select("leader", "element", *[F.col(c).alias(f"{c}_b") for c in ("id", "rest", "n", "d")])
    # the first element that both have leaves room for as many more as a link must share
    u, v = bands.den + bands.num, bands.den - bands.num
    room = F.least("rest_a", "rest_b") * (2 * u) >= (F.col("d_a") + F.col("d_b")) * u - (F.col("n_a") + F.col("n_b")) * v
    pairs = a.join(b, ["leader", "element"]).where((F.col("id_a") != F.col("id_b")) & room)
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _allocated(rows: DataFrame, sets: DataFrame, bands: Bands, small: int) -> DataFrame:
    """(sig, id) of ``rows`` by cost: a set passes over the signatures that more than ``small`` sets have, as long as these are no more than it can spare.

    A linked pair is met if either of its sets has spared its frequent signatures,
    as then one that is not frequent is left among those that they share.  Sets
    with more frequent signatures than that keep them all.
    """
    frequent = rows.groupBy("sig").agg(F.count("*").alias("often")).where(F.col("often") > small).select("sig")
    odd = F.col("sig").bitwiseAND(1).cast("int").alias("odd")
    costly = stored(rows.join(frequent, "sig").select("sig", "id", odd))
    many = costly.groupBy("id", "odd").agg(F.count("*").alias("many")).join(sets.select("id", "n"), "id")

    def run(batches):
        for batch in batches:
            odd, many, n = (batch.column(i).to_pylist() for i in (1, 2, 3))
            keep = pa.array([m > bands.spare(k, o) for o, m, k in zip(odd, many, n, strict=True)], pa.bool_())
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["id", "odd"]).filter(keep)

    keeps = many.select("id", "odd", "many", "n").mapInArrow(run, "id long, odd int")
    held = costly.join(keeps, ["id", "odd"], "left_semi").select("sig", "id")
    return rows.join(costly.select("sig").distinct(), "sig", "left_anti").select("sig", "id").unionAll(held)


def links(docs: DataFrame, sets: DataFrame, *, size: int = 3, bands: Bands | None = None, small: int = 16) -> DataFrame:
    """(a, b), a < b: enough verified links between classes to join every component; ``docs`` has id and text (binary)."""
    bands = bands or Bands()
    spark = docs.sparkSession
    # by classes, not documents: copies of a set are one member
    classes = class_ids(sets)
    rows = stored(_repeated_signatures(docs, size, bands).join(classes, "id").select("sig", F.col("least").alias("id")).distinct())
    released(spark)
    rows = stored(_allocated(rows, sets, bands, small))
    buckets = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1")
    members = rows.join(buckets, "sig")
    few = members.where(F.col("n") <= small).groupBy("sig").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = stored(few.select(F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, small), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b").distinct())
    stars = stored(members.where((F.col("n") > small) & (F.col("id") > F.col("leader"))).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    del classes, buckets, members, few
    released(spark)
    compared = stored(_compare(docs, stars, size, bands, True))
    centred = stored(_centred(compared, bands))
    released(spark)
    rest = stored(_near(pairs.union(_through_centers(centred, bands)).distinct(), sets, bands))
    released(spark)
    known = compared.where("linked").select("a", "b").union(centred.where("linked").select(F.least("center", "id").alias("a"), F.greatest("center", "id").alias("b")))
    return stored(known.union(_compare(docs, rest, size, bands, False)).distinct())


def class_ids(sets: DataFrame) -> DataFrame:
    """(id, least): the least id of the documents with the same set; empty sets are each their own class."""
    least = sets.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("least"))
    own = sets.where("n > 0").select("id", "d1", "d2").distinct().join(least, ["d1", "d2"]).select("id", "least")
    return own.groupBy("id").agg(F.min("least").alias("least"))


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """(id, component): the least id reachable from each id of the edges (a, b), by least labels and pointer jumping."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label"))
    for _ in range(limit):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        # the label of the label as well
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        new = labels.join(near.withColumnRenamed("a", "id"), "id").join(jump, "label").select("id", F.least("label", "near", "jump").alias("new"), "label")
        new = stored(new)
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {limit} rounds")


def join_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id (the least ``key`` reachable by links, itself included).

    ``key`` is an integer column.  Two documents link where the similarity of
    their sets is num / den or more.
    """
    bands = Bands(num, den)
    rows = settled(docs).select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    sets = stored(_sets(rows, size))
    classes = stored(class_ids(sets))
    found = components(links(rows, sets, size=size, bands=bands))
    named = classes.join(found.select(F.col("id").alias("least"), "component"), "least", "left").select("id", F.coalesce("component", "least").alias("component"))
    out = sets.select("id", "n").join(named, "id", "left")
    kind = docs.schema[key].dataType
    return out.select(F.col("id").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").cast(kind).alias("component_id"))
