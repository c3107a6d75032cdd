"""Edit-aware token counts.

A document's pre-tokens (words, see ``pretokens``) lie in blocks, and a segment
tree over the blocks holds the sums of their tokens and characters.  An edit
walks down the tree to the words it touches, cuts and encodes anew only these
and the context up to the next cut that old and new text share, and updates the
sums on the way up.  ``build`` makes the trees of a table, which are kept; later
``apply_edits`` reads them, and encodes nothing but what the edits touch.

Strings of special tokens in a text are ordinary text here, so cuts depend on
nothing far away.  Offsets are characters; an edit past the end is clamped to
it, a negative start to 0.  Null and empty texts have no words; edits with a
null start are left out, a null length or replacement is 0 or empty.  Rows with
equal keys or texts have each their own tree.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pack, portions, stored, unpack
from .pretokens import default_path, encode_words, split_words

BLOCK = 64


class Counter:
    """Tokens of words; the table of words met is emptied when it is full."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        self.path, self.most, self.table = path, most, {}

    def of(self, words: list[str]) -> list[int]:
        missing = list({w for w in words if w not in self.table})
        if missing:
            if len(self.table) + len(missing) > self.most:
                self.table.clear()
                missing = list(set(words))
            self.table.update(zip(missing, encode_words(missing, self.path, False)[0].tolist(), strict=True))
        return [self.table[w] for w in words]


class CountTree:
    """The words of a text in blocks under a tree of (tokens, characters) sums.

    Of a tree that was stored, a block's words are cut out of the text when an edit
    comes to it, and nothing is encoded.
    """

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.recoded = counter, 0
        self._build(split_words(text, None))

    def _build(self, words: list[str], counts: list[int] | None = None) -> None:
        counts = self.counter.of(words) if counts is None else counts
        self.words = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)] or [[]]
        self.counts = [counts[i : i + BLOCK] for i in range(0, len(words), BLOCK)] or [[]]
        self.leaves = 1
        while self.leaves < len(self.words):
            self.leaves *= 2
        self.tokens, self.chars = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i in range(len(self.words)):
            self.tokens[self.leaves + i], self.chars[self.leaves + i] = sum(self.counts[i]), sum(map(len, self.words[i]))
        for node in range(self.leaves - 1, 0, -1):
            self._sum(node)

    @classmethod
    def loaded(cls, text: str, data: bytes, counter: Counter) -> CountTree:
        """The tree of ``dump``."""
        self = cls.__new__(cls)
        self.counter, self.recoded = counter, 0
        lengths, counts, sizes, tokens, chars = unpack(data, *(np.int32,) * 5)
        self.leaves, self.tokens, self.chars = len(tokens) // 2, tokens.tolist(), chars.tolist()
        ends = np.cumsum(sizes).tolist()
        starts = [0, *ends[:-1]]
        begin = np.concatenate([[0], np.cumsum(lengths)])
        self.words, self.counts = [None] * len(ends), [None] * len(ends)
        self._source = lambda b: ([text[i:j] for i, j in itertools.pairwise(begin[starts[b] : ends[b] + 1].tolist())], counts[starts[b] : ends[b]].tolist())
        return self

    def dump(self) -> tuple[str, bytes]:
        """The text, and the tree as bytes: lengths and tokens of the words, words of the blocks, and the sums of all nodes."""
        self._load(range(len(self.words)))
        lengths = [len(w) for b in self.words for w in b]
        return self.text(), pack(*(np.array(x, np.int32) for x in (lengths, [c for b in self.counts for c in b], [len(b) for b in self.words], self.tokens, self.chars)))

    def _load(self, blocks: range) -> None:
        for b in blocks:
            if self.words[b] is None:
                self.words[b], self.counts[b] = self._source(b)

    def _sum(self, node: int) -> None:
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        self._load(range(len(self.words)))
        return "".join(w for block in self.words for w in block)

    def _find(self, at: int) -> int:
        """The block of the character ``at``, or the last block."""
        node = 1
        while node < self.leaves:
            node *= 2
            if self.chars[node] <= at:
                at -= self.chars[node]
                node += 1
        return min(node - self.leaves, len(self.words) - 1)

    def _before(self, block: int) -> int:
        """The characters before a block: the sums of what stands left on the way up."""
        node, out = self.leaves + block, 0
        while node > 1:
            out += self.chars[node - 1] if node & 1 else 0
            node >>= 1
        return out

    def edit(self, start: int, length: int, new: str) -> None:
        """Put ``new`` in place of ``length`` characters from ``start`` on."""
        start = min(max(0, start), self.size)
        end = min(self.size, start + max(0, length))
        first, last = self._find(max(0, start - 1)), self._find(end)
        while True:
            self._load(range(first, last + 1))
            words = [w for block in self.words[first : last + 1] for w in block]
            # a word that ends before the edit keeps its cut, but for white space, whose cut depends on
            # where its run ends; the first other word is where cutting begins
            i, at = 0, self._before(first)
            while i < len(words) and at + len(words[i]) < start:
                at += len(words[i])
                i += 1
            while i and words[i - 1].isspace():
                i -= 1
                at -= len(words[i])
            if not i and first:
                first -= 1
                continue
            old = "".join(words[i:])
            changed = old[: start - at] + new + old[end - at :]
            whole = last == len(self.words) - 1
            # old cuts from the edit's end on, by the characters right of them
            cuts, right = {}, 0
            for j in range(len(words), i - 1, -1):
                if at + len(old) - right < end:
                    break
                cuts[right] = j
                right += len(words[j - 1]) if j > i else 0
            if not whole:
                cuts.pop(0, None)  # what follows may move this cut
            fresh, position = split_words(changed, None), 0
            fixed, join, keep = start - at + len(new), None, 0
            for keep in range(len(fresh) + 1):
                if position >= fixed and len(changed) - position in cuts:
                    join = cuts[len(changed) - position]
                    break
                position += len(fresh[keep]) if keep < len(fresh) else 0
            if join is not None:
                break
            last = min(len(self.words) - 1, 2 * last - first + 1)
        counts = [c for block in self.counts[first : last + 1] for c in block]
        counts[i:join], words[i:join] = self.counter.of(fresh[:keep]), fresh[:keep]
        self.recoded += keep
        if len(words) > 4 * BLOCK * (last - first + 1):
            self._load(range(len(self.words)))
            self.words[first : last + 1], self.counts[first : last + 1] = [words], [counts]
            self._build([w for b in self.words for w in b], [c for b in self.counts for c in b])
            return
        share = -(-len(words) // (last - first + 1)) or 1
        touched = set()
        for n, block in enumerate(range(first, last + 1)):
            self.words[block], self.counts[block] = words[n * share : (n + 1) * share], counts[n * share : (n + 1) * share]
            node = self.leaves + block
            self.tokens[node], self.chars[node] = sum(self.counts[block]), sum(map(len, self.words[block]))
            touched.add(node >> 1)
        while touched and self.leaves > 1:
            for node in touched:
                self._sum(node)
            touched = {node >> 1 for node in touched if node > 1}


def attach_edits(docs: DataFrame, edits: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``docs`` with a column edits: its edits (start, length, new) in the order of ``seq``; an edit applies to the text left by those before it."""
    held = edits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "new"))), lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["new"].alias("new"))).alias("edits"))
    return docs.join(held, key, "left")


def build(docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document to keep: ``key``, text (null: empty) and tree (bytes, see ``CountTree.dump``), with n_words and n_tokens."""
    path = path or default_path()
    kind = docs.schema[key].dataType

    def run(batches):
        counter = Counter(path)
        for whole in batches:
            for batch in portions(whole, 1, 128):
                trees = [CountTree(value or "", counter) for value in batch.column(1).to_pylist()]
                kept = [t.dump() for t in trees]
                columns = [pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.binary()), pa.array([sum(map(len, t.words)) for t in trees], pa.int64()), pa.array([t.total for t in trees], pa.int64())]
                yield pa.record_batch([batch.column(0), *columns], names=[key, "text", "tree", "n_words", "n_tokens"])

    fields = [T.StructField(key, kind), T.StructField("text", T.StringType()), T.StructField("tree", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return docs.select(key, text).mapInArrow(run, T.StructType(fields))


def apply_edits(trees: DataFrame, path: str | None = None, *, key: str = "doc_id", edits: str = "edits", keep: bool = True) -> DataFrame:
    """Kept trees (``build``) with their column of edits applied: ``key``, text and tree as they are then (with ``keep``), n_words and n_tokens before, n_edits, n_tokens_after, n_chars_after, n_recoded (words encoded).

    Only the words that an edit touches and the context up to the next common cut
    are encoded; the other words' tokens come from the kept tree.
    """
    path = path or default_path()
    kind = trees.schema[key].dataType
    names = ["n_words", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_recoded"]

    def run(batches):
        counter = Counter(path)
        for whole in batches:
            for batch in portions(whole, 1, 128):
                out, kept = [], []
                for value, data, words, before, todo in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                    tree, done = CountTree.loaded(value, data, counter), 0
                    for e in todo or []:
                        if e is not None and e["start"] is not None:
                            tree.edit(e["start"], e["length"] or 0, e["new"] or "")
                            done += 1
                    out.append((words, before, done, tree.total, tree.size, tree.recoded))
                    if keep:
                        kept.append(tree.dump())
                columns = [pa.array([x[0] for x in kept], pa.string()), pa.array([x[1] for x in kept], pa.binary())] if keep else []
                yield pa.record_batch([batch.column(0), *columns, *(pa.array(list(c), pa.int64()) for c in zip(*out, strict=True))], names=[key, *(["text", "tree"] if keep else []), *names])

    fields = [T.StructField(key, kind), *([T.StructField("text", T.StringType()), T.StructField("tree", T.BinaryType())] if keep else []), *(T.StructField(n, T.LongType()) for n in names)]
    return trees.select(key, "text", "tree", "n_words", "n_tokens", edits).mapInArrow(run, T.StructType(fields))


def recount(docs: DataFrame, path: str | None = None, *, key: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """One row per document: the columns of ``apply_edits`` over trees that are built and stored first.

    ``docs`` holds the edits of each row; rows with equal keys have their own trees
    and edits, so the edits are kept beside the trees.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.struct(F.col(key), F.col(edits)).alias("own"))
    trees = stored(build(rows, path, key="own").select("own", "text", "tree", "n_words", "n_tokens"))
    flat = trees.select(F.col("own")[key].alias(key), "text", "tree", "n_words", "n_tokens", F.col("own")[edits].alias("edits"))
    return apply_edits(flat, path, key=key, keep=False)
