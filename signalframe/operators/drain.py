"""Log template mining: a fixed-depth tree over token counts and leading tokens, with clusters at its leaves (Drain).

What a line is given depends on the lines before it, so each stream is mined in
order by one task; streams run side by side.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialised

WILDCARD = "<*>"
_SPACE = re.compile("[\t-\r \xa0]+")


class Miner(Protocol):
    """What ``mine`` needs of a template extractor, of which it makes one for each stream: ``templates`` by id less 1, as tokens with wildcards."""

    templates: list[list[str]]

    def add(self, line: str) -> tuple[int, ...]:
        """The id of the line's template, from 1 on, first of what it returns."""


def tokens_of(line: str) -> list[str]:
    return [t for t in _SPACE.split(line) if t]


@dataclass
class _Leaf:
    below: dict[str, _Leaf] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)


class Drain:
    """Mines templates from lines.

    ``depth`` counts the root and the leaf, so depth 4 tells lines apart by
    their number of tokens and first token.  ``children`` bounds the branches
    of a node: beyond it tokens share the wildcard's branch.
    """

    def __init__(self, depth: int = 4, similarity: float = 0.4, children: int = 100, numbers_are_variable: bool = True) -> None:
        self.levels, self.similarity, self.children, self.numbers_are_variable = max(0, depth - 3), similarity, children, numbers_are_variable
        self.templates: list[list[str]] = []
        self.sizes: list[int] = []
        self.roots: dict[int, _Leaf] = {}

    def _leading(self, tokens: list[str]) -> list[str]:
        return tokens[: min(self.levels, max(0, len(tokens) - 1))]

    def _find(self, tokens: list[str]) -> int | None:
        node = self.roots.get(len(tokens))
        for token in self._leading(tokens):
            node = node and (node.below.get(token) or node.below.get(WILDCARD))
        if node is None:
            return None
        if not tokens:
            return node.clusters[0] if node.clusters else None
        best, score = None, (-1.0, -1)
        for i in node.clusters:
            template = self.templates[i]
            wild = template.count(WILDCARD)
            same = sum(a == b != WILDCARD for a, b in zip(template, tokens, strict=True))
            if (same / len(tokens), wild) > score:
                best, score = i, (same / len(tokens), wild)
        return best if score[0] >= self.similarity else None

    def _branch(self, node: _Leaf, token: str) -> _Leaf:
        """Where a new template goes on from ``node``; the last free branch is the wildcard's."""
        if token in node.below:
            return node.below[token]
        wild = WILDCARD in node.below
        if self.numbers_are_variable and any("0" <= c <= "9" for c in token):
            token = WILDCARD
        elif len(node.below) + (not wild) >= self.children:
            token = WILDCARD
        return node.below.setdefault(token, _Leaf())

    def match(self, line: str) -> tuple[int, list[str]] | None:
        """(template id, variables) of a line, without learning from it."""
        tokens = tokens_of(line)
        found = self._find(tokens)
        return None if found is None else (found + 1, self._variables(found, tokens))

    def add(self, line: str) -> tuple[int, list[str], bool]:
        """(template id, variables, whether the template is new); positions that differ become wildcards."""
        tokens = tokens_of(line)
        found = self._find(tokens)
        if found is None:
            self.restore(tokens, 1)
            return len(self.templates), [], True
        self.templates[found] = [a if a == b else WILDCARD for a, b in zip(self.templates[found], tokens, strict=True)]
        self.sizes[found] += 1
        return found + 1, self._variables(found, tokens), False

    def restore(self, template: list[str], size: int) -> None:
        """Put a template as the next one, below its leading tokens."""
        node = self.roots.setdefault(len(template), _Leaf())
        for token in self._leading(template):
            node = self._branch(node, token)
        node.clusters.append(len(self.templates))
        self.templates.append(list(template))
        self.sizes.append(size)

    def _variables(self, i: int, tokens: list[str]) -> list[str]:
        return [b for a, b in zip(self.templates[i], tokens, strict=True) if a == WILDCARD]


def reconstruct(template: str, variables: list[str]) -> str:
    """The line of a template and its variables, with single blanks."""
    left = iter(variables)
    return " ".join(next(left, "") if t == WILDCARD else t for t in template.split(" "))


def mine(logs: DataFrame, stream: str = "stream", miner: Callable[..., Miner] = Drain, **settings) -> DataFrame:
    """(stream, seq, template_id, template, variables): the final template of each line and the variables at its wildcards.

    Lines pass through one by one in order of their stream and seq, so a task holds
    the templates of one stream only; lines meet the templates as they are in the end
    afterwards.  ``miner`` makes the extractor of a stream from the settings.
    """
    kind = logs.schema[stream].dataType.simpleString()

    def run(batches):
        drain, last = None, None

        def ended():
            ids = list(range(1, len(drain.templates) + 1))
            return pa.record_batch([pa.array([last] * len(ids), stream_type), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array([" ".join(t) for t in drain.templates], pa.string())], names=names)

        names = [stream, "seq", "body", "template_id", "template"]
        for batch in batches:
            stream_type, ids, begin = batch.schema.field(0).type, [], 0
            streams = batch.column(0).to_pylist()
            for i, (own, body) in enumerate(zip(streams, batch.column(2).to_pylist(), strict=True)):
                if drain is None or own != last:
                    if drain is not None:
                        if i > begin:
                            yield pa.record_batch([*(c.slice(begin, i - begin) for c in batch.columns), pa.array(ids, pa.int32()), pa.nulls(i - begin, pa.string())], names=names)
                        yield ended()
                    drain, last, ids, begin = miner(**settings), own, [], i
                ids.append(drain.add(body)[0])
            if ids:
                yield pa.record_batch([*(c.slice(begin) for c in batch.columns), pa.array(ids, pa.int32()), pa.nulls(len(ids), pa.string())], names=names)
        if drain is not None:
            yield ended()

    rows = logs.where(F.col("body").isNotNull()).select(stream, F.col("seq").cast("long").alias("seq"), "body")
    mined = materialised(rows.repartition(stream).sortWithinPartitions(stream, "seq").mapInArrow(run, f"`{stream}` {kind}, seq long, body string, template_id int, template string"))
    templates = mined.where("seq is null").select(F.col(stream).alias("own_stream"), "template_id", "template")
    lines = mined.where("seq is not null").drop("template")
    both = lines.join(templates, (lines[stream].eqNullSafe(templates.own_stream)) & (lines.template_id == templates.template_id)).select(lines[stream], "seq", lines.template_id, "template", "body")
    words = F.filter(F.split("body", "[\\t-\\r \\u00a0]+"), lambda w: w != "")
    pairs = F.zip_with(F.split("template", " "), words, lambda t, w: F.when(t == WILDCARD, w))
    return both.select(stream, "seq", "template_id", "template", F.when(F.size(words) > 0, F.array_compact(pairs)).otherwise(F.array().cast("array<string>")).alias("variables"))


#: The kinds of a template's variables, the first that all values of a slot have.
SLOT_KINDS = (
    ("uuid", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("integer", "^-?(0|[1-9][0-9]{0,17})$"),
    ("timestamp", "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?Z?$"),
    ("prefixed_integer", "^[^0-9]+(0|[1-9][0-9]{0,17})$"),
    ("prefixed_uuid", "^.+[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
)


def slot_types(mined: DataFrame, stream: str = "stream", min_rows: int = 50) -> DataFrame:
    """The kind of each variable position of a template with enough rows; prefixed ones share one prefix."""
    slots = mined.select(stream, "template_id", F.posexplode("variables").alias("slot", "value"))
    checks = [F.bool_and(F.col("value").rlike(p)).alias(k) for k, p in SLOT_KINDS]
    prefixes = F.countDistinct(F.regexp_extract("value", "^([^0-9]*)", 1)).alias("prefixes")
    heads = F.countDistinct(F.regexp_extract("value", "^(.*)[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", 1)).alias("heads")
    out = slots.groupBy(stream, "template_id", "slot").agg(F.count("*").alias("n"), prefixes, heads, *checks).where(F.col("n") >= min_rows)
    kind = F.when(F.col("uuid"), "uuid").when(F.col("integer"), "integer").when(F.col("timestamp"), "timestamp").when(F.col("prefixed_integer") & (F.col("prefixes") == 1), "prefixed_integer").when(F.col("prefixed_uuid") & (F.col("heads") == 1), "prefixed_uuid").otherwise("string")
    return out.select(stream, "template_id", "slot", "n", kind.alias("kind"))
