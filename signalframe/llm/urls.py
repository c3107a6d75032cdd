"""URL filters by a sort-merge range join.

The host of a rule or page becomes a key of its labels in reverse order
(``example.org`` is ``org.example.``), so a host and its subdomains are one
interval of keys.  Pages are cut into ranges of (key, path, id), so even one
host with most of the pages is spread; a rule goes to every range that its
interval overlaps.  Each range is sorted by key and swept once with a stack of
the nested hosts that are open; the rules of a host are held by their paths.

A rule (host, path) fits its host and all subdomains where the page's path
starts with the rule's.  The longest rule, host and path together, wins; of
equally long ones that with the longer host; of equal rules ``block``.  A rule
without a host fits every page.  Pages without a fitting rule get ``default``.
A null url, or one without ``://``, has an empty host and path.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LAST = "\U0010ffff"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path of a url."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_UPPER), path[:stop]


def host_key(host: str) -> str:
    """The labels in reverse order, each with a dot after it; a subdomain's key starts with its domain's."""
    return ".".join(reversed(host.split("."))) + "." if host else ""


class Sweep:
    """The open hosts, innermost last, each with the verdicts of its paths by length."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, dict[int, dict[str, str]]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, host, {}))
        held = self.stack[-1][2].setdefault(len(path), {})
        if held.get(path) != "block":
            held[path] = verdict

    def page(self, key: str, path: str) -> tuple[str | None, str | None]:
        self._close(key)
        best: tuple[int, str, str] | None = None
        for _, host, paths in reversed(self.stack):
            for size in sorted(paths, reverse=True):
                verdict = paths[size].get(path[:size])
                if verdict is not None and (best is None or len(host) + size > best[0]):
                    best = (len(host) + size, host + path[:size], verdict)
                if verdict is not None:
                    break
        return (None, None) if best is None else best[1:]


def judge(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row per page: ``key``, host, path, rule (host and path of the winning rule, else null), verdict.

    ``rules`` has host, path and verdict (allow or block); rules with a null in
    any of them are left out.  The ranges' bounds are read off at most 20 pages
    a range, drawn by a hash; they decide where rows go, not what comes out.
    """
    spark = pages.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = pages.schema[key].dataType.simpleString()

    def place(host: str, path: str, page) -> str:
        return f"{host_key(host)}\0{path}\0{page}"

    drawn = pages.select(key, url).orderBy(F.xxhash64(F.col(key).cast("string"), F.col(url))).limit(20 * n).collect()
    at = sorted(place(*split_url(r[1]), r[0]) for r in drawn)
    bounds = [at[i * len(at) // n] for i in range(1, n)] if at else []

    schema = f"part int, sort string, kind int, `{key}` {kind}, host string, path string, verdict string"
    names = ["part", "sort", "kind", key, "host", "path", "verdict"]

    def page_rows(batches):
        for batch in batches:
            ids, cut = batch.column(0).to_pylist(), [split_url(u) for u in batch.column(1).to_pylist()]
            hosts, paths = [c[0] for c in cut], [c[1] for c in cut]
            parts = [bisect_right(bounds, place(h, p, i)) for h, p, i in zip(hosts, paths, ids, strict=True)]
            size = len(ids)
            yield pa.record_batch([pa.array(parts, pa.int32()), pa.array([host_key(h) for h in hosts], pa.string()), pa.array([1] * size, pa.int32()), batch.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.nulls(size, pa.string())], names=names)

    def rule_rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                host, path, verdict = (batch.column(j)[i].as_py() for j in range(3))
                k = host_key(host.translate(_UPPER))
                parts = list(range(bisect_right(bounds, k), bisect_right(bounds, k + _LAST) + 1))
                size = len(parts)
                yield pa.record_batch([pa.array(parts, pa.int32()), pa.array([k] * size, pa.string()), pa.array([0] * size, pa.int32()), pa.nulls(size, batch.column(3).type), pa.array([host.translate(_UPPER)] * size, pa.string()), pa.array([path] * size, pa.string()), pa.array([verdict] * size, pa.string())], names=names)

    events = pages.select(key, url).mapInArrow(page_rows, schema).unionByName(
        rules.select("host", "path", "verdict").dropna().withColumn("none", F.lit(None).cast(kind)).mapInArrow(rule_rows, schema)
    )

    def sweep(batches):
        open_rules = Sweep()
        for batch in batches:
            ids, kept = [], ([], [], [], [])
            sort, kinds, hosts, paths, verdicts = (batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6))
            for i, is_page in enumerate(kinds):
                if not is_page:
                    open_rules.rule(sort[i], hosts[i], paths[i], verdicts[i])
                    continue
                rule, verdict = open_rules.page(sort[i], paths[i])
                ids.append(i)
                for column, value in zip(kept, (hosts[i], paths[i], rule, verdict or default), strict=True):
                    column.append(value)
            yield pa.record_batch([batch.column(3).take(pa.array(ids, pa.int64())), *(pa.array(c, pa.string()) for c in kept)], names=[key, "host", "path", "rule", "verdict"])

    return events.repartitionById(n, F.col("part")).sortWithinPartitions("sort", "kind").mapInArrow(sweep, f"`{key}` {kind}, host string, path string, rule string, verdict string")
