"""Trace operators over ``spans`` (see ``schemas.SPANS``).

Relations along the parent links are found by pointer doubling: in each round
every span looks up what the span it points at has found, and points twice as
far.  So a tree of depth d takes log2(d) joins on (trace, span), with no
closure of ancestor pairs and no trace gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import checked
from ..schemas import SPAN_KINDS
from ..storage import materialised

ERROR = 2
SERVER, CLIENT = 2, 3
RELATIONS = ("descendant", "ancestor", "child", "parent", "sibling")


def span_filter(
    *,
    trace_id: str | None = None,
    start_ns: int | None = None,
    end_ns: int | None = None,
    name: str | None = None,
    name_regex: str | None = None,
    kind: int | None = None,
    status_code: int | None = None,
    min_duration_ns: int | None = None,
    max_duration_ns: int | None = None,
    service: str | None = None,
    attributes: Sequence[Column] = (),
) -> Column:
    """A condition on spans.  Times overlap with both ends; a regular expression matches anywhere in the name."""
    out = F.lit(True)
    for given, condition in (
        (trace_id, lambda v: F.col("trace_id") == v),
        (start_ns, lambda v: F.col("end_ns") >= v),
        (end_ns, lambda v: F.col("start_ns") <= v),
        (name, lambda v: F.col("name") == v),
        (name_regex, lambda v: F.col("name").rlike(v)),
        (kind, lambda v: F.col("kind") == v),
        (status_code, lambda v: F.col("status_code") == v),
        (min_duration_ns, lambda v: F.col("duration_ns") >= v),
        (max_duration_ns, lambda v: F.col("duration_ns") <= v),
        (service, lambda v: F.element_at("resource", F.lit("service.name")) == v),
    ):
        if given is not None:
            out = out & condition(given)
    for a in attributes:
        out = out & a
    return out


def two_phase(spans: DataFrame, condition: Column) -> DataFrame:
    """All spans of the traces that have a span with ``condition``: a semi-join on the matching ids."""
    ids = spans.where(condition).select("trace_id").distinct()
    return spans.join(ids, "trace_id", "left_semi")


def assemble(spans: DataFrame) -> DataFrame:
    """One row per trace: start (of its first span), end (of its last), duration, number of spans, root name and service, first seq.

    The root is the first span without a parent, by (start, seq).
    """
    order = F.struct("start_ns", "seq")
    root = F.min_by(F.struct("name", "service_name", "span_id"), F.when(F.col("parent_span_id").isNull(), order))
    out = spans.groupBy("trace_id").agg(
        F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.count("*").alias("span_count"), root.alias("root"), F.min("seq").alias("first_seq"),
        F.count_if(F.col("status_code") == ERROR).alias("error_count"),
    )
    return out.select("trace_id", "start_ns", "end_ns", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), "span_count", "error_count", F.col("root.name").alias("root_name"), F.col("root.service_name").alias("root_service"), "first_seq")


def trace_filter(*, min_duration_ns: int | None = None, max_duration_ns: int | None = None, min_spans: int | None = None, max_spans: int | None = None, root_service: str | None = None, root_name: str | None = None, root_name_regex: str | None = None) -> Column:
    """A condition on the rows of ``assemble``."""
    out = F.lit(True)
    for given, condition in (
        (min_duration_ns, lambda v: F.col("duration_ns") >= v),
        (max_duration_ns, lambda v: F.col("duration_ns") <= v),
        (min_spans, lambda v: F.col("span_count") >= v),
        (max_spans, lambda v: F.col("span_count") <= v),
        (root_service, lambda v: F.coalesce(F.col("root_service") == v, F.lit(False))),
        (root_name, lambda v: F.coalesce(F.col("root_name") == v, F.lit(False))),
        (root_name_regex, lambda v: F.coalesce(F.col("root_name").rlike(v), F.lit(False))),
    ):
        if given is not None:
            out = out & condition(given)
    return out


def page(traces: DataFrame, sort_by: str = "start_ns", ascending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Sorted traces, equals in the order of their first spans, from ``offset`` on."""
    column = {"startTime": "start_ns", "duration": "duration_ns", "spanCount": "span_count"}.get(sort_by, sort_by)
    out = traces.orderBy(F.asc(column) if ascending else F.desc(column), "first_seq")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def _links(spans: DataFrame) -> DataFrame:
    """(trace, span, parent) with one row per span id, the last by seq; a parent that the trace lacks is none."""
    last = spans.groupBy("trace_id", "span_id").agg(F.max_by("parent_span_id", "seq").alias("parent"))
    known = last.select("trace_id", F.col("span_id").alias("parent"), F.lit(True).alias("there"))
    return last.join(known, ["trace_id", "parent"], "left").select("trace_id", "span_id", F.when(F.col("there"), F.col("parent")).alias("parent"))


def _doubled(state: DataFrame, columns: dict[str, Column], rounds: int = 40) -> DataFrame:
    """Pointer doubling until no span points anywhere, or only cycles are left.

    ``state`` has trace_id, span_id, up and the columns, each with the
    expression that joins it with ``far_<name>`` of the span pointed at.
    """
    state, left = materialised(state), None
    for _ in range(rounds):
        pointing = state.where("up is not null").count()
        if not pointing or pointing == left:
            break
        left = pointing
        far = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("far_up"), *[F.col(c).alias(f"far_{c}") for c in columns])
        both = state.join(far, ["trace_id", "up"], "left")
        state = materialised(both.select("trace_id", "span_id", F.col("far_up").alias("up"), *[F.when(F.col("up").isNull(), F.col(c)).otherwise(rule).alias(c) for c, rule in columns.items()]))
    return state


def depths(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth): the number of links up to a root; roots and orphans have 0."""
    state = _links(spans).select("trace_id", "span_id", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth"))
    out = _doubled(state, {"depth": F.col("depth") + F.coalesce("far_depth", F.lit(0))})
    return out.select("trace_id", "span_id", "depth")


def under(spans: DataFrame, condition: Column) -> DataFrame:
    """(trace_id, span_id, found): whether an ancestor of the span has ``condition``."""
    marked = spans.groupBy("trace_id", "span_id").agg(F.max(F.coalesce(condition, F.lit(False))).alias("own"))
    links = _links(spans)
    parents = marked.select("trace_id", F.col("span_id").alias("parent"), F.col("own").alias("above"))
    state = links.join(parents, ["trace_id", "parent"], "left").select("trace_id", "span_id", F.col("parent").alias("up"), F.coalesce("above", F.lit(False)).alias("found"))
    return _doubled(state, {"found": F.col("found") | F.coalesce("far_found", F.lit(False))}).select("trace_id", "span_id", "found")


def structural(spans: DataFrame, left: Column | str, relation: str, right: Column | str) -> DataFrame:
    """The ids of traces in which some b with ``right`` is the ``relation`` of another span a with ``left`` (b is a's descendant, ...)."""
    if relation not in RELATIONS:
        raise ValueError(f"a relation is one of {', '.join(RELATIONS)}")
    left, right = (F.expr(c) if isinstance(c, str) else c for c in (left, right))
    if relation in ("ancestor", "parent"):
        return structural(spans, right, {"ancestor": "descendant", "parent": "child"}[relation], left)
    if relation == "descendant":
        found = under(spans, left).where("found")
        return spans.where(right).join(found, ["trace_id", "span_id"], "left_semi").select("trace_id").distinct()
    a = spans.where(left).select("trace_id", F.col("span_id").alias("a"), F.col("parent_span_id").alias("a_parent"))
    b = spans.where(right).select("trace_id", F.col("span_id").alias("b"), F.col("parent_span_id").alias("b_parent"))
    if relation == "child":
        return b.join(a, (a.trace_id == b.trace_id) & (b.b_parent == a.a), "left_semi").select("trace_id").distinct()
    # siblings: the parents' groups that hold two different spans, one of either kind
    each = spans.where((F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))) & F.col("parent_span_id").isNotNull())
    is_a, is_b = F.coalesce(left, F.lit(False)), F.coalesce(right, F.lit(False))
    groups = each.groupBy("trace_id", "parent_span_id").agg(F.count_if(is_a).alias("a"), F.count_if(is_b).alias("b"), F.count_if(is_a & is_b).alias("both"))
    return groups.where("a > 0 and b > 0 and (a > 1 or b > 1 or both = 0)").select("trace_id").distinct()


def nested_sets(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, nested_left, nested_right, nested_parent): a depth-first numbering of each trace, roots and children by (start, seq).

    The numbering is sequential within a trace, so each trace is one task's.
    """

    def number(trace: pd.DataFrame) -> pd.DataFrame:
        trace = trace.sort_values("seq", kind="stable").drop_duplicates("span_id", keep="last").sort_values(["start_ns", "seq"], kind="stable")
        known = set(trace["span_id"])
        children: dict[str | None, list[str]] = {}
        for span, parent in zip(trace["span_id"], trace["parent_span_id"], strict=True):
            children.setdefault(parent if parent in known and parent != span else None, []).append(span)
        left, right, above, n = {}, {}, {}, 0
        stack = [(s, None, False) for s in reversed(children.get(None, []))]
        while stack:
            span, parent, done = stack.pop()
            n += 1
            if done:
                right[span] = n
                continue
            left[span], above[span] = n, left.get(parent, 0)
            stack.append((span, parent, True))
            stack += [(c, span, False) for c in reversed(children.get(span, []))]
        ids = list(right)
        return pd.DataFrame({"trace_id": trace["trace_id"].iloc[0], "span_id": ids, "nested_left": [left[i] for i in ids], "nested_right": [right[i] for i in ids], "nested_parent": [above[i] for i in ids]})

    schema = "trace_id string, span_id string, nested_left long, nested_right long, nested_parent long"
    return spans.select("trace_id", "span_id", "parent_span_id", "start_ns", "seq").groupBy("trace_id").applyInPandas(number, schema)


def is_ancestor(a: str = "a", b: str = "b") -> Column:
    """Whether the span with the columns <a>_left and <a>_right is above the one of b."""
    return (F.col(f"{a}_left") < F.col(f"{b}_left")) & (F.col(f"{b}_right") < F.col(f"{a}_right"))


def self_times(spans: DataFrame) -> DataFrame:
    """``spans`` with self_ns: the duration less the union of the children's times, cut to the span's own.

    Sorted by start, a child adds what lies past the furthest end before it.
    """
    parent = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("start_ns").alias("p_start"), F.col("end_ns").alias("p_end"))
    cut = spans.join(parent, ["trace_id", "parent_span_id"]).select("trace_id", "parent_span_id", F.greatest("start_ns", "p_start").alias("s"), F.least("end_ns", "p_end").alias("e"), "seq").where("e > s")
    before = F.max("e").over(W.partitionBy("trace_id", "parent_span_id").orderBy("s", "seq").rowsBetween(W.unboundedPreceding, -1))
    added = cut.select("trace_id", F.col("parent_span_id").alias("span_id"), F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(before, "s"))).alias("new"))
    covered = added.groupBy("trace_id", "span_id").agg(F.sum("new").alias("covered"))
    out = spans.join(covered, ["trace_id", "span_id"], "left")
    return out.withColumn("self_ns", F.greatest(F.lit(0), F.col("duration_ns") - F.coalesce("covered", F.lit(0)))).drop("covered")


def span_tree(spans: DataFrame) -> DataFrame:
    """``spans`` with depth and self_ns."""
    return self_times(spans).join(depths(spans), ["trace_id", "span_id"], "left")


def critical_path(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth) of each trace's critical path: the longest root, then of each span's children the one that ends last."""
    links = _links(spans)
    rows = spans.join(links.select("trace_id", "span_id", "parent"), ["trace_id", "span_id"])
    root_order = W.partitionBy("trace_id").orderBy(F.desc("duration_ns"), "start_ns", "seq")
    child_order = W.partitionBy("trace_id", "parent").orderBy(F.desc("end_ns"), "start_ns", "seq")
    best = rows.where("parent is null").withColumn("r", F.row_number().over(root_order)).unionByName(rows.where("parent is not null").withColumn("r", F.row_number().over(child_order)))
    state = best.select("trace_id", "span_id", F.col("parent").alias("up"), (F.col("r") == 1).alias("on_path"), F.col("parent").isNotNull().cast("long").alias("depth"))
    out = _doubled(state, {"on_path": F.col("on_path") & F.coalesce("far_on_path", F.lit(False)), "depth": F.col("depth") + F.coalesce("far_depth", F.lit(0))})
    return out.where("on_path").select("trace_id", "span_id", "depth")


def red_metrics(spans: DataFrame, bucket_ns: int = 60_000_000_000) -> DataFrame:
    """Rate, errors and durations of each span name and time bucket."""
    if bucket_ns <= 0:
        raise ValueError("a bucket is longer than 0")
    p = lambda f: F.expr(f"cast(percentile_disc({f}) WITHIN GROUP (ORDER BY duration_ns) as bigint)")
    return spans.groupBy(F.col("name"), (F.col("start_ns") - F.col("start_ns") % bucket_ns).alias("bucket_ns")).agg(
        F.count("*").alias("rate"), F.count_if(F.col("status_code") == ERROR).alias("errors"),
        (F.count_if(F.col("status_code") == ERROR) / F.count("*")).alias("error_rate"),
        F.min("duration_ns").alias("min_ns"), F.max("duration_ns").alias("max_ns"), F.sum("duration_ns").alias("sum_ns"),
        p(0.5).alias("p50_ns"), p(0.95).alias("p95_ns"), p(0.99).alias("p99_ns"),
    )


def service_of() -> Column:
    """The service of a span: of its resource, else of its attributes."""
    return F.coalesce(F.element_at("resource", F.lit("service.name")), F.element_at("attributes", F.lit("service.name")))


def service_graph(spans: DataFrame, service: Column | None = None) -> DataFrame:
    """Calls from client spans to the server spans below them, between different services."""
    s = spans.withColumn("svc", service if service is not None else service_of())
    client = s.where(F.col("kind") == CLIENT).select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("svc").alias("source"))
    server = s.where(F.col("kind") == SERVER).select("trace_id", "parent_span_id", F.col("svc").alias("target"), "status_code", "duration_ns")
    calls = server.join(client, ["trace_id", "parent_span_id"]).where("source <> '' and target <> '' and source <> target")
    return calls.groupBy("source", "target").agg(F.count("*").alias("calls"), F.count_if(F.col("status_code") == ERROR).alias("errors"), F.sum("duration_ns").alias("total_ns"))


AGGREGATES = {
    "count": lambda c: F.count(c), "avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum,
    **{p: (lambda c, f=f: F.expr(f"cast(percentile_disc({f}) WITHIN GROUP (ORDER BY `{c}`) as bigint)")) for p, f in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))},
}


def aggregate(rows: DataFrame, by: Sequence[str], fns: Sequence[tuple[str, str]]) -> DataFrame:
    """Groups of traces or spans with the aggregates (function, column), largest first; nothing to aggregate gives 0."""
    columns = [F.coalesce(AGGREGATES[f](c), F.lit(0)).alias(f"{f}_{c}") for f, c in fns]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("first_seq" if "first_seq" in rows.columns else "seq").alias("first"), *columns)
    return out.orderBy(F.desc("n"), "first").drop("first")


def time_windows(spans: DataFrame, padding_ns: int = 0) -> DataFrame:
    """(trace_id, from_ns, to_ns): when each trace was, with padding on both sides."""
    return spans.groupBy("trace_id").agg((F.min("start_ns") - padding_ns).alias("from_ns"), (F.max("end_ns") + padding_ns).alias("to_ns"))


def service_metrics(spans: DataFrame, buckets: int = 20) -> DataFrame:
    """Rate, errors and durations of each service in equal time buckets of the whole range (long form: one row per service and bucket met)."""
    bounds = spans.agg(F.min("start_ns").alias("lo"), F.max("start_ns").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1) / F.lit(float(buckets))
    rows = spans.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((F.col("start_ns") - F.col("lo")) / width)).cast("int"))
    p = lambda f: F.expr(f"cast(percentile_disc({f}) WITHIN GROUP (ORDER BY duration_ns) as bigint)")
    return rows.groupBy("service_name", "bucket").agg(F.count("*").alias("spans"), F.count_if(F.col("status_code") == ERROR).alias("errors"), F.avg("duration_ns").alias("avg_ns"), p(0.5).alias("p50_ns"), p(0.95).alias("p95_ns"), p(0.99).alias("p99_ns"))


def service_summary(spans: DataFrame) -> DataFrame:
    p = lambda f: F.expr(f"cast(percentile_disc({f}) WITHIN GROUP (ORDER BY duration_ns) as bigint)")
    return spans.groupBy("service_name").agg(
        F.count("*").alias("spans"), F.count_if(F.col("status_code") == ERROR).alias("errors"), (F.count_if(F.col("status_code") == ERROR) / F.count("*")).alias("error_rate"),
        F.avg("duration_ns").alias("avg_ns"), p(0.5).alias("p50_ns"), p(0.95).alias("p95_ns"), p(0.99).alias("p99_ns"), F.max("duration_ns").alias("max_ns"),
    )


def problematic_traces(spans: DataFrame, limit: int = 50) -> DataFrame:
    """Traces with errors, over a second, or with a span over one and a half times its service's p99; worst first."""
    p99 = spans.groupBy("service_name").agg(F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY duration_ns)").alias("p99"))
    rows = spans.join(p99.withColumnRenamed("service_name", "own_service"), F.col("service_name").eqNullSafe(F.col("own_service")), "left").drop("own_service")
    order = F.struct("seq")
    root = F.min_by(F.struct("name", "service_name", (F.col("end_ns") - F.col("start_ns")).alias("d")), F.when(F.col("parent_span_id").isNull(), order))
    t = rows.groupBy("trace_id").agg(
        F.count("*").alias("span_count"), F.count_if(F.col("status_code") == ERROR).alias("error_count"), F.max(F.col("duration_ns") > F.col("p99") * 1.5).alias("outlier"),
        root.alias("root"), F.max(F.col("end_ns") - F.col("start_ns")).alias("longest"), F.min("seq").alias("first"),
    )
    t = t.withColumn("duration_ns", F.coalesce("root.d", "longest"))
    slow = F.col("duration_ns") > 1_000_000_000
    t = t.where((F.col("error_count") > 0) | slow | F.col("outlier"))
    high = (F.col("error_count") > 3) | (F.col("duration_ns") > 5_000_000_000)
    out = t.select("trace_id", F.coalesce("root.service_name", F.lit("unknown")).alias("root_service"), F.coalesce("root.name", F.lit("unknown")).alias("root_name"), "span_count", "error_count", "duration_ns", "outlier", slow.alias("slow"), F.when(high, "high").otherwise("medium").alias("severity"), "first")
    # high sorts as medium's like, as a rank of 0 counts as unset
    return out.orderBy(F.when(F.col("severity") == "high", 2).otherwise(1), F.desc("error_count"), "first").limit(limit).drop("first")


def insights(summary: DataFrame) -> DataFrame:
    """(service_name, kind, severity) of what stands out in ``service_summary``."""
    kinds = F.array(
        F.when(F.col("error_rate") > 0.05, F.struct(F.lit("error_rate").alias("kind"), F.when(F.col("error_rate") > 0.15, "high").otherwise("medium").alias("severity"))),
        F.when(F.col("p99_ns") > 500_000_000, F.struct(F.lit("latency").alias("kind"), F.when(F.col("p99_ns") > 2_000_000_000, "high").otherwise("medium").alias("severity"))),
        F.when(F.col("p99_ns") > F.col("p50_ns") * 10, F.struct(F.lit("variance").alias("kind"), F.lit("medium").alias("severity"))),
    )
    return summary.select("service_name", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("x")).select("service_name", "x.kind", "x.severity")


def waterfall(spans: DataFrame) -> DataFrame:
    """Each trace's spans by start, with the offset from the trace's start and the depth."""
    start = F.min("start_ns").over(W.partitionBy("trace_id"))
    rows = spans.withColumn("offset_ns", F.col("start_ns") - start)
    return rows.join(depths(spans), ["trace_id", "span_id"], "left").select("trace_id", "span_id", "name", "offset_ns", "duration_ns", "depth", "status_code")


def lane_rows(frame: DataFrame) -> DataFrame:
    """Waterfall rows in milliseconds for a chart of lanes."""
    return frame.select("trace_id", "span_id", F.col("name").alias("label"), (F.col("offset_ns") / 1e6).alias("start_ms"), ((F.col("offset_ns") + F.col("duration_ns")) / 1e6).alias("end_ms"), "depth")


def span_number(field: str) -> Column:
    """A span's number by field: duration (ns), startTime (ms), or an attribute (with or without ``span.``) that reads as a number; null if none."""
    if field == "duration":
        return F.col("duration_ns").cast("double")
    if field == "startTime":
        return F.expr("start_ns div 1000000").cast("double")
    return F.element_at("attributes", F.lit(field.removeprefix("span."))).try_cast("double")


def span_group(field: str) -> Column:
    """A span's group by field: name, status, kind, or an attribute's text (``<missing>`` without it)."""
    if field == "name":
        return F.col("name")
    if field == "status":
        return F.when(F.col("status_code") == 0, "UNSET").when(F.col("status_code") == 1, "OK").otherwise("ERROR")
    if field == "kind":
        return F.coalesce(F.get(F.array(*map(F.lit, SPAN_KINDS)), F.col("kind")), F.lit("UNKNOWN"))
    return F.coalesce(F.element_at("attributes", F.lit(field.removeprefix("span."))), F.lit("<missing>"))


def trace_rows(spans: DataFrame) -> DataFrame:
    """(trace_id, spanCount, duration, rootService, rootName, first_seq): the fields by which traces are grouped and added up.

    The root is the first span without a parent; a trace without one is
    ``<no root>``, and as long as its longest span.
    """
    root = F.min_by(F.struct("name", service_of().alias("service"), "duration_ns"), F.when(F.col("parent_span_id").isNull(), F.col("seq")))
    t = spans.groupBy("trace_id").agg(F.count("*").alias("spanCount"), root.alias("root"), F.max("duration_ns").alias("longest"), F.min("seq").alias("first_seq"))
    service = F.when(F.col("root").isNull(), "<no root>").otherwise(F.coalesce(F.nullif("root.service", F.lit("")), F.lit("<unknown>")))
    return t.select("trace_id", "spanCount", F.coalesce("root.duration_ns", "longest").alias("duration"), service.alias("rootService"), F.coalesce("root.name", F.lit("<no root>")).alias("rootName"), "first_seq")


def trace_ids(spans: DataFrame) -> DataFrame:
    """The distinct trace ids."""
    return spans.where("trace_id is not null").select("trace_id").distinct()


def service_names(spans: DataFrame) -> DataFrame:
    """The distinct services."""
    return spans.select(service_of().alias("service_name")).where("service_name <> ''").distinct()


def lenient_filter(*, service: str | None = None, name: str | None = None, status_code: int | None = None, kind: int | None = None, min_ms: float = 0, max_ms: float = 0, attributes: Sequence[tuple[str, str, str]] = ()) -> Column:
    """The condition of the explorer's dialect: a name is a pattern without case, and != holds where the attribute is missing.

    The operators are =, !=, ~ (contains), > and <; an empty key or value is no
    condition, and -1 no status or kind.
    """
    out = F.lit(True)
    if service:
        out = out & F.coalesce(service_of() == service, F.lit(False))
    if name:
        out = out & F.col("name").rlike("(?i)" + checked(name))
    for column, wanted in (("status_code", status_code), ("kind", kind)):
        if wanted is not None and wanted != -1:
            out = out & (F.col(column) == wanted)
    if min_ms > 0:
        out = out & (F.col("duration_ns") >= round(min_ms * 1_000_000))
    if max_ms > 0:
        out = out & (F.col("duration_ns") <= round(max_ms * 1_000_000))
    for key, op, value in attributes:
        if not key or not value:
            continue
        v = F.element_at("attributes", F.lit(key))
        number = v.try_cast("double")
        holds = {"!=": v != value, "~": v.contains(value), ">": number > float(value) if op in "<>" else None, "<": number < float(value) if op in "<>" else None}.get(op, v == value)
        out = out & F.coalesce(holds, F.lit(op == "!="))
    return out
