import random

import pytest
from pyspark.sql import functions as F

from signalframe.operators import traces as ops
from signalframe.plans.trace_query import TraceQuery

SCHEMA = "trace_id string, span_id string, parent_span_id string, name string, kind int, start_ns bigint, end_ns bigint, duration_ns bigint, status_code int, attributes map<string,string>, resource map<string,string>, service_name string, seq bigint"
MS = 1_000_000


def span(trace, sid, parent, name, kind, start, length, status=1, attributes=None, service="svc", seq=0):
    return (trace, sid, parent, name, kind, start * MS, (start + length) * MS, length * MS, status, attributes or {}, {"service.name": service}, service, seq)


@pytest.fixture(scope="module")
def spans(spark):
    rows = [
        span("A", "root", None, "root-gateway", 2, 0, 100, service="gw", seq=1),
        span("A", "api", "root", "api-handler", 1, 5, 80, service="api", seq=2),
        span("A", "db", "api", "db.query", 3, 10, 30, 2, {"db.system": "postgresql"}, "api", 3),
        span("A", "cache", "api", "cache.lookup", 3, 45, 5, 1, {"cache.hit": "true"}, "api", 4),
        span("A", "auth", "root", "auth-check", 1, 1, 15, service="auth", seq=5),
        span("B", "c", None, "consumer-root", 5, 200, 50, service="worker", seq=6),
        span("B", "p", "c", "process-message", 1, 205, 40, service="worker", seq=7),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


NAME = lambda n: F.col("name") == n


@pytest.mark.parametrize(
    ("left", "relation", "right", "found"),
    [
        ("root-gateway", "descendant", "db.query", True),
        ("root-gateway", "child", "db.query", False),
        ("root-gateway", "child", "api-handler", True),
        ("db.query", "ancestor", "root-gateway", True),
        ("db.query", "parent", "api-handler", True),
        ("db.query", "sibling", "cache.lookup", True),
        ("db.query", "sibling", "auth-check", False),
        ("db.query", "sibling", "db.query", False),
        ("consumer-root", "descendant", "db.query", False),
    ],
)
def test_structural_relations(spans, left, relation, right, found):
    got = [r.trace_id for r in ops.structural(spans, NAME(left), relation, NAME(right)).collect()]
    assert got == (["A"] if found else [])


def test_search_is_two_phase_and_paged(spans):
    assert TraceQuery().status(2).spans(spans).count() == 5
    found = TraceQuery().frame(spans).collect()
    assert [(r.trace_id, r.span_count, r.root_name) for r in found] == [("B", 2, "consumer-root"), ("A", 5, "root-gateway")]
    assert [r.trace_id for r in TraceQuery().sort_by("duration").limit(1).frame(spans).collect()] == ["A"]
    assert [r.trace_id for r in TraceQuery().offset(1).frame(spans).collect()] == ["A"]
    assert TraceQuery().attribute("db.system", "neq", "mysql").frame(spans).count() == 1
    assert TraceQuery().missing_attribute("db.system").service("api").frame(spans).count() == 1
    assert TraceQuery().root_service("worker").frame(spans).first().trace_id == "B"
    with pytest.raises(ValueError):
        TraceQuery().sort_by("name")


def test_tree(spans):
    depth = {r.span_id: r.depth for r in ops.depths(spans).collect()}
    assert depth == {"root": 0, "api": 1, "db": 2, "cache": 2, "auth": 1, "c": 0, "p": 1}
    own = {r.span_id: r.self_ns // MS for r in ops.self_times(spans).collect()}
    assert own["root"] == 16 and own["api"] == 45 and own["db"] == 30
    path = [r.span_id for r in ops.critical_path(spans).where("trace_id = 'A'").orderBy("depth").collect()]
    assert path == ["root", "api", "cache"]


def test_nested_sets_agree_with_parents_on_random_forests(spark):
    rng, rows, above = random.Random(1), [], {}
    for t in range(6):
        for i in range(40):
            parent = None if i == 0 or rng.random() < 0.05 else f"s{rng.randrange(i)}"
            if rng.random() < 0.03:
                parent = "elsewhere"
            above[f"t{t}", f"s{i}"] = parent
            rows.append(span(f"t{t}", f"s{i}", parent, "n", 1, rng.randrange(1000), 5, seq=t * 100 + i))
    df = spark.createDataFrame(rows, SCHEMA)
    n = {(r.trace_id, r.span_id): r for r in ops.nested_sets(df).collect()}

    def chain(t, s):
        out = []
        while (s := above.get((t, s))) is not None and (t, s) in above:
            out.append(s)
        return out

    depth = {(r.trace_id, r.span_id): r.depth for r in ops.depths(df).collect()}
    for (t, s), r in n.items():
        ups = chain(t, s)
        assert depth[t, s] == len(ups)
        inside = [b for (u, b), x in n.items() if u == t and x.nested_left < r.nested_left and r.nested_right < x.nested_right]
        assert sorted(inside) == sorted(ups)


def test_cycles_end(spark):
    df = spark.createDataFrame([span("t", "a", "b", "n", 1, 0, 1), span("t", "b", "a", "n", 1, 0, 1), span("t", "r", None, "n", 1, 0, 1)], SCHEMA)
    assert ops.depths(df).where("span_id = 'r'").first().depth == 0


def test_red_and_graph(spark, spans):
    red = {r.name: r for r in ops.red_metrics(spans, 60_000 * MS).collect()}
    assert red["db.query"].errors == 1 and red["db.query"].error_rate == 1.0 and red["db.query"].p99_ns == 30 * MS
    rows = [span("t", "1", None, "call|x", 3, 0, 9, service="a"), span("t", "2", "1", "serve|x", 2, 1, 5, 2, service="b"), span("t", "3", "1", "self", 2, 1, 5, service="a")]
    graph = ops.service_graph(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.source, r.target, r.calls, r.errors, r.total_ns) for r in graph] == [("a", "b", 1, 1, 5 * MS)]
    with pytest.raises(ValueError):
        ops.red_metrics(spans, 0)
