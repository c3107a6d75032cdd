import pytest

from signalframe.operators import logs as ops
from signalframe.operators.drain import Drain, mine, reconstruct, slot_types, tokens_of
from signalframe.plans.log_query import LogQuery

SCHEMA = "time_ns bigint, severity_number int, body string, body_kind string, body_json string, resource map<string,string>, stream string, seq bigint"


@pytest.fixture(scope="module")
def logs(spark):
    rows = []
    for i in range(56):
        body, severity = (f"error processing request {i}", 17) if i % 7 == 0 else (f"user alice completed action {i}", 13) if i % 3 == 0 else (f"request {i} accepted by gateway", 9)
        rows.append((1000 + 100 * i, severity, body, "string", f'{{"a":{{"b":{i}}},"s":"{i}"}}', {"service.name": f"svc{i % 2}"}, f"s{i % 2}", i))
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_predicates(logs):
    count = lambda **k: LogQuery(**k).frame(logs).count()
    assert count(body_contains="error") == 8 and count(body_contains="") == 56 and count(body_contains="nothing") == 0
    assert count(from_ns=1000, to_ns=1200) == 2
    assert count(severity_gte=17) == 8
    assert count(body_equals=("a.b", 3)) == 1 and count(body_equals=("body.a.b", 3)) == 1 and count(body_equals=("a.b", "3")) == 0 and count(body_equals=("s", "3")) == 1
    assert count(resource={"service.name": "svc1"}) == 28 and count(resource={"none": "x"}) == 0
    first = LogQuery(limit=3).frame(logs).collect()
    assert [r.seq for r in first] == [0, 2, 4]  # stream by stream, not by time
    assert [r.seq for r in LogQuery(limit=2).iterate(logs)] == [0, 2]


def test_rollups(logs):
    assert {r.severity: r.n for r in ops.severity_distribution(logs).collect()} == {"TRACE": 0, "DEBUG": 0, "INFO": 32, "WARN": 16, "ERROR": 8, "FATAL": 0}
    top = ops.clusters(logs.where("severity_number >= 17"), 3, 16).collect()
    assert top[0].n == 8 and top[0].sample == "error processing request 0"
    assert ops.masked_templates(logs.selectExpr("'ip 10.0.0.1 took 12345 id deadbeef' as body", "body_kind", "seq")).first().pattern == "ip {ip} took {num} id {id}"


def test_drain():
    d = Drain()
    assert d.add("user 1 logged in") == (1, [], True)
    assert d.add("user 2 logged in") == (1, ["2"], False)
    assert d.templates == [["user", "<*>", "logged", "in"]]
    assert d.match("user 3 logged in") == (1, ["3"]) and d.match("something else") is None
    assert d.add("something quite different here")[2]
    assert reconstruct("user <*> logged in", ["9"]) == "user 9 logged in"
    assert tokens_of("\t a\xa0b  c ") == ["a", "b", "c"] and d.add("")[0] == 3 and d.add("")[0] == 3


def test_drain_by_stream_and_slots(spark):
    rows = [("s", f"user user_{i} logged in successfully", i) for i in range(60)] + [("t", f"took {i} ms", i) for i in range(60)] + [("t", None, 99)]
    mined = mine(spark.createDataFrame(rows, "stream string, body string, seq bigint"))
    got = {(r.stream, r.template) for r in mined.collect()}
    assert got == {("s", "user <*> logged in successfully"), ("t", "took <*> ms")}
    assert {(r.stream, r.kind) for r in slot_types(mined).collect()} == {("s", "prefixed_integer"), ("t", "integer")}


def test_mined_templates_are_those_of_plain_miners(spark):
    """Every stream as one miner of its own would have it, and all lines come back from template and variables."""
    import random

    from pyspark.sql import functions as F

    from signalframe.operators import drain

    r = random.Random(9)
    kinds = ["user {} logged in from {}", "job {} done", "cache miss for key {} in {} ms", "\t spaced   out {} \u00a0 line ", ""]
    rows = [(r.choice("abc"), i, r.choice(kinds).format(r.choice(["x", "17", "203"]), r.randrange(1000))) for i in range(600)]
    rows += [("b", 700, None), (None, 701, "alone 1"), (None, 702, "alone 2")]
    df = spark.createDataFrame(rows, "stream string, seq long, body string").orderBy(F.rand(1))
    got = {x.seq: x for x in drain.mine(df).collect()}
    for stream in ("a", "b", "c", None):
        plain, own = drain.Drain(), sorted((seq, body) for s, seq, body in rows if s == stream and body is not None)
        ids = {seq: plain.add(body)[0] for seq, body in own}
        for seq, body in own:
            template = " ".join(plain.templates[ids[seq] - 1])
            x = got[seq]
            assert (x.stream, x.template_id, x.template) == (stream, ids[seq], template)
            assert list(x.variables) == plain._variables(ids[seq] - 1, drain.tokens_of(body))
            assert drain.reconstruct(x.template, list(x.variables)) == " ".join(drain.tokens_of(body))
    assert len(got) == sum(b is not None for _, _, b in rows)
