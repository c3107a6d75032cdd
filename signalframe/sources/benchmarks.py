"""Readers of benchmark results: go and libtest text, hyperfine, pytest-benchmark and name/value/unit JSON, and stored runs.

Each parser takes rows (file, line) or (file, content) and gives points (file,
scenario, tags, metric, value, unit, direction).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialised
from ..operators.bench import MONITOR, SMALLER, infer_direction, metric_name

POINT = ["file", "scenario", "tags", "metric", "value", "unit", "direction"]
NO_TAGS = "cast(map() as map<string,string>)"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of text files, without carriage returns."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\r$", "").alias("line"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def stripped(line: str | Column) -> Column:
    """A line without the escape codes of terminals."""
    return F.regexp_replace(F.col(line) if isinstance(line, str) else line, "\u001b\\[[0-9;]*[A-Za-z]", "")


def parse_go(lines: DataFrame, lenient: bool = False) -> DataFrame:
    """``BenchmarkName-8  1000  12.5 ns/op  3 B/op``: the number after the dash is the tag procs, and (value, unit) pairs follow the count.

    Of pairs whose units give one name the last counts.  The lenient dialect
    names and directs units its own way and passes over terminal codes.
    """
    line = stripped("line") if lenient else F.col("line")
    rows = lines.select("file", F.monotonically_increasing_id().alias("at"), line.alias("line")).where(F.col("line").rlike(r"^Benchmark\S+\s+\d+\s+.+$"))
    full = F.regexp_extract("line", r"^(Benchmark\S+)", 1)
    procs = F.regexp_extract(full, r"-(\d+)$", 1)
    has = full.rlike(r"^.+?-\d+$")
    pieces = F.split(F.trim(F.regexp_extract("line", r"^Benchmark\S+\s+\d+\s+(.+)$", 1)), r"\s+")
    rows = rows.select("file", "at", F.when(has, F.regexp_replace(full, r"-\d+$", "")).otherwise(full).alias("scenario"), F.when(has, F.create_map(F.lit("procs"), procs)).otherwise(F.expr(NO_TAGS)).alias("tags"), pieces.alias("p"))
    pairs = rows.where("size(p) >= 2").select("file", "at", "scenario", "tags", "p", F.explode(F.expr("sequence(0, size(p) div 2 - 1)")).alias("i"))
    pairs = pairs.select("file", "at", "scenario", "tags", "i", F.expr("p[2 * i]").alias("text"), F.expr("p[2 * i + 1]").alias("unit"))
    number = F.regexp_extract("text", r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    points = pairs.select("file", "at", "scenario", "tags", "i", metric_name("unit", lenient).alias("metric"), number.alias("value"), "unit", infer_direction("unit", lenient).alias("direction")).where("value is not null")
    last = points.groupBy("file", "at", "scenario", "metric").agg(F.max_by(F.struct("tags", "value", "unit", "direction"), "i").alias("x"))
    return last.select("file", "scenario", F.col("x.tags").alias("tags"), "metric", "x.value", "x.unit", "x.direction")


def parse_rust(lines: DataFrame) -> DataFrame:
    """``test name ... bench:  1,234 ns/iter (+/- 56)``; always smaller is better."""
    pattern = r"^test\s+(\S+)\s+\.\.\.\s+bench:\s+([\d,]+)\s+(\S+)"
    line = F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))
    rows = lines.where(line.rlike(pattern))
    unit = F.regexp_extract(line, pattern, 3)
    value = F.regexp_replace(F.regexp_extract(line, pattern, 2), ",", "").try_cast("double")
    return rows.select("file", F.regexp_extract(line, pattern, 1).alias("scenario"), F.expr(NO_TAGS).alias("tags"), metric_name(unit).alias("metric"), value.alias("value"), unit.alias("unit"), F.lit(SMALLER).alias("direction"))


def _long(rows: DataFrame, metrics: list[tuple[str, str, str | None, str]]) -> DataFrame:
    """One row per metric (name, expression, unit, direction) of rows with file and scenario."""
    items = [F.struct(F.lit(n).alias("metric"), F.expr(e).cast("double").alias("value"), F.lit(u).cast("string").alias("unit"), F.lit(d).alias("direction")) for n, e, u, d in metrics]
    return rows.select("file", "scenario", F.expr(NO_TAGS).alias("tags"), F.explode(F.array(*items)).alias("m")).select("file", "scenario", "tags", "m.metric", "m.value", "m.unit", "m.direction").where("value is not null")


def parse_hyperfine(files: DataFrame) -> DataFrame:
    schema = "struct<results:array<struct<command:string,mean:double,stddev:double,median:double,min:double,max:double>>>"
    rows = files.select("file", F.explode(F.from_json("content", schema, {"mode": "FAILFAST"})["results"]).alias("r")).withColumn("scenario", F.col("r.command"))
    return _long(rows, [(m, f"r.{m}", "s", SMALLER) for m in ("mean", "stddev", "median", "min", "max")])


def parse_pytest(files: DataFrame) -> DataFrame:
    schema = "struct<benchmarks:array<struct<name:string,stats:struct<mean:double,median:double,min:double,max:double,stddev:double,ops:double,rounds:double>>>>"
    rows = files.select("file", F.explode(F.from_json("content", schema, {"mode": "FAILFAST"})["benchmarks"]).alias("r")).withColumn("scenario", F.col("r.name"))
    metrics = [(m, f"r.stats.{m}", "s", SMALLER) for m in ("mean", "median", "min", "max", "stddev")]
    return _long(rows, [*metrics, ("ops", "r.stats.ops", "ops/s", "bigger_is_better"), ("rounds", "r.stats.rounds", None, "bigger_is_better")])


def parse_named_values(files: DataFrame) -> DataFrame:
    """``[{"name", "value", "unit"}]``."""
    rows = files.select("file", F.explode(F.from_json("content", "array<struct<name:string,value:double,unit:string>>", {"mode": "FAILFAST"})).alias("r"))
    return rows.select("file", F.col("r.name").alias("scenario"), F.expr(NO_TAGS).alias("tags"), F.lit("value").alias("metric"), F.col("r.value").alias("value"), F.col("r.unit").alias("unit"), infer_direction(F.col("r.unit")).alias("direction"))


def detected(content: str | Column = "content") -> Column:
    """The format of a file: pytest, otlp, hyperfine, named, go or rust; null if none."""
    c = F.col(content) if isinstance(content, str) else content
    return (
        F.when(c.rlike(r'(?s)^\s*\{.*"benchmarks"\s*:\s*\['), "pytest")
        .when(c.rlike(r'(?s)^\s*\{.*"resourceMetrics"\s*:\s*\['), "otlp")
        .when(c.rlike(r'(?s)^\s*\{.*"results"\s*:\s*\['), "hyperfine")
        .when(c.rlike(r"(?s)^\s*\["), "named")
        .when(c.rlike(r"(?m)^Benchmark\S+\s+\d+"), "go")
        .when(c.rlike(r"(?m)^\s*test\s+\S+\s+\.\.\.\s+bench:"), "rust")
    )


def parse_any(files: DataFrame, format: str | None = None) -> DataFrame:
    """Points of files in any format, told by their content unless ``format`` names it."""
    kinds = files.withColumn("format", F.lit(format) if format else detected())
    lines = lambda k: kinds.where(F.col("format") == k).select("file", F.explode(F.split("content", "\r?\n")).alias("line"))
    whole = lambda k: kinds.where(F.col("format") == k)
    parts = [parse_go(lines("go")), parse_rust(lines("rust")), parse_hyperfine(whole("hyperfine")), parse_pytest(whole("pytest")), parse_named_values(whole("named"))]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, file, content) of stored runs: *.json, {run}/*.otlp.json, {run}/*.otlp.jsonl and *.otlp.jsonl.gz; a run's files share its id."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    name, folder = F.substring_index("file", "/", -1), F.element_at(F.split("file", "/"), -2)
    nested = name.rlike(r"\.otlp\.jsonl?(\.gz)?$")
    return rows.where(nested | name.rlike(r"\.json$")).select(F.when(nested, folder).otherwise(F.regexp_replace(name, r"\.json$", "")).alias("run_id"), "file", "content")


def merged_context(batches: DataFrame, fields: list[str]) -> DataFrame:
    """Each run's first value of each context field over its batches, by seq."""
    return batches.groupBy("run_id").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def monitor_points(points: DataFrame) -> DataFrame:
    """Monitors' points under their scenario prefix, in the role of diagnostics."""
    own = F.col("scenario").startswith(MONITOR) | F.col("metric").startswith(MONITOR)
    scenario = F.when(own & ~F.col("scenario").startswith(MONITOR), F.concat(F.lit(MONITOR), "scenario")).otherwise(F.col("scenario"))
    return points.withColumns({"scenario": scenario, "series": F.when(own, F.coalesce("series", "scenario")).otherwise(F.col("series")), "role": F.when(own, "diagnostic").otherwise(F.col("role"))})


def ci_runs(runs: DataFrame, workflows: list[str] | None = None, events: list[str] | None = None, conclusions: list[str] | None = None, since: str | None = None, max_runs: int | None = None) -> DataFrame:
    """CI runs (workflow, event, conclusion, created_at) to read: the newest that pass the filters, oldest first."""
    out = runs
    for column, wanted in (("workflow", workflows), ("event", events), ("conclusion", conclusions)):
        if wanted:
            out = out.where(F.col(column).isin(wanted))
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if max_runs is not None:
        out = out.orderBy(F.desc("created_at")).limit(max_runs)
    return out.orderBy("created_at")


def descendants(processes: DataFrame, root: int) -> DataFrame:
    """The processes (pid, ppid) below ``root``, itself included; cycles end."""
    links = materialised(processes.select(F.col("pid").cast("long"), F.col("ppid").cast("long")).distinct())
    found, n = processes.sparkSession.createDataFrame([(root,)], "pid long"), 1
    while True:
        found = materialised(links.join(found.withColumnRenamed("pid", "ppid"), "ppid").select("pid").union(found).distinct())
        before, n = n, found.count()
        if n == before:
            return processes.join(found, "pid", "left_semi")


def lenient_rust(lines: DataFrame) -> DataFrame:
    """``parse_rust`` of lines without terminal codes, with the lenient names of metrics."""
    out = parse_rust(lines.withColumn("line", stripped("line")))
    return out.withColumn("metric", metric_name("unit", lenient=True))


def lenient_hyperfine(files: DataFrame) -> DataFrame:
    """``parse_hyperfine`` that passes over results without a command and takes 0 for what is missing."""
    schema = "struct<results:array<struct<command:string,mean:double,stddev:double,median:double,min:double,max:double>>>"
    rows = files.select("file", F.explode(F.from_json("content", schema)["results"]).alias("r")).where("r.command <> ''").withColumn("scenario", F.col("r.command"))
    return _long(rows, [(m, f"coalesce(r.{m}, 0)", "s", SMALLER) for m in ("mean", "stddev", "median", "min", "max")])


def lenient_pytest(files: DataFrame) -> DataFrame:
    """``parse_pytest`` that passes over benchmarks without a name or statistics and takes 0 for what is missing."""
    schema = "struct<benchmarks:array<struct<name:string,stats:struct<mean:double,median:double,min:double,max:double,stddev:double,ops:double,rounds:double>>>>"
    rows = files.select("file", F.explode(F.from_json("content", schema)["benchmarks"]).alias("r")).where("r.name <> '' and r.stats is not null").withColumn("scenario", F.col("r.name"))
    metrics = [(m, f"coalesce(r.stats.{m}, 0)", "s", SMALLER) for m in ("mean", "median", "min", "max", "stddev")]
    return _long(rows, [*metrics, ("ops", "coalesce(r.stats.ops, 0)", "ops/s", "bigger_is_better"), ("rounds", "coalesce(r.stats.rounds, 0)", None, "bigger_is_better")])


def lenient_named_values(files: DataFrame) -> DataFrame:
    """``parse_named_values`` that passes over entries without a name, a number or a unit, and leaves unknown directions null."""
    rows = files.select("file", F.explode(F.from_json("content", "array<struct<name:string,value:double,unit:string>>")).alias("r")).where("r.name <> '' and r.value is not null and r.unit <> ''")
    return rows.select("file", F.col("r.name").alias("scenario"), F.expr(NO_TAGS).alias("tags"), F.lit("value").alias("metric"), F.col("r.value").alias("value"), F.col("r.unit").alias("unit"), infer_direction(F.col("r.unit"), lenient=True).alias("direction"))


def resolve_since(given: str | Column | None, cursor: str | Column | None, now: str | Column, lookback_hours: int) -> Column:
    """From when on runs are read: as given, else by the cursor, else some hours before now; what is not a time is passed over."""
    at = lambda x: F.lit(None).cast("timestamp") if x is None else F.try_to_timestamp(x if isinstance(x, Column) else F.lit(x))
    return F.coalesce(at(given), at(cursor), at(now) - F.expr(f"interval {lookback_hours} hours"))


def run_lines(runs: DataFrame, strict: bool = True) -> DataFrame:
    """(run_id, file, line_number, line) of ``read_runs``: the JSON lines of each file; a line that isn't JSON stops the query with its file and number, or has ``error`` where not ``strict``."""
    rows = runs.select("run_id", "file", F.posexplode(F.split("content", "\r?\n")).alias("at", "line")).where(F.trim("line") != "").withColumn("line_number", F.col("at") + 1).drop("at")
    bad = F.try_parse_json("line").isNull()
    text = F.concat(F.lit("not JSON: "), "file", F.lit(":"), F.col("line_number").cast("string"))
    if strict:
        return rows.withColumn("line", F.when(bad, F.raise_error(text).cast("string")).otherwise(F.col("line")))
    return rows.withColumn("error", F.when(bad, text))
