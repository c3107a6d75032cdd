"""The text operators as registered queries: each over its whole table, with the columns that its contract fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, counts, decontaminate, jaccard, langid, lines, media, quality, urls
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("training", fold("doc_id", 7) != 2)
    scores = brown.fit_and_score(docs, "training")
    return scores.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_digest(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = langid.fit(docs.where(~held_out))
    # the text alone goes to the model; the fold is read off the id
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document, at places read off its id: 20 characters replaced, a beginning put before, 7 characters taken out."""
    docs = table(spark, sf_dir, "documents")

    def place(salt: str):
        return F.pmod(F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(salt)).cast("binary")), F.length(F.coalesce("text", F.lit(""))) + 1).cast("int")

    def edit(start, length: int, new: str):
        return F.struct(start.alias("start"), F.lit(length).alias("length"), F.lit(new).alias("new"))

    edits = F.array(edit(place("a"), 20, " an edited passage "), edit(F.lit(0), 0, "Preface. "), edit(place("b"), 7, ""))
    return counts.recount(docs.withColumn("edits", edits))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), report=True)
    return kept.select("doc_id", "n_lines", "n_runs", F.col("n_words").alias("n_words_deleted"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.read_back(media.store(table(spark, sf_dir, "documents"))))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 3) == 1
    model = quality.fit(docs, labels.where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_brown_lm": op1_brown_lm,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_media": op6_media,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_jaccard": op10_jaccard,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_RULES = ", ".join(str(r) for r in URL_RULES)

ORACLES = {
    "op7_url_filter": f"""
        WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
        cut AS (
            SELECT page_id, """ + _LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)") + """ AS host,
                   regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        fits AS (
            SELECT page_id, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS place
            FROM cut JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM cut LEFT JOIN (SELECT page_id, rule, verdict FROM fits WHERE place = 1) USING (page_id)
    """,
    "op8_decontaminate": f"""
        WITH items AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
        docs AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
        sizes AS (SELECT DISTINCT size FROM windows),
        cut AS (
            SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
        hits AS (SELECT doc_id, i, cut.size, item_id FROM cut JOIN windows USING (win) WHERE cut.size = windows.size),
        hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
        hit_items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
}
