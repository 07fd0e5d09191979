"""Domain tables, projected from the driver's tables by fixed rules: DataFrames here, the same rules in SQL in ``VIEWS``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.sources.tables import table

SEVERITIES = ("fatal", "high", "medium", "low", "info")

VIEWS = {
    "samples": """SELECT doc_id AS sample_id, source AS scope, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.png' AS path, sha256(text) AS sha,
      CAST(256 + (n_chars % 13) * 128 AS BIGINT) AS encoded_w, CAST(256 + (doc_id % 11) * 128 AS BIGINT) AS encoded_h,
      CASE WHEN doc_id % 7 = 0 THEN 0 ELSE CAST(256 + (n_chars % 13) * 128 AS BIGINT) END AS display_w, CAST(256 + (doc_id % 11) * 128 AS BIGINT) AS display_h,
      CASE WHEN n_chars < 20 THEN 'decode_error' WHEN doc_id % 97 = 0 THEN 'hard_reject' ELSE 'valid' END AS state, lang, n_chars FROM documents""",
    "areas": """SELECT *, coalesce(nullif(display_w, 0), encoded_w) AS w, coalesce(nullif(display_h, 0), encoded_h) AS h,
      coalesce(nullif(display_w, 0), encoded_w) * coalesce(nullif(display_h, 0), encoded_h) AS area FROM samples""",
    "scores": """SELECT doc_id, quality, toxic, CASE WHEN doc_id % 61 = 0 THEN NULL WHEN doc_id % 59 = 0 THEN 5.5 ELSE CAST(1 + quality * 3 + (doc_id % 5) * 0.25 AS DOUBLE) END AS aes,
      CASE WHEN doc_id % 31 = 0 THEN 'aes_old' ELSE 'aes_new' END AS aes_source, CAST(0.1 + 0.8 * toxic AS DOUBLE) AS ai, (doc_id % 1000) / 1000.0::DOUBLE AS wm FROM labels""",
    "evidence": """SELECT doc_id AS sample_id, 'text_length' AS code, 'metrics' AS source, CAST(n_chars AS DOUBLE) AS value, CAST(100 AS DOUBLE) AS threshold, CASE WHEN n_chars < 100 THEN 'medium' ELSE 'info' END AS severity, false AS review_only, 0 AS nth FROM documents
      UNION ALL SELECT doc_id, 'aesthetic', aes_source, aes, 3.0, CASE WHEN aes < 3.0 THEN 'high' ELSE 'info' END, false, 0 FROM scores
      UNION ALL SELECT doc_id, 'aesthetic', aes_source, aes + 0.25, 3.0, CASE WHEN aes + 0.25 < 3.0 THEN 'high' ELSE 'info' END, false, 1 FROM scores WHERE doc_id % 53 = 0
      UNION ALL SELECT doc_id, 'ai_generated', 'ai_head', ai, 0.5, CASE WHEN ai >= 0.5 THEN 'high' ELSE 'info' END, true, 0 FROM scores
      UNION ALL SELECT doc_id, 'watermark', 'wm_head', wm, 0.9, CASE WHEN wm >= 0.9 THEN 'medium' ELSE 'info' END, true, 0 FROM scores
      UNION ALL SELECT doc_id, 'style', 'style_head', CAST(60 + (doc_id * 7) % 41 AS DOUBLE), CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 92.07 END, CASE WHEN (doc_id * 7) % 41 < 10 THEN 'high' WHEN (doc_id * 7) % 41 < 20 THEN 'medium' ELSE 'info' END, false, 0 FROM documents
      UNION ALL SELECT doc_id, 'duplicate_exact', 'dup_head', CAST(n AS DOUBLE), NULL, 'info', true, 0 FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1""",
    "decision_log": """SELECT event_id AS decision_id, user_id % (SELECT count(*) FROM documents) AS sample_id, CASE event_id % 2 WHEN 0 THEN 'ai' ELSE 'style' END AS category,
      CASE event_id % 3 WHEN 0 THEN 'pending_review' WHEN 1 THEN 'approved_keep' ELSE 'approved_exclude' END AS decision, ts AS created_at FROM events""",
    "decisions": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, category ORDER BY created_at DESC, decision_id DESC) AS rn FROM decision_log) WHERE rn = 1""",
    "overlay": """SELECT sample_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY created_at DESC, decision_id DESC) AS rn FROM decision_log) WHERE rn = 1""",
    "task_events": """SELECT user_id AS task_id, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence,
      CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' ELSE 'done' END AS to_status, event_type FROM events""",
    "vectors": """SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings""",
    "dims": """SELECT vec_id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS d FROM vectors""",
    "centroids": """SELECT label, list(c / norm ORDER BY d) AS c FROM (SELECT label, d, c, sqrt(sum(c * c) OVER (PARTITION BY label)) AS norm FROM (SELECT label, d, avg(x) AS c FROM dims GROUP BY label, d)) GROUP BY label""",
    "members": """SELECT vec_id, label, list_dot_product(v, c) AS score FROM vectors JOIN centroids USING (label)""",
}


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document, as an image of made-up size."""
    d = table(spark, sf, "documents")
    w, h = (256 + (F.col("n_chars") % 13) * 128).cast("long"), (256 + (F.col("doc_id") % 11) * 128).cast("long")
    state = F.when(F.col("n_chars") < 20, "decode_error").when(F.col("doc_id") % 97 == 0, "hard_reject").otherwise("valid")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".png")))
    return d.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("scope"), path.alias("path"), F.sha2("text", 256).alias("sha"), w.alias("encoded_w"), h.alias("encoded_h"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(w).cast("long").alias("display_w"), h.alias("display_h"), state.alias("state"), "lang", "n_chars")


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """``samples`` with their shown width and height, where a zero falls back to the encoded one, and area."""
    s = samples(spark, sf)
    s = s.withColumns({"w": F.coalesce(F.nullif("display_w", F.lit(0)), "encoded_w"), "h": F.coalesce(F.nullif("display_h", F.lit(0)), "encoded_h")})
    return s.withColumn("area", F.col("w") * F.col("h"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    t, i = table(spark, sf, "labels"), F.col("doc_id")
    aes = F.when(i % 61 == 0, None).when(i % 59 == 0, 5.5).otherwise((1 + F.col("quality") * 3 + (i % 5) * 0.25).cast("double"))
    return t.select("doc_id", "quality", "toxic", aes.alias("aes"), F.when(i % 31 == 0, "aes_old").otherwise("aes_new").alias("aes_source"), (0.1 + 0.8 * F.col("toxic")).cast("double").alias("ai"), ((i % 1000) / 1000.0).alias("wm"))


def evidence_row(code: str, source: Column, value: Column, threshold: Column, severity: Column, review_only: bool, nth: int = 0) -> list[Column]:
    return [F.col("doc_id").alias("sample_id"), F.lit(code).alias("code"), source.alias("source"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), severity.alias("severity"), F.lit(review_only).alias("review_only"), F.lit(nth).alias("nth")]


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (sample, code, source) observation."""
    d, s = table(spark, sf, "documents"), scores(spark, sf)
    flag = lambda bad, level: F.when(bad, level).otherwise("info")
    aes, style = F.col("aes"), (F.col("doc_id") * 7) % 41
    digests = d.select("doc_id", F.sha2("text", 256).alias("sha"))  # texts are compared by digest, so that none is shuffled
    copies = digests.join(digests.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sha")
    parts = [
        d.select(*evidence_row("text_length", F.lit("metrics"), F.col("n_chars"), F.lit(100), flag(F.col("n_chars") < 100, "medium"), False)),
        s.select(*evidence_row("aesthetic", F.col("aes_source"), aes, F.lit(3.0), flag(aes < 3, "high"), False)),
        s.where("doc_id % 53 = 0").select(*evidence_row("aesthetic", F.col("aes_source"), aes + 0.25, F.lit(3.0), flag(aes + 0.25 < 3, "high"), False, 1)),
        s.select(*evidence_row("ai_generated", F.lit("ai_head"), F.col("ai"), F.lit(0.5), flag(F.col("ai") >= 0.5, "high"), True)),
        s.select(*evidence_row("watermark", F.lit("wm_head"), F.col("wm"), F.lit(0.9), flag(F.col("wm") >= 0.9, "medium"), True)),
        d.select(*evidence_row("style", F.lit("style_head"), 60 + style, F.when(F.col("doc_id") % 19 == 0, None).otherwise(92.07), F.when(style < 10, "high").when(style < 20, "medium").otherwise("info"), False)),
        copies.select(*evidence_row("duplicate_exact", F.lit("dup_head"), F.col("n"), F.lit(None), F.lit("info"), True)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def severity_rank(c: Column) -> Column:
    rank = F.lit(len(SEVERITIES))
    for i in reversed(range(len(SEVERITIES))):
        rank = F.when(c == SEVERITIES[i], i).otherwise(rank)
    return rank


def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    i = F.col("event_id")
    decision = F.when(i % 3 == 0, "pending_review").when(i % 3 == 1, "approved_keep").otherwise("approved_exclude")
    return e.join(F.broadcast(n)).select(i.alias("decision_id"), (F.col("user_id") % F.col("n_docs")).alias("sample_id"), F.when(i % 2 == 0, "ai").otherwise("style").alias("category"), decision.alias("decision"), F.col("ts").alias("created_at"))


def latest(df: DataFrame, *by: str) -> DataFrame:
    """The newest row of each key: one aggregate, combined before the shuffle, and no sort."""
    rest = [c for c in df.columns if c not in by]
    top = F.max_by(F.struct(*rest), F.struct("created_at", "decision_id")).alias("r")
    return df.groupBy(*by).agg(top).select(*by, "r.*")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return latest(decision_log(spark, sf), "sample_id", "category")


def overlay(spark: SparkSession, sf: str) -> DataFrame:
    """The newest decision of each sample over all categories."""
    return latest(decision_log(spark, sf), "sample_id").select("sample_id", "decision")


def task_events(spark: SparkSession, sf: str) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id") % 4
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("task_id"), "event_id", "ts", seq.alias("sequence"), F.when(i == 0, "queued").when(i == 1, "running").when(i == 2, "paused").otherwise("done").alias("to_status"), "event_type")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The unit mean vector of each label: per-dimension averages, then one small array for each label."""
    d = vectors(spark, sf).select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("c"))
    c = d.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("c"))
    return c.select("label", F.transform("c", lambda x: x / F.sqrt(dot(F.col("c"), F.col("c")))).alias("c"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).join(centroids(spark, sf), "label").select("vec_id", "label", dot(F.col("v"), F.col("c")).alias("score"))
