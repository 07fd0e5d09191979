"""Coverage: style summaries, leaf statistics and the report over scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query
from quarrykit.plans.domain import evidence, samples
from quarrykit.sources.tables import table

S = SparkSession


def n_rows() -> Column:
    return F.count(F.lit(1))


STYLE_LOG_SQL = """style_log AS (SELECT sample_id, n.nth, CASE WHEN n.nth = 0 THEN 'v1' ELSE 'v2' END AS version, CASE WHEN sample_id % 59 = 0 THEN 'nan'::DOUBLE WHEN sample_id % 61 = 0 THEN NULL ELSE value - n.nth END AS value, n.nth = 0 AND sample_id % 3 = 0 AS review_only
  FROM evidence, (VALUES (0), (1)) n(nth) WHERE code = 'style' AND (n.nth = 0 OR sample_id % 17 <> 0)), style_latest AS (SELECT sample_id, max_by(version, nth) AS version, arg_max_null(value, nth) AS value, max_by(review_only, nth) AS review_only FROM style_log GROUP BY sample_id)"""


def style_log(spark: S, sf: str) -> DataFrame:
    """Style observations in the order they were made (nth), with the version that made them; most samples were seen by both."""
    i = F.col("sample_id")
    e = evidence(spark, sf).where("code = 'style'").select("sample_id", "value", F.explode(F.when(i % 17 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("nth"))
    value = F.when(i % 59 == 0, F.lit(float("nan"))).when(i % 61 != 0, F.col("value") - F.col("nth"))
    return e.select("sample_id", "nth", F.when(F.col("nth") == 0, "v1").otherwise("v2").alias("version"), value.alias("value"), ((F.col("nth") == 0) & (i % 3 == 0)).alias("review_only"))


@query(f"""WITH {STYLE_LOG_SQL} SELECT scope, count(l.sample_id) AS n, count(*) - count(l.sample_id) AS missing, count(*) FILTER (isfinite(value)) AS finite, min(value) FILTER (isfinite(value)) AS lowest, median(value) FILTER (isfinite(value)) AS middle, max(value) FILTER (isfinite(value)) AS highest,
  count(*) FILTER (review_only) AS review_only, CASE WHEN count(DISTINCT version) = 1 THEN max(version) END AS version, CASE count(DISTINCT version) WHEN 0 THEN 'unavailable' WHEN 1 THEN 'available' ELSE 'mixed' END AS version_status
  FROM samples LEFT JOIN style_latest l USING (sample_id) GROUP BY scope""")
def style_summary(spark: S, sf: str) -> DataFrame:
    """Each scope's style scores, by the last observation of each sample. The median is taken over distinct values with their counts, so no task holds a scope's rows."""
    last = style_log(spark, sf).groupBy("sample_id").agg(F.max_by(F.struct("version", "value", "review_only"), "nth").alias("l")).select("sample_id", "l.*", F.lit(1).alias("seen"))
    t = samples(spark, sf).select("sample_id", "scope").join(last, "sample_id", "left")
    fine = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    per = t.groupBy("scope", fine.alias("x")).agg(n_rows().alias("rows"), F.count("seen").alias("n"), F.count_if("review_only").alias("review_only"), F.min("version").alias("v0"), F.max("version").alias("v1"))
    w = Window.partitionBy("scope").orderBy(F.asc_nulls_last("x"))  # a row for each distinct score of a scope, as an ordered running sum
    upto = F.sum(F.when(F.col("x").isNotNull(), F.col("rows")).otherwise(0))
    per = per.withColumns({"upto": upto.over(w), "all": upto.over(Window.partitionBy("scope"))})
    # places (all - 1) // 2 and all // 2, counted from 0, hold the middle
    at = lambda place: F.min(F.when(F.col("upto") > F.floor(place), F.col("x")))
    a = per.groupBy("scope").agg(F.sum("n").alias("n"), (F.sum("rows") - F.sum("n")).alias("missing"), F.max("all").alias("finite"), F.min("x").alias("lowest"), ((at((F.col("all") - 1) / 2) + at(F.col("all") / 2)) / 2).alias("middle"), F.max("x").alias("highest"), F.sum("review_only").alias("review_only"), F.min("v0").alias("v0"), F.max("v1").alias("v1"))
    status = F.when(F.col("v0").isNull(), "unavailable").when(F.col("v0") == F.col("v1"), "available").otherwise("mixed")
    return a.select("scope", "n", "missing", "finite", "lowest", "middle", "highest", "review_only", F.when(status == "available", F.col("v0")).alias("version"), status.alias("version_status"))


LEAF_SQL = """leaves AS (SELECT label AS scope, vec_id % 7 AS leaf, count(*) AS size FROM embeddings GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY size, leaf) AS up, row_number() OVER (PARTITION BY scope ORDER BY size DESC, leaf) AS down, count(*) OVER (PARTITION BY scope) AS n FROM leaves),
  cover AS (SELECT scope, max(n) AS n_leaves, sum(size)::BIGINT AS assigned, count(*) FILTER (size = 1) AS singles, round(max(size) / nullif(sum(size), 0)::DOUBLE, 6) AS largest_share,
  round(sum(size) FILTER (down <= 5) / nullif(sum(size), 0)::DOUBLE, 6) AS top5_share, round(sum(size) FILTER (up <= ceil(n / 2.0)) / nullif(sum(size), 0)::DOUBLE, 6) AS bottom_half_share FROM ranked GROUP BY scope)"""


def covered(spark: S, sf: str) -> DataFrame:
    """Leaf statistics of each scope; windows run over leaves, of which there are few."""
    leaves = table(spark, sf, "embeddings").groupBy(F.col("label").alias("scope"), (F.col("vec_id") % 7).alias("leaf")).agg(n_rows().alias("size"))
    w = Window.partitionBy("scope")
    t = leaves.withColumns({"up": F.row_number().over(w.orderBy("size", "leaf")), "down": F.row_number().over(w.orderBy(F.desc("size"), "leaf")), "n": n_rows().over(w)})
    share = lambda part: F.round(F.try_divide(part, F.sum("size")), 6)
    return t.groupBy("scope").agg(F.max("n").alias("n_leaves"), F.sum("size").alias("assigned"), F.count_if(F.col("size") == 1).alias("singles"), share(F.max("size")).alias("largest_share"), share(F.sum(F.when(F.col("down") <= 5, F.col("size")))).alias("top5_share"), share(F.sum(F.when(F.col("up") <= F.ceil(F.col("n") / 2), F.col("size")))).alias("bottom_half_share"))


@query(f"WITH {LEAF_SQL} SELECT * FROM cover")
def scope_coverage(spark: S, sf: str) -> DataFrame:
    return covered(spark, sf)


@query(f"WITH {LEAF_SQL} SELECT count(*) AS scopes, sum(n_leaves)::BIGINT AS leaves, sum(assigned)::BIGINT AS assigned, sum(singles)::BIGINT AS singles, round(max(largest_share), 6) AS worst_share, round(avg(bottom_half_share), 5) AS mean_bottom_half FROM cover")
def coverage_report(spark: S, sf: str) -> DataFrame:
    return covered(spark, sf).agg(n_rows().alias("scopes"), F.sum("n_leaves").alias("leaves"), F.sum("assigned").alias("assigned"), F.sum("singles").alias("singles"), F.round(F.max("largest_share"), 6).alias("worst_share"), F.round(F.avg("bottom_half_share"), 5).alias("mean_bottom_half"))


@query("WITH a AS (SELECT doc_id AS id FROM documents), b AS (SELECT vec_id AS id FROM embeddings) SELECT (SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b)) AS both, (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b)) AS only_samples, (SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a)) AS only_vectors")
def embedding_coverage_sets(spark: S, sf: str) -> DataFrame:
    """Intersection and both differences in one shuffle."""
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("side"))
    b = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit(2).alias("side"))
    t = a.unionByName(b).groupBy("id").agg(F.bit_or("side").alias("m"))
    return t.agg(F.count_if(F.col("m") == 3).alias("both"), F.count_if(F.col("m") == 1).alias("only_samples"), F.count_if(F.col("m") == 2).alias("only_vectors"))


@query("SELECT sample_id FROM samples WHERE state = 'valid' AND sample_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark: S, sf: str) -> DataFrame:
    have = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"))
    return samples(spark, sf).where("state = 'valid'").select("sample_id").join(have, "sample_id", "left_anti")
