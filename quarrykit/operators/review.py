"""Candidate filters, the human overlay, audit read models and decision writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query
from quarrykit.plans.domain import areas, decision_log, decisions, evidence, members, overlay, samples, scores, severity_rank
from quarrykit.sources.tables import table

S = SparkSession
RANK_SQL = "CASE severity WHEN 'fatal' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"


def n_rows() -> Column:
    return F.count(F.lit(1))


@query("SELECT sample_id, source, value FROM evidence WHERE code = 'ai_generated' AND source IN ('ai_head', 'cf_head') AND value IS NOT NULL AND threshold IS NOT NULL AND value >= threshold")
def ai_candidates(spark: S, sf: str) -> DataFrame:
    return evidence(spark, sf).where("code = 'ai_generated' AND source IN ('ai_head', 'cf_head') AND value IS NOT NULL AND threshold IS NOT NULL AND value >= threshold").select("sample_id", "source", "value")


@query("SELECT e.sample_id, e.value, e.severity, d.decision FROM evidence e LEFT JOIN (SELECT * FROM decisions WHERE category = 'style') d USING (sample_id) WHERE code = 'style' AND (severity IN ('medium', 'high') OR d.decision IS NOT NULL)")
def style_candidates(spark: S, sf: str) -> DataFrame:
    d = decisions(spark, sf).where("category = 'style'").select("sample_id", "decision")
    return evidence(spark, sf).where("code = 'style'").join(d, "sample_id", "left").where("severity IN ('medium', 'high') OR decision IS NOT NULL").select("sample_id", "value", "severity", "decision")


@query("SELECT sample_id, value FROM evidence JOIN samples USING (sample_id) WHERE code = 'style' AND scope = 'src1' AND value >= 70 AND value <= 90")
def score_range_selection(spark: S, sf: str) -> DataFrame:
    return evidence(spark, sf).where("code = 'style' AND value BETWEEN 70 AND 90").join(samples(spark, sf).where("scope = 'src1'").select("sample_id"), "sample_id", "left_semi").select("sample_id", "value")


@query("SELECT sample_id, code, CASE WHEN code = 'duplicate_exact' THEN 'cross_scope_duplicate' WHEN severity = 'high' AND code = 'style' THEN 'style_outlier' WHEN code = 'aesthetic' AND source = 'aes_new' THEN 'aesthetic' ELSE 'other' END AS kind, nth FROM evidence")
def curated_evidence_type(spark: S, sf: str) -> DataFrame:
    kind = F.when(F.col("code") == "duplicate_exact", "cross_scope_duplicate").when((F.col("severity") == "high") & (F.col("code") == "style"), "style_outlier").when((F.col("code") == "aesthetic") & (F.col("source") == "aes_new"), "aesthetic").otherwise("other")
    return evidence(spark, sf).select("sample_id", "code", kind.alias("kind"), "nth")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1")
def json_leaf_filter(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k % 2 = 1")


@query(f"SELECT e.sample_id, s.path, e.code, e.severity, e.value, e.nth FROM evidence e JOIN samples s USING (sample_id) WHERE {RANK_SQL} <= 2")
def risk_list(spark: S, sf: str) -> DataFrame:
    return evidence(spark, sf).where(severity_rank(F.col("severity")) <= 2).join(samples(spark, sf).select("sample_id", "path"), "sample_id").select("sample_id", "path", "code", "severity", "value", "nth")


@query("SELECT e.sample_id, s.path, e.value, coalesce(d.decision, 'pending_review') AS decision FROM evidence e JOIN samples s USING (sample_id) LEFT JOIN (SELECT * FROM decisions WHERE category = 'ai') d ON d.sample_id = e.sample_id WHERE e.code = 'ai_generated' AND e.value >= e.threshold")
def ai_review_list(spark: S, sf: str) -> DataFrame:
    d = decisions(spark, sf).where("category = 'ai'").select("sample_id", "decision")
    e = evidence(spark, sf).where("code = 'ai_generated' AND value >= threshold")
    return e.join(samples(spark, sf).select("sample_id", "path"), "sample_id").join(d, "sample_id", "left").select("sample_id", "path", "value", F.coalesce("decision", F.lit("pending_review")).alias("decision"))


@query("SELECT e.sample_id, s.scope, e.value, e.threshold, e.severity, coalesce(d.decision, 'pending_review') AS decision FROM evidence e JOIN samples s USING (sample_id) LEFT JOIN (SELECT * FROM decisions WHERE category = 'style') d ON d.sample_id = e.sample_id WHERE e.code = 'style' AND e.threshold IS NOT NULL")
def style_audit_list(spark: S, sf: str) -> DataFrame:
    d = decisions(spark, sf).where("category = 'style'").select("sample_id", "decision")
    e = evidence(spark, sf).where("code = 'style' AND threshold IS NOT NULL")
    return e.join(samples(spark, sf).select("sample_id", "scope"), "sample_id").join(d, "sample_id", "left").select("sample_id", "scope", "value", "threshold", "severity", F.coalesce("decision", F.lit("pending_review")).alias("decision"))


@query(f"""SELECT s.scope, count(*) AS n_samples, count(*) FILTER (s.state = 'valid') AS n_valid, coalesce(max(r.risky), 0) AS n_risky, coalesce(max(r.n), 0) AS n_evidence, coalesce(max(l.n), 0) AS n_leaves FROM samples s
  LEFT JOIN (SELECT scope, count(DISTINCT sample_id) AS risky, count(*) AS n FROM evidence JOIN samples USING (sample_id) WHERE {RANK_SQL} <= 2 GROUP BY scope) r ON r.scope = s.scope
  LEFT JOIN (SELECT scope, count(DISTINCT (label, vec_id % 7)) AS n FROM embeddings JOIN samples ON vec_id = sample_id GROUP BY scope) l ON l.scope = s.scope GROUP BY s.scope""")
def folder_rollup(spark: S, sf: str) -> DataFrame:
    """Counts of each folder: samples, valid ones, those at risk with their observations, and distinct leaf clusters that its samples are members of."""
    risks = evidence(spark, sf).where(severity_rank(F.col("severity")) <= 2).groupBy("sample_id").agg(n_rows().alias("n"))  # a row per risky sample, so no count distinct later
    leaf = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.struct("label", (F.col("vec_id") % 7).alias("leaf")).alias("leaf"))
    s = samples(spark, sf).select("sample_id", "scope", "state").join(risks, "sample_id", "left")
    counts = s.groupBy("scope").agg(n_rows().alias("n_samples"), F.count_if(F.col("state") == "valid").alias("n_valid"), F.count("n").alias("n_risky"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_evidence"))
    leaves = samples(spark, sf).select("sample_id", "scope").join(leaf, "sample_id").select("scope", "leaf").distinct().groupBy("scope").agg(n_rows().alias("n_leaves"))
    return counts.join(leaves, "scope", "left").withColumn("n_leaves", F.coalesce("n_leaves", F.lit(0)))


@query("SELECT doc_id AS sample_id, aes FROM scores WHERE doc_id IN (SELECT sample_id FROM samples WHERE state = 'valid')")
def eligible_inputs_semi(spark: S, sf: str) -> DataFrame:
    return scores(spark, sf).select(F.col("doc_id").alias("sample_id"), "aes").join(samples(spark, sf).where("state = 'valid'").select("sample_id"), "sample_id", "left_semi")


@query("SELECT sample_id, scope FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM evidence WHERE code = 'style' AND severity = 'high') AND sample_id NOT IN (SELECT sample_id FROM evidence WHERE code = 'ai_generated' AND value >= 0.5)")
def style_scope_anti(spark: S, sf: str) -> DataFrame:
    out = evidence(spark, sf).where("code = 'style' AND severity = 'high' OR code = 'ai_generated' AND value >= 0.5").select("sample_id")
    return samples(spark, sf).select("sample_id", "scope").join(out, "sample_id", "left_anti")


RISK_SQL = f"""SELECT e.sample_id, any_value(s.path) AS path, min({RANK_SQL}) AS worst, count(*) AS n, array_to_string(list_sort(list(DISTINCT e.code)), ',') AS codes,
  bool_or(o.decision IS NOT NULL AND o.decision = 'approved_exclude') AS excluded FROM evidence e JOIN samples s USING (sample_id) LEFT JOIN overlay o ON o.sample_id = e.sample_id WHERE e.severity <> 'info' GROUP BY e.sample_id"""


@query(RISK_SQL)
def risk_samples(spark: S, sf: str) -> DataFrame:
    """Samples at risk: their worst severity, how many observations, which codes, and whether a person has excluded them."""
    e = evidence(spark, sf).where("severity <> 'info'").groupBy("sample_id").agg(F.min(severity_rank(F.col("severity"))).alias("worst"), n_rows().alias("n"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    out = overlay(spark, sf).where("decision = 'approved_exclude'").select("sample_id", F.lit(True).alias("x"))
    return e.join(samples(spark, sf).select("sample_id", "path"), "sample_id").join(out, "sample_id", "left").select("sample_id", "path", "worst", "n", "codes", F.col("x").isNotNull().alias("excluded"))


@query("SELECT label AS cluster, count(*) AS size, max_by(vec_id, score) AS representative, count(*) FILTER (vec_id % 3 = 0) AS in_folder FROM members GROUP BY label HAVING count(*) FILTER (vec_id % 3 = 0) > 0")
def clusters_in_folder(spark: S, sf: str) -> DataFrame:
    return members(spark, sf).groupBy(F.col("label").alias("cluster")).agg(n_rows().alias("size"), F.max_by("vec_id", "score").alias("representative"), F.count_if(F.col("vec_id") % 3 == 0).alias("in_folder")).where("in_folder > 0")


@query("SELECT label AS cluster, vec_id AS sample_id, round(CASE WHEN vec_id % 10 = 0 THEN NULL ELSE score END, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN vec_id % 10 = 0 THEN NULL ELSE round(score, 6) END DESC NULLS LAST, vec_id) AS place FROM members")
def cluster_samples(spark: S, sf: str) -> DataFrame:
    from pyspark.sql import Window

    s = F.round(F.when(F.col("vec_id") % 10 != 0, F.col("score")), 6)
    m = members(spark, sf).select(F.col("label").alias("cluster"), F.col("vec_id").alias("sample_id"), s.alias("score"))
    return m.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc_nulls_last("score"), "sample_id")).cast("long"))


@query("SELECT (SELECT count(*) FROM samples) AS n_samples, (SELECT count(*) FROM samples WHERE state = 'valid') AS n_valid, (SELECT count(*) FROM evidence) AS n_evidence, (SELECT count(*) FROM decisions) AS n_decisions, (SELECT count(DISTINCT label) FROM embeddings) AS n_clusters")
def task_overview(spark: S, sf: str) -> DataFrame:
    parts = [samples(spark, sf).agg(n_rows().alias("n_samples"), F.count_if(F.col("state") == "valid").alias("n_valid")), evidence(spark, sf).agg(n_rows().alias("n_evidence")), decisions(spark, sf).agg(n_rows().alias("n_decisions")), table(spark, sf, "embeddings").agg(F.count_distinct("label").alias("n_clusters"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # single rows
    return out


@query("SELECT category, decision, count(*) AS n FROM decisions GROUP BY ALL")
def review_counts(spark: S, sf: str) -> DataFrame:
    return decisions(spark, sf).groupBy("category", "decision").agg(n_rows().alias("n"))


@query("SELECT coalesce(d.decision, 'pending_review') AS decision, count(*) AS n FROM evidence e LEFT JOIN (SELECT * FROM decisions WHERE category = 'ai') d USING (sample_id) WHERE code = 'ai_generated' AND value >= threshold GROUP BY 1")
def ai_decision_counts(spark: S, sf: str) -> DataFrame:
    return ai_review_list(spark, sf).groupBy("decision").agg(n_rows().alias("n"))


@query("SELECT coalesce(d.decision, 'pending_review') AS decision, count(*) AS n FROM evidence e LEFT JOIN (SELECT * FROM decisions WHERE category = 'style') d USING (sample_id) WHERE code = 'style' AND threshold IS NOT NULL GROUP BY 1")
def style_decision_counts(spark: S, sf: str) -> DataFrame:
    return style_audit_list(spark, sf).groupBy("decision").agg(n_rows().alias("n"))


def state_sql(name: str, rows: str, source: str, lower: float, upper: float) -> str:
    """``name``: (sample_id, state, value) of every sample, from the rows (sample_id, source, value) of the query ``rows``."""
    return f"""{name} AS (SELECT s.sample_id, CASE WHEN count(e.sample_id) = 0 THEN 'missing' WHEN count(*) FILTER (e.source = '{source}') < count(*) THEN 'provenance_mismatch' WHEN count(*) FILTER (e.value IS NULL) > 0 THEN 'missing'
  WHEN count(*) FILTER (isnan(e.value) OR isinf(e.value)) > 0 THEN 'non_finite' WHEN count(*) FILTER (e.value < {lower} OR e.value > {upper}) > 0 THEN 'out_of_range' WHEN count(DISTINCT e.value) > 1 THEN 'ambiguous' ELSE 'value' END AS state,
  max(e.value) AS value FROM samples s LEFT JOIN ({rows}) e USING (sample_id) GROUP BY s.sample_id)"""


STATE_SQL = state_sql("trusted", "SELECT * FROM evidence WHERE code = 'aesthetic'", "aes_new", 1, 5)
DOMAIN_SQL = state_sql("domained", """SELECT doc_id AS sample_id, CASE WHEN doc_id % 43 = 0 THEN 'dom_old' ELSE 'dom_new' END AS source, unnest(CASE WHEN doc_id % 37 = 0 THEN [1 - ai, 0.75] ELSE [CASE WHEN doc_id % 41 = 0 THEN 'nan'::DOUBLE WHEN doc_id % 47 = 0 THEN 1.5 ELSE 1 - ai END] END) AS value FROM scores""", "dom_new", 0, 1)


def domain_rows(spark: S, sf: str) -> DataFrame:
    """Observations of the probability that a sample is of the domain: of an old model, two that differ, not finite, or out of range for some."""
    i, v = F.col("doc_id"), 1 - F.col("ai")
    one = F.when(i % 41 == 0, F.lit(float("nan"))).when(i % 47 == 0, 1.5).otherwise(v)
    return scores(spark, sf).select(i.alias("sample_id"), F.when(i % 43 == 0, "dom_old").otherwise("dom_new").alias("source"), F.explode(F.when(i % 37 == 0, F.array(v, F.lit(0.75))).otherwise(F.array(one))).alias("value"))


def states(rows: DataFrame, source: str, lower: float, upper: float) -> DataFrame:
    """(sample_id, state, value): the one value that a sample's rows (sample_id, source, value) agree on, or why there is none: the checks in order, in one
    aggregate. Samples without rows are not in the result; their state is ``missing``."""
    v = F.col("value")
    a = rows.groupBy("sample_id").agg(n_rows().alias("n"), F.count_if(F.col("source") == source).alias("own"), F.count_if(v.isNull()).alias("gone"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("odd"), F.count_if((v < lower) | (v > upper)).alias("out"), F.min("value").alias("lo"), F.max("value").alias("value"))
    state = F.when(F.col("own") < F.col("n"), "provenance_mismatch").when(F.col("gone") > 0, "missing").when(F.col("odd") > 0, "non_finite").when(F.col("out") > 0, "out_of_range").when(F.col("lo") < F.col("value"), "ambiguous").otherwise("value")
    return a.select("sample_id", state.alias("state"), F.when(state == "value", v).alias("value"))


def aesthetic_states(spark: S, sf: str) -> DataFrame:
    return states(evidence(spark, sf).where("code = 'aesthetic'").select("sample_id", "source", "value"), "aes_new", 1, 5)


def trusted(spark: S, sf: str) -> DataFrame:
    return samples(spark, sf).select("sample_id", "scope").join(aesthetic_states(spark, sf), "sample_id", "left").select("sample_id", "scope", F.coalesce("state", F.lit("missing")).alias("state"), "value")


@query(f"WITH {STATE_SQL} SELECT sample_id, state, CASE WHEN state = 'value' THEN value END AS value FROM trusted")
def trusted_score(spark: S, sf: str) -> DataFrame:
    return trusted(spark, sf).select("sample_id", "state", "value")


@query(f"WITH {STATE_SQL}, b AS (SELECT unnest([1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0])::DOUBLE AS bucket) SELECT bucket, count(t.sample_id) AS n FROM b LEFT JOIN trusted t ON t.state = 'value' AND least(5.0, floor(t.value * 2) / 2) = bucket GROUP BY bucket")
def aesthetic_buckets(spark: S, sf: str) -> DataFrame:
    """Half-point buckets, empty ones included."""
    b = spark.createDataFrame([(1 + i / 2,) for i in range(9)], "bucket double")
    t = trusted(spark, sf).where("state = 'value'").groupBy(F.least(F.lit(5.0), (F.floor(F.col("value") * 2) / 2).cast("double")).alias("bucket")).agg(n_rows().alias("n"))
    return b.join(t, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {STATE_SQL} SELECT CASE WHEN state = 'value' THEN CAST(CAST(floor(value * 2) AS BIGINT) AS VARCHAR) ELSE '_unscored' END AS bin, CASE WHEN state = 'value' THEN NULL ELSE state END AS reason, count(*) AS n FROM trusted GROUP BY ALL")
def aesthetic_bins(spark: S, sf: str) -> DataFrame:
    scored = F.col("state") == "value"
    return trusted(spark, sf).groupBy(F.when(scored, F.floor(F.col("value") * 2).cast("string")).otherwise("_unscored").alias("bin"), F.when(~scored, F.col("state")).alias("reason")).agg(n_rows().alias("n"))


@query(f"WITH {STATE_SQL} SELECT t.sample_id, t.state, CASE WHEN t.state = 'value' THEN t.value END AS value, coalesce(o.decision, 'pending_review') AS decision, CASE WHEN t.state = 'value' AND t.value < 3.0 THEN true ELSE false END AS below_minimum FROM trusted t LEFT JOIN overlay o USING (sample_id)")
def aesthetic_audit(spark: S, sf: str) -> DataFrame:
    t = trusted(spark, sf).join(overlay(spark, sf), "sample_id", "left")
    return t.select("sample_id", "state", "value", F.coalesce("decision", F.lit("pending_review")).alias("decision"), F.coalesce(F.col("value") < 3.0, F.lit(False)).alias("below_minimum"))


@query("SELECT sample_id, decision FROM overlay")
def human_overlay(spark: S, sf: str) -> DataFrame:
    return overlay(spark, sf)


@query(f"SELECT * EXCLUDE (rn) FROM (SELECT sample_id, code, severity, value, row_number() OVER (PARTITION BY sample_id ORDER BY {RANK_SQL}, code, nth) AS rn FROM evidence WHERE severity <> 'info') WHERE rn = 1")
def curated_candidates(spark: S, sf: str) -> DataFrame:
    """The first candidate of each sample, as one aggregate instead of a sorted window."""
    e = evidence(spark, sf).where("severity <> 'info'")
    first = F.min_by(F.struct("code", "severity", "value"), F.struct(severity_rank(F.col("severity")), "code", "nth")).alias("r")
    return e.groupBy("sample_id").agg(first).select("sample_id", "r.*")


@query(f"SELECT sample_id, code, severity, nth FROM evidence ORDER BY {RANK_SQL}, sample_id, code, nth LIMIT 50 OFFSET 20")
def paged_risks(spark: S, sf: str) -> DataFrame:
    """One page of the ranked list: the page is the feature."""
    return evidence(spark, sf).orderBy(severity_rank(F.col("severity")), "sample_id", "code", "nth").offset(20).limit(50).select("sample_id", "code", "severity", "nth")


@query("SELECT s.sample_id, s.path, s.state, e.code, e.severity, e.value, e.threshold, e.nth, o.decision FROM samples s JOIN evidence e USING (sample_id) LEFT JOIN overlay o USING (sample_id) WHERE s.scope = 'src3'")
def risk_detail(spark: S, sf: str) -> DataFrame:
    s = samples(spark, sf).where("scope = 'src3'").select("sample_id", "path", "state")
    return s.join(evidence(spark, sf), "sample_id").join(overlay(spark, sf), "sample_id", "left").select("sample_id", "path", "state", "code", "severity", "value", "threshold", "nth", "decision")


@query("""WITH want AS (SELECT sample_id, CASE sample_id % 2 WHEN 0 THEN 'approved_keep' ELSE 'approved_exclude' END AS new FROM evidence WHERE code = 'ai_generated' AND value >= threshold)
  SELECT w.sample_id, d.decision AS old_decision, w.new AS new_decision, d.decision_id AS supersedes, d.decision IS NULL OR d.decision <> w.new AS changed FROM want w LEFT JOIN (SELECT * FROM decisions WHERE category = 'ai') d USING (sample_id)""")
def apply_decisions(spark: S, sf: str) -> DataFrame:
    """The rows a bulk decision writes: what each supersedes and whether it changes anything."""
    want = ai_candidates(spark, sf).select("sample_id", F.when(F.col("sample_id") % 2 == 0, "approved_keep").otherwise("approved_exclude").alias("new_decision"))
    d = decisions(spark, sf).where("category = 'ai'").select("sample_id", F.col("decision").alias("old_decision"), F.col("decision_id").alias("supersedes"))
    return want.join(d, "sample_id", "left").withColumn("changed", F.col("old_decision").isNull() | (F.col("old_decision") != F.col("new_decision")))


@query(f"WITH {STATE_SQL} SELECT a.sample_id, a.w, a.h, CASE WHEN o.decision = 'approved_exclude' THEN false WHEN o.decision = 'approved_keep' THEN true ELSE t.state = 'value' AND t.value >= 3.0 END AS curated FROM areas a JOIN trusted t USING (sample_id) LEFT JOIN overlay o USING (sample_id) WHERE a.state = 'valid'")
def curated_membership(spark: S, sf: str) -> DataFrame:
    a = areas(spark, sf).where("state = 'valid'").select("sample_id", "w", "h")
    t = trusted(spark, sf).select("sample_id", F.coalesce(F.col("value") >= 3.0, F.lit(False)).alias("good")).join(overlay(spark, sf), "sample_id", "left")
    curated = F.when(F.col("decision") == "approved_exclude", False).when(F.col("decision") == "approved_keep", True).otherwise(F.col("good"))
    return a.join(t, "sample_id").select("sample_id", "w", "h", curated.alias("curated"))


@query("SELECT r AS resolution, count(*) AS n, count(*) FILTER (o.decision IS NULL OR o.decision <> 'approved_exclude') AS n_kept FROM areas a JOIN (VALUES (512), (768), (1024), (1216), (1536)) t(r) ON a.area >= r * r LEFT JOIN overlay o ON o.sample_id = a.sample_id WHERE a.state = 'valid' GROUP BY r")
def resolution_slices(spark: S, sf: str) -> DataFrame:
    from quarrykit.operators.evidence import RESOLUTIONS

    a = areas(spark, sf).where("state = 'valid'").join(overlay(spark, sf), "sample_id", "left").withColumn("resolution", F.explode(F.array(*map(F.lit, RESOLUTIONS))))
    return a.where("area >= resolution * resolution").groupBy("resolution").agg(n_rows().alias("n"), F.count_if(F.coalesce(F.col("decision") != "approved_exclude", F.lit(True))).alias("n_kept"))


@query("SELECT category, count(*) AS n, count(DISTINCT sample_id) AS n_samples FROM decision_log GROUP BY category")
def decision_history(spark: S, sf: str) -> DataFrame:
    return decision_log(spark, sf).groupBy("category").agg(n_rows().alias("n"), F.count_distinct("sample_id").alias("n_samples"))
