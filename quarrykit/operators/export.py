"""Export: the eligibility cascade, folder plans, sample-seen balance, file plans and tree comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.operators import dedupe, review
from quarrykit.plans.catalog import query
from quarrykit.plans.domain import areas, evidence, overlay, samples
from quarrykit.sources.tables import table

S = SparkSession


def n_rows() -> Column:
    return F.count(F.lit(1))
MINIMUM_AREA, FOLDER_MINIMUM, DOMAIN_MINIMUM = 512 * 512, 3, 0.5

STYLE_ROWS_SQL = """SELECT e.sample_id, CASE WHEN e.sample_id % 29 = 0 THEN 'style_old' ELSE e.source END AS source, e.threshold, unnest(CASE WHEN e.sample_id % 23 = 0 THEN [e.severity, 'info'] ELSE [e.severity] END) AS severity FROM evidence e JOIN samples s USING (sample_id) WHERE e.code = 'style' AND s.state = 'valid'"""
STYLE_SQL = f"""styled AS (SELECT s.sample_id, CASE WHEN count(e.sample_id) = 0 THEN 'style_missing' WHEN count(*) FILTER (e.source <> 'style_head' OR e.threshold IS DISTINCT FROM 92.07) > 0 THEN 'style_provenance_mismatch'
  WHEN count(DISTINCT e.severity) > 1 THEN 'style_ambiguous' WHEN max(e.severity) = 'high' THEN 'style_outlier' WHEN max(e.severity) = 'medium' THEN 'style_review' ELSE 'core' END AS style FROM samples s LEFT JOIN ({STYLE_ROWS_SQL}) e USING (sample_id) GROUP BY s.sample_id)"""


def style_states(spark: S, sf: str) -> DataFrame:
    """(sample_id, style) of samples with rows of style: rows of another model or threshold, or that differ, give no class. Only valid samples have rows."""
    i = F.col("sample_id")
    valid = samples(spark, sf).where("state = 'valid'").select("sample_id")
    e = evidence(spark, sf).where("code = 'style'").join(valid, "sample_id", "left_semi")
    e = e.select("sample_id", F.when(i % 29 == 0, "style_old").otherwise(F.col("source")).alias("source"), "threshold", F.explode(F.when(i % 23 == 0, F.array("severity", F.lit("info"))).otherwise(F.array("severity"))).alias("severity"))
    own = (F.col("source") == "style_head") & F.col("threshold").eqNullSafe(92.07)
    a = e.groupBy("sample_id").agg(F.bool_and(own).alias("own"), F.min("severity").alias("low"), F.max("severity").alias("high"))
    c = F.when(~F.col("own"), "style_provenance_mismatch").when(F.col("low") < F.col("high"), "style_ambiguous").when(F.col("high") == "high", "style_outlier").when(F.col("high") == "medium", "style_review").otherwise("core")
    return a.select("sample_id", c.alias("style"))


def style_classes(spark: S, sf: str) -> DataFrame:
    return samples(spark, sf).select("sample_id").join(style_states(spark, sf), "sample_id", "left").select("sample_id", F.coalesce("style", F.lit("style_missing")).alias("style"))


@query(f"WITH {STYLE_SQL} SELECT sample_id, style FROM styled")
def style_classification(spark: S, sf: str) -> DataFrame:
    return style_classes(spark, sf)


ELIGIBLE_SQL = f"""{review.STATE_SQL}, {STYLE_SQL}, {dedupe.ELECT_SQL}, {review.DOMAIN_SQL},
  early AS (SELECT a.sample_id, a.scope, a.area, a.path, o.decision, CASE WHEN a.state <> 'valid' OR a.area < {MINIMUM_AREA} THEN 'resolution_below_minimum' WHEN o.decision = 'approved_exclude' THEN 'manual_exclude' WHEN o.decision = 'approved_keep' THEN NULL
    WHEN d.state <> 'value' THEN 'domain_' || d.state WHEN d.value < {DOMAIN_MINIMUM} THEN 'domain_below_minimum' WHEN t.state <> 'value' THEN 'aesthetic_' || t.state WHEN t.value < 3.0 THEN 'aesthetic_below_minimum' WHEN st.style <> 'core' AND st.style <> 'style_review' THEN st.style END AS reason
    FROM areas a JOIN trusted t USING (sample_id) JOIN styled st USING (sample_id) JOIN domained d USING (sample_id) LEFT JOIN overlay o ON o.sample_id = a.sample_id),
  alive AS (SELECT e.*, c.component FROM early e LEFT JOIN c USING (sample_id)),
  prot AS (SELECT component, bool_or(coalesce(decision, '') = 'approved_keep') AS any_keep FROM alive WHERE component IS NOT NULL GROUP BY component),
  win AS (SELECT component, sample_id AS winner FROM (SELECT component, sample_id, row_number() OVER (PARTITION BY component ORDER BY area DESC, lower(path), path, sample_id) AS rn FROM alive WHERE component IS NOT NULL AND reason IS NULL) WHERE rn = 1),
  deduped AS (SELECT a.sample_id, a.scope, CASE WHEN a.reason IS NULL AND a.component IS NOT NULL AND NOT p.any_keep AND a.sample_id <> w.winner THEN 'duplicate_non_representative' ELSE a.reason END AS reason FROM alive a LEFT JOIN prot p USING (component) LEFT JOIN win w USING (component)),
  folders AS (SELECT scope, count(*) AS kept FROM deduped WHERE reason IS NULL GROUP BY scope),
  eligible AS (SELECT d.sample_id, d.scope, CASE WHEN d.reason IS NULL AND f.kept < {FOLDER_MINIMUM} THEN 'folder_below_minimum' ELSE coalesce(d.reason, 'included') END AS outcome FROM deduped d LEFT JOIN folders f USING (scope))"""


def eligible(spark: S, sf: str) -> DataFrame:
    """(sample_id, scope, outcome): the first rule that speaks, in order; a human keep silences the rules from the domain to the style.

    Duplicates are elected among what no earlier rule took; one human keep protects its whole component. Folders left with too few go last.
    """
    t = review.aesthetic_states(spark, sf).select("sample_id", F.col("state").alias("aes_state"), "value")
    d = review.states(review.domain_rows(spark, sf), "dom_new", 0, 1).select("sample_id", F.col("state").alias("dom_state"), F.col("value").alias("dom"))
    w = areas(spark, sf).select("sample_id", "scope", "area", "path", "state")
    for part in (t, d, style_states(spark, sf), overlay(spark, sf)):
        w = w.join(part, "sample_id", "left")
    dom, aes, style = (F.coalesce(c, F.lit(none)) for c, none in (("dom_state", "missing"), ("aes_state", "missing"), ("style", "style_missing")))
    reason = (
        F.when((F.col("state") != "valid") | (F.col("area") < MINIMUM_AREA), "resolution_below_minimum").when(F.col("decision") == "approved_exclude", "manual_exclude").when(F.col("decision") == "approved_keep", None)
        .when(dom != "value", F.concat(F.lit("domain_"), dom)).when(F.col("dom") < DOMAIN_MINIMUM, "domain_below_minimum")
        .when(aes != "value", F.concat(F.lit("aesthetic_"), aes)).when(F.col("value") < 3.0, "aesthetic_below_minimum").when(~style.isin("core", "style_review"), style)
    )
    w = w.select("sample_id", "scope", "area", "path", "decision", reason.alias("reason")).join(dedupe.duplicate_components(spark, sf), "sample_id", "left")
    grouped = w.where("component IS NOT NULL").groupBy("component").agg(F.bool_or(F.coalesce(F.col("decision") == "approved_keep", F.lit(False))).alias("any_keep"), F.min_by(F.when(F.col("reason").isNull(), F.col("sample_id")), F.when(F.col("reason").isNull(), F.struct(-F.col("area"), F.lower("path"), "path", "sample_id"))).alias("winner"))
    w = w.join(grouped, "component", "left")
    lost = F.col("reason").isNull() & F.col("component").isNotNull() & ~F.col("any_keep") & (F.col("sample_id") != F.col("winner"))
    w = w.withColumn("reason", F.when(lost, "duplicate_non_representative").otherwise(F.col("reason")))
    few = w.groupBy("scope").agg(F.count_if(F.col("reason").isNull()).alias("kept"))
    w = w.join(few, "scope")
    return w.select("sample_id", "scope", F.when(F.col("reason").isNull() & (F.col("kept") < FOLDER_MINIMUM), "folder_below_minimum").otherwise(F.coalesce("reason", F.lit("included"))).alias("outcome"))


@query(f"WITH RECURSIVE {ELIGIBLE_SQL} SELECT sample_id, scope, outcome FROM eligible")
def eligibility(spark: S, sf: str) -> DataFrame:
    return eligible(spark, sf)


INVALID = ("missing", "provenance_mismatch", "non_finite", "out_of_range", "ambiguous")
OUTCOMES = ("included", "resolution_below_minimum", "manual_exclude", "domain_below_minimum", *(f"domain_{x}" for x in INVALID), "aesthetic_below_minimum", *(f"aesthetic_{x}" for x in INVALID), "style_outlier", *(f"style_{x}" for x in INVALID), "duplicate_non_representative", "folder_below_minimum")


@query(f"WITH RECURSIVE {ELIGIBLE_SQL}, o AS (SELECT unnest([{', '.join(repr(x) for x in OUTCOMES)}]) AS outcome) SELECT o.outcome, count(e.sample_id) AS n FROM o LEFT JOIN eligible e USING (outcome) GROUP BY o.outcome")
def exclusion_counts(spark: S, sf: str) -> DataFrame:
    """Counts of all outcomes, those without samples included."""
    n = eligible(spark, sf).groupBy("outcome").agg(n_rows().alias("n"))
    return spark.createDataFrame([(o,) for o in OUTCOMES], "outcome string").join(n, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


FOLDER_SQL = """named AS (SELECT scope, CASE WHEN CAST(substr(scope, 4) AS INT) % 2 = 0 THEN CAST(1 + CAST(substr(scope, 4) AS INT) % 3 AS VARCHAR) || '_' || scope ELSE scope END AS folder, sample_id, path, area, n_chars FROM areas WHERE state = 'valid'),
  parts AS (SELECT *, CASE WHEN regexp_matches(folder, '^[1-9][0-9]*_.+$') THEN CAST(regexp_extract(folder, '^([1-9][0-9]*)_(.+)$', 1) AS BIGINT) ELSE 1 END AS repeat, CASE WHEN regexp_matches(folder, '^[1-9][0-9]*_.+$') THEN regexp_extract(folder, '^([1-9][0-9]*)_(.+)$', 2) ELSE folder END AS base FROM named),
  plan AS (SELECT folder, repeat, base, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM parts GROUP BY ALL)"""


def folders(spark: S, sf: str) -> DataFrame:
    """Valid samples with their export folder, its repeat prefix and its name without it."""
    number = F.substring("scope", 4, 10).cast("int")
    t = areas(spark, sf).where("state = 'valid'").withColumn("folder", F.when(number % 2 == 0, F.concat_ws("_", (1 + number % 3).cast("string"), "scope")).otherwise(F.col("scope")))
    pattern, has = r"^([1-9][0-9]*)_(.+)$", F.col("folder").rlike(r"^[1-9][0-9]*_.+$")
    return t.withColumns({"repeat": F.when(has, F.regexp_extract("folder", pattern, 1).cast("long")).otherwise(F.lit(1).cast("long")), "base": F.when(has, F.regexp_extract("folder", pattern, 2)).otherwise(F.col("folder"))})


def folder_sums(spark: S, sf: str) -> DataFrame:
    return folders(spark, sf).groupBy("folder", "repeat", "base").agg(n_rows().alias("files"), F.sum("n_chars").alias("bytes"))


@query(f"WITH {FOLDER_SQL} SELECT folder, repeat, base, files, bytes, files < 3 AS below_minimum FROM plan")
def folder_plan(spark: S, sf: str) -> DataFrame:
    return folder_sums(spark, sf).withColumn("below_minimum", F.col("files") < FOLDER_MINIMUM)


SEEN_SQL = FOLDER_SQL + """, target AS (SELECT max(repeat * files) AS t FROM plan), seen AS (SELECT folder, base, files, repeat, t, CASE WHEN repeat * files > t THEN repeat ELSE greatest(repeat, t // files) END AS new_repeat FROM plan, target)"""


def balanced(spark: S, sf: str) -> DataFrame:
    """Repeats raised so that every folder is seen about as often as the one seen most."""
    p = folder_sums(spark, sf)
    t = p.agg(F.max(F.col("repeat") * F.col("files")).alias("t"))
    new = F.when(F.col("repeat") * F.col("files") > F.col("t"), F.col("repeat")).otherwise(F.greatest("repeat", F.floor(F.col("t") / F.col("files"))))
    return p.join(F.broadcast(t)).withColumn("new_repeat", new)


@query(f"WITH {SEEN_SQL} SELECT folder, files, repeat, t AS target, new_repeat, CAST(new_repeat AS VARCHAR) || '_' || base AS output, new_repeat * files <> t AS approximate FROM seen")
def sample_seen_plan(spark: S, sf: str) -> DataFrame:
    return balanced(spark, sf).select("folder", "files", "repeat", F.col("t").alias("target"), "new_repeat", F.concat_ws("_", F.col("new_repeat").cast("string"), "base").alias("output"), (F.col("new_repeat") * F.col("files") != F.col("t")).alias("approximate"))


@query(f"WITH {SEEN_SQL} SELECT p.sample_id, CAST(s.new_repeat AS VARCHAR) || '_' || s.base || '/' || string_split(p.path, '/')[-1] AS destination, sha256(CAST(s.new_repeat AS VARCHAR) || '_' || s.base || '/' || string_split(p.path, '/')[-1] || '|' || CAST(p.sample_id AS VARCHAR)) AS digest FROM parts p JOIN seen s USING (folder)")
def export_files(spark: S, sf: str) -> DataFrame:
    b = balanced(spark, sf).select("folder", F.concat_ws("_", F.col("new_repeat").cast("string"), "base").alias("out"))
    t = folders(spark, sf).select("folder", "sample_id", F.element_at(F.split("path", "/"), -1).alias("name")).join(b, "folder").withColumn("destination", F.concat_ws("/", "out", "name"))
    return t.select("sample_id", "destination", F.sha2(F.concat_ws("|", "destination", F.col("sample_id").cast("string")), 256).alias("digest"))


@query("SELECT doc_id, 'f' || CAST(doc_id % 50 AS VARCHAR) || CASE WHEN rn > 1 THEN '_' || CAST(rn AS VARCHAR) ELSE '' END || '.jpg' AS destination FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, doc_id % 50 ORDER BY doc_id) AS rn FROM documents)")
def collision_suffix(spark: S, sf: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("source", F.col("doc_id") % 50).orderBy("doc_id"))
    t = table(spark, sf, "documents").select("doc_id", "source").withColumn("rn", rn)
    return t.select("doc_id", F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("rn") > 1, F.concat(F.lit("_"), F.col("rn").cast("string"))).otherwise(""), F.lit(".jpg")).alias("destination"))


TREES_SQL = "WITH a AS (SELECT path, sha FROM samples WHERE sample_id % 11 <> 0), b AS (SELECT path, CASE WHEN sample_id % 17 = 0 THEN 'x' ELSE sha END AS sha FROM samples WHERE sample_id % 13 <> 0)"


def compare_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, status) of every path that is missing, extra or changed between two (path, sha) listings."""
    both = a.select("path", F.col("sha").alias("x")).join(b.select("path", F.col("sha").alias("y")), "path", "full")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") != F.col("y"), "changed")
    return both.select("path", status.alias("status")).where("status IS NOT NULL")


def _listings(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    s = samples(spark, sf)
    return s.where("sample_id % 11 <> 0").select("path", "sha"), s.where("sample_id % 13 <> 0").select("path", F.when(F.col("sample_id") % 17 == 0, "x").otherwise(F.col("sha")).alias("sha"))


@query(TREES_SQL + " SELECT path, CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha IS NULL THEN 'extra' ELSE 'changed' END AS status FROM a FULL JOIN b USING (path) WHERE a.sha IS NULL OR b.sha IS NULL OR a.sha <> b.sha")
def tree_diff(spark: S, sf: str) -> DataFrame:
    return compare_trees(*_listings(spark, sf))


@query(TREES_SQL + " SELECT path, CASE WHEN b.path IS NULL THEN 'not_published' ELSE 'not_planned' END AS problem FROM a FULL JOIN b USING (path) WHERE a.path IS NULL OR b.path IS NULL OR false".replace("USING (path)", "ON a.path = b.path").replace("SELECT path, CASE", "SELECT coalesce(a.path, b.path) AS path, CASE"))
def publish_layout_diff(spark: S, sf: str) -> DataFrame:
    plan, there = _listings(spark, sf)
    gone = plan.select("path").join(there.select("path"), "path", "left_anti").withColumn("problem", F.lit("not_published"))
    return gone.unionByName(there.select("path").join(plan.select("path"), "path", "left_anti").withColumn("problem", F.lit("not_planned")))


@query(f"WITH RECURSIVE {ELIGIBLE_SQL} SELECT s.path FROM samples s JOIN eligible e USING (sample_id) WHERE e.outcome <> 'included'")
def rewrite_preview_paths(spark: S, sf: str) -> DataFrame:
    stay = eligible(spark, sf).where("outcome = 'included'").select("sample_id")
    return samples(spark, sf).select("sample_id", "path").join(stay, "sample_id", "left_anti").select("path")


@query("SELECT s.sample_id, s.path, t.txt FROM samples s LEFT JOIN (SELECT regexp_replace(path, '\\.[^.]+$', '.txt') AS txt FROM samples WHERE sample_id % 3 = 0) t ON t.txt = regexp_replace(s.path, '\\.[^.]+$', '.txt')")
def annotation_pairs(spark: S, sf: str) -> DataFrame:
    stem = F.regexp_replace("path", r"\.[^.]+$", "")
    s = samples(spark, sf).select("sample_id", "path", stem.alias("stem"))
    notes = s.where("sample_id % 3 = 0").select("stem", F.concat("stem", F.lit(".txt")).alias("txt"))
    return s.join(notes, "stem", "left").select("sample_id", "path", "txt")


MATCH_SQL = """WITH e AS (SELECT doc_id AS entry, CASE WHEN doc_id % 4 = 0 THEN upper(p) WHEN doc_id % 4 = 1 THEN 'moved/' || string_split(p, '/')[-1] ELSE 'moved/n' || CAST(doc_id % 20 AS VARCHAR) || '.png' END AS key FROM (SELECT doc_id, (SELECT path FROM samples WHERE sample_id = doc_id) AS p FROM documents)),
  f AS (SELECT sample_id, lower(path) AS lp, lower(string_split(path, '/')[-1]) AS name FROM samples), u AS (SELECT name, min(sample_id) AS sample_id FROM f GROUP BY name HAVING count(*) = 1)
  SELECT e.entry, coalesce(f.sample_id, u.sample_id) AS sample_id, CASE WHEN f.sample_id IS NOT NULL THEN 'path' WHEN u.sample_id IS NOT NULL THEN 'name' ELSE 'none' END AS how FROM e LEFT JOIN f ON f.lp = lower(e.key) LEFT JOIN u ON u.name = lower(string_split(e.key, '/')[-1])"""


@query(MATCH_SQL)
def exact_or_unique_name_match(spark: S, sf: str) -> DataFrame:
    """By path without case, else by a file name that only one sample has."""
    s = samples(spark, sf).select("sample_id", "path")
    name = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    i, p = F.col("sample_id"), F.col("path")
    key = F.when(i % 4 == 0, F.upper(p)).when(i % 4 == 1, F.concat(F.lit("moved/"), F.element_at(F.split(p, "/"), -1))).otherwise(F.concat(F.lit("moved/n"), (i % 20).cast("string"), F.lit(".png")))
    e = s.select(i.alias("entry"), F.lower(key).alias("lp"), name(key).alias("name"))
    exact = s.select(F.lower("path").alias("lp"), i.alias("by_path"))
    once = s.select(name(p).alias("name"), "sample_id").groupBy("name").agg(n_rows().alias("n"), F.min("sample_id").alias("by_name")).where("n = 1").drop("n")
    how = F.when(F.col("by_path").isNotNull(), "path").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return e.join(exact, "lp", "left").join(once, "name", "left").select("entry", F.coalesce("by_path", "by_name").alias("sample_id"), how.alias("how"))
