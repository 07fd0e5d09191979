"""Scans, evidence policies, metrics and resolution assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query
from quarrykit.plans.domain import areas, evidence, evidence_row, samples, scores
from quarrykit.sources.tables import table

S = SparkSession
RESOLUTIONS = (512, 768, 1024, 1216, 1536)


@query("SELECT sample_id, path, CASE WHEN strpos(path, '/') > 0 THEN split_part(path, '/', 1) ELSE '__root__' END AS scope FROM samples")
def scan_scope_from_path(spark: S, sf: str) -> DataFrame:
    parts = F.split("path", "/")
    return samples(spark, sf).select("sample_id", "path", F.when(F.size(parts) > 1, parts[0]).otherwise("__root__").alias("scope"))


@query("SELECT CAST(len(string_split(path, '/')) - 1 AS INT) AS depth, count(*) AS n, min(path) AS example, len(string_split(path, '/')) - 1 >= 3 AS too_deep FROM samples GROUP BY ALL")
def layout_depth_audit(spark: S, sf: str) -> DataFrame:
    return samples(spark, sf).groupBy((F.size(F.split("path", "/")) - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("example")).withColumn("too_deep", F.col("depth") >= 3)


UNSAFE = r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:|\\"


@query("SELECT page_id, p AS path, regexp_matches(p, '(^|/)\\.\\.(/|$)|^/|^[A-Za-z]:|\\\\') AS unsafe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../' || split_part(url, '://', 2) WHEN 1 THEN '/' || split_part(url, '://', 2) ELSE split_part(url, '://', 2) END AS p FROM pages)")
def unsafe_path_filter(spark: S, sf: str) -> DataFrame:
    rest, i = F.split_part("url", F.lit("://"), F.lit(2)), F.col("page_id") % 4
    p = table(spark, sf, "pages").select("page_id", F.when(i == 0, F.concat(F.lit("../"), rest)).when(i == 1, F.concat(F.lit("/"), rest)).otherwise(rest).alias("path"))
    return p.withColumn("unsafe", F.col("path").rlike(UNSAFE))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def embedding_subset_semi(spark: S, sf: str) -> DataFrame:
    want = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id", "label").join(want, "vec_id", "left_semi")


@query("""WITH c AS (SELECT doc_id AS k FROM documents WHERE doc_id % 3 <> 0), s AS (SELECT doc_id AS k FROM documents WHERE doc_id % 5 <> 0), t AS (SELECT doc_id AS k FROM documents WHERE doc_id % 7 <> 0),
  j AS (SELECT coalesce(c.k, s.k, t.k) AS entry_key, c.k IS NOT NULL AS in_catalog, s.k IS NOT NULL AS in_sidecar, t.k IS NOT NULL AS in_shard FROM c FULL JOIN s ON c.k = s.k FULL JOIN t ON t.k = coalesce(c.k, s.k))
  SELECT * FROM j WHERE NOT (in_catalog AND in_sidecar AND in_shard)""")
def catalog_sidecar_reconcile(spark: S, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("entry_key"))
    parts = [d.where(f"entry_key % {m} <> 0").withColumn("part", F.lit(p)) for m, p in ((3, "in_catalog"), (5, "in_sidecar"), (7, "in_shard"))]
    seen = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("entry_key")  # one shuffle instead of two full joins
    out = seen.agg(*[F.bool_or(F.col("part") == p).alias(p) for p in ("in_catalog", "in_sidecar", "in_shard")])
    return out.where("NOT (in_catalog AND in_sidecar AND in_shard)")


@query("SELECT s.sample_id, replace('{stem}_latent.npz', '{stem}', regexp_replace(s.path, '\\.[^.]+$', '')) AS expected, f.file IS NOT NULL AS found FROM samples s LEFT JOIN (SELECT regexp_replace(path, '\\.[^.]+$', '') || '_latent.npz' AS file FROM samples WHERE sample_id % 3 = 0) f ON f.file = regexp_replace(s.path, '\\.[^.]+$', '') || '_latent.npz'")
def pattern_pair_join(spark: S, sf: str) -> DataFrame:
    s = samples(spark, sf)
    stem = F.regexp_replace("path", r"\.[^.]+$", "")
    files = s.where("sample_id % 3 = 0").select(F.concat(stem, F.lit("_latent.npz")).alias("file"))
    want = s.select("sample_id", F.replace(F.lit("{stem}_latent.npz"), F.lit("{stem}"), stem).alias("expected"))
    return want.join(files, F.col("expected") == F.col("file"), "left").select("sample_id", "expected", F.col("file").isNotNull().alias("found"))


@query("""SELECT item_id, length(text) AS n, count(*) OVER (PARTITION BY sha256(text)) > 1 AS repeated_hash, length(text) < 50 AS too_short,
  CASE WHEN count(*) OVER (PARTITION BY sha256(text)) > 1 THEN 'duplicate_hash' WHEN length(text) < 50 THEN 'short' ELSE 'ok' END AS verdict FROM benchmark""")
def manifest_rule_audit(spark: S, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").withColumn("sha", F.sha2("text", 256))
    n = b.groupBy("sha").agg((F.count(F.lit(1)) > 1).alias("repeated_hash"))
    b = b.join(n, "sha").select("item_id", F.length("text").cast("long").alias("n"), "repeated_hash", (F.length("text") < 50).alias("too_short"))
    return b.withColumn("verdict", F.when(F.col("repeated_hash"), "duplicate_hash").when(F.col("too_short"), "short").otherwise("ok"))


@query("SELECT sample_id, w, h, area FROM areas WHERE area > 0")
def canonical_area(spark: S, sf: str) -> DataFrame:
    return areas(spark, sf).where("area > 0").select("sample_id", "w", "h", "area")


@query("SELECT doc_id AS sample_id, aes_source AS source, aes AS value, 'aesthetic' AS code, 'info' AS severity FROM scores WHERE aes IS NOT NULL UNION ALL SELECT doc_id, aes_source, aes / 5.0, 'in_domain', CASE WHEN aes / 5.0 >= 0.5 THEN 'info' ELSE 'high' END FROM scores WHERE aes IS NOT NULL")
def evidence_policy_aesthetic(spark: S, sf: str) -> DataFrame:
    p = F.col("aes") / 5.0
    rows = F.array(F.struct(F.col("aes").alias("value"), F.lit("aesthetic").alias("code"), F.lit("info").alias("severity")), F.struct(p.alias("value"), F.lit("in_domain").alias("code"), F.when(p >= 0.5, "info").otherwise("high").alias("severity")))
    return scores(spark, sf).where("aes IS NOT NULL").select(F.col("doc_id").alias("sample_id"), F.col("aes_source").alias("source"), F.inline(rows))


@query("SELECT doc_id AS sample_id, ai AS value, 0.5::DOUBLE AS threshold, CASE WHEN ai >= 0.5 THEN 'high' ELSE 'info' END AS severity, true AS review_only FROM scores")
def evidence_policy_ai(spark: S, sf: str) -> DataFrame:
    return scores(spark, sf).select(F.col("doc_id").alias("sample_id"), F.col("ai").alias("value"), F.lit(0.5).alias("threshold"), F.when(F.col("ai") >= 0.5, "high").otherwise("info").alias("severity"), F.lit(True).alias("review_only"))


@query("SELECT doc_id AS sample_id, wm AS value, CASE WHEN wm >= 0.995 THEN 'medium' ELSE 'info' END AS severity, wm >= 0.995 AS candidate FROM scores")
def evidence_policy_watermark(spark: S, sf: str) -> DataFrame:
    hit = F.col("wm") >= 0.995
    return scores(spark, sf).select(F.col("doc_id").alias("sample_id"), F.col("wm").alias("value"), F.when(hit, "medium").otherwise("info").alias("severity"), hit.alias("candidate"))


@query("""WITH b AS (SELECT doc_id AS sample_id, unnest(range(0, doc_id % 4)) AS k FROM documents), r AS (SELECT sample_id, k, (10 * k)::DOUBLE AS x0, 0.0::DOUBLE AS y0, (10 * k + 5 + sample_id % 50)::DOUBLE AS x1, 20.0::DOUBLE AS y1 FROM b),
  a AS (SELECT sample_id, least(1.0, sum((x1 - x0) * (y1 - y0)) / 4000.0) AS ratio, count(*) AS boxes FROM r GROUP BY sample_id)
  SELECT r.sample_id, r.k AS box, x0, x1, round(ratio, 9) AS area_ratio, boxes, CASE WHEN ratio >= 0.25 THEN 'medium' ELSE 'info' END AS severity FROM r JOIN a USING (sample_id)""")
def evidence_policy_ocr(spark: S, sf: str) -> DataFrame:
    n = (F.col("doc_id") % 4).cast("long")
    boxes = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct(k.alias("box"), (10 * k).cast("double").alias("x0"), (10 * k + 5 + F.col("doc_id") % 50).cast("double").alias("x1"))))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), boxes.alias("b")).where("b IS NOT NULL")
    total = F.aggregate("b", F.lit(0.0), lambda acc, x: acc + (x["x1"] - x["x0"]) * 20.0)
    d = d.withColumns({"ratio": F.least(F.lit(1.0), total / 4000.0), "boxes": F.size("b").cast("long")})
    return d.select("sample_id", F.inline("b"), F.round("ratio", 9).alias("area_ratio"), "boxes", F.when(F.col("ratio") >= 0.25, "medium").otherwise("info").alias("severity"))


@query("SELECT severity_before, severity_after, count(*) AS n FROM (SELECT severity AS severity_before, CASE WHEN value >= 0.8 THEN 'medium' ELSE 'info' END AS severity_after FROM evidence WHERE code = 'watermark') GROUP BY ALL")
def watermark_reclassify(spark: S, sf: str) -> DataFrame:
    e = evidence(spark, sf).where("code = 'watermark'").select(F.col("severity").alias("severity_before"), F.when(F.col("value") >= 0.8, "medium").otherwise("info").alias("severity_after"))
    return e.groupBy("severity_before", "severity_after").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT code, severity, count(*) AS n FROM evidence GROUP BY ALL")
def evidence_histogram(spark: S, sf: str) -> DataFrame:
    return evidence(spark, sf).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sample_id, code, source, value, nth FROM evidence WHERE source <> 'aes_old' AND code = 'aesthetic' UNION ALL SELECT doc_id, 'aesthetic', 'aes_old', 2.0, 9 FROM labels WHERE doc_id % 31 = 0")
def evidence_replace_by_source(spark: S, sf: str) -> DataFrame:
    old = evidence(spark, sf).where("code = 'aesthetic'").select("sample_id", "code", "source", "value", "nth")
    new = scores(spark, sf).where("doc_id % 31 = 0").select(*evidence_row("aesthetic", F.lit("aes_old"), F.lit(2.0), F.lit(3.0), F.lit("high"), False, 9)).select(*old.columns)
    return old.join(F.broadcast(spark.createDataFrame([("aes_old",)], "source string")), "source", "left_anti").select(*new.columns).unionByName(new)


@query("SELECT count(*) AS processed, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'hard_reject') AS hard_rejected, count(*) FILTER (state IN ('decode_error', 'metric_error')) AS decode_errors, count(*) FILTER (state = 'source_changed') AS source_changed FROM samples")
def scan_counters(spark: S, sf: str) -> DataFrame:
    c = lambda *x: F.count_if(F.col("state").isin(*x))
    return samples(spark, sf).agg(F.count(F.lit(1)).alias("processed"), c("valid").alias("valid"), c("hard_reject").alias("hard_rejected"), c("decode_error", "metric_error").alias("decode_errors"), c("source_changed").alias("source_changed"))


@query("SELECT count(*) FILTER (code = 'text_length') AS metrics, (SELECT count(*) FROM samples) AS samples, count(*) FILTER (code = 'text_length') = (SELECT count(*) FROM samples) AS complete FROM evidence")
def metric_count(spark: S, sf: str) -> DataFrame:
    e = evidence(spark, sf).agg(F.count_if(F.col("code") == "text_length").alias("metrics"))
    n = samples(spark, sf).agg(F.count(F.lit(1)).alias("samples"))
    return e.join(F.broadcast(n)).withColumn("complete", F.col("metrics") == F.col("samples"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("""WITH c AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch FROM documents), f AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch BETWEEN 'a' AND 'z' GROUP BY ALL), t AS (SELECT doc_id, sum(n)::DOUBLE AS total FROM f GROUP BY 1)
  SELECT doc_id AS sample_id, round(-sum(n / total * log2(n / total)), 6) + 0.0 AS entropy FROM f JOIN t USING (doc_id) GROUP BY 1""")
def metric_entropy(spark: S, sf: str) -> DataFrame:
    low = F.lower("text")
    counts = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.filter(counts, lambda x: x > 0).alias("c")).where(F.size("c") > 0)
    d = d.withColumn("t", F.aggregate("c", F.lit(0.0), lambda a, x: a + x))
    return d.select("sample_id", (F.round(-F.aggregate("c", F.lit(0.0), lambda a, x: a + x / F.col("t") * F.log2(x / F.col("t"))), 6) + 0.0).alias("entropy"))


@query("SELECT doc_id AS sample_id, round((length(text) - length(replace(text, ' ', ''))) / length(text)::DOUBLE, 6) AS blank_ratio, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text)::DOUBLE, 6) AS digit_ratio FROM documents WHERE length(text) > 0")
def metric_ratio(spark: S, sf: str) -> DataFrame:
    n = F.length("text").cast("double")
    return table(spark, sf, "documents").where("length(text) > 0").select(F.col("doc_id").alias("sample_id"), F.round((n - F.length(F.replace("text", F.lit(" "), F.lit("")))) / n, 6).alias("blank_ratio"), F.round(F.length(F.regexp_replace("text", "[^0-9]", "")) / n, 6).alias("digit_ratio"))


@query("SELECT source AS scope, round(stddev_pop(n_chars), 6) AS std, round(avg(n_chars), 6) AS mean, count(*) AS n FROM documents GROUP BY source")
def metric_std(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.col("source").alias("scope")).agg(F.round(F.stddev_pop("n_chars"), 6).alias("std"), F.round(F.avg("n_chars"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS sample_id, 'aesthetic' AS code, aes AS value FROM scores WHERE aes IS NOT NULL UNION ALL SELECT doc_id, 'ai', ai FROM scores UNION ALL SELECT doc_id, 'watermark', wm FROM scores")
def metrics_long(spark: S, sf: str) -> DataFrame:
    wide = scores(spark, sf).select(F.col("doc_id").alias("sample_id"), F.col("aes").alias("aesthetic"), "ai", F.col("wm").alias("watermark"))
    return wide.unpivot("sample_id", ["aesthetic", "ai", "watermark"], "code", "value").where("value IS NOT NULL")


JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def number_of(json: Column) -> Column:
    """The number that a JSON text is, as a double; null for texts, booleans, null, lists and objects."""
    return F.when(json.rlike(JSON_NUMBER), json.try_cast("double"))


MIXED = ("1.5", "true", '"7"', "null", "[1]", "-2e3", '{"a": 1}', "07", "3")


@query(f"""SELECT doc_id AS sample_id, j AS value_json, CASE WHEN regexp_matches(j, '{JSON_NUMBER}') THEN try_cast(j AS DOUBLE) END AS value_number FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN CAST(n_chars AS VARCHAR) ELSE [{", ".join(repr(x) for x in MIXED)}][doc_id % 10 + 1] END AS j FROM documents)""")
def numeric_shadow(spark: S, sf: str) -> DataFrame:
    """A number column beside mixed JSON values."""
    i = (F.col("doc_id") % 10).cast("int")
    j = F.when(i == 9, F.col("n_chars").cast("string")).otherwise(F.get(F.array(*map(F.lit, MIXED)), i))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), j.alias("value_json")).withColumn("value_number", number_of(F.col("value_json")))


@query("SELECT doc_id AS sample_id, CASE WHEN wm < 0.5 THEN 'clean' ELSE 'watermark' END AS label, round(greatest(wm, 1 - wm), 9) AS p, len(list_filter([1 - wm, wm], lambda x: x >= 0.25))::INT AS likely FROM scores")
def label_probabilities(spark: S, sf: str) -> DataFrame:
    """A map from label to probability; its largest entry, and how many labels are likely."""
    m = F.map_from_arrays(F.array(F.lit("clean"), F.lit("watermark")), F.array(1 - F.col("wm"), F.col("wm")))
    t = scores(spark, sf).select(F.col("doc_id").alias("sample_id"), m.alias("m"))
    top = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("label"))))
    return t.select("sample_id", top["label"].alias("label"), F.round(top["p"], 9).alias("p"), F.size(F.map_filter("m", lambda _, p: p >= 0.25)).alias("likely"))


@query("SELECT sample_id, r AS resolution, area >= r * r AS area_pass FROM areas, (VALUES (512), (768), (1024), (1216), (1536)) t(r)")
def resolution_area_pass(spark: S, sf: str) -> DataFrame:
    r = F.col("resolution")
    return areas(spark, sf).select("sample_id", "area", F.explode(F.array(*map(F.lit, RESOLUTIONS))).alias("resolution")).select("sample_id", "resolution", (F.col("area") >= r * r).alias("area_pass"))


BUCKET_SQL = """SELECT r, bw, bh FROM (SELECT r, lo, hi, bw, unnest([b - 64, b, b + 64]) AS bh FROM (SELECT r, lo, hi, bw, greatest(lo, (r * r // bw) // 64 * 64) AS b FROM (SELECT r, lo, hi, unnest(range(lo, hi + 1, 64)) AS bw
  FROM (SELECT r, greatest(64, least(256, r // 4) // 64 * 64) AS lo, greatest(r, (2 * r) // 64 * 64) AS hi FROM (VALUES (512), (768), (1024), (1216), (1536)) t(r))))) WHERE bh BETWEEN lo AND hi AND bw * bh <= r * r"""


def _buckets(spark: S) -> DataFrame:
    """Candidate sizes of each resolution: a few hundred rows, whatever the data.

    Sides are multiples of 64 from a quarter of the resolution (256 at most) to twice the resolution; of each width the heights around the
    one that fills the area.
    """
    r = spark.createDataFrame([(x,) for x in RESOLUTIONS], "r long").withColumns({"lo": F.expr("greatest(64L, least(256L, r div 4) div 64 * 64)"), "hi": F.expr("greatest(r, (2 * r) div 64 * 64)")})
    r = r.withColumn("bw", F.explode(F.expr("sequence(lo, hi, 64L)")))
    base = F.expr("greatest(lo, (r * r div bw) div 64 * 64)")
    return r.withColumn("bh", F.explode(F.array(base - 64, base, base + 64))).where("bh BETWEEN lo AND hi AND bw * bh <= r * r").select("r", "bw", "bh")


@query(f"SELECT CAST(r AS BIGINT) AS resolution, CAST(bw AS BIGINT) AS bucket_w, CAST(bh AS BIGINT) AS bucket_h FROM ({BUCKET_SQL})")
def resolution_buckets(spark: S, sf: str) -> DataFrame:
    return _buckets(spark).select(F.col("r").alias("resolution"), F.col("bw").alias("bucket_w"), F.col("bh").alias("bucket_h"))


CHOSEN_SQL = f"""WITH b AS ({BUCKET_SQL}), shapes AS (SELECT DISTINCT w, h FROM areas), c AS (SELECT w, h, r, bw, bh, row_number() OVER (PARTITION BY w, h, r ORDER BY round(abs(ln((bw::DOUBLE / bh) / (w::DOUBLE / h))), 12), r * r - bw * bh, bw, bh) AS rn FROM shapes, b),
  a AS (SELECT sample_id, w, h, c.r, bw, bh, greatest(bw::DOUBLE / w, bh::DOUBLE / h) AS scale, w * h >= c.r * c.r AS area_pass FROM areas JOIN c USING (w, h) WHERE rn = 1)"""


def _assessed(spark: S, sf: str) -> DataFrame:
    """Each sample's best bucket at each resolution; buckets are chosen once for each distinct shape, of which there are few."""
    s = areas(spark, sf)
    shapes = s.select("w", "h").distinct()
    off = F.round(F.abs(F.ln((F.col("bw").cast("double") / F.col("bh")) / (F.col("w").cast("double") / F.col("h")))), 12)
    best = shapes.join(F.broadcast(_buckets(spark))).groupBy("w", "h", "r").agg(F.min(F.struct(off.alias("off"), (F.col("r") * F.col("r") - F.col("bw") * F.col("bh")).alias("unused"), "bw", "bh")).alias("b"))
    a = s.join(best, ["w", "h"]).select("sample_id", "w", "h", "r", "b.bw", "b.bh", (F.col("area") >= F.col("r") * F.col("r")).alias("area_pass"))
    return a.withColumn("scale", F.greatest(F.col("bw").cast("double") / F.col("w"), F.col("bh").cast("double") / F.col("h")))


@query(CHOSEN_SQL + " SELECT sample_id, CAST(r AS BIGINT) AS resolution, CAST(bw AS BIGINT) AS bucket_w, CAST(bh AS BIGINT) AS bucket_h, round(greatest(1.0, scale), 9) AS upscale, round(least(1.0, greatest(0.0, 1 - (bw * bh) / (w * scale * h * scale))), 9) AS crop_loss, area_pass AS eligible FROM a")
def resolution_assess(spark: S, sf: str) -> DataFrame:
    crop = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (F.col("bw") * F.col("bh")) / (F.col("w") * F.col("scale") * F.col("h") * F.col("scale"))))
    return _assessed(spark, sf).select("sample_id", F.col("r").alias("resolution"), F.col("bw").alias("bucket_w"), F.col("bh").alias("bucket_h"), F.round(F.greatest(F.lit(1.0), "scale"), 9).alias("upscale"), F.round(crop, 9).alias("crop_loss"), F.col("area_pass").alias("eligible"))


@query(CHOSEN_SQL + """ SELECT sample_id, CAST(r AS BIGINT) AS resolution, concat_ws(',', CASE WHEN NOT area_pass THEN 'area_below_resolution' END, CASE WHEN greatest(w, h)::DOUBLE / least(w, h) > 4 THEN 'extreme_aspect_ratio' END,
  CASE WHEN 1 - (bw * bh) / (w * scale * h * scale) > 0.35 THEN 'high_crop_loss' END, CASE WHEN scale > 1.001 THEN 'upscale_required' END) AS risk_codes FROM a""")
def resolution_risk_codes(spark: S, sf: str) -> DataFrame:
    crop = 1 - (F.col("bw") * F.col("bh")) / (F.col("w") * F.col("scale") * F.col("h") * F.col("scale"))
    codes = F.array(F.when(~F.col("area_pass"), "area_below_resolution"), F.when(F.greatest("w", "h").cast("double") / F.least("w", "h") > 4, "extreme_aspect_ratio"), F.when(crop > 0.35, "high_crop_loss"), F.when(F.col("scale") > 1.001, "upscale_required"))
    return _assessed(spark, sf).select("sample_id", F.col("r").alias("resolution"), F.array_join(F.array_compact(codes), ",").alias("risk_codes"))
