"""Duplicate groups: exact, perceptual (144-bit hashes by band join), semantic, and electing representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators.graph import connected_components
from quarrykit.plans.catalog import query
from quarrykit.plans.domain import areas, evidence, overlay, samples, vectors
from quarrykit.sources.tables import table

S = SparkSession


def n_rows() -> Column:
    return F.count(F.lit(1))
BITS = 8

EXACT_SQL = """SELECT sha, substr(sha256('exact:' || string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY sample_id)), 1, 24) AS group_key, min(sample_id) AS representative, count(*) AS size FROM samples GROUP BY sha HAVING count(*) > 1"""


def group_key(kind: str, ids: Column) -> Column:
    """A name that depends on the sorted members only."""
    text = F.array_join(F.transform(F.array_sort(ids), lambda x: x.cast("string")), ",")
    return F.substring(F.sha2(F.concat(F.lit(kind + ":"), text), 256), 1, 24)


def exact_groups(spark: S, sf: str) -> DataFrame:
    s = samples(spark, sf)
    many = s.groupBy("sha").agg(n_rows().alias("size"), F.min("sample_id").alias("representative")).where("size > 1")
    members = s.join(many.select("sha"), "sha", "left_semi").groupBy("sha").agg(group_key("exact", F.collect_list("sample_id")).alias("group_key"))  # ids of duplicates only
    return many.join(members, "sha").select("sha", "group_key", "representative", "size")


@query(EXACT_SQL)
def dup_exact(spark: S, sf: str) -> DataFrame:
    return exact_groups(spark, sf)


@query(f"SELECT s.sample_id, g.group_key, 'duplicate_exact' AS code, CAST(g.size AS DOUBLE) AS value, 'info' AS severity, true AS review_only FROM samples s JOIN ({EXACT_SQL}) g USING (sha)")
def dup_evidence(spark: S, sf: str) -> DataFrame:
    g = exact_groups(spark, sf)
    return samples(spark, sf).join(g, "sha").select("sample_id", "group_key", F.lit("duplicate_exact").alias("code"), F.col("size").cast("double").alias("value"), F.lit("info").alias("severity"), F.lit(True).alias("review_only"))


@query(f"SELECT s.sample_id, g.representative FROM samples s JOIN ({EXACT_SQL}) g USING (sha) WHERE s.sample_id <> g.representative")
def dup_non_representatives(spark: S, sf: str) -> DataFrame:
    return samples(spark, sf).join(exact_groups(spark, sf), "sha").where("sample_id <> representative").select("sample_id", "representative")


HASH_SQL = """hashes AS (SELECT doc_id AS sample_id, list_transform(range(0, 9), lambda i: xor(CAST(CAST('0x' || substr(md5(CAST(doc_id // 3 AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 4) AS BIGINT) AS BIGINT), CASE WHEN doc_id % 3 = 1 AND i = doc_id % 9 THEN CAST(1 << CAST(doc_id % 16 AS INT) AS BIGINT) WHEN doc_id % 3 = 2 AND i < 2 THEN 65535 ELSE 0 END)) AS p, xor(CAST('0x' || substr(md5(CAST(doc_id // 3 AS VARCHAR) || 'c'), 1, 4) AS BIGINT), CASE WHEN doc_id % 3 = 1 THEN 3 ELSE 0 END) AS c FROM documents)"""
PAIRS_SQL = HASH_SQL + """, pairs AS (SELECT a.sample_id AS a, b.sample_id AS b, CAST(list_sum(list_transform(range(1, 10), lambda i: bit_count(xor(a.p[i], b.p[i])))) AS INT) AS distance FROM hashes a JOIN hashes b ON a.sample_id < b.sample_id
  AND bit_count(xor(a.c, b.c)) <= 8 AND list_sum(list_transform(range(1, 10), lambda i: bit_count(xor(a.p[i], b.p[i])))) <= 8)"""


def hashes(spark: S, sf: str) -> DataFrame:
    """Nine 16-bit bands of a 144-bit hash, and a 16-bit colour hash; two of three neighbours are near each other."""
    i = F.col("doc_id")
    part = lambda k: F.conv(F.substring(F.md5(F.concat(F.floor(i / 3).cast("string"), k)), 1, 4), 16, 10).cast("long")
    flip = lambda k: F.when((i % 3 == 1) & (i % 9 == k), F.call_function("shiftleft", F.lit(1).cast("long"), (i % 16).cast("int"))).when((i % 3 == 2) & F.lit(k < 2), F.lit(65535).cast("long")).otherwise(F.lit(0).cast("long"))
    bands = F.array(*[part(F.lit(f":{k}")).bitwiseXOR(flip(k)) for k in range(9)])
    return table(spark, sf, "documents").select(i.alias("sample_id"), bands.alias("p"), part(F.lit("c")).bitwiseXOR(F.when(i % 3 == 1, 3).otherwise(0).cast("long")).alias("c"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def near_hash_pairs(h: DataFrame) -> DataFrame:
    """Pairs within 8 bits: of nine bands one is equal at least, so an equi-join on (band, value) misses none.

    Equal hashes are one node of the join, so a hash that many samples share joins once; ``hash_members`` has the samples behind it.
    A pair is taken at its first equal band.
    """
    one = h.groupBy("p", "c").agg(F.min("sample_id").alias("rep"))
    band = one.select("rep", "p", "c", F.posexplode("p").alias("band", "value"))
    x, y = band.alias("x"), band.alias("y")
    first = F.array_position(F.zip_with("x.p", "y.p", lambda a, b: a == b), F.lit(True)) - 1
    near = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.rep") < F.col("y.rep"))).where(first == F.col("x.band"))
    near = near.withColumn("distance", hamming(F.col("x.p"), F.col("y.p"))).where((F.col("distance") <= BITS) & (F.bit_count(F.col("x.c").bitwiseXOR(F.col("y.c"))) <= BITS))
    return near.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), "distance")


def hash_members(h: DataFrame) -> DataFrame:
    """(rep, sample_id): each sample with the least one of equal hashes."""
    return h.join(h.groupBy("p", "c").agg(F.min("sample_id").alias("rep")), ["p", "c"]).select("rep", "sample_id")


def visual_edges(h: DataFrame) -> DataFrame:
    """(a, b) that connect all samples near each other: near representatives, and each of them with its copies."""
    copies = hash_members(h).where("rep <> sample_id").select(F.col("rep").alias("a"), F.col("sample_id").alias("b"))
    return near_hash_pairs(h).select("a", "b").unionByName(copies)


def all_near_pairs(h: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of samples within 8 bits, copies too: as many rows as there are such pairs."""
    m = hash_members(h)
    x, y = m.select(F.col("rep").alias("a"), F.col("sample_id").alias("s")), m.select(F.col("rep").alias("b"), F.col("sample_id").alias("t"))
    near = near_hash_pairs(h).join(x, "a").join(y, "b").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "distance")
    same = x.join(y, x["a"] == y["b"]).where("s < t").select(F.col("s").alias("a"), F.col("t").alias("b"), F.lit(0).alias("distance"))
    return near.unionByName(same)


@query("WITH " + PAIRS_SQL + " SELECT * FROM pairs")
def visual_pairs(spark: S, sf: str) -> DataFrame:
    return all_near_pairs(hashes(spark, sf))


@query("WITH RECURSIVE " + PAIRS_SQL + ", e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), r AS (SELECT a AS n, a AS m FROM e UNION SELECT e.a, r.m FROM e JOIN r ON e.b = r.n) SELECT n AS sample_id, min(m) AS component FROM r GROUP BY n")
def dup_visual(spark: S, sf: str) -> DataFrame:
    return connected_components(visual_edges(hashes(spark, sf))).select(F.col("node").alias("sample_id"), "component")


SEM_SQL = "semantic AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS score FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.35)"


def similar_vectors(v: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """Pairs of one label with a cosine over the threshold.

    A label's vectors are cut in blocks by a hash; each pair of blocks is a task of its own, joined as two matrices there, so that a large label is
    spread out and no row is made for a pair that isn't similar.
    """
    import numpy as np
    import pandas as pd

    size = v.groupBy("label").agg(F.ceil(n_rows() / block).cast("int").alias("blocks"))
    t = v.join(F.broadcast(size), "label").withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("blk")).alias("i"), F.greatest(k, F.col("blk")).alias("j")))
    t = t.withColumn("p", F.explode(pairs)).select("label", "p.i", "p.j", "blk", "vec_id", "v")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        i, j = g["i"].iloc[0], g["j"].iloc[0]
        x, y = g[g["blk"] == i], g[g["blk"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": "int64", "b": "int64"})
        s = np.stack(x["v"]) @ np.stack(y["v"]).T
        r, c = np.nonzero(s >= threshold)
        a, b, s = x["vec_id"].to_numpy()[r], y["vec_id"].to_numpy()[c], s[r, c]
        keep = a < b if i == j else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": s[keep]})

    return t.groupBy("label", "i", "j").applyInPandas(run, "a long, b long, score double")


@query("WITH " + SEM_SQL + " SELECT a, b, round(score, 6) AS score FROM semantic")
def semantic_pairs(spark: S, sf: str) -> DataFrame:
    return similar_vectors(vectors(spark, sf), 0.35).select("a", "b", F.round("score", 6).alias("score"))


@query("WITH RECURSIVE " + SEM_SQL + ", e AS (SELECT a, b, score FROM semantic UNION ALL SELECT b, a, score FROM semantic), r AS (SELECT a AS n, a AS m FROM e UNION SELECT e.a, r.m FROM e JOIN r ON e.b = r.n) SELECT r.n AS sample_id, min(r.m) AS component, round(max(s.best), 6) AS score FROM r JOIN (SELECT a, max(score) AS best FROM e GROUP BY a) s ON s.a = r.n GROUP BY r.n")
def dup_semantic(spark: S, sf: str) -> DataFrame:
    from quarrykit.plans.storage import staged

    p = staged(similar_vectors(vectors(spark, sf), 0.35), "semantic")
    ends = p.select(F.explode(F.array("a", "b")).alias("sample_id"), "score").groupBy("sample_id").agg(F.round(F.max("score"), 6).alias("score"))
    return connected_components(p.select("a", "b")).select(F.col("node").alias("sample_id"), "component").join(ends, "sample_id")


@query("""WITH d AS (SELECT sample_id, sha, scope, area, coalesce(decision, 'pending_review') AS decision FROM areas LEFT JOIN overlay USING (sample_id)),
  g AS (SELECT sha, count(*) AS size, count(*) FILTER (decision = 'pending_review') AS pending, count(*) FILTER (decision = 'approved_exclude') AS excluded, max(area) AS largest, bool_or(scope = 'src0') AS in_folder FROM d GROUP BY sha HAVING count(*) > 1)
  SELECT sha, size, pending, excluded, size - excluded AS retained, largest, pending > 0 AS unresolved FROM g WHERE in_folder""")
def duplicate_group_audit(spark: S, sf: str) -> DataFrame:
    """A folder's filter keeps whole groups: a group is in if any member is in the folder."""
    d = areas(spark, sf).join(overlay(spark, sf), "sample_id", "left").withColumn("decision", F.coalesce("decision", F.lit("pending_review")))
    g = d.groupBy("sha").agg(n_rows().alias("size"), F.count_if(F.col("decision") == "pending_review").alias("pending"), F.count_if(F.col("decision") == "approved_exclude").alias("excluded"), F.max("area").alias("largest"), F.bool_or(F.col("scope") == "src0").alias("in_folder"))
    return g.where("size > 1 AND in_folder").select("sha", "size", "pending", "excluded", (F.col("size") - F.col("excluded")).alias("retained"), "largest", (F.col("pending") > 0).alias("unresolved"))


MEMBERS_SQL = """WITH seen AS (SELECT sample_id, sha, unnest(CASE WHEN sample_id % 5 = 0 THEN [1.0, 0.5] WHEN sample_id % 5 = 1 THEN [NULL, 0.75] ELSE [1.0] END)::DOUBLE AS score, unnest(CASE WHEN sample_id % 5 < 2 THEN [0, 1] ELSE [0] END) AS nth FROM samples),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha, sample_id ORDER BY score DESC NULLS LAST, nth) AS rn, count(DISTINCT sample_id) OVER (PARTITION BY sha) AS size FROM seen) WHERE rn = 1 AND size > 1),
  numbered AS (SELECT *, dense_rank() OVER (ORDER BY sha) AS nth_group FROM best)
  SELECT sha, b.sample_id, b.size, b.score, CAST(b.nth AS INT) AS evidence_nth, a.area, array_to_string(list_filter([512, 768, 1024, 1216, 1536], lambda r: a.area >= r * r), ',') AS resolutions, coalesce(o.decision, 'pending_review') AS decision
  FROM numbered b JOIN areas a USING (sample_id, sha) LEFT JOIN overlay o ON o.sample_id = b.sample_id WHERE b.nth_group BETWEEN 6 AND 10"""


def best_evidence(rows: DataFrame, by: tuple[str, ...], score: str, nth: str) -> DataFrame:
    """Of each key the row of the highest score (null: lowest), of equals the first; one aggregate, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in by]
    rank = F.struct(F.col(score).isNull(), -F.col(score), F.col(nth))
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(*by, "r.*")


@query(MEMBERS_SQL)
def duplicate_group_page(spark: S, sf: str) -> DataFrame:
    """The second page of five duplicate groups, whole groups in order of their key: each member's best evidence, its resolutions and its decision.

    Paging is the feature: the page's keys are found first (a top-k over keys), and only their members are looked up.
    """
    i, none = F.col("sample_id"), F.lit(None).cast("double")
    row = lambda score, nth: F.struct(score.alias("score"), F.lit(nth).alias("nth"))
    one = F.lit(1.0)
    a = areas(spark, sf).select("sample_id", "sha", "area")
    page = a.groupBy("sha").agg(n_rows().alias("size")).where("size > 1").orderBy("sha").offset(5).limit(5)
    m = a.join(page, "sha")
    seen = F.when(i % 5 == 0, F.array(row(one, 0), row(F.lit(0.5), 1))).when(i % 5 == 1, F.array(row(none, 0), row(F.lit(0.75), 1))).otherwise(F.array(row(one, 0)))
    best = best_evidence(m.select("*", F.inline(seen)), ("sha", "sample_id"), "score", "nth")
    fits = F.filter(F.array(*[F.lit(r) for r in (512, 768, 1024, 1216, 1536)]), lambda r: F.col("area") >= r * r)
    t = best.join(overlay(spark, sf), "sample_id", "left")
    return t.select("sha", "sample_id", "size", "score", F.col("nth").alias("evidence_nth"), "area", F.array_join(fits.cast("array<string>"), ",").alias("resolutions"), F.coalesce("decision", F.lit("pending_review")).alias("decision"))


ELECT_SQL = HASH_SQL + """, ex AS (SELECT s.sample_id AS a, min(s.sample_id) OVER (PARTITION BY sha) AS b FROM samples s),
  vis AS (SELECT sample_id AS a, (sample_id // 3) * 3 AS b FROM samples WHERE sample_id % 3 = 1 AND sample_id - 1 IN (SELECT sample_id FROM samples)),
  e AS (SELECT a, b FROM ex WHERE a <> b UNION SELECT b, a FROM ex WHERE a <> b UNION SELECT a, b FROM vis UNION SELECT b, a FROM vis), r AS (SELECT a AS n, a AS m FROM e UNION SELECT e.a, r.m FROM e JOIN r ON e.b = r.n),
  c AS (SELECT n AS sample_id, min(m) AS component FROM r GROUP BY n), k AS (SELECT c.*, a.area, a.path, o.decision, bool_or(coalesce(o.decision, '') = 'approved_keep') OVER (PARTITION BY component) AS any_keep FROM c JOIN areas a USING (sample_id) LEFT JOIN overlay o USING (sample_id)),
  q AS (SELECT *, row_number() OVER (PARTITION BY component, coalesce(decision, '') = 'approved_exclude' ORDER BY area DESC, lower(path), path, sample_id) AS rn FROM k)"""


def duplicate_components(spark: S, sf: str) -> DataFrame:
    """(sample_id, component) over exact and visual groups together."""
    s = samples(spark, sf)
    least = s.groupBy("sha").agg(F.min("sample_id").alias("b"))
    exact = s.select(F.col("sample_id").alias("a"), "sha").join(least, "sha").where("a <> b").select("a", "b")
    visual = visual_edges(hashes(spark, sf))
    return connected_components(exact.unionByName(visual)).select(F.col("node").alias("sample_id"), "component")


def elected(spark: S, sf: str) -> DataFrame:
    """Members of components that no human keep protects, not excluded themselves, ranked by area, then path; others have a null place."""
    c = duplicate_components(spark, sf).join(areas(spark, sf).select("sample_id", "area", "path"), "sample_id").join(overlay(spark, sf), "sample_id", "left")
    keep = c.groupBy("component").agg(F.bool_or(F.coalesce(F.col("decision") == "approved_keep", F.lit(False))).alias("any_keep"))
    c = c.join(keep, "component").withColumn("out", F.coalesce(F.col("decision") == "approved_exclude", F.lit(False)))
    top = c.where("NOT any_keep AND NOT out").groupBy("component").agg(F.min_by("sample_id", F.struct(-F.col("area"), F.lower("path"), "path", "sample_id")).alias("winner"))
    return c.join(top, "component", "left")


@query("WITH RECURSIVE " + ELECT_SQL + " SELECT sample_id, component, CASE WHEN any_keep THEN 'protected' WHEN coalesce(decision, '') = 'approved_exclude' THEN 'excluded' WHEN rn = 1 THEN 'representative' ELSE 'duplicate_non_representative' END AS outcome FROM q")
def dup_export_representative(spark: S, sf: str) -> DataFrame:
    outcome = F.when(F.col("any_keep"), "protected").when(F.col("out"), "excluded").when(F.col("sample_id") == F.col("winner"), "representative").otherwise("duplicate_non_representative")
    return elected(spark, sf).select("sample_id", "component", outcome.alias("outcome"))


@query("SELECT sample_id, sha FROM (SELECT sample_id, sha, row_number() OVER (PARTITION BY sha ORDER BY area DESC, path, sample_id) AS rn FROM areas) WHERE rn > 1")
def dup_auto_exclude(spark: S, sf: str) -> DataFrame:
    a = areas(spark, sf).select("sample_id", "sha", "area", "path")
    top = a.groupBy("sha").agg(F.min_by("sample_id", F.struct(-F.col("area"), "path", "sample_id")).alias("winner"))
    return a.join(top, "sha").where("sample_id <> winner").select("sample_id", "sha")


@query("SELECT code, count(*) AS n, max(value) AS largest FROM evidence WHERE code LIKE 'duplicate%' GROUP BY code")
def duplicate_evidence_summary(spark: S, sf: str) -> DataFrame:
    return evidence(spark, sf).where("code LIKE 'duplicate%'").groupBy("code").agg(n_rows().alias("n"), F.max("value").alias("largest"))


