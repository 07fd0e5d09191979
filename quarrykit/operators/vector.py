"""Vector statistics: centroids, leave-one-out similarity, outliers, cluster trees, diversity and scoring heads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query
from quarrykit.plans.domain import centroids, dot, evidence, members, overlay, samples, scores, vectors
from quarrykit.sources.tables import table

S = SparkSession


def n_rows() -> Column:
    return F.count(F.lit(1))


@query("SELECT label, d AS dim, round(x, 6) AS value FROM (SELECT label, unnest(c) AS x, unnest(range(1, len(c) + 1)) AS d FROM centroids)")
def scope_centroid(spark: S, sf: str) -> DataFrame:
    return centroids(spark, sf).select("label", F.posexplode("c").alias("d", "x")).select("label", (F.col("d") + 1).cast("long").alias("dim"), F.round("x", 6).alias("value"))


@query("SELECT label, max_by(vec_id, score) AS representative, round(max(score), 6) AS score FROM members GROUP BY label")
def scope_representative(spark: S, sf: str) -> DataFrame:
    return members(spark, sf).groupBy("label").agg(F.max_by("vec_id", "score").alias("representative"), F.round(F.max("score"), 6).alias("score"))


@query("SELECT vec_id, label, round(score, 6) AS score FROM members")
def membership_scores(spark: S, sf: str) -> DataFrame:
    return members(spark, sf).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("SELECT v.vec_id, max_by(c.label, list_dot_product(v.v, c.c)) AS nearest, round(max(list_dot_product(v.v, c.c)), 6) AS score FROM vectors v, centroids c GROUP BY v.vec_id")
def nearest_centroid(spark: S, sf: str) -> DataFrame:
    """Centroids (one small array for each label) travel as one row to every vector."""
    c = centroids(spark, sf).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("cs"))
    best = F.array_max(F.transform("cs", lambda x: F.struct(dot(F.col("v"), x["c"]).alias("s"), x["label"].alias("label"))))
    return vectors(spark, sf).join(F.broadcast(c)).withColumn("b", best).select("vec_id", F.col("b.label").alias("nearest"), F.round("b.s", 6).alias("score"))


def with_loo(v: DataFrame, by: str = "label") -> DataFrame:
    """Adds n and loo, the mean similarity of each unit vector to its group's others: (v.S - v.v) / (n - 1), S the group's sum. Never all pairs."""
    sums = v.select(by, F.posexplode("v").alias("d", "x")).groupBy(by, "d").agg(F.sum("x").alias("s"), n_rows().alias("n"))
    s = sums.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda x: x["s"]).alias("total"), F.max("n").alias("n"))
    out = v.join(s, by)
    return out.withColumn("loo", (dot(F.col("v"), F.col("total")) - dot(F.col("v"), F.col("v"))) / F.greatest(F.col("n") - 1, F.lit(1))).drop("total")


LOO_SQL = """tot AS (SELECT label, list(s ORDER BY d) AS total, max(n) AS n FROM (SELECT label, d, sum(x) AS s, count(*) AS n FROM dims GROUP BY label, d) GROUP BY label),
  loo AS (SELECT vec_id, v.label, v.v, n, (list_dot_product(v.v, total) - list_dot_product(v.v, v.v)) / greatest(n - 1, 1) AS loo FROM vectors v JOIN tot USING (label))"""


@query(f"WITH {LOO_SQL} SELECT vec_id, label, n, round(loo, 6) AS loo FROM loo")
def style_loo_similarity(spark: S, sf: str) -> DataFrame:
    return with_loo(vectors(spark, sf)).select("vec_id", "label", "n", F.round("loo", 6).alias("loo"))


def spherical_tree(v: np.ndarray, ids: np.ndarray, scope: str, seed: int = 7, target: int = 16, most: int = 4, split: int = 24, rounds: int = 12) -> list[tuple[str, np.ndarray]]:
    """Leaves (path, ids) of recursive spherical k-means; a node's seed comes from its path, and children are ordered by their least id."""
    out: list[tuple[str, np.ndarray]] = []
    todo = [("0", np.argsort(ids))]
    while todo:
        path, rows = todo.pop()
        n = len(rows)
        if n < split or n <= target:
            out.append((path, ids[rows]))
            continue
        k = min(most, max(2, -(-n // target)))
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{scope}:{path}".encode()).digest()[:4], "big"))
        x = v[rows]
        c = x[rng.choice(n, k, replace=False)]
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            new = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(k)])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.allclose(new, c):
                break
            c = new
        groups = sorted((rows[near == j] for j in range(k) if (near == j).any()), key=lambda g: ids[g].min())
        if len(groups) < 2:
            out.append((path, ids[rows]))
            continue
        todo += [(f"{path}.{i}", g) for i, g in enumerate(groups)]
    return sorted(out, key=lambda x: x[0])


@query()
def cluster_tree(spark: S, sf: str) -> DataFrame:
    """(label, leaf, vec_id): each scope's tree of clusters. Scopes are the unit of work; tests hold its properties (no SQL for seeded k-means)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        label = int(g["label"].iloc[0])
        leaves = spherical_tree(np.stack(g["v"]), g["vec_id"].to_numpy(), str(label))
        return pd.DataFrame([(label, p, int(i)) for p, ids in leaves for i in ids], columns=["label", "leaf", "vec_id"])

    return vectors(spark, sf).groupBy("label").applyInPandas(run, "label int, leaf string, vec_id long")


def round_robin(t: DataFrame) -> DataFrame:
    """(parent, leaf, place) of every row (parent, leaf) of ``t``, parents' lists interleaved. Before a parent's k-th leaf come at most k - 1 of every parent, and the k-th of lesser parents: sizes (a row for each parent) are all that travels."""
    sizes = t.groupBy("parent").agg(n_rows().alias("n")).agg(F.collect_list(F.struct("parent", "n")).alias("sizes"))
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("parent").orderBy("leaf")).cast("long")).join(F.broadcast(sizes))
    place = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + F.least(x["n"], F.col("k") - F.when(x["parent"] <= F.col("parent"), 0).otherwise(1)))
    return t.select("parent", "leaf", place.alias("place"))


@query("SELECT label AS parent, vec_id AS leaf, row_number() OVER (ORDER BY rn, label) AS place FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)")
def leaf_round_robin(spark: S, sf: str) -> DataFrame:
    """Every embedding is a leaf of its label."""
    return round_robin(table(spark, sf, "embeddings").select(F.col("label").alias("parent"), F.col("vec_id").alias("leaf")))


@query("SELECT sample_id, scope FROM samples WHERE state = 'valid' AND sample_id NOT IN (SELECT sample_id FROM evidence WHERE code = 'ai_generated' AND value >= 0.5) AND (sample_id NOT IN (SELECT sample_id FROM evidence WHERE code = 'style' AND severity = 'high') OR sample_id IN (SELECT sample_id FROM overlay WHERE decision = 'approved_keep'))")
def clustering_inputs(spark: S, sf: str) -> DataFrame:
    e = evidence(spark, sf)
    ai = e.where("code = 'ai_generated' AND value >= 0.5").select("sample_id")
    odd = e.where("code = 'style' AND severity = 'high'").select("sample_id")
    odd = odd.join(overlay(spark, sf).where("decision = 'approved_keep'").select("sample_id"), "sample_id", "left_anti")
    return samples(spark, sf).where("state = 'valid'").select("sample_id", "scope").join(ai, "sample_id", "left_anti").join(odd, "sample_id", "left_anti")


def allocate_quota(sizes: dict[str, int], target: int) -> dict[str, int]:
    """One for each leaf in order, then shares by the root of the size with the largest remainders, none over its size, until the target is given."""
    target = min(target, sum(sizes.values()))
    order = list(sizes)
    given = dict.fromkeys(order, 0)
    for k in order[: target if target < len(order) else len(order)]:
        given[k] = min(1, sizes[k])
    left = target - sum(given.values())
    while left > 0:
        room = [k for k in order if given[k] < sizes[k]]
        total = sum(sizes[k] ** 0.5 for k in room)
        want = {k: left * sizes[k] ** 0.5 / total for k in room}
        whole = {k: min(int(want[k]), sizes[k] - given[k]) for k in room}
        for k in sorted(room, key=lambda k: (int(want[k]) - want[k], order.index(k))):
            if sum(whole.values()) < left and given[k] + whole[k] < sizes[k]:
                whole[k] += 1
        for k in room:
            given[k] += whole[k]
        left = target - sum(given.values())
    return given


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT *, (100 - (SELECT count(*) FROM s)) * sqrt(n) / (SELECT sum(sqrt(n)) FROM s) AS want FROM s), r AS (SELECT *, floor(want) AS whole, row_number() OVER (ORDER BY round(floor(want) - want, 9), label) AS rn FROM w) SELECT label, n AS size, CAST(1 + whole + CASE WHEN rn <= (100 - (SELECT count(*) FROM s)) - (SELECT sum(whole) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r")
def sqrt_quota(spark: S, sf: str) -> DataFrame:
    """A hundred picks over the leaves. Leaf sizes (a row for each leaf) are all the allocation needs."""
    rows = table(spark, sf, "embeddings").groupBy("label").agg(n_rows().alias("n")).orderBy("label").collect()
    quota = allocate_quota({r["label"]: r["n"] for r in rows}, 100)
    return spark.createDataFrame([(r["label"], r["n"], quota[r["label"]]) for r in rows], "label int, size long, quota long")


def pick_diverse(v: np.ndarray, ids: np.ndarray, quota: int) -> list[int]:
    """Farthest-point picks: the least id first, then whichever is least like what is picked (ties: the least id)."""
    order = np.argsort(ids)
    v, ids = v[order], ids[order]
    picked = [0]
    near = v @ v[0]
    while len(picked) < min(quota, len(ids)):
        near[picked] = np.inf
        nxt = int(np.argmin(near))
        picked.append(nxt)
        near = np.maximum(near, v @ v[nxt])
    return [int(ids[i]) for i in picked]


@query()
def diverse_selection(spark: S, sf: str) -> DataFrame:
    """Five diverse members of each leaf, in the order they were picked. Greedy picking has no SQL; tests hold it against brute force."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids = pick_diverse(np.stack(g["v"]), g["vec_id"].to_numpy(), 5)
        return pd.DataFrame({"label": g["label"].iloc[0], "place": range(len(ids)), "vec_id": ids})

    return vectors(spark, sf).groupBy("label").applyInPandas(run, "label int, place int, vec_id long")


@query("SELECT CAST(d AS BIGINT) AS feature, round(quantile_cont(x, 0.95), 6) AS threshold FROM dims GROUP BY d")
def feature_thresholds(spark: S, sf: str) -> DataFrame:
    d = vectors(spark, sf).select(F.posexplode("v").alias("d", "x"))
    return d.groupBy((F.col("d") + 1).cast("long").alias("feature")).agg(F.round(F.percentile("x", 0.95), 6).alias("threshold"))


TOPK_SQL = "topk AS (SELECT CAST(d AS BIGINT) AS feature, vec_id, x, row_number() OVER (PARTITION BY d ORDER BY x DESC, vec_id) AS place FROM dims)"


def top_features(spark: S, sf: str, k: int) -> DataFrame:
    """The k largest of each feature. Spark stops ranking a task's rows at k before the shuffle (window group limit)."""
    d = vectors(spark, sf).select("vec_id", F.posexplode("v").alias("d", "x")).select((F.col("d") + 1).cast("long").alias("feature"), "vec_id", "x")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("x"), "vec_id")).cast("long")).where(F.col("place") <= k)


@query(f"WITH {TOPK_SQL} SELECT feature, vec_id, round(x, 6) AS value, place FROM topk WHERE place <= 5")
def feature_topk(spark: S, sf: str) -> DataFrame:
    return top_features(spark, sf, 5).select("feature", "vec_id", F.round("x", 6).alias("value"), "place")


@query(f"WITH {TOPK_SQL} SELECT feature, array_to_string(list(vec_id ORDER BY place), ',') AS representatives FROM topk WHERE place <= 3 GROUP BY feature")
def sae_feature_list(spark: S, sf: str) -> DataFrame:
    t = top_features(spark, sf, 3).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id"))).alias("r"))
    return t.select("feature", F.array_join(F.transform("r", lambda x: x["vec_id"].cast("string")), ",").alias("representatives"))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


@query("SELECT vec_id, round(sum(abs(x - m)), 6) AS distance FROM dims JOIN (SELECT label, d, avg(x) AS m FROM dims GROUP BY label, d) USING (label, d) GROUP BY vec_id")
def color_l1(spark: S, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    mean = v.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))
    return v.join(mean, "label").select("vec_id", F.round(l1(F.col("v"), F.col("m")), 6).alias("distance"))


@query("SELECT vec_id, CAST(d AS BIGINT) AS class, round(exp(x * 10) / sum(exp(x * 10)) OVER (PARTITION BY vec_id), 6) AS p FROM dims")
def softmax_scores(spark: S, sf: str) -> DataFrame:
    e = F.transform("v", lambda x: F.exp(x * 10))
    t = vectors(spark, sf).select("vec_id", e.alias("e")).withColumn("t", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return t.select("vec_id", "t", F.posexplode("e").alias("k", "x")).select("vec_id", (F.col("k") + 1).cast("long").alias("class"), F.round(F.col("x") / F.col("t"), 6).alias("p"))


@query("SELECT vec_id, round(4 / (1 + exp(-(sum(x * (d % 3 - 1)) + 0.1))) + 1, 6) AS score FROM dims GROUP BY vec_id")
def affine_sigmoid_head(spark: S, sf: str) -> DataFrame:
    """An affine head, its logistic stretched to 1 to 5."""
    w = F.array(*[F.lit(float((d + 1) % 3 - 1)) for d in range(64)])
    return vectors(spark, sf).select("vec_id", F.round(4 / (1 + F.exp(-(dot(F.col("v"), F.slice(w, 1, F.size("v"))) + 0.1))) + 1, 6).alias("score"))


@query("""WITH q AS (SELECT doc_id, [0.0, 10 + doc_id % 7, 12.0 + doc_id % 7, 1.0]::DOUBLE[] AS xs, [0.0, doc_id % 3, 8.0 + doc_id % 5, 9.0]::DOUBLE[] AS ys FROM documents)
  SELECT doc_id AS sample_id, round(least(1.0, abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[4] - xs[4] * ys[3] + xs[4] * ys[1] - xs[1] * ys[4]) / 2 / 400.0), 6) AS ratio FROM q""")
def polygon_area_ratio(spark: S, sf: str) -> DataFrame:
    i = F.col("doc_id")
    xs = F.array(F.lit(0.0), 10.0 + i % 7, 12.0 + i % 7, F.lit(1.0))
    ys = F.array(F.lit(0.0), (i % 3).cast("double"), 8.0 + i % 5, F.lit(9.0))
    d = table(spark, sf, "documents").select(i.alias("sample_id"), xs.alias("xs"), ys.alias("ys"))
    turn = lambda a: F.concat(F.slice(a, 2, 3), F.slice(a, 1, 1))
    twice = dot(F.col("xs"), turn(F.col("ys"))) - dot(turn(F.col("xs")), F.col("ys"))  # shoelace
    return d.select("sample_id", F.round(F.least(F.lit(1.0), F.abs(twice) / 2 / 400.0), 6).alias("ratio"))


ROC_SQL = "scored AS (SELECT (doc_id * 37 % 50 + toxic * 20) AS s, toxic FROM labels), per AS (SELECT s, sum(toxic)::BIGINT AS p, (count(*) - sum(toxic))::BIGINT AS n FROM scored GROUP BY s), roc AS (SELECT s, p, n, sum(p) OVER (ORDER BY s DESC)::BIGINT AS tp, sum(n) OVER (ORDER BY s DESC)::BIGINT AS fp FROM per)"


def roc(spark: S, sf: str) -> DataFrame:
    """Cumulated hits and false alarms at each threshold; scores are binned before the running sum, so it runs over thresholds, not rows."""
    t = table(spark, sf, "labels").select((F.col("doc_id") * 37 % 50 + F.col("toxic") * 20).alias("s"), "toxic")
    per = t.groupBy("s").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    w = Window.orderBy(F.desc("s"))
    return per.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w)})


@query(f"WITH {ROC_SQL} SELECT s AS threshold, tp, fp FROM roc")
def roc_points(spark: S, sf: str) -> DataFrame:
    return roc(spark, sf).select(F.col("s").alias("threshold"), "tp", "fp")


@query(f"WITH {ROC_SQL} SELECT round(sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)), 9) AS auc FROM roc")
def auc(spark: S, sf: str) -> DataFrame:
    return roc(spark, sf).agg(F.round(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / (F.sum("p") * F.sum("n")), 9).alias("auc"))


@query("SELECT doc_id AS sample_id, aes FROM scores WHERE aes IS NOT NULL AND NOT isnan(aes) AND NOT isinf(aes)")
def finite_guard(spark: S, sf: str) -> DataFrame:
    return scores(spark, sf).where("aes IS NOT NULL AND NOT isnan(aes) AND abs(aes) < double('infinity')").select(F.col("doc_id").alias("sample_id"), "aes")
