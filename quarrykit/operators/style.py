"""Consistency of a scope's members: leave-one-out similarity, scores of feature families, a guardrail, and rounds that take out what does not belong.

A scope may hold any share of all rows, so no scope is gathered into one task: sums of a scope's vectors are aggregates by dimension, combined before
the shuffle, and each row meets them through a join by scope. A round writes its rows to the shared folder, so a plan holds one round only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query
from quarrykit.plans.domain import dot, vectors
from quarrykit.plans.storage import discard, staged

S = SparkSession
#: Spread under the mean that still counts as alike, least combined score, rounds, least size of a scope that rounds may cut.
SIGMA, MIN_SCORE, ROUNDS, LEAST = 0.522, 92.07, 3, 8
#: Fixed values of the one-family check: spread, rounds, least size.
CHARACTER_SIGMA, CHARACTER_ROUNDS, CHARACTER_LEAST = 2.04, 2, 4


@dataclass(frozen=True)
class Weights:
    """Shares of the main family, the texture family (itself split in average and centroid) and the guardrail family."""

    main: float = 0.892
    texture: float = 0.0
    guard: float = 0.108
    average: float = 0.8
    centroid: float = 0.2

    def __post_init__(self) -> None:
        if abs(self.main + self.texture + self.guard - 1) > 1e-9 or abs(self.average + self.centroid - 1) > 1e-9:
            raise ValueError("weights must sum to 1")


def unit(v: Column) -> Column:
    """``v`` at length 1; a vector of no length, or of none that is finite, is an error."""
    norm = F.sqrt(dot(v, v))
    fine = norm.isNotNull() & (norm > 0) & (norm < F.lit(float("inf")))  # NaN is larger than every number
    return F.when(fine, F.transform(v, lambda x: x / norm)).otherwise(F.raise_error(F.lit("a feature row has no finite, positive length")).cast("array<double>"))


@query("SELECT vec_id, CAST(d AS BIGINT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) + 0.0 AS value FROM dims")
def unit_vectors(spark: S, sf: str) -> DataFrame:
    return vectors(spark, sf).select("vec_id", F.posexplode(unit(F.col("v"))).alias("d", "x")).select("vec_id", (F.col("d") + 1).cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("value"))


FAMILIES = ("main", "texture", "guard")


def measured(t: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """Adds n (active rows of the scope) and, for each family, its similarity to the active rows (an active row to the others) and the squared
    distance to their mean. ``t`` has label, active and an array for each family; sums of all families travel in one shuffle."""
    whole = F.concat(*map(F.col, families))
    sums = t.where("active").select("label", F.posexplode(whole).alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]).alias("total"), F.max("n").alias("n"))
    t, at, new = t.join(sums, "label"), F.lit(1), {}
    for f in families:
        v, s = F.col(f), F.slice("total", at, F.size(f))
        vs, vv, n = dot(v, s), dot(v, v), F.col("n")
        new[f"{f}_sim"] = F.when(F.col("active") & (n > 1), (vs - vv) / (n - 1)).otherwise(vs / n)
        new[f"{f}_far"] = F.greatest(F.lit(0.0), vv - 2 * vs / n + dot(s, s) / (n * n))
        at = at + F.size(f)
    return t.withColumns(new).drop("total")


def _share(value: Column, floor: Column, top: Column) -> Column:
    """The place of ``value`` between floor and top, 0 to 100; 100 for all where top isn't above floor."""
    return F.when(top <= floor, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), (value - floor) / (top - floor) * 100)))


def scored(t: DataFrame, w: Weights) -> DataFrame:
    """Adds thresholds, scores and the combined score of every row, by the rows that are active. A family of no weight is neutral."""
    m, zero = measured(t, FAMILIES), F.lit(0.0)
    st = m.where("active").groupBy("label").agg(*[a for f in FAMILIES for a in (F.avg(f"{f}_sim").alias(f"{f}_mean"), F.stddev_pop(f"{f}_sim").alias(f"{f}_sd"), F.avg(f"{f}_far").alias(f"{f}_spread"))])
    m, used, new = m.join(st, "label"), {"main": w.main > 0, "texture": w.texture > 0, "guard": w.guard > 0}, {}
    for f in FAMILIES:
        mean, sd = F.col(f"{f}_mean"), F.col(f"{f}_sd")
        cut, floor = F.greatest(zero, mean - SIGMA * sd), F.greatest(zero, mean - F.greatest(F.lit(0.18), 2 * sd))
        new[f"{f}_cut"] = cut if used[f] else zero
        new[f"{f}_score"] = _share(F.col(f"{f}_sim"), floor, F.greatest(mean, floor + 1e-6)) if used[f] else F.lit(100.0)
        new[f"{f}_near"] = 100 - _share(F.col(f"{f}_far"), zero, F.greatest(2 * F.col(f"{f}_spread"), F.lit(1e-6))) if used[f] else F.lit(100.0)
        new[f"{f}_low"] = (F.col(f"{f}_sim") < cut) if used[f] else F.lit(False)
    cut = F.greatest(zero, F.col("guard_mean") - SIGMA * F.col("guard_sd"))
    floor = F.greatest(zero, cut - F.greatest(F.lit(0.10), 1.5 * F.col("guard_sd")))
    new["guardrail"] = F.when(F.col("guard_sim") >= cut, 100.0).otherwise(_share(F.col("guard_sim"), floor, F.greatest(cut, floor + 1e-6))) if used["guard"] else F.lit(100.0)
    m = m.withColumns(new)
    texture = F.col("texture_score") * w.average + F.col("texture_near") * w.centroid
    return m.withColumn("combined", F.col("main_score") * w.main + texture * w.texture + F.col("guardrail") * w.guard)


def with_active(t: DataFrame) -> DataFrame:
    """All rows active; held is the number of rows in the scope."""
    return t.join(t.groupBy("label").agg(F.count(F.lit(1)).alias("held")), "label").withColumns({"active": F.lit(True), "removed": F.lit(None).cast("int")})


def assess(t: DataFrame, weights: Weights = Weights()) -> DataFrame:  # noqa: B008 (frozen)
    """(vec_id, label, combined, core, reason, removed) of rows (vec_id, label, main, texture, guard), unit vectors each; vec_id is unique.

    In each of three rounds the active rows leave whose main or texture similarity is under their scope's threshold and whose combined score is under the
    least score. Two rows of each scope stay in any case: those of the highest combined score, of equals those of the greatest id. Scopes of fewer
    than eight rows lose none; what would have left is marked for review. An empty table stays empty.
    """
    t = staged(with_active(t), "style")
    low = (F.col("main_low") | F.col("texture_low")) & (F.col("combined") < MIN_SCORE)
    for nth in range(1, ROUNDS + 1):
        s = staged(scored(t, weights).withColumn("out", F.col("active") & low & (F.col("held") >= LEAST)).select(*t.columns, "combined", "out"), "style")
        discard(t)
        tight = s.groupBy("label").agg(F.count_if("active").alias("a"), F.count_if("out").alias("o")).where("o > 0 AND a - o < 2").select("label", (2 - (F.col("a") - F.col("o"))).alias("keep"))
        order = Window.partitionBy("label").orderBy(F.desc("combined"), F.desc("vec_id"))  # ranks end at 2, so a task hands on two rows of a scope
        first = s.where("out").join(tight, "label").withColumn("nth", F.row_number().over(order)).where("nth <= 2")
        spared = first.where("nth <= keep").select("vec_id", F.lit(True).alias("spared"))
        gone = F.col("out") & F.col("spared").isNull()
        s2 = s.join(spared, "vec_id", "left").withColumns({"removed": F.when(gone, nth).otherwise(F.col("removed")), "active": F.col("active") & ~gone})
        t = staged(s2.select(*t.columns), "style")
        discard(s)
        if t.where(F.col("removed") == nth).isEmpty():
            break
    both = F.when(F.col("main_low") & F.col("texture_low"), "main_and_texture_below_threshold").when(F.col("main_low"), "main_below_threshold").otherwise("texture_below_threshold")
    reason = F.when(~F.col("active"), both).when((F.col("held") < LEAST) & low, "small_scope_review")
    return scored(t, weights).select("vec_id", "label", "combined", F.col("active").alias("core"), reason.alias("reason"), "removed")


def families(spark: S, sf: str) -> DataFrame:
    """Whole vectors as the main family, their halves as the two others."""
    v = vectors(spark, sf)
    half = F.floor(F.size("v") / 2).cast("int")
    return v.select("vec_id", "label", unit(F.col("v")).alias("main"), unit(F.slice("v", F.lit(1), half)).alias("texture"), unit(F.slice("v", half + 1, F.size("v"))).alias("guard"))


def _family_sql(b: str, i: str, w: Weights) -> str:
    """Tables e, t, p, q, c of one round: ``c{i}`` is ``scored`` over ``b``."""
    shares = {"main": w.main, "texture": w.texture, "guard": w.guard}
    at = {"main": "total[1:len(main)]", "texture": "total[len(main) + 1:len(main) + len(texture)]", "guard": "total[len(main) + len(texture) + 1:]"}
    share = lambda x, f, c: f"CASE WHEN {c} <= {f} THEN 100.0 ELSE least(100.0, greatest(0.0, ({x} - {f}) / ({c} - {f}) * 100)) END"
    cut = lambda f: f"greatest(0.0, {f}_mean - {SIGMA} * {f}_sd)"
    p = ", ".join(f"CASE WHEN active AND n > 1 THEN (list_dot_product({f}, {s}) - list_dot_product({f}, {f})) / (n - 1) ELSE list_dot_product({f}, {s}) / n END AS {f}_sim, greatest(0.0, list_dot_product({f}, {f}) - 2 * list_dot_product({f}, {s}) / n + list_dot_product({s}, {s}) / (n * n)) AS {f}_far" for f, s in at.items())
    q = ", ".join(f"avg({f}_sim) FILTER (active) OVER (PARTITION BY label) AS {f}_mean, stddev_pop({f}_sim) FILTER (active) OVER (PARTITION BY label) AS {f}_sd, avg({f}_far) FILTER (active) OVER (PARTITION BY label) AS {f}_spread" for f in at)
    r = []
    for f in at:
        floor = f"greatest(0.0, {f}_mean - greatest(0.18, 2 * {f}_sd))"
        used = shares[f] > 0
        r.append(f"{share(f + '_sim', floor, f'greatest({f}_mean, {floor} + 1e-6)') if used else '100.0'} AS {f}_score, {'100 - ' + share(f + '_far', '0.0', f'greatest(2 * {f}_spread, 1e-6)') if used else '100.0'} AS {f}_near, {f'{f}_sim < {cut(f)}' if used else 'false'} AS {f}_low, {cut(f) if used else '0.0'} AS {f}_cut")
    floor = f"greatest(0.0, {cut('guard')} - greatest(0.1, 1.5 * guard_sd))"
    top = f"greatest({cut('guard')}, {floor} + 1e-6)"
    rail = f"CASE WHEN guard_sim >= {cut('guard')} THEN 100.0 ELSE {share('guard_sim', floor, top)} END" if w.guard > 0 else "100.0"
    return f"""e{i} AS (SELECT label, k, sum(x) AS s, count(*) AS n FROM (SELECT label, unnest(main || texture || guard) AS x, unnest(range(1, len(main || texture || guard) + 1)) AS k FROM {b} WHERE active) GROUP BY label, k),
    t{i} AS (SELECT label, list(s ORDER BY k) AS total, max(n) AS n FROM e{i} GROUP BY label), p{i} AS (SELECT b.*, n, {p} FROM {b} b JOIN t{i} USING (label)), q{i} AS (SELECT *, {q} FROM p{i}), r{i} AS (SELECT *, {", ".join(r)}, {rail} AS guardrail FROM q{i}),
    c{i} AS (SELECT *, main_score * {w.main} + (texture_score * {w.average} + texture_near * {w.centroid}) * {w.texture} + guardrail * {w.guard} AS combined FROM r{i})"""


def _assess_sql(w: Weights, rounds: int) -> str:
    def norm(x: str) -> str:
        return f"list_transform({x}, lambda y: y / sqrt(list_dot_product({x}, {x})))"

    out = [f"b0 AS (SELECT vec_id, label, {norm('v')} AS main, {norm('v[1:len(v) // 2]')} AS texture, {norm('v[len(v) // 2 + 1:]')} AS guard, count(*) OVER (PARTITION BY label) AS held, true AS active, CAST(NULL AS INT) AS removed FROM vectors)"]
    for i in range(rounds):
        out.append(_family_sql(f"b{i}", str(i), w))
        out.append(f"""o{i} AS (SELECT *, active AND held >= {LEAST} AND (main_low OR texture_low) AND combined < {MIN_SCORE} AS bad FROM c{i}),
    k{i} AS (SELECT *, bad AND row_number() OVER (PARTITION BY label, bad ORDER BY combined DESC, vec_id DESC) > 2 - (count(*) FILTER (active) OVER (PARTITION BY label) - count(*) FILTER (bad) OVER (PARTITION BY label)) AS gone FROM o{i}),
    b{i + 1} AS (SELECT vec_id, label, main, texture, guard, held, active AND NOT gone AS active, CASE WHEN gone THEN {i + 1} ELSE removed END AS removed FROM k{i})""")
    out.append(_family_sql(f"b{rounds}", str(rounds), w))
    return "WITH " + ", ".join(out) + " "


def _outcome_sql(w: Weights) -> str:
    return _assess_sql(w, ROUNDS) + f"""SELECT vec_id, label, round(combined, 4) + 0.0 AS combined, active AS core, removed, CASE WHEN NOT active THEN CASE WHEN main_low AND texture_low THEN 'main_and_texture_below_threshold' WHEN main_low THEN 'main_below_threshold' ELSE 'texture_below_threshold' END
    WHEN held < {LEAST} AND (main_low OR texture_low) AND combined < {MIN_SCORE} THEN 'small_scope_review' END AS reason FROM c{ROUNDS}"""


TEXTURED = Weights(0.5, 0.3, 0.2)


@query(_assess_sql(TEXTURED, 0) + "SELECT vec_id, label, round(main_cut, 6) + 0.0 AS threshold, round(main_score, 4) + 0.0 AS score, round(main_near, 4) + 0.0 AS centroid_score, round(guardrail, 4) + 0.0 AS guardrail FROM c0")
def style_family_scores(spark: S, sf: str) -> DataFrame:
    """The main family's threshold, average and centroid scores, and the guardrail, before any row leaves."""
    r = lambda c, k: F.round(c, k) + 0.0
    return scored(with_active(families(spark, sf)), TEXTURED).select("vec_id", "label", r("main_cut", 6).alias("threshold"), r("main_score", 4).alias("score"), r("main_near", 4).alias("centroid_score"), r("guardrail", 4).alias("guardrail"))


@query(_assess_sql(TEXTURED, 0) + "SELECT vec_id, label, round(combined, 4) + 0.0 AS combined FROM c0")
def style_combined(spark: S, sf: str) -> DataFrame:
    return scored(with_active(families(spark, sf)), TEXTURED).select("vec_id", "label", (F.round("combined", 4) + 0.0).alias("combined"))


@query(_outcome_sql(Weights()))
def style_outliers(spark: S, sf: str) -> DataFrame:
    return assess(families(spark, sf)).withColumn("combined", F.round("combined", 4) + 0.0)


@query(_outcome_sql(TEXTURED))
def style_outliers_textured(spark: S, sf: str) -> DataFrame:
    """``style_outliers`` with a weight for the texture family, so that each reason can occur."""
    return assess(families(spark, sf), TEXTURED).withColumn("combined", F.round("combined", 4) + 0.0)


def character_check(t: DataFrame) -> DataFrame:
    """(vec_id, label, near, threshold, review, reason) of rows (vec_id, label, main), unit vectors.

    Twice the active rows leave whose similarity is under mean - 2.04 deviations, unless fewer than two would stay; then rows under the threshold of
    similarity to the active rows' unit mean are for review, as are those that left. Scopes of fewer than four rows have no threshold and no review.
    """
    t = staged(with_active(t), "character")
    for _ in range(CHARACTER_ROUNDS):
        m = measured(t, ("main",))
        cut = m.where("active").groupBy("label").agg((F.avg("main_sim") - CHARACTER_SIGMA * F.stddev_pop("main_sim")).alias("cut"))
        m = m.join(cut, "label").withColumn("out", F.col("active") & (F.col("held") >= CHARACTER_LEAST) & (F.col("main_sim") < F.col("cut")))
        s = staged(m.select(*t.columns, "out"), "character")
        discard(t)
        few = s.groupBy("label").agg((F.count_if("active") - F.count_if("out") < 2).alias("few"))
        t = staged(s.join(few, "label").withColumn("active", F.col("active") & (~F.col("out") | F.col("few"))).select(*t.columns), "character")
        discard(s)
    mean = t.where("active").select("label", F.posexplode("main").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))
    near = F.coalesce(F.try_divide(dot(F.col("main"), F.col("mean")), F.sqrt(dot(F.col("mean"), F.col("mean")))), F.lit(0.0))
    t = t.join(mean, "label").withColumn("near", near)
    cut = t.where("active").groupBy("label").agg((F.avg("near") - CHARACTER_SIGMA * F.stddev_pop("near")).alias("threshold"))
    small = F.col("held") < CHARACTER_LEAST
    review = ~small & (~F.col("active") | (F.col("near") < F.col("threshold") - 1e-6))
    reason = F.when(small, "insufficient_scope_size").when(review, "below_scope_threshold").otherwise("core_member")
    return t.join(cut, "label").select("vec_id", "label", "near", F.when(~small, F.col("threshold")).alias("threshold"), review.alias("review"), reason.alias("reason"))


def _character_round_sql(i: int) -> str:
    b = f"b{i}"
    return f"""e{i} AS (SELECT label, k, sum(x) AS s, count(*) AS n FROM (SELECT label, unnest(main) AS x, unnest(range(1, len(main) + 1)) AS k FROM {b} WHERE active) GROUP BY label, k), t{i} AS (SELECT label, list(s ORDER BY k) AS total, max(n) AS n FROM e{i} GROUP BY label),
    p{i} AS (SELECT b.*, total, n, CASE WHEN active AND n > 1 THEN (list_dot_product(main, total) - list_dot_product(main, main)) / (n - 1) ELSE list_dot_product(main, total) / n END AS sim, list_dot_product(main, total) / sqrt(list_dot_product(total, total)) AS near FROM {b} b JOIN t{i} USING (label)),
    o{i} AS (SELECT *, active AND held >= {CHARACTER_LEAST} AND sim < avg(sim) FILTER (active) OVER (PARTITION BY label) - {CHARACTER_SIGMA} * stddev_pop(sim) FILTER (active) OVER (PARTITION BY label) AS bad FROM p{i}),
    b{i + 1} AS (SELECT vec_id, label, main, held, active AND NOT (bad AND n - count(*) FILTER (bad) OVER (PARTITION BY label) >= 2) AS active FROM o{i})"""


CHARACTER_SQL = f"""WITH b0 AS (SELECT vec_id, label, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS main, count(*) OVER (PARTITION BY label) AS held, true AS active FROM vectors), {", ".join(_character_round_sql(i) for i in range(CHARACTER_ROUNDS + 1))},
  z AS (SELECT *, avg(near) FILTER (active) OVER (PARTITION BY label) - {CHARACTER_SIGMA} * stddev_pop(near) FILTER (active) OVER (PARTITION BY label) AS threshold FROM p{CHARACTER_ROUNDS}), y AS (SELECT *, held >= {CHARACTER_LEAST} AND (NOT active OR near < threshold - 1e-6) AS review FROM z)
  SELECT vec_id, label, round(near, 6) + 0.0 AS near, round(CASE WHEN held >= {CHARACTER_LEAST} THEN threshold END, 6) + 0.0 AS threshold, review, CASE WHEN held < {CHARACTER_LEAST} THEN 'insufficient_scope_size' WHEN review THEN 'below_scope_threshold' ELSE 'core_member' END AS reason FROM y"""


@query(CHARACTER_SQL)
def character_outliers(spark: S, sf: str) -> DataFrame:
    t = vectors(spark, sf).select("vec_id", "label", unit(F.col("v")).alias("main"))
    return character_check(t).withColumns({"near": F.round("near", 6) + 0.0, "threshold": F.round("threshold", 6) + 0.0})
