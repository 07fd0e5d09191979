"""The component graph: closure, order, dependency states, and the registry of model functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query

S = SparkSession

#: Components with their phase order, and what each takes its input from.
COMPONENTS = {
    "media.scan": (10, []), "metrics.technical": (20, ["media.scan"]), "feature.clip_l14": (30, ["media.scan"]), "score.aesthetic_domain": (40, ["feature.clip_l14"]), "detect.ai": (41, ["feature.clip_l14"]), "evidence.ocr": (42, ["media.scan"]),
    "evidence.watermark": (43, ["media.scan"]), "style.artist": (50, ["media.scan"]), "embedding.semantic": (60, ["media.scan"]), "analysis.sae": (69, ["embedding.semantic"]), "cluster.hierarchy": (70, ["embedding.semantic", "style.artist"]),
    "review.decisions": (80, ["media.scan"]), "latent.resolve": (110, ["media.scan"]), "export.dataset": (120, ["review.decisions", "metrics.technical"]),
}
EDGES = [(c, p) for c, (_, ps) in COMPONENTS.items() for p in ps]
EDGE_SQL = "edges(consumer, producer) AS (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in EDGES) + ")"
NODE_SQL = "nodes(id, phase) AS (VALUES " + ", ".join(f"('{c}', {o})" for c, (o, _) in COMPONENTS.items()) + ")"


def edges(spark: S) -> DataFrame:
    return spark.createDataFrame(EDGES, "consumer string, producer string")


def nodes(spark: S) -> DataFrame:
    return spark.createDataFrame([(c, o) for c, (o, _) in COMPONENTS.items()], "id string, phase int")


def closure(spark: S) -> DataFrame:
    """(consumer, producer) over any number of steps, by recursion over the graph, which is acyclic."""
    edges(spark).createOrReplaceTempView("quarrykit_edges")
    return spark.sql("""WITH RECURSIVE r(consumer, producer, depth) AS (SELECT consumer, producer, 1 FROM quarrykit_edges
      UNION ALL SELECT r.consumer, e.producer, r.depth + 1 FROM r JOIN quarrykit_edges e ON r.producer = e.consumer WHERE r.depth < 20) SELECT consumer, producer, max(depth) AS depth FROM r GROUP BY consumer, producer""")


REACH_SQL = EDGE_SQL + ", reach AS (SELECT consumer, producer, 1 AS depth FROM edges UNION ALL SELECT r.consumer, e.producer, r.depth + 1 FROM reach r JOIN edges e ON r.producer = e.consumer)"


@query(f"WITH RECURSIVE {REACH_SQL} SELECT consumer, producer, CAST(max(depth) AS INT) AS depth FROM reach GROUP BY ALL")
def component_closure(spark: S, sf: str) -> DataFrame:
    return closure(spark)


@query(f"WITH RECURSIVE {REACH_SQL}, {NODE_SQL}, want AS (SELECT DISTINCT producer AS id FROM reach WHERE consumer IN ('cluster.hierarchy', 'export.dataset') UNION SELECT unnest(['cluster.hierarchy', 'export.dataset'])) SELECT id, row_number() OVER (ORDER BY phase, id) AS place FROM want JOIN nodes USING (id)")
def component_topo(spark: S, sf: str) -> DataFrame:
    """The selected components with all they need, in run order (phases rise along every edge)."""
    from pyspark.sql import Window

    chosen = ["cluster.hierarchy", "export.dataset"]
    need = closure(spark).where(F.col("consumer").isin(chosen)).select(F.col("producer").alias("id")).unionByName(spark.createDataFrame([(c,) for c in chosen], "id string")).distinct()
    return need.join(nodes(spark), "id").select("id", F.row_number().over(Window.orderBy("phase", "id")).cast("long").alias("place"))


@query(f"WITH RECURSIVE {REACH_SQL}, {NODE_SQL} SELECT id, CAST(coalesce(max(depth), 0) AS INT) AS level FROM nodes LEFT JOIN reach ON reach.consumer = id GROUP BY id")
def dependency_order(spark: S, sf: str) -> DataFrame:
    """Each node's longest chain of dependencies: nodes of one level can run together."""
    return nodes(spark).join(closure(spark), F.col("consumer") == F.col("id"), "left").groupBy("id").agg(F.coalesce(F.max("depth"), F.lit(0)).alias("level"))


@query(f"WITH RECURSIVE {REACH_SQL}, {NODE_SQL} SELECT id, CASE WHEN phase % 4 = 1 THEN 'failed' WHEN count(*) FILTER (p.pphase % 4 = 1) > 0 THEN 'blocked' ELSE 'ready' END AS state FROM nodes LEFT JOIN (SELECT consumer, n2.phase AS pphase FROM reach JOIN nodes n2 ON n2.id = producer) p ON p.consumer = id GROUP BY id, phase")
def dependency_state(spark: S, sf: str) -> DataFrame:
    """A node is blocked if anything it depends on, however far, has failed."""
    bad = nodes(spark).where("phase % 4 = 1").select(F.col("id").alias("producer"))
    hit = closure(spark).join(F.broadcast(bad), "producer", "left_semi").select(F.col("consumer").alias("id")).distinct().withColumn("hit", F.lit(True))
    return nodes(spark).join(hit, "id", "left").select("id", F.when(F.col("phase") % 4 == 1, "failed").when(F.col("hit"), "blocked").otherwise("ready").alias("state"))


@query(f"WITH {NODE_SQL} SELECT id, CASE WHEN phase < 50 THEN 'done' WHEN phase = 50 THEN 'running' ELSE 'waiting' END AS status FROM nodes")
def component_run_status(spark: S, sf: str) -> DataFrame:
    return nodes(spark).select("id", F.when(F.col("phase") < 50, "done").when(F.col("phase") == 50, "running").otherwise("waiting").alias("status"))


#: Memory tiers and the batch size of each.
TIERS = ((8, 4), (12, 8), (16, 16), (24, 32))


@query("SELECT m AS memory, CASE WHEN m >= 24 THEN 32 WHEN m >= 16 THEN 16 WHEN m >= 12 THEN 8 WHEN m >= 8 THEN 4 ELSE 1 END AS batch FROM (SELECT CAST(unnest(range(0, 33, 2)) AS BIGINT) AS m)")
def tier_lookup(spark: S, sf: str) -> DataFrame:
    batch: Column = F.lit(1)
    for memory, size in TIERS:
        batch = F.when(F.col("memory") >= memory, size).otherwise(batch)
    return spark.range(0, 33, 2).select(F.col("id").alias("memory"), batch.alias("batch"))


_MODELS: dict[str, Callable[[Column], Column]] = {}


def register_model(name: str, f: Callable[[Column], Column]) -> None:
    """Put a scoring function (features -> score; a pandas UDF or a Column expression) into the registry."""
    if name in _MODELS:
        raise ValueError(f"model {name} is registered already")
    _MODELS[name] = f


def model(name: str) -> Callable[[Column], Column]:
    return _MODELS[name]
