"""Round trips through manifests and vector shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query
from quarrykit.plans.domain import samples, vectors
from quarrykit.plans.storage import new_path
from quarrykit.sources.manifest import read_manifest, read_vectors, write_manifest, write_vectors

S = SparkSession


@query("SELECT path AS relative_path, CAST(n_chars AS BIGINT) AS source_size, 'image' AS media_kind, scope FROM samples")
def manifest_round_trip(spark: S, sf: str) -> DataFrame:
    """All samples written as a manifest and read back with its checks."""
    path = new_path(spark, "manifest")
    write_manifest(samples(spark, sf).select(F.col("path").alias("relative_path"), F.col("n_chars").cast("long").alias("source_size"), F.lit("image").alias("media_kind"), "scope"), path, "scan")
    return read_manifest(spark, path, "scan")


@query("SELECT vec_id, round(list_sum(embedding::FLOAT[]::DOUBLE[]), 5) + 0.0 AS total FROM embeddings WHERE vec_id IN (SELECT sample_id FROM samples WHERE state = 'valid')")
def vector_shard_round_trip(spark: S, sf: str) -> DataFrame:
    """All vectors written as a shard; those of valid samples read back with its checks."""
    path = new_path(spark, "vectors")
    v = vectors(spark, sf)
    write_vectors(v, path, "model")
    wanted = samples(spark, sf).where("state = 'valid'").select(F.col("sample_id").alias("vec_id")).join(v.select("vec_id"), "vec_id", "left_semi")
    t = read_vectors(spark, path, "model", wanted)
    return t.select("vec_id", (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"))
