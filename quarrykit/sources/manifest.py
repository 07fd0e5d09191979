"""Manifests and vector shards: written once, read back only if whole.

Both are folders: the rows, and beside them a header of one line, written last, so a folder without header was cut off. The header holds the number of
rows and a digest that doesn't depend on order or files: the bitwise exclusive or of the rows' 64-bit hashes, and the sum of their halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators.evidence import UNSAFE

#: Fixed value: version of the layout.
SCHEMA_VERSION = 1
HEADER = "schema_version int, config_hash string, item_count long, digest string"


def _sums(df: DataFrame, *hashed: Column) -> tuple[int, str]:
    h = F.xxhash64(*hashed)
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
    n, x, a, b = df.select(h.alias("h"), low.alias("l"), high.alias("u")).agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.col("l").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.col("u").cast("decimal(38,0)")), F.lit(0))).first()
    return n, f"{x}:{a}:{b}"


def _put_header(spark: SparkSession, path: str, config_hash: str, n: int, digest: str) -> None:
    spark.createDataFrame([(SCHEMA_VERSION, config_hash, n, digest)], HEADER).coalesce(1).write.json(f"{path}/header")


def _header(spark: SparkSession, path: str, config_hash: str) -> tuple[int, str]:
    rows = spark.read.schema(HEADER).json(f"{path}/header").collect()  # one line
    if len(rows) != 1 or rows[0]["schema_version"] != SCHEMA_VERSION:
        raise ValueError("no header of a known version")
    if rows[0]["config_hash"] != config_hash:
        raise ValueError("the header is of another configuration")
    return rows[0]["item_count"], rows[0]["digest"]


MEDIA = "relative_path string, source_size long, media_kind string, scope string"


def write_manifest(media: DataFrame, path: str, config_hash: str) -> None:
    """JSON lines of (relative_path, source_size, media_kind, scope), and their header. Null columns are left out of a line."""
    columns = [c.split()[0] for c in MEDIA.split(", ")]
    media.select(columns).write.json(f"{path}/media")
    spark = media.sparkSession
    _put_header(spark, path, config_hash, *_sums(spark.read.text(f"{path}/media"), F.col("value")))


def read_manifest(spark: SparkSession, path: str, config_hash: str) -> DataFrame:
    """The manifest's rows; an error if the header is missing or another's, a line was lost, added or changed, isn't a record, or names a path outside the source."""
    n, digest = _header(spark, path, config_hash)
    lines = spark.read.text(f"{path}/media")
    found = _sums(lines, F.col("value"))
    if found[0] != n:
        raise ValueError(f"{found[0]} records, the header says {n}")
    if found[1] != digest:
        raise ValueError("the records' digest is not the header's")
    r = F.from_json("value", MEDIA)
    fine = r["relative_path"].isNotNull() & (r["source_size"] >= 0) & ~r["relative_path"].rlike(UNSAFE)
    checked = F.when(fine, r).otherwise(F.raise_error(F.concat(F.lit("unsafe or broken record: "), F.col("value"))).cast(f"struct<{', '.join(': '.join(c.split()) for c in MEDIA.split(', '))}>"))
    return lines.select(checked.alias("r")).select("r.*")


def write_vectors(vectors: DataFrame, path: str, config_hash: str) -> None:
    """A Parquet folder of (vec_id, v) with its header; ids are unique, vectors of one width and finite, or nothing is written."""
    bad = F.col("vec_id").isNull() | F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    t = vectors.select("vec_id", F.col("v").cast("array<float>").alias("v"))
    per = t.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.count_if(bad).alias("bad"))
    twice, low, high, odd = per.agg(F.count_if(F.col("n") > 1), F.min("low"), F.max("high"), F.sum("bad")).first()
    if twice or odd or low != high:
        raise ValueError(f"{twice} ids occur twice, {odd or 0} rows are null or not finite, widths are {low} to {high}")
    t.write.parquet(f"{path}/rows")
    spark = vectors.sparkSession
    _put_header(spark, path, config_hash, *_sums(spark.read.parquet(f"{path}/rows"), F.col("vec_id"), F.col("v")))


def read_vectors(spark: SparkSession, path: str, config_hash: str, wanted: DataFrame | None = None) -> DataFrame:
    """(vec_id, v) of a folder whose rows are those that were written; of the ids of ``wanted`` (vec_id) only, each of which must be there."""
    n, digest = _header(spark, path, config_hash)
    t = spark.read.parquet(f"{path}/rows")
    if _sums(t, F.col("vec_id"), F.col("v")) != (n, digest):
        raise ValueError("the shard's rows are not those of its header")
    if wanted is None:
        return t
    ids = wanted.select("vec_id").distinct()
    if not ids.join(t.select("vec_id"), "vec_id", "left_anti").isEmpty():
        raise ValueError("the shard lacks wanted ids")
    return t.join(ids, "vec_id", "left_semi")
