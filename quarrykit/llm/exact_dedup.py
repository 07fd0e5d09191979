"""Exact dedup [native]: group by a 128-bit content hash, keep the smallest stable id, compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.names import columns, free

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: h (128-bit hash), keep_id, group_size, sha (names the text from here on).

    Grouping by (h, text) has Spark's aggregate compare the bytes of the texts of a hash, so a collision makes two groups.
    Copies are combined before the shuffle, so a group that holds a third of all rows costs one row per task, and each text is
    shuffled once for each task that has it. Behind the comparison a group is named by h and its text's SHA-256.
    """
    t = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    t = t.select("id", "body", F.md5("body").alias("h"))
    groups = t.groupBy("h", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("h", "keep_id", "group_size", F.sha2("body", 256).alias("sha"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest id stays. Rows that repeat both id and text: one of them stays. A null id is larger than
    every other; a group of null ids only has keep_id null and keeps one row. An empty table gives no rows. Further columns are not read.
    """
    groups = duplicate_groups(docs, id_col, text_col).withColumnsRenamed({"h": "gh"})
    t = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    t = t.select("id", F.md5("body").alias("h"), F.sha2("body", 256).alias("text_sha256"))
    t = t.withColumn("rep", F.row_number().over(Window.partitionBy("id", "h").orderBy("text_sha256")))
    out = t.join(groups, (t["h"] == groups["gh"]) & (t["text_sha256"] == groups["sha"]))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("rep") == 1)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns and no other. Of rows that repeat id and text, the first by a hash of all columns stays.

    Null counts as empty; a null id is larger than every other; an empty table stays empty. Columns of any name are handed on as they are.
    """
    h, sha, nth, keep, gh, gsha = free(docs, "_h", "_sha", "_nth", "_keep", "_gh", "_gsha")
    stay = duplicate_groups(docs, id_col, text_col).select(F.col("keep_id").alias(keep), F.col("h").alias(gh), F.col("sha").alias(gsha))
    body = normalised(F.col(text_col))
    t = docs.withColumns({h: F.md5(body), sha: F.sha2(body, 256)})
    t = t.join(stay, t[id_col].eqNullSafe(stay[keep]) & (t[h] == stay[gh]) & (t[sha] == stay[gsha]), "left_semi")
    own = columns(docs)
    first = Window.partitionBy(F.col(id_col), h, sha).orderBy(F.xxhash64(*own))
    return t.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*own)
