"""A corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed to their target weights; what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import exact_dedup, jaccard_join, mixing, packing, string_kernel
from quarrykit.llm.queries import domain_column, tokenizer_path, weight
from quarrykit.plans.storage import new_path
from quarrykit.sources.tables import table

#: Share of the tokens that the mix keeps; leaves short of their target hand their budget on, and no document is repeated.
MIX_SHARE = 0.9


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go, with all columns as they were. It is trained on the labelled rows of the input; without any, no document goes.

    Null and empty texts have no evidence and stay; repeated rows are judged alike; an empty table stays empty.
    """
    model = string_kernel.train(*string_kernel.training_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return string_kernel.drop_toxic(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the smallest id stays; a null id is larger than every other; of rows that repeat id and text one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays. Texts without words are linked with nothing and stay; ids may repeat or be null."""
    return jaccard_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf keeps the whole documents of its seeded order that its token budget reaches into.

    A null language or source is a leaf of its own. Documents without words cost nothing: they stay where the leaf's budget takes a whole epoch.
    """
    return mixing.mixed_documents(docs, [domain_column(), F.col("lang"), F.col("source")], weight, MIX_SHARE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, in pieces of binary lengths; null text is empty (its one token is the end)."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("jaccard_join", near_copies), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The string kernel, the hash-ordered mix and the tokenizer aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
