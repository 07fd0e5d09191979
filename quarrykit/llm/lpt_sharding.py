"""Sharding by longest-processing-time scheduling: whole groups, largest first, to the least-loaded shard through a heap.

Groups of the same size are alike to the schedule, so it goes over distinct sizes and how many groups have each: a few groups go one by one through
the heap, many at once by the threshold up to which the heap would fill every shard. Both give what one heap over all groups gives (ties: the lowest shard).
Distinct sizes add up to at most all bytes, so there are at most sqrt(2 * bytes) of them, however many groups there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.plans.storage import staged, width

#: Distinct sizes whose shares are sent to every task (16 numbers each); more of them are joined by size.
SENT = 100_000


def _at_once(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` items of one size each shard gets: the ``count`` least of all load + t * size, ties to the lowest shard."""
    below = lambda level: [max(0, -(-(level - x) // size)) for x in loads]
    lo, hi = min(loads), min(loads) + size * count + 1
    while hi - lo > 1:  # the highest level below which there are no more than ``count``
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if sum(below(mid)) <= count else (lo, mid)
    given = below(lo)
    left = count - sum(given)
    for i, x in enumerate(loads):
        if left and x + given[i] * size == lo:
            given[i] += 1
            left -= 1
    return given


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """For each (size, groups of that size), largest first: how many of them each shard gets."""
    loads = [0] * shards
    for size, count in sorted(sizes, reverse=True):
        if count > 2 * shards:
            given = _at_once(loads, size, count)
        else:
            given, heap = [0] * shards, [(x, i) for i, x in enumerate(loads)]
            heapq.heapify(heap)
            for _ in range(count):
                load, i = heap[0]
                given[i] += 1
                heapq.heapreplace(heap, (load + size, i))
        loads = [x + n * size for x, n in zip(loads, given, strict=True)]
        yield size, given


def _numbered(rows: DataFrame, key: str, order: list[str], chunks: int, out: str) -> DataFrame:
    """``rows`` with ``out``: numbers without gaps from 0 within each ``key``, by ``chunk`` (0 to chunks - 1), then by ``order``; no key is sorted in one task."""
    counts = rows.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # chunks rows a key at most
    inside = F.row_number().over(Window.partitionBy(key, "chunk").orderBy(*order))
    return rows.withColumn("inside", inside).join(offsets, [key, "chunk"]).withColumn(out, F.col("base") + F.col("inside") - 1).drop("base", "inside")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes + 1; null text: 1), text_crc32, law ``bytes``, shard, slot, grown_shard (null).

    Equal texts share a shard; null and empty texts count as equal. Slots of a shard run from 0 without gaps; within a shard rows are numbered by a hash
    chunk of the row, then by id. Rows that repeat id and text get slots of their own; null ids are documents like others. An empty table gives no rows.
    Columns other than id and text are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(text).alias("h"))
    spark = docs.sparkSession
    chunks = 4 * width(spark)
    groups = t.groupBy("h").agg(F.sum("size").alias("bytes")).withColumn("chunk", F.pmod(F.xxhash64("h"), F.lit(chunks)).cast("int"))
    groups = staged(groups, "groups")
    sizes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()]  # see the module's bound
    shares = []
    for size, given in schedule(sizes, shards):
        upto = 0
        shares.append((size, [upto := upto + n for n in given]))
    share = spark.createDataFrame(shares, "bytes long, upto array<long>")
    share = F.broadcast(share) if len(shares) <= SENT else share
    ranked = _numbered(groups, "bytes", ["h"], chunks, "nth").join(share, "bytes")
    home = ranked.select("h", F.size(F.filter("upto", lambda x: x <= F.col("nth"))).alias("shard"))
    t = t.join(home, "h").withColumn("chunk", F.pmod(F.xxhash64("id", "h"), F.lit(chunks)).cast("int"))
    out = _numbered(staged(t, "placed"), "shard", ["id", "h"], chunks, "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
