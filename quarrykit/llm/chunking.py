"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks boundaries; normalised chunking asks for more zero bits before the
normal size and fewer after it. The fingerprint is the set of the chunks' digests, each with its chunk's length, as a
hexadecimal string; containment weighs shared digests by length. An edit moves only the boundaries near it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.plans.storage import width

LEAST, NORMAL, MOST = 16, 48, 192
STRICT, LOOSE = 0xFC000000, 0xF0000000  # top bits: they depend on all of the last 32 bytes
ODD = np.uint64(0x9E3779B97F4A7C15)


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest() for i in range(n)), np.uint64)


GEAR = (_random_words(256, 1) >> np.uint64(32)).astype(np.uint32)
LETTER = _random_words(256, 2)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of a byte array end."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k].copy() << np.uint32(k)
    loose = np.flatnonzero((h & np.uint32(LOOSE)) == 0)
    strict = loose[(h[loose] & np.uint32(STRICT)) == 0].tolist()
    loose = loose.tolist()
    out, at = [], 0
    while n - at > LEAST:
        cut = min(n, at + MOST)
        i = bisect_right(strict, at + LEAST - 1)
        if i < len(strict) and strict[i] < at + NORMAL:
            cut = min(cut, strict[i] + 1)
        else:
            j = bisect_right(loose, at + NORMAL - 1)
            if j < len(loose):
                cut = min(cut, loose[j] + 1)
        out.append(cut)
        at = cut
    if at < n:
        out.append(n)
    return out


def chunk_words(data: bytes) -> np.ndarray:
    """The distinct chunks, sorted, each in 64 bits: 56 of its digest and 8 of its length."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.array(chunk_ends(raw), np.int64)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.append(0, ends[:-1])
    lengths = ends - starts
    # a polynomial in ODD over the bytes of each chunk, each byte replaced by a random word
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    digest = _mixed(np.add.reduceat(LETTER[raw] * POWERS[place], starts) + lengths.astype(np.uint64))
    return np.unique((digest & ~np.uint64(255)) | lengths.astype(np.uint64))


with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.full(MOST + LEAST + 1, ODD, np.uint64))


def to_string(words: np.ndarray) -> str:
    return words.astype(">u8").tobytes().hex()


def from_string(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The shared chunks' length over that of the smaller set: 1 if one holds the other. Two empty sets: 1; one: 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    weight = lambda w: int((w & np.uint64(255)).sum())
    return weight(np.intersect1d(a, b, assume_unique=True)) / min(weight(a), weight(b))


def fingerprint(text: str | None) -> str:
    """Null counts as empty, whose fingerprint is the empty string."""
    return to_string(chunk_words((text or "").encode()))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, ghost, id, text, key) so that sorting a bucket by (ghost, id, key) gives a run of documents in ascending id
    order, then a ghost: the document after the run (behind the last run: the first document).

    Ids are cut into ranges at approximate quantiles; each range's first id is found exactly. Null ids come first.
    """
    spark = docs.sparkSession
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = 2 * width(spark)
    cuts = sorted(set(t.select("id").approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)))
    splits = [float("-inf"), *cuts, float("inf")] if cuts else [float("-inf"), 0.0, float("inf")]
    t = t.withColumn("_at", F.coalesce(F.col("id").cast("double"), F.lit(-1.7e308)))
    t = Bucketizer(splits=splits, inputCol="_at", outputCol="_b").transform(t).drop("_at").withColumn("bucket", F.col("_b").cast("int")).drop("_b")
    firsts = t.groupBy("bucket").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("null")).orderBy("bucket").collect()  # a row per range
    before = {r["bucket"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    heads = [r["id"] for r in firsts if not r["null"]]
    is_head = F.col("id").isin(heads) | (F.col("id").isNull() if len(heads) < len(firsts) else F.lit(False))
    prev = F.element_at(F.lit([before.get(b, 0) for b in range(len(splits) - 1)]), F.col("bucket") + 1)
    ghosts = t.where(is_head).withColumn("bucket", prev)
    both = t.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    return both.withColumn("key", F.xxhash64("text")).repartition(width(spark), "bucket").sortWithinPartitions("bucket", "ghost", "id", "key").select("bucket", "ghost", "id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's.

    Edited: the last floor(n_chars / 4) code points are replaced by as many first ones (or all) of the next document. Null text is empty. Equal ids
    are in the order of a hash of their text; null ids come first. A table of one row has itself as the next document; an empty one gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, id, text, words) of the document whose next one isn't known yet
        for batch in batches:
            rows: list[tuple] = []
            for bucket, ghost, id_, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ghost and (last is None or last[0] != bucket):
                    continue  # a further row of the next document's id
                text = text or ""
                words = chunk_words(text.encode())
                if last is not None and last[0] == bucket:
                    _, lid, ltext, lwords = last
                    cut = len(ltext) // 4
                    edited = (ltext[: len(ltext) - cut] + text[:cut]).encode()
                    ewords = chunk_words(edited)
                    rows.append((lid, len(ltext), hashlib.sha256(edited).hexdigest(), to_string(lwords), to_string(ewords), containment(lwords, ewords), containment(lwords, words)))
                last = None if ghost else (bucket, id_, text, words)
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                names = [c.split()[0] for c in OUT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return with_next(docs, id_col, text_col).mapInArrow(run, OUT)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, fingerprint string")
