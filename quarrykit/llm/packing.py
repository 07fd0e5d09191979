"""Packing by power-of-two decomposition: documents in pieces of binary lengths, equal lengths in a bucket.

A document of n tokens becomes n // longest pieces of the longest length and one piece for each set bit of the rest,
largest first. Every piece is a sequence of its own: no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.encoding import encoder, spans
from quarrykit.plans.storage import staged

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def piece_lengths(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the document, length) of every piece, documents in order, each one's pieces largest first."""
    bits = longest.bit_length() - 1
    whole = sizes >> bits
    rest = sizes & (longest - 1)
    set_ = (rest[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    times = np.concatenate([whole[:, None], set_], 1)
    lengths = np.tile(1 << np.arange(bits, -1, -1), len(sizes))
    flat = times.ravel()
    return np.repeat(np.repeat(np.arange(len(sizes)), bits + 1), flat), np.repeat(lengths, flat)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = 4096, keep_tokens: bool = False, id_col: str = "doc_id", text_col: str = "text", most_chunks: int = 350_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``keep_tokens`` its token ids.

    Null text is empty (its one token is ``end_id``). Each row of the input is a document of its own, also where id and text repeat; null ids stay
    null. An empty table gives no rows. Sequence ids are dense: sequences of a bucket are numbered one after another, longest bucket first. Nothing is
    shuffled: a task numbers the pieces of each length as it makes them, and the counts of each task and length (a bounded table) place them.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made: dict[int, int] = {}
        enc = encoder(tokenizer, most_chunks)
        for batch in batches:
            all_ids, all_texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in spans(all_texts):
                tokens, per = enc.encode([t or "" for t in all_texts[a:b]])
                tokens = np.insert(tokens, np.cumsum(per), end_id).astype("<u4")
                per = per + 1
                doc, lengths = piece_lengths(per, longest)
                ends = np.cumsum(lengths)
                at = ends - lengths
                raw = memoryview(tokens.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), ends.tolist(), strict=True)]
                nth = np.zeros(len(lengths), np.int64)
                for size in np.unique(lengths).tolist():
                    mine = np.flatnonzero(lengths == size)
                    nth[mine] = made.get(size, 0) + np.arange(len(mine))
                    made[size] = made.get(size, 0) + len(mine)
                cols = {"doc_id": all_ids.slice(a, b - a).take(pa.array(doc)), "start": at - (np.cumsum(per) - per)[doc], "length": lengths.astype(np.int64), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": per[doc], "part": pa.array(np.full(len(doc), part, np.int32)), "nth": nth}
                if keep_tokens:
                    cols["tokens"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    schema = PIECES + (", tokens array<int>" if keep_tokens else "")
    pieces = staged(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))  # tasks * 13 rows at most
    before = Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = pieces.join(F.broadcast(base), ["length", "part"])
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    return out.select(*cols, *(["tokens"] if keep_tokens else []))
