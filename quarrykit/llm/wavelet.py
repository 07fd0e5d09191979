"""Token-ID output as wavelet matrices: one compressed file per shard that can be read at any token.

File format: magic ``WMX2``, then six little-endian unsigned 64-bit numbers (tokens, documents, bits, rank bytes, document bytes, and the
shard's first token in its part) and one for each plane's bytes; then zstd frames of the rank directory, of the documents' table and of
each bit plane by itself, so that reading a token, counting or looking one up unpacks the planes it comes to and nothing else. A plane
holds one bit of every token, most significant first, in the order that the planes above leave: tokens with a 0 keep their order before those
with a 1. The rank directory counts the ones before every 512th bit of each plane. The table holds each document's id and number of tokens.
A shard of 2 ** 17 tokens has planes of 16 KB, which stay in a processor's cache while they are made and undone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.encoding import encoder, spans
from quarrykit.plans.storage import new_path, width

MAGIC, STEP = b"WMX2", 512
SHARDS = "part int, seq int, start_in_part long, n_tokens long, n_docs long, file binary"


def _order(one: np.ndarray) -> np.ndarray:
    """The tokens' places when those with a 0 come before those with a 1, in order."""
    return np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))


class WaveletMatrix:
    """Access, rank and select over one shard's tokens."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray | None], ranks: np.ndarray, frames: list[bytes] | None = None) -> None:
        """``planes`` that are None are unpacked from ``frames`` when they are needed first."""
        self.n, self.bits, self.planes, self.ranks, self.frames = n, bits, planes, ranks, frames

    def _plane(self, p: int) -> np.ndarray:
        if self.planes[p] is None:
            import zstandard

            self.planes[p] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[p], (self.n + 7) // 8), np.uint8)
        return self.planes[p]

    def _zeros(self, p: int) -> int:
        return self.n - self._rank1(p, self.n)

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        n = len(tokens)
        bits = max(1, int(tokens.max()).bit_length()) if n else 1
        a = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        planes: list[np.ndarray | None] = []
        ranks = np.zeros((bits, n // STEP + 1), np.uint32)
        for p in range(bits):
            one = (a & a.dtype.type(1 << (bits - 1 - p))) != 0
            planes.append(np.packbits(one))
            per = np.add.reduceat(one, np.arange(0, n, STEP), dtype=np.uint32) if n else np.zeros(0, np.uint32)
            ranks[p, 1:] = np.cumsum(per)[: n // STEP]
            a = a.take(_order(one))
        return cls(n, bits, planes, ranks)

    def _rank1(self, plane: int, i: int) -> int:
        block = i // STEP
        rest = np.unpackbits(self._plane(plane)[block * STEP // 8 : (i + 7) // 8])[: i - block * STEP]
        return int(self.ranks[plane, block]) + int(rest.sum())

    def _bit(self, plane: int, i: int) -> int:
        return int(self._plane(plane)[i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        """The i-th token."""
        out = 0
        for p in range(self.bits):
            b = self._bit(p, i)
            ones = self._rank1(p, i)
            i = self._zeros(p) + ones if b else i - ones
            out = out << 1 | b
        return out

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` is among the first i tokens."""
        if token >> self.bits:
            return 0
        lo, hi = 0, i
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (self._zeros(p) + a, self._zeros(p) + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Where the k-th (from 0) occurrence of ``token`` is; -1 if there are fewer."""
        if k >= self.count(token):
            return -1
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.rank(token, mid + 1) > k else (mid + 1, hi)
        return lo

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All tokens in order: the planes' permutations undone from the last to the first."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in reversed(range(self.bits)):
            one = np.unpackbits(self._plane(p))[: self.n].view(bool)
            up = np.empty_like(a)
            up[_order(one)] = a
            a = up | (one.astype(a.dtype) << a.dtype.type(self.bits - 1 - p))
        return a

    def to_file(self, doc_ids: list, sizes: np.ndarray, start: int) -> bytes:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        ids = pa.array(doc_ids, pa.int64())
        table = np.asarray(ids.is_null(), bool).astype(np.uint8).tobytes() + ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + np.asarray(sizes, "<u8").tobytes()
        body = [pack(self.ranks.astype("<u4").tobytes()), pack(table), *[pack(self._plane(p).tobytes()) for p in range(self.bits)]]
        return MAGIC + struct.pack(f"<{6 + self.bits}Q", self.n, len(doc_ids), self.bits, len(body[0]), len(body[1]), start, *map(len, body[2:])) + b"".join(body)

    @classmethod
    def from_file(cls, file: bytes) -> tuple[WaveletMatrix, list, np.ndarray, int]:
        """(the matrix, document ids, tokens of each document, the shard's first token in its part)."""
        import zstandard

        if file[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, docs, bits, *sizes, start = struct.unpack_from("<6Q", file, 4)
        sizes += struct.unpack_from(f"<{bits}Q", file, 52)
        parts, at = [], 52 + 8 * bits
        for size in sizes:
            parts.append(file[at : at + size])
            at += size
        unpack = zstandard.ZstdDecompressor().decompress
        ranks = np.frombuffer(unpack(parts[0]), "<u4").reshape(bits, n // STEP + 1)
        table = unpack(parts[1])
        null = np.frombuffer(table, np.uint8, docs)
        ids = np.frombuffer(table, "<i8", docs, docs)
        lengths = np.frombuffer(table, "<u8", docs, 9 * docs)
        return cls(n, bits, [None] * bits, ranks, parts[2:]), [None if x else int(i) for x, i in zip(null, ids, strict=True)], lengths.astype(np.int64), start


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_tokens: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 1 << 20, most_chunks: int = 2_000_000) -> None:
    """Encode all documents in ascending id order and write their shards under ``path``, a file in each row.

    A shard is closed when it holds ``shard_tokens``; a document is never cut, so one longer than that has a shard to itself. The
    container is Parquet, the format that Spark commits atomically to any store; each row's ``file`` is a whole wavelet matrix file.
    Null text is empty (its one token is ``end_id``). Null ids come first, equal ids in the order of a hash of their text. Nothing is written for an empty table.
    """
    key = F.xxhash64(text_col)
    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), key.alias("key")).repartitionByRange(width(docs.sparkSession), "id", "key").sortWithinPartitions("id", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        held_ids: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        have = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, start, have, held_ids, held, sizes
            file = WaveletMatrix.build(np.concatenate(held)).to_file(held_ids, np.concatenate(sizes), start)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start_in_part": [start], "n_tokens": [have], "n_docs": [len(held_ids)], "file": pa.array([file], pa.binary())})
            seq, start, have, held_ids, held, sizes = seq + 1, start + have, 0, [], [], []
            return row

        enc = encoder(tokenizer, most_chunks)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in spans(texts, most_chars):
                tokens, per = enc.encode([t or "" for t in texts[a:b]])
                tokens, per = np.insert(tokens, np.cumsum(per), end_id), per + 1
                ends = np.append(0, np.cumsum(per))
                first = 0
                while first < len(per):  # documents up to the one with which the shard is full
                    upto = min(len(per), max(first + 1, int(np.searchsorted(ends, ends[first] + shard_tokens - have))))
                    held_ids += ids[a + first : a + upto]
                    held.append(tokens[ends[first] : ends[upto]])
                    sizes.append(per[first:upto])
                    have += int(ends[upto] - ends[first])
                    first = upto
                    if have >= shard_tokens:
                        yield close()
        if held_ids:
            yield close()

    ranged.mapInArrow(run, SHARDS).write.parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Each document from its shard's file: id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part that was written
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix, ids, sizes, start = WaveletMatrix.from_file(file.as_py())
                tokens = matrix.decode().astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(tokens.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(ids), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "at": start + ends - sizes, "n_tokens": sizes, "ids_crc32": pa.array(crc, pa.int64())})

    docs = shards.select("part", "file").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_shards(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """``write_shards`` to a new path of the shared folder; the shards as they are read back."""
    spark = docs.sparkSession
    path = new_path(spark, "wavelet")
    write_shards(docs, path, tokenizer, **options)
    return spark.read.schema(SHARDS).parquet(path)
