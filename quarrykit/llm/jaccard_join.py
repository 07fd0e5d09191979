"""N-gram Jaccard join by prefix trees: exact components of documents whose five-word shingle sets have a similarity of 0.8 or more.

1. Texts with equal sets are one class (128-bit key), whatever their number.
2. A class can link only if at most a fifth of its shingles are its own. Shingles of a fixed part of the number space are counted
   over all classes; a class with too many of its own there is out. This reads every document and is exact: it drops no link.
3. The sets of the classes left are counted in full. Rarest first is the global order; two linked sets share a shingle among
   their first n // 5 + 1. Classes that share one (over any chain) form a cluster: no link leaves it.
4. Each cluster goes to one task, whose trie finds its components. A cluster of more than a task's load is cut in blocks: each block joins
   itself, then the first block meets the others; of what is not connected then, a class goes only to those blocks that hold a class of
   another component with a prefix shingle in common.
5. Links become components over all; a class hands its component to its documents.

What is shuffled by shingle travels as packed number blocks, and a shingle that many documents of a batch hold is sent once for all of them. Buckets, blocks
and units are as many as keep each within MOST or LOAD shingles, whatever the size of the corpus.

Shingles are told apart by 64-bit numbers and classes by 128-bit keys (see ``shingles``): a pair of documents is judged wrongly only if
two different shingles of theirs share a number, a chance under n * m / 2 ** 64 for sets of n and m.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.names import columns, free
from quarrykit.llm.shingles import shingle_set_and_key
from quarrykit.llm.trie_join import join_components
from quarrykit.operators.graph import connected_components
from quarrykit.plans.storage import discard, staged, width

#: The part of the number space whose shingles are counted in step 2. Any part is exact; a larger one drops more classes early and ships more.
PART = int(0.4 * 2**64)
#: Shingles of one task's block of a cluster.
LOAD = 300_000
#: Shingles that one bucket's count or one block of sets takes into memory at once; there are as many buckets and blocks as that asks for.
MOST = 2_000_000
#: Buckets of the number space at least, whatever the cluster's width: what a bucket sends back follows the number of buckets.
BUCKETS = 64
#: Bits of the filter of survivors' ids: 16 for each, and no more than 2 ** 29 (64 MB) for any number of them.
LEAST_BITS, MOST_BITS, BITS_EACH = 2**15, 2**29, 16


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _infos(docs: DataFrame) -> DataFrame:
    """(id, cls, n, s): each document's class, set size, and shingles in the counted part. What follows the text in ``docs`` (id, text, name) is handed on."""
    more = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, s = [], [], []
            for t in batch.column(1):
                shingles, key = shingle_set_and_key(t.as_py())
                keys.append(key)
                n.append(len(shingles))
                s.append(int(np.searchsorted(shingles, np.uint64(PART))))
            yield _rows(id=batch.column(0), cls=pa.array(keys, pa.binary()), n=pa.array(n, pa.int64()), s=pa.array(s, pa.int64()), **{c: batch.column(2 + k) for k, c in enumerate(more)})

    return docs.mapInArrow(run, ", ".join(["id long, cls binary, n long, s long", *[f"{c} string" for c in more]]))


def _runs(new: np.ndarray) -> np.ndarray:
    """Number of the run each place is in, from the places where runs begin."""
    return np.cumsum(new) - 1


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _shared_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(cls, shared): for each class with any, how many of its shingles in the counted part another class has too, or more.

    Within a batch of rows a shingle of several classes is settled at once: it travels as four bytes without its classes, so a
    shingle that a third of all documents hold is sent once a batch. Others travel with their class's key. More than there are may be counted (a
    class with copies in several batches; different shingles with the same 32 bits within a bucket): that keeps a class in, and loses none.
    """
    step = PART // buckets + 1
    shift = np.uint64(max(0, step.bit_length() - 32))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own_bucket = -1 - (TaskContext.get().partitionId() << 24)  # what a batch settles is a group of its own
        for nth, texts in enumerate(part for batch in batches for part in _slices(batch.column(0))):
            seen: dict[bytes, np.ndarray] = {}
            for t in texts:
                s, key = shingle_set_and_key(t.as_py())
                if key:
                    seen.setdefault(key, s[: np.searchsorted(s, np.uint64(PART))])
            tokens = np.concatenate([*seen.values(), np.zeros(0, np.uint64)])
            if not len(tokens):
                continue
            keys = np.frombuffer(b"".join(seen), "V16")
            owner = np.repeat(np.arange(len(seen), dtype=np.int32), [len(s) for s in seen.values()])
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            first = _begins(tokens)
            run = _runs(first)
            several = np.bincount(run) > 1
            local = np.bincount(owner[several[run]], minlength=len(seen))
            hit = np.flatnonzero(local)
            yield _rows(bucket=[own_bucket - nth], tokens=pa.array([local[hit].astype(np.int64).tobytes()], pa.binary()), owner=pa.array([keys[hit].tobytes()], pa.binary()), many=pa.array([b""], pa.binary()))
            tokens, owner = tokens[first], owner[first]
            bucket = (tokens // np.uint64(step)).astype(np.int64)
            short = ((tokens - bucket.astype(np.uint64) * np.uint64(step)) >> shift).astype(np.uint32)
            at = np.flatnonzero(_begins(bucket))
            for a, b in zip(at.tolist(), np.append(at[1:], len(bucket)).tolist(), strict=True):
                m = several[a:b]
                yield _rows(bucket=[int(bucket[a])], tokens=pa.array([short[a:b][~m].tobytes()], pa.binary()), owner=pa.array([keys[owner[a:b][~m]].tobytes()], pa.binary()), many=pa.array([short[a:b][m].tobytes()], pa.binary()))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        if part["bucket"].iloc[0] < 0:  # what a batch has settled
            return pd.DataFrame({"cls": [k for o in part["owner"] for k in _cut(o)], "shared": np.concatenate([np.frombuffer(t, np.int64) for t in part["tokens"]])})
        tokens = np.concatenate([np.frombuffer(t, np.uint32) for t in part["tokens"]])
        many = np.unique(np.concatenate([np.frombuffer(t, np.uint32) for t in part["many"]]))
        raw = b"".join(part["owner"])
        high, low = np.frombuffer(raw, np.uint64).reshape(-1, 2).T
        order = np.argsort(tokens.astype(np.uint64) << np.uint64(32) | high >> np.uint64(32))
        tokens, high, low = tokens[order], high[order], low[order]
        first = _begins(tokens)
        new = _begins(tokens, high, low)
        run = _runs(first)
        held = np.bincount(run, new)[run] > 1 if len(run) else np.zeros(0, bool)
        if len(many):
            held |= many[np.minimum(np.searchsorted(many, tokens), len(many) - 1)] == tokens
        held &= new
        high, low = high[held], low[held]
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        own = _begins(high, low)
        return pd.DataFrame({"cls": _cut(np.stack([high[own], low[own]], 1).tobytes()), "shared": np.bincount(_runs(own), minlength=int(own.sum())).astype(np.int64)})

    dealt = docs.select("text").mapInArrow(deal, "bucket long, tokens binary, owner binary, many binary")
    return dealt.groupBy("bucket").applyInPandas(count, "cls binary, shared long").groupBy("cls").agg(F.sum("shared").alias("shared"))


def _slices(texts: pa.Array, most: int = 16 << 20) -> Iterator[pa.Array]:
    """Runs of texts of about ``most`` bytes together, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, upto - at)
        at = upto


def _cut(keys: bytes) -> list[bytes]:
    return [keys[a : a + 16] for a in range(0, len(keys), 16)]


def _id_filter(survivors: DataFrame) -> tuple[int, bytes]:
    """(bits, filter): a bit is set for the hash of each survivor's id. Its size is bounded; more survivors than it is made for let more others through."""
    bits = LEAST_BITS
    wanted = min(MOST_BITS, BITS_EACH * survivors.count())
    while bits < wanted:
        bits *= 2
    place = F.pmod(F.xxhash64("rep"), F.lit(bits))
    parts = survivors.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("map"))
    out = bytearray(bits // 8)
    for part, found in parts.collect():  # one row of 4 KB for each 2 ** 15 bits: at most 64 MB
        out[4096 * part : 4096 * part + len(found)] = found
    return bits, bytes(out)


def _survivor_sets(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """(block, at, cls, n, tokens): the set of each surviving class once; block and at number it.

    Texts are not shuffled: a filter of bounded size picks nearly only survivors' rows, and the join by class drops the sets of others.
    """
    bits, raw = _id_filter(survivors)
    id_filter = docs.sparkSession.sparkContext.broadcast(raw)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(id_filter.value, np.uint8)
        for batch in batches:
            found: dict[bytes, np.ndarray] = {}
            p = batch.column(0).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero((held[p >> 3] >> (p & 7).astype(np.uint8)) & 1).tolist():
                s, key = shingle_set_and_key(batch.column(1)[i].as_py())
                if key:
                    found.setdefault(key, s)
            yield _rows(cls=pa.array(list(found), pa.binary()), tokens=pa.array([s.tobytes() for s in found.values()], pa.binary()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, at, have = TaskContext.get().partitionId() << 16, 0, 0
        for batch in batches:
            lengths = [len(t.as_py()) // 8 for t in batch.column(1)]
            blocks, places = [], []
            for n in lengths:
                if have and have + n > MOST:
                    block, at, have = block + 1, 0, 0
                blocks.append(block)
                places.append(at)
                at, have = at + 1, have + n
            yield _rows(block=pa.array(blocks, pa.int64()), at=pa.array(places, pa.int64()), cls=batch.column(0), n=pa.array(lengths, pa.int64()), tokens=batch.column(1))

    rows = docs.select(F.pmod(F.xxhash64("id"), F.lit(bits)).alias("p"), "text").mapInArrow(sets, "cls binary, tokens binary")
    # survivors grow with the corpus, so they are never broadcast
    rows = rows.join(survivors.select("cls").hint("merge"), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "tokens")
    return staged(rows.mapInArrow(number, "block long, at long, cls binary, n long, tokens binary"), "sets")


def _ordered(sets: DataFrame) -> DataFrame:
    """(v, cls, n, prefix, body): of each class that can still link, the shingles another class has too; the rarest ones of its prefix apart.

    A block sends each of its shingles once a batch, with its count there, and gets those back that more than one class holds, so a shingle
    of all classes is sent as often as there are batches.
    """
    buckets = _parts(sets, "n", BUCKETS, MOST)
    step = 2**64 // buckets + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            for mine in np.unique(block).tolist():  # a scan task may read several files, so a batch may hold rows of several blocks
                parts = [np.frombuffer(batch.column(1)[i].as_py(), np.uint64) for i in np.flatnonzero(block == mine).tolist()]
                tokens, times = np.unique(np.concatenate(parts), return_counts=True)
                bucket = (tokens // np.uint64(step)).astype(np.int64)
                at = np.flatnonzero(_begins(bucket))
                for a, b in zip(at.tolist(), np.append(at[1:], len(bucket)).tolist(), strict=True):
                    yield _rows(bucket=[int(bucket[a])], block=[mine], tokens=pa.array([tokens[a:b].tobytes()], pa.binary()), times=pa.array([times[a:b].astype(np.uint32).tobytes()], pa.binary()))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in part["tokens"]])
        times = np.concatenate([np.frombuffer(t, np.uint32) for t in part["times"]])
        _, inverse = np.unique(tokens, return_inverse=True)
        df = np.bincount(inverse, times)[inverse].astype(np.uint32)
        out, at = [], 0
        for block, size in zip(part["block"], [len(t) // 8 for t in part["tokens"]], strict=True):
            mine, held = slice(at, at + size), df[at : at + size] > 1
            if held.any():
                out.append((block, tokens[mine][held].tobytes(), df[mine][held].tobytes()))
            at += size
        return pd.DataFrame(out, columns=["block", "tokens", "df"], dtype=object)

    def gather(sets_: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame([], columns=["v", "cls", "n", "prefix", "body"], dtype=object)
        if not len(sets_) or not len(back):
            return none
        known, at = np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in back["tokens"]]), return_index=True)
        df_of = np.concatenate([np.frombuffer(d, np.uint32) for d in back["df"]])[at]
        tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in sets_["tokens"]])
        owner = np.repeat(np.arange(len(sets_)), sets_["n"].to_numpy(np.int64))
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        held = known[at] == tokens
        tokens, owner, df = tokens[held], owner[held], df_of[at[held]]
        order = np.lexsort((tokens, df, owner))
        tokens, ends = tokens[order], np.cumsum(np.bincount(owner, minlength=len(sets_)))
        out = []
        for block, at, cls, n, b, size in zip(sets_["block"], sets_["at"], sets_["cls"], sets_["n"], ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
            a, alone = b - size, n - size
            if size and 5 * alone <= n:
                out.append(((int(block) << 24) + int(at), cls, int(n), tokens[a : a + n // 5 + 1 - alone].astype(np.int64), tokens[a:b].tobytes()))
        return pd.DataFrame(out, columns=["v", "cls", "n", "prefix", "body"], dtype=object) if out else none

    back = sets.select("block", "tokens").mapInArrow(deal, "bucket long, block long, tokens binary, times binary")
    back = back.groupBy("bucket").applyInPandas(count, "block long, tokens binary, df binary")
    return staged(sets.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(gather, "v long, cls binary, n long, prefix array<long>, body binary"), "ordered")


def _parts(table: DataFrame, column: str, least: int, most: int) -> int:
    """How many parts keep each at ``most`` of the sum of ``column``; ``least`` at least."""
    return max(least, -(-(table.agg(F.sum(column)).first()[0] or 0) // most))


def _clusters(ordered: DataFrame) -> DataFrame:
    """(v, cluster) for classes that share a prefix shingle with another."""
    entry = ordered.select("v", F.explode("prefix").alias("token"))
    hub = entry.groupBy("token").agg(F.min("v").alias("hub"), F.max("v").alias("far")).where("hub <> far").select("token", "hub")
    edges = entry.join(hub, "token").where("v <> hub").select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct()
    return connected_components(edges).select(F.col("node").alias("v"), F.col("component").alias("cluster"))


def _linked(work: DataFrame) -> DataFrame:
    """Links found in each unit of ``work`` (unit, cluster, i, j, blk, v, n, label, body)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        for (_, i, j), g in part.groupby(["cluster", "i", "j"], sort=False):
            v = g["v"].to_numpy()
            side = None if i == j else (g["blk"].to_numpy() == j).astype(int)
            sets = [np.frombuffer(b, np.uint64) for b in g["body"]]
            links += [(int(v[a]), int(v[b])) for a, b in join_components(sets, g["n"].to_numpy(), g["label"].to_numpy(), side)]
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    return work.groupBy("unit").applyInPandas(run, "a long, b long")


def _unit(small: F.Column, units: int) -> F.Column:
    """Small clusters share units by a hash; each pair of blocks of a large one is a unit."""
    return F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(units))).otherwise(F.lit(units) + F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(2**40)))


def _links(ordered: DataFrame, clusters: DataFrame, least: int) -> DataFrame:
    """(a, b): links that connect all classes that similar sets connect."""
    # where each class goes is settled over numbers only; the sets are then shuffled once to meet that and once to their units
    load = clusters.join(ordered.select("v", (F.octet_length("body") / 8).cast("long").alias("load")), "v")
    size = load.groupBy("cluster").agg(F.ceil(F.sum("load") / LOAD).cast("int").alias("blocks"))
    place = staged(load.join(size, "cluster").withColumn("blk", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).select("v", "cluster", "blocks", "blk", "load"), "places")
    units = _parts(place, "load", least, LOAD)
    place = place.drop("load")
    sets = ordered.select("v", "n", "body")
    t = sets.join(place, "v")
    own = t.withColumns({"i": F.col("blk"), "j": F.col("blk"), "label": F.col("v")}).withColumn("unit", _unit(F.col("blocks") == 1, units))
    links = staged(_linked(own.drop("blocks")), "links")
    if place.where("blocks > 1").isEmpty():
        return links
    large = staged(sets.join(place.where("blocks > 1"), "v"), "large")
    for first in (True, False):  # the first block meets the others; then what is not connected yet meets where it can link
        label = connected_components(links)
        x = large.join(label.select(F.col("node").alias("v"), F.col("component").alias("label")), "v", "left").withColumn("label", F.coalesce("label", "v"))
        many = x.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cluster")
        x = x.join(many, "cluster", "left_semi")
        if first:
            pairs = F.when(F.col("blk") == 0, F.transform(F.sequence(F.lit(1), F.col("blocks") - 1), lambda k: F.struct(F.lit(0).alias("i"), k.alias("j")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.col("blk").alias("j"))))
            x = x.withColumn("p", F.explode(pairs)).select("*", "p.i", "p.j").drop("p")
        else:
            x = x.join(_meetings(ordered, x.select("v", "blk", "label")), "v")
        x = x.withColumn("unit", _unit(F.lit(False), units))
        before, links = links, staged(links.unionByName(_linked(x.drop("blocks"))), "links")
        discard(before)
    discard(large)
    return links


def _meetings(ordered: DataFrame, at: DataFrame) -> DataFrame:
    """(v, i, j): the pairs of blocks that a class must go to: those with a class of another component that has a prefix shingle in common with it."""
    entry = staged(ordered.select("v", F.explode("prefix").alias("token")).join(at, "v"), "prefixes")
    open_ = entry.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    entry = entry.join(open_, "token", "left_semi")
    there = entry.select("token", F.col("blk").alias("other")).distinct()
    met = entry.join(there, "token").where("blk <> other")
    return met.select("v", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")).distinct()


def _components(t: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``t`` (id, text, and a name if wanted): its infos, its classes, and (cls, component, rep) of the classes that have a link."""
    units = 4 * width(t.sparkSession)
    infos = staged(_infos(t), "infos")
    t = t.select("id", "text")
    classes = infos.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("s").alias("s"))
    shared = _shared_counts(t, _parts(infos, "s", BUCKETS, MOST))
    hopeful = classes.join(shared, "cls", "left").where(5 * (F.col("s") - F.coalesce("shared", F.lit(0))) <= F.col("n")).select("cls", "rep")
    hopeful = staged(hopeful, "hopeful")
    sets = _survivor_sets(t, hopeful)
    ordered = _ordered(sets)
    discard(hopeful, sets)
    comp = connected_components(_links(ordered, _clusters(ordered), units)).withColumnsRenamed({"node": "v"})
    return infos, classes, comp.join(ordered.select("v", "cls"), "v").join(classes.select("cls", "rep"), "cls").select("cls", "component", "rep")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included).

    A-Z are lower-cased; words are runs without ASCII white space. Texts without a word (null, empty, blank) have an empty set and are
    linked with nothing: their component is their own id. Equal sets are always linked, so repeated rows and ids share a component. A component of
    null ids only has a null component_id. An empty table gives no rows. Other columns are not read.
    """
    infos, classes, linked = _components(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    to = linked.join(least, "component").select("cls", "least")
    full = classes.select("cls", "rep").join(to, "cls", "left").select(F.col("cls").alias("c"), F.coalesce("least", "rep").alias("component_id"))
    some = infos.where("n > 0").join(full, F.col("cls") == F.col("c")).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    none = infos.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return some.unionByName(none)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component with all its columns: that of the smallest id; a null id is larger than every other.

    The document is found by id and text, so ids may repeat or be null: rows without links stay. Of rows of one component that share
    its smallest id, one stays. Texts without a word are linked with nothing, and all of them stay.
    """
    name = F.md5(F.col(text_col))
    infos, _, linked = _components(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), name.alias("name")))
    t = infos.where("n > 0").select("cls", "id", "name").join(linked.select(F.col("cls").alias("c"), "component"), F.col("cls") == F.col("c"), "left")
    # a class without links is a component of its own
    t = t.withColumn("own", F.when(F.col("component").isNull(), F.col("cls")))
    keep = t.groupBy("component", "own").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "name")).alias("k")).select(F.col("k.id").alias("_keep"), F.col("k.name").alias("_kname"))
    own, (named, nth, kept, kept_name) = columns(docs), free(docs, "_name", "_nth", "_keep", "_kname")
    keep = keep.select(F.col("_keep").alias(kept), F.col("_kname").alias(kept_name))
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    some = docs.where(worded).withColumn(named, name)
    some = some.join(keep, some[id_col].cast("long").eqNullSafe(keep[kept]) & (some[named] == keep[kept_name]), "left_semi")
    one = Window.partitionBy(F.col(id_col), named).orderBy(F.xxhash64(*own))
    some = some.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*own)
    return some.unionByName(docs.where(~worded))
