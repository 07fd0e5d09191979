"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a domain-language-source tree. What a node can't use (its leaves hold too few tokens, even over
``max_epochs``) goes to its siblings by their weights first; only what no sibling can take is left to the parent's
siblings. Each leaf then takes a token-prefix of its seeded epochs: epoch e is the leaf's documents ordered by a hash of seed, e and
id; whole epochs are taken, then a prefix of the next.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.names import columns, free
from quarrykit.plans.storage import staged

BUCKETS = 1024
#: Leaves whose plan (a row each) is sent to every task; with more of them it is joined.
SENT = 100_000


def _split(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """Integer shares of ``budget`` by weight, none over its room; what one can't take goes to the others by weight.

    Weights that are all zero among those with room count as equal.
    """
    given = [0] * len(room)
    left = min(budget, sum(room))
    while left > 0:
        open_ = [i for i in range(len(room)) if given[i] < room[i] and weights[i] > 0] or [i for i in range(len(room)) if given[i] < room[i]]
        w = {i: weights[i] or 1.0 for i in open_}
        total = sum(w.values())
        want = {i: left * w[i] / total for i in open_}
        full = [i for i in open_ if want[i] >= room[i] - given[i]]
        if full:
            for i in full:
                left -= room[i] - given[i]
                given[i] = room[i]
            continue
        whole = {i: int(want[i]) for i in open_}
        rest = left - sum(whole.values())
        for i in sorted(open_, key=lambda i: (whole[i] - want[i], i))[:rest]:
            whole[i] += 1
        for i in open_:
            given[i] += whole[i]
        left = 0
    return given


def allocate(leaves: dict[tuple, int], weight: Callable[[tuple], float], budget: int, max_epochs: int = 1) -> dict[tuple, int]:
    """Tokens for each leaf. ``leaves``: path -> tokens it has; ``weight``: weight of any path among its siblings."""
    room: dict[tuple, int] = defaultdict(int)
    children: dict[tuple, set] = defaultdict(set)
    for path, tokens in leaves.items():
        for d in range(len(path) + 1):
            room[path[:d]] += tokens * max_epochs
            if d:
                children[path[: d - 1]].add(path[:d])
    out, todo = {}, [((), min(budget, room[()]))]
    while todo:
        node, has = todo.pop()
        if node not in children:
            if node:
                out[node] = has
            continue
        kids = sorted(children[node], key=str)
        todo += zip(kids, _split(has, [weight(k) for k in kids], [room[k] for k in kids]), strict=True)
    return out


def word_tokens(text: Column) -> Column:
    """A document's tokens: its words (runs without ASCII white space); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _mixed(docs: DataFrame, levels: list[Column], weight: Callable[[tuple], float], share: float, max_epochs: int, seed: int, id_col: str, text_col: str, buckets: int) -> tuple[DataFrame, list[str]]:
    """(all columns of ``docs`` and those that ``mix`` adds, the names of these)."""
    spark, own = docs.sparkSession, columns(docs)
    leaf, tokens, epochs, take, epoch, bucket, n, rest, edge, start, key, *names = free(docs, "_leaf", "_tokens", "_epochs", "_take", "_epoch", "_bucket", "_n", "_rest", "_edge", "_start", "_key", *[f"_level{i}" for i in range(len(levels))])
    there = [f"{x}_of" for x in names]
    key_of = lambda e: F.shiftrightunsigned(F.xxhash64(F.lit(seed), e, F.col(id_col), F.col(text_col)), 1)
    bucket_of = lambda k: (k / 2.0**63 * buckets).cast("int")
    t = docs.select(*own, *[x.alias(c) for x, c in zip(levels, names, strict=True)])

    # one pass over the texts: a leaf's tokens in each hash range of each epoch that it may end in
    ranges = F.array(*[F.struct(F.lit(e).cast("long").alias(epoch), bucket_of(key_of(F.lit(e).cast("long"))).alias(bucket)) for e in range(max_epochs)])
    counted_once = t.select(*names, word_tokens(F.col(text_col)).alias(tokens), ranges.alias(key))
    sums = counted_once.select(*names, tokens, F.inline(key)).groupBy(*names, epoch, bucket).agg(F.sum(tokens).alias(n))
    sums = staged(sums, "ranges")
    stats = sums.where(F.col(epoch) == 0).groupBy(*names).agg(F.sum(n).alias(n)).collect()  # a row for each leaf of the tree
    leaves = {tuple(r[x] for x in names): r[n] for r in stats}
    budgets = allocate(leaves, weight, int(sum(leaves.values()) * share), max_epochs)
    kinds = dict(t.dtypes)
    rows = [(*k, budgets[k] // max(1, m), budgets[k] - budgets[k] // max(1, m) * m if m else 0) for k, m in leaves.items()]
    plan = spark.createDataFrame(rows, ", ".join(f"`{x}` {kinds[c]}" for x, c in zip(there, names, strict=True)) + f", `{epochs}` long, `{rest}` long")
    same = lambda a, b: [a[c].eqNullSafe(b[x]) for c, x in zip(names, there, strict=True)]
    # the range in which a leaf's last epoch ends, and the tokens before it
    mine = sums.join(plan, [*same(sums, plan), sums[epoch] == plan[epochs]])
    before = Window.partitionBy(*names).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    mine = mine.withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0))).where(F.col(start) + F.col(n) > F.col(rest))
    ends = mine.groupBy(*there).agg(F.min(F.struct(F.col(bucket), F.col(start))).alias(edge))
    ends = ends.select(*[F.col(x).alias(f"{x}_too") for x in there], F.col(f"{edge}.{bucket}").alias(edge), F.col(f"{edge}.{start}").alias(start))
    plan = staged(plan.join(ends, [plan[x].eqNullSafe(ends[f"{x}_too"]) for x in there], "left").drop(*[f"{x}_too" for x in there]), "plan")
    few = F.broadcast if len(rows) <= SENT else lambda x: x
    t = t.join(few(plan), same(t, plan)).withColumn(key, key_of(F.col(epochs)))
    t = t.withColumn(bucket, bucket_of(F.col(key)))
    in_edge = F.coalesce(F.col(bucket) == F.col(edge), F.lit(False))
    counted = lambda x: x.withColumn(tokens, word_tokens(F.col(text_col)))
    plain = counted(t.where(~in_edge)).withColumn(take, F.when(F.col(bucket) < F.col(edge), F.col(tokens)).otherwise(0))
    some = counted(t.where(in_edge))
    upto = F.sum(tokens).over(Window.partitionBy(*names).orderBy(key, id_col).rowsBetween(Window.unboundedPreceding, -1))
    some = some.withColumn(take, F.greatest(F.lit(0), F.least(F.col(tokens), F.col(rest) - F.col(start) - F.coalesce(upto, F.lit(0)))))
    path = F.struct(*[F.col(c).alias(f"level{i}") for i, c in enumerate(names)]).alias(leaf)
    cols = [*own, path, F.col(tokens), F.col(epochs), F.col(take).cast("long").alias(take)]
    return plain.select(*cols).unionByName(some.select(*cols)), [leaf, tokens, epochs, take]


def mix(docs: DataFrame, levels: list[Column], weight: Callable[[tuple], float], share: float, max_epochs: int = 1, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``docs`` plus _leaf (struct), _tokens, _epochs (whole epochs taken), _take (tokens taken in the last, partial epoch).

    The budget is ``share`` of the tokens there are. Null levels are a leaf of their own (null). Documents without words have 0 tokens and are taken
    with the whole epochs only. Rows that repeat an id are ordered by their text's hash. An empty table gives no rows. A column that ``docs`` has under one of the
    added names stays as it is, and the added one gets underscores in front.
    A leaf's prefix is found by hash ranges: sums over ``buckets`` ranges show in which range the budget ends, and only that range's
    documents (1 / buckets of the leaf) are ordered one by one, so a leaf that holds a third of all rows isn't sorted in one task.
    """
    return _mixed(docs, levels, weight, share, max_epochs, seed, id_col, text_col, buckets)[0]


def mixed_documents(docs: DataFrame, levels: list[Column], weight: Callable[[tuple], float], share: float, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the mix takes or ends in, whole, with the columns of ``docs``; none is repeated. Rows without words stay where their leaf is taken whole."""
    out, (_, _, epochs, take) = _mixed(docs, levels, weight, share, 1, seed, id_col, text_col, BUCKETS)
    return out.where((F.col(epochs) > 0) | (F.col(take) > 0)).select(*columns(docs))
