"""URL filter by a Bloom filter cascade [native].

Level 0 encodes the listed keys. Every key of the corpus's universe that is not
listed but passes level 0 is encoded in level 1; listed keys that pass level 1
are encoded in level 2; and so on until a level lets nothing wrong through. A
key of the universe is listed exactly if the first level that rejects it has an
odd number (or none rejects it and the number of levels is odd). Probing reads
bit arrays in the plan, so there is no join.

Size bound: with L listed keys and U keys in the universe, level 0 has a false
positive rate near L / (sqrt(2) U), so that level 1 holds about L keys, and every
later level about half of the one before: O(L log(U / L)) bits, whatever U is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.names import free

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


#: Hash functions of a filter at most: fewer probes for somewhat more bits.
MOST_HASHES = 6


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]  #: the bits, 64 to a word, signed
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        ok = F.lit(True)
        for at in _positions(key, self.bits, self.hashes, self.seed):
            word = F.lit(self.words[0]).cast("long") if len(self.words) == 1 else F.element_at(F.lit(list(self.words)).cast("array<long>"), (F.floor(at / 64) + 1).cast("int"))
            ok = ok & (F.getbit(word, (at % 64).cast("int")) == 1)
        return ok


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 1000 + i), key), F.lit(bits)) for i in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter over column ``key`` of ``keys`` (n rows), its bits set by a distributed aggregate."""
    hashes = max(1, min(MOST_HASHES, round(math.log2(1 / rate))))
    bits = max(64, 64 * math.ceil(n * hashes / -math.log(1 - rate ** (1 / hashes)) / 64))
    words = (
        keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("at"))
        .groupBy(F.floor(F.col("at") / 64).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("v"))
    )
    full = [0] * (bits // 64)
    for r in words.collect():  # at most bits / 64 rows: bounded by the list, not by the corpus
        full[r["word"]] = r["v"]
    return Level(tuple(full), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact membership for every key of the universe the cascade was built for."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascades(lists: dict[str, list[str]], universe: DataFrame, seed: int = 7) -> dict[str, Cascade]:
    """A cascade for each of ``lists`` over ``universe`` (column ``key``, repeats allowed), which is read twice whatever the number of lists.

    An empty list gives a cascade of no level, which contains nothing.
    """
    spark = universe.sparkSession
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    listed = {name: sorted(set(keys)) for name, keys in lists.items()}
    out = {name: Cascade(()) for name, keys in listed.items() if not keys}
    listed = {name: keys for name, keys in listed.items() if keys}
    if not listed:
        return out
    size = max(1, universe.count())
    first = {name: _level(frame(keys), len(keys), min(0.5, len(keys) / (math.sqrt(2) * size)), seed) for name, keys in listed.items()}
    # whatever passes a level 0 and isn't listed there; about as many keys as are listed, by the choice of the rate
    passes = F.array_compact(F.array(*[F.when(level.passes(F.col("key")), F.lit(name)) for name, level in first.items()]))
    passed = universe.select("key", F.explode(passes).alias("name")).distinct()
    own = spark.createDataFrame([(k, name) for name, keys in listed.items() for k in keys], "key string, name string")
    wrong: dict[str, list[str]] = {name: [] for name in listed}
    for r in passed.join(own, ["key", "name"], "left_anti").collect():
        wrong[r["name"]].append(r["key"])
    for name, level in first.items():
        levels, inside, outside = [level], listed[name], sorted(wrong[name])
        while put := outside if len(levels) % 2 else inside:
            against = inside if len(levels) % 2 else outside
            levels.append(_level(frame(put), len(put), 0.5, seed + len(levels)))
            left = [r["key"] for r in frame(against).where(levels[-1].passes(F.col("key"))).collect()]
            inside, outside = (left, outside) if len(levels) % 2 == 0 else (inside, left)
        out[name] = Cascade(tuple(levels))
    return out


def build_cascade(listed: list[str], universe: DataFrame, seed: int = 7) -> Cascade:
    """One list's cascade."""
    return build_cascades({"list": listed}, universe, seed)["list"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def filter_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every url: the longest rule that fits the host (or a parent domain) and begins the path.

    Adds host, path, rule (its key, else null) and verdict (the rule's; ``default`` where no list
    has the url). A null url or one without ``://`` has an empty host and path and fits no rule. Of rules equally
    long, the one with the longer host wins. Repeated pages are judged alike; an empty table gives no rows. Columns of these names in ``pages`` are
    replaced, all others are handed on, whatever their names.
    """
    shapes = sorted({(len(r.host), len(r.path)) for r in rules}, key=lambda s: (-(s[0] + s[1]), -s[0]))
    out = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    host, path = F.col("host"), F.col("path")

    def candidate(h: int, p: int) -> Column:
        fits = (F.length(host) == h) | (F.substring(host, -(h + 1), 1) == ".") & (F.length(host) > h)
        return F.when(fits & (F.length(path) >= p), F.concat(F.substring(host, -h, h), F.substring(path, 1, p)))

    if not rules:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = F.array(*[candidate(h, p) for h, p in shapes])
    universe = out.select(F.explode(keys).alias("key")).where(F.col("key").isNotNull())
    cascades = build_cascades({v: [r.key for r in rules if r.verdict == v] for v in sorted({r.verdict for r in rules})}, universe)
    judged, (held, hit) = list(cascades), free(out, "_keys", "_hit")
    # one cascade after another, over the list of keys: the expression doesn't grow with the number of shapes
    of_key = lambda key: F.coalesce(*[F.when(cascades[v].contains(key), F.lit(n)) for n, v in enumerate(judged)], F.lit(-1))
    found = F.transform(F.col(held), lambda key: F.struct(key.alias("key"), F.when(key.isNotNull(), of_key(key)).otherwise(F.lit(-1)).alias("n")))
    out = out.withColumn(held, keys)
    out = out.withColumn(hit, F.filter(found, lambda x: x["n"] >= 0))
    some, best = F.size(hit) > 0, F.get(F.col(hit), F.lit(0))
    verdict = F.when(some, F.get(F.array(*map(F.lit, judged)), best["n"])).otherwise(F.lit(default))
    return out.withColumns({"rule": F.when(some, best["key"]), "verdict": verdict}).drop(held, hit)
