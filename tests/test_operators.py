"""Golden cases and properties of single operators."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import dedupe
from quarrykit.operators.dedupe import best_evidence, near_hash_pairs
from quarrykit.operators.evidence import UNSAFE, number_of
from quarrykit.operators.export import compare_trees
from quarrykit.operators.graph import connected_components
from quarrykit.operators.incremental import merge_rescan, shard_keys
from quarrykit.operators.registry import model, register_model
from quarrykit.operators.review import states
from quarrykit.operators.vector import allocate_quota, pick_diverse, round_robin, spherical_tree
from quarrykit.streaming.tail import commit_batches, tail, window_counts


def test_components_are_least_members(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_band_join_finds_all_near_hashes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        base = rng.integers(0, 65536, 9)
        for j in range(3):
            p = base.copy()
            for _ in range(int(rng.integers(0, 11))):
                p[rng.integers(9)] ^= 1 << int(rng.integers(16))
            rows.append((3 * i + j, [int(x) for x in p], 7))
    got = {(r["a"], r["b"]) for r in near_hash_pairs(spark.createDataFrame(rows, "sample_id long, p array<long>, c long")).collect()}
    apart = lambda x, y: sum(bin(a ^ b).count("1") for a, b in zip(x, y, strict=True))
    least = {}
    for i, p, _ in rows:
        least.setdefault(tuple(p), i)
    reps = [(i, p) for i, p, _ in rows if least[tuple(p)] == i]
    assert got == {(i, j) for i, p in reps for j, q in reps if i < j and apart(p, q) <= 8}


def test_equal_hashes_are_duplicates(spark, monkeypatch):
    p, near, far = [1] * 9, [1] * 8 + [2], [60000] * 9
    rows = [(1, p, 7), (2, p, 7), (3, near, 7), (4, near, 7), (5, far, 7), (6, far, 7), (8, far, 7), (9, [255 * 7] * 9, 7)]
    monkeypatch.setattr(dedupe, "hashes", lambda *_: spark.createDataFrame(rows, "sample_id long, p array<long>, c long"))
    monkeypatch.setattr(dedupe, "samples", lambda *_: spark.createDataFrame([(9, "u"), (10, "u")], "sample_id long, sha string"))
    groups = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 8: 5}
    assert {r["sample_id"]: r["component"] for r in dedupe.dup_visual(spark, "").collect()} == groups
    assert {r["sample_id"]: r["component"] for r in dedupe.duplicate_components(spark, "").collect()} == groups | {9: 9, 10: 9}
    apart = lambda x, y: sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True))
    want = [(i, j, apart(x, y)) for i, x, _ in rows for j, y, _ in rows if i < j and apart(x, y) <= 8]
    assert sorted(tuple(r) for r in dedupe.visual_pairs(spark, "").collect()) == sorted(want) and len(want) == 9


@pytest.mark.parametrize(("sizes", "target", "want"), [({"a": 100, "b": 25, "c": 4}, 9, None), ({"b": 25, "c": 4, "a": 100}, 2, {"b": 1, "c": 1, "a": 0})])
def test_quota(sizes, target, want):
    got = allocate_quota(sizes, target)
    assert sum(got.values()) == target and all(0 <= got[k] <= sizes[k] for k in sizes)
    if want:
        assert got == want
    else:
        assert got["a"] >= got["b"] >= got["c"] >= 1


def test_diverse_picks_the_farthest():
    assert pick_diverse(np.array([[1, 0], [0.999, 0.001], [0, 1.0]]), np.array([0, 1, 2]), 2) == [0, 2]


def test_cluster_tree_is_a_stable_partition():
    rng = np.random.default_rng(7)
    v = np.concatenate([np.eye(4)[k] + rng.normal(0, 0.02, (65, 4)) for k in range(4)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(260)
    a, b = (spherical_tree(v, ids, "x", target=64, split=32) for _ in range(2))
    assert [p for p, _ in a] == [p for p, _ in b] and len(a) >= 4
    assert sorted(np.concatenate([g for _, g in a])) == list(ids)


def test_rescan(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3")], "path string, sha string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "7")], "path string, sha string")
    got = {(r["path"], r["old_path"], r["status"]) for r in merge_rescan(old, new).collect()}
    assert got == {("a", "a", "same"), ("b", "b", "changed"), ("x", "c", "moved"), ("y", None, "added"), (None, "d", "missing")}


def test_trees(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha string")
    b = spark.createDataFrame([("q", "3"), ("r", "4")], "path string, sha string")
    assert {tuple(r) for r in compare_trees(a, b).collect()} == {("p", "missing"), ("q", "changed"), ("r", "extra")}


def test_every_id_is_in_a_shard_key(spark):
    rows = [(i, i % 3) for i in range(100)]
    got = {(r["label"], r["shard"]): (r["cache_key"], r["n"]) for r in shard_keys(spark.createDataFrame(rows, "vec_id long, label int"), 16).collect()}
    want = defaultdict(list)
    for i, label in rows:
        want[label, i // 16].append(str(i))
    assert got == {k: (hashlib.sha256(("model:" + ",".join(ids)).encode()).hexdigest(), len(ids)) for k, ids in want.items()}


def test_every_leaf_has_its_turn(spark):
    queues = {p: [10 * i + p for i in range(n)] for p, n in ((1, 4), (2, 1), (5, 7))}
    t = spark.createDataFrame([(p, x) for p, q in queues.items() for x in q], "parent int, leaf long")
    got = [(r["parent"], r["leaf"]) for r in sorted(round_robin(t).collect(), key=lambda r: r["place"])]
    want = [(p, queues[p][k]) for k in range(7) for p in queues if k < len(queues[p])]
    assert got == want and [r["place"] for r in round_robin(t).orderBy("place").collect()] == list(range(1, 13))


def test_unsafe_paths(spark):
    t = spark.createDataFrame([("a/b.png",), ("../a",), ("/a",), ("C:x",), ("a\\b",), ("a/../b",), ("a..b",)], "p string")
    assert [r["x"] for r in t.select(F.col("p").rlike(UNSAFE).alias("x")).collect()] == [False, True, True, True, True, True, False]


def test_registry():
    register_model("half", lambda c: c / 2)
    assert model("half")(4) == 2
    with pytest.raises(ValueError, match="registered"):
        register_model("half", lambda c: c)


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:00", "click") for i in range(30)]
    t = spark.createDataFrame(rows, "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    schema = "event_id long, ts timestamp_ntz, event_type string"
    src = str(tmp_path / "in")
    t.where("event_id < 20").write.parquet(src)
    args = (spark, src, schema, 4, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert tail(*args).count() == 15 and tail(*args).count() == 15
    t.where("event_id >= 20").write.mode("append").parquet(src)
    assert tail(*args).count() == 25
    commit_batches(spark.readStream.schema(schema).parquet(src), str(tmp_path / "b"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 30
    assert {r["n"] for r in window_counts(t).collect()} == {10}


def test_numbers_of_json(spark):
    texts = ["1", "-0.5", "1e3", "true", "null", '"1"', "01", "1.", ".5", "[1]", "{}", "NaN", "Infinity", "", None, "1 "]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, j string")
    got = [r["x"] for r in t.select("i", number_of(t["j"]).alias("x")).orderBy("i").collect()]
    assert got == [1.0, -0.5, 1000.0] + [None] * 13


def test_states_name_the_first_check_that_fails(spark):
    nan, inf = float("nan"), float("inf")
    seen = {1: [("own", 2.0)], 2: [("own", 2.0), ("old", 2.0)], 3: [("own", None)], 4: [("own", nan)], 5: [("own", -inf)], 6: [("own", 9.0)], 7: [("own", 2.0), ("own", 3.0)], 8: [("own", 2.0), ("own", 2.0)], 9: [("old", nan)]}
    t = spark.createDataFrame([(k, *r) for k, rows in seen.items() for r in rows], "sample_id long, source string, value double")
    got = {r["sample_id"]: (r["state"], r["value"]) for r in states(t, "own", 1, 5).collect()}
    none = {2: "provenance_mismatch", 3: "missing", 4: "non_finite", 5: "non_finite", 6: "out_of_range", 7: "ambiguous", 9: "provenance_mismatch"}
    assert got == {1: ("value", 2.0), 8: ("value", 2.0)} | {k: (s, None) for k, s in none.items()}


def test_best_evidence(spark):
    rows = [("g", 1, 0.5, 0), ("g", 1, 0.9, 1), ("g", 1, 0.9, 2), ("g", 2, None, 0), ("g", 2, 0.1, 1), ("h", 1, None, 3), ("h", 1, None, 2)]
    t = spark.createDataFrame(rows, "sha string, sample_id long, score double, nth int")
    got = {(r["sha"], r["sample_id"]): (r["score"], r["nth"]) for r in best_evidence(t, ("sha", "sample_id"), "score", "nth").collect()}
    assert got == {("g", 1): (0.9, 1), ("g", 2): (0.1, 1), ("h", 1): (None, 2)}
