"""The registered pipeline over a planted corpus: what each stage leaves, and the pieces, against brute force."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from quarrykit.llm import mixing
from quarrykit.llm.queries import DOMAINS, tokenizer_path, weight


def test_each_stage_against_brute_force(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(17)
    words = ["".join(rng.choice(list("aeinorst"), 5)) for _ in range(300)]
    docs, toxic, copies, near = {}, set(), set(), set()
    for i in range(240):
        docs[i] = " ".join([*rng.choice(words, int(rng.integers(30, 60))), *(["blockhead"] * 2 if i % 3 == 0 else [])])
        if i % 3 == 0:
            toxic.add(i)
    for i in range(1, 240, 12):  # neither is a multiple of 3
        docs[500 + i], docs[800 + i] = docs[i].replace(" ", "  "), docs[i] + " " + words[i % 300]
        copies.add(500 + i)
        near.add(800 + i)
    docs[1100], docs[1101] = " ".join(f"w{k}" for k in range(5000)), ""
    rows = [(i, t, ("en", "de")[i % 2], f"src{i % 5}", len(t)) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    paths, new_path = {}, corpus_pipeline.new_path
    monkeypatch.setattr(corpus_pipeline, "new_path", lambda s, label: paths.setdefault(label, new_path(s, label)))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {k.removeprefix("stage-"): spark.read.parquet(p) for k, p in paths.items()}
    ids = {k: sorted(r["doc_id"] for r in t.select("doc_id").collect()) for k, t in left.items()}
    want = set(docs) - toxic
    assert ids["toxicity"] == sorted(want)
    want -= copies
    assert ids["exact_dedup"] == sorted(want)
    want -= near
    assert ids["jaccard_join"] == sorted(want)

    leaf = {i: (DOMAINS[i % 5 % len(DOMAINS)], ("en", "de")[i % 2], f"src{i % 5}") for i in want}
    size = {i: len(docs[i].split()) for i in want}
    total = Counter()
    for i in want:
        total[leaf[i]] += size[i]
    budget = mixing.allocate(dict(total), weight, int(sum(total.values()) * 0.9), 1)
    key = {r["doc_id"]: r["k"] for r in left["jaccard_join"].select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(11), F.lit(0).cast("long"), "doc_id", "text"), 1).alias("k")).collect()}
    mixed, begun = set(), Counter()
    for i in sorted(want, key=lambda i: (key[i], i)):
        whole = budget[leaf[i]] == total[leaf[i]]
        if whole or (begun[leaf[i]] < budget[leaf[i]] and size[i]):
            mixed.add(i)
        begun[leaf[i]] += size[i]
    assert ids["mixing"] == sorted(mixed) and mixed < want

    tok, by = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append(r)
    assert set(by) == mixed and sorted(r["sequence_id"] for r in pieces) == list(range(len(pieces)))
    for i, got in by.items():
        tokens, at = [*tok.encode(docs[i], add_special_tokens=False).ids, 2], 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(tokens) and zlib.crc32(np.array(tokens[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        n = len(tokens)
        assert at == n and Counter(r["length"] for r in got) == Counter([4096] * (n // 4096) + [1 << b for b in range(12) if n >> b & 1])
