"""The ten operators as queries over whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import anchors, bloom_cascade, chunking, exact_dedup, jaccard_join, lpt_sharding, mixing, packing, string_kernel, wavelet
from quarrykit.sources.tables import table

#: Longest fitting rule wins; the host is a domain with all its subdomains.
URL_RULES = [
    bloom_cascade.Rule("org", "/", "allow"),
    bloom_cascade.Rule("example.org", "/es/", "block"),
    bloom_cascade.Rule("example.org", "/en/1", "block"),
    bloom_cascade.Rule("com", "/fr/", "allow"),
    bloom_cascade.Rule("com", "/de/", "block"),
]
#: Domains by the number in a source's name, and their target weights.
DOMAINS = ("web", "books", "code", "forum")
DOMAIN_WEIGHTS = {"web": 0.4, "books": 0.3, "code": 0.2, "forum": 0.1}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def domain_column() -> F.Column:
    """The domain of a source: by its number, modulo the domains; without a number: the first."""
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(source, '([0-9]+)', 1) AS long)"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS)).cast("int") + 1)


def weight(path: tuple) -> float:
    """Target weight of a node among its siblings: sources of a language are equal."""
    if len(path) == 1:
        return DOMAIN_WEIGHTS.get(path[0], 0.0)
    return LANG_WEIGHTS.get(path[1], 0.05) if len(path) == 2 else 1.0


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = wavelet.encode_to_shards(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return wavelet.read_documents(shards)


def op2_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_cascade.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op6_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), most_chunks=1_500_000)


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = string_kernel.train(*string_kernel.training_rows(docs, table(spark, sf_dir, "labels")))
    return string_kernel.score_documents(docs, model)


def op8_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.span_digests(anchors.find_pii(table(spark, sf_dir, "documents")))


def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op10_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its leaf, tokens, whole epochs taken, and tokens taken in the last epoch. Budget: 0.8 of all tokens, at most 3 epochs."""
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, [domain_column(), F.col("lang"), F.col("source")], weight, 0.8, max_epochs=3)
    return out.select("doc_id", F.col("_leaf.level0").alias("domain"), F.col("_leaf.level1").alias("lang"), F.col("_leaf.level2").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_epochs").alias("epochs"), F.col("_take").alias("take_tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_wavelet_tokens, op2_bloom_cascade_urls, op3_exact_dedup, op4_jaccard_components, op5_chunk_fingerprints, op6_power_of_two_packing, op7_string_kernel_toxicity, op8_anchor_pii, op9_lpt_shards, op10_mixed_sources]
    return {f.__name__: f for f in own}


URL_SQL = r"""
WITH cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM cut c LEFT JOIN best b USING (page_id)
"""

DEDUP_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), ' ') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws = [''] THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * i >= 80 * (na + nb - i)),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.a, r.c FROM l JOIN r ON l.b = r.doc_id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_bloom_cascade_urls": URL_SQL, "op3_exact_dedup": DEDUP_SQL, "op4_jaccard_components": JACCARD_SQL}
