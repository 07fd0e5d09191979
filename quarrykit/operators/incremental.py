"""Incremental work: rescans, event logs, checkpoints, leases, caches, batches and run comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.plans.catalog import query
from quarrykit.plans.domain import samples, task_events
from quarrykit.sources.tables import table

S = SparkSession


def n_rows() -> Column:
    return F.count(F.lit(1))

RESCAN_SQL = """WITH old AS (SELECT path, sha FROM samples WHERE sample_id % 10 <> 0), new AS (SELECT CASE WHEN sample_id % 9 = 0 THEN 'moved/' || path ELSE path END AS path, CASE WHEN sample_id % 8 = 0 THEN 'new' || CAST(sample_id AS VARCHAR) ELSE sha END AS sha FROM samples WHERE sample_id % 7 <> 0),
  j AS (SELECT o.path AS op, o.sha AS os, n.path AS np, n.sha AS ns FROM old o FULL JOIN new n ON o.path = n.path),
  gone AS (SELECT op, os, row_number() OVER (PARTITION BY os ORDER BY op) AS rn FROM j WHERE np IS NULL), come AS (SELECT np, ns, row_number() OVER (PARTITION BY ns ORDER BY np) AS rn FROM j WHERE op IS NULL)
  SELECT np AS path, op AS old_path, CASE WHEN os = ns THEN 'same' ELSE 'changed' END AS status FROM j WHERE np IS NOT NULL AND op IS NOT NULL
  UNION ALL SELECT c.np, g.op, CASE WHEN g.op IS NULL THEN 'added' ELSE 'moved' END FROM come c LEFT JOIN gone g ON c.ns = g.os AND c.rn = g.rn
  UNION ALL SELECT NULL, g.op, 'missing' FROM gone g LEFT JOIN come c ON c.ns = g.os AND c.rn = g.rn WHERE c.np IS NULL"""


def merge_rescan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old_path, status) from two (path, sha) scans: same, changed, moved (content found at a new path, one to one in path order), added, missing."""
    j = old.select(F.col("path").alias("op"), F.col("sha").alias("os")).join(new.select(F.col("path").alias("np"), F.col("sha").alias("ns")), F.col("op") == F.col("np"), "full")
    both = j.where("op IS NOT NULL AND np IS NOT NULL").select(F.col("np").alias("path"), F.col("op").alias("old_path"), F.when(F.col("os") == F.col("ns"), "same").otherwise("changed").alias("status"))
    gone = j.where("np IS NULL").select("op", F.col("os").alias("sha")).withColumn("rn", F.row_number().over(Window.partitionBy("sha").orderBy("op")))
    come = j.where("op IS NULL").select("np", F.col("ns").alias("sha")).withColumn("rn", F.row_number().over(Window.partitionBy("sha").orderBy("np")))
    rest = gone.join(come, ["sha", "rn"], "full").select(F.col("np").alias("path"), F.col("op").alias("old_path"), F.when(F.col("op").isNull(), "added").when(F.col("np").isNull(), "missing").otherwise("moved").alias("status"))
    return both.unionByName(rest)


@query(RESCAN_SQL)
def incremental_rescan_merge(spark: S, sf: str) -> DataFrame:
    s, i = samples(spark, sf), F.col("sample_id")
    new = s.where("sample_id % 7 <> 0").select(F.when(i % 9 == 0, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(i % 8 == 0, F.concat(F.lit("new"), i.cast("string"))).otherwise(F.col("sha")).alias("sha"))
    return merge_rescan(s.where("sample_id % 10 <> 0").select("path", "sha"), new)


@query("SELECT task_id, max(sequence) AS last, max(sequence) + 1 AS next FROM task_events GROUP BY task_id")
def latest_event_sequence(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("task_id")).agg(n_rows().alias("last"), (n_rows() + 1).alias("next"))  # sequences have no gaps


@query("SELECT task_id, event_id, sequence FROM task_events")
def event_sequence(spark: S, sf: str) -> DataFrame:
    return task_events(spark, sf).select("task_id", "event_id", "sequence")


@query("SELECT user_id AS task_id, event_type AS phase, max_by(event_id, struct_pack(a := ts, b := event_id)) AS checkpoint, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY ALL")
def latest_checkpoint(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("value IS NOT NULL").groupBy(F.col("user_id").alias("task_id"), F.col("event_type").alias("phase")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("checkpoint"), F.max("value").alias("most"))


@query("SELECT event_id, ts + INTERVAL 90 SECOND < TIMESTAMP '2024-01-15 00:00:00' AS expired FROM events WHERE event_type = 'click'")
def expired_leases(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'click'").select("event_id", F.expr("ts + INTERVAL 90 SECOND < TIMESTAMP_NTZ '2024-01-15 00:00:00'").alias("expired"))


@query("SELECT task_id, event_id, sequence FROM task_events WHERE task_id = 7 AND sequence > 3 ORDER BY sequence LIMIT 200")
def events_after_cursor(spark: S, sf: str) -> DataFrame:
    """One page behind a cursor: the page is the feature."""
    return task_events(spark, sf).where("task_id = 7 AND sequence > 3").orderBy("sequence").limit(200).select("task_id", "event_id", "sequence")


#: Which status may follow which.
ALLOWED = {("queued", "running"), ("running", "paused"), ("running", "done"), ("paused", "queued"), ("paused", "running")}


@query("SELECT task_id, event_id, before, to_status FROM (SELECT *, lag(to_status) OVER (PARTITION BY task_id ORDER BY sequence) AS before FROM task_events) WHERE before IS NOT NULL AND before || '>' || to_status NOT IN (" + ", ".join(f"'{a}>{b}'" for a, b in sorted(ALLOWED)) + ")")
def illegal_transitions(spark: S, sf: str) -> DataFrame:
    t = task_events(spark, sf).withColumn("before", F.lag("to_status").over(Window.partitionBy("task_id").orderBy("sequence")))
    return t.where("before IS NOT NULL").where(~F.concat_ws(">", "before", "to_status").isin([f"{a}>{b}" for a, b in sorted(ALLOWED)])).select("task_id", "event_id", "before", "to_status")


PHASE_SQL = "gaps AS (SELECT to_status AS phase, epoch_us(coalesce(lead(ts) OVER (PARTITION BY task_id ORDER BY sequence), TIMESTAMP '2024-02-01')) - epoch_us(ts) AS us, event_id FROM task_events), phases AS (SELECT phase, round(sum(us) / 1e6, 3) AS seconds, count(*) AS items FROM gaps GROUP BY phase)"


def phases(events: DataFrame) -> DataFrame:
    """Seconds spent in each status, each gap counted for the status before it, and items a second."""
    end = F.coalesce(F.lead("ts").over(Window.partitionBy("task_id").orderBy("sequence")), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
    us = F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col("to_status").alias("phase"), us.alias("us")).groupBy("phase").agg(F.round(F.sum("us") / 1e6, 3).alias("seconds"), n_rows().alias("items"))


@query(f"WITH {PHASE_SQL} SELECT phase, seconds, items, round(items / nullif(seconds, 0), 9) AS per_second FROM phases")
def phase_durations(spark: S, sf: str) -> DataFrame:
    return phases(task_events(spark, sf)).withColumn("per_second", F.round(F.try_divide(F.col("items"), F.col("seconds")), 9))


@query("WITH a AS (SELECT event_type AS phase, sum(value) AS x FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS phase, sum(value) AS y FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT phase, round(x, 4) AS base, round(y, 4) AS candidate, round(y - x, 4) AS delta, round((y - x) / nullif(x, 0) * 100, 4) AS delta_percent FROM a JOIN b USING (phase)")
def perf_compare(spark: S, sf: str) -> DataFrame:
    odd = F.col("event_id") % 2 == 1
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("phase")).agg(F.sum(F.when(~odd, F.col("value"))).alias("x"), F.sum(F.when(odd, F.col("value"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return t.select("phase", F.round("x", 4).alias("base"), F.round("y", 4).alias("candidate"), F.round(F.col("y") - F.col("x"), 4).alias("delta"), F.round(F.try_divide(F.col("y") - F.col("x"), F.col("x")) * 100, 4).alias("delta_percent"))


@query("SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || ':42') AS key FROM documents ORDER BY key LIMIT 25")
def deterministic_sample(spark: S, sf: str) -> DataFrame:
    """A seeded sample of fixed size: the limit is the operator."""
    return table(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42"))).alias("key")).orderBy("key").limit(25)


@query("SELECT task_id, first_ts FROM (SELECT user_id AS task_id, min(ts) AS first_ts, min(event_id) AS e FROM events WHERE event_type = 'view' GROUP BY user_id) ORDER BY first_ts, task_id LIMIT 1")
def queue_next(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("task_id")).agg(F.min("ts").alias("first_ts")).orderBy("first_ts", "task_id").limit(1)


@query("SELECT user_id AS task_id, max(ts) AS updated, count(*) AS n FROM events GROUP BY user_id ORDER BY updated DESC, task_id LIMIT 20")
def task_list(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("task_id")).agg(F.max("ts").alias("updated"), n_rows().alias("n")).orderBy(F.desc("updated"), "task_id").limit(20)


def shard_keys(v: DataFrame, size: int) -> DataFrame:
    """(label, shard, cache_key, n): each row of ``v`` is in the shard of its label and range of ``size`` ids, named by the shard's ordered ids."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), ",")
    return v.groupBy("label", F.floor(F.col("vec_id") / size).alias("shard")).agg(F.sha2(F.concat(F.lit("model:"), ids), 256).alias("cache_key"), n_rows().alias("n"))


@query("SELECT label, vec_id // 4096 AS shard, sha256('model:' || string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id)) AS cache_key, count(*) AS n FROM embeddings GROUP BY label, vec_id // 4096")
def shard_cache_key(spark: S, sf: str) -> DataFrame:
    """Every embedding is in one key, and a key is over 4096 ids at most."""
    return shard_keys(table(spark, sf, "embeddings"), 4096)


@query("SELECT batch, n_items, ceil(256.0 / batch)::BIGINT * batch AS flush, ceil(n_items / (ceil(256.0 / batch) * batch))::BIGINT AS commits FROM (VALUES (64, 100000), (300, 100000), (256, 1000), (1, 10)) t(batch, n_items)")
def write_schedule(spark: S, sf: str) -> DataFrame:
    t = spark.createDataFrame([(64, 100000), (300, 100000), (256, 1000), (1, 10)], "batch int, n_items int")
    t = t.withColumn("flush", F.ceil(F.lit(256.0) / F.col("batch")) * F.col("batch"))
    return t.withColumn("commits", F.ceil(F.col("n_items") / F.col("flush")))


@query("SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS BIGINT) AS batch FROM embeddings")
def batch_partition(spark: S, sf: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id", "label").withColumn("batch", F.floor((rn - 1) / 16))


@query("SELECT s.sample_id, s.sha FROM samples s WHERE NOT EXISTS (SELECT 1 FROM samples c WHERE c.sample_id % 3 = 0 AND c.sha = s.sha)")
def score_cache_misses(spark: S, sf: str) -> DataFrame:
    s = samples(spark, sf).select("sample_id", "sha")
    return s.join(s.where("sample_id % 3 = 0").select("sha"), "sha", "left_anti").select("sample_id", "sha")


@query("SELECT doc_id AS sample_id, CASE WHEN doc_id % 29 = 0 THEN 'missing' WHEN doc_id % 23 = 0 THEN 'non_finite' WHEN (doc_id % 100) / 90.0 > 1 THEN 'out_of_range' ELSE 'ok' END AS verdict FROM labels")
def score_contract_check(spark: S, sf: str) -> DataFrame:
    i = F.col("doc_id")
    score = F.when(i % 29 == 0, None).when(i % 23 == 0, float("nan")).otherwise((i % 100) / 90.0)
    t = table(spark, sf, "labels").select(i.alias("sample_id"), score.alias("s"))
    return t.select("sample_id", F.when(F.col("s").isNull(), "missing").when(F.isnan("s"), "non_finite").when((F.col("s") < 0) | (F.col("s") > 1), "out_of_range").otherwise("ok").alias("verdict"))
