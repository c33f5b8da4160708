"""Queries over what comes in: log lines, settled files, journals left behind, tool calls, spans as they end, and comparisons' fine print."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyze, anchors, diff, proofs
from ..shared import apart, new_path, written
from ..sources import driver, recorder, traces
from ..streaming import live
from .catalogue import STEPS, query
from .evidence import EDITED, edited, logged_anchors


@query("SELECT 'part-' || user_id % 7 AS file, CAST(row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS INTEGER) AS line, event_id || ' ' || event_type AS raw FROM events")
def log_lines(spark, sf):
    """Events as seven log files, read in splits of 4 KB: every line has its number in its file."""
    base = new_path(spark, "logs")
    e = driver.table(spark, sf, "events").select((F.col("user_id") % 7).alias("k"), "event_id", F.concat_ws(" ", "event_id", "event_type").alias("value"))
    e.repartition(7, "k").sortWithinPartitions("k", "event_id").select("k", "value").write.partitionBy("k").text(base)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = traces.lines(spark, base, "part-*")
        at = new_path(spark, "lines")
        read.write.parquet(at)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return spark.read.parquet(at).select(F.concat(F.lit("part-"), F.regexp_extract("file", "/k=([0-9]+)/", 1)).alias("file"), "line", "raw")


@query("WITH f AS (SELECT user_id AS run_id, max(ts) AS modified FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT run_id FROM f, n WHERE modified <= now - INTERVAL 1 DAY AND run_id % 5 <> 0")
def settled_logs(spark, sf):
    """Each user as a log that was last written with its last event: those idle for a day, but for every fifth, which is stored."""
    e = driver.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"))
    now = e.agg(F.max("ts").cast("string")).first()[0] or "1970-01-01"
    files = e.groupBy("run_id").agg(F.max("ts").alias("modified"))
    return live.settled_files(files, now, 86_400, e.select("run_id").distinct().where("run_id % 5 = 0")).select("run_id")


@query("SELECT user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 'completed' ELSE 'failed' END AS status FROM events WHERE user_id % 4 <> 0 GROUP BY user_id HAVING count(*) FILTER (WHERE event_type <> 'signup') > 0")
def recovered_journals(spark, sf):
    """Journals left behind: every third has ended, every fourth has a broken chain."""
    e = driver.table(spark, sf, "events")
    found = e.groupBy(F.col("user_id").alias("run_id")).agg(F.count_if(F.col("event_type") != "signup").alias("steps")).withColumn("ended", F.when(F.col("run_id") % 3 == 0, "completed"))
    checked = found.select("run_id", F.when(F.col("run_id") % 4 == 0, 1).alias("broken_index"))
    return live.recoverable(found, checked).select("run_id", "status")


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (1, 2) THEN 'error' ELSE 'tool_call' END AS type, CAST(CASE WHEN event_id % 5 = 0 THEN event_id ELSE 0 END AS DOUBLE) AS tokens, CASE WHEN event_id % 5 = 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS cost,
CASE WHEN event_id % 5 = 0 THEN '{"rows":1}' END AS data_payload, CASE event_id % 5 WHEN 1 THEN '{"error":"lost"}' WHEN 2 THEN '{"isError":true}' WHEN 3 THEN '{"_meta":{"trace.cost":"0.5","trace/tokens":"-1"}}' WHEN 4 THEN '7' ELSE '{"structuredContent":{"rows":1},"_meta":{"trace/tokens":"' || event_id || '"}}' END AS output FROM events""")
def tool_call_steps(spark, sf):
    """Events as tool calls of an agent protocol: raised, failed by their result, with reported usage, and plain."""
    k = F.col("event_id") % 5
    result = F.when(k == 2, '{"isError":true}').when(k == 3, '{"_meta":{"trace.cost":"0.5","trace/tokens":"-1"}}').when(k == 4, "7").when(k == 0, F.concat(F.lit('{"structuredContent":{"rows":1},"_meta":{"trace/tokens":"'), F.col("event_id").cast("string"), F.lit('"}}')))
    calls = driver.table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("tool"), F.col("props").alias("arguments"), result.alias("result"), F.when(k == 1, "lost").alias("thrown"), F.lit("").alias("started_at"), F.lit(0.0).alias("duration_ms"))
    return recorder.tool_calls(calls).select(F.col("ord").alias("event_id"), "type", "tokens", "cost", "data_payload", "output")


@query(f"WITH {STEPS} SELECT CAST(run_id AS VARCHAR) AS run_id, index, CASE WHEN event_id % 4 = 0 THEN 'plan' WHEN label = 'error' THEN 'error' WHEN event_id % 4 = 1 OR label = 'view' THEN 'tool_call' WHEN label = 'purchase' THEN 'final_output' ELSE 'llm_reasoning' END AS type FROM steps")
def live_step_types(spark, sf):
    """Spans as a processor sees them: an explicit type first, then a failed status, then a tool attribute and what the name hints at."""
    e = driver.event_steps(spark, sf)
    k = F.col("ord") % 4
    text = lambda key, value: F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))
    name = F.when(F.col("label") == "view", "run_query").when(F.col("label") == "purchase", "the answer").otherwise("step")
    attributes = F.array(text("trace.step.type", F.when(k == 0, "plan")), text("gen_ai.tool.name", F.when(k == 1, "t")))
    nanos = F.concat(F.unix_millis("ts").cast("string"), F.lit("000000"))
    span = F.struct("index", name.alias("name"), nanos.alias("startTimeUnixNano"), nanos.alias("endTimeUnixNano"), F.filter(attributes, lambda a: a["value"]["stringValue"].isNotNull()).alias("attributes"), F.struct(F.when(F.col("label") == "error", 2).alias("code")).alias("status"))
    held = e.groupBy("run_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    whole = F.struct(F.array(F.struct(F.struct(F.array(text("trace.run.id", F.col("run_id"))).alias("attributes")).alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))).alias("resourceSpans"))
    docs = held.select(F.col("run_id").cast("string").alias("path"), F.to_json(whole).alias("text"))
    return traces.otlp(docs, live=True)[1].select("run_id", "index", "type")


@query(f"WITH {EDITED}, u AS (SELECT DISTINCT pair, CAST(pair AS BIGINT) AS u FROM a) SELECT pair, FALSE AS equivalent, array_to_string(list_filter([CASE WHEN u % 3 = 0 THEN 'hash-version-mismatch' END, CASE WHEN u % 7 = 0 THEN 'unsupported-hash-version' END, CASE WHEN u % 5 = 0 THEN 'currency-mismatch' END], lambda x: x IS NOT NULL), ',') AS caveats FROM u UNION ALL SELECT pair || '-self', u % 5 <> 0, array_to_string(list_filter([CASE WHEN u % 3 = 0 THEN 'hash-version-mismatch' END, CASE WHEN u % 7 = 0 THEN 'unsupported-hash-version' END, CASE WHEN u % 5 = 0 THEN 'currency-mismatch' END], lambda x: x IS NOT NULL), ',') FROM u")
def comparisons_judged(spark, sf):
    """Each run beside its edited copy and beside itself: whether they are equivalent, and why a comparison is less than whole."""
    pairs, steps = edited(spark, sf)
    pairs = pairs.unionByName(pairs.withColumns({"pair": F.concat("pair", F.lit("-self")), "b_run": F.col("a_run")}))
    u = F.split_part("pair", F.lit("-"), F.lit(1)).cast("long")
    pairs = pairs.withColumns({"same_currency": u % 5 != 0, "a_version": F.when(u % 7 == 0, 3).otherwise(F.when(u % 3 == 0, 1).otherwise(2)), "b_version": F.when(u % 7 == 0, F.when(u % 3 == 0, 2).otherwise(3)).otherwise(2)})
    aligned = written(diff.alignments(pairs, steps), "aligned")
    found = written(diff.summary(diff.step_differences(aligned, pairs, steps)), "differences")
    news = diff.warning_differences(pairs, aligned, steps, written(analyze.warnings(steps), "warnings"))
    return diff.equivalent(pairs, found, news).join(apart(diff.caveats(pairs, found, aligned)), "pair").select("pair", "equivalent", F.array_join("caveats", ",").alias("caveats"))


@query("SELECT DISTINCT 'r' || user_id AS run_id, CASE WHEN user_id % 3 = 0 THEN 'self-attested' ELSE 'local' END AS strength, CASE WHEN user_id % 3 = 0 THEN '1970-01-01T00:00:01Z' END AS proven_by, TRUE AS ok FROM events")
def anchors_proven(spark, sf):
    """The anchors of anchors_answered as their file has them: how strongly each binds its run, and since when at the latest."""
    runs, _, path = logged_anchors(spark, sf)
    records = anchors.read_lines(traces.lines(spark, path))
    say = anchors.statement(F.col("runId"), F.col("runHash"), F.col("keyId"), F.col("signature"))
    return anchors.verify(runs.select("run_id", "run_hash"), records, proofs.proofs(records, say)).select("run_id", "strength", "proven_by", "ok")
