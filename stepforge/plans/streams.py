"""Queries over runs that are long and runs that are still coming: events as three long runs, as spans of a stream, and as journals that grow."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, long_runs
from ..shared import new_path
from ..sources import driver, growing
from ..streaming import stateful
from .catalogue import BY_INPUT, ISO, SENT, STEPS, query, repeating

LONG = STEPS.replace("user_id AS run_id", "user_id % 3 AS run_id").replace("PARTITION BY user_id", "PARTITION BY user_id % 3")


def long_steps(spark: SparkSession, sf: str) -> DataFrame:
    """All events as three runs, numbered over ranges."""
    return long_runs.assemble(driver.event_drafts(spark, sf).withColumn("run_id", F.col("run_id") % 3), "ts", "ord")


@query(f"WITH {LONG} SELECT run_id, index, round(sum(cost) OVER w, 2) AS cum_cost, sum(tokens) OVER w AS cum_tokens, count(*) OVER w AS cum_steps FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY index)")
def long_running_totals(spark, sf):
    out = long_runs.running(long_steps(spark, sf).withColumn("duration_ms", F.lit(0.0)))
    return out.select("run_id", "index", F.round("cum_cost", 2).alias("cum_cost"), "cum_tokens", "cum_steps")


@query(f"WITH {LONG}, {SENT}, {BY_INPUT.replace('FROM steps WINDOW', 'FROM sent WINDOW')} SELECT * FROM loops")
def long_loops(spark, sf):
    return long_runs.loops(repeating(long_steps(spark, sf)))


@query(f"WITH {LONG} SELECT run_id, min(CASE WHEN event_id % 211 = 7 THEN index END) AS broken_index FROM steps GROUP BY run_id")
def long_chain_breaks(spark, sf):
    """Three long chains, in which each 211th step's text is changed afterwards."""
    steps = long_steps(spark, sf).withColumn("pos", F.col("index"))
    chained = integrity.chain(steps.select("run_id", "pos", "ord", F.concat_ws(" ", "id", "label").alias("canonical")))
    return long_runs.broken_links(chained.withColumn("canonical", F.when(F.col("ord") % 211 == 7, F.concat("canonical", F.lit("!"))).otherwise(F.col("canonical"))))


# ---- runs that are still coming ---------------------------------------------------------------------------------


def thirds(spark: SparkSession, sf: str) -> list:
    """Conditions that part the events by time in three."""
    low, high = driver.table(spark, sf, "events").agg(F.min(F.unix_millis(F.col("ts").cast("timestamp"))), F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()
    low, high = low or 0, high or 0
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    one, two = low + (high - low) // 3, low + 2 * (high - low) // 3
    return [at < one, (at >= one) & (at < two), at >= two]


def drained(stream: DataFrame, base: str, out: str) -> None:
    """Run a stream until it has read what is there; it goes on from where it ended the last time."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{out}/{number}")

    stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


SPAN_TEXT = f"""{STEPS},
texts AS (SELECT run_id, index, '{{"cost":' || event_id % 7 || ',"durationMs":' || CAST(duration_ms AS BIGINT) || ',"id":"otel-' || run_id || ':' || index || '","index":' || index || ',"input":{{"k":' || CAST(json_extract(input, '$.k') AS VARCHAR) || '}},"label":"' || label
  || '","parentSpanId":"root","runId":"otel-' || run_id || '","spanId":"s' || event_id || '","startedAt":"' || {ISO.format("ts")} || '","tokens":' || CAST(tokens AS BIGINT) || CASE WHEN tool_name IS NOT NULL THEN ',"toolName":"' || tool_name || '"' ELSE '' END || ',"type":"' || type || '"}}' AS t FROM steps),
chain AS (SELECT run_id, index, sha256('tgstep/2' || chr(0) || t || chr(0)) AS hash FROM texts WHERE index = 0
  UNION ALL SELECT x.run_id, x.index, sha256('tgstep/2' || chr(0) || x.t || chr(0) || c.hash) FROM chain c JOIN texts x ON x.run_id = c.run_id AND x.index = c.index + 1)"""


@query(f"WITH RECURSIVE {SPAN_TEXT} SELECT 'otel-' || run_id AS run_id, index, hash FROM chain")
def live_chain(spark, sf):
    """Events as spans of a stream in three goes, each user's a trace; the stream chains them as they come, and goes on from its state."""
    base = new_path(spark, "spans")
    steps = driver.event_steps(spark, sf).withColumns({
        "trace_id": F.col("run_id").cast("string"), "span_id": F.concat(F.lit("s"), F.col("ord").cast("string")), "parent_span_id": F.lit("root"), "cost": (F.col("ord") % 7).cast("double"),
        "output": F.lit(None).cast("string"), "data_payload": F.lit(None).cast("string"),
    }).withColumn("ord", F.col("index"))
    for part in thirds(spark, sf):
        steps.where(part).select(*[c.split()[0] for c in stateful.SPAN.split(", ")]).write.mode("append").parquet(f"{base}/in")
        drained(stateful.written_runs(spark.readStream.schema(stateful.SPAN).parquet(f"{base}/in")), base, "out")
    out = spark.read.option("recursiveFileLookup", "true").schema(stateful.WRITTEN).parquet(f"{base}/out")
    return out.where("event = 'step'").select("run_id", "index", "hash")


def write_journals(lines: DataFrame, folder: str) -> None:
    """Rows (run_id, place, raw) as a file for each run, whole: a task that runs twice writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = growing.opened(folder)
        store.create_dir(at, recursive=True)
        held, name, files = [], None, 0
        rows = ((r["run_id"], r["raw"]) for b in batches for r in b.to_pylist())
        for run_id, raw in chain(rows, [(None, None)]):
            if run_id != name and held:
                with store.open_output_stream(f"{at}/{name}.jsonl") as f:
                    f.write(("\n".join(held) + "\n").encode())
                held, files = [], files + 1
            name = run_id
            held += [raw] if raw is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    lines.repartition("run_id").sortWithinPartitions("run_id", "place").mapInArrow(run, "files long").agg(F.sum("files")).collect()


FOLLOWED = f"WITH {STEPS}, {SENT}, {BY_INPUT.replace('FROM steps WINDOW', 'FROM sent WINDOW')}, e AS (SELECT run_id, count(*) AS steps, count(*) FILTER (WHERE type = 'error') AS errors FROM steps GROUP BY run_id), l AS (SELECT run_id, count(*) AS loops FROM loops GROUP BY run_id) SELECT CAST(run_id AS VARCHAR) AS run_id, steps, errors, coalesce(loops, 0) AS loops, CAST(0 AS BIGINT) AS broken FROM e LEFT JOIN l USING (run_id)"


@query(FOLLOWED)
def followed_journals(spark, sf):
    """Events as journals that grow in three goes, and the stream that follows them: steps and warnings told once, loops however they grew."""
    base = new_path(spark, "journals")
    none = {"output": "string", "data_payload": "string", "span_id": "string", "parent_span_id": "string", "commitments": "map<string,string>"}
    steps = repeating(driver.event_steps(spark, sf)).withColumn("run_id", F.col("run_id").cast("string")).withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).withColumn("span_id", F.concat(F.lit("s"), F.col("ord").cast("string")))
    chained = integrity.chain(steps.withColumn("canonical", integrity.canonical_step(2)))
    record = F.struct("id", F.col("run_id").alias("runId"), "index", "type", "label", F.col("started_at").alias("startedAt"), F.col("duration_ms").alias("durationMs"), "tokens", "cost", F.col("tool_name").alias("toolName"), F.parse_json("input").alias("input"), F.col("span_id").alias("spanId"), F.col("prev_hash").alias("prevHash"), "hash")
    raw = F.to_json(F.struct(F.lit("step").alias("kind"), record.alias("step")))
    made = chained.select("run_id", (F.col("pos") + 1).alias("place"), raw.alias("raw"), "ts")
    meta = F.to_json(F.struct(F.lit("meta").alias("kind"), F.lit(1).alias("formatVersion"), F.col("run_id").alias("id"), F.lit("n").alias("name"), F.lit("USD").alias("currency"), F.lit(2).alias("hashVersion")))
    made.write.parquet(f"{base}/made")
    made = spark.read.parquet(f"{base}/made")
    heads = made.select("run_id").distinct().select("run_id", F.lit(0).cast("long").alias("place"), meta.alias("raw"))
    first, second, _ = thirds(spark, sf)
    for part in (first, first | second, F.lit(True)):
        write_journals(heads.unionByName(made.where(part).select("run_id", "place", "raw")), f"{base}/journals")
        drained(stateful.followed(spark, f"{base}/journals"), base, "told")
    told = spark.read.option("recursiveFileLookup", "true").schema(stateful.TOLD_EVENT).parquet(f"{base}/told")
    kind = lambda k: F.col("kind") == k
    return told.groupBy("run_id").agg(F.count_if(F.col("event") == "step").alias("steps"), F.count_if(kind("error")).alias("errors"), F.count_distinct(F.when(kind("loop"), F.col("step_ids")[0])).alias("loops"), F.count_if(F.col("event") == "broken").alias("broken"))
