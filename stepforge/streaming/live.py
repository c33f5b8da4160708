"""Live runs: events folded into one row of state for each run, as they come.

The state is a few numbers (next index, open island of equal calls, totals), whatever the length of a run. An `end` event
or a timeout settles a run; an event after that opens a continuation, `<run>-2` and so on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.canonical import canonicalize
from ..schema import LOOP_LENGTH
from ..shared import new_path

EVENT = "run_id string, at long, ord long, type string, tool string, input string, cost double, tokens double"
STATE = "generation int, steps long, cost double, tokens double, tool string, length long, loops long, errors long, ended boolean"
OUT = "run_id string, status string, steps long, cost double, tokens double, loops long, open_loop long, errors long"
FRESH = (1, 0, 0.0, 0.0, "", 0, 0, 0, False)


def call_of(tool: object, text: object, by_tool: bool = False) -> str | None:
    """What makes calls the same: the tool and, unless by_tool, a digest of the canonical input, absent and null alike. None without a tool."""
    if not isinstance(tool, str):
        return None
    said = text if isinstance(text, str) else "null"
    return tool if by_tool else f"{tool}\0{hashlib.sha256((canonicalize(said) or said).encode('utf-8', 'surrogatepass')).hexdigest()}"


def fold(state: tuple, kind: str, tool: str | None, cost: float, tokens: float) -> tuple:
    """The state after one more event. A loop counts once, when its run of equal calls, by call_of(), reaches LOOP_LENGTH."""
    gen, steps, total, toks, last, length, loops, errors, ended = state
    if ended:
        gen, steps, total, toks, last, length, loops, errors = gen + 1, *FRESH[1:8]
    if kind == "end":
        return gen, steps, total, toks, last, length, loops, errors, True
    call = kind == "tool_call" and tool is not None
    length = length + 1 if call and tool == last else int(call)
    return gen, steps + 1, total + cost, toks + tokens, tool if call else "", length, loops + (length == LOOP_LENGTH), errors + (kind == "error"), False


def live_runs(events: DataFrame, timeout_ms: int = 0, forget_ms: int = 0, by_tool: bool = False) -> DataFrame:
    """A streaming DataFrame of OUT: the state of every run that a trigger touched. events: a stream of EVENT.

    A trigger's events of a run are put in order; across triggers, arrival is the order. timeout_ms: after so much silence
    a run counts as failed and its state goes; 0 waits for ever. forget_ms: so long an ended run is remembered, for events
    that come late; what comes later still begins the run anew; 0 remembers it for ever. With either, a trigger that ends by
    itself (availableNow) wouldn't, since Spark then always waits for the next timeout.
    """

    def settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else FRESH
        status = "failed"
        if state.hasTimedOut:
            state.remove()
            if now[8]:
                return
        else:
            for r in pd.concat(list(batches)).sort_values(["at", "ord"]).itertuples():
                now = fold(now, r.type, call_of(r.tool, r.input, by_tool), r.cost, r.tokens)
            state.update(now)
            if wait := forget_ms if now[8] else timeout_ms:
                state.setTimeoutDuration(wait)
            status = "completed" if now[8] else "running"
        name = key[0] if now[0] == 1 else f"{key[0]}-{now[0]}"
        yield pd.DataFrame({"run_id": [name], "status": [status], "steps": [now[1]], "cost": [now[2]], "tokens": [now[3]], "loops": [now[6]], "open_loop": [now[5] if now[5] >= LOOP_LENGTH else 0], "errors": [now[7]]})

    return events.groupBy("run_id").applyInPandasWithState(settle, OUT, STATE, "update", clock(timeout_ms or forget_ms))


def clock(wait_ms: int) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout


SPAN = "trace_id string, span_id string, parent_span_id string, ord long, type string, label string, tool string, started_at string, duration_ms double, cost double, tokens double"
TRACED = "trace_id string, run_id string, index long, span_id string, parent_span_id string, type string, label string, tool string, started_at string, duration_ms double, cost double, tokens double, final boolean"
TRACE_STATE = "generation int, steps long"


def traced_steps(spans: DataFrame, name: str = "otel-", finalize_on_root: bool = True, idle_ms: int = 0) -> DataFrame:
    """A streaming DataFrame of TRACED: ended spans as steps of a run for each trace. spans: a stream of SPAN.

    A span without a parent ends its run: its step is `final`. A span that comes after that opens a continuation, `<run>-2`
    and so on. Steps keep the ids of their spans and the order in which these ended. A trace that is silent for idle_ms
    is forgotten; 0 remembers it for ever. Filtering and renaming are for the caller's columns before and after; unmapped spans never open a run.
    """

    def record(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        generation, steps = state.get if state.exists else (1, 0)
        rows = pd.concat(list(batches)).sort_values("ord")
        ids, index, final = [], [], []
        for parent in rows["parent_span_id"]:
            ids.append(name + key[0] + (f"-{generation}" if generation > 1 else ""))
            index.append(steps)
            root = finalize_on_root and not (isinstance(parent, str) and parent)
            final.append(root)
            generation, steps = (generation + 1, 0) if root else (generation, steps + 1)
        state.update((generation, steps))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        out = rows.drop(columns=["ord", "trace_id"])
        yield out.assign(trace_id=key[0], run_id=ids, index=index, final=final)[[c.split()[0] for c in TRACED.split(", ")]]

    return spans.groupBy("trace_id").applyInPandasWithState(record, TRACED, TRACE_STATE, "append", clock(idle_ms))


def provisional(recordings: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, warnings) of recordings in progress, newest first: analysed as finished runs are, but neither anchored nor signed.

    runs: (run_id, name, currency, status, run_hash, steps, cost, tokens, duration_ms, started_at, ended_at, chain_ok, modified). A live
    record owes no integrity yet; chain_ok tells whether the links written so far hold.
    """
    from ..operators import analyze, integrity

    sums = steps.groupBy("run_id").agg(*analyze.total_columns(), *analyze.bound_columns()[1:])
    links = integrity.broken_links(steps.withColumn("canonical", integrity.canonical_step(2))).select("run_id", F.col("broken_index").isNull().alias("chain_ok"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    heads = recordings.select("run_id", "name", "currency", "started_at", "modified").join(sums, "run_id", "left").join(links, "run_id", "left")
    runs = heads.select("run_id", "name", "currency", F.lit("running").alias("status"), F.lit("").alias("run_hash"), zero("steps"), zero("cost"), zero("tokens"), zero("duration_ms"), "started_at", F.coalesce("ended_at", "started_at").alias("ended_at"), F.coalesce("chain_ok", F.lit(True)).alias("chain_ok"), "modified")
    return runs.orderBy(F.desc("modified")), analyze.warnings(steps)


def journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the lines of journal files. A file is read once, so that a producer writes one for each batch of events."""
    return spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def rollup(events: DataFrame, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Steps and cost for each window and tool, over a table or a stream; `late`: how long a stream waits for stragglers."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width, slide), "tool").agg(F.count(F.lit(1)).alias("steps"), F.sum("cost").alias("cost"))


def settled_files(files: DataFrame, now: str, settle_seconds: int, stored: DataFrame) -> DataFrame:
    """Files that have been idle for a while and whose run isn't stored: (file, run_id, modified)."""
    idle = F.col("modified") <= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(settle_seconds))
    return files.where(idle).join(stored.select("run_id"), "run_id", "left_anti")


def recoverable(recordings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Orphaned recordings with steps and a sound chain, with the status they settle as: as they ended, else failed."""
    sound = verdicts.where(F.col("broken_index").isNull()).select("run_id")
    return recordings.where("steps > 0").join(sound, "run_id", "left_semi").withColumn("status", F.coalesce("ended", F.lit("failed")))


def follow(events: DataFrame, sink, checkpoint: str, every: str = "500 milliseconds", timeout_ms: int = 0, forget_ms: int = 3_600_000):
    """Start a query that hands each trigger's states to sink(DataFrame, trigger number)."""
    return live_runs(events, timeout_ms, forget_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(sink).start()


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, folded; rows (run_id, steps, cost, loops) of the last state of each run."""
    base = new_path(spark, "live")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    call = F.col("event_type").isin("click", "view", "purchase")
    shaped = source.select(F.col("user_id").cast("string").alias("run_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("ord"), F.when(call, "tool_call").when(F.col("event_type") == "signup", "approval").otherwise("error").alias("type"), F.when(call, F.col("event_type")).alias("tool"), F.col("props").alias("input"), F.col("value").alias("cost"), (F.col("event_id") % 100).cast("double").alias("tokens"))
    shaped.write.parquet(f"{base}/events")
    stream = spark.readStream.schema(EVENT).parquet(f"{base}/events")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger", F.lit(number)).write.mode("append").parquet(f"{base}/states")

    query = live_runs(stream, by_tool=True).writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{base}/states").groupBy("run_id").agg(F.max_by(F.struct("steps", "cost", "loops"), "trigger").alias("s"))
    return last.select("run_id", "s.steps", F.round("s.cost", 2).alias("cost"), "s.loops")
