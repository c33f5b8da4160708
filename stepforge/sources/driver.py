"""The driver's tables as traces: events of a user are a run, and so are a conversation's turns and an order's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyze import assemble, in_run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def event_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events: clicks, views and purchases call a tool, a signup approves, an error fails."""
    kind = F.col("event_type")
    call = kind.isin("click", "view", "purchase")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"),
        F.when(call, "tool_call").when(kind == "signup", "approval").otherwise("error").alias("type"),
        F.when(call, kind).alias("tool_name"), kind.alias("label"), F.col("value").alias("cost"), (F.col("event_id") % 100).cast("double").alias("tokens"), F.col("props").alias("input"),
    )


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_drafts() in order, with the time to the next one."""
    out = assemble(event_drafts(spark, sf_dir), "ts", "ord")
    gap = F.unix_millis(F.lead("ts").over(in_run())) - F.unix_millis("ts")
    return out.withColumns({"duration_ms": F.greatest(F.lit(0), F.coalesce(gap, F.lit(0))).cast("double"), "started_at": iso(F.col("ts")), "pos": F.col("index")})


def event_runs(steps: DataFrame) -> DataFrame:
    """A run for each user: its currency is EUR for odd ids, it is signed unless its id is a multiple of 5."""
    from ..operators.analyze import summaries

    return summaries(steps).withColumns({
        "name": F.concat(F.lit("run "), F.col("run_id").cast("string")), "currency": F.when(F.col("run_id") % 2 == 1, "EUR").otherwise("USD"), "signed": F.col("run_id") % 5 != 0,
        "chain_ok": F.col("run_id") % 17 != 0, "signature_ok": F.lit(True),
    })


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a run, its lines are steps: (run_id, cost, steps, ingested_at)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("cost"), F.count(F.lit(1)).alias("steps"))
    return lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("ingested_at")), "run_id")


def conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as entries of a session log: (file, line, type, timestamp, text, input_tokens, output_tokens, model)."""
    t = table(spark, sf_dir, "conversations")
    return t.select(
        F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.col("role").alias("type"), F.timestamp_millis(F.col("turn") * 60000).alias("timestamp"), "text",
        F.when(F.col("role") == "assistant", F.col("conv_id") % 1000).otherwise(0).alias("input_tokens"), F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).cast("long").alias("output_tokens"),
        F.concat(F.lit("model-"), (F.col("conv_id") % 4).cast("string"), F.when(F.col("conv_id") % 3 == 0, "-20250101").otherwise("")).alias("model"),
    )
