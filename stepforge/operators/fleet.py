"""Fleet triage: a row for each run, its issues, outliers, filters, order and one summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The issues of a run, gravest first.
ISSUES = ("tampered", "policy", "error", "loop", "high_cost", "outlier", "unsigned")
COUNTS = ("loop", "high_cost_step", "error", "total")


def rows(runs: DataFrame, warning_counts: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """runs (run_id, started_at, ended_at, ingested_at, status, currency, steps, tokens, cost, duration_ms, signed, chain_ok,
    signature_ok) with their warning counts and policy verdict."""
    out = runs.join(warning_counts, "run_id", "left").fillna(0, list(COUNTS))
    if verdicts is None:
        return out.withColumns({"policy_ok": F.lit(None).cast("boolean"), "violations": F.lit(0).cast("long")})
    return out.join(verdicts.select("run_id", F.col("ok").alias("policy_ok"), "violations"), "run_id", "left")


def outlier_threshold(stored: DataFrame, multiple: float = 3.0) -> DataFrame:
    """One row (threshold): `multiple` medians of the stored costs above 0; infinity with fewer than three of them."""
    cost = F.when(F.col("cost") > 0, F.col("cost"))
    return stored.agg(F.when(F.count(cost) >= 3, F.percentile(cost, F.lit(0.5)) * multiple).otherwise(F.lit(float("inf"))).alias("threshold"))


def with_issues(fleet: DataFrame) -> DataFrame:
    """`issues`, gravest first, and `worst_issue`. A live run is never unsigned or an outlier."""
    threshold = outlier_threshold(fleet.where(~F.col("live")))
    found: dict[str, Column] = {
        "tampered": ~F.col("chain_ok") | ~F.col("signature_ok"),
        "policy": ~F.coalesce(F.col("policy_ok"), F.lit(True)),
        "error": F.col("error") > 0,
        "loop": F.col("loop") > 0,
        "high_cost": F.col("high_cost_step") > 0,
        "outlier": ~F.col("live") & (F.col("cost") > F.col("threshold")),
        "unsigned": ~F.col("live") & ~F.col("signed"),
    }
    out = fleet.crossJoin(F.broadcast(threshold)).withColumn("issues", F.array_compact(F.array(*[F.when(found[k], F.lit(k)) for k in ISSUES])))
    return out.withColumn("worst_issue", F.try_element_at("issues", F.lit(1)))


def with_live(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored runs and the live recordings that haven't ended and aren't stored yet."""
    fresh = live.where(~F.col("ended")).drop("ended").join(stored.select("run_id"), "run_id", "left_anti")
    return stored.withColumn("live", F.lit(False)).unionByName(fresh.withColumn("live", F.lit(True)), allowMissingColumns=True)


def filtered(fleet: DataFrame, statuses: tuple[str, ...] = (), text: str = "", issues: tuple[str, ...] = (), since: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """All facets must hold; of the issues, one. A start that can't be read passes `since`."""
    if statuses:
        fleet = fleet.where(F.col("status").isin(*statuses))
    if text.strip():
        needle = text.strip().lower()
        fleet = fleet.where(F.lower(F.col("run_id").cast("string")).contains(needle) | F.lower("name").contains(needle))
    if issues:
        fleet = fleet.where(F.arrays_overlap("issues", F.array(*map(F.lit, issues))))
    if since:
        at = F.try_to_timestamp("started_at")
        fleet = fleet.where(at.isNull() | (at >= F.lit(since).cast("timestamp")))
    return fleet.join(ids.select("run_id").distinct(), "run_id", "left_semi") if ids is not None else fleet


def ordered(fleet: DataFrame, by: str = "recent") -> DataFrame:
    """Live runs first, then by one of recent, cost, steps, duration, warnings and name."""
    key = {"recent": F.desc("started_at"), "cost": F.desc("cost"), "steps": F.desc("steps"), "duration": F.desc("duration_ms"), "warnings": F.desc("total"), "name": F.asc("name")}[by]
    return fleet.orderBy(F.desc("live"), key, "run_id")


def summary(fleet: DataFrame) -> DataFrame:
    """One row of counters. With several currencies, cost is 0 and currency is empty."""
    many = F.count_distinct("currency") > 1
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return fleet.agg(
        F.count(F.lit(1)).alias("runs"), count(F.col("live")).alias("live"), count(F.col("status") == "failed").alias("failed"), count(F.col("total") > 0).alias("with_warnings"),
        count(~F.col("policy_ok")).alias("policy_failed"), count(~F.col("live") & ~F.col("signed")).alias("unsigned"), count(~F.col("chain_ok") | ~F.col("signature_ok")).alias("tampered"),
        F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.when(many, F.lit(0.0)).otherwise(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("cost"), F.when(many, F.lit("")).otherwise(F.coalesce(F.max("currency"), F.lit(""))).alias("currency"),
    )
