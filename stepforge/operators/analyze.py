"""Analytics over steps: order, totals, medians, loops, costly and failed steps, running sums.

All work within a run, so that one shuffle on run_id serves a chain of them; sums and counts combine before it.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical, number_text
from ..schema import HIGH_COST, LOOP_LENGTH
from ..shared import apart

#: The messages of warnings.
MESSAGES = {
    "loop": 'Tool "%s" was called %dx in a row with identical input — likely a stuck loop burning tokens/cost.',
    "high_cost_step": "Step #%d (%s) cost %s — over 3x the median step cost (%s).",
    "error": "Error at step #%d: %s",
}


def in_run(*order: str | Column) -> Window:
    return Window.partitionBy("run_id").orderBy(*(order or ("index",)))


def assemble(drafts: DataFrame, time: str = "started_at", arrival: str = "ord") -> DataFrame:
    """Steps ordered by time in milliseconds, ties by arrival: `index` from 0 and `id` = run:index."""
    out = drafts.withColumn("index", (F.row_number().over(in_run(F.unix_millis(F.col(time).cast("timestamp")), arrival)) - 1).cast("long"))
    return out.withColumn("id", F.concat_ws(":", F.col("run_id").cast("string"), F.col("index").cast("string")))


def fold_sum(index: str, value: str) -> Column:
    """The sum of a column as a left fold in step order, bit for bit: aggregate column."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index), F.coalesce(F.col(value), F.lit(0.0)).alias("x"))))
    return F.aggregate(ordered, F.lit(0.0), lambda acc, s: acc + s["x"])


def total_columns() -> list[Column]:
    return [F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.sum("duration_ms").alias("duration_ms"), F.count(F.lit(1)).alias("steps")]


def totals(steps: DataFrame) -> DataFrame:
    """Rows (run_id, tokens, cost, duration_ms, steps), display sums that combine before the shuffle."""
    return steps.groupBy("run_id").agg(*total_columns())


def exact_totals(steps: DataFrame, index: str = "pos") -> DataFrame:
    """totals() with sums folded in step order, as hashed run headers need them; one run's numbers meet in one row."""
    return steps.groupBy("run_id").agg(*[fold_sum(index, c).alias(c) for c in ("tokens", "cost", "duration_ms")], F.count(F.lit(1)).alias("steps"))


def status_column() -> Column:
    return F.when(F.bool_or(F.col("type") == "error"), "failed").otherwise("completed").alias("status")


def status(steps: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Rows (run_id, status): declared, else failed if a step is an error, else completed."""
    out = steps.groupBy("run_id").agg(status_column())
    if declared is None:
        return out
    given = declared.select("run_id", F.col("status").alias("given"))
    return out.join(given, "run_id", "left").select("run_id", F.coalesce("given", "status").alias("status"))


def bound_columns() -> list[Column]:
    at = F.col("started_at").cast("timestamp")
    last = F.max_by(F.struct(at.alias("at"), F.col("duration_ms").alias("ms")), "index")
    end = F.timestamp_millis((F.unix_millis(last["at"]) + F.coalesce(last["ms"], F.lit(0.0))).cast("long"))
    return [F.min_by("started_at", "index").alias("started_at"), F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ended_at")]


def bounds(steps: DataFrame) -> DataFrame:
    """Rows (run_id, started_at, ended_at): the first step's start, and the last one's start and duration, as ISO text."""
    return steps.groupBy("run_id").agg(*bound_columns())


def gap_durations(steps: DataFrame, time: str = "ts") -> DataFrame:
    """duration_ms: milliseconds to the next step of the run, not under 0; 0 for the last."""
    gap = F.unix_millis(F.lead(time).over(in_run())) - F.unix_millis(F.col(time))
    return steps.withColumn("duration_ms", F.greatest(F.lit(0), F.coalesce(gap, F.lit(0))).cast("double"))


def running(steps: DataFrame) -> DataFrame:
    """cum_tokens, cum_cost, cum_duration_ms and cum_steps up to and with each step."""
    upto = in_run().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {f"cum_{c}": F.sum(c).over(upto) for c in ("tokens", "cost", "duration_ms")}
    return steps.withColumns(out | {"cum_steps": F.count(F.lit(1)).over(upto)})


def median_cost(steps: DataFrame) -> DataFrame:
    """Rows (run_id, median_cost): the exact median of the costs above 0; 0 without any."""
    return steps.groupBy("run_id").agg(F.coalesce(F.percentile(F.when(F.col("cost") > 0, F.col("cost")), F.lit(0.5)), F.lit(0.0)).alias("median_cost"))


def high_cost(steps: DataFrame, multiple: float = HIGH_COST) -> DataFrame:
    """The steps that cost over `multiple` times their run's median, with median_cost."""
    return apart(steps).join(median_cost(steps).where("median_cost > 0"), "run_id").where(F.col("cost") > F.col("median_cost") * multiple)


def calls_in_islands(steps: DataFrame, by_tool: bool = False, *more: str) -> DataFrame:
    """Tool calls (run_id, index, tool_name, island, *more): calls in a row with one tool and one input share an island.

    Inputs are the same if their canonical JSON is; absent and null are the same, and steps without the column have none. A text is made canonical only where a call beside
    it has the same tool and another text. by_tool: the tool alone decides, whatever the inputs.
    """
    call = (F.col("type") == "tool_call") & F.col("tool_name").isNotNull()
    before = lambda c: F.lag(c).over(in_run())
    out = steps.withColumn("tool", F.when(call, F.col("tool_name")))
    same = F.col("tool") == before("tool")
    if not by_tool:
        out = out.withColumn("said", F.coalesce("input", F.lit("null")) if "input" in steps.columns else F.lit("null"))
        other = lambda f: F.coalesce((f("tool").over(in_run()) == F.col("tool")) & (f("said").over(in_run()) != F.col("said")), F.lit(False))
        out = out.withColumn("doubt", other(F.lag) | other(F.lead)).withColumn("exact", F.when(F.col("doubt"), F.coalesce(canonical(F.when(F.col("doubt"), F.col("said"))), "said")))
        same &= (F.col("said") == before("said")) | F.coalesce(F.col("exact") == before("exact"), F.lit(False))
    out = out.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return out.withColumn("island", F.sum("new").over(in_run())).where("tool is not null").select("run_id", "index", "tool_name", "island", *more)


def loops(steps: DataFrame, least: int = LOOP_LENGTH, by_tool: bool = False, *extra: Column) -> DataFrame:
    """Maximal runs of at least `least` tool calls in a row with one tool and one canonical input, or with by_tool one tool.

    (run_id, tool_name, run_length, first_index, last_index). Other steps and calls without a tool end a run. extra: further
    aggregates over the steps' id and index.
    """
    out = calls_in_islands(steps, by_tool, *(["id"] if extra else []))
    grouped = out.groupBy("run_id", "island").agg(F.first("tool_name").alias("tool_name"), F.count(F.lit(1)).alias("run_length"), F.min("index").alias("first_index"), F.max("index").alias("last_index"), *extra)
    return grouped.where(F.col("run_length") >= least).drop("island")


def errors(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("type") == "error")


def fixed(x: float, places: int = 2) -> str:
    """A number with so many places as ECMAScript's toFixed writes it: ties away from zero, judged on the exact binary value."""
    if not abs(x) < 1e21:
        return number_text(x) if math.isfinite(x) else "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    return str(Decimal(x or 0).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


@F.pandas_udf(T.StringType())
def two_places(values: pd.Series) -> pd.Series:
    return values.map(fixed, na_action="ignore")


def warnings(steps: DataFrame, by_tool: bool = False) -> DataFrame:
    """Rows (run_id, ord, kind, message, step_ids): loops, then costly steps, then errors, each in step order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("index", "id"))), lambda s: s["id"]).alias("step_ids")
    looped = loops(steps, LOOP_LENGTH, by_tool, ids)
    text = F.format_string(MESSAGES["loop"], "tool_name", "run_length")
    first = looped.select("run_id", F.lit(0).alias("o"), F.col("first_index").alias("i"), F.lit("loop").alias("kind"), text.alias("message"), "step_ids")
    text = F.format_string(MESSAGES["high_cost_step"], "index", "label", two_places(F.col("cost")), two_places(F.col("median_cost")))
    second = high_cost(steps).select("run_id", F.lit(1).alias("o"), F.col("index").alias("i"), F.lit("high_cost_step").alias("kind"), text.alias("message"), F.array("id").alias("step_ids"))
    third = errors(steps).select("run_id", F.lit(2).alias("o"), F.col("index").alias("i"), F.lit("error").alias("kind"), F.format_string(MESSAGES["error"], "index", "label").alias("message"), F.array("id").alias("step_ids"))
    out = first.unionByName(second).unionByName(third)
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("run_id").orderBy("o", "i")) - 1).select("run_id", "ord", "kind", "message", "step_ids")


def warning_counts(steps: DataFrame, by_tool: bool = False) -> DataFrame:
    """Rows (run_id, loop, high_cost_step, error, total) for the runs with a warning."""
    found = loops(steps, by_tool=by_tool).select("run_id", F.lit("loop").alias("kind"))
    found = found.unionByName(high_cost(steps).select("run_id", F.lit("high_cost_step").alias("kind"))).unionByName(errors(steps).select("run_id", F.lit("error").alias("kind")))
    return found.groupBy("run_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("loop", "high_cost_step", "error")], F.count(F.lit(1)).alias("total"))


def tool_counts(steps: DataFrame) -> DataFrame:
    return steps.where((F.col("type") == "tool_call") & F.col("tool_name").isNotNull()).groupBy("tool_name").agg(F.count(F.lit(1)).alias("calls"))


def loop_span(steps_in_loop: DataFrame) -> DataFrame:
    """The first and last index over all loops of a run."""
    return steps_in_loop.groupBy("run_id").agg(F.min("first_index").alias("first_index"), F.max("last_index").alias("last_index"))


def summaries(steps: DataFrame) -> DataFrame:
    """Rows (run_id, started_at, ended_at, steps, cost, tokens, duration_ms, status) without any payload, in one aggregate."""
    return steps.groupBy("run_id").agg(*bound_columns(), *total_columns(), status_column()).select("run_id", "started_at", "ended_at", "steps", "cost", "tokens", "duration_ms", "status")
