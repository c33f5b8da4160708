"""The same analytics for runs too long for one task: a scan in two levels over ranges of (run, order).

A run's rows lie in many ranges, each in a task of its own. A range is summed up in one row for each run in it: how many rows, what sums, the
last hash, the rows of equal calls at its borders. Prefixes over these rows, as many for a run as it has ranges, say what each range
goes on from, and the ranges are completed by themselves. Ranges are written to spark.checkpoint.dir once, so that both levels see the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LOOP_LENGTH
from ..shared import new_path
from . import analyze, integrity

#: Rows of a run from which on its ranges are scanned apart; below, a run is a window's partition.
LONG = 20_000_000


def is_long(steps: DataFrame, most: int = LONG) -> bool:
    """Whether a run has more rows than one task should hold: counts combine before they are shuffled."""
    return not steps.groupBy("run_id").count().where(F.col("count") > most).isEmpty()


def ranged(steps: DataFrame, *order: str | Column, partitions: int | None = None) -> DataFrame:
    """steps in ranges of (run_id, order), with `_part`, the number of the range, and `_at`, which rises by one along a range."""
    spark = steps.sparkSession
    path = new_path(spark, "ranges")
    keys = {f"_key{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = steps.withColumns(keys).repartitionByRange(n, "run_id", *keys).sortWithinPartitions("run_id", *keys)
    placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).drop(*keys).write.parquet(path)
    return spark.read.parquet(path)


def within() -> Window:
    return Window.partitionBy("run_id", "_part").orderBy("_at")


def across() -> Window:
    return Window.partitionBy("run_id").orderBy("_part")


def before(parts: DataFrame, *columns: str) -> DataFrame:
    """The sums of these columns over a run's earlier ranges, in their place."""
    earlier = across().rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("run_id", "_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns])


def plain(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def assemble(drafts: DataFrame, time: str = "started_at", arrival: str = "ord", partitions: int | None = None) -> DataFrame:
    """analyze.assemble() over ranges."""
    rows = ranged(drafts, F.unix_millis(F.col(time).cast("timestamp")), arrival, partitions=partitions)
    parts = rows.groupBy("run_id", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    out = rows.join(before(parts, "n").join(parts.select("run_id", "_part", "_first"), ["run_id", "_part"]), ["run_id", "_part"])
    out = out.withColumn("index", F.col("_at") - F.col("_first") + F.col("_before_n"))
    return plain(out.withColumn("id", F.concat_ws(":", F.col("run_id").cast("string"), F.col("index").cast("string"))))


def running(steps: DataFrame, partitions: int | None = None) -> DataFrame:
    """analyze.running() over ranges; sums of a range are added to those before it, so that they may round otherwise."""
    rows, sums = ranged(steps, "index", partitions=partitions), ("tokens", "cost", "duration_ms")
    parts = rows.groupBy("run_id", "_part").agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("steps"))
    upto = within().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {f"cum_{c}": F.sum(c).over(upto) for c in sums} | {"cum_steps": F.count(F.lit(1)).over(upto)}
    out = rows.withColumns(own).join(before(parts, *sums, "steps"), ["run_id", "_part"])
    return plain(out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_before_{c}") for c in (*sums, "steps")}))


def loops(steps: DataFrame, least: int = LOOP_LENGTH, by_tool: bool = False, partitions: int | None = None) -> DataFrame:
    """analyze.loops() over ranges: equal calls in a row are counted in each range, and those at borders are put together.

    Whether calls are equal across a border is judged on canonical inputs of the two at it; a range has two border rows at most.
    """
    rows = ranged(steps, "index", partitions=partitions)
    # Each range as a run of its own, by a key that keeps them apart.
    apart = rows.withColumn("_run", F.col("run_id")).withColumn("run_id", F.struct("run_id", "_part")).withColumn("_said", F.lit("") if by_tool else F.coalesce("input", F.lit("null")) if "input" in steps.columns else F.lit("null"))
    own = analyze.calls_in_islands(apart, by_tool, "_said")
    islands = own.groupBy("run_id", "island").agg(F.first("tool_name").alias("tool_name"), F.count(F.lit(1)).alias("run_length"), F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.min_by("_said", "index").alias("said"))
    islands = islands.select("run_id.run_id", F.col("run_id._part").alias("_part"), "tool_name", "run_length", "first_index", "last_index", "said")
    ends = rows.groupBy("run_id", "_part").agg(F.min("index").alias("_low"), F.max("index").alias("_high"))
    placed = islands.join(ends, ["run_id", "_part"])
    border = (F.col("first_index") == F.col("_low")) | (F.col("last_index") == F.col("_high"))
    whole = placed.where(~border)
    same = placed.where(border).withColumn("said", F.coalesce(analyze.canonical(F.col("said")), "said"))
    chain = Window.partitionBy("run_id").orderBy("first_index")
    goes_on = (F.lag("last_index").over(chain) + 1 == F.col("first_index")) & (F.lag("tool_name").over(chain) == F.col("tool_name")) & (F.lag("said").over(chain) == F.col("said"))
    joined = same.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(chain))
    merged = joined.groupBy("run_id", "_island").agg(F.first("tool_name").alias("tool_name"), F.sum("run_length").alias("run_length"), F.min("first_index").alias("first_index"), F.max("last_index").alias("last_index"))
    columns = ("run_id", "tool_name", "run_length", "first_index", "last_index")
    return whole.select(*columns).unionByName(merged.select(*columns)).where(F.col("run_length") >= least)


def broken_links(df: DataFrame, text_col: str = "canonical", version: int = 2, order: str = "pos", partitions: int | None = None) -> DataFrame:
    """integrity.broken_links() over ranges: a range's first step follows the last hash of the range before."""
    rows = ranged(df, order, partitions=partitions)
    last = rows.groupBy("run_id", "_part").agg(F.max_by("hash", "_at").alias("_last")).withColumn("_carried", F.lag("_last").over(across()))
    rows = rows.join(last.select("run_id", "_part", "_carried"), ["run_id", "_part"])
    previous = F.coalesce(F.when(F.row_number().over(within()) == 1, F.col("_carried")).otherwise(F.lag("hash").over(within())), F.lit(""))
    linked = rows.withColumn("_previous", previous)
    right = F.col("prev_hash").eqNullSafe(F.col("_previous")) & F.col("hash").eqNullSafe(F.sha2(integrity.preimage(F.col(text_col), F.col("_previous"), version), 256))
    return linked.groupBy("run_id").agg(F.min(F.when(~right, F.col(order))).alias("broken_index"))


def by_size(steps: DataFrame, short, long, most: int = LONG) -> DataFrame:
    """long(steps) if a run has more than `most` rows, else short(steps): the same rows either way."""
    return long(steps) if is_long(steps, most) else short(steps)
