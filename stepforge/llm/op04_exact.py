"""Exact dedup by distributed MSD radix partitioning.

Groups of texts split by successive bytes until they are single or ended. Digits widen eightfold from one round to the
next, so that texts of any length take a few rounds; a digit is compared as it is, never as a digest. A round counts
(group, digit) with partial aggregates, so that a third of all rows with one text meet as one row of each task, and
gives every row its new group by an equi-join, whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Width in bytes of the first digit, and how much wider each next one is.
FIRST, WIDER = 32, 8


def normalised(text_col: str):
    """The text with A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)


def group_equal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, keep_id, group_size, text_sha256), one for each row of df.

    keep_id: the largest id among the rows with an equal text (null if none has one); group_size counts those rows, repeated
    ones too. The digest describes the text and takes no part in comparing. df must give the same rows when read
    again. Empty and null texts are one group; an empty table gives an empty one.
    """
    text = normalised(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("rest"), F.lit(0).cast("long").alias("grp"), F.monotonically_increasing_id().alias("row"))
    width, done, turn = FIRST, [], 0
    while True:
        cut = rows.select("id", "sha", "grp", "row", F.substring("rest", 1, width).alias("digit"), F.substring("rest", width + 1, 2**31 - 1).alias("rest"), (F.octet_length("rest") <= width).alias("ended"))
        groups = cut.groupBy("grp", "digit", "ended").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"), F.max("row").alias("next")).where("n > 1")
        # Written, so that the join has a shuffle on either side and adaptive execution can split a hot group's rows.
        groups = written(groups, f"exact-groups-{turn}")
        # A row without a group of its own digit is single; one whose group has ended has its equals.
        split = cut.join(groups.hint("merge"), ["grp", "digit", "ended"], "left").select("id", "sha", "row", F.col("next").alias("grp"), F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"), (F.col("ended") | F.col("n").isNull()).alias("over"), F.when(~F.col("ended") & F.col("n").isNotNull(), F.col("rest")).alias("rest"))
        split = written(split, f"exact-{turn}")
        done.append(split.where("over").select("id", "keep", "n", "sha"))
        rows = split.where("not over").select("id", "sha", "rest", "grp", "row")
        if rows.isEmpty():
            break
        width, turn = width * WIDER, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row with a larger id has; of rows that share an id and whose texts are equal, one stays.

    Equal is equal after lower-casing A-Z, with null as empty. Of rows that share an id that one stays whose JSON comes last, whatever the order
    of reading. Rows without an id have nothing to be ranked by, and all stay unless an equal text has an id.
    """
    groups = group_equal(docs, id_col, text_col).where("group_size > 1")
    gone = groups.where(~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias("gone"), F.col("text_sha256").alias("gone_sha")).distinct().hint("merge")
    kept = docs.join(gone, (docs[id_col] == gone["gone"]) & (F.sha2(normalised(text_col), 256) == gone["gone_sha"]), "left_anti")
    missing = groups.where(F.col(id_col).isNull() & F.col("keep_id").isNotNull()).select(F.col("text_sha256").alias("sha")).distinct()
    if not missing.isEmpty():
        kept = kept.join(missing, kept[id_col].isNull() & (F.sha2(normalised(text_col), 256) == missing["sha"]), "left_anti")
    twice = groups.where(F.col(id_col).isNotNull()).groupBy(id_col, "text_sha256").count().where("count > 1")
    if twice.isEmpty():
        return kept
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = kept.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("sha")).agg(F.max_by(row, F.to_json(row)).alias("row"))
    return one.select("row.*").unionByName(kept.where(F.col(id_col).isNull()))


def op4_exact_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document, and whether it stays."""
    out = group_equal(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
