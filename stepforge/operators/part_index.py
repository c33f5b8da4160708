"""What lies in a store's parts, so that a lookup or a search opens only those that may have it.

For each part and column, Bloom filters in blocks of 32,768 bits: of run ids, and of the pieces of three characters that the lower-cased
text of a searched column has. They are made and probed by built-in functions alone. A filter may say yes to what isn't there, never
no to what is; a part without filters is always opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block, which is what bitmap_construct_agg makes; places a key sets; keys a block is meant to hold, for one wrong yes in about 5,000.
BITS, PLACES, KEYS = 32_768, 5, 1_500
GRAM = 3
FILTERS = "part string, field string, block long, blocks long, bits binary"


def places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(BITS)) for i in range(PLACES)]


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), blocks)


def grams(text: Column) -> Column:
    """The distinct pieces of GRAM characters of the lower-cased text; none of a shorter one or a null."""
    low = F.lower(text)
    n = F.coalesce(F.char_length(low), F.lit(0)) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(low, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def filters(keys: DataFrame) -> DataFrame:
    """FILTERS of rows (part, field, key), repeated ones too: as many blocks as a part's distinct keys need."""
    keys = keys.where("key is not null").distinct()
    sizes = keys.groupBy("part", "field").agg(F.ceil(F.count(F.lit(1)) / KEYS).alias("blocks"))
    bits = keys.join(sizes, ["part", "field"]).select("part", "field", "blocks", block_of(F.col("key"), F.col("blocks")).alias("block"), F.explode(F.array(*places(F.col("key")))).alias("place"))
    return bits.groupBy("part", "field", "block", "blocks").agg(F.bitmap_construct_agg("place").alias("bits"))


def id_filters(rows: DataFrame, part: str) -> DataFrame:
    return filters(rows.select(F.lit(part).alias("part"), F.lit("run_id").alias("field"), F.col("run_id").cast("string").alias("key")))


def text_filters(rows: DataFrame, part: str, fields: tuple[str, ...]) -> DataFrame:
    """An empty key stands for the column itself, so that one without texts has a filter too, which excludes all."""
    each = [rows.select(F.lit(part).alias("part"), F.lit(f).alias("field"), F.explode(F.concat(F.array(F.lit("")), grams(F.col(f)))).alias("key")) for f in fields]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return filters(out)


def may_hold(key: Column) -> Column:
    """Whether the bits of a key's places are set in a block."""
    bit = lambda p: F.call_function("shiftright", F.conv(F.hex(F.substring("bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int"), (p % 8).cast("int")) % 2 == 1
    out = F.lit(True)
    for p in places(key):
        out &= bit(p)
    return out


def excluded(stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (part): those in which none of some fields can have all the keys wanted. wanted: (field, key), a handful of keys.

    Only parts that have filters of every wanted field are judged.
    """
    fields = wanted.select("field").distinct().count()
    known = stats.join(F.broadcast(wanted.select("field").distinct()), "field").select("part", "field", "blocks").distinct()
    asked = known.join(F.broadcast(wanted), "field").withColumn("block", block_of(F.col("key"), F.col("blocks")))
    met = asked.join(stats.select("part", "field", "block", "bits"), ["part", "field", "block"], "left")
    by_field = met.groupBy("part", "field").agg(F.bool_and(F.coalesce(may_hold(F.col("key")), F.lit(False))).alias("may"))
    return by_field.groupBy("part").agg(F.bool_or("may").alias("may"), F.count(F.lit(1)).alias("n")).where(~F.col("may") & (F.col("n") == fields)).select("part")
