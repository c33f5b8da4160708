"""What an ingest endpoint would answer, as columns over a table of requests: limits on rate and size, formats, repeated ids.

Serving HTTP is left to a gateway that lands requests as files; this gives the same answers over what has landed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Wire
from .traces import ATTRIBUTES, UNNAMED, native_fault, run_attribute, with_format

#: Limits of a collector unless it is told otherwise.
MOST_BYTES, PER_WINDOW, WINDOW = 32 << 20, 120, "1 minute"


def answered(requests: DataFrame, stored: DataFrame | None = None, most_bytes: int = MOST_BYTES, per_window: int = PER_WINDOW, window: str = WINDOW, wire: Wire = Wire()) -> DataFrame:
    """requests (client, at, ord, text, ...) with format, run_id, status and reason.

    429: beyond what a client may send in a fixed window of time, refused ones counted; 413: too large, the text isn't looked
    at; 400: no known format, or a native document that breaks its schema; 200: a run that is stored, or that an earlier
    accepted request brought, and nothing is stored again; 201: a run to be stored. Exports without a run id share one; attributes
    of other producers, such as the id of a build's pipeline run, aren't run ids.
    """
    place = F.row_number().over(Window.partitionBy("client", F.window("at", window)).orderBy("at", "ord"))
    late, large = place > per_window, F.octet_length("text") > most_bytes
    some = requests.withColumn("refused", F.when(late, 429).when(large, 413)).withColumn("body", F.when(F.col("refused").isNull(), F.col("text")))
    kinds = with_format(some.drop("text").withColumnRenamed("body", "text"))
    fault = F.when(F.col("format").isNull(), "unknown format").when(F.col("format") == "native", native_fault(F.col("text")))
    found = kinds.withColumn("fault", F.when(F.col("refused").isNull(), fault))
    exported = F.from_json("text", f"struct<resourceSpans:array<struct<resource:struct<attributes:{ATTRIBUTES}>>>>")["resourceSpans"]
    run = F.when(F.col("format") == "native", F.get_json_object("text", "$.id")).otherwise(run_attribute(exported, "id", wire, UNNAMED))
    good = F.col("refused").isNull() & F.col("fault").isNull()
    found = found.withColumn("run_id", F.when(good, run))
    # Requests that bring no run, mostly refused ones, have nothing to repeat: they are dealt by their order, or they would meet in one task.
    own = F.when(F.col("run_id").isNull(), F.xxhash64("client", "at", "ord"))
    again = F.col("run_id").isNotNull() & (F.row_number().over(Window.partitionBy("run_id", own).orderBy("at", "ord")) > 1)
    if stored is not None:
        have = stored.select(F.col("run_id").cast("string").alias("have")).distinct()
        found = found.join(have, F.col("run_id") == F.col("have"), "left")
        again = again | F.col("have").isNotNull()
    status = F.coalesce("refused", F.when(F.col("fault").isNotNull(), 400).when(again, 200).otherwise(201))
    out = found.withColumns({"status": status, "reason": F.when(F.col("refused") == 429, "too many requests").when(F.col("refused") == 413, "too large").otherwise(F.col("fault"))})
    names = [c for c in requests.columns if c != "text"]
    return out.select(*names, "format", "run_id", "status", "reason")
