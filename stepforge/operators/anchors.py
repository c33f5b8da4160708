"""Anchors: statements about runs in an append-only JSONL file whose lines chain, and how strongly they bind."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_text, string_text
from ..functions.crypto import inclusion_root, leaf_hash
from ..schema import Wire

RECORD = "version int, runId string, runHash string, keyId string, signature string, anchoredAt string, prev string, recordSignature struct<algorithm:string,keyId:string,publicKey:string,signature:string>, proof string"
#: Strengths, weakest first.
STRENGTHS = ("none", "local", "self-attested", "external")


def statement(run_id: Column, run_hash: Column, key_id: Column, signature: Column, wire: Wire = Wire()) -> Column:
    """The five lines that an anchor attests to. Values are JSON strings, or null."""

    @F.pandas_udf(T.StringType())
    def quoted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(string_text, na_action="ignore")

    j = lambda c: F.coalesce(quoted(c), F.lit("null"))
    lines = [F.lit(f"{wire.namespace}-anchor-v2"), *[F.concat(F.lit(f"{n}: "), j(c)) for n, c in (("runId", run_id), ("runHash", run_hash), ("keyId", key_id), ("signature", signature))]]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def read_lines(lines: DataFrame) -> DataFrame:
    """Rows (file, line, ok, problem, record...) of anchor files. lines: (file, line, raw).

    A line's predecessor is the last one that isn't blank, well-formed or not. Records of version 1 aren't chained; of
    version 2, the first may stand on unchained ones.
    """
    some = lines.where(F.length(F.trim("raw")) > 0)
    order = Window.partitionBy("file").orderBy("line")
    rec = F.from_json("raw", RECORD)
    out = some.withColumn("before", F.lag(F.sha2("raw", 256)).over(order)).withColumn("r", rec)
    known = F.try_parse_json("raw").isNotNull()
    fine = known & F.get_json_object("raw", "$.runId").isNotNull() & F.get_json_object("raw", "$.runHash").isNotNull()
    chained = fine & (F.col("r.version") == 2)
    earlier = F.coalesce(F.max(chained.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    broken = chained & (earlier | F.col("r.prev").isNotNull()) & ~F.col("r.prev").eqNullSafe(F.col("before"))
    problem = F.when(~known, "not valid JSON").when(~fine, "not an anchor record").when(broken, "chain break")
    return out.select("file", "line", problem.isNull().alias("ok"), problem.alias("problem"), "r.*")


def chained_lines(records: list[dict], last: str | None) -> list[str]:
    """The lines to append for new records; last: the file's last line that isn't blank."""
    import hashlib

    out = []
    for r in records:
        prev = hashlib.sha256(last.encode()).hexdigest() if last is not None else None
        last = json.dumps({**r, "version": 2, "prev": prev}, ensure_ascii=False, separators=(",", ":"))
        out.append(last)
    return out


def fresh(candidates: DataFrame, anchored: DataFrame) -> DataFrame:
    """Candidates (run_id, run_hash) that aren't anchored with that hash; `conflict` if they are with another one."""
    have = anchored.groupBy(F.col("runId").alias("run_id")).agg(F.collect_set("runHash").alias("hashes"))
    out = candidates.join(have, "run_id", "left")
    return out.where(F.col("hashes").isNull() | ~F.array_contains("hashes", F.col("run_hash"))).withColumn("conflict", F.col("hashes").isNotNull()).drop("hashes")


def orphans(records: DataFrame, runs: DataFrame) -> DataFrame:
    return records.join(runs.select(F.col("run_id").alias("runId")), "runId", "left_anti")


def record_text(r: dict) -> str:
    """What a record's own signature covers: the record without the signature itself."""
    return canonical_text({k: v for k, v in r.items() if k != "recordSignature" and v is not None or k == "prev"})


def verify(runs: DataFrame, records: DataFrame, proofs: DataFrame | None = None) -> DataFrame:
    """Rows (run_id, found, matched, mismatched, strength, ok, proven_by). runs: (run_id, run_hash).

    proofs: (runId, runHash, strength, proven_at, proof_ok), the checked external proofs, where there are any.
    """
    mine = records.where("ok").select(F.col("runId").alias("run_id"), F.col("runHash").alias("anchored"))
    n = runs.select("run_id", "run_hash").join(mine, "run_id", "left").groupBy("run_id", "run_hash").agg(F.count("anchored").alias("found"), F.count_if(F.col("anchored") == F.col("run_hash")).alias("matches"))
    rank = lambda c: F.array_position(F.array(*map(F.lit, STRENGTHS)), c)
    if proofs is not None:
        p = proofs.groupBy(F.col("runId").alias("run_id"), F.col("runHash").alias("run_hash")).agg(F.max_by("strength", rank(F.col("strength"))).alias("best"), F.min("proven_at").alias("proven_by"), F.bool_and("proof_ok").alias("proofs_ok"))
        n = n.join(p, ["run_id", "run_hash"], "left")
    else:
        n = n.withColumns({"best": F.lit(None).cast("string"), "proven_by": F.lit(None).cast("string"), "proofs_ok": F.lit(True)})
    strength = F.when(F.col("matches") == 0, "none").otherwise(F.coalesce("best", F.lit("local")))
    return n.select("run_id", "found", (F.col("matches") > 0).alias("matched"), (F.col("found") - F.col("matches")).alias("mismatched"), strength.alias("strength"), ((F.col("found") == F.col("matches")) & F.coalesce("proofs_ok", F.lit(True))).alias("ok"), "proven_by")


def log_entries(responses: DataFrame) -> DataFrame:
    """Rows (uuid, entry) from transparency-log answers (raw), which hold exactly one entry each."""
    found = F.map_entries(F.from_json("raw", "map<string,string>"))
    return responses.where(F.size(found) == 1).select(found[0]["key"].alias("uuid"), found[0]["value"].alias("entry"))


def inclusion_ok(body: bytes, index: int, size: int, hashes: list[str], root: str) -> bool:
    """Whether a log entry's inclusion proof leads to the root it names."""
    try:
        return inclusion_root(leaf_hash(body), index, size, [bytes.fromhex(h) for h in hashes]).hex() == root
    except ValueError:
        return False
