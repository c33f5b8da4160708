"""One sweep: drafts of runs are committed to, sealed and stored, those stored already are left out, and all are counted on the way."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..shared import scope
from . import analyze, integrity, policy, redact
from .store import Store

LOG = "array<struct<path:string,at:string,reason:string,by:string>>"


@dataclass(frozen=True)
class Counts:
    ingested: int
    skipped: int
    violations: int


def with_marks(runs: DataFrame) -> DataFrame:
    """runs with a signature and a seal of redactions, null where they had none."""
    for name, kind in (("signature", integrity.SIGNATURE), ("redaction_seal", integrity.SEAL)):
        if name not in runs.columns:
            runs = runs.withColumn(name, F.lit(None).cast(kind))
    return runs


def sweep(store: Store, runs: DataFrame, steps: DataFrame, ingested_at: str, rules: policy.Policy | None = None, batch: tuple[str, int] | None = None) -> Counts:
    """Store drafts: runs (run_id, name, currency, declared) and their steps.

    What is new and what is stored already is counted by the pass that writes the new runs' heads, and violations of rules by the pass that
    writes them to `violations` beside the store; no other job counts. batch: as Store.save() takes it.
    """
    spark, temp = runs.sparkSession, f"{store.path}/_sweep-{uuid.uuid4().hex}"
    have = store.table("runs")
    marked = runs.withColumn("stored", F.lit(False)) if have is None else runs.join(have.select("run_id").withColumn("stored", F.lit(True)), "run_id", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    seen, broke = Observation(), Observation()
    try:
        marked.observe(seen, F.count_if("stored").alias("skipped"), F.count_if(~F.col("stored")).alias("ingested")).where(~F.col("stored")).drop("stored").write.parquet(f"{temp}/heads")
        heads = spark.read.schema(runs.schema).parquet(f"{temp}/heads")
        empty = {"commitments": "map<string,string>", "salts": "map<string,string>", "redactions": LOG}
        salted = redact.commit(steps.join(heads.select("run_id"), "run_id", "left_semi").withColumns({c: F.lit(None).cast(t) for c, t in empty.items()}))
        # Salts are random: they are written before anything reads them twice.
        salted.write.parquet(f"{temp}/steps")
        own = spark.read.schema(salted.schema).parquet(f"{temp}/steps")
        full = heads.join(analyze.bounds(own), "run_id", "left").join(analyze.status(own, heads.withColumnRenamed("declared", "status")), "run_id", "left").drop("declared")
        with scope(spark, []):
            sealed, chained = integrity.seal(full, own)
            stored = store.save(with_marks(sealed), chained, ingested_at, batch)
        violations = 0
        if rules is not None and stored and seen.get["ingested"]:
            sums = analyze.totals(own).join(heads.select("run_id"), "run_id").withColumn("signed", F.lit(False))
            found = policy.evaluate(sums.select("run_id", "cost", "tokens", "steps", "signed"), own, analyze.warnings(own), rules)
            found.withColumn("ingested_at", F.lit(ingested_at)).observe(broke, F.count(F.lit(1)).alias("violations")).write.mode("append").parquet(f"{store.path}/violations")
            violations = broke.get["violations"]
        return Counts(seen.get["ingested"] if stored else 0, seen.get["skipped"], violations)
    finally:
        store.fs.delete(store.fs_path(temp), True)
