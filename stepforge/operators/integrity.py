"""Hash chains, run anchors, signatures and commitments.

Sealing walks a run's steps in order, streamed through one task; verifying doesn't: each link is checked against its
predecessor's stored hash, so that a shuffle on run_id and one digest for each step are all it takes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import ABSENT, SAFE, canonical_text, canonicalize, commitment, number_text, parsed, plain_json, plain_number, plain_string, split_path, string_text, value_at
from ..functions.crypto import key_id, sign_text, verify_text
from ..schema import HASH_VERSIONS, JSON_NAMES, PAYLOADS, RUN_TAG, STEP_TAG, Wire
from ..shared import spread, without_null_lists, written

#: Columns of a step that its hash covers, by their names in a record.
HASHED = {
    "id": "id", "index": "index", "type": "type", "label": "label", "startedAt": "started_at", "durationMs": "duration_ms", "tokens": "tokens", "cost": "cost",
    "toolName": "tool_name", "input": "input", "output": "output", "dataPayload": "data_payload", "spanId": "span_id", "parentSpanId": "parent_span_id", "runId": "run_id",
}
NUMBERS = {"index", "duration_ms", "tokens", "cost"}
QUOTED = [(string_text(name), name, column) for name, column in sorted(HASHED.items())]


def step_text(row: dict, version: int) -> str | None:
    """Canonical text of a step's hashed members: absent ones are left out, and a payload with commitments is their map."""
    parts = []
    committed = dict(row["commitments"] or ())
    for quoted, name, column in QUOTED:
        value = row[column]
        if name == "runId" and version != 2:
            continue
        view = {p: c for p, c in committed.items() if p == name or p.startswith((f"{name}.", f"{name}["))} if committed and column in PAYLOADS else None
        if view:
            text = canonical_text(view)
        elif value is None or value != value:
            continue
        elif column in PAYLOADS:
            if (text := canonicalize(value)) is None:
                return None
        else:
            text = number_text(float(value)) if column in NUMBERS else string_text(value)
        parts.append(f"{quoted}:{text}")
    return "{" + ",".join(parts) + "}"


def committed_to(name: str) -> Column:
    """The entries of `commitments` under a payload."""
    return F.filter(F.map_entries("commitments"), lambda e: (e["key"] == name) | e["key"].startswith(f"{name}.") | e["key"].startswith(f"{name}["))


def plain_step(version: int = 2) -> Column:
    """A column of a steps DataFrame: step_text() by built-in functions; null where a member needs more than these."""
    members = []
    for quoted, name, column in QUOTED:
        value, absent = F.col(column), F.col(column).isNull()
        if name == "runId" and version != 2:
            continue
        if column in PAYLOADS:
            own = committed_to(name)
            some = F.coalesce(F.size(own) > 0, F.lit(False))
            listed = F.array_join(F.transform(F.array_sort(own), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":"'), e["value"], F.lit('"'))), ",")
            view = F.when(F.forall(own, lambda e: e["key"].rlike(SAFE) & e["value"].rlike(SAFE)), F.concat(F.lit("{"), listed, F.lit("}")))
            text, absent = F.when(some, view).otherwise(plain_json(value)), absent & ~some
        elif column in NUMBERS:
            value = value.cast("double")
            text, absent = plain_number(value), absent | F.isnan(value)
        else:
            text = plain_string(value)
        members.append(F.when(absent, "").otherwise(F.concat(F.lit(f",{quoted}:"), text)))
    return F.concat(F.lit("{"), F.substring(F.concat(*members), 2, 2**31 - 1), F.lit("}"))


def canonical_step(version: int = 2, plain: Column | None = None) -> Column:
    """A column of a steps DataFrame: step_text() of each row; null where a payload can't be read. plain: plain_step(), if it is a column already.

    Rows that plain_step() leaves out go to Python, as one text each: an Arrow batch is measured after each row, column by column.
    """
    plain = plain_step(version) if plain is None else plain

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(one, na_action="ignore").astype(object)

    def one(row: str) -> str | None:
        held = json.loads(row)
        return step_text({c: float(v) if c in NUMBERS and isinstance(v, str) else v for c in (*HASHED.values(), "commitments") for v in (held.get(c),)}, version)

    return F.coalesce(plain, text(F.when(plain.isNull(), F.to_json(F.struct(*HASHED.values(), "commitments")))))


def with_canonical(steps: DataFrame, version: int = 2) -> DataFrame:
    """steps with `canonical`, canonical_step()."""
    return steps.withColumn("_plain", plain_step(version)).withColumn("canonical", canonical_step(version, F.col("_plain"))).drop("_plain")


def preimage(text: Column, previous: Column, version: int) -> Column:
    tag = F.concat(F.lit(STEP_TAG[:-1]), F.chr(F.lit(0)))
    return F.concat(tag, text, F.chr(F.lit(0)), previous) if version == 2 else F.concat(text, previous)


def link(text: str, previous: str, version: int) -> str:
    return hashlib.sha256((f"{STEP_TAG}{text}\0{previous}" if version == 2 else text + previous).encode("utf-8", "surrogatepass")).hexdigest()


def chain(df: DataFrame, text_col: str = "canonical", version: int = 2, order: str = "pos") -> DataFrame:
    """df with prev_hash and hash along each run, from a column of canonical text.

    A run's rows stream through a task in order, in batches: the length of a run takes time, not memory.
    """
    base, back = without_null_lists(df.drop("hash", "prev_hash"))
    columns = base.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, previous = object(), ""
        for batch in batches:
            before, hashes = [], []
            for key, text in zip(batch.column("run_id").to_pylist(), batch.column(text_col).to_pylist(), strict=True):
                if key != last:
                    last, previous = key, ""
                before.append(previous)
                previous = link(text or "", previous, version)
                hashes.append(previous)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(hashes, pa.string())], [*columns, "prev_hash", "hash"])

    schema = T.StructType([*base.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
    return back(spread(base, "run_id").sortWithinPartitions("run_id", order).mapInArrow(run, schema))


def anchors(chained: DataFrame, order: str = "pos") -> DataFrame:
    """Rows (run_id, anchor, steps): the last hash of each run."""
    return chained.groupBy("run_id").agg(F.max_by("hash", order).alias("anchor"), F.count(F.lit(1)).alias("steps"))


def broken_links(df: DataFrame, text_col: str = "canonical", version: int = 2, order: str = "pos") -> DataFrame:
    """Rows (run_id, broken_index): each run's first step whose hash or predecessor is wrong; null if all hold."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("run_id").orderBy(order)), F.lit(""))
    right = F.col("prev_hash").eqNullSafe(before) & F.col("hash").eqNullSafe(F.sha2(preimage(F.col(text_col), before, version), 256))
    return df.select("run_id", order, (~right).alias("bad")).groupBy("run_id").agg(F.min(F.when(F.col("bad"), F.col(order))).alias("broken_index"))


def run_hash(runs: DataFrame) -> DataFrame:
    """runs with `expected_hash`. runs: header columns, totals (struct), step_count, anchor, hash_version.

    Version 1: the anchor. Version 2: a digest of the canonical header and the anchor. Without steps: empty.
    """

    @F.pandas_udf(T.StringType())
    def header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            out = []
            for r in x.to_dict("records"):
                value = {"hashVersion": 2, "id": r["run_id"], "name": r["name"], "startedAt": r["started_at"], "endedAt": r["ended_at"], "status": r["status"], "currency": r["currency"], "totals": {k: r[k] for k in ("tokens", "cost", "durationMs", "steps")}, "stepCount": r["step_count"], "chainAnchor": r["anchor"]}
                out.append(canonical_text(value))
            yield pd.Series(out, dtype=object)

    text = header(F.struct("run_id", "name", "started_at", "ended_at", "status", "currency", F.col("totals.tokens").alias("tokens"), F.col("totals.cost").alias("cost"), F.col("totals.durationMs").alias("durationMs"), F.col("totals.steps").alias("steps"), "step_count", "anchor"))
    tagged = F.sha2(F.concat(F.lit(RUN_TAG[:-1]), F.chr(F.lit(0)), text), 256)
    return runs.withColumn("expected_hash", F.when(F.col("step_count") == 0, "").when(F.coalesce("hash_version", F.lit(1)) == 2, tagged).otherwise(F.coalesce("anchor", F.lit(""))))


def seal(runs: DataFrame, steps: DataFrame, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """(runs with run_hash and hash_version, steps with their hashes). runs: run_id, name, started_at, ended_at, status, currency.

    Both are written before they are returned, since whatever verifies them reads each several times.
    """
    from .analyze import exact_totals

    chained = written(chain(with_canonical(steps, version), version=version).drop("canonical"), "sealed-steps")
    sums = exact_totals(chained).select("run_id", F.struct("tokens", "cost", F.col("duration_ms").alias("durationMs"), "steps").alias("totals"))
    none = F.struct(F.lit(0.0).alias("tokens"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("durationMs"), F.lit(0).cast("long").alias("steps"))
    heads = runs.join(sums, "run_id", "left").withColumn("totals", F.coalesce("totals", none)).join(anchors(chained).select("run_id", "anchor", F.col("steps").alias("step_count")), "run_id", "left").fillna(0, ["step_count"])
    heads = run_hash(heads.withColumn("hash_version", F.lit(version)))
    return written(heads.withColumnRenamed("expected_hash", "run_hash").drop("anchor", "step_count"), "sealed-runs"), chained


def verify_runs(runs: DataFrame, steps: DataFrame, wire: Wire = Wire()) -> DataFrame:
    """Rows (run_id, ok, failure, broken_index, expected_hash, redacted): the first check that fails.

    failure: version, chain, commitment, undeclared or anchor; null if all hold. A live run isn't sealed yet and has
    no place here. expected_hash is built on the last stored hash and so is null where the chain is broken.
    """
    version = F.coalesce("hash_version", F.lit(1))
    known = steps.join(runs.select("run_id", version.alias("v")), "run_id").where(F.col("v").isin(*HASH_VERSIONS))
    broken, leaves = None, None
    for v in HASH_VERSIONS:
        some = known.where(F.col("v") == v)
        found = broken_links(with_canonical(some, v), version=v)
        checked = check_commitments(some, v, wire)
        broken, leaves = (found, checked) if broken is None else (broken.unionByName(found), leaves.unionByName(checked))
    bad, gone = F.col("state").isin("mismatched", "undeclared"), F.col("state") == "redacted"
    first = F.min(F.when(bad, F.struct("pos", F.when(F.col("state") == "undeclared", 0).otherwise(1).alias("o")))).alias("first")
    redacted = F.transform(F.array_sort(F.collect_list(F.when(gone, F.struct("pos", "path")))), lambda x: x["path"]).alias("redacted")
    spoiled = leaves.groupBy("run_id").agg(first, redacted)
    heads = runs.join(anchors(steps).select("run_id", "anchor", F.col("steps").alias("step_count")), "run_id", "left").fillna(0, ["step_count"])
    heads = run_hash(heads).join(broken, "run_id", "left").join(spoiled, "run_id", "left")
    failure = F.when(~version.isin(*HASH_VERSIONS), "version").when(F.col("broken_index").isNotNull(), "chain").when(F.col("first").isNotNull(), F.when(F.col("first.o") == 0, "undeclared").otherwise("commitment")).when(~F.col("run_hash").eqNullSafe(F.col("expected_hash")), "anchor")
    at = F.when(failure == "chain", F.col("broken_index")).when(failure.isin("commitment", "undeclared"), F.col("first.pos")).when((failure == "anchor") & (F.col("step_count") > 0), F.col("step_count") - 1)
    return heads.select("run_id", failure.isNull().alias("ok"), failure.alias("failure"), at.alias("broken_index"), F.when(F.col("broken_index").isNull(), F.col("expected_hash")).alias("expected_hash"), F.coalesce("redacted", F.array().cast("array<string>")).alias("redacted"))


def check_commitments(steps: DataFrame, version: int, wire: Wire = Wire()) -> DataFrame:
    """Rows (run_id, pos, path, state): verified, mismatched, redacted or undeclared, for every committed leaf."""
    state = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("state", T.StringType())]))

    @F.pandas_udf(state)
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            names = list(x.columns)
            yield pd.Series([leaf_states(dict(zip(names, r, strict=True)), version, wire) for r in zip(*[x[n] for n in names], strict=True)], dtype=object)

    found = steps.where("commitments is not null").select("run_id", "pos", F.explode(check(F.struct(*PAYLOADS, F.map_entries("commitments").alias("commitments"), F.coalesce(F.map_entries("salts"), F.array().cast("array<struct<key:string,value:string>>")).alias("salts"), F.coalesce(F.transform("redactions", lambda r: r["path"]), F.array().cast("array<string>")).alias("declared")))).alias("x"))
    return found.select("run_id", "pos", "x.path", "x.state")


@lru_cache(4096)
def known_path(path: str, version: int) -> tuple[str, list[str]]:
    """split_path(), of which a table's steps share many; nothing changes the list."""
    return split_path(path, version)


def leaf_states(row: dict, version: int, wire: Wire) -> list[dict]:
    values = {JSON_NAMES[c]: parsed(row[c]) if isinstance(row[c], str) else ABSENT for c in PAYLOADS}
    salts, declared = {x["key"]: x["value"] for x in row["salts"]}, set(row["declared"])
    out = []
    for x in row["commitments"]:
        path = x["key"]
        field, at = known_path(path, version)
        value = value_at(values.get(field, ABSENT), at)
        if path not in salts:
            state = "redacted" if version == 1 or path in declared and value == wire.redacted else "undeclared"
        else:
            text = "undefined" if value is ABSENT else canonical_text(value)
            state = "verified" if commitment(salts[path], text) == x["value"] else "mismatched"
        out.append({"path": path, "state": state})
    return out


# ---- signatures -------------------------------------------------------------------------------------------------


def signed_text(run_id: str, run_hash_: str, signed_at: str) -> str:
    return canonical_text({"runId": run_id, "runHash": run_hash_, "signedAt": signed_at})


def sealed_text(run_id: str, run_hash_: str, log_hash: str, sealed_at: str) -> str:
    return canonical_text({"runId": run_id, "runHash": run_hash_, "redactionsHash": log_hash, "sealedAt": sealed_at})


def log_digest(log: list[dict]) -> str:
    """Digest of a redaction log: [{stepId, redactions: [...]}] in step order; absent members are left out."""
    return hashlib.sha256(("tgredact/2\0" + canonical_text(log)).encode("utf-8", "surrogatepass")).hexdigest()


SIGNATURE = "struct<algorithm:string,keyId:string,publicKey:string,signature:string,signedAt:string>"


def sign_runs(runs: DataFrame, private_pem: str, public_pem: str, signed_at: str) -> DataFrame:
    """runs with `signature` over run_id, run_hash and signed_at. A run without run_hash isn't signed."""
    kid = key_id(public_pem)

    @F.pandas_udf(T.StringType())
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([sign_text(private_pem, signed_text(r["run_id"], r["run_hash"], signed_at)) for r in x.to_dict("records")], dtype=object)

    mark = F.struct(F.lit("ed25519").alias("algorithm"), F.lit(kid).alias("keyId"), F.lit(public_pem).alias("publicKey"), sign(F.struct("run_id", "run_hash")).alias("signature"), F.lit(signed_at).alias("signedAt"))
    return spread(runs).withColumn("signature", F.when(F.col("run_hash") != "", mark))


def verify_signatures(runs: DataFrame) -> DataFrame:
    """Rows (run_id, signature_ok, key_id): an unsigned run is ok and has no key. The algorithm's name isn't read."""

    @F.pandas_udf(T.BooleanType())
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([verify_text(r["key"], signed_text(r["run_id"], r["run_hash"], r["at"]), r["sig"]) for r in x.to_dict("records")])

    s = F.col("signature")
    holds = check(F.struct("run_id", "run_hash", s["publicKey"].alias("key"), F.coalesce(s["signedAt"], F.lit("")).alias("at"), s["signature"].alias("sig")))
    return spread(runs).select("run_id", F.when(s.isNull(), True).otherwise(holds).alias("signature_ok"), s["keyId"].alias("key_id"))


def redaction_log(steps: DataFrame) -> DataFrame:
    """Rows (run_id, log): JSON of the run's redactions, in step order and then log order."""
    some = steps.where(F.size("redactions") > 0).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("id").alias("stepId"), "redactions"))).alias("x"))
    return some.select("run_id", F.to_json(F.transform("x", lambda r: F.struct(r["stepId"].alias("stepId"), r["redactions"].alias("redactions")))).alias("log"))


SEAL = "struct<algorithm:string,keyId:string,publicKey:string,signature:string,sealedAt:string,redactionsHash:string>"


def seal_redactions(runs: DataFrame, steps: DataFrame, private_pem: str, public_pem: str, sealed_at: str) -> DataFrame:
    """runs with `redaction_seal` over the run's hash and its redaction log; null where nothing is redacted."""
    kid = key_id(public_pem)

    @F.pandas_udf(T.StructType([T.StructField("hash", T.StringType()), T.StructField("signature", T.StringType())]))
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            hashes = [log_digest(json.loads(r)) if r is not None else None for r in x["log"]]
            said = [sign_text(private_pem, sealed_text(i, h, d, sealed_at)) if d else None for i, h, d in zip(x["run_id"], x["run_hash"], hashes, strict=True)]
            yield pd.DataFrame({"hash": hashes, "signature": said})

    out = spread(runs.join(redaction_log(steps), "run_id", "left")).withColumn("x", sign(F.struct("run_id", "run_hash", "log")))
    mark = F.struct(F.lit("ed25519").alias("algorithm"), F.lit(kid).alias("keyId"), F.lit(public_pem).alias("publicKey"), F.col("x.signature").alias("signature"), F.lit(sealed_at).alias("sealedAt"), F.col("x.hash").alias("redactionsHash"))
    return out.withColumn("redaction_seal", F.when(F.col("log").isNotNull(), mark)).drop("x", "log")


def verify_seals(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (run_id, seal_ok, attested): without a seal nothing is wrong and nothing attested."""

    @F.pandas_udf(T.BooleanType())
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            out = []
            for r in x.to_dict("records"):
                h = log_digest(json.loads(r["log"]))
                out.append(r["hash"] == h and verify_text(r["key"], sealed_text(r["run_id"], r["run_hash"], h, r["at"]), r["sig"]))
            yield pd.Series(out)

    s = F.col("redaction_seal")
    logs = spread(runs.join(redaction_log(steps), "run_id", "left"))
    holds = check(F.struct("run_id", "run_hash", F.coalesce("log", F.lit("[]")).alias("log"), s["redactionsHash"].alias("hash"), s["publicKey"].alias("key"), F.coalesce(s["sealedAt"], F.lit("")).alias("at"), s["signature"].alias("sig")))
    return logs.select("run_id", F.when(s.isNull(), True).otherwise(holds).alias("seal_ok"), F.when(s.isNull(), False).otherwise(holds).alias("attested"))


def verify_full(runs: DataFrame, steps: DataFrame, wire: Wire = Wire()) -> DataFrame:
    """verify_runs() with signature_ok, key_id, seal_ok, attested, and `all_ok` over all of them."""
    out = verify_runs(runs, steps, wire).join(verify_signatures(runs), "run_id").join(verify_seals(runs, steps), "run_id")
    return out.withColumn("all_ok", F.col("ok") & F.col("signature_ok") & F.col("seal_ok"))
