"""Commitments to payload leaves, scrubbing before they are hashed, and erasing afterwards."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import ABSENT, canonical_text, commitment, leaves, parsed, replaced, split_path, value_at
from ..schema import JSON_NAMES, PAYLOADS, Wire

#: What each detector looks for. Words are ASCII, white space is Unicode; the first that hits gives the name.
EDGE, SPACE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))", r"[\t-\r\x20\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
DETECTORS = {
    "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}",
    "credit-card": EDGE + r"(?:[0-9][ -]*?){13,19}" + EDGE,
    "ssn": EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + EDGE,
    "aadhaar": EDGE + "[0-9]{4}" + SPACE + "?[0-9]{4}" + SPACE + "?[0-9]{4}" + EDGE,
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer-token": EDGE + "(?:sk-|ghp_|Bearer" + SPACE + r"+)[A-Za-z0-9_\-.]{16,}",
}


#: Fixed value: the reason that a legacy redaction gives by default.
LEGACY = "legacy redaction (record re-chained)"


def detectors(names: tuple[str, ...] | None = None) -> dict[str, str]:
    if names is None:
        return DETECTORS
    if unknown := set(names) - set(DETECTORS):
        raise ValueError(f"unknown detectors: {', '.join(sorted(unknown))}; there are {', '.join(DETECTORS)}")
    return {n: DETECTORS[n] for n in names}


def first_hit(text: Column, names: tuple[str, ...] | None = None) -> Column:
    """The name of the first detector that hits a text; null if none does. Native."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in detectors(names).items()])


def hit(leaf: object, found: dict[str, re.Pattern]) -> str | None:
    if leaf is None:
        return None
    text = leaf if isinstance(leaf, str) else canonical_text(leaf)
    return next((n for n, p in found.items() if p.search(text)), None)


REDACTION = T.StructType([T.StructField(n, T.StringType()) for n in ("path", "at", "reason", "by")])
MAP = T.MapType(T.StringType(), T.StringType())
EDITED = T.StructType([*[T.StructField(c, T.StringType()) for c in PAYLOADS], T.StructField("commitments", MAP), T.StructField("salts", MAP), T.StructField("redactions", T.ArrayType(REDACTION)), T.StructField("paths", T.ArrayType(T.StringType()))])


def edited(steps: DataFrame, change, columns: tuple[str, ...]) -> DataFrame:
    """steps with the given columns from change(row), a dict of EDITED's members."""

    @F.pandas_udf(EDITED)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [change(r) for r in x.astype(object).where(x.notna(), None).to_dict("records")]
            yield pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in EDITED.fields})

    # No list here is null, as in without_null_lists().
    listed = lambda c: F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>")).alias(c)
    log = F.coalesce("redactions", F.array().cast(T.ArrayType(REDACTION))).alias("redactions")
    fields = F.struct("id", *PAYLOADS, listed("commitments"), listed("salts"), F.col("salts").isNotNull().alias("salted"), log)
    out = steps.withColumn("_edit", run(fields))
    return out.withColumns({c: F.col(f"_edit.{c}") for c in columns}).drop("_edit")


def pairs(x) -> dict[str, str]:
    return {e["key"]: e["value"] for e in x} if x is not None else {}


def logged(x) -> list[dict]:
    return [dict(r) for r in x] if x is not None else []


def scrub(steps: DataFrame, at: str, names: tuple[str, ...] | None = None, version: int = 2, wire: Wire = Wire()) -> DataFrame:
    """Payload leaves that a detector hits become the marker before anything is hashed; redactions say which and why."""
    found = {n: re.compile(p) for n, p in detectors(names).items()}

    def change(row: dict) -> dict:
        out = {c: row[c] for c in PAYLOADS} | {"redactions": logged(row["redactions"])}
        for c in PAYLOADS:
            if row[c] is None:
                continue
            value = parsed(row[c])
            hits = [(p, n) for p, leaf in list(leaves(value, JSON_NAMES[c], version)) if (n := hit(leaf, found))]
            for path, name in hits:
                value = replaced(value, split_path(path, version)[1], wire.redacted)
                out["redactions"].append({"path": path, "at": at, "reason": f"pattern:{name}", "by": "pattern"})
            if hits:
                out[c] = canonical_text(value)
        return out

    return edited(steps, change, (*PAYLOADS, "redactions"))


def commit(steps: DataFrame, version: int = 2, salt=None) -> DataFrame:
    """commitments and salts for every payload leaf. Salts are random: write the result before using it twice.

    salt: a function from (step id, path) to hex, for tests.
    """
    make = salt or (lambda step, path: os.urandom(16).hex())

    def one(step: str, texts: tuple) -> tuple[dict, dict]:
        salts, out = {}, {}
        for c, text in zip(PAYLOADS, texts, strict=True):
            if isinstance(text, str):
                for path, leaf in leaves(parsed(text), JSON_NAMES[c], version):
                    salts[path] = make(step, path)
                    out[path] = commitment(salts[path], canonical_text(leaf))
        return out, salts

    @F.pandas_udf(T.StructType([T.StructField("commitments", MAP), T.StructField("salts", MAP)]))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [one(step, texts) for step, *texts in zip(x["id"], *[x[c] for c in PAYLOADS], strict=True)]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(("commitments", "salts"))})

    out = steps.withColumn("_edit", run(F.struct("id", *PAYLOADS)))
    return out.withColumns({c: F.col(f"_edit.{c}") for c in ("commitments", "salts")}).drop("_edit")


def targets(row: dict, paths: tuple[str, ...], found: dict[str, re.Pattern], version: int, wire: Wire) -> list[str]:
    """Paths of a step that are named, as `step#path` or for every step, or that a detector hits; each once."""
    out = [leaf for step, _, leaf in (p.rpartition("#") for p in paths) if leaf and step in ("", row["id"])]
    for c in PAYLOADS if found else ():
        if row[c] is not None:
            out += [p for p, leaf in leaves(parsed(row[c]), JSON_NAMES[c], version) if leaf != wire.redacted and hit(leaf, found)]
    return list(dict.fromkeys(out))


def redact(steps: DataFrame, at: str, paths: tuple[str, ...] = (), names: tuple[str, ...] = (), reason: str | None = None, version: int = 2, legacy: bool = False, wire: Wire = Wire()) -> DataFrame:
    """Erase leaves: value and salt go, the commitment stays, the log says so; `redacted_paths` lists them.

    Where a step has no commitment to a path, nothing happens. legacy: for records without commitments, any leaf that
    is there goes; the run must then be sealed anew, and its old signature means nothing.
    """
    found = {n: re.compile(p) for n, p in detectors(names).items()} if names else {}

    def change(row: dict) -> dict:
        committed, salts, log, gone = pairs(row["commitments"]), pairs(row["salts"]), logged(row["redactions"]), []
        values = {JSON_NAMES[c]: parsed(row[c]) for c in PAYLOADS if row[c] is not None}
        for path in targets(row, paths, found, version, wire):
            field, tokens = split_path(path, version)
            if field not in values or (value_at(values[field], tokens) is ABSENT if legacy else path not in committed):
                continue
            values[field] = replaced(values[field], tokens, wire.redacted)
            salts.pop(path, None)
            log.append({"path": path, "at": at, "reason": reason or (LEGACY if legacy else None), "by": "pattern" if names else "manual"})
            gone.append(path)
        changed = {split_path(p, version)[0] for p in gone}
        return {c: canonical_text(values[JSON_NAMES[c]]) if JSON_NAMES[c] in changed else row[c] for c in PAYLOADS} | {
            "salts": salts if row["salted"] else None, "redactions": log, "paths": gone,
        }

    out = edited(steps.withColumn("paths", F.lit(None)), change, (*PAYLOADS, "salts", "redactions", "paths"))
    return out.withColumnRenamed("paths", "redacted_paths")
