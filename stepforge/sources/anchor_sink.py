"""Anchors that outside services prove: requests for proofs, answers checked before anything is stored, and a sink for the file.

Serving requests over a network is left to a gateway: requests are rows with the bytes to send, answers are rows with what came back.
Whatever the answers are, every record is stored; one whose answer doesn't hold is stored without a proof, and its outcome says why.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.asn1 import DIGESTS, OCTETS, SEQUENCE, encoded, write
from ..functions.crypto import sign_text
from ..operators.anchors import chained_lines, statement
from ..operators.proofs import check_entry, check_token, response_token
from ..schema import Wire
from ..shared import new_path, spread
from .growing import opened

INTEGER, BOOLEAN, NULL = 0x02, 0x01, 0x05
RECORD = "runId string, runHash string, keyId string, signature string, anchoredAt string, proof string"


# ---- requests ---------------------------------------------------------------------------------------------------


def timestamp_request(digest: bytes, nonce: bytes, policy: str | None = None, algorithm: str = "sha256") -> bytes:
    """DER of a request for a timestamp over a digest that asks for the signer's certificate, without which no one could check the token later."""
    if len(digest) != hashlib.new(algorithm).digest_size:
        raise ValueError(f"not a {algorithm} digest")
    name = next(o for o, n in DIGESTS.items() if n == algorithm)
    imprint = write(SEQUENCE, write(SEQUENCE, encoded(name) + write(NULL, b"")) + write(OCTETS, digest))
    return write(SEQUENCE, write(INTEGER, b"\1") + imprint + (encoded(policy) if policy else b"") + write(INTEGER, nonce) + write(BOOLEAN, b"\xff"))


def new_nonce() -> bytes:
    """64 bits that read as a positive number without a byte in front."""
    out = bytearray(os.urandom(8))
    out[0] = out[0] & 0x7F or 1
    return bytes(out)


def stated(candidates: DataFrame, wire: Wire = Wire()) -> DataFrame:
    """candidates (run_id, run_hash, keyId, signature) with `statement`."""
    return candidates.withColumn("statement", statement(F.col("run_id"), F.col("run_hash"), F.col("keyId"), F.col("signature"), wire))


def timestamp_requests(candidates: DataFrame, wire: Wire = Wire(), policy: str | None = None) -> DataFrame:
    """candidates with statement, nonce (hex) and request (DER). Nonces are random: write this before it is used twice."""

    @F.pandas_udf("nonce string, request binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            nonces = [new_nonce() for _ in x]
            yield pd.DataFrame({"nonce": [n.hex() for n in nonces], "request": [timestamp_request(hashlib.sha256(t.encode()).digest(), n, policy) for t, n in zip(x, nonces, strict=True)]})

    return stated(candidates, wire).withColumn("made", made("statement")).select("*", "made.*").drop("made")


def log_requests(candidates: DataFrame, private_pem: str, public_pem: str, wire: Wire = Wire()) -> DataFrame:
    """candidates with statement and request: the JSON of a proposal to a transparency log, the statement's digest signed with a key."""

    @F.pandas_udf(T.StringType())
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(one)

    def one(text: str) -> str:
        signature = {"content": sign_text(private_pem, text), "publicKey": {"content": base64.b64encode(public_pem.encode()).decode()}}
        return json.dumps({"apiVersion": "0.0.1", "kind": "hashedrekord", "spec": {"data": {"hash": {"algorithm": "sha256", "value": hashlib.sha256(text.encode()).hexdigest()}}, "signature": signature}})

    return spread(stated(candidates, wire)).withColumn("request", made("statement"))


# ---- answers ----------------------------------------------------------------------------------------------------


def token_proof(text: str, nonce: str, answer: bytes | None, pinned: str | None, url: str | None) -> tuple[str | None, str | None]:
    """(proof, error) of a timestamp answer."""
    if answer is None:
        return None, "no answer"
    try:
        status, token = response_token(answer)
    except (ValueError, IndexError, KeyError):
        return None, "the answer can't be read"
    if status > 1 or token is None:
        return None, f"refused with status {status}"
    found = check_token(token, hashlib.sha256(text.encode()).digest(), pinned, nonce)
    if not found["ok"]:
        return None, "; ".join(found["problems"])
    at = found["time"].isoformat().replace("+00:00", "Z")
    return json.dumps({"type": "rfc3161", "token": base64.b64encode(token).decode(), "genTime": at, "hashAlgorithm": "sha256", **({"tsaUrl": url} if url else {})}), None


def entry_proof(text: str, answer: bytes | None, log_key: str | None, url: str | None) -> tuple[str | None, str | None]:
    """(proof, error) of a log's answer, which holds one entry; without the log's key a consistent one is enough."""
    if answer is None:
        return None, "no answer"
    try:
        ((name, entry),) = json.loads(answer).items()
        found = check_entry(entry, hashlib.sha256(text.encode()).hexdigest(), text.encode(), log_key)
    except (ValueError, TypeError, AttributeError):
        return None, "the answer can't be read"
    if not (found["ok"] if log_key else found["consistent"]):
        return None, "; ".join(found["problems"]) or "the log's timestamp is missing"
    return json.dumps({"type": "rekor", "entry": {"uuid": name, **entry}, **({"rekorUrl": url} if url else {})}), None


def answered(requests: DataFrame, answers: DataFrame, anchored_at: str, pinned: str | None = None, log_key: str | None = None, url: str | None = None) -> DataFrame:
    """Rows RECORD with `error`, one for each request. answers: (run_id, answer), of which a run has one; requests with a nonce are for timestamps.

    A proof is there only if the answer holds in all that can be checked: digest, nonce, signatures, certificate, inclusion.
    """
    timed = "nonce" in requests.columns

    @F.pandas_udf("proof string, error string")
    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            held = [bytes(a) if isinstance(a, (bytes, bytearray)) else None for a in x["answer"]]
            rows = [token_proof(t, n, a, pinned, url) if timed else entry_proof(t, a, log_key, url) for t, n, a in zip(x["statement"], x["nonce"], held, strict=True)]
            yield pd.DataFrame(rows, columns=["proof", "error"])

    nonce = F.col("nonce") if timed else F.lit("").alias("nonce")
    out = spread(requests.join(answers.select("run_id", "answer"), "run_id", "left")).withColumn("x", judged(F.struct("statement", nonce, "answer")))
    return out.select(F.col("run_id").alias("runId"), F.col("run_hash").alias("runHash"), "keyId", "signature", F.lit(anchored_at).alias("anchoredAt"), "x.proof", "x.error")


# ---- the file ---------------------------------------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    partition: int
    path: str
    records: int


class AnchorFile(DataSource):
    """A sink for RECORD: lines of one file, each of which names the digest of the one before. Option path: the file."""

    @classmethod
    def name(cls) -> str:
        return "anchor_file"

    def schema(self) -> str:
        return RECORD

    def writer(self, schema: T.StructType, overwrite: bool) -> Appender:
        return Appender(self.options["path"], schema.fieldNames())


class Appender(DataSourceArrowWriter):
    """Tasks stage their records beside the file; the commit chains them behind its last line and puts the longer file in its place by one rename.

    A task that runs twice stages twice, and the commit takes the one that Spark names. A job that fails leaves the file as it was, and
    of tasks that end after it perhaps staged parts, which nothing reads.
    """

    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.job = path, names, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, at = opened(self.path)
        part = TaskContext.get().partitionId()
        path, n = f"{at}.staged-{self.job}/{part}-{uuid.uuid4().hex}", 0
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as f:
            for batch in iterator:
                for r in batch.to_pylist():
                    r = {k: json.loads(v) if k == "proof" else v for k, v in r.items() if v is not None}
                    f.write((json.dumps(r, ensure_ascii=False) + "\n").encode())
                    n += 1
        return Staged(part, path, n)

    def commit(self, messages: list[Staged | None]) -> None:
        store, at = opened(self.path)
        parts = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.partition)
        if parts:
            last, temp = None, f"{at}.{self.job}"
            with store.open_output_stream(temp) as out:
                if store.get_file_info(at).is_file:
                    with store.open_input_stream(at) as old:
                        held = b""
                        while block := old.read(1 << 20):
                            out.write(block)
                            *lines, held = (held + block).split(b"\n")
                            last = next((x.decode("utf-8", "replace") for x in reversed(lines) if x.strip()), last)
                        if held.strip():
                            last = held.decode("utf-8", "replace")
                        out.write(b"\n" if held else b"")
                for m in parts:
                    with store.open_input_stream(m.path) as f:
                        held = b""
                        while block := f.read(1 << 20):
                            *lines, held = (held + block).split(b"\n")
                            for line in chained_lines([json.loads(x) for x in lines], last):
                                out.write((line + "\n").encode())
                                last = line
            store.move(temp, at)
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        store, at = opened(self.path)
        try:
            store.delete_dir(f"{at}.staged-{self.job}")
        except FileNotFoundError:
            pass


def append(records: DataFrame, path: str) -> None:
    """Append RECORD rows, further columns left out, to an anchor file, made if there is none."""
    records.sparkSession.dataSource.register(AnchorFile)
    records.select(*[c.split()[0] for c in RECORD.split(", ")]).write.format("anchor_file").option("path", path).mode("append").save()


def store_anchors(requests: DataFrame, answers: DataFrame, path: str, anchored_at: str, pinned: str | None = None, log_key: str | None = None, url: str | None = None) -> DataFrame:
    """Check the answers, append a record for every request, and return the outcomes: rows (runId, runHash, proven, error)."""
    judged = answered(requests, answers, anchored_at, pinned, log_key, url)
    at = new_path(requests.sparkSession, "anchors")
    judged.write.parquet(at)
    done = requests.sparkSession.read.schema(judged.schema).parquet(at)
    append(done, path)
    return done.select("runId", "runHash", F.col("proof").isNotNull().alias("proven"), "error")

