"""Producers of records: a live recorder, tool calls of an agent protocol, and span attributes as steps."""

from __future__ import annotations

import inspect
import json
import os
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.canonical import canonical_text, commitment, leaves, parsed, replaced, split_path
from ..functions.crypto import key_id, sign_text
from ..operators.integrity import link, signed_text, step_text
from ..operators.redact import detectors, hit
from ..schema import HASH_VERSIONS, JSON_NAMES, RUN_TAG, STATUSES, STEP_TYPES, Wire
from .traces import attribute


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class Recorder:
    """Records one run: each step is scrubbed, committed to, chained and journalled before step() returns.

    folder: where the journal file goes, one line an event; None records in memory only. A run that is never ended
    can be recovered from its journal. keys: (private, public) PEM to sign the ended run with.
    """

    def __init__(self, name: str, folder: str | None = None, run_id: str | None = None, currency: str = "USD", redactable: bool = True, scrub: tuple[str, ...] = (), keys: tuple[str, str] | None = None, wire: Wire = Wire()):
        import re

        self.name, self.currency, self.keys, self.wire, self.redactable = name, currency, keys, wire, redactable
        self.run_id = run_id or f"sdk-{now()[:10]}-{os.urandom(3).hex()}"
        self.found = {n: re.compile(p) for n, p in detectors(scrub).items()} if scrub else {}
        self.version, self.started_at, self.steps, self.over = HASH_VERSIONS[-1], now(), [], False
        self.journal = Path(folder, f"{self.run_id}.jsonl") if folder else None
        if self.journal:
            self.journal.parent.mkdir(parents=True, exist_ok=True)
        self.write({"kind": "meta", "formatVersion": 1, "id": self.run_id, "name": name, "currency": currency, "startedAt": self.started_at, "hashVersion": self.version})

    def write(self, line: dict) -> None:
        if self.journal:
            with self.journal.open("a", encoding="utf-8") as f:
                f.write(json.dumps(line, ensure_ascii=False) + "\n")

    def step(self, type: str, label: str, tool_name: str | None = None, tokens: float = 0, cost: float = 0, duration_ms: float = 0, started_at: str | None = None, **payload) -> dict:
        """payload: any of input, output and data_payload, as Python values; None is a present null."""
        if self.over:
            raise ValueError(f"recording {self.run_id} has ended")
        if type not in STEP_TYPES or set(payload) - set(JSON_NAMES) or min(tokens, cost, duration_ms) < 0:
            raise ValueError("not a step")
        at, values, log = now(), {JSON_NAMES[k]: parsed(json.dumps(v)) for k, v in payload.items()}, []
        for field, value in values.items():
            for path, leaf in list(leaves(value, field, 2)):
                if name := hit(leaf, self.found):
                    values[field] = replaced(values[field], split_path(path)[1], self.wire.redacted)
                    log.append({"path": path, "at": at, "reason": f"pattern:{name}", "by": "pattern"})
        salts = {p: os.urandom(16).hex() for f, v in values.items() for p, _ in leaves(v, f, 2)} if self.redactable else {}
        sealed = {p: commitment(salts[p], canonical_text(x)) for f, v in values.items() for p, x in leaves(v, f, 2)} if self.redactable else {}
        n, before = len(self.steps), self.steps[-1]["hash"] if self.steps else ""
        row = {c: canonical_text(values[j]) if j in values else None for c, j in JSON_NAMES.items()}
        row |= {"run_id": self.run_id, "id": f"{self.run_id}:{n}", "index": n, "type": type, "label": label, "tool_name": tool_name, "started_at": started_at or at, "duration_ms": duration_ms, "tokens": tokens, "cost": cost, "span_id": os.urandom(8).hex(), "parent_span_id": None, "commitments": sealed}
        record = {"id": row["id"], "runId": self.run_id, "index": n, "type": type, "label": label, "startedAt": row["started_at"], "durationMs": duration_ms, "tokens": tokens, "cost": cost, **({"toolName": tool_name} if tool_name is not None else {}), **values, "spanId": row["span_id"], "prevHash": before, "hash": link(step_text(row, self.version), before, self.version)}
        record |= ({"commitments": sealed, "salts": salts} if self.redactable else {}) | ({"redactions": log} if log else {})
        self.steps.append(record)
        self.write({"kind": "step", "step": record})
        return record

    def end(self, status: str | None = None) -> dict:
        """The sealed run as a record; status: completed or failed, by default failed if a step is an error."""
        if self.over or not self.steps:
            raise ValueError("nothing to end")
        status = status or ("failed" if any(s["type"] == "error" for s in self.steps) else "completed")
        if status not in STATUSES[:2]:
            raise ValueError(status)
        self.over = True
        self.write({"kind": "end", "status": status})
        totals = {k: 0.0 for k in ("tokens", "cost", "durationMs")}
        for s in self.steps:
            for k in totals:
                totals[k] += s[k]
        head = {"hashVersion": self.version, "id": self.run_id, "name": self.name, "startedAt": self.started_at, "endedAt": now(), "status": status, "currency": self.currency, "totals": {**totals, "steps": len(self.steps)}}
        import hashlib

        anchor = hashlib.sha256((RUN_TAG + canonical_text({**head, "stepCount": len(self.steps), "chainAnchor": self.steps[-1]["hash"]})).encode("utf-8", "surrogatepass")).hexdigest()
        run = {**head, "warnings": [], "steps": self.steps, "runHash": anchor}
        if self.keys:
            at = now()
            run["signature"] = {"algorithm": "ed25519", "keyId": key_id(self.keys[1]), "publicKey": self.keys[1], "signature": sign_text(self.keys[0], signed_text(self.run_id, anchor, at)), "signedAt": at}
        return run


def envelope(run: dict) -> dict:
    return {"formatVersion": 1, "exportedAt": now(), "run": run}


# ---- tool calls -------------------------------------------------------------------------------------------------


def reported(meta: Column, name: str, wire: Wire = Wire()) -> Column:
    """A number above or equal to 0 that a tool result's `_meta` (a map) reports, under a slashed or a dotted key."""
    found = [F.element_at(meta, f"{wire.namespace}{mark}{name}").try_cast("double") for mark in "/."]
    return F.coalesce(*[F.when((x >= 0) & (x < float("inf")), x) for x in found])


def tool_calls(calls, wire: Wire = Wire()):
    """Drafts of steps from rows (run_id, ord, tool, arguments, result, thrown, started_at, duration_ms), JSON text.

    A result that says it is an error, or a thrown one, gives an error step.
    """
    meta = F.from_json(F.get_json_object("result", "$._meta"), "map<string,string>")
    failed = F.col("thrown").isNotNull() | (F.coalesce(F.get_json_object("result", "$.isError"), F.lit("")) == "true")
    zero = F.lit(0.0)
    return calls.select(
        "run_id", "ord", F.when(failed, "error").otherwise("tool_call").alias("type"), F.concat(F.lit("Tool: "), "tool").alias("label"), F.col("tool").alias("tool_name"), "started_at", "duration_ms",
        F.coalesce(reported(meta, "tokens", wire), zero).alias("tokens"), F.coalesce(reported(meta, "cost", wire), zero).alias("cost"), F.col("arguments").alias("input"),
        F.coalesce(F.when(F.col("thrown").isNotNull(), F.to_json(F.struct(F.col("thrown").alias("error")))), F.col("result")).alias("output"), F.get_json_object("result", "$.structuredContent").alias("data_payload"),
    )


def reported_usage(result: object, wire: Wire) -> dict[str, float]:
    """tokens and cost, numbers above or equal to 0, that a result's `_meta` reports under a slashed or a dotted key."""
    meta = result.get("_meta") if isinstance(result, dict) else None
    out = {}
    for name in ("tokens", "cost"):
        for mark in "./":
            x = meta.get(f"{wire.namespace}{mark}{name}") if isinstance(meta, dict) else None
            if isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x < float("inf"):
                out[name] = x
    return out


class CallRecorder:
    """Records each tool call as a step, whether a client makes it or a handler serves it. recorder: one, or a function that makes one at the first step.

    A session without a call leaves nothing behind. usage: (tool, arguments, result) to {tokens, cost}, over what the result itself reports.
    A result that says it is an error, or a raised one, gives an error step; what was raised goes on to the caller.
    """

    def __init__(self, recorder: Recorder | Callable[[], Recorder], usage: Callable | None = None, wire: Wire = Wire()):
        self.made, self.usage, self.wire, self.over = recorder, usage, wire, False

    @property
    def recorder(self) -> Recorder:
        if self.over:
            raise ValueError("the recording has ended")
        if not isinstance(self.made, Recorder):
            self.made = self.made()
        return self.made

    def record(self, tool: str, arguments: dict | None = None, result: object = None, raised: BaseException | None = None, began: datetime | None = None) -> dict:
        """One call: arguments that aren't there count as none given; what a result holds as structured content is the step's data."""
        now_ = datetime.now(UTC)
        began = began or now_
        failed = raised is not None or isinstance(result, dict) and result.get("isError") is True
        more = {"output": result} if raised is None else {"output": {"error": str(raised), "name": type(raised).__name__}}
        if isinstance(result, dict) and result.get("structuredContent") is not None:
            more["data_payload"] = result["structuredContent"]
        more |= reported_usage(result, self.wire) | (self.usage(tool, arguments, result) or {} if self.usage and raised is None else {})
        at = began.isoformat(timespec="milliseconds").replace("+00:00", "Z")
        return self.recorder.step("error" if failed else "tool_call", f"Tool: {tool}", tool, started_at=at, duration_ms=float(round((now_ - began).total_seconds() * 1000)), input=arguments or {}, **more)

    def around(self, tool: str, arguments: dict | None, call: Callable):
        """What call() gives, recorded; if that is to be awaited, so is this."""
        began = datetime.now(UTC)

        async def awaited(coming):
            try:
                result = await coming
            except Exception as e:
                self.record(tool, arguments, raised=e, began=began)
                raise
            self.record(tool, arguments, result, began=began)
            return result

        try:
            result = call()
        except Exception as e:
            self.record(tool, arguments, raised=e, began=began)
            raise
        if inspect.isawaitable(result):
            return awaited(result)
        self.record(tool, arguments, result, began=began)
        return result

    def wrap(self, tool: str, call: Callable) -> Callable:
        """A function of keyword arguments, recorded."""
        return lambda **arguments: self.around(tool, arguments, lambda: call(**arguments))

    def handler(self, tool: str, handle: Callable) -> Callable:
        """A server's handler, recorded; its first argument, if it is a dict, holds the call's arguments."""
        return lambda *args, **more: self.around(tool, args[0] if args and isinstance(args[0], dict) else None, lambda: handle(*args, **more))

    def client(self, client: object, method: str = "call_tool") -> object:
        """A stand-in for a client whose method(tool, arguments, ...) is recorded; all else is the client's own."""
        return Recorded(client, method, self)

    def end(self, status: str | None = None) -> dict | None:
        """The sealed run; None if nothing was recorded."""
        if self.over:
            raise ValueError("the recording has ended")
        self.over = True
        return self.made.end(status) if isinstance(self.made, Recorder) and self.made.steps else None


class Recorded:
    def __init__(self, client: object, method: str, calls: CallRecorder):
        self._client, self._method, self._calls = client, method, calls

    def __getattr__(self, name: str):
        own = getattr(self._client, name)
        if name != self._method:
            return own
        return lambda tool, arguments=None, *args, **more: self._calls.around(tool, arguments, lambda: own(tool, arguments, *args, **more))


def snapshot(attrs: Column, wire: Wire = Wire()) -> Column:
    """A span's attributes that no column of the step holds, as the JSON payload {"attributes": {...}}; null without any."""
    own = [wire.attribute(n) for n in ("step.type", "step.label", "tool.name", "cost", "input", "output", "data_payload")] + ["gen_ai.tool.name", "gen_ai.prompt", "gen_ai.completion"]
    rest = F.filter(attrs, lambda a: ~a["key"].isin(*own))
    keys = F.array_distinct(F.transform(rest, lambda a: a["key"]))
    return F.when(F.size(keys) > 0, F.to_json(F.struct(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(rest, lambda a: a["key"] == k), -1)["value"]["stringValue"])).alias("attributes"))))


__all__ = ["CallRecorder", "Recorder", "attribute", "envelope", "reported", "snapshot", "tool_calls"]
