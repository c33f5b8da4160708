"""Runs as they come: stateful operators over journals that grow and over spans.

A run's state is what the next step needs: the last hash, the open row of equal calls, sums, and which warnings were told. The
steps themselves aren't kept, but for the costs above 0, of which the median is exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.analyze import MESSAGES, fixed
from ..operators.integrity import link, step_text
from ..schema import HIGH_COST, JSON_NAMES, LOOP_LENGTH, STEP_TYPES
from ..sources.growing import growing_lines
from .live import call_of

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that the runs of a stream are dealt into: a group's rows of one trigger are in memory together, and what a group costs is shared by its runs. A checkpoint's state is for one number.
BUCKETS = 512
#: Entries of a part of a run's log, and rows that are given out at once.
PART, ROWS = 1000, 10_000
TOLD = "kind string, message string, step_ids array<string>"


@dataclass
class Watch:
    """Warnings of a run as its steps come: a loop each time it has grown, a costly step and an error once."""

    call: str | None = None
    first: int = 0
    length: int = 0
    closed: list[tuple[str, int, int]] = field(default_factory=list)

    def step(self, index: int, kind: str, tool: object, text: object) -> None:
        same = call_of(tool, text) if kind == "tool_call" else None
        if same is not None and same == self.call:
            self.length += 1
            return
        self.close()
        self.call, self.first, self.length = same, index, 1

    def close(self) -> None:
        if self.call is not None and self.length >= LOOP_LENGTH:
            self.closed.append((self.call.split("\0")[0], self.first, self.length))

    def loops(self) -> list[tuple[str, int, int]]:
        """(tool, first index, length) of the loops that ended or grew since the last call."""
        self.close()
        out, self.closed = self.closed, []
        return out


def warned(run_id: str, loops: list[tuple[str, int, int]], costs: list[tuple[int, str, float]], errors: list[tuple[int, str]], told: set[int] = frozenset()) -> list[tuple[str, str, list[str]]]:
    """(kind, message, step ids) in the order of a finished run's warnings. costs: all those above 0; told: costly steps that are left out."""
    middle = median(c for *_, c in costs) if costs else 0.0
    out = [("loop", MESSAGES["loop"] % (tool, n), [f"{run_id}:{i}" for i in range(first, first + n)]) for tool, first, n in loops]
    out += [("high_cost_step", MESSAGES["high_cost_step"] % (i, label, fixed(c), fixed(middle)), [f"{run_id}:{i}"]) for i, label, c in costs if middle > 0 and c > HIGH_COST * middle and i not in told]
    return out + [("error", MESSAGES["error"] % x, [f"{run_id}:{x[0]}"]) for x in errors]


class Kept:
    """The state of the runs of a bucket, a text for each: what the next step needs, the loop told last, and the end of a log of costs and of costly steps that were told.

    The log only grows; its full parts are texts of their own, so that a long run's aren't written again. One call reads a run and one writes it.
    """

    def __init__(self, handle: StatefulProcessorHandle, ttl: int | None = None):
        self.runs = handle.getMapState("runs", "key string", "text string", ttl)
        self.parts = handle.getMapState("parts", "key string", "text string", ttl)

    def get(self, key: str, fresh: list) -> list:
        """The run's values as they were put; from here on, told() and put() are about this run."""
        held = self.runs.getValue((key,))
        self.key, (self.full, self.loop, self.log, out) = key, json.loads(held[0]) if held else (0, None, [], fresh)
        return out

    def put(self, values: list) -> None:
        while len(self.log) >= PART:
            self.parts.updateValue((f"{self.full} {self.key}",), (json.dumps(self.log[:PART]),))
            self.full, self.log = self.full + 1, self.log[PART:]
        self.runs.updateValue((self.key,), (json.dumps((self.full, self.loop, self.log, values)),))

    def clear(self) -> None:
        for k in range(self.full):
            self.parts.removeKey((f"{k} {self.key}",))
        self.full, self.loop, self.log = 0, None, []

    def untold(self, run_id: str, watch: Watch, new: list[tuple[int, str, float]], errors: list[tuple[int, str]]) -> list[tuple[str, str, list[str]]]:
        """warned() of what has come, each once. A loop comes again only from where the last one began; of errors no one needs to ask: each step comes once."""
        loops = [x for x in watch.loops() if list(x[1:]) != self.loop]
        if loops:
            self.loop = list(loops[-1][1:])
        before = []
        if new:
            texts = [self.parts.getValue((f"{k} {self.key}",)) for k in range(self.full)]
            before = [x for t in texts if t for x in json.loads(t[0])] + self.log
        out = warned(run_id, loops, [tuple(x) for x in before if len(x) == 3] + new, errors, {x[0] for x in before if len(x) == 1})
        self.log += new + [(int(ids[0].rpartition(":")[2]),) for kind, _, ids in out if kind == "high_cost_step"]
        return out


def stateful(spark: SparkSession) -> None:
    """Such state lives in RocksDB, beside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


# ---- journals ---------------------------------------------------------------------------------------------------

TOLD_EVENT = "file string, run_id string, event string, index long, type string, label string, cost double, tokens double, kind string, message string, step_ids array<string>, status string"


class Follower(StatefulProcessor):
    """Events of journals: step, warning, broken (the first step whose hash or predecessor is wrong, or a line that isn't one), ended, gone (with its file)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = Kept(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        return frames((self.told(file, lines) for file, lines in grouped(rows, "file", "start")), TOLD_EVENT)

    def told(self, file: str, lines: list[dict]) -> list[dict]:
        run_id, version, n, before, broken, call, first, length = self.kept.get(file, [None, 2, 0, "", False, None, 0, 0])
        watch, out, errors, new = Watch(call, first, length), [], [], []
        say = lambda event, **more: out.append({"file": file, "run_id": run_id, "event": event, **more})
        for raw in (x["raw"] for x in lines):
            if raw is None:
                say("gone")
                run_id, version, n, before, broken, watch = None, 2, 0, "", False, Watch()
                self.kept.clear()
                continue
            if not raw.strip():
                continue
            try:
                line = json.loads(raw)
                kind = line["kind"]
                if kind == "meta":
                    run_id, version = line["id"], line.get("hashVersion") or 1
                elif kind == "end":
                    say("ended", status=line["status"])
                elif kind == "step":
                    s = line["step"]
                    row = {c: json.dumps(s[j]) if j in s else None for c, j in JSON_NAMES.items()}
                    row |= {"id": s["id"], "index": s["index"], "type": s["type"], "label": s["label"], "tool_name": s.get("toolName"), "started_at": s["startedAt"], "duration_ms": s["durationMs"], "tokens": s["tokens"], "cost": s["cost"], "span_id": s["spanId"], "parent_span_id": s.get("parentSpanId"), "run_id": s["runId"], "commitments": s.get("commitments")}
                    if not broken and (s["prevHash"] != before or s["hash"] != link(step_text(row, version) or "", before, version)):
                        broken = True
                        say("broken", index=n)
                    before = s["hash"]
                    say("step", index=n, type=s["type"], label=s["label"], cost=float(s["cost"]), tokens=float(s["tokens"]))
                    watch.step(n, s["type"], s.get("toolName"), row["input"])
                    if s["type"] == "error":
                        errors.append((n, s["label"]))
                    if s["cost"] > 0:
                        new.append((n, s["label"], float(s["cost"])))
                    n += 1
            except (ValueError, KeyError, TypeError, AttributeError):
                if not broken:
                    broken = True
                    say("broken", index=n)
        for kind, message, ids in self.kept.untold(run_id, watch, new, errors):
            say("warning", kind=kind, message=message, step_ids=ids)
        self.kept.put([run_id, version, n, before, broken, watch.call, watch.first, watch.length])
        return out

    def close(self) -> None:
        pass


def frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows with the columns of a schema, absent ones null; whole numbers stay whole."""
    kinds = dict(x.split(" ", 1) for x in schema.split(", "))
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype={"long": "Int64", "double": "Float64"}.get(k, object)) for c, k in kinds.items()})


def grouped(rows: Iterator[pd.DataFrame], key: str, order: str) -> Iterator[tuple[str, list[dict]]]:
    """(key, its rows in order) for each key of a bucket; what is missing is None."""
    table = pd.concat(list(rows), ignore_index=True).sort_values([key, order], kind="stable")
    held = table.astype(object).where(table.notna(), None).to_dict("records")
    return ((k, list(g)) for k, g in groupby(held, key=lambda r: r[key]))


def frames(made: Iterator[list[dict]], schema: str) -> Iterator[pd.DataFrame]:
    """frame() of what many runs give, some thousand rows at a time: a frame costs milliseconds, however small it is."""
    held: list[dict] = []
    for rows in made:
        held += rows
        if len(held) >= ROWS:
            yield frame(held, schema)
            held = []
    if held:
        yield frame(held, schema)


def in_buckets(df: DataFrame, key: str, buckets: int):
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).groupBy("bucket")


def followed(spark: SparkSession, folder: str, pattern: str = "*.jsonl", buckets: int = BUCKETS) -> DataFrame:
    """A stream of TOLD_EVENT from the journals in a folder: each step once and each warning once, whatever restarts come between."""
    stateful(spark)
    return in_buckets(growing_lines(spark, folder, pattern), "file", buckets).transformWithStateInPandas(Follower(), TOLD_EVENT, "Append", "None")


# ---- spans ------------------------------------------------------------------------------------------------------

SPAN = "trace_id string, span_id string, parent_span_id string, ord long, type string, label string, tool_name string, started_at string, duration_ms double, cost double, tokens double, input string, output string, data_payload string"
WRITTEN = "trace_id string, run_id string, name string, event string, index long, id string, type string, label string, tool_name string, started_at string, duration_ms double, cost double, tokens double, input string, output string, data_payload string, span_id string, parent_span_id string, prev_hash string, hash string, kind string, message string, step_ids array<string>, status string, steps long"


class Writer(StatefulProcessor):
    """Spans of one trace as a run: steps chained as they come, warnings, and the run's end with its sums."""

    def __init__(self, prefix: str, finalize_on_root: bool, ttl_ms: int, version: int = 2):
        self.prefix, self.finalize_on_root, self.ttl_ms, self.version = prefix, finalize_on_root, ttl_ms, version

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = Kept(handle, self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        return frames((self.written(trace, spans) for trace, spans in grouped(rows, "trace_id", "ord")), WRITTEN)

    def written(self, trace: str, spans: list[dict]) -> list[dict]:
        fresh = (0, "", 0.0, 0.0, 0.0, False, None, 0, 0)
        generation, n, before, tokens, cost, ms, failed, call, first, length = self.kept.get(trace, [1, *fresh])
        watch, out, errors, new = Watch(call, first, length), [], [], []

        def tell(run_id: str, name: str | None) -> None:
            for kind, message, ids in self.kept.untold(run_id, watch, new, errors):
                out.append({"trace_id": trace, "run_id": run_id, "name": name, "event": "warning", "kind": kind, "message": message, "step_ids": ids})
            new.clear(), errors.clear()

        for r in spans:
            base = r.get("run_id") or self.prefix + trace
            run_id, name = base + (f"-{generation}" if generation > 1 else ""), r.get("name")
            step = {c: r[c] for c in ("type", "label", "tool_name", "started_at", "span_id", "input", "output", "data_payload")}
            step |= {"run_id": run_id, "index": n, "id": f"{run_id}:{n}", "parent_span_id": r["parent_span_id"] or None, **{c: float(r[c] or 0) for c in ("duration_ms", "cost", "tokens")}, "commitments": None}
            text = step_text(step, self.version) if r["type"] in STEP_TYPES else None
            if text is None:  # told rather than thrown, so that one bad span doesn't end the stream
                out.append({"trace_id": trace, "run_id": run_id, "event": "fault", "span_id": r["span_id"], "message": "no such step type" if r["type"] not in STEP_TYPES else "a payload isn't JSON"})
            else:
                step |= {"prev_hash": before, "hash": link(text, before, self.version)}
                before = step["hash"]
                out.append({"trace_id": trace, "name": name, "event": "step", **step})
                watch.step(n, r["type"], r["tool_name"], r["input"])
                errors += [(n, r["label"])] if r["type"] == "error" else []
                new += [(n, r["label"], step["cost"])] if step["cost"] > 0 else []
                n, tokens, cost, ms, failed = n + 1, tokens + step["tokens"], cost + step["cost"], ms + step["duration_ms"], failed or r["type"] == "error"
            if self.finalize_on_root and not r["parent_span_id"] and n:
                tell(run_id, name)
                out.append({"trace_id": trace, "run_id": run_id, "name": name, "event": "run", "status": "failed" if failed else "completed", "steps": n, "tokens": tokens, "cost": cost, "duration_ms": ms, "hash": before})
                generation, (n, before, tokens, cost, ms, failed, *_), watch = generation + 1, fresh, Watch()
                self.kept.clear()
        if n:
            tell(run_id, name)
        self.kept.put([generation, n, before, tokens, cost, ms, failed, watch.call, watch.first, watch.length])
        return out

    def close(self) -> None:
        pass


def written_runs(spans: DataFrame, run_id: Column | None = None, name: Column | None = None, keep: Column | None = None, prefix: str = "otel-", finalize_on_root: bool = True, ttl_ms: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """A stream of WRITTEN from a stream of SPAN: `step` rows, chained as they come; `warning`, each once; `run`, when its root span ends it; `fault`.

    A trigger's spans of a trace are put in order of `ord`; across triggers, arrival is the order. What comes after a root opens a
    continuation, `<run>-2` and so on. run_id, name, keep: columns over a span's that name its run, give the run a name, and choose which spans count; a
    fault is a span that can't be a step, and the run goes on without it. A trace that is silent for ttl_ms is forgotten, and then begins
    anew; 0 remembers it for ever. A sink takes `run` and `fault` rows where another system would call back.
    """
    stateful(spans.sparkSession)
    none = F.lit(None).cast("string")
    some = spans.where(keep) if keep is not None else spans
    keyed = some.withColumns({"run_id": run_id if run_id is not None else none, "name": name if name is not None else none})
    return in_buckets(keyed, "trace_id", buckets).transformWithStateInPandas(Writer(prefix, finalize_on_root, ttl_ms), WRITTEN, "Append", "ProcessingTime" if ttl_ms else "None")
