"""Streams: journals that grow, and runs written span by span."""

import json
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepforge.operators import analyze, integrity
from stepforge.sources import growing, traces
from stepforge.sources.recorder import Recorder
from stepforge.streaming import stateful


def drained(make, at):
    """Rows that a stream gives until it has read all there is; it goes on from its checkpoint."""
    out = []
    query = make().writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(df.collect())).start()
    assert query.awaitTermination(90)
    return out


def test_lines_come_once_when_they_are_whole(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    read = lambda: sorted((r.file.split("/")[-1], r.start, r.raw) for r in drained(lambda: growing.growing_lines(spark, str(folder), split=7), tmp_path))
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_bytes("one\ntwo è\nhal".encode())
    (folder / "other.txt").write_text("no\n")
    assert read() == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two è")]
    assert read() == []
    with a.open("ab") as f:
        f.write(b"f\n\n" + b"x" * 100 + b"\nrest")
    b.write_text("first\n")
    assert read() == [("a.jsonl", 11, "half"), ("a.jsonl", 16, ""), ("a.jsonl", 17, "x" * 100), ("b.jsonl", 0, "first")]
    b.write_text("new\n")  # shorter: replaced
    assert read() == [("b.jsonl", 0, "new")]
    b.unlink()
    assert read() == [("b.jsonl", -1, None)]


def test_the_end_of_the_last_line_is_found_in_long_files(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "BLOCK", 4)
    store, p = growing.opened(str(tmp_path / "x"))
    for data, end in ((b"", 0), (b"abcdefghij", 0), (b"ab\ncdefghijkl", 3), (b"\n", 1), (b"abcdefghijk\n", 12)):
        (tmp_path / "x").write_bytes(data)
        assert growing.last_line_end(store, p, 0, len(data)) == end


def test_followed_journals_tell_steps_and_warnings_once(spark, tmp_path):
    folder = tmp_path / "j"
    r = Recorder("followed", str(folder), "f1")
    call = lambda: r.step("tool_call", "Tool: db", "db", cost=1.0, input={"q": 1})
    read = lambda: [(e.event, e["index"], e.kind) for e in drained(lambda: stateful.followed(spark, str(folder)), tmp_path)]
    call()
    assert read() == [("step", 0, None)]
    assert read() == []
    call(), call(), r.step("error", "broke")
    assert read() == [("step", 1, None), ("step", 2, None), ("step", 3, None), ("warning", None, "loop"), ("warning", None, "error")]
    r.step("plan", "p", cost=50.0)
    assert read() == [("step", 4, None), ("warning", None, "high_cost_step")]
    path = folder / "f1.jsonl"
    with path.open("a") as f:  # a step that was never chained, half of it first
        line = json.dumps({"kind": "step", "step": r.steps[-1] | {"label": "forged"}}) + "\n"
        f.write(line[:30])
    assert read() == []
    with path.open("a") as f:
        f.write(line[30:] + '{"kind":"end","status":"failed"}\n')
    assert read() == [("broken", 5, None), ("step", 5, None), ("ended", None, None), ("warning", None, "high_cost_step")]
    path.rename(tmp_path / "elsewhere")
    assert read() == [("gone", None, None)]
    (tmp_path / "elsewhere").rename(path)
    assert [x[0] for x in read()] == ["step"] * 5 + ["broken", "step", "ended"] + ["warning"] * 4
    whole = analyze.warnings(traces.journals(traces.lines(spark, str(folder)))[1]).where("kind = 'loop'").first()
    assert whole.message.startswith('Tool "db" was called 3x in a row')


def span(trace, i, parent, ord, kind="plan", tool=None, cost=0.0, text=None, at="2024-01-01T00:00:00.000Z"):
    return (trace, f"{trace}{i}", parent, ord, kind, f"step {i}", tool, at, 2.0, cost, 1.0, text, None, None)


def written(spark, tmp_path, frames, **more):
    out = []
    for rows in frames:
        spark.createDataFrame(rows, stateful.SPAN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out.append(drained(lambda: stateful.written_runs(spark.readStream.schema(stateful.SPAN).parquet(f"{tmp_path}/in"), **more), tmp_path))
    return out


def test_written_steps_are_chained_as_a_batch_chains_them(spark, tmp_path):
    frames = [[span("x", 1, "x9", 1, "tool_call", "db", 1.0, '{"b":1,"a":[2]}'), span("x", 2, "x9", 0, "tool_call", "db", 1.0, '{"a":[2.0],"b":1}'), span("y", 1, "y9", 2)], [span("x", 3, "x9", 3, "tool_call", "db", 1.0, '{ "a":[2],"b":1 }'), span("x", 9, None, 4, "error", cost=30.0)], [span("x", 4, "x9", 5), span("y", 2, "y9", 6, text="{bad"), span("y", 3, "y9", 7, kind="nonsense"), span("y", 9, "", 8)]]
    out = [r for b in written(spark, tmp_path, frames) for r in b]
    steps = sorted((r.run_id, r["index"], r.span_id) for r in out if r.event == "step")
    assert steps == [("otel-x", 0, "x2"), ("otel-x", 1, "x1"), ("otel-x", 2, "x3"), ("otel-x", 3, "x9"), ("otel-x-2", 0, "x4"), ("otel-y", 0, "y1"), ("otel-y", 1, "y9")]
    told = [(r.run_id, r.kind, r.message) for r in out if r.event == "warning"]
    assert [x[:2] for x in told] == [("otel-x", "loop"), ("otel-x", "high_cost_step"), ("otel-x", "error")] and told[1][2] == "Step #3 (step 9) cost 30.00 — over 3x the median step cost (1.00)."
    assert sorted((r.run_id, r.status, r.steps, r.cost) for r in out if r.event == "run") == [("otel-x", "failed", 4, 33.0), ("otel-y", "completed", 2, 0.0)]
    assert sorted((r.span_id, r.message) for r in out if r.event == "fault") == [("y2", "a payload isn't JSON"), ("y3", "no such step type")]
    rows = spark.createDataFrame([r for r in out if r.event == "step"], stateful.WRITTEN).withColumns({"pos": F.col("index"), "commitments": F.lit(None).cast("map<string,string>")})
    chained = integrity.chain(rows.withColumn("canonical", integrity.canonical_step(2)))
    assert sorted((r.run_id, r.pos, r.prev_hash, r.hash) for r in chained.collect()) == sorted((r.run_id, r["index"], r.prev_hash, r.hash) for r in out if r.event == "step")
    last = {r.run_id: r.hash for r in out if r.event == "run"}
    assert {r.run_id: r.anchor for r in integrity.anchors(chained).collect() if r.run_id in last} == last


def test_hooks_name_and_choose(spark, tmp_path):
    frames = [[span("x", 1, "x9", 1), span("x", 2, "x9", 2, "approval"), span("x", 9, None, 3)]]
    (out,) = written(spark, tmp_path, frames, run_id=F.concat(F.lit("mine-"), "trace_id"), name=F.upper("trace_id"), keep=F.col("type") != "approval")
    assert [(r.run_id, r.name, r.event, r.span_id) for r in out] == [("mine-x", "X", "step", "x1"), ("mine-x", "X", "step", "x9"), ("mine-x", "X", "run", None)]


def test_silent_traces_are_forgotten(spark, tmp_path):
    stream = lambda: stateful.written_runs(spark.readStream.schema(stateful.SPAN).parquet(f"{tmp_path}/in"), ttl_ms=1500)
    out = []
    spark.createDataFrame([span("x", 1, "x9", 1)], stateful.SPAN).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = stream().writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").foreachBatch(lambda df, n: out.extend(df.collect())).start()
    try:
        def wait(n):
            until = time.time() + 60
            while len(out) < n and time.time() < until:
                time.sleep(0.1)
            assert len(out) == n

        wait(1)
        time.sleep(4)
        spark.createDataFrame([span("x", 2, "x9", 2)], stateful.SPAN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        wait(2)
        assert [(r["index"], r.prev_hash) for r in out] == [(0, ""), (0, "")]
    finally:
        query.stop()


@pytest.mark.parametrize("calls, want", [(["a", "a"], []), (["a"] * 3, [("t", 0, 3)]), (["a"] * 3 + ["b"] * 4, [("t", 0, 3), ("t", 3, 4)])])
def test_watch(calls, want):
    watch = stateful.Watch()
    for i, x in enumerate(calls):
        watch.step(i, "tool_call", "t", f'"{x}"')
    assert watch.loops() == want


class Maps:
    """A handle whose map states are dicts; calls counts what is asked of them."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def getMapState(self, name, *_):  # noqa: N802
        held, said = self.held.setdefault(name, {}), lambda x: setattr(self, "calls", self.calls + 1) or x
        return SimpleNamespace(getValue=lambda k: said(held.get(k)), updateValue=lambda k, v: said(held.update({k: v})), removeKey=lambda k: said(held.pop(k, None)))


def fed(writer, spans):
    table = pd.DataFrame(spans, columns=[c.split()[0] for c in stateful.SPAN.split(", ")])
    return list(writer.handleInputRows((0,), iter([table[::2], table[1::2]]), None))


def test_runs_of_a_bucket_share_frames_and_ask_for_state_twice():
    maps, writer = Maps(), stateful.Writer("", True, 0)
    writer.init(maps)
    for at in range(2):
        found = fed(writer, [span(f"t{t}", i, "p", i, "tool_call", "db", 1.0, '"a"') for t in range(500) for i in range(at * 2, at * 2 + 2)])
        assert len(found) == 1 and maps.calls == 1000 * (at + 1)
        assert sorted(found[0]["event"].tolist()) == ["step"] * 1000 + ["warning"] * 500 * at


def test_costly_steps_are_told_once_from_a_log_in_parts(monkeypatch):
    out = []
    for part in (3, 1000):
        monkeypatch.setattr(stateful, "PART", part)
        maps, writer, told = Maps(), stateful.Writer("", True, 0), []
        writer.init(maps)
        for i, cost in enumerate([50.0, 1.0, 1.0, 1.0, 20.0, 1.0, 0.0, 2.0, 30.0]):
            told += [(i, x) for f in fed(writer, [span("t", i, "p", i, cost=cost)]) for x in f["message"].dropna()]
        assert [(i, x.split(" (")[0]) for i, x in told] == [(2, "Step #0"), (4, "Step #4"), (8, "Step #8")]
        assert len(maps.held["parts"]) == (3 if part == 3 else 0)
        out.append(told)
        fed(writer, [span("t", 99, None, 99)])
        assert not maps.held["parts"]
    assert out[0] == out[1]
