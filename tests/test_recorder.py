"""What the recorder writes verifies, and can be read back from its journal and its envelope."""

import json

import pytest
from pyspark.sql import functions as F

from stepforge.functions import crypto
from stepforge.operators import integrity
from stepforge.schema import Wire
from stepforge.sources import recorder, traces
from stepforge.sources.recorder import CallRecorder, Recorder


def test_recorded_run_verifies(spark, tmp_path):
    r = recorder.Recorder("demo", str(tmp_path / "journal"), "run-1", scrub=("email",), keys=crypto.keys())
    r.step("user_input", "ask", input={"q": "mail bob@corp.example", "n": [1, 2.5, None]})
    tools = recorder.CallRecorder(r, lambda tool, arguments, result: {"tokens": 3})
    assert tools.wrap("add", lambda a, b: {"sum": a + b})(a=1, b=2) == {"sum": 3}
    with pytest.raises(ZeroDivisionError):
        tools.wrap("div", lambda a: a / 0)(a=1)
    for bad in (lambda: r.step("nope", "x"), lambda: r.step("plan", "x", cost=-1), lambda: r.step("plan", "x", other=1)):
        with pytest.raises(ValueError):
            bad()
    run = r.end()
    with pytest.raises(ValueError):
        r.step("plan", "late")
    assert run["status"] == "failed" and run["totals"]["tokens"] == 3.0 and "[trace:redacted]" in json.dumps(run["steps"][0])
    (tmp_path / "run.json").write_text(json.dumps(recorder.envelope(run)))
    runs, steps, _ = traces.envelopes(traces.documents(spark, f"{tmp_path}/run.json"))
    found = integrity.verify_full(runs, steps).first()
    assert found["all_ok"] and found["signature_ok"] and found["failure"] is None
    recordings, journalled = traces.journals(traces.lines(spark, f"{tmp_path}/journal"))
    assert recordings.first()["ended"] == "failed"
    assert [x["hash"] for x in journalled.orderBy("pos").collect()] == [s["hash"] for s in run["steps"]]
    links = integrity.broken_links(journalled.withColumn("canonical", integrity.canonical_step(2)))
    assert links.first()["broken_index"] is None


def test_tool_calls_as_steps(spark):
    rows = [("r", 0, "db", '{"a":1}', '{"_meta":{"w/tokens":"7","w.cost":"-1"},"structuredContent":{"x":1}}', None), ("r", 1, "db", None, '{"isError":true}', None), ("r", 2, "db", None, None, "boom")]
    df = spark.createDataFrame([(*r, "2024-01-01T00:00:00.000Z", 1.0) for r in rows], "run_id string, ord int, tool string, arguments string, result string, thrown string, started_at string, duration_ms double")
    got = [(r["type"], r["tokens"], r["cost"], r["data_payload"]) for r in recorder.tool_calls(df, Wire("w")).orderBy("ord").collect()]
    assert got == [("tool_call", 7.0, 0.0, '{"x":1}'), ("error", 0.0, 0.0, None), ("error", 0.0, 0.0, None)]


def test_attribute_snapshot(spark):
    a = F.from_json(F.lit(json.dumps([{"key": "x.y", "value": {"stringValue": "1"}}, {"key": "trace.cost", "value": {"doubleValue": 1}}])), traces.ATTRIBUTES)
    row = spark.range(1).select(recorder.snapshot(a).alias("s"), recorder.snapshot(F.array().cast(traces.ATTRIBUTES)).alias("n")).first()
    assert json.loads(row["s"]) == {"attributes": {"x.y": "1"}} and row["n"] is None


def test_clients_and_handlers_are_recorded(tmp_path):
    import asyncio

    class Client:
        secret = 7

        def call_tool(self, tool, arguments=None, timeout=None):
            if tool == "broken":
                raise KeyError("no such row")
            return {"content": [tool, arguments, timeout], "structuredContent": {"rows": 2}, "_meta": {"trace/tokens": 12, "trace.cost": 0.5, "trace/cost": -1}}

        async def later(self, tool, arguments=None):
            if tool == "broken":
                raise ValueError("lost")
            return {"isError": True}

    calls = CallRecorder(lambda: Recorder("calls", str(tmp_path / "j"), "c1"), usage=lambda tool, arguments, result: {"cost": 2} if tool == "dear" else None)
    client = calls.client(Client())
    assert client.secret == 7 and not (tmp_path / "j").exists()
    assert client.call_tool("db", {"id": 1}, timeout=3)["content"] == ["db", {"id": 1}, 3]
    client.call_tool("dear")
    with pytest.raises(KeyError):
        client.call_tool("broken", {"id": 2})
    slow = calls.client(Client(), "later")
    assert asyncio.run(slow.later("soft")) == {"isError": True}
    with pytest.raises(ValueError):
        asyncio.run(slow.later("broken"))
    assert calls.handler("served", lambda arguments, context: arguments["x"] + 1)({"x": 1}, "ctx") == 2

    async def serve(x):
        return x

    assert asyncio.run(calls.handler("listed", serve)([1])) == [1]
    run = calls.end()
    got = [(s["type"], s["toolName"], s["input"], s["tokens"], s["cost"]) for s in run["steps"]]
    assert got == [("tool_call", "db", {"id": 1}, 12, 0.5), ("tool_call", "dear", {}, 12, 2), ("error", "broken", {"id": 2}, 0, 0), ("error", "soft", {}, 0, 0), ("error", "broken", {}, 0, 0), ("tool_call", "served", {"x": 1}, 0, 0), ("tool_call", "listed", {}, 0, 0)]
    assert run["steps"][0]["dataPayload"] == {"rows": 2} and run["steps"][2]["output"] == {"error": "'no such row'", "name": "KeyError"} and run["status"] == "failed"
    for act in (calls.end, lambda: client.call_tool("db")):
        with pytest.raises(ValueError):
            act()
    assert CallRecorder(lambda: Recorder("none", str(tmp_path / "k"), "c2")).end() is None and not (tmp_path / "k").exists()
