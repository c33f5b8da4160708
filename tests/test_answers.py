"""Requests answered from a store, as an endpoint would."""

import json

from pyspark.sql import functions as F

from stepforge.functions import second
from stepforge.operators import answers, policy, sweep
from stepforge.operators.store import Store

STEP = "run_id string, type string, label string, tool_name string, started_at string, duration_ms double, tokens double, cost double, input string, output string, data_payload string, span_id string, parent_span_id string, pos long, index long, id string"


def step(run, i, kind="tool_call", tool="db", text=None):
    return (run, kind, f"step {i}", tool, f"2024-01-01T00:00:0{i}.000Z", 1.0, 1.0, 1.0, text, None, None, f"s{i}", None, i, i, f"{run}:{i}")


def ask(spark, store, urls, **more):
    rows = spark.createDataFrame([(i, *(u if isinstance(u, tuple) else ("GET", u))) for i, u in enumerate(urls)], "request int, method string, url string")
    replies, lines = answers.answers(rows, store.table("runs"), store.table("steps"), **more)
    bodies = {}
    for r in lines.collect():
        bodies.setdefault(r.answer, {})[r.ord] = json.loads(r.body)
    assert all(sorted(x) == list(range(len(x))) for x in bodies.values())
    return [(r.status, [bodies.get(r.answer, {})[k] for k in sorted(bodies.get(r.answer, {}))]) for r in sorted(replies.collect(), key=lambda r: r.request)]


def test_requests_are_answered(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    heads = "run_id string, name string, currency string, declared string"
    loop = [step("loop", i, text='{"q":4471}' if i % 2 else '{ "q": 4471 }') for i in range(3)]
    sweep.sweep(store, spark.createDataFrame([("loop", "looping", "USD", None)], heads), spark.createDataFrame(loop, STEP), "2024-01-01T00:00:00")
    sweep.sweep(store, spark.createDataFrame([("a b", "clean", "USD", None)], heads), spark.createDataFrame([step("a b", 0, text='{"x":"Émile 4471"}'), step("a b", 1, "plan", None)], STEP), "2024-01-02T00:00:00")
    live = spark.createDataFrame([("now", "going", "2024-01-03T00:00:00.000Z", 4, None), ("loop", "looping", "x", 1, None), ("over", "n", "x", 1, "completed")], "run_id string, name string, started_at string, steps long, ended string").withColumn("modified", F.lit("2024-01-03").cast("timestamp"))
    urls = ["/api/runs", "/api/runs/loop", "/%61pi/runs/a%20b", "/api/runs/loop/verify", "/api/search?q=4471", "/api/search?limit=1&q=4471", "/api/search?q=%C3%A9MILE", "/api/search", "/api/search?q=", "/api/live", "/api/live/now", "/api/live/loop", "/api/live/over", "/api/runs/nobody", "/api/nothing", "/other", ("POST", "/api/fleet"), "/api/fleet", "/api/fleet/x", "/api/runs"]
    got = ask(spark, store, urls, live=live)
    status = [x[0] for x in got]
    assert status == [200] * 7 + [400, 400, 200, 200, 200] + [404] * 5 + [200, 404, 200]
    body = dict(zip([u if isinstance(u, str) else u[1] + "!" for u in urls], [x[1] for x in got], strict=True))
    assert [r["id"] for r in body["/api/runs"]] == ["a b", "loop"]
    assert [len(b[0]["steps"]) for b in (body["/api/runs/loop"], body["/%61pi/runs/a%20b"])] == [3, 2]
    assert second.verdicts(json.dumps(body["/api/runs/loop"][0]))["ok"] and body["/api/runs/loop/verify"][0]["ok"] is True
    assert [(h["runId"], h["stepIndex"], h["field"]) for h in body["/api/search?q=4471"]] == [("a b", 0, "input"), ("loop", 0, "input"), ("loop", 1, "input"), ("loop", 2, "input")]
    assert len(body["/api/search?limit=1&q=4471"]) == 1 and "Émile" in body["/api/search?q=%C3%A9MILE"][0]["snippet"]
    assert [r["runId"] for r in body["/api/live"]] == ["now"] and body["/api/live/now"][0]["live"] is True and "runHash" in body["/api/live/loop"][0]
    rows = {r["id"]: r for r in body["/api/fleet"]}
    assert rows["loop"]["warnings"]["loop"] == 1 and "loop" in rows["loop"]["issues"] and rows["a b"]["chainOk"] and "policyOk" not in rows["a b"]
    ((_, scored),) = ask(spark, store, ["/api/fleet"], rules=policy.Policy(forbidWarnings=("loop",)))
    assert {r["id"]: r["policyOk"] for r in scored} == {"loop": False, "a b": True}
    assert ask(spark, store, []) == []
