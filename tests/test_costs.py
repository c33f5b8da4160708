"""What keeps a query's time and memory in step with its input."""

import json

from pyspark.sql import functions as F

from stepforge.functions import canonical, crypto, second
from stepforge.functions.text import trimmed
from stepforge.operators import analyze, answers, diff, integrity, proofs, redact
from stepforge.plans import evidence, sources
from stepforge.schema import RUN_SCHEMA, STEP_SCHEMA
from stepforge.shared import without_null_lists, written
from stepforge.sources import anchor_sink, growing, traces


def counted(monkeypatch, module, name):
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a: calls.append(1) or real(*a))
    return calls


def test_a_key_that_is_known_takes_few_sums(monkeypatch):
    private, public = crypto.keys()
    mark = crypto.sign_text(private, "x")
    for module, name, check, most in ((crypto, "add", crypto.verify_text, 170), (second, "plus", second.signed_by, 330)):
        assert check(public, "x", mark) and not check(public, "y", mark)
        calls = counted(monkeypatch, module, name)
        assert check(public, "x", mark)
        assert 0 < len(calls) < most, module.__name__


def test_sealed_runs_are_read_not_made_again(spark, sf):
    for made in (evidence.sealed, evidence.redacted_runs):
        for df in made(spark, sf):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "Arrow" not in plan and "Aggregate" not in plan


def test_many_small_files_share_tasks_and_have_short_offsets(tmp_path):
    for i in range(1000):
        (tmp_path / f"{i}.jsonl").write_text("x\n")
    reader = growing.Reader(str(tmp_path), "*.jsonl", growing.SPLIT)
    end = reader.latestOffset()
    packs = reader.partitions({}, end)
    assert len(packs) == 4 and len(str(end)) < 20 * 1000
    assert sorted((b.column(0)[0].as_py(), b.column(2)[0].as_py()) for p in packs for b in reader.read(p)) == sorted((f"{tmp_path}/{i}.jsonl", "x") for i in range(1000))
    before = {f"{tmp_path}/{i}.jsonl": 2 for i in range(999)}  # an offset of an older checkpoint
    assert [p.file for x in reader.partitions(before, end) for p in x.pieces] == [f"{tmp_path}/999.jsonl"]


def test_requests_without_a_run_are_dealt_apart(spark, sf):
    out = evidence.request_answers(spark, sf)
    assert "xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()


def test_warnings_are_compared_once(spark):
    pairs = spark.createDataFrame([("p", "a", "b")], "pair string, a_run string, b_run string")
    steps = spark.createDataFrame([("a", 0, "a0"), ("b", 0, "b0"), ("b", 1, "b1")], "run_id string, pos long, id string")
    aligned = spark.createDataFrame([("p", 0, 0)], "pair string, a_pos long, b_pos long")
    found = spark.createDataFrame([("a", 0, "error", ["a0"]), ("a", 1, "error", ["a0"]), ("a", 2, "loop", ["a9"]), ("b", 0, "error", ["b0"]), ("b", 1, "error", ["b1"]), ("b", 2, "error", ["b1"])], "run_id string, ord int, kind string, step_ids array<string>")
    out = diff.warning_differences(pairs, aligned, steps, found)
    assert sorted((r.state, r.kind, r.signature) for r in out.collect()) == [("appeared", "error", "b1"), ("cleared", "loop", "?a9"), ("persisted", "error", "b0"), ("persisted", "error", "b0")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FullOuter") == 1 and "LeftSemi" not in plan


def test_step_texts_and_chains_take_no_python_where_they_are_plain(spark):
    odd = [None, "a", "", 'q"', "b\\", "\x00", "\x1f", "\x7f", "é", "\u2028", "😀", "\n"]
    payloads = [None, "", "x", "null", "true", "0", "-0", "-1", "01", "1.5", "1e3", "9" * 15, "9" * 16, '"s"', '"\\u00e9"', '"é"', "{}", "{ }", "[]", "[1]", '{"k": 76}', '{"b":1,"a":"x"}', '{"a":1,"a":2}', '{"10":1,"9":2}', '{"x": -0}', '{"x": 1.0}', '{"é":"ü", "z":null,"y" : true}', '{"a":NaN}', "{'a':1}", '{"a":1} x', '{"a":1,}', '{"😀":1,"\ufb01":2,"\x7f":"/"}', '{"a":"}"}', '{"a":"x', '{"a":{"b":1}}', "{a:1}", '{"a":01}', '{"a":+1}', ' {"a":1} ', '{"a":tru}', '{"a":"1.5"}', '{"a":1 "b":2}', '{"":1}', '{"a":/*x*/1}', '{"a":" 5e"}', '{"A":1,"a":2,"Z":3,"_":4}']
    numbers = [None, float("nan"), float("inf"), 0.0, -0.0, 1.0, -3.0, 0.1, 122.79, 1e-6, 1.5e-6, 1e-7, 0.30000000000000004, 2.0**53, 2.0**53 - 1, 123456789.123456, 1234567890.5, 1e22, 5e-324, -2.5, 100.10, 999999999.9999999]
    committed = [None, {}, {"input": "c"}, {"input.b": "2", "input.a": "1", "output[0]": "3", "inputs": "4"}, {"input.é": "1"}, {"input.a": 'q"'}, {"label": "x"}]
    rows = []
    for i in range(max(len(payloads), len(numbers)) * 3):
        at = lambda x, k=1: x[i * k % len(x)]  # noqa: B023, E731
        rows.append((f"r{i}", i, at(odd), i, "t", at(odd, 5), "s", at(numbers), at(numbers, 3), at(numbers, 5), at(odd, 7), payloads[i % len(payloads)], payloads[(i // len(payloads) + i) % len(payloads)], None, None, None, committed[i // 7 % len(committed)]))
    rows += [(f"ok{i}", i, "é", i, "t", "l", "s", 1.0, float(i), 122.79, None, '{"k": 76}', None, None, None, None, committed[i]) for i in range(4)]
    schema = "run_id string, pos long, id string, index long, type string, label string, started_at string, duration_ms double, tokens double, cost double, tool_name string, input string, output string, data_payload string, span_id string, parent_span_id string, commitments map<string,string>"
    steps = spark.createDataFrame(rows, schema)
    fields = [x.split()[0] for x in schema.split(", ")]
    for version in (1, 2):
        found = integrity.with_canonical(steps, version).withColumn("whole", integrity.canonical_step(version)).withColumn("plain", integrity.plain_step(version)).collect()
        for r in found:
            want = integrity.step_text({f: r[f] for f in fields}, version)
            assert r.canonical == want and r.whole == want and r.plain in (None, want), (r, want)
        assert all(r.plain is not None for r in found if r.run_id.startswith("ok"))
    sure = {'{"k": 76}', '{"b":1,"a":"x"}', "{}", '{"é":"ü", "z":null,"y" : true}', '{"A":1,"a":2,"Z":3,"_":4}'}
    texts = spark.createDataFrame([(x,) for x in payloads if x is not None], "x string").select("x", canonical.plain_json(F.col("x")).alias("y")).collect()
    assert all(r.y == canonical.canonicalize(r.x) if r.y is not None else r.x not in sure for r in texts)


def test_lists_that_go_to_python_are_not_null(spark):
    steps = spark.createDataFrame([("a", 0, "t", None, None), ("a", 1, "u", {"x": "y"}, []), ("b", 0, "v", {}, ["z", None])], "run_id string, pos long, canonical string, m map<string,string>, l array<string>")
    filled, back = without_null_lists(steps)
    assert filled.where("m is null or l is null").count() == 0 and back(filled).schema.simpleString() == steps.schema.simpleString()
    got = integrity.chain(steps).orderBy("run_id", "pos").collect()
    assert [(r.m, r.l) for r in got] == [(None, None), ({"x": "y"}, []), ({}, ["z", None])]
    assert got[1].prev_hash == got[0].hash and got[2].prev_hash == ""


def test_requests_are_parsed_once(spark):
    asked = spark.createDataFrame([(1, "GET", "/api/runs"), (2, "GET", "/api/search?q=x")], "request long, method string, url string")
    runs = spark.createDataFrame([], f"{RUN_SCHEMA}, totals struct<tokens:double,cost:double,durationMs:double,steps:long>, run_hash string, hash_version int, ingested_at timestamp, signature {integrity.SIGNATURE}, redaction_seal {integrity.SEAL}")
    replies, lines = answers.answers(asked, runs, spark.createDataFrame([], STEP_SCHEMA))
    for df in (replies, lines):
        assert "url_decode" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted((r.request, r.status) for r in replies.collect()) == [(1, 200), (2, 200)]


def test_signatures_and_proofs_are_dealt_over_all_cores(spark, tmp_path):
    private, public = crypto.keys()
    runs = spark.createDataFrame([("r", "h", None, None)], "run_id string, run_hash string, keyId string, signature string")
    asked = anchor_sink.log_requests(runs, private, public)
    records = spark.createDataFrame([("r", "h", "{}")], "runId string, runHash string, proof string")
    for df in (asked, anchor_sink.answered(asked, runs.select("run_id", F.lit(b"").alias("answer")), "t"), proofs.proofs(records, F.col("runId"))):
        assert "Repartition" in df._jdf.queryExecution().optimizedPlan().toString()


def test_attributes_are_looked_up_once(spark):
    text = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"name":" x ","startTimeUnixNano":"1000000","endTimeUnixNano":" 3000000 ","attributes":[{"key":"gen_ai.tool.name","value":{"stringValue":"a"}},{"key":"gen_ai.tool.name","value":{"intValue":7}},{"key":"trace.cost","value":{"doubleValue":0.5}},null,{"key":"gen_ai.usage.input_tokens","value":{"stringValue":"\\u00a04"}}]},{"name":"plan"}]}]}]}'
    steps = traces.otlp(spark.createDataFrame([("p", text)], "path string, text string"))[1]
    assert sorted((r.ord, r.type, r.tool_name, r.cost, r.tokens, r.duration_ms) for r in steps.collect()) == [(0, "tool_call", "7", 0.5, 4.0, 2.0), (1, "plan", None, 0.0, 0.0, 0.0)]
    assert steps._jdf.queryExecution().optimizedPlan().toString().count("= gen_ai.usage.total_tokens") <= 1
    ends = spark.createDataFrame([(x,) for x in ("", " ", "a", " a", "a ", "\ta b\n", "😀", "﻿😀 ")], "x string")
    assert [r[0] for r in ends.select(trimmed(F.col("x"))).collect()] == ["", "", "a", "a", "a", "a b", "😀", "😀"]


def test_commitments_are_made_from_the_payloads_alone(spark):
    steps = spark.createDataFrame([("a", '{"k": [1, {"x": "y"}]}', None, None), ("b", None, "2", '"s"')], "id string, input string, output string, data_payload string")
    none = {"commitments": "map<string,string>", "salts": "map<string,string>", "redactions": "array<struct<path:string,at:string,reason:string,by:string>>"}
    out = redact.commit(steps.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}), salt=lambda step, path: f"{step}{path}")
    assert "map_entries" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r for r in out.collect()}
    assert got["a"].salts == {p: f"a{p}" for p in ("input.k[0]", "input.k[1].x")} and got["b"].salts == {p: f"b{p}" for p in ("output", "dataPayload")}
    assert got["a"].commitments["input.k[1].x"] == canonical.commitment("ainput.k[1].x", '"y"') and got["b"].commitments["output"] == canonical.commitment("boutput", "2")
    gone = redact.redact(out.where("id = 'a'").withColumn("salts", F.lit(None).cast("map<string,string>")), "t", paths=("input.k[0]",)).first()
    assert gone.salts is None and gone.redacted_paths == ["input.k[0]"]


def test_leaves_take_one_python_process_a_task(spark):
    steps = spark.createDataFrame([("a", 0, '{"x":[1]}', "no", '"s"', 2), ("b", 0, None, None, None, 2)], "run_id string, pos long, input string, output string, data_payload string, hash_version int")
    none = {"commitments": "map<string,string>", "salts": "map<string,string>", "redactions": "array<struct<path:string,at:string,reason:string,by:string>>"}
    out = diff.leaf_rows(steps.withColumns({c: F.lit(None).cast(t) for c, t in none.items()}))
    assert [(r.run_id, r.path, r.value) for r in out.collect()] == [("a", "input.x[0]", "1"), ("a", "dataPayload", '"s"')]
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1


def test_steps_of_compared_runs_are_not_sent_whole(spark, sf):
    pairs, steps = evidence.edited(spark, sf)
    aligned, warned = written(diff.alignments(pairs, steps), "aligned"), analyze.warnings(steps)
    found = diff.summary(diff.step_differences(aligned, pairs, steps))
    made = (diff.alignments(pairs, steps), found, warned, diff.warning_differences(pairs, aligned, steps, written(warned, "warnings")), diff.caveats(pairs.withColumns({"a_version": F.lit(2), "b_version": F.lit(2)}), found, aligned), sources.comparisons_judged(spark, sf))
    for df in made:
        assert df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_short_text_is_made_canonical_once(monkeypatch):
    calls = counted(monkeypatch, canonical, "canonical_text")
    text, long = '{"k": "a short text", "a": 1}', '["%s"]' % ("x" * canonical.SHORT)
    assert {canonical.canonicalize(text) for _ in range(5)} == {'{"a":1,"k":"a short text"}'} and len(calls) <= 1
    assert canonical.canonicalize(long) == canonical.canonicalize(long) == long and canonical.canonicalize("{bad") is canonical.canonicalize("{bad") is None
    assert len(canonical.REMEMBERED.__reduce__()[0]()) == 0


def test_the_second_verifier_writes_a_step_once(monkeypatch):
    step = {"id": "r:0", "index": 0, "label": "ü\ud800x", "cost": 1.5, "input": {"10": 1, "9": 2.0, "a": [1e21, -0.0, 10**15, 1e-7]}, "runId": "r", "prevHash": ""}
    run = {"id": "r", "hashVersion": 2, "steps": [step | {"hash": second.step_digest(step, "", 2)}], "runHash": ""}
    calls = counted(monkeypatch, second, "text_of")
    out = second.verdicts(json.dumps(run))
    assert out["chain"] and out["commitments"] and len(calls) < 25
    assert second.text_of(step["input"]) == canonical.canonical_text(step["input"]) == '{"9":2,"10":1,"a":[1e+21,0,1000000000000000,1e-7]}'
    assert second.json_string(step["label"]) == canonical.string_text(step["label"])
    deep = json.dumps(run).replace('"prevHash"', '"x": ' + "[" * 600 + "]" * 600 + ', "prevHash"')
    assert not second.verdicts(deep)["parsed"] and not second.shallow([[]], 1) and second.shallow([[]], 2)
    for path in ("input.k", "", "a..b", "a.", ".a", "a]b", "input"):
        assert second.keys_of(path, 2) == second.keys_of(path + "[0]", 2)[:-1] or path.endswith(".") or not path
