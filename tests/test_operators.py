"""Operators on hand-made traces: canonical text, chains, commitments, policies, alignment, sources, store."""

import hashlib
import json
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stepforge.functions import canonical as canon
from stepforge.functions import crypto, second
from stepforge.operators import analyze, anchors, diff, fleet, integrity, long_runs, policy, redact, report, search, store
from stepforge.schema import STEP_SCHEMA, Wire
from stepforge.sources import traces
from stepforge.streaming import live

CANONICAL = [
    ("1e2", "100"), ("1.0", "1"), ("-0", "0"), ("2.5E-5", "0.000025"), ("1e21", "1e+21"), ("123456789012345680000", "123456789012345680000"), ("1e-7", "1e-7"), ("9007199254740993", "9007199254740992"),
    ("5e-324", "5e-324"), ("1e999", "null"), ('{"b":1,"a":2,"10":3,"9":4,"01":5}', '{"9":4,"10":3,"01":5,"a":2,"b":1}'), ('{"a":1,"a":2}', '{"a":2}'), ('"\\u0001\\/\\u007f\\n"', '"\\u0001/\x7f\\n"'),
    ('"\\ud800"', '"\\ud800"'), ('"\\ud83d\\ude00"', '"😀"'), ('{"😀":1,"￿":2}', '{"😀":1,"￿":2}'), (" [ ] ", "[]"), ("{}", "{}"), ("null", "null"),
]


@pytest.mark.parametrize(("text", "want"), CANONICAL)
def test_canonical_text(text, want):
    assert canon.canonicalize(text) == want


def test_numbers_read_back_as_they_were():
    rng = random.Random(2)
    for _ in range(3000):
        x = rng.choice([rng.random(), rng.uniform(-1e9, 1e9), rng.random() * 10.0 ** rng.randint(-300, 300)])
        assert float(canon.number_text(x)) == x


def test_bad_and_deep_json(spark):
    deep = "[" * 5000 + "]" * 5000
    assert canon.canonicalize(deep) == deep and canon.canonicalize("{") is None and canon.canonicalize("NaN") is None
    df = spark.createDataFrame([("{ }",), (None,), ("12",), ('"a"',), ("1.50",)], "t string")
    assert [r[0] for r in df.select(canon.canonical(F.col("t"))).collect()] == ["{}", None, "12", '"a"', "1.5"]


def test_paths_lead_back_to_their_leaves():
    value = canon.parsed('{"a.b":{"[x":[1,{"":2,"\\\\":[]}]},"10":{},"9":null}')
    found = list(canon.leaves(value, "input"))
    assert [p for p, _ in found] == ["input.9", "input.10", "input.a\\.b.\\[x[0]", "input.a\\.b.\\[x[1].", "input.a\\.b.\\[x[1].\\\\"]
    for path, leaf in found:
        field, at = canon.split_path(path)
        assert field == "input" and canon.value_at(value, at) == leaf
    assert canon.split_path("input.a.b[2].c", 1) == ("input", ["a", "b", "2", "c"])
    assert canon.value_at(canon.replaced(canon.parsed('{"a":[1,2]}'), ["a", "1"], "x"), ["a", "1"]) == "x"


def test_ed25519_known_answer_and_forgeries():
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    public = crypto.public_key(seed)
    assert public.hex() == "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c"
    s = crypto.sign(seed, b"\x72")
    assert s.hex().startswith("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da")
    assert crypto.verify(public, b"\x72", s) and not crypto.verify(public, b"\x73", s) and not crypto.verify(public, b"\x72", s[:-1] + b"\xff")
    private, pem = crypto.keys()
    assert crypto.verify_text(pem, "x", crypto.sign_text(private, "x")) and not crypto.verify_text("junk", "x", "junk") and not crypto.verify_text(None, "x", None)


def test_merkle_proofs_of_every_leaf():
    def root(x):
        if len(x) == 1:
            return crypto.leaf_hash(x[0])
        k = 1 << (len(x) - 1).bit_length() - 1
        return crypto.node_hash(root(x[:k]), root(x[k:]))

    def path(i, x):
        if len(x) == 1:
            return []
        k = 1 << (len(x) - 1).bit_length() - 1
        return [*path(i, x[:k]), root(x[k:])] if i < k else [*path(i - k, x[k:]), root(x[:k])]

    for n in range(1, 20):
        x = [bytes([i]) for i in range(n)]
        for i in range(n):
            assert crypto.inclusion_root(crypto.leaf_hash(x[i]), i, n, path(i, x)) == root(x)
            with pytest.raises(ValueError):
                crypto.inclusion_root(crypto.leaf_hash(x[i]), i, n, [*path(i, x), b"\0" * 32])


def step(run, pos, kind="tool_call", tool=None, **more):
    return {"run_id": run, "pos": pos, "id": f"{run}:{pos}", "index": pos, "type": kind, "label": kind, "tool_name": tool, "started_at": f"2024-01-01T00:00:{pos:02d}.000Z", "duration_ms": 5.0, "tokens": 1.0, "cost": 0.1, "span_id": f"s{pos}", **more}


def steps_of(spark, rows):
    return spark.createDataFrame([{**{f.split()[0]: None for f in STEP_SCHEMA.replace(",string>", "").split(", ")}, **r} for r in rows], STEP_SCHEMA) if rows else spark.createDataFrame([], STEP_SCHEMA)


@pytest.fixture(scope="module")
def trace(spark):
    rows = [step("a", 0, "user_input", input='{"q":"mail bob@corp.example","n":[1,2]}')] + [step("a", i, tool="db", input='{"x": 1}') for i in (1, 2, 3)] + [step("a", 4, "error", cost=9.0), step("b", 0, "approval"), step("b", 1, tool="Pay​ment", input='"42"')]
    return steps_of(spark, rows)


def runs_of(spark, ids):
    return spark.createDataFrame([(i, f"run {i}", "2024-01-01T00:00:00.000Z", "2024-01-01T00:01:00.000Z", "completed", "USD") for i in ids], "run_id string, name string, started_at string, ended_at string, status string, currency string")


@pytest.mark.parametrize("version", [1, 2])
def test_sealed_runs_verify_and_changes_show(spark, trace, version, tmp_path):
    salted = redact.commit(trace, version, salt=lambda s, p: hashlib.sha256((s + p).encode()).hexdigest()[:32])
    runs, steps = integrity.seal(runs_of(spark, "ab"), salted, version)
    steps.write.parquet(f"{tmp_path}/s")
    steps = spark.read.parquet(f"{tmp_path}/s")
    seed = bytes(32)
    keys = crypto.pem(crypto.PKCS8 + seed, "PRIVATE KEY"), crypto.pem(crypto.SPKI + crypto.public_key(seed), "PUBLIC KEY")
    runs = integrity.sign_runs(runs, *keys, "2024-01-02T00:00:00.000Z").withColumn("redaction_seal", F.lit(None).cast("struct<keyId:string,publicKey:string,signature:string,sealedAt:string,redactionsHash:string>"))
    runs.write.parquet(f"{tmp_path}/r")
    runs = spark.read.parquet(f"{tmp_path}/r")
    first = steps.where("pos = 0 and run_id = 'a'").first()
    by_hand = integrity.step_text({**first.asDict(), "commitments": first["commitments"]}, version)
    assert first["hash"] == hashlib.sha256((f"tgstep/2\0{by_hand}\0" if version == 2 else by_hand).encode()).hexdigest()
    assert all(r["all_ok"] for r in integrity.verify_full(runs, steps).collect())
    bad = {r["run_id"]: r for r in integrity.verify_runs(runs, steps.withColumn("label", F.when((F.col("run_id") == "a") & (F.col("pos") == 2), "x").otherwise(F.col("label")))).collect()}
    assert (bad["a"]["failure"], bad["a"]["broken_index"], bad["b"]["ok"]) == ("chain", 2, True)
    other = steps.withColumn("input", F.when(F.col("id") == "a:1", '{"x":2}').otherwise(F.col("input")))
    assert {r["run_id"]: r["failure"] for r in integrity.verify_runs(runs, other).collect()} == {"a": "commitment", "b": None}
    gone = redact.redact(steps, "2024-01-03T00:00:00.000Z", names=("email",), version=version).drop("redacted_paths")
    after = {r["run_id"]: r for r in integrity.verify_runs(runs, gone).collect()}
    assert after["a"]["ok"] and after["a"]["redacted"] == ["input.q"]
    silent = gone.withColumn("redactions", F.lit(None).cast(gone.schema["redactions"].dataType))
    assert {r["run_id"]: r["failure"] for r in integrity.verify_runs(runs, silent).collect()}["a"] == ("undeclared" if version == 2 else None)
    edited = runs.withColumn("currency", F.lit("EUR"))
    assert {r["failure"] for r in integrity.verify_runs(edited, steps).collect()} == ({"anchor"} if version == 2 else {None})
    assert {r["signature_ok"] for r in integrity.verify_signatures(runs.withColumn("run_id", F.reverse(F.concat("run_id", F.lit("x"))))).collect()} == {False}
    assert [r["failure"] for r in integrity.verify_runs(runs.withColumn("hash_version", F.lit(7)), steps).collect()] == ["version"] * 2
    page = report.html(runs, steps, integrity.verify_full(runs, steps), analyze.warnings(steps), "a")
    assert page.isascii() and "intact" in page
    found = {r["run_id"]: r for r in report.compliance(runs, steps, integrity.verify_full(runs, steps)).collect()}
    assert found["b"]["approvals"] == 1 and found["a"]["authentic"] and found["a"]["signed"] and found["a"]["complete"] and found["a"]["data_steps"] == 0


def test_scrub_and_legacy_redaction(spark, trace):
    done = {r["id"]: r for r in redact.scrub(trace, "t", ("email",), wire=Wire("w")).collect()}
    assert json.loads(done["a:0"]["input"])["q"] == "[w:redacted]" and done["a:0"]["redactions"][0]["reason"] == "pattern:email" and done["a:1"]["input"] == '{"x": 1}'
    old = {r["id"]: r for r in redact.redact(trace, "t", paths=("a:1#input.x", "input.none"), legacy=True).collect()}
    assert "redacted" in old["a:1"]["input"] and old["a:2"]["input"] == '{"x": 1}' and old["a:1"]["redacted_paths"] == ["input.x"]
    with pytest.raises(ValueError):
        redact.detectors(("nope",))


HITS = [("a@b.co", "email"), ("é123-45-6789", "ssn"), ("x123-45-6789", None), ("4111 1111 1111 1111", "credit-card"), ("1234 5678 9012", "aadhaar"), ("Bearer abcdefghijklmnop", "bearer-token"), ("-----BEGIN RSA PRIVATE KEY-----", "private-key"), ("nothing", None)]


def test_detectors_agree_in_both_engines(spark):
    import re

    got = [r[0] for r in spark.createDataFrame([(x,) for x, _ in HITS], "t string").select(redact.first_hit(F.col("t"))).collect()]
    found = {n: re.compile(p) for n, p in redact.DETECTORS.items()}
    assert got == [w for _, w in HITS] == [redact.hit(x, found) for x, _ in HITS]


def test_policy_rules_and_parsing(spark, trace):
    runs = spark.createDataFrame([("a", 9.4, 5.0, 5, False), ("b", 0.2, 2.0, 2, True)], "run_id string, cost double, tokens double, steps int, signed boolean")
    p = policy.parse_policy('{"name":"n","rules":{"maxSteps":4,"forbidTools":["payment"],"requireApprovalFor":["*"],"forbidInputText":["42"],"requireSignature":true}}')
    got = {(r["run_id"], r["rule"], r["hits"]) for r in policy.evaluate(runs, trace, spark.createDataFrame([], "run_id string, kind string"), p).collect()}
    assert got == {("a", "maxSteps", 1), ("b", "forbidTools", 1), ("a", "requireApprovalFor", 3), ("b", "forbidInputText", 1), ("a", "requireSignature", 1)}
    for bad in ('{"rules":{"nope":1}}', '{"rules":{"maxSteps":0}}', '{"rules":{"maxSteps":1.5}}', '{"rules":{"forbidTools":"x"}}', "{}", '{"rules":{},"more":1}'):
        with pytest.raises(ValueError):
            policy.parse_policy(bad)
    names = spark.createDataFrame([("ｄｂ_Query",), (" A​ ",), (None,)], "n string").select(policy.folded(F.col("n")).alias("n"))
    assert [r[0] for r in names.collect()] == ["db_query", "a", None]
    match = lambda n, x: spark.range(1).select(policy.tool_matches(F.lit(n), x)).first()[0]
    assert match("ab", "*") and match("ab", "*b") and match("ab", "A*") and match("ab", "AB") and not match("ab", "a*b") and match("a*", "**")


def test_loops_follow_tool_and_input(spark):
    rows = [step("r", i, tool="t", input=x) for i, x in enumerate(['{"a":1}', '{ "a": 1.0 }', '{"a":1}', '{"a":2}', None, "null", None])]
    df = steps_of(spark, rows)
    assert [(r["run_length"], r["first_index"]) for r in analyze.loops(df).orderBy("first_index").collect()] == [(3, 0), (3, 4)]
    assert [r["run_length"] for r in analyze.loops(df, by_tool=True).collect()] == [7]
    searches = steps_of(spark, [step("r", i, tool="search", input=f'{{"q":{i}}}') for i in range(4)])
    assert analyze.loops(searches).count() == analyze.warnings(searches).count() == analyze.warning_counts(searches).count() == 0
    # Texts alike, then written otherwise, then a text that no JSON reads; and a call without a tool ends a run.
    rows = [step("r", i, tool="t", input=x) for i, x in enumerate(['{"a":1}', '{"a":1}', '{"a": 1}', "{bad", "{bad", "{bad", '"s"', '"s"', '"\\u0073"'])]
    assert sorted((r["first_index"], r["run_length"]) for r in analyze.loops(steps_of(spark, rows)).collect()) == [(0, 3), (3, 3), (6, 3)]
    mixed = steps_of(spark, [step("r", i, "tool_call" if i != 2 else "approval", "t") for i in range(5)])
    assert analyze.loops(mixed).count() == 0


@pytest.mark.parametrize("kept", [0, diff.KEPT])
def test_alignments_in_bits_are_those_of_the_table(monkeypatch, kept):
    monkeypatch.setattr(diff.exact_middle, "__defaults__", (kept,))
    rng = random.Random(4)
    for _ in range(300):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        a, b = ([(x, "") for x in rng.choices(letters, k=rng.randint(0, 40))] for _ in range(2))
        assert diff.subsequence(a, b, 0, exact=True) == diff.subsequence(a, b)
        assert diff.align(a, b, 0, exact=True) == diff.align(a, b)


def test_long_runs_align_exactly_in_little_memory(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(diff.exact_middle, "__defaults__", (1 << 20,))
    rng, n = random.Random(5), 20_000
    a = [(f"t{rng.randrange(50)}", "") for _ in range(n)]
    b = [x for x in a if rng.random() < 0.9] + [("new", "")]
    rng.shuffle(cut := b[5000:5200])
    b[5000:5200] = cut
    tracemalloc.start()
    found, large = diff.subsequence([("first", ""), *a], [("other", ""), *b], exact=True)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert not large and len(found) > 0.88 * n - 200
    assert all(i < x and j < y for (i, j), (x, y) in zip(found, found[1:]))
    assert diff.subsequence([("first", ""), *a], [("other", ""), *b])[1]


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_subsequences_are_longest_and_alignments_whole():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs, large = diff.subsequence(a, b)
        assert not large and len(pairs) == brute_lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and sorted(j for _, j in pairs) == [j for _, j in pairs]
        rows, _ = diff.align([(x, "") for x in a], [(x, "") for x in b])
        assert sorted(i for i, _, _ in rows if i is not None) == list(range(len(a))) and sorted(j for _, j, _ in rows if j is not None) == list(range(len(b)))
    assert diff.align([("a", ""), ("b", "")], [("b", ""), ("a", "")])[0] == [(0, 1, True), (1, 0, False)]
    assert diff.subsequence("xaby", "xbaz", 1)[1]


def test_diff_of_two_runs(spark):
    a = [step("a", 0, "user_input", input='{"q":1}'), step("a", 1, tool="x", cost=1.0), step("a", 2, tool="y")]
    b = [step("b", 0, "user_input", input='{"q":2,"r":3}'), step("b", 1, tool="y"), step("b", 2, tool="z", cost=1.0), step("b", 3, "final_output")]
    steps = steps_of(spark, a + b).withColumn("hash_version", F.lit(2))
    pairs = spark.createDataFrame([("p", "a", "b", True, 2, 2)], "pair string, a_run string, b_run string, same_currency boolean, a_version int, b_version int")
    aligned = diff.alignments(pairs, steps)
    leaves = diff.leaf_differences(aligned, pairs, diff.leaf_rows(steps))
    assert {(r["path"], r["status"], r["a"], r["b"]) for r in leaves.collect()} == {("input.q", "changed", "1", "2"), ("input.r", "added", None, "3")}
    found = diff.step_differences(aligned, pairs, steps, leaves)
    total = diff.summary(found).first()
    assert (total["changed"] + total["same"], total["added"], total["removed"]) == (2, 2, 1)
    assert not diff.equivalent(pairs, diff.summary(found), diff.warning_differences(pairs, aligned, steps, analyze.warnings(steps))).first()["equivalent"]
    assert diff.caveats(pairs, diff.summary(found), aligned).first()["caveats"] == []
    gone = steps.withColumn("input", F.when(F.col("id") == "b:0", '{"q":"[trace:redacted]","r":3}').otherwise(F.col("input")))
    assert {r["path"]: r["status"] for r in diff.leaf_differences(aligned, pairs, diff.leaf_rows(gone)).collect()} == {"input.q": "redacted", "input.r": "added"}


def test_payload_access(spark):
    rows = [('{"_access":"mutated","table":"t"}', "plan", "MUTATED"), ('{"a":1}', "branch", "MUTATED"), ('{"_access":"x"}', "plan", "READ"), ("[1]", "final_output", "READ"), (None, "branch", None), ("null", "branch", None)]
    df = spark.createDataFrame(rows, "p string, k string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", report.access(F.col("p"), F.col("k"))).collect())
    first = df.limit(1).select(report.payload_view(F.col("p")).alias("v"), report.payload_table(F.col("p")).alias("t")).first()
    assert first["v"] == {"table": "t"} and first["t"] == "t"


def test_fleet_edges(spark):
    runs = spark.createDataFrame([("a", "2024", "completed", "USD", 1, 1.0, 1.0, 1.0, True, True, True), ("b", "bad", "failed", "EUR", 1, 1.0, 0.0, 1.0, False, True, True)], "run_id string, started_at string, status string, currency string, steps int, tokens double, cost double, duration_ms double, signed boolean, chain_ok boolean, signature_ok boolean").withColumn("name", F.col("run_id"))
    counts = spark.createDataFrame([("b", 0, 0, 1, 1)], "run_id string, loop long, high_cost_step long, error long, total long")
    f = fleet.with_issues(fleet.rows(runs, counts).withColumn("live", F.lit(False)))
    assert fleet.outlier_threshold(runs).first()[0] == float("inf")
    assert {r["run_id"]: r["issues"] for r in f.collect()} == {"a": [], "b": ["error", "unsigned"]}
    assert [r["run_id"] for r in fleet.filtered(f, since="2025-01-01").collect()] == ["b"]
    s = fleet.summary(f).first()
    assert (s["cost"], s["currency"], s["failed"]) == (0.0, "", 1)


def test_anchor_files(spark):
    one = '{"version":1,"runId":"a","runHash":"h"}'
    lines = [one, "", "junk", *anchors.chained_lines([{"runId": "b", "runHash": "g"}, {"runId": "c", "runHash": "k"}], "junk"), '{"version":2,"runId":"d","runHash":"x","prev":null}', '{"version":2}']
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines, 1)], "file string, line int, raw string")
    read = anchors.read_lines(df)
    assert {r["line"]: r["problem"] for r in read.collect()} == {1: None, 3: "not valid JSON", 4: None, 5: None, 6: "chain break", 7: "not an anchor record"}
    runs = spark.createDataFrame([("a", "h"), ("b", "other"), ("z", "q")], "run_id string, run_hash string")
    assert {r["run_id"]: (r["strength"], r["ok"]) for r in anchors.verify(runs, read).collect()} == {"a": ("local", True), "b": ("none", False), "z": ("none", True)}
    assert {r["run_id"]: r["conflict"] for r in anchors.fresh(runs, read).collect()} == {"b": True, "z": False}
    assert {r["runId"] for r in anchors.orphans(read.where("ok"), runs).collect()} == {"c"}
    text = runs.limit(1).select(anchors.statement(F.col("run_id"), F.col("run_hash"), F.lit(None).cast("string"), F.lit(None).cast("string"), Wire("w"))).first()[0]
    assert text == 'w-anchor-v2\nrunId: "a"\nrunHash: "h"\nkeyId: null\nsignature: null\n'


def test_native_and_otlp_agree(spark, tmp_path):
    native = {"id": "r", "name": "n", "steps": [{"type": "tool_call", "label": "q", "startedAt": "2024-01-01T00:00:01.000Z", "durationMs": 3, "toolName": "db", "input": {"b": 1, "a": [True]}, "cost": 0.5}, {"type": "user_input", "label": "hi", "startedAt": "2024-01-01T00:00:00.000Z", "durationMs": 1, "tokens": 7}]}
    text = lambda k, v: {"key": k, "value": {"stringValue": v}}
    spans = [{"spanId": "r-span-0", "name": "q", "startTimeUnixNano": "1704067201000000000", "endTimeUnixNano": "1704067201003000000", "status": {"code": 2}, "attributes": [text("gen_ai.tool.name", "db"), {"key": "trace.cost", "value": {"doubleValue": 0.5}}, text("trace.input", '{"b":1,"a":[true]}')]}, {"name": "user asks", "startTimeUnixNano": 1704067200000000000, "endTimeUnixNano": 1704067200001000000, "attributes": [text("trace.step.label", "hi"), {"key": "gen_ai.usage.input_tokens", "value": {"intValue": "7"}}]}]
    otel = {"resourceSpans": [{"resource": {"attributes": [text("trace.run.id", "r"), text("trace.run.name", "n")]}, "scopeSpans": [{"spans": spans}]}]}
    for name, x in (("n.json", native), ("o.json", otel), ("junk.json", [1])):
        (tmp_path / name).write_text(json.dumps(x))
    docs = traces.with_format(traces.documents(spark, str(tmp_path)))
    assert {r["path"][-6:]: r["format"] for r in docs.collect()} == {"n.json": "native", "o.json": "otlp", "k.json": None}
    cols = ["run_id", "index", "id", "type", "label", "tool_name", "started_at", "duration_ms", "tokens", "cost"]
    a, b = (f(docs.where(F.col("format") == k))[1] for f, k in ((traces.native, "native"), (traces.otlp, "otlp")))
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())
    assert {canon.canonicalize(r["input"]) for x in (a, b) for r in x.where("index = 1").collect()} == {'{"a":[true],"b":1}'}
    assert {r["type"] for r in traces.otlp(docs.where("format = 'otlp'"), live=True)[1].collect()} == {"error", "user_input"}


def test_faulty_documents_are_refused_whole(spark):
    step = {"type": "plan", "label": "p", "startedAt": "2024-01-01T00:00:00.000Z", "durationMs": 0}
    doc = {"id": "a", "name": "n", "steps": [step, step]}
    broken = {
        "steps[1].type": {**doc, "steps": [step, {**step, "type": "plans"}]}, "steps[0].label": {**doc, "steps": [{**step, "label": 7}, {**step, "type": 1}]}, "steps[1].durationMs": {**doc, "steps": [step, {k: v for k, v in step.items() if k != "durationMs"}]},
        "steps[0].durationMs": {**doc, "steps": [{**step, "durationMs": -1}]}, "steps[0].cost": {**doc, "steps": [{**step, "cost": None}]}, "steps[0].tokens": {**doc, "steps": [{**step, "tokens": "3"}]}, "steps[0].toolName": {**doc, "steps": [{**step, "toolName": None}]},
        "steps[0].type": {**doc, "steps": ["plan"]}, "id": {**doc, "id": ""}, "name": {"id": "a", "steps": []}, "status": {**doc, "status": "running"}, "currency": {**doc, "currency": 1},
    }
    rows = [(k, json.dumps(v)) for k, v in broken.items()] + [("0", json.dumps(doc)), ("1", json.dumps({**doc, "id": "b", "status": "failed", "steps": [{**step, "tokens": 0, "cost": 1.5, "input": None}]})), ("2", json.dumps({**doc, "name": "again"}))]
    runs, steps, refused = traces.native(spark.createDataFrame(rows, "path string, text string"))
    assert {r["path"]: r["reason"] for r in refused.collect()} == {**{k: k for k in broken}, "2": "the run is in 0"}
    assert sorted((r["run_id"], r["name"], r["declared"]) for r in runs.collect()) == [("a", "n", None), ("b", "n", "failed")]
    assert sorted((r["run_id"], r["index"], r["input"]) for r in steps.collect()) == [("a", 0, None), ("a", 1, None), ("b", 0, "null")]


def test_exports_of_one_run_do_not_mix(spark):
    span = lambda n: {"name": n, "startTimeUnixNano": "1704067201000000000", "endTimeUnixNano": "1704067201003000000"}
    rows = [(p, json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span(p), span(p)]}]}]})) for p in ("b", "a")]
    runs, steps, refused = traces.otlp(spark.createDataFrame(rows, "path string, text string"))
    assert [(r["path"], r["run_id"]) for r in runs.collect()] == [("a", "otel-run")]
    assert sorted((r["index"], r["label"]) for r in steps.collect()) == [(0, "a"), (1, "a")]
    assert [tuple(r) for r in refused.collect()] == [("b", "otel-run", "the run is in a")]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rows = [f"line {i}" if i % 5 else "" for i in range(2000)]
    (tmp_path / "x.jsonl").write_text("\n".join(rows) + "\n")
    (tmp_path / "y.jsonl").write_text("one\r\ntwo")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = traces.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {n: [r["raw"] for r in sorted((r for r in found if r["file"].endswith(n)), key=lambda r: r["line"])] for n in ("x.jsonl", "y.jsonl")}
    assert by == {"x.jsonl": rows, "y.jsonl": ["one\r", "two"]} and min(r["line"] for r in found) == 1


def test_two_places_are_ecmascripts():
    want = {1.005: "1.00", 2.675: "2.67", 0.285: "0.28", 1.255: "1.25", 0.125: "0.13", 2.5: "2.50", -0.375: "-0.38", -0.001: "-0.00", -0.0: "0.00", 1e20: "100000000000000000000.00", 1e21: "1e+21", 123456789.995: "123456790.00", float("inf"): "Infinity"}
    assert {x: analyze.fixed(x) for x in want} == want
    assert analyze.fixed(0.25, 1) == "0.3" and analyze.fixed(-0.0, 1) == "0.0"


def test_the_second_verifier_writes_the_same_text():
    for text, want in CANONICAL:
        if text != "1e999":
            assert second.text_of(json.loads(text)) == want, text


def test_labels():
    assert report.money(1.005, "USD") == "USD 1.00" and report.commas(1234567.5) == "1,234,568" and report.commas(-0.5) == "0"
    assert [report.duration_label(x) for x in (999, 1000, 61234)] == ["999 ms", "1.00 s", "61.23 s"]
    assert [report.human_bytes(n) for n in (0, 1023, 1024, 1536, 1024**2, 5 * 1024**3)] == ["0 B", "1023 B", "1.0 KiB", "1.5 KiB", "1.0 MiB", "5120.0 MiB"]
    ago = lambda minutes: report.age("2024-01-01T00:00:00.000Z", f"{(datetime(2024, 1, 1) + timedelta(minutes=minutes)).isoformat()}Z")
    assert [ago(m) for m in (0, 3, 59, 60, 95, 1380, 1440, 43200, 130000)] == ["just now", "3m ago", "59m ago", "1h ago", "2h ago", "23h ago", "1d ago", "1mo ago", "3mo ago"]
    assert report.age("never", "2024-01-01T00:00:00Z") == "" and report.clock("2024-01-01T05:06:07.089+01:00") == "04:06:07.089"


def test_journals(spark, tmp_path):
    s = lambda i: json.dumps({"kind": "step", "step": {"id": f"r:{i}", "index": i, "type": "plan", "label": "p", "startedAt": "2024-01-01T00:00:00.000Z", "durationMs": 1, "input": None}})
    meta = '{"kind":"meta","formatVersion":1,"id":"%s","name":"n","currency":"USD","startedAt":"2024-01-01T00:00:00.000Z"}'
    (tmp_path / "a.jsonl").write_text("\n".join([meta % "a", s(0), s(1), '{"kind":"end","status":"completed"}', ""]))
    (tmp_path / "b.jsonl").write_text("\n".join([meta % "b", s(0), '{"kind":"st']))
    (tmp_path / "c.jsonl").write_text(s(0))
    (tmp_path / "d.jsonl").write_text(meta % "d")
    recordings, steps = traces.journals(traces.lines(spark, str(tmp_path)))
    assert {r["run_id"]: (r["steps"], r["ended"]) for r in recordings.collect()} == {"a": (2, "completed"), "d": (0, None)}
    assert [(r["id"], r["input"]) for r in steps.orderBy("pos").collect()] == [("r:0", "null"), ("r:1", "null")]
    ok = spark.createDataFrame([("a", None), ("d", None)], "run_id string, broken_index long")
    assert [(r["run_id"], r["status"]) for r in live.recoverable(recordings, ok).collect()] == [("a", "completed")]


def test_envelopes(spark, tmp_path):
    run = {"id": "x", "name": "n", "startedAt": "s", "endedAt": "e", "status": "completed", "currency": "USD", "totals": {"tokens": 0, "cost": 0, "durationMs": 0, "steps": 0}, "runHash": "", "steps": []}
    for i, x in enumerate([{"formatVersion": 1, "run": run}, {**run, "id": "y"}, {"formatVersion": 2, "run": run}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(x))
    runs, steps, refused = traces.envelopes(traces.documents(spark, str(tmp_path)))
    assert sorted(r["run_id"] for r in runs.collect()) == ["x", "y"] and refused.count() == 1 and steps.count() == 0


def test_session_log(spark):
    use = {"input_tokens": 1_000_000, "cache_creation": {"ephemeral_1h_input_tokens": 1_000_000}}
    entries = [
        {"type": "user", "uuid": "u1", "timestamp": "2024-01-01T00:00:00.000Z", "sessionId": "s", "message": {"content": "<command-x>"}},
        {"type": "user", "uuid": "u2", "timestamp": "2024-01-01T00:00:01.000Z", "message": {"content": [{"type": "text", "text": " Do  it\nnow "}]}},
        {"type": "assistant", "uuid": "a", "timestamp": "2024-01-01T00:00:02.000Z", "message": {"model": "m-1-2024", "usage": use, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t", "name": "db", "input": {"k": 1}}]}},
        {"type": "user", "uuid": "u3", "timestamp": "2024-01-01T00:00:04.000Z", "toolUseResult": {"rows": 2}, "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "A"}, {"type": "text", "text": "B"}]}]}},
        {"type": "assistant", "uuid": "z", "timestamp": "2024-01-01T00:00:05.000Z", "message": {"content": "done"}},
    ]
    raw = spark.createDataFrame([("f", i, json.dumps(e)) for i, e in enumerate(entries)] + [("f", 9, "{bad")], "file string, line int, raw string")
    prices = spark.createDataFrame([("m-1-20", 9.0, 9.0, 1), ("m-1", 2.0, 4.0, 0)], "model string, price_in double, price_out double, ord int")
    runs, steps = traces.sessions(raw, prices, (5.0, 25.0))
    assert [(r["run_id"], r["name"]) for r in runs.collect()] == [("cc-s", "Do it now")]
    got = [(r["type"], r["label"], r["tool_name"], r["output"], r["data_payload"], r["duration_ms"], r["tokens"], r["cost"]) for r in steps.orderBy("index").collect()]
    assert got == [
        ("user_input", "Do it now", None, None, None, 1000.0, 0.0, 0.0), ("llm_reasoning", "Reasoning", None, '"hm"', None, 2000.0, 1_000_000.0, 6.0),
        ("tool_call", "Tool: db", "db", '"A\\nB"', '{"rows":2}', 0.0, 0.0, 0.0), ("final_output", "Final output", None, '"done"', None, 0.0, 0.0, 0.0),
    ]
    assert traces.is_session(traces.session_entries(raw)).first()["session"]
    assert [(r["session_id"], r["prompt"], r["messages"]) for r in traces.session_summaries(raw).collect()] == [("s", "Do it now", 5)]


def test_search_snippets(spark):
    df = spark.createDataFrame([("r", 0, "x" * 40 + "Needle" + "y" * 60), ("r", 1, "needle"), ("r", 2, None)], "run_id string, index long, label string")
    got = [r["snippet"] for r in search.search(df, "needle", fields=("label",)).collect()]
    assert got == ["…" + "x" * 30 + "Needle" + "y" * 50 + "…", "needle"]


def test_store(spark, trace, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.save(runs_of(spark, "a"), trace.where("run_id = 'a'"), "2024-01-01T10:00:00")
    s.save(runs_of(spark, "b"), trace.where("run_id = 'b'"), "2024-02-01T10:00:00")
    with pytest.raises(ValueError):
        s.save(runs_of(spark, "a"), trace, "2024-03-01T10:00:00")
    assert [r["run_id"] for r in s.list().collect()] == ["b", "a"] and s.get("a").count() == 1
    s.replace({"steps": s.table("steps").where("run_id = 'a'").withColumn("label", F.lit("gone"))})
    assert s.table("steps").where("label = 'gone'").count() == 5 and s.table("steps").count() == 7
    assert [r["run_id"] for r in s.prune("2024-01-15").collect()] == ["a"] and s.table("steps").count() == 2
    assert s.vacuum()["after"] > 0 and s.table("runs").count() == 1
    s.audit("prune", {"run": "a"}, "t")
    (tmp_path / "new").mkdir()
    store.Store(spark, f"file://{tmp_path}/new")
    marker = next((tmp_path / "new/_schema_version").glob("part-*"))
    spark.createDataFrame([('{"version": 99}',)], "value string").coalesce(1).write.mode("overwrite").text(f"file://{tmp_path}/new/_schema_version")
    assert not marker.exists()
    with pytest.raises(ValueError):
        store.Store(spark, f"file://{tmp_path}/new")


def test_prune_is_exact_within_a_day(spark, trace, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    for run, at in (("a", "2024-01-01T10:00:00"), ("b", "2024-01-01T10:00:01")):
        s.save(runs_of(spark, run), trace.where(F.col("run_id") == run), at)
    s.vacuum()
    assert [r["run_id"] for r in s.prune("2024-01-01T10:00:01").collect()] == ["a"]
    assert [r["run_id"] for r in s.list().collect()] == ["b"] and {r["run_id"] for r in s.table("steps").collect()} == {"b"}
    assert s.prune("2024-01-01T10:00:01").count() == 0 and s.table("runs").count() == 1
    assert s.prune("2025-01-01").count() == 1 and s.table("runs").count() == 0 and s.table("steps").count() == 0
    s.save(runs_of(spark, "a"), trace.where("run_id = 'a'"), "2025-01-01T00:00:00")
    assert s.table("runs").count() == 1


def test_a_crash_leaves_the_store_whole(spark, trace, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.save(runs_of(spark, "a"), trace.where("run_id = 'a'"), "2024-01-01T10:00:00")
    before = sorted(s.table("steps").collect()), sorted(s.table("runs").select("run_id", "ingested_at").collect())
    with monkeypatch.context() as m:
        m.setattr(s, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        for act in (lambda: s.save(runs_of(spark, "b"), trace.where("run_id = 'b'"), "2024-01-02T00:00:00"), lambda: s.prune("2030-01-01"), lambda: s.replace({"steps": s.table("steps").withColumn("label", F.lit("x"))})):
            with pytest.raises(OSError):
                act()
            assert (sorted(s.table("steps").collect()), sorted(s.table("runs").select("run_id", "ingested_at").collect())) == before
    s.save(runs_of(spark, "b"), trace.where("run_id = 'b'"), "2024-01-02T00:00:00")
    assert s.table("runs").count() == 2 and s.vacuum(0)["after"] > 0 and s.table("steps").count() == trace.count()
    left = {p.relative_to(tmp_path / "store/data").parts[0] for p in (tmp_path / "store/data").rglob("*.parquet")}
    assert left == {p["path"].split("/")[1] for t in s.read()[1].values() for p in t["parts"]}


def test_a_crash_between_any_two_steps_leaves_old_or_new(spark, trace, tmp_path, monkeypatch):
    """Every write, commit and deletion of each operation fails in turn, before or after it is done."""
    first = store.Store(spark, f"file://{tmp_path}/first")
    for run, hour in (("a", 10), ("b", 11)):
        first.save(runs_of(spark, run), trace.where(F.col("run_id") == run), f"2024-01-01T{hour}:00:00")

    def fresh(name):
        shutil.copytree(tmp_path / "first", tmp_path / name)
        return store.Store(spark, f"file://{tmp_path}/{name}")

    def seen(s):
        s = store.Store(spark, s.path)
        return sorted(map(str, s.table("runs").select("run_id", "name").collect())), sorted(map(str, s.table("steps").select("run_id", "index", "label").collect()))

    acts = {
        "prune": lambda s: s.prune("2024-01-01T10:30:00"),
        "erase": lambda s: s.prune("2024-01-01T10:30:00", erase=True),
        "redact": lambda s: s.replace({"runs": s.table("runs").where("run_id = 'a'").withColumn("name", F.lit("new")), "steps": s.table("steps").where("run_id = 'a'").withColumn("label", F.lit("gone"))}),
        "vacuum": lambda s: s.vacuum(0),
    }
    for act, run in acts.items():
        model = fresh(f"{act}-model")
        old = seen(model)
        run(model)
        new, crashes = seen(model), 0
        for n in range(40):
            s = fresh(f"{act}-{n}")
            calls = iter(range(1000))

            def failing(f, n=n, calls=calls):
                def step(*args, **more):
                    if (k := next(calls)) == n // 2 and n % 2 == 0:
                        raise OSError("lost before")
                    out = f(*args, **more)
                    if k == n // 2:
                        raise OSError("lost after")
                    return out

                return step

            with monkeypatch.context() as m:
                for name in ("written", "commit", "erase"):
                    m.setattr(s, name, failing(getattr(s, name)))
                try:
                    run(s)
                except OSError:
                    crashes += 1
                else:
                    break
            assert seen(s) in (old, new), (act, n)
            if act == "redact" and seen(s) == new:
                store.Store(spark, s.path).sweep()
                texts = spark.read.parquet(f"{s.path}/data/*/steps")
                assert texts.where("run_id = 'a' and label <> 'gone'").count() == 0
        assert crashes >= 4


def test_open_readers_survive_prune_and_vacuum_but_not_redaction(spark, trace, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    for k, run in enumerate(("a", "b")):
        s.save(runs_of(spark, run), trace.where(F.col("run_id") == run), f"2024-01-01T10:00:0{k}")
    before, n = s.table("steps"), trace.count()
    s.vacuum()
    assert before.count() == n and s.table("steps").count() == n
    between = s.table("steps")
    assert s.prune("2024-01-01T10:00:01").count() == 1
    assert before.count() == between.count() == n and s.table("steps").count() < n
    s.vacuum(0)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FAILED_READ_FILE"):
        before.select("label").collect()
    late = s.table("steps")
    s.replace({"steps": late.withColumn("label", F.lit("gone"))})
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FAILED_READ_FILE"):
        late.select("label").collect()


def test_a_replayed_trigger_stores_nothing(spark, trace, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.save(runs_of(spark, "a"), trace.where("run_id = 'a'"), "2024-01-01T10:00:00", batch=("serve", 0))
    with monkeypatch.context() as m:  # the process ends after the commit of trigger 1, before its stream knows
        m.setattr(s, "undo", lambda made: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.save(runs_of(spark, "b"), trace.where("run_id = 'b'"), "2024-01-01T10:00:01", batch=("serve", 1))
    s = store.Store(spark, s.path)
    assert not s.save(runs_of(spark, "b"), trace.where("run_id = 'b'"), "2024-01-01T10:00:02", batch=("serve", 1))
    assert s.table("runs").count() == 2 and s.table("steps").count() == trace.count()
    assert s.save(runs_of(spark, "c"), trace.where("false"), "2024-01-01T10:00:03", batch=("other", 0)) and s.state()[1]["batches"] == {"serve": 1, "other": 0}


def test_lookups_open_only_the_parts_that_may_hold_what_is_sought(spark, tmp_path):
    rng, s = random.Random(3), store.Store(spark, f"file://{tmp_path}/store")
    words = ["alpha", "BETA", "gamma", "delta", "épsilon", "zeta"]
    for k in range(6):
        rows = [step(f"r{k}-{j}", i, tool=rng.choice([None, "db"]), input=json.dumps({"q": f"{rng.choice(words)} {words[k]}{k} {rng.randrange(10**6)}"}, ensure_ascii=False)) for j in range(4) for i in range(3)]
        ids = [f"r{k}-{j}" for j in range(4)]
        runs = spark.createDataFrame([(i, "n", "s", "e", "completed", "USD") for i in ids], "run_id string, name string, started_at string, ended_at string, status string, currency string")
        s.save(runs, steps_of(spark, rows), f"2024-01-0{k + 1}T00:00:00")
    assert s.run("r3-1")[1].count() == 3 and len(s.run("r3-1")[1].inputFiles()) > 1
    assert s.index() == 12 and s.index() == 0
    folders = lambda df: {f.split("/data/")[1].split("/")[0] for f in df.inputFiles()}
    runs, steps = s.run("r3-1")
    assert (runs.count(), steps.count()) == (1, 3) and len(folders(runs)) == len(folders(steps)) == 1
    assert s.run("nobody")[1].count() == 0 and s.get("r5-0").count() == 1
    whole = s.table("steps")
    needles = ["GAMMA2", "a", "ÉPSILON4", "nowhere", "db", '"q"'] + ["".join(rng.choice("abdelmtz0123456789 ") for _ in range(rng.randint(2, 4))) for _ in range(2)]
    for needle in needles:
        assert sorted(map(str, s.search(needle, None).collect())) == sorted(map(str, search.search(whole, needle, None).collect())), needle
    assert len(folders(s.holding("steps", [(f, g) for f in search.FIELDS for g in ("gam", "amm", "mma", "ma2")]))) == 1
    s.prune("2024-01-05T00:00:00")
    assert s.run("r3-1")[1].count() == 0 and s.search("delta3").count() == 0 and s.search("zeta5").count() == 12
    s.save(spark.createDataFrame([("late", "n", "s", "e", "completed", "USD")], runs.drop("ingested_at").schema), steps_of(spark, [step("late", 0, input='"gamma2"')]), "2024-02-01T00:00:00")
    assert [r["run_id"] for r in s.search("GAMMA2").collect()] == ["late"]  # a part without filters is opened
    assert s.index() == 2 and len(s.stat_folders()) == 1


def test_two_writers_do_not_store_one_run_twice(spark, trace, tmp_path, monkeypatch):
    one, two = (store.Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    plain, raced = one.commit, []

    def late(number, tables):
        if not raced:
            raced.append(two.save(runs_of(spark, "a"), trace.where("run_id = 'a'"), "2024-01-01T00:00:00"))
        return plain(number, tables)

    monkeypatch.setattr(one, "commit", late)
    with pytest.raises(ValueError, match="stored already"):
        one.save(runs_of(spark, "a"), trace.where("run_id = 'a'"), "2024-01-02T00:00:00")
    one.save(runs_of(spark, "b"), trace.where("run_id = 'b'"), "2024-01-02T00:00:00")
    assert two.table("runs").count() == 2 and two.table("steps").count() == trace.count()
    with pytest.raises(ValueError):
        one.save(runs_of(spark, "c").unionByName(runs_of(spark, "c")), trace.where("false"), "2024-01-03T00:00:00")


def test_old_stores_are_taken_over(spark, trace, tmp_path):
    at = f"file://{tmp_path}/store"
    spark.createDataFrame([('{"version": 1}',)], "value string").coalesce(1).write.text(f"{at}/_schema_version")
    stamp = {"ingested_at": F.lit("2024-01-01T10:00:00").cast("timestamp"), "day": F.lit("2024-01-01").cast("date")}
    for name, df in (("runs", runs_of(spark, "a")), ("steps", trace.where("run_id = 'a'"))):
        df.withColumns(stamp).write.partitionBy("day").parquet(f"{at}/{name}")
    s = store.Store(spark, at)
    assert s.table("runs").count() == 1 and s.vacuum(0)["after"] > 0 and store.Store(spark, at).table("steps").count() == 5
    assert not (tmp_path / "store/runs").exists()


def test_live_states_fold_and_continue():
    state = live.FRESH
    for kind, tool in [("tool_call", "x")] * 4 + [("error", None)]:
        state = live.fold(state, kind, tool, 1.0, 2.0)
    assert state[1:5] == (5, 5.0, 10.0, "") and state[6:8] == (1, 1)
    state = live.fold(live.fold(state, "end", None, 0.0, 0.0), "plan", None, 1.0, 0.0)
    assert state[:3] == (2, 1, 1.0)


def streamed(spark, tmp_path, frames, schema, make, mode):
    """What a stateful query gives for frames that arrive one after another."""
    query, out = None, []
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, n: out.append(df.collect()) if not df.isEmpty() else None).start()
        query.awaitTermination()
    return out


def test_spans_become_runs_by_trace(spark, tmp_path):
    span = lambda t, i, parent, k: (t, f"{t}{i}", parent, k, "plan", "p", None, "2024-01-01T00:00:00.000Z", 1.0, 0.5, 2.0)
    frames = [[span("x", 1, "x9", 1), span("y", 1, "y9", 2), span("x", 2, "x9", 0)], [span("x", 9, None, 3)], [span("x", 3, "x9", 4), span("y", 9, "", 5)]]
    out = streamed(spark, tmp_path, frames, live.SPAN, live.traced_steps, "append")
    rows = sorted((r["run_id"], r["index"], r["span_id"], r["final"]) for b in out for r in b)
    assert rows == [("otel-x", 0, "x2", False), ("otel-x", 1, "x1", False), ("otel-x", 2, "x9", True), ("otel-x-2", 0, "x3", False), ("otel-y", 0, "y1", False), ("otel-y", 1, "y9", True)]


def test_ended_runs_continue(spark, tmp_path):
    event = lambda k, kind: ("r", k, k, kind, None, None, 1.0, 0.0)
    out = streamed(spark, tmp_path, [[event(k, kind)] for k, kind in enumerate(("plan", "end", "plan", "plan"))], live.EVENT, live.live_runs, "update")
    assert [(r["run_id"], r["status"], r["steps"]) for b in out for r in b] == [("r", "running", 1), ("r", "completed", 1), ("r-2", "running", 1), ("r-2", "running", 2)]


def test_recordings_in_progress_are_analysed(spark, tmp_path):
    from stepforge.sources.recorder import Recorder

    r = Recorder("followed", str(tmp_path / "j"), "f1")
    for _ in range(3):
        r.step("tool_call", "Tool: db", "db", cost=1.0, input={"q": 1})
    r.step("error", "broke"), r.step("plan", "p")
    runs, warned = live.provisional(*traces.journals(traces.lines(spark, str(tmp_path / "j"))))
    row = runs.first()
    assert (row["status"], row["run_hash"], row["steps"], row["cost"], row["chain_ok"]) == ("running", "", 5, 3.0, True) and warned.count() == 2


def long_steps(spark):
    """A long run and short ones whose calls repeat in many ways, over ranges that cut them anywhere."""
    rng, rows = random.Random(8), []
    for run, n in (("long", 700), ("r1", 3), ("r2", 40), ("s", 1)):
        kind, tool, text = "plan", None, None
        for i in range(n):
            if rng.random() < 0.2:
                kind, tool = rng.choice([("tool_call", "a"), ("tool_call", "b"), ("plan", None), ("tool_call", None), ("approval", "a")])
                text = rng.choice(['{"k":1}', None, '"x"'])
            said = rng.choice(['{"k":1}', '{ "k": 1.0}']) if text == '{"k":1}' else rng.choice([None, "null"]) if text is None else text
            rows.append(step(run, i, kind, tool, input=said, cost=float(rng.randint(0, 9)), tokens=1.0))
    return steps_of(spark, rows)


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_long_runs_over_ranges_give_what_windows_give(spark, partitions):
    steps = long_steps(spark).cache()
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    columns = ("run_id", "index", "cum_tokens", "cum_cost", "cum_duration_ms", "cum_steps")
    assert rows(long_runs.running(steps, partitions), *columns) == rows(analyze.running(steps), *columns)
    columns = ("run_id", "tool_name", "run_length", "first_index", "last_index")
    for by_tool in (False, True):
        want = rows(analyze.loops(steps, by_tool=by_tool), *columns)
        assert rows(long_runs.loops(steps, by_tool=by_tool, partitions=partitions), *columns) == want and len(want) > 20
    chained = integrity.chain(steps.withColumn("canonical", F.concat("id", F.lit("x")))).cache()
    spoiled = chained.withColumn("canonical", F.when(F.col("run_id").isin("long", "s") & (F.col("pos") % 300 == 299), "y").otherwise(F.col("canonical"))).withColumn("hash", F.when((F.col("run_id") == "r2") & (F.col("pos") == 20), "z").otherwise(F.col("hash")))
    for df in (chained, spoiled):
        assert rows(long_runs.broken_links(df, partitions=partitions), "run_id", "broken_index") == rows(integrity.broken_links(df), "run_id", "broken_index")
    assert long_runs.is_long(steps, 699) and not long_runs.is_long(steps, 700)
    assert rows(long_runs.by_size(steps, analyze.running, long_runs.running, 5), "run_id", "index", "cum_cost") == rows(analyze.running(steps), "run_id", "index", "cum_cost")


def test_long_runs_are_numbered_across_ranges(spark):
    rng = random.Random(8)
    rows = [("long" if i % 3 else f"r{i % 11}", f"2024-01-01T00:00:{rng.randrange(60):02d}.000Z", i) for i in range(900)]
    df = spark.createDataFrame(rows, "run_id string, started_at string, ord int")
    wide = sorted((r["id"], r["ord"]) for r in long_runs.assemble(df, partitions=7).collect())
    assert wide == sorted((r["id"], r["ord"]) for r in analyze.assemble(df).collect())
    assert long_runs.assemble(df.where("false")).count() == 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    texts = {"a.jsonl": "".join(f"line {i}\n" * (i % 3 != 1) + "\n" * (i % 3 == 1) for i in range(900)), "b.jsonl": "one\ntwo", "c.jsonl": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("300b", "64m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted((r["file"].split("/")[-1], r["line"], r["raw"]) for r in traces.lines(spark, str(tmp_path)).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == sorted((n, i, x) for n, t in texts.items() for i, x in enumerate(t.removesuffix("\n").split("\n") if t else [], 1))


def test_median_and_warnings(spark):
    df = steps_of(spark, [step("r", i, "plan", cost=c) for i, c in enumerate([0.0, 1.0, 2.0, 10.0, 20.0])])
    assert analyze.median_cost(df).first()["median_cost"] == 6.0
    assert [(r["kind"], r["message"]) for r in analyze.warnings(df).collect()] == [("high_cost_step", "Step #4 (plan) cost 20.00 — over 3x the median step cost (6.00).")]
