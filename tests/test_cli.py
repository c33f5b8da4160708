"""The commands, end to end over one store."""

import json

from stepforge.cli import main
from stepforge.functions import second


def test_commands(spark, tmp_path, capsys):
    at = f"file://{tmp_path}/store"
    run = lambda *args: main(["--store", at, *map(str, args)], spark)
    doc = {"id": "n1", "name": "native", "steps": [{"type": "tool_call", "label": "call", "startedAt": "2024-01-01T00:00:00.000Z", "durationMs": 1, "toolName": "db", "input": {"mail": "bob@corp.example"}, "cost": 2}]}
    (tmp_path / "n.json").write_text(json.dumps(doc))
    assert run("demo", "--id", "d1", "--folder", tmp_path / "demo") == 0
    assert run("open", tmp_path / "n.json") == 0
    assert run("open", tmp_path / "n.json") == 0  # stored already: nothing happens
    assert run("list") == 0 and capsys.readouterr().out.count("run_id=") == 2
    assert run("verify", "--json") == 0
    assert all(json.loads(x)["all_ok"] for x in capsys.readouterr().out.splitlines())
    (tmp_path / "p.json").write_text('{"rules":{"maxCostPerRun":1}}')
    assert run("check", "--policy", tmp_path / "p.json") == 1 and "n1" in capsys.readouterr().out
    assert run("check", "d1", "--policy", tmp_path / "p.json", "--markdown") == 0
    assert run("diff", "n1", "d1", "--fail-on-change") == 1 and run("diff", "d1", "d1", "--fail-on-change") == 0
    capsys.readouterr()
    assert run("search", "corp.example") == 0 and "n1" in capsys.readouterr().out
    assert run("report", "d1", "--out", tmp_path / "r.html") == 0 and "intact" in (tmp_path / "r.html").read_text()
    assert run("redact", "n1", "--pattern", "email") == 0 and run("search", "corp.example") == 0 and "n1:0" in capsys.readouterr().out
    assert run("redact", "n1", "--pattern", "email", "--yes") == 0
    capsys.readouterr()
    assert run("search", "corp.example") == 0 and not capsys.readouterr().out
    assert run("verify", "n1") == 0
    anchors = tmp_path / "anchors.jsonl"
    assert run("anchor", "--file", anchors) == 0 and run("anchor", "--file", anchors) == 0 and len(anchors.read_text().splitlines()) == 2
    assert run("anchor", "--file", anchors, "--verify") == 0
    anchors.write_text(anchors.read_text().splitlines()[1] + "\n")
    assert run("anchor", "--file", anchors, "--verify") == 1
    assert run("export", "d1", "--out", tmp_path / "e.json") == 0
    whole = (tmp_path / "e.json").read_text()
    assert second.verdicts(whole)["ok"] and second.verdicts(whole[:-9])["parsed"] is False
    for old, new, where in (("payment_status", "other_status", ("chain", 1)), ('"currency": "USD"', '"currency": "EUR"', ("anchor", None)), ('"hashVersion": 2', '"hashVersion": 3', ("version", None))):
        found = second.verdicts(whole.replace(old, new))
        assert found[where[0]] is False and found["broken"] == where[1] and not found["ok"], old
    other = f"file://{tmp_path}/other"
    assert main(["--store", other, "open", str(tmp_path / "e.json")], spark) == 0 and main(["--store", other, "verify"], spark) == 0
    text = (tmp_path / "e.json").read_text().replace("payment_status", "other_status")
    (tmp_path / "f.json").write_text(text)
    third = f"file://{tmp_path}/third"
    assert main(["--store", third, "open", str(tmp_path / "f.json")], spark) == 0 and main(["--store", third, "verify"], spark) == 1
    assert run("keygen", tmp_path / "keys") == 0 and (tmp_path / "keys/private.pem").exists()
    assert run("vacuum") == 0


def test_only_identical_inputs_are_a_loop(spark, tmp_path, capsys):
    at = f"file://{tmp_path}/store"
    call = lambda i, q: {"type": "tool_call", "label": "search", "startedAt": f"2024-01-01T00:00:0{i}.000Z", "durationMs": 1, "toolName": "search", "input": {"q": q}}
    for name, inputs in (("apart", [0, 1, 2, 3]), ("alike", [1, 1.0, 1, 2])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": name, "name": name, "steps": [call(i, q) for i, q in enumerate(inputs)]}))
        assert main(["--store", at, "open", str(tmp_path / f"{name}.json")], spark) == 0
    (tmp_path / "p.json").write_text('{"rules":{"forbidWarnings":["loop"]}}')
    assert main(["--store", at, "check", "apart", "--policy", str(tmp_path / "p.json")], spark) == 0
    assert main(["--store", at, "check", "alike", "--policy", str(tmp_path / "p.json")], spark) == 1
    assert main(["--store", at, "report", "apart", "--out", str(tmp_path / "r.html")], spark) == 0 and "in a row" not in (tmp_path / "r.html").read_text()
    assert main(["--store", at, "report", "alike", "--out", str(tmp_path / "r.html")], spark) == 0 and "called 3x in a row" in (tmp_path / "r.html").read_text()


def test_journals_are_recovered_and_served(spark, tmp_path, capsys):
    from stepforge.sources.recorder import Recorder

    at = f"file://{tmp_path}/store"
    r = Recorder("left behind", str(tmp_path / "journal"), "j1")
    r.step("plan", "p", input={"a": 1})
    assert main(["--store", at, "recover", str(tmp_path / "journal"), "--settle", "0"], spark) == 0
    assert main(["--store", at, "verify", "j1"], spark) == 0
    capsys.readouterr()
    assert main(["--store", at, "tail", str(tmp_path / "journal"), "--once"], spark) == 0 and "j1" in capsys.readouterr().out
    (tmp_path / "land").mkdir()
    (tmp_path / "land/x.json").write_text(json.dumps({"id": "s1", "name": "n", "steps": [{"type": "plan", "label": "p", "startedAt": "2024-01-01T00:00:00.000Z", "durationMs": 1}]}))
    assert main(["--store", at, "serve", str(tmp_path / "land"), "--once"], spark) == 0
    assert main(["--store", at, "verify", "s1"], spark) == 0
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.jsonl").write_text(json.dumps({"type": "user", "uuid": "u", "sessionId": "z", "timestamp": "2024-01-01T00:00:00.000Z", "message": {"content": "hello"}}))
    (tmp_path / "rules.json").write_text('{"rules":{"requireSignature":true}}')
    capsys.readouterr()
    for want in ({"ingested": 1, "skipped": 0, "violations": 1}, {"ingested": 0, "skipped": 1, "violations": 0}):
        assert main(["--store", at, "watch", str(tmp_path / "logs"), "--once", "--settle", "0", "--policy", str(tmp_path / "rules.json")], spark) == 0
        assert json.loads(capsys.readouterr().out.splitlines()[-1]) == want
    assert main(["--store", at, "anchor", "--requests", str(tmp_path / "asked"), "--file", str(tmp_path / "a.jsonl")], spark) == 0
    asked = sorted(p.name for p in (tmp_path / "asked").iterdir())
    assert asked == ["cc-z.tsq", "j1.tsq", "s1.tsq"]
    (tmp_path / "asked/j1.tsr").write_bytes(b"nonsense")
    assert main(["--store", at, "anchor", "--answers", str(tmp_path / "asked"), "--file", str(tmp_path / "a.jsonl")], spark) == 1
    assert len((tmp_path / "a.jsonl").read_text().splitlines()) == 3
    assert main(["--store", at, "anchor", "--verify", "--file", str(tmp_path / "a.jsonl")], spark) == 0
    assert main(["--store", at, "sessions", str(tmp_path / "logs")], spark) == 0
    capsys.readouterr()
    assert main(["--store", at, "list"], spark) == 0 and "cc-z" in capsys.readouterr().out
