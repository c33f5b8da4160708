"""Command line over a store: python -m stepforge.cli --store PATH COMMAND ...

Exit code 1: a record that was tampered with, a policy violation, a difference under --fail-on-change, or a failed anchor.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import crypto
from .operators import analyze, anchors, diff, integrity, policy, proofs, redact, report, sweep
from .operators.store import GRACE, Store
from .schema import Wire
from .shared import new_path
from .sources import anchor_sink, recorder, traces
from .streaming import live, stateful

COMMANDS = "open sessions demo verify check diff search report list serve tail watch recover keygen redact vacuum export anchor".split()


def session() -> SparkSession:
    spark = SparkSession.builder.appName("stepforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def show(rows: DataFrame, as_json: bool = False, most: int = 1000) -> None:
    for r in rows.limit(most).collect():
        print(json.dumps(r.asDict(recursive=True), default=str) if as_json else "  ".join(f"{k}={v}" for k, v in r.asDict().items()))


class Cli:
    def __init__(self, spark: SparkSession, path: str, wire: Wire):
        self.spark, self.store, self.wire = spark, Store(spark, path), wire

    def ingest(self, runs: DataFrame, steps: DataFrame, rules: policy.Policy | None = None, batch: tuple[str, int] | None = None) -> sweep.Counts:
        """Analyse, seal and store drafts; runs that are stored already are left out."""
        return sweep.sweep(self.store, runs, steps, recorder.now()[:19], rules, batch)

    def save(self, runs: DataFrame, steps: DataFrame) -> None:
        self.store.save(sweep.with_marks(runs), steps, recorder.now()[:19])

    def frames(self, run_id: str | None = None) -> tuple[DataFrame, DataFrame]:
        runs, steps = self.store.table("runs"), self.store.table("steps")
        if runs is None:
            raise SystemExit("the store is empty")
        return self.store.run(run_id) if run_id else (runs, steps)

    def take(self, docs: DataFrame, trigger: int | None = None) -> int:
        """Store native documents and OTLP exports; those refused are printed and counted, and nothing of them is stored.

        trigger: of the stream that brought them; one that is replayed stores nothing.
        """
        refused = 0
        for name, read in (("native", traces.native), ("otlp", lambda d: traces.otlp(d, self.wire))):
            if (some := docs.where(F.col("format") == name)).isEmpty():
                continue
            runs, steps, bad = read(some)
            for r in bad.toLocalIterator():
                refused += 1
                print(f"refused {r['path']}: {r['reason']}", file=sys.stderr)
            self.ingest(runs.select("run_id", "name", "currency", "declared"), steps, batch=None if trigger is None else (f"serve {name}", trigger))
        return refused

    # ---- commands

    def open(self, a) -> int:
        docs = traces.with_format(traces.documents(self.spark, a.file))
        if a.file.endswith(".jsonl"):
            prices = self.spark.createDataFrame([], "model string, price_in double, price_out double, ord int")
            self.ingest(*traces.sessions(traces.lines(self.spark, a.file), prices, (a.price_in, a.price_out)))
        else:
            refused = self.take(docs)
            sealed, steps, _ = traces.envelopes(docs.where("format is null or text like '%runHash%'"))
            if not sealed.isEmpty():
                self.save(sealed.drop("warnings"), steps)
            return int(refused > 0)
        return 0

    def demo(self, a) -> int:
        r = recorder.Recorder("Demo: a payment check that loops", run_id=a.id)
        r.step("user_input", "Is payment 17 settled?", input="Is payment 17 settled?", duration_ms=5)
        for _ in range(3):
            r.step("tool_call", "Tool: payment_status", "payment_status", cost=0.02, duration_ms=60, input={"id": 17}, output={"status": "pending"})
        r.step("error", "gave up", duration_ms=1)
        folder = Path(a.folder)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{r.run_id}.json").write_text(json.dumps(recorder.envelope(r.end())))
        runs, steps, _ = traces.envelopes(traces.documents(self.spark, f"file://{folder.resolve()}/{r.run_id}.json"))
        self.save(runs.drop("warnings"), steps)
        return 0

    def sessions(self, a) -> int:
        show(traces.session_summaries(traces.lines(self.spark, a.folder)), a.json)
        return 0

    def verify(self, a) -> int:
        found = integrity.verify_full(*self.frames(a.run), self.wire)
        show(found, a.json)
        return int(not found.where("not all_ok").isEmpty())

    def check(self, a) -> int:
        runs, steps = self.frames(a.run)
        heads = runs.select("run_id", "totals.cost", "totals.tokens", "totals.steps", F.col("signature").isNotNull().alias("signed"))
        broken = policy.evaluate(heads, steps, analyze.warnings(steps), policy.parse_policy(Path(a.policy).read_text()))
        verdicts = integrity.verify_full(runs, steps, self.wire)
        if a.markdown:
            print(report.ci_markdown(verdicts.withColumn("ok", F.col("all_ok")), broken))
        else:
            show(broken, a.json)
        return int(not broken.isEmpty() or not verdicts.where("not all_ok").isEmpty())

    def diff(self, a) -> int:
        runs, steps = self.frames()
        two = runs.where(F.col("run_id").isin(a.a, a.b)).select("run_id", "currency").collect()
        if len(two) != len({a.a, a.b}):
            raise SystemExit("both runs must be stored")
        pairs = self.spark.createDataFrame([("pair", a.a, a.b, len({r["currency"] for r in two}) == 1)], "pair string, a_run string, b_run string, same_currency boolean")
        own = steps.where(F.col("run_id").isin(a.a, a.b)).join(runs.select("run_id", "hash_version"), "run_id")
        aligned = diff.alignments(pairs, own, exact=a.exact)
        leaves = diff.leaf_differences(aligned, pairs, diff.leaf_rows(own, wire=self.wire))
        found = diff.step_differences(aligned, pairs, own, leaves)
        show(diff.summary(found), a.json)
        show(found.where("kind <> 'same'").orderBy("ord"), a.json)
        place = F.row_number().over(analyze.Window.partitionBy("ord").orderBy("path"))
        show((leaves if a.all else leaves.withColumn("n", place).where("n <= 12").drop("n")).orderBy("ord", "path"), a.json)
        same = diff.equivalent(pairs, diff.summary(found), diff.warning_differences(pairs, aligned, own, analyze.warnings(own))).first()["equivalent"]
        return int(a.fail_on_change and not same)

    def search(self, a) -> int:
        self.frames()
        show(self.store.search(a.text, a.limit), a.json)
        return 0

    def report(self, a) -> int:
        runs, steps = self.frames(a.run)
        Path(a.out).write_text(report.html(runs, steps, integrity.verify_full(runs, steps, self.wire), analyze.warnings(steps), a.run))
        return 0

    def list(self, a) -> int:
        show(self.store.list(), a.json)
        return 0

    def serve(self, a) -> int:
        """Ingest what lands in a folder, trigger by trigger; keep what is younger than --keep-days."""
        text = self.spark.readStream.text(a.folder, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))

        def take(batch: DataFrame, number: int) -> None:
            self.take(traces.with_format(batch), number)
            if a.keep_days and self.store.table("runs") is not None:
                self.store.prune(time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(time.time() - 86400 * a.keep_days)))

        writer = text.writeStream.option("checkpointLocation", f"{self.store.path}/_serve").foreachBatch(take)
        query = (writer.trigger(availableNow=True) if a.once else writer.trigger(processingTime="10 seconds")).start()
        query.awaitTermination()
        return 0

    def tail(self, a) -> int:
        """Follow a journal folder, or one run in it: steps as they come, each warning once."""
        told = stateful.followed(self.spark, a.folder)

        def tell(batch: DataFrame, number: int) -> None:
            for r in batch.toLocalIterator():
                e = {k: v for k, v in r.asDict().items() if v is not None and k != "file"}
                print(json.dumps(e, ensure_ascii=False) if a.json else "  ".join(str(v) for k, v in e.items() if k not in ("step_ids", "event") or v == "warning"))

        writer = (told.where(F.col("run_id") == a.run) if a.run else told).writeStream.option("checkpointLocation", a.checkpoint or new_path(self.spark, "tail")).foreachBatch(tell)
        query = (writer.trigger(availableNow=True) if a.once else writer.trigger(processingTime=f"{max(100, a.interval)} milliseconds")).start()
        query.awaitTermination()
        return 0

    def settled(self, a) -> tuple[DataFrame, DataFrame]:
        recordings, steps = traces.journals(traces.lines(self.spark, a.folder))
        have = self.store.table("runs")
        fresh = live.settled_files(recordings, recorder.now(), a.settle, have if have is not None else recordings.where("false"))
        return fresh, steps.join(fresh.select("run_id"), "run_id", "left_semi")

    def recover(self, a) -> int:
        """Store journals that were left behind: as they ended, else failed; broken and empty ones are refused."""
        fresh, steps = self.settled(a)
        good = live.recoverable(fresh, integrity.broken_links(steps.withColumn("canonical", integrity.canonical_step(2))))
        heads = good.select("run_id", "name", "currency", "started_at", "status", "hash_version").join(analyze.bounds(steps).select("run_id", "ended_at"), "run_id")
        sums = analyze.exact_totals(steps).select("run_id", F.struct("tokens", "cost", F.col("duration_ms").alias("durationMs"), "steps").alias("totals"))
        heads = heads.join(sums, "run_id").join(integrity.anchors(steps).select("run_id", "anchor", F.col("steps").alias("step_count")), "run_id")
        runs = integrity.run_hash(heads).withColumnRenamed("expected_hash", "run_hash").drop("anchor", "step_count")
        self.save(runs, steps.join(good.select("run_id"), "run_id", "left_semi"))
        return 0

    def watch(self, a) -> int:
        """Sweep session logs that have settled, once or for ever, and count; a log that grows later isn't read again."""
        rules = policy.parse_policy(Path(a.policy).read_text()) if a.policy else None
        while True:
            raw = traces.lines(self.spark, a.folder)
            idle = raw.where(F.col("modified") <= F.lit(recorder.now()).cast("timestamp") - F.make_dt_interval(secs=F.lit(a.settle)))
            if not idle.isEmpty():
                prices = self.spark.createDataFrame([], "model string, price_in double, price_out double, ord int")
                done = self.ingest(*traces.sessions(idle, prices, (a.price_in, a.price_out)), rules)
                if done.ingested or not a.json:
                    print(json.dumps(asdict(done)))
            if a.once:
                return 0
            time.sleep(max(5, a.every))

    def keygen(self, a) -> int:
        folder = Path(a.folder)
        if (folder / "private.pem").exists():
            raise SystemExit("keys are there already")
        folder.mkdir(parents=True, exist_ok=True)
        private, public = crypto.keys()
        (folder / "private.pem").touch(mode=0o600)
        (folder / "private.pem").write_text(private)
        (folder / "public.pem").write_text(public)
        print(crypto.key_id(public))
        return 0

    def redact(self, a) -> int:
        runs, steps = self.frames(a.run)
        out = redact.redact(steps.drop("ingested_at", "day"), recorder.now(), tuple(a.path), tuple(a.pattern), a.reason, legacy=a.legacy, wire=self.wire)
        show(out.where(F.size("redacted_paths") > 0).select("id", "redacted_paths"), a.json)
        if not a.yes:
            return 0
        temp = f"{self.store.path}/_redacted"
        out.drop("redacted_paths").write.mode("overwrite").parquet(temp)
        done = self.spark.read.parquet(temp)
        if a.legacy:
            version = runs.first()["hash_version"] or 1
            done = integrity.chain(done.withColumn("canonical", integrity.canonical_step(version)), version=version).drop("canonical")
            heads = runs.join(integrity.anchors(done).select("run_id", "anchor", F.col("steps").alias("step_count")), "run_id")
            fixed = integrity.run_hash(heads).withColumns({"run_hash": F.col("expected_hash"), "signature": F.lit(None).cast(integrity.SIGNATURE), "redaction_seal": F.lit(None).cast(runs.schema["redaction_seal"].dataType)}).drop("anchor", "step_count", "expected_hash")
            fresh = {"runs": fixed, "steps": done}
        elif not integrity.verify_runs(runs, done, self.wire).where("not ok").isEmpty():
            raise SystemExit("the redacted record doesn't verify; nothing was stored")
        self.store.replace(fresh if a.legacy else {"steps": done})
        self.store.audit("redaction", {"run": a.run, "paths": a.path, "patterns": a.pattern, "reason": a.reason}, recorder.now())
        self.store.fs.delete(self.store.fs_path(temp), True)
        return 0

    def vacuum(self, a) -> int:
        print(json.dumps(self.store.vacuum(a.grace_hours)))
        return 0

    def export(self, a) -> int:
        runs, steps = self.frames(a.run)
        run = runs.first()
        if run is None:
            raise SystemExit(f"no run {a.run}")
        members = {"id": "id", "index": "index", "type": "type", "label": "label", "startedAt": "started_at", "durationMs": "duration_ms", "tokens": "tokens", "cost": "cost", "toolName": "tool_name", "spanId": "span_id", "parentSpanId": "parent_span_id", "hash": "hash", "prevHash": "prev_hash", "commitments": "commitments", "salts": "salts"}
        out = []
        for s in steps.orderBy("pos").toLocalIterator():
            one = {k: s[c] for k, c in members.items() if s[c] is not None} | {"runId": a.run}
            one |= {k: json.loads(s[c]) for k, c in (("input", "input"), ("output", "output"), ("dataPayload", "data_payload")) if s[c] is not None}
            one |= {"redactions": [{k: v for k, v in r.asDict().items() if v is not None} for r in s["redactions"]]} if s["redactions"] else {}
            out.append(one)
        head = {"id": a.run, "name": run["name"], "startedAt": run["started_at"], "endedAt": run["ended_at"], "status": run["status"], "currency": run["currency"], "totals": run["totals"].asDict(), "warnings": [], "steps": out, "runHash": run["run_hash"]}
        head |= {"hashVersion": run["hash_version"]} if run["hash_version"] is not None else {}
        head |= {k: run[c].asDict() for k, c in (("signature", "signature"), ("redactionSeal", "redaction_seal")) if run[c] is not None}
        Path(a.out).write_text(json.dumps(recorder.envelope(head), ensure_ascii=False))
        return 0

    def anchor(self, a) -> int:
        path = Path(a.file)
        raw = path.read_text().split("\n") if path.exists() else []
        lines = self.spark.createDataFrame([(a.file, i, x) for i, x in enumerate(raw, 1)], "file string, line int, raw string")
        records, (runs, _) = anchors.read_lines(lines), self.frames(a.run)
        if a.verify:
            say = anchors.statement(F.col("runId"), F.col("runHash"), F.col("keyId"), F.col("signature"), self.wire)
            pem = lambda p: Path(p).read_text() if p else None
            found = anchors.verify(runs, records, proofs.proofs(records.where("ok"), say, pem(a.tsa_cert), pem(a.log_key)))
            show(records.where("not ok").select("line", "problem"), a.json)
            show(found, a.json)
            return int(not found.where("not ok").isEmpty() or not records.where("not ok").isEmpty())
        if a.requests or a.answers:
            return self.prove(a, runs, records)
        new = anchors.fresh(runs.select("run_id", "run_hash", "signature.keyId", "signature.signature"), records.where("ok")).collect()
        entries = [{"runId": r["run_id"], "runHash": r["run_hash"], **({"keyId": r["keyId"], "signature": r["signature"]} if r["keyId"] else {}), "anchoredAt": recorder.now()} for r in new]
        last = next((x for x in reversed(raw) if x.strip()), None)
        with path.open("a") as f:
            f.writelines(x + "\n" for x in anchors.chained_lines(entries, last))
        return int(any(r["conflict"] for r in new))


    def prove(self, a, runs: DataFrame, records: DataFrame) -> int:
        """Write requests for timestamps of what isn't anchored yet, as <run>.tsq; or check the answers to them, <run>.tsr, and append."""
        if a.requests:
            new = anchors.fresh(runs.select("run_id", "run_hash", "signature.keyId", "signature.signature"), records.where("ok")).drop("conflict")
            anchor_sink.timestamp_requests(new, self.wire).write.mode("overwrite").parquet(f"{self.store.path}/_requests")
            for r in self.spark.read.parquet(f"{self.store.path}/_requests").toLocalIterator():
                Path(a.requests).mkdir(parents=True, exist_ok=True)
                Path(a.requests, f"{r['run_id']}.tsq").write_bytes(bytes(r["request"]))
            return 0
        asked = self.spark.read.parquet(f"{self.store.path}/_requests")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.tsr").load(a.answers)
        given = files.select(F.regexp_extract(F.url_decode("path"), r"([^/]*)\.tsr$", 1).alias("run_id"), F.col("content").alias("answer"))
        pem = Path(a.tsa_cert).read_text() if a.tsa_cert else None
        out = anchor_sink.store_anchors(asked, given, str(Path(a.file).resolve()), recorder.now(), pem)
        show(out, a.json)
        return int(not out.where("not proven").isEmpty())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stepforge", description=__doc__)
    p.add_argument("--store", default="runs-store")
    p.add_argument("--namespace", default="trace", help="what records of interoperating producers are marked with")
    sub = p.add_subparsers(dest="command", required=True)
    made = {c: sub.add_parser(c) for c in COMMANDS}
    for c in COMMANDS:
        made[c].add_argument("--json", action="store_true")
    for c in ("verify", "check", "anchor"):
        made[c].add_argument("run", nargs="?")
    for c in ("report", "export", "redact"):
        made[c].add_argument("run")
    for c in ("report", "export"):
        made[c].add_argument("--out", required=True)
    for c in ("sessions", "serve", "tail", "watch", "recover", "keygen"):
        made[c].add_argument("folder")
    made["tail"].add_argument("--run")
    made["tail"].add_argument("--checkpoint", help="a folder that remembers what was told; without it all is told from the start")
    made["tail"].add_argument("--interval", type=int, default=500, help="milliseconds between polls, 100 at least")
    for c in ("serve", "tail", "watch"):
        made[c].add_argument("--once", action="store_true")
    for c in ("watch", "recover"):
        made[c].add_argument("--settle", type=int, default=60)
    for c in ("open", "watch"):
        made[c].add_argument("--price-in", type=float, default=5.0, help="per million tokens")
        made[c].add_argument("--price-out", type=float, default=25.0)
    made["open"].add_argument("file")
    made["demo"].add_argument("--id")
    made["demo"].add_argument("--folder", default="demo")
    made["check"].add_argument("--policy", required=True)
    made["check"].add_argument("--markdown", action="store_true")
    made["diff"].add_argument("a")
    made["diff"].add_argument("b")
    made["diff"].add_argument("--exact", action="store_true", help="search runs of any length for their alignment")
    made["diff"].add_argument("--all", action="store_true")
    made["diff"].add_argument("--fail-on-change", action="store_true")
    made["search"].add_argument("text")
    made["search"].add_argument("--limit", type=int, default=50)
    made["serve"].add_argument("--keep-days", type=int, default=0)
    made["watch"].add_argument("--policy", help="rules that new runs are held against")
    made["watch"].add_argument("--every", type=int, default=30)
    for flag in ("--path", "--pattern"):
        made["redact"].add_argument(flag, action="append", default=[])
    made["redact"].add_argument("--reason")
    made["redact"].add_argument("--yes", action="store_true")
    made["redact"].add_argument("--legacy", action="store_true")
    made["vacuum"].add_argument("--grace-hours", type=float, default=GRACE, help="how long what is no longer named stays for open readers")
    made["anchor"].add_argument("--file", default="anchors.jsonl")
    made["anchor"].add_argument("--requests", help="a folder for requests to a timestamp authority")
    made["anchor"].add_argument("--answers", help="a folder with its answers")
    made["anchor"].add_argument("--verify", action="store_true")
    made["anchor"].add_argument("--tsa-cert")
    made["anchor"].add_argument("--log-key")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return getattr(Cli(spark or session(), a.store, Wire(a.namespace)), a.command)(a)


if __name__ == "__main__":
    sys.exit(main())
