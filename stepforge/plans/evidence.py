"""Queries over records as evidence: seals, verdicts, anchors, redaction, refusals, the store, and alignments known beforehand."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crypto, second
from ..operators import analyze, anchors, answers, diff, integrity, policy, redact, report, sweep
from ..operators.store import Store
from ..shared import new_path, spread, written
from ..sources import anchor_sink, driver, requests, traces
from .catalogue import ISO, STEPS, as_documents, query

AT = "2024-01-01T00:00:00.000Z"
EMPTY = {c: "string" for c in ("output", "data_payload", "span_id", "parent_span_id")} | {"commitments": "map<string,string>", "salts": "map<string,string>", "redactions": "array<struct<path:string,at:string,reason:string,by:string>>"}

#: Records of the events: whole numbers for costs, so that SQL can write their canonical text.
RECORDS = f"""{STEPS},
rec AS (SELECT run_id AS u, 'r' || run_id AS run_id, index, 'r' || run_id || ':' || index AS id, type, label, tool_name, event_id % 7 AS cost, CAST(tokens AS BIGINT) AS tokens, CAST(duration_ms AS BIGINT) AS ms,
  {ISO.format("ts")} AS started, '{{"k":' || CAST(json_extract(input, '$.k') AS VARCHAR) || '}}' AS input FROM steps),
texts AS (SELECT *, '{{"cost":' || cost || ',"durationMs":' || ms || ',"id":"' || id || '","index":' || index || ',"input":' || input || ',"label":"' || label || '","runId":"' || run_id || '","startedAt":"' || started || '","tokens":' || tokens
  || CASE WHEN tool_name IS NOT NULL THEN ',"toolName":"' || tool_name || '"' ELSE '' END || ',"type":"' || type || '"}}' AS t FROM rec),
chain AS (SELECT run_id, index, sha256('tgstep/2' || chr(0) || t || chr(0)) AS hash FROM texts WHERE index = 0
  UNION ALL SELECT x.run_id, x.index, sha256('tgstep/2' || chr(0) || x.t || chr(0) || c.hash) FROM chain c JOIN texts x ON x.run_id = c.run_id AND x.index = c.index + 1),
heads AS (SELECT u, run_id, min_by(started, index) AS first, max_by(started, index) AS last, count(*) AS n, sum(cost) AS cost, sum(tokens) AS tokens, sum(ms) AS ms, bool_or(type = 'error') AS failed, count(*) FILTER (WHERE type = 'approval') AS approvals FROM rec GROUP BY u, run_id),
tops AS (SELECT run_id, max_by(hash, index) AS anchor FROM chain GROUP BY run_id),
sealed AS (SELECT heads.*, sha256('tgrun/2' || chr(0) || '{{"chainAnchor":"' || anchor || '","currency":"USD","endedAt":"' || last || '","hashVersion":2,"id":"' || run_id || '","name":"n","startedAt":"' || first || '","status":"'
  || CASE WHEN failed THEN 'failed' ELSE 'completed' END || '","stepCount":' || n || ',"totals":{{"cost":' || cost || ',"durationMs":' || ms || ',"steps":' || n || ',"tokens":' || tokens || '}}}}') AS run_hash FROM heads JOIN tops USING (run_id))"""
SEALED = f"WITH RECURSIVE {RECORDS}"


def records(spark, sf) -> DataFrame:
    s = driver.event_steps(spark, sf)
    name = F.concat(F.lit("r"), F.col("run_id").cast("string"))
    return s.select(F.col("run_id").alias("u"), name.alias("run_id"), "pos", F.concat_ws(":", name, "index").alias("id"), "index", "type", "label", "tool_name", "started_at", "duration_ms", "tokens", (F.col("ord") % 7).cast("double").alias("cost"), "input").withColumns({c: F.lit(None).cast(t) for c, t in EMPTY.items()})


def sealed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(runs, steps), sealed; steps keep the number of their user as `u`."""
    s = records(spark, sf)
    heads = analyze.summaries(s).select("run_id", F.lit("n").alias("name"), "started_at", "ended_at", "status", F.lit("USD").alias("currency"))
    runs, steps = integrity.seal(heads, s)
    return runs.withColumn("u", F.substring("run_id", 2, 20).cast("long")), steps


def keys() -> tuple[str, str]:
    seed = bytes(range(32))
    return crypto.pem(crypto.PKCS8 + seed, "PRIVATE KEY"), crypto.pem(crypto.SPKI + crypto.public_key(seed), "PUBLIC KEY")


@query(f"{SEALED} SELECT run_id, n AS steps, run_hash FROM sealed")
def sealed_runs(spark, sf):
    """The hash of each run: canonical steps, their chain and the header over it."""
    return sealed(spark, sf)[0].select("run_id", F.col("totals.steps").alias("steps"), "run_hash")


VERDICTS = f"{SEALED} SELECT run_id, CASE u % 5 WHEN 1 THEN 'chain' WHEN 2 THEN 'anchor' WHEN 3 THEN 'version' WHEN 4 THEN 'anchor' END AS failure, CASE u % 5 WHEN 1 THEN 1 WHEN 2 THEN n - 1 WHEN 4 THEN n - 1 END AS broken_index, CASE WHEN u % 5 IN (0, 2) THEN run_hash END AS right_hash FROM sealed"


def spoiled(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Of each five runs, one is left alone, and the others have a step, the run's hash, its version or its name changed."""
    runs, steps = sealed(spark, sf)
    changed = F.when((F.col("u") % 5 == 1) & (F.col("pos") == 1), F.concat("label", F.lit("!"))).otherwise(F.col("label"))
    runs = runs.withColumns({"run_hash": F.when(F.col("u") % 5 == 2, F.reverse("run_hash")).otherwise(F.col("run_hash")), "hash_version": F.when(F.col("u") % 5 == 3, 9).otherwise(F.col("hash_version")), "name": F.when(F.col("u") % 5 == 4, "m").otherwise(F.col("name"))})
    return runs, steps.withColumn("label", changed)


@query(VERDICTS)
def run_verdicts(spark, sf):
    runs, steps = spoiled(spark, sf)
    found = integrity.verify_runs(runs, steps)
    right = F.when(F.substring("run_id", 2, 20).cast("long") % 5 < 3, F.col("expected_hash"))
    return found.select("run_id", "failure", "broken_index", right.alias("right_hash"))


@query(VERDICTS.replace(", CASE WHEN u % 5 IN (0, 2) THEN run_hash END AS right_hash", ""))
def second_verdicts(spark, sf):
    """The same runs as records, judged by the second verifier."""
    said = spread(answers.records(*spoiled(spark, sf))).select("run_id", "n", second.second_opinion("text").alias("x"))
    failure = F.when(~F.col("x.version"), "version").when(~F.col("x.chain"), "chain").when(~F.col("x.anchor"), "anchor")
    at = F.coalesce("x.broken", F.when(failure == "anchor", F.col("n") - 1))
    return said.select("run_id", failure.alias("failure"), at.alias("broken_index"))


FULL = f"{SEALED} SELECT run_id, TRUE AS ok, u % 7 <> 0 AS signature_ok, NOT (u % 2 = 0 AND u % 3 = 0) AS seal_ok, u % 2 = 0 AND u % 3 <> 0 AS attested, u % 7 <> 0 AND NOT (u % 2 = 0 AND u % 3 = 0) AS all_ok, CASE WHEN u % 2 = 0 THEN n ELSE 0 END AS redacted FROM sealed"


def redacted_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Runs with committed payloads, signed. Even ones have their inputs redacted and that sealed; every third seal and every seventh signature is spoiled."""
    s = redact.commit(records(spark, sf), salt=lambda step, path: f"s{step}")
    heads = analyze.summaries(s).select("run_id", F.lit("n").alias("name"), "started_at", "ended_at", "status", F.lit("USD").alias("currency"))
    runs, steps = integrity.seal(heads, s)
    private, public = keys()
    erased = redact.redact(steps.where("u % 2 = 0"), AT, paths=("input.k",)).drop("redacted_paths")
    steps = written(erased.unionByName(steps.where("u % 2 = 1")), "redacted-steps")
    u = F.substring("run_id", 2, 20).cast("long")
    runs = integrity.seal_redactions(integrity.sign_runs(runs, private, public, AT), steps, private, public, AT)
    spoil = lambda c, name, where: F.when(where & F.col(c).isNotNull(), F.col(c).withField(name, F.lit("2025-01-01T00:00:00.000Z"))).otherwise(F.col(c))
    runs = runs.withColumns({"signature": spoil("signature", "signedAt", u % 7 == 0), "redaction_seal": spoil("redaction_seal", "sealedAt", u % 3 == 0)})
    return written(runs, "redacted-runs"), steps


@query(FULL)
def full_verdicts(spark, sf):
    found = integrity.verify_full(*redacted_runs(spark, sf))
    return found.select("run_id", "ok", "signature_ok", "seal_ok", "attested", "all_ok", F.size("redacted").cast("long").alias("redacted"))


@query(FULL.replace(", CASE WHEN u % 2 = 0 THEN n ELSE 0 END AS redacted", ""))
def second_full_verdicts(spark, sf):
    """The same by the second verifier: commitments, signatures and seals."""
    x = spread(answers.records(*redacted_runs(spark, sf))).select("run_id", second.second_opinion("text").alias("x"))
    fine = F.col("x.parsed") & F.col("x.version") & F.col("x.chain") & F.col("x.commitments") & F.col("x.anchor")
    return x.select("run_id", fine.alias("ok"), F.col("x.signature").alias("signature_ok"), F.col("x.seal").alias("seal_ok"), "x.attested", F.col("x.ok").alias("all_ok"))


@query(f"{SEALED} SELECT run_id, TRUE AS authentic, n AS steps, approvals, TRUE AS complete FROM sealed")
def compliance_rows(spark, sf):
    runs, steps = sealed(spark, sf)
    runs = runs.withColumns({"signature": F.lit(None).cast(integrity.SIGNATURE), "redaction_seal": F.lit(None).cast(integrity.SEAL)})
    return report.compliance(runs, steps, integrity.verify_full(runs, steps)).select("run_id", "authentic", "steps", "approvals", "complete")


# ---- anchors ----------------------------------------------------------------------------------------------------


@query(f"WITH {STEPS}, x AS (SELECT DISTINCT run_id, 'trace-anchor-v2' || chr(10) || 'runId: \"r' || run_id || '\"' || chr(10) || 'runHash: \"' || sha256('r' || run_id) || '\"' || chr(10) || 'keyId: ' || CASE WHEN run_id % 2 = 0 THEN 'null' ELSE '\"k\"' END || chr(10) || 'signature: ' || CASE WHEN run_id % 2 = 0 THEN 'null' ELSE '\"s\\\"\"' END || chr(10) AS t FROM steps) SELECT 'r' || run_id AS run_id, t AS statement, sha256(t) AS digest FROM x")
def anchor_statements(spark, sf):
    runs = driver.table(spark, sf, "events").select("user_id").distinct()
    name, odd = F.concat(F.lit("r"), F.col("user_id").cast("string")), F.col("user_id") % 2 == 1
    text = anchors.statement(name, F.sha2(name, 256), F.when(odd, "k"), F.when(odd, 's"'))
    return runs.select(name.alias("run_id"), text.alias("statement")).withColumn("digest", anchors.digest(F.col("statement")))


def anchored(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(runs, records): of three runs one has its hash on record, every other of these twice, one another hash, one nothing; and a stranger for each."""
    users = driver.table(spark, sf, "events").select(F.col("user_id").alias("u")).distinct()
    name = F.concat(F.lit("r"), F.col("u").cast("string"))
    runs = users.select("u", name.alias("run_id"), F.sha2(name, 256).alias("run_hash"))
    one = lambda where, runId, hash_: runs.where(where).select(runId.alias("runId"), hash_.alias("runHash"))
    right, own = F.col("run_hash"), F.col("run_id")
    lines = one("u % 3 = 0", own, right).unionByName(one("u % 6 = 0", own, right)).unionByName(one("u % 3 = 1", own, F.lit("other"))).unionByName(one("true", F.concat(F.lit("x"), "run_id"), right))
    raw = F.to_json(F.struct(F.lit(1).alias("version"), "runId", "runHash"))
    return runs, anchors.read_lines(lines.select(F.col("runId").alias("file"), F.monotonically_increasing_id().alias("line"), raw.alias("raw")))


@query("SELECT DISTINCT 'r' || user_id AS run_id, CASE WHEN user_id % 6 = 0 THEN 2 WHEN user_id % 3 < 2 THEN 1 ELSE 0 END AS found, user_id % 3 = 0 AS matched, CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END AS mismatched, CASE WHEN user_id % 3 = 0 THEN 'local' ELSE 'none' END AS strength, user_id % 3 <> 1 AS ok FROM events")
def anchor_strengths(spark, sf):
    runs, found = anchored(spark, sf)
    return anchors.verify(runs, found).select("run_id", "found", "matched", "mismatched", "strength", "ok")


@query("SELECT DISTINCT 'r' || user_id AS run_id, user_id % 3 = 1 AS conflict FROM events WHERE user_id % 3 <> 0")
def anchor_candidates(spark, sf):
    runs, found = anchored(spark, sf)
    return anchors.fresh(runs, found.where("ok")).select("run_id", "conflict")


@query("SELECT DISTINCT 'xr' || user_id AS run_id FROM events")
def anchor_orphans(spark, sf):
    runs, found = anchored(spark, sf)
    return anchors.orphans(found.where("ok"), runs).select(F.col("runId").alias("run_id"))


def logged_anchors(spark, sf) -> tuple[DataFrame, DataFrame, str]:
    """(runs, outcomes, file): requests to a log for every run: one of three has an answer that holds, one that of another statement, one none; all are stored in a chained file."""
    private, public = keys()
    name = F.concat(F.lit("r"), F.col("u").cast("string"))
    runs = driver.table(spark, sf, "events").select(F.col("user_id").alias("u")).distinct().select("u", name.alias("run_id"), F.sha2(name, 256).alias("run_hash"), *[F.lit(None).cast("string").alias(c) for c in ("keyId", "signature")])
    base = new_path(spark, "anchored")
    anchor_sink.log_requests(runs, private, public).write.parquet(f"{base}/asked")
    asked = spark.read.parquet(f"{base}/asked")
    stranger = anchor_sink.log_requests(runs.withColumn("run_hash", F.lit("other")), private, public)

    @F.pandas_udf("binary")
    def entry(requests: pd.Series) -> pd.Series:
        return requests.map(lambda x: json.dumps({"id": {"body": base64.b64encode(x.encode()).decode(), "integratedTime": 1, "inclusionProof": {"logIndex": 0, "treeSize": 1, "hashes": [], "rootHash": crypto.leaf_hash(x.encode()).hex()}}}).encode())

    given = asked.where("u % 3 = 0").unionByName(stranger.where("u % 3 = 1")).select("run_id", entry("request").alias("answer"))
    return runs, anchor_sink.store_anchors(asked, given, f"{base}/anchors.jsonl", AT), f"{base}/anchors.jsonl"


@query("SELECT DISTINCT 'r' || user_id AS run_id, user_id % 3 = 0 AS proven, CASE user_id % 3 WHEN 1 THEN 'the entry covers another digest; the entry''s signature doesn''t hold over the statement' WHEN 2 THEN 'no answer' END AS error, TRUE AS stored FROM events")
def anchors_answered(spark, sf):
    _, out, path = logged_anchors(spark, sf)
    stored = anchors.read_lines(traces.lines(spark, path)).where("ok").select("runId", F.lit(True).alias("stored"))
    return out.join(stored, "runId", "left").select(F.col("runId").alias("run_id"), "proven", "error", F.coalesce("stored", F.lit(False)).alias("stored"))


# ---- redaction, folding, access ---------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"k":"[trace:redacted]"}' ELSE props END AS input, CASE WHEN event_id % 3 = 0 THEN 'input.k' END AS path, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS salts FROM events""")
def redacted_steps(spark, sf):
    """Every third event's leaf is erased by its path; its commitment stays and its salt goes."""
    s = records(spark, sf).withColumn("id", F.col("id")).join(driver.event_steps(spark, sf).select(F.concat_ws(":", F.concat(F.lit("r"), F.col("run_id").cast("string")), "index").alias("id"), F.col("ord").alias("event_id")), "id")
    s = redact.commit(s, salt=lambda step, path: f"s{step}")
    done = redact.redact(s.where("event_id % 3 = 0"), AT, paths=("input.k",)).drop("redacted_paths").unionByName(s.where("event_id % 3 <> 0"))
    return done.select("event_id", "input", F.when(F.size("redactions") > 0, F.col("redactions")[0]["path"]).alias("path"), F.size(F.map_keys("salts")).alias("salts"))


@query("SELECT event_id, event_type AS tool, event_type IN ('click', 'view') AS hit FROM events")
def folded_tools(spark, sf):
    """Tool names in full width, with invisible characters, blanks and capitals fold to plain ones before they are matched."""
    t, k = F.col("event_type"), F.col("event_id") % 4
    wide = F.translate(t, "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26)))
    odd = F.when(k == 0, wide).when(k == 1, F.concat(F.lit("​"), F.upper(t), F.lit("﻿"))).when(k == 2, F.concat(F.lit("  "), t, F.lit(" "))).otherwise(t)
    hit = policy.tool_matches(F.col("tool"), "Cli*") | policy.tool_matches(F.col("tool"), "*iew")
    return driver.table(spark, sf, "events").select("event_id", policy.folded(odd).alias("tool")).withColumn("hit", hit)


ACCESS = "CASE event_id % 6 WHEN 0 THEN 'READ' WHEN 1 THEN 'MUTATED' WHEN 3 THEN 'READ' WHEN 4 THEN CASE WHEN event_type IN ('error', 'signup') THEN 'MUTATED' ELSE 'READ' END END"


@query(f"SELECT event_id, {ACCESS} AS access, CASE WHEN event_id % 6 IN (0, 1) THEN 't' || event_id % 5 END AS tab FROM events")
def payload_access(spark, sf):
    """Payloads that say how they were touched, in any case; lists and records that don't; a present null; none."""
    k = F.col("event_id") % 6
    table = F.concat(F.lit(',"table":"t'), (F.col("event_id") % 5).cast("string"), F.lit('"}'))
    payload = F.when(k == 0, F.concat(F.lit('{"_access":"read"'), table)).when(k == 1, F.concat(F.lit('{"_access":"Mutated"'), table)).when(k == 2, "null").when(k == 3, "[1]").when(k == 4, '{"a":1}')
    kind = F.when(F.col("event_type") == "error", "final_output").when(F.col("event_type") == "signup", "branch").otherwise("tool_call")
    e = driver.table(spark, sf, "events").select("event_id", payload.alias("p"), kind.alias("kind"))
    return e.select("event_id", report.access(F.col("p"), F.col("kind")).alias("access"), report.payload_table(F.col("p")).alias("tab"))


# ---- messages ---------------------------------------------------------------------------------------------------

#: A number with two places, exact ties away from zero: those lie at eighths.
PLACES = "CASE WHEN {0} * 8 = floor({0} * 8) THEN printf('%.2f', floor({0} * 100 + 0.5) / 100) ELSE printf('%.2f', {0}) END"


@query(f"WITH x AS (SELECT event_id, event_id / 8.0::DOUBLE AS eighth, event_id / 1000.0::DOUBLE + 0.005::DOUBLE AS half FROM events) SELECT event_id, {PLACES.format('eighth')} AS eighth, {PLACES.format('half')} AS half FROM x")
def two_place_texts(spark, sf):
    id_ = F.col("event_id").cast("double")
    return driver.table(spark, sf, "events").select("event_id", analyze.two_places(id_ / 8).alias("eighth"), analyze.two_places(id_ / 1000 + F.lit(0.005)).alias("half"))


@query(f"""WITH {STEPS}, medians AS (SELECT run_id, median(cost) FILTER (WHERE cost > 0) AS m FROM steps GROUP BY run_id), high AS (SELECT s.*, m FROM steps s JOIN medians USING (run_id) WHERE m > 0 AND cost > 3 * m)
SELECT run_id, index, 'Step #' || index || ' (' || label || ') cost ' || {PLACES.format('cost')} || ' — over 3x the median step cost (' || {PLACES.format('m')} || ').' AS message FROM high
UNION ALL SELECT run_id, index, 'Error at step #' || index || ': ' || label FROM steps WHERE type = 'error'""")
def warning_messages(spark, sf):
    s = driver.event_steps(spark, sf)
    found = analyze.warnings(s).where("kind <> 'loop'")
    return found.select("run_id", F.element_at(F.split(found["step_ids"][0], ":"), -1).cast("long").alias("index"), "message")


# ---- sources ----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS path, CASE user_id % 4 WHEN 0 THEN 'otlp' WHEN 1 THEN 'native' END AS format FROM events")
def trace_formats(spark, sf):
    docs = as_documents(spark, sf, "otlp").where("path % 4 = 0").unionByName(as_documents(spark, sf, "native").where("path % 4 = 1"))
    other = driver.table(spark, sf, "events").select("user_id").distinct().where("user_id % 4 > 1")
    rest = other.select(F.col("user_id").cast("string").alias("path"), F.when(F.col("user_id") % 4 == 2, '{"steps":[]}').otherwise('{"id":"x","resourceSpans":{').alias("text"))
    return traces.with_format(docs.unionByName(rest)).select("path", "format")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS steps, CASE user_id % 5 WHEN 1 THEN 'steps[0].type' WHEN 2 THEN 'name' WHEN 3 THEN 'steps[0].durationMs' END AS reason FROM events GROUP BY user_id")
def native_refusals(spark, sf):
    """Three of five documents break the schema and are refused whole; the steps of the others are all there."""
    docs, k = as_documents(spark, sf, "native"), F.col("path").cast("long") % 5
    spoiled = F.when(k == 1, F.regexp_replace("text", '^(.*?)"type":"', '$1"type":"x')).when(k == 2, F.regexp_replace("text", '^(.*?)"name":"run"', '$1"name":7')).when(k == 3, F.regexp_replace("text", '^(.*?)"durationMs":', '$1"durationMs":-1')).otherwise(F.col("text"))
    _, steps, refused = traces.native(docs.withColumn("text", spoiled))
    whole = driver.event_steps(spark, sf).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("steps"))
    read = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps")).withColumn("reason", F.lit(None).cast("string"))
    return read.unionByName(refused.join(whole, "run_id").select("run_id", "steps", "reason"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS path, 'the run is in ' || user_id // 2 * 2 AS reason FROM events WHERE user_id % 2 = 1 AND user_id - 1 IN (SELECT user_id FROM events) AND length(CAST(user_id AS VARCHAR)) = length(CAST(user_id - 1 AS VARCHAR))")
def otlp_refusals(spark, sf):
    """Two users' exports name one run: the first by path stays whole."""
    docs = as_documents(spark, sf, "otlp")
    shared = F.regexp_replace("text", '("key":"trace.run.id","value":\\{"stringValue":")(\\d+)', F.concat(F.lit("$1"), F.concat(F.lit("p"), F.floor(F.col("path").cast("long") / 2).cast("string"))))
    return traces.otlp(docs.withColumn("text", shared))[2].select("path", "reason")


@query("""WITH r AS (SELECT event_id, user_id, event_id % 7 AS k, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS n, ts FROM events),
a AS (SELECT *, CASE WHEN n > 5 THEN 429 WHEN k = 0 THEN 413 WHEN k IN (1, 2) THEN 400 END AS no FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY no, user_id ORDER BY ts, event_id) AS m FROM a)
SELECT event_id, coalesce(no, CASE WHEN user_id % 4 = 0 OR m > 1 THEN 200 ELSE 201 END) AS status, CASE WHEN no IS NULL THEN 'r' || user_id END AS run_id, CASE no WHEN 429 THEN 'too many requests' WHEN 413 THEN 'too large' WHEN 400 THEN CASE k WHEN 1 THEN 'unknown format' ELSE 'name' END END AS reason FROM b""")
def request_answers(spark, sf):
    """Each event as a request of its type: five an hour are let in; of these some are too large, of no format or faulty; a user's second one, or a stored one, stores nothing."""
    e = driver.table(spark, sf, "events")
    k, name = F.col("event_id") % 7, F.concat(F.lit('"id":"r'), F.col("user_id").cast("string"), F.lit('"'))
    text = F.when(k == 0, F.repeat(F.lit("x"), 400)).when(k == 1, "{}").when(k == 2, F.concat(F.lit("{"), name, F.lit(',"steps":[]}'))).when(k == 3, F.concat(F.lit('{"resourceSpans":[{"resource":{"attributes":[{"key":"trace.run.id","value":{"stringValue":"r'), F.col("user_id").cast("string"), F.lit('"}},{"key":"cicd.pipeline.run.id","value":{"stringValue":"77"}}]}}]}'))).otherwise(F.concat(F.lit("{"), name, F.lit(',"name":"n","steps":[]}')))
    sent = e.select("event_id", F.col("event_type").alias("client"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), text.alias("text"))
    stored = e.where("user_id % 4 = 0").select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"))
    return requests.answered(sent, stored, 300, 5, "1 hour").select("event_id", "status", "run_id", "reason")


@query("SELECT DISTINCT CAST(conv_id AS VARCHAR) AS file, 'cc-' || conv_id AS run_id FROM conversations")
def session_run_ids(spark, sf):
    e = driver.conversation_entries(spark, sf)
    raw = F.to_json(F.struct("type", F.col("file").cast("string").alias("sessionId")))
    return traces.session_run_ids(e.select(F.col("file").cast("string").alias("file"), "line", raw.alias("raw")))


@query("SELECT conv_id, CAST(sum(conv_id % 1000 + length(text)) AS DOUBLE) AS tokens FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def usage_tokens(spark, sf):
    e = driver.conversation_entries(spark, sf).where("type = 'assistant'")
    usage = F.from_json(F.to_json(F.struct("input_tokens", "output_tokens")), traces.USAGE)
    return e.groupBy(F.col("file").alias("conv_id")).agg(F.sum(traces.usage_tokens(usage)).alias("tokens"))


RUN_OF = "'r' || (event_id % 200)"


@query(f"""{SEALED}, q AS (SELECT event_id, event_id % 9 AS k, {RUN_OF} AS id FROM events), w AS (SELECT run_id, n FROM heads), h AS (SELECT run_id, index, contains(input, ':42') AS hit FROM rec),
l AS (SELECT 'runs' AS answer, count(*) AS lines FROM w UNION ALL SELECT 'search 3 : 42', least(3, count(*)) FROM h WHERE hit UNION ALL SELECT 'runs/id ' || run_id, 1 FROM w UNION ALL SELECT 'runs/id/verify ' || run_id, 1 FROM w UNION ALL SELECT 'live/id ' || run_id, 1 FROM w),
a AS (SELECT event_id, CASE k WHEN 0 THEN 'runs' WHEN 1 THEN 'runs/id ' || id WHEN 2 THEN 'runs/id/verify ' || id WHEN 3 THEN 'live/id ' || id WHEN 4 THEN 'search 3 : 42' END AS answer, k FROM q)
SELECT a.event_id, CASE WHEN k IN (0, 4) OR k IN (1, 2, 3) AND l.answer IS NOT NULL THEN 200 WHEN k = 5 THEN 400 ELSE 404 END AS status, coalesce(l.lines, 0) AS lines FROM a LEFT JOIN l ON l.answer = a.answer""")
def queries_answered(spark, sf):
    """Each event as a request for the list of runs, a run, its verdict, a live run, a search, a search for nothing, or what isn't there; how it is answered, and in how many lines."""
    runs, steps = sealed(spark, sf)
    runs = runs.drop("u").withColumns({"ingested_at": F.lit(AT).cast("timestamp"), "signature": F.lit(None).cast(integrity.SIGNATURE), "redaction_seal": F.lit(None).cast(integrity.SEAL)})
    base = new_path(spark, "answers")
    for name, df in (("runs", runs), ("steps", steps)):
        df.write.parquet(f"{base}/{name}")
    k, id_ = F.col("event_id") % 9, F.concat(F.lit("r"), (F.col("event_id") % 200).cast("string"))
    url = F.when(k == 0, "/api/runs").when(k == 1, F.concat(F.lit("/%61pi/runs/"), id_)).when(k == 2, F.concat(F.lit("/api/runs/"), id_, F.lit("/verify"))).when(k == 3, F.concat(F.lit("/api/live/"), id_)).when(k == 4, "/api/search?limit=3&q=%3A%2042").when(k == 5, "/api/search?limit=3").when(k == 6, "/api/nothing").when(k == 7, "/api/runs/nobody").otherwise("/api/runs")
    asked = driver.table(spark, sf, "events").select(F.col("event_id").alias("request"), F.when(k == 8, "DELETE").otherwise("GET").alias("method"), url.alias("url"))
    replies, lines = answers.answers(asked, spark.read.parquet(f"{base}/runs"), spark.read.parquet(f"{base}/steps"))
    counted = lines.groupBy("answer").agg(F.count(F.lit(1)).alias("lines"))
    return replies.join(counted, "answer", "left").select(F.col("request").alias("event_id"), "status", F.coalesce("lines", F.lit(0)).alias("lines"))


# ---- the store --------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id) SELECT 'r' || r.user_id AS run_id, count(*) AS steps, r.user_id % 2 = 1 AS replaced FROM r JOIN events e ON e.user_id = r.user_id WHERE r.user_id % 3 <> 0 GROUP BY r.user_id")
def store_contents(spark, sf):
    """Runs stored in three sweeps, some rewritten as redacted, one sweep pruned by its time to the second, then compacted."""
    s = records(spark, sf)
    runs = analyze.summaries(s).select("run_id", F.lit("n").alias("name"), "started_at", "ended_at", "status", F.lit("USD").alias("currency"), F.substring("run_id", 2, 20).cast("long").alias("u"))
    base = new_path(spark, "store")
    kept = Store(spark, base)
    for k in range(3):
        kept.save(runs.where(F.col("u") % 3 == k).drop("u"), s.where(F.col("u") % 3 == k).drop("u"), f"2024-01-01T00:00:0{k}")
    steps = kept.table("steps")
    kept.replace({"steps": steps.where(F.substring("run_id", 2, 20).cast("long") % 2 == 1).withColumn("input", F.lit('"gone"'))})
    kept.prune("2024-01-01T00:00:01")
    kept.vacuum()
    found = kept.table("steps").groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.bool_and(F.col("input") == '"gone"').alias("replaced"))
    return kept.table("runs").select("run_id").join(found, "run_id")


@query(f"WITH {STEPS} SELECT 'r' || run_id AS run_id, index, 'input' AS field, input AS snippet FROM steps WHERE contains(lower(input), ': 42')")
def stored_search(spark, sf):
    """Runs stored in four parts with filters, and a search that opens those whose texts have every piece of the needle."""
    s = records(spark, sf).drop("u")
    runs = analyze.summaries(s).select("run_id", F.lit("n").alias("name"), "started_at", "ended_at", "status", F.lit("USD").alias("currency"))
    kept = Store(spark, new_path(spark, "store"))
    for k in range(4):
        own = F.substring("run_id", 2, 20).cast("long") % 4 == k
        kept.save(runs.where(own), s.where(own), f"2024-01-01T00:00:0{k}")
    kept.index()
    return kept.search(": 42", None)


@query(f"WITH {STEPS}, n AS (SELECT run_id, count(*) AS n FROM steps GROUP BY run_id) SELECT count(*) FILTER (WHERE run_id % 3 <> 0) AS ingested, count(*) FILTER (WHERE run_id % 3 = 0) AS skipped, count(*) FILTER (WHERE run_id % 3 <> 0 AND n > 70) AS violations FROM n")
def sweep_counters(spark, sf):
    """A sweep of all runs into a store that has every third; what it stores, leaves out, and finds against the rules, counted as it writes."""
    s = records(spark, sf).drop("u", "commitments", "salts", "redactions")
    heads = s.select("run_id").distinct().select("run_id", F.lit("n").alias("name"), F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("declared"))
    kept, third = Store(spark, new_path(spark, "store")), F.substring("run_id", 2, 20).cast("long") % 3 == 0
    sweep.sweep(kept, heads.where(third), s.where(third), "2024-01-01T00:00:00")
    done = sweep.sweep(kept, heads, s, "2024-01-02T00:00:00", policy.Policy(maxSteps=70))
    return spark.createDataFrame([(done.ingested, done.skipped, done.violations)], "ingested long, skipped long, violations long")


# ---- alignments known beforehand --------------------------------------------------------------------------------

#: b is a without the steps 3, 8, 13 ..., with other tools in 1, 6, 11 ..., its first step last, and a new one after it.
EDITED = f"""{STEPS}, n AS (SELECT run_id, count(*) AS n FROM steps GROUP BY run_id), a AS (SELECT CAST(steps.run_id AS VARCHAR) AS pair, index, n FROM steps JOIN n USING (run_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n >= 5 AND index = 0, index) - 1 AS b_pos FROM a WHERE NOT (n >= 5 AND index % 5 = 3)), new AS (SELECT pair, max(n) AS n, count(*) AS m FROM b GROUP BY pair)"""


def edited(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(pairs, steps): runs a<user> and b<user>, whose every step has a tool of its own; every fifth step is an error."""
    s = driver.event_steps(spark, sf)
    n = F.count(F.lit(1)).over(Window.partitionBy("run_id"))
    i = F.col("index")
    base = s.select("run_id", "index", n.alias("n"), F.when((i % 5 == 4) | (i % 10 == 3), "error").otherwise("tool_call").alias("type"), F.concat(F.lit("t"), i.cast("string")).alias("tool_name"), "cost", "tokens", "duration_ms")
    some = F.col("n") >= 5
    left = base.where(~(some & (i % 5 == 3))).withColumn("tool_name", F.when(some & (i % 5 == 1), F.concat(F.lit("x"), "tool_name")).otherwise(F.col("tool_name"))).withColumn("at", F.when(some & (i == 0), 10**9).otherwise(i))
    new = base.where("index = 0").withColumns({"type": F.lit("plan"), "tool_name": F.lit("new"), "at": F.lit(10**9 + 1).cast("long"), "cost": F.lit(0.0), "tokens": F.lit(0.0), "duration_ms": F.lit(0.0)})
    b = left.withColumn("at", F.col("at").cast("long")).unionByName(new).withColumn("pos", F.row_number().over(Window.partitionBy("run_id").orderBy("at")) - 1)
    both = base.withColumns({"pos": i, "side": F.lit("a")}).unionByName(b.drop("at").withColumn("side", F.lit("b")))
    steps = both.select("run_id", "side", F.concat("side", F.col("run_id").cast("string")).alias("name"), F.col("pos").cast("long").alias("pos"), "type", "tool_name", F.col("tool_name").alias("label"), "cost", "tokens", "duration_ms")
    steps = steps.drop("run_id").withColumnRenamed("name", "run_id").withColumns({"index": F.col("pos"), "id": F.concat_ws(":", "run_id", "pos")})
    steps = written(steps, "edited")
    user = steps.where("startswith(run_id, 'a')").select(F.substring("run_id", 2, 20).alias("pair")).distinct()
    return user.select("pair", F.concat(F.lit("a"), "pair").alias("a_run"), F.concat(F.lit("b"), "pair").alias("b_run"), F.lit(True).alias("same_currency")), steps


ALIGNED = f"WITH {EDITED} SELECT a.pair, a.index AS ord, a.index AS a_pos, b_pos, a.n >= 5 AND a.index = 0 AS moved FROM a LEFT JOIN b ON b.pair = a.pair AND b.index = a.index UNION ALL SELECT pair, n, NULL, m, FALSE FROM new"


@query(ALIGNED)
def align_known(spark, sf):
    """Common, moved, gap-paired, removed and added steps."""
    pairs, steps = edited(spark, sf)
    return diff.alignments(pairs, steps).select("pair", "ord", "a_pos", "b_pos", "moved")


@query(ALIGNED)
def align_known_in_bits(spark, sf):
    """The same by the search that has no largest size."""
    pairs, steps = edited(spark, sf)
    return diff.alignments(pairs, steps, cells=0, exact=True).where("not degraded").select("pair", "ord", "a_pos", "b_pos", "moved")


@query(f"WITH {EDITED} SELECT a.pair, count(*) FILTER (WHERE a.n < 5 OR a.index % 5 IN (0, 2, 4)) AS same, count(*) FILTER (WHERE a.n >= 5 AND a.index % 5 = 1) AS changed, 1 AS added, count(*) FILTER (WHERE a.n >= 5 AND a.index % 5 = 3) AS removed, count(*) FILTER (WHERE a.n >= 5 AND a.index = 0) AS moved FROM a GROUP BY a.pair")
def diff_known(spark, sf):
    pairs, steps = edited(spark, sf)
    return diff.summary(diff.step_differences(diff.alignments(pairs, steps), pairs, steps)).select("pair", "same", "changed", "added", "removed", "moved")


KNOWN_WARNINGS = f"""WITH {EDITED}, w AS (SELECT pair, count(*) FILTER (WHERE index % 5 = 4 OR index % 10 = 3 AND n < 5) AS stay, count(*) FILTER (WHERE index % 10 = 3 AND n >= 5) AS gone FROM a GROUP BY pair)
SELECT pair, 'persisted' AS state, stay AS n FROM w WHERE stay > 0 UNION ALL SELECT pair, 'cleared', gone FROM w WHERE gone > 0 UNION ALL SELECT pair || '-back', 'persisted', stay FROM w WHERE stay > 0 UNION ALL SELECT pair || '-back', 'appeared', gone FROM w WHERE gone > 0"""


@query(KNOWN_WARNINGS)
def warnings_known(spark, sf):
    """Errors that stay, go, and come when the runs change places."""
    pairs, steps = edited(spark, sf)
    pairs = pairs.unionByName(pairs.select(F.concat("pair", F.lit("-back")).alias("pair"), F.col("b_run").alias("a_run"), F.col("a_run").alias("b_run"), "same_currency"))
    found = analyze.warnings(steps).where("kind = 'error'")
    return diff.warning_differences(pairs, written(diff.alignments(pairs, steps), "aligned"), steps, written(found, "warnings")).groupBy("pair", "state").agg(F.count(F.lit(1)).alias("n"))
