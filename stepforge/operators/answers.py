"""What a query endpoint would answer, over a table of requests: runs, one run, its verdict, search, the fleet and live recordings.

Serving HTTP is left to a gateway that lands requests as rows. Requests for the same thing share one answer, whose lines are made once,
so that neither many requests nor a long list meet in one row or are multiplied with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Wire
from ..shared import written
from . import analyze, fleet, integrity, policy, search

#: Hits of a search unless the request says otherwise.
HITS = 50
#: Needles of a block of requests that are sent to every task (a few MB); more are searched block by block.
NEEDLES = 1_000


def records(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (run_id, text, n): each run with its steps as the JSON of a record; a run's steps meet in one row, as in the record."""
    payload = lambda c, name: F.parse_json(c).alias(name)
    step = F.struct("pos", "id", F.col("run_id").alias("runId"), "index", "type", "label", F.col("started_at").alias("startedAt"), F.col("duration_ms").alias("durationMs"), "tokens", "cost", F.col("tool_name").alias("toolName"), payload("input", "input"), payload("output", "output"), payload("data_payload", "dataPayload"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("prev_hash").alias("prevHash"), "hash", "commitments", "salts", "redactions")
    by_place = lambda x: F.array_sort(x, lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    held = steps.groupBy("run_id").agg(by_place(F.collect_list(step)).alias("steps"), F.count(F.lit(1)).alias("n"))
    more = [F.col(c).alias(n) for c, n in (("signature", "signature"), ("redaction_seal", "redactionSeal")) if c in runs.columns]
    head = F.struct(F.col("run_id").alias("id"), "name", F.col("started_at").alias("startedAt"), F.col("ended_at").alias("endedAt"), "status", "currency", "totals", F.col("run_hash").alias("runHash"), F.col("hash_version").alias("hashVersion"), *more, F.coalesce("steps", F.array().cast(held.schema["steps"].dataType)).alias("steps"))
    return runs.join(held, "run_id", "left").select("run_id", F.to_json(head).alias("text"), F.coalesce("n", F.lit(0)).alias("n"))


def parsed(requests: DataFrame) -> DataFrame:
    """requests (request, method, url) with route, id, q, limit and `answer`, the name of what is asked; route is null for what isn't a read route.

    Percent signs are decoded before a path is matched, so that no spelling of it goes elsewhere.
    """
    path, query = F.split_part("url", F.lit("?"), F.lit(1)), F.substring_index(F.col("url"), "?", -1)
    parameter = lambda n: F.when(F.contains("url", F.lit("?")), F.try_url_decode(F.nullif(F.regexp_extract(query, rf"(?:^|&){n}=([^&]*)", 1), F.lit(""))))
    plain = F.try_url_decode(path)
    shape = r"^/api/(runs|search|fleet|live)(?:/([^/]+))?(?:/(verify))?/?$"
    kind, name, more = (F.nullif(F.regexp_extract(plain, shape, i), F.lit("")) for i in (1, 2, 3))
    fits = (F.col("method") == "GET") & F.when(more.isNotNull(), kind == "runs").when(name.isNotNull(), kind.isin("runs", "live")).otherwise(kind.isNotNull())
    route = F.when(F.coalesce(fits, F.lit(False)), F.concat_ws("/", kind, F.when(name.isNotNull(), "id"), more))
    out = requests.withColumns({"route": route, "id": name, "q": parameter("q"), "limit": F.coalesce(parameter("limit").try_cast("int"), F.lit(HITS))})
    answer = F.when(F.col("route") == "search", F.concat_ws(" ", "route", F.col("limit").cast("string"), "q")).otherwise(F.concat_ws(" ", "route", "id"))
    return out.withColumn("answer", F.when(F.col("route").isNotNull(), answer))


def listed(rows: DataFrame, answer: str | Column, order: list[Column], body: Column, by: list[str] = []) -> DataFrame:
    """Rows (answer, ord, body): lines in order. One list's places are numbered by a sort over it."""
    place = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)) - 1
    return rows.select((F.lit(answer) if isinstance(answer, str) else answer).alias("answer"), place.cast("long").alias("ord"), F.to_json(body).alias("body"))


def answers(requests: DataFrame, runs: DataFrame, steps: DataFrame, live: DataFrame | None = None, rules: policy.Policy | None = None, wire: Wire = Wire()) -> tuple[DataFrame, DataFrame]:
    """(replies, lines): replies (request, status, answer), one for each request; lines (answer, ord, body), JSON, made once for each answer.

    400: a search without q; 404: no such route, method or run; 200 otherwise, though a list may have no lines. runs, steps: as a store holds them;
    live: recordings (run_id, name, started_at, steps, modified, ended) in progress. An id that is both stored and live is answered with the record.
    """
    asked = written(parsed(requests), "asked")
    if live is None:
        live = runs.select("run_id", "name", "started_at", F.lit(0).cast("long").alias("steps"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("ended")).where(F.lit(False))
    going = live.where("ended is null").join(runs.select("run_id"), "run_id", "left_anti")
    wanted = asked.where("id is not null").select(F.col("id").alias("run_id"), "route").distinct()
    ids = wanted.select("run_id").distinct()
    mine, own = runs.join(ids, "run_id", "left_semi"), steps.join(ids, "run_id", "left_semi")
    name = lambda route: F.concat_ws(" ", F.lit(route), "run_id").alias("answer")
    zero = F.lit(0).cast("long").alias("ord")
    text = records(mine, own)
    parts = [text.join(wanted.where(F.col("route") == r), "run_id", "left_semi").select(name(r), zero, F.col("text").alias("body")) for r in ("runs/id", "live/id")]
    found = integrity.verify_full(mine.join(wanted.where("route = 'runs/id/verify'"), "run_id", "left_semi"), own, wire)
    parts.append(found.select(name("runs/id/verify"), zero, F.to_json(F.struct(F.col("run_id").alias("id"), F.col("all_ok").alias("ok"), F.col("broken_index").alias("brokenAtIndex"), "failure", F.col("signature_ok").alias("signatureOk"))).alias("body")))
    recording = F.struct(F.col("run_id").alias("runId"), "name", F.col("started_at").alias("startedAt"), "steps", F.lit(True).alias("live"))
    parts.append(going.join(wanted.where("route = 'live/id'"), "run_id", "left_semi").select(name("live/id"), zero, F.to_json(recording).alias("body")))
    lists = {r[0] for r in asked.where(F.col("route").isin("runs", "fleet", "live")).select("route").distinct().collect()}
    if "runs" in lists:
        head = F.struct(F.col("run_id").alias("id"), "name", F.col("started_at").alias("startedAt"), F.col("ended_at").alias("endedAt"), "status", "currency")
        parts.append(listed(runs, "runs", [F.desc("ingested_at"), F.asc("run_id")], head))
    if "live" in lists:
        parts.append(listed(going, "live", [F.desc("modified"), F.asc("run_id")], recording))
    if "fleet" in lists:
        parts.append(fleet_lines(runs, steps, rules, wire))
    if (hits := search_lines(asked, steps)) is not None:
        parts.append(hits)
    lines = reduce(DataFrame.unionByName, parts)
    known = runs.select(F.col("run_id").alias("id")).withColumn("stored", F.lit(True))
    state = asked.join(known, "id", "left").join(going.select(F.col("run_id").alias("id"), F.lit(True).alias("going")), "id", "left")
    there = F.col("id").isNull() | F.col("stored").isNotNull() | ((F.col("route") == "live/id") & F.col("going").isNotNull())
    status = F.when(F.col("route").isNull(), 404).when((F.col("route") == "search") & F.col("q").isNull(), 400).when(~there, 404).otherwise(200)
    replies = state.select("request", status.alias("status"), F.when(status == 200, F.col("answer")).alias("answer"))
    return replies, lines


def fleet_lines(runs: DataFrame, steps: DataFrame, rules: policy.Policy | None, wire: Wire) -> DataFrame:
    checked = integrity.verify_full(runs, steps, wire).select("run_id", F.col("ok").alias("chain_ok"), "signature_ok", "key_id")
    heads = runs.select("run_id", "name", "started_at", "ended_at", "ingested_at", "status", "currency", "totals.steps", "totals.tokens", "totals.cost", F.col("totals.durationMs").alias("duration_ms"), F.col("signature").isNotNull().alias("signed")).join(checked, "run_id")
    warned = analyze.warnings(steps)
    verdicts = None if rules is None else policy.verdicts(heads, policy.evaluate(heads, steps, warned, rules))
    full = fleet.with_issues(fleet.rows(heads, analyze.warning_counts(steps), verdicts).withColumn("live", F.lit(False)))
    counts = F.struct("loop", "high_cost_step", "error", "total").alias("warnings")
    body = F.struct(F.col("run_id").alias("id"), "name", "status", "currency", "steps", "tokens", "cost", counts, "signed", F.col("key_id").alias("keyId"), F.col("chain_ok").alias("chainOk"), F.col("signature_ok").alias("signatureOk"), F.col("policy_ok").alias("policyOk"), "issues")
    return listed(full, "fleet", [F.desc("started_at"), F.asc("run_id")], body)


def search_lines(asked: DataFrame, steps: DataFrame) -> DataFrame | None:
    """The first hits of each needle, in order of run and step: a step is held against all needles of a block, which every task has."""
    needles = asked.where("route = 'search' and q is not null").groupBy("q").agg(F.max("limit").alias("most"))
    n = needles.count()
    if not n:
        return None
    blocks = -(-n // NEEDLES)
    parts = []
    for i in range(blocks):
        some = F.broadcast(needles.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else needles)
        hit = F.coalesce(*[F.when(F.contains(F.lower(F.col(f)), F.lower("q")), F.struct(F.lit(f).alias("field"), F.col(f).alias("text"))) for f in search.FIELDS])
        met = steps.select("run_id", "index", "type", "label", *[f for f in search.FIELDS if f != "label"]).join(some, hit.isNotNull()).withColumn("hit", hit)
        place = F.row_number().over(Window.partitionBy("q").orderBy("run_id", "index"))
        parts.append(met.select("q", "most", "run_id", "index", "type", "label", "hit").withColumn("place", place).where("place <= most"))
    found = reduce(DataFrame.unionByName, parts)
    body = F.to_json(F.struct(F.col("run_id").alias("runId"), F.col("index").alias("stepIndex"), F.col("type").alias("stepType"), "label", F.col("hit.field").alias("field"), search.snippet_of(F.col("hit.text"), F.col("q")).alias("snippet")))
    names = asked.where("route = 'search' and q is not null").select("answer", "q", "limit").distinct()
    return found.withColumn("body", body).join(names, "q").where(F.col("place") <= F.col("limit")).select("answer", (F.col("place") - 1).cast("long").alias("ord"), "body")
