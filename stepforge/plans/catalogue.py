"""Queries over the driver's tables, one for each group of operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as canon
from ..functions import text as tx
from ..operators import analyze, anchors, diff, fleet, integrity, long_runs, policy, redact, report, search, store
from ..shared import written
from ..sources import driver, traces
from ..streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Steps of the events table, as SQL.
STEPS = """
steps AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS index,
  CASE WHEN event_type IN ('click','view','purchase') THEN 'tool_call' WHEN event_type = 'signup' THEN 'approval' ELSE 'error' END AS type,
  CASE WHEN event_type IN ('click','view','purchase') THEN event_type END AS tool_name, event_type AS label, value AS cost,
  CAST(event_id % 100 AS DOUBLE) AS tokens, props AS input, ts, event_id,
  CAST(coalesce(greatest(0, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id)) // 1000 - epoch_us(ts) // 1000), 0) AS DOUBLE) AS duration_ms FROM events)"""
LOOPS = """
marked AS (SELECT *, CASE WHEN type = 'tool_call' AND lag(tool_name) OVER w IS NOT DISTINCT FROM tool_name AND lag(type) OVER w = 'tool_call' THEN 0 ELSE 1 END AS fresh
  FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY index)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY index) AS island FROM marked),
loops AS (SELECT run_id, min(tool_name) AS tool_name, count(*) AS run_length, min(index) AS first_index, max(index) AS last_index
  FROM islands WHERE type = 'tool_call' GROUP BY run_id, island HAVING count(*) >= 3)"""
HIGH = """
medians AS (SELECT run_id, coalesce(median(cost) FILTER (WHERE cost > 0), 0) AS median_cost FROM steps GROUP BY run_id),
high AS (SELECT s.*, m.median_cost FROM steps s JOIN medians m USING (run_id) WHERE m.median_cost > 0 AND s.cost > 3 * m.median_cost)"""
COUNTS = """
found AS (SELECT run_id, 'loop' AS kind FROM loops UNION ALL SELECT run_id, 'high_cost_step' FROM high UNION ALL SELECT run_id, 'error' FROM steps WHERE type = 'error'),
counts AS (SELECT run_id, count(*) FILTER (WHERE kind = 'loop') AS loop, count(*) FILTER (WHERE kind = 'high_cost_step') AS high_cost_step,
  count(*) FILTER (WHERE kind = 'error') AS error, count(*) AS total FROM found GROUP BY run_id)"""
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
RUNS = f"""
runs AS (SELECT run_id, 'run ' || run_id AS name, {ISO.format("min_by(ts, index)")} AS started_at, max(ts) AS last_ts, count(*) AS steps, sum(cost) AS cost, sum(tokens) AS tokens, sum(duration_ms) AS duration_ms,
  CASE WHEN bool_or(type = 'error') THEN 'failed' ELSE 'completed' END AS status, CASE WHEN run_id % 2 = 1 THEN 'EUR' ELSE 'USD' END AS currency,
  run_id % 5 <> 0 AS signed, run_id % 17 <> 0 AS chain_ok, TRUE AS signature_ok FROM steps GROUP BY run_id)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# ---- analytics --------------------------------------------------------------------------------------------------


@query(f"WITH {STEPS} SELECT run_id, index, type, tool_name, cost FROM steps")
def steps_assembled(spark, sf):
    return driver.event_steps(spark, sf).select("run_id", "index", "type", "tool_name", "cost")


@query(f"WITH {STEPS} SELECT run_id, sum(tokens) AS tokens, round(sum(cost), 2) AS cost, sum(duration_ms) AS duration_ms, count(*) AS steps FROM steps GROUP BY run_id")
def run_totals(spark, sf):
    return analyze.totals(driver.event_steps(spark, sf)).withColumn("cost", F.round("cost", 2))


@query(f"WITH {STEPS} SELECT run_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(cost ORDER BY index)), lambda a, b: a + b), 6) AS cost FROM steps GROUP BY run_id")
def run_totals_folded(spark, sf):
    return analyze.exact_totals(driver.event_steps(spark, sf)).select("run_id", F.round("cost", 6).alias("cost"))


@query(f"WITH {STEPS} SELECT run_id, CASE WHEN bool_or(type = 'error') THEN 'failed' ELSE 'completed' END AS status FROM steps GROUP BY run_id")
def run_status(spark, sf):
    return analyze.status(driver.event_steps(spark, sf))


@query(f"WITH {STEPS}, {RUNS} SELECT run_id, started_at, {ISO.format('last_ts')} AS ended_at, steps, round(cost, 2) AS cost FROM runs")
def run_summary_list(spark, sf):
    out = analyze.summaries(driver.event_steps(spark, sf))
    return out.orderBy(F.desc("ended_at")).select("run_id", "started_at", "ended_at", "steps", F.round("cost", 2).alias("cost"))


@query(f"WITH {STEPS} SELECT run_id, index, duration_ms FROM steps")
def step_gap_duration(spark, sf):
    return analyze.gap_durations(driver.event_steps(spark, sf).drop("duration_ms")).select("run_id", "index", "duration_ms")


@query(f"WITH {STEPS} SELECT run_id, index, round(sum(cost) OVER w, 2) AS cum_cost, sum(tokens) OVER w AS cum_tokens, count(*) OVER w AS cum_steps FROM steps WINDOW w AS (PARTITION BY run_id ORDER BY index)")
def running_totals(spark, sf):
    return long_runs.by_size(driver.event_steps(spark, sf), analyze.running, long_runs.running).select("run_id", "index", F.round("cum_cost", 2).alias("cum_cost"), "cum_tokens", "cum_steps")


@query(f"WITH {STEPS}, {HIGH} SELECT run_id, round(median_cost, 4) AS median_cost FROM medians")
def median_step_cost(spark, sf):
    return analyze.median_cost(driver.event_steps(spark, sf)).select("run_id", F.round("median_cost", 4).alias("median_cost"))


@query(f"WITH {STEPS}, {HIGH} SELECT run_id, index, cost, round(median_cost, 4) AS median_cost FROM high")
def high_cost_steps(spark, sf):
    return analyze.high_cost(driver.event_steps(spark, sf)).select("run_id", "index", "cost", F.round("median_cost", 4).alias("median_cost"))


@query(f"WITH {STEPS}, {LOOPS} SELECT * FROM loops")
def tool_loops(spark, sf):
    """Calls of one tool in a row, whatever their inputs: no two events' props are equal, so that by input none would be found."""
    return analyze.loops(driver.event_steps(spark, sf), by_tool=True)


BY_INPUT = LOOPS.replace("lag(tool_name) OVER w IS NOT DISTINCT FROM tool_name", "lag(tool_name) OVER w IS NOT DISTINCT FROM tool_name AND lag(sent) OVER w IS NOT DISTINCT FROM sent")
SENT = "sent AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(json_extract(input, '$.k') AS BIGINT) % 2 END AS sent FROM steps)"


def repeating(steps: DataFrame) -> DataFrame:
    """Steps with inputs that repeat, written in three ways: {"k":1}, { "k" : 1.0 } and the like; others, and each eleventh, are absent or null."""
    k = F.get_json_object("input", "$.k").cast("long") % 2
    odd = F.when(k == 1, F.when(F.col("ord") % 3 == 0, '{"k":1}').when(F.col("ord") % 3 == 1, '{ "k" : 1.0 }').otherwise('{"k":10e-1}'))
    return steps.withColumn("input", F.when(F.col("ord") % 11 == 0, F.when(F.col("ord") % 2 == 0, "null")).otherwise(F.coalesce(odd, F.when(F.col("ord") % 2 == 0, "null"))))


@query(f"WITH {STEPS}, {SENT}, {BY_INPUT.replace('FROM steps WINDOW', 'FROM sent WINDOW')} SELECT * FROM loops")
def loops_by_input(spark, sf):
    """Calls of one tool in a row with one input, however that is written; some runs of calls by tool alone are no loops, or shorter ones."""
    return analyze.loops(repeating(driver.event_steps(spark, sf)))


@query(f"WITH {STEPS}, {LOOPS} SELECT run_id, min(first_index) AS first_index, max(last_index) AS last_index FROM loops GROUP BY run_id")
def loop_spans(spark, sf):
    return analyze.loop_span(analyze.loops(driver.event_steps(spark, sf), by_tool=True))


@query(f"WITH {STEPS} SELECT run_id, index FROM steps WHERE type = 'error'")
def error_steps(spark, sf):
    return analyze.errors(driver.event_steps(spark, sf)).select("run_id", "index")


@query(f"WITH {STEPS}, {LOOPS}, {HIGH}, {COUNTS} SELECT * FROM counts")
def warning_counts(spark, sf):
    return analyze.warning_counts(driver.event_steps(spark, sf), by_tool=True)


@query(f"""WITH {STEPS}, {LOOPS}, {HIGH}, every AS (SELECT run_id, 0 AS o, first_index AS i, 'loop' AS kind, run_length AS n FROM loops UNION ALL SELECT run_id, 1, index, 'high_cost_step', 1 FROM high
UNION ALL SELECT run_id, 2, index, 'error', 1 FROM steps WHERE type = 'error') SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY o, i) - 1 AS INT) AS ord, kind, CAST(n AS INT) AS n_steps FROM every""")
def warning_list(spark, sf):
    return analyze.warnings(driver.event_steps(spark, sf), by_tool=True).select("run_id", "ord", "kind", F.size("step_ids").alias("n_steps"))


@query(f"WITH {STEPS} SELECT tool_name, count(*) AS calls FROM steps WHERE type = 'tool_call' GROUP BY tool_name")
def tool_counts(spark, sf):
    return analyze.tool_counts(driver.event_steps(spark, sf))


# ---- policies ---------------------------------------------------------------------------------------------------

RULES = policy.Policy(maxCostPerRun=2500.0, maxTokensPerRun=3300.0, maxSteps=70, maxCostPerStep=200.0, forbidTools=("pur*",), requireApprovalFor=("purchase", "*ew"), forbidInputText=("42",), requireSignature=True, forbidWarnings=("loop",))
POLICY_SQL = {
    "maxCostPerRun": "SELECT run_id, 1 AS hits, CAST(NULL AS BIGINT) AS first_index FROM runs WHERE round(cost, 2) > 2500",
    "maxTokensPerRun": "SELECT run_id, 1 AS hits, CAST(NULL AS BIGINT) AS first_index FROM runs WHERE tokens > 3300",
    "maxSteps": "SELECT run_id, 1 AS hits, CAST(NULL AS BIGINT) AS first_index FROM runs WHERE steps > 70",
    "maxCostPerStep": "SELECT run_id, count(*) AS hits, min(index) AS first_index FROM steps WHERE cost > 200 GROUP BY run_id",
    "forbidTools": "SELECT run_id, count(*) AS hits, min(index) AS first_index FROM steps WHERE type = 'tool_call' AND lower(tool_name) LIKE 'pur%' GROUP BY run_id",
    "requireApprovalFor": "SELECT run_id, count(*) AS hits, min(index) AS first_index FROM steps s WHERE type = 'tool_call' AND {} AND NOT EXISTS (SELECT 1 FROM steps a WHERE a.run_id = s.run_id AND a.type = 'approval' AND a.index < s.index) GROUP BY run_id",
    "forbidInputText": "SELECT run_id, count(*) AS hits, min(index) AS first_index FROM steps WHERE contains(lower(input), '42') GROUP BY run_id",
    "requireSignature": "SELECT run_id, 1 AS hits, CAST(NULL AS BIGINT) AS first_index FROM runs WHERE NOT signed",
    "forbidWarnings": "SELECT run_id, count(*) AS hits, CAST(NULL AS BIGINT) AS first_index FROM loops GROUP BY run_id",
}
POLICY_CTE = f"WITH {STEPS}, {RUNS}, {LOOPS}"


def rule_rows(rule: str) -> str:
    part = lambda pattern, sql: f"SELECT run_id, '{rule}' AS rule, {pattern} AS pattern, CAST(hits AS BIGINT) AS hits, first_index FROM ({sql})"
    sql = POLICY_SQL[rule]
    if rule == "requireApprovalFor":
        return part("'purchase'", sql.format("tool_name = 'purchase'")) + " UNION ALL " + part("'*ew'", sql.format("tool_name LIKE '%ew'"))
    return part({"forbidTools": "'pur*'", "forbidInputText": "'42'", "forbidWarnings": "'loop'"}.get(rule, "CAST(NULL AS VARCHAR)"), sql)


def policy_inputs(spark, sf):
    steps = driver.event_steps(spark, sf)
    runs = driver.event_runs(steps).withColumn("cost", F.round("cost", 2))
    return runs, steps, analyze.loops(steps, by_tool=True).select("run_id", F.lit("loop").alias("kind"))


def policy_query(rule: str):
    def run(spark, sf):
        only = policy.Policy(**{rule: getattr(RULES, rule)})
        return policy.evaluate(*policy_inputs(spark, sf), only).select("run_id", "rule", "pattern", "hits", "first_index")

    run.__name__ = "pol_" + "".join(f"_{c.lower()}" if c.isupper() else c for c in rule)
    return query(f"{POLICY_CTE} {rule_rows(rule)}")(run)


for _rule in POLICY_SQL:
    policy_query(_rule)

EVERY_RULE = " UNION ALL ".join(map(rule_rows, POLICY_SQL))


@query(f"{POLICY_CTE}, every AS ({EVERY_RULE}) SELECT * FROM every")
def policy_violations(spark, sf):
    return policy.evaluate(*policy_inputs(spark, sf), RULES).select("run_id", "rule", "pattern", "hits", "first_index")


@query(f"{POLICY_CTE}, every AS ({EVERY_RULE}), n AS (SELECT run_id, sum(CASE WHEN rule = 'forbidWarnings' THEN hits ELSE 1 END) AS v FROM every GROUP BY run_id) SELECT run_id, v IS NULL AS ok, CAST(coalesce(v, 0) AS BIGINT) AS violations FROM runs LEFT JOIN n USING (run_id)")
def policy_verdict(spark, sf):
    runs, steps, warned = policy_inputs(spark, sf)
    return policy.verdicts(runs, policy.evaluate(runs, steps, warned, RULES))


# ---- search -----------------------------------------------------------------------------------------------------

SNIPPET = """CASE WHEN p - 30 > 1 THEN '…' ELSE '' END || substr(t, greatest(1, p - 30), least(length(t), p + {n} - 1 + 50) - greatest(1, p - 30) + 1) || CASE WHEN p + {n} - 1 + 50 < length(t) THEN '…' ELSE '' END"""


@query("WITH d AS (SELECT doc_id, text AS t, instr(lower(text), 'license') AS p FROM documents) SELECT doc_id AS run_id, CAST(0 AS BIGINT) AS index, 'label' AS field, " + SNIPPET.format(n=7) + " AS snippet FROM d WHERE p > 0")
def search_documents(spark, sf):
    docs = driver.table(spark, sf, "documents").select(F.col("doc_id").alias("run_id"), F.lit(0).cast("long").alias("index"), F.col("text").alias("label"))
    return search.search(docs, "License", None, ("label",))


@query(f"WITH {STEPS} SELECT run_id, index, 'input' AS field, input AS snippet FROM steps WHERE contains(lower(input), '42') ORDER BY run_id, index LIMIT 50")
def search_first_hits(spark, sf):
    return search.search(driver.event_steps(spark, sf), "42", 50, ("label", "tool_name", "input"))


# ---- fleet ------------------------------------------------------------------------------------------------------

FLEET = f"""WITH {STEPS}, {RUNS}, {LOOPS}, {HIGH}, {COUNTS},
verdict AS (SELECT run_id, steps <= 70 AS policy_ok FROM runs),
rows AS (SELECT r.*, FALSE AS live, coalesce(c.loop, 0) AS loop, coalesce(c.high_cost_step, 0) AS high_cost_step, coalesce(c.error, 0) AS error, coalesce(c.total, 0) AS total, v.policy_ok FROM runs r LEFT JOIN counts c USING (run_id) JOIN verdict v USING (run_id)),
bound AS (SELECT CASE WHEN count(*) FILTER (WHERE cost > 0) >= 3 THEN 3 * median(cost) FILTER (WHERE cost > 0) ELSE 'infinity'::DOUBLE END AS threshold FROM rows),
fleet AS (SELECT rows.*, list_filter([CASE WHEN NOT chain_ok OR NOT signature_ok THEN 'tampered' END, CASE WHEN NOT policy_ok THEN 'policy' END, CASE WHEN error > 0 THEN 'error' END, CASE WHEN loop > 0 THEN 'loop' END,
  CASE WHEN high_cost_step > 0 THEN 'high_cost' END, CASE WHEN cost > threshold THEN 'outlier' END, CASE WHEN NOT signed THEN 'unsigned' END], lambda x: x IS NOT NULL) AS issues FROM rows, bound)"""


def fleet_frame(spark, sf):
    steps = driver.event_steps(spark, sf)
    runs = driver.event_runs(steps)
    verdict = policy.verdicts(runs, policy.evaluate(runs, steps, analyze.loops(steps, by_tool=True).select("run_id", F.lit("loop").alias("kind")), policy.Policy(maxSteps=70)))
    return fleet.with_issues(fleet.rows(runs, analyze.warning_counts(steps, by_tool=True), verdict).withColumn("live", F.lit(False)))


@query(f"{FLEET} SELECT run_id, status, currency, steps, round(cost, 2) AS cost, loop, high_cost_step, error, total, policy_ok, array_to_string(issues, ',') AS issues, issues[1] AS worst_issue FROM fleet")
def fleet_rows(spark, sf):
    return fleet_frame(spark, sf).select("run_id", "status", "currency", "steps", F.round("cost", 2).alias("cost"), "loop", "high_cost_step", "error", "total", "policy_ok", F.array_join("issues", ",").alias("issues"), "worst_issue")


@query(f"{FLEET} SELECT run_id FROM fleet WHERE status = 'failed' AND contains(name, '1') AND list_has_any(issues, ['tampered', 'policy'])")
def fleet_filtered(spark, sf):
    return fleet.filtered(fleet_frame(spark, sf), ("failed",), "1", ("tampered", "policy")).select("run_id")


@query(f"{FLEET} SELECT run_id, total FROM fleet ORDER BY total DESC, run_id LIMIT 20")
def fleet_most_warned(spark, sf):
    return fleet.ordered(fleet_frame(spark, sf), "warnings").select("run_id", "total").limit(20)


SUMMARY = """SELECT count(*) AS runs, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE total > 0) AS with_warnings, count(*) FILTER (WHERE NOT policy_ok) AS policy_failed,
count(*) FILTER (WHERE NOT signed) AS unsigned, count(*) FILTER (WHERE NOT chain_ok OR NOT signature_ok) AS tampered, CAST(sum(steps) AS BIGINT) AS steps, sum(tokens) AS tokens,
CASE WHEN count(DISTINCT currency) > 1 THEN 0 ELSE round(sum(cost), 2) END AS cost, CASE WHEN count(DISTINCT currency) > 1 THEN '' ELSE max(currency) END AS currency FROM fleet"""


@query(f"{FLEET} {SUMMARY} WHERE currency = 'USD'")
def fleet_summary(spark, sf):
    return fleet.summary(fleet_frame(spark, sf).where("currency = 'USD'")).withColumn("cost", F.round("cost", 2))


@query(f"{FLEET} {SUMMARY}")
def fleet_mixed_currency(spark, sf):
    return fleet.summary(fleet_frame(spark, sf))


ORDER_RUNS = "runs AS (SELECT l_orderkey AS run_id, round(sum(l_extendedprice), 2) AS cost, count(*) AS steps FROM lineitem GROUP BY 1)"


@query(f"WITH {ORDER_RUNS}, kept AS (SELECT runs.*, o_orderdate FROM runs JOIN orders ON o_orderkey = run_id), bound AS (SELECT 3 * median(cost) AS threshold FROM kept WHERE cost > 0) SELECT run_id, cost, round(threshold, 4) AS threshold FROM kept, bound WHERE cost > threshold")
def fleet_outliers(spark, sf):
    runs = driver.order_runs(spark, sf)
    return runs.crossJoin(F.broadcast(fleet.outlier_threshold(runs))).where("cost > threshold").select("run_id", "cost", F.round("threshold", 4).alias("threshold"))


@query(f"WITH {STEPS}, {RUNS}, fresh AS (SELECT DISTINCT conv_id AS run_id FROM conversations WHERE conv_id % 3 <> 0 AND conv_id NOT IN (SELECT run_id FROM runs)) SELECT run_id, FALSE AS live FROM runs UNION ALL SELECT run_id, TRUE FROM fresh")
def fleet_live_merge(spark, sf):
    live_ = driver.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id")).distinct().withColumn("ended", F.col("run_id") % 3 == 0)
    return fleet.with_live(analyze.status(driver.event_steps(spark, sf)), live_).select("run_id", "live")


@query(f"WITH {ORDER_RUNS} SELECT run_id, o_orderdate < TIMESTAMP '1996-01-01' AS pruned FROM runs JOIN orders ON o_orderkey = run_id")
def retention_split(spark, sf):
    kept, pruned = store.split_older(driver.order_runs(spark, sf), "1996-01-01")
    return kept.select("run_id", F.lit(False).alias("pruned")).unionByName(pruned.select("run_id", F.lit(True).alias("pruned")))


@query(f"WITH {STEPS}, {RUNS} SELECT DISTINCT conv_id * 3 AS run_id FROM conversations WHERE conv_id * 3 NOT IN (SELECT run_id FROM runs)")
def ingest_dedupe(spark, sf):
    """Every third number as a new run: those that events have already are left out."""
    return store.not_stored(driver.table(spark, sf, "conversations").select((F.col("conv_id") * 3).alias("run_id")).distinct(), analyze.status(driver.event_steps(spark, sf)))


# ---- integrity --------------------------------------------------------------------------------------------------

TEXTS = STEPS + """, texts AS (SELECT run_id, index, '{"id":"' || run_id || ':' || index || '","label":"' || label || '"}' AS t FROM steps)"""
CHAIN_SQL = f"""WITH RECURSIVE {TEXTS}, chain AS (SELECT run_id, index, sha256('tgstep/2' || chr(0) || t || chr(0)) AS hash FROM texts WHERE index = 0
UNION ALL SELECT x.run_id, x.index, sha256('tgstep/2' || chr(0) || x.t || chr(0) || c.hash) FROM chain c JOIN texts x ON x.run_id = c.run_id AND x.index = c.index + 1)"""


def chained(spark, sf):
    steps = driver.event_steps(spark, sf).select("run_id", "pos", "id", "label")
    return integrity.chain(steps.withColumn("canonical", F.concat(F.lit('{"id":"'), "id", F.lit('","label":"'), "label", F.lit('"}'))))


@query(f"{CHAIN_SQL} SELECT run_id, index, hash FROM chain")
def chain_hashes(spark, sf):
    return chained(spark, sf).select("run_id", F.col("pos").alias("index"), "hash")


@query(f"{CHAIN_SQL} SELECT run_id, max_by(hash, index) AS anchor, count(*) AS steps FROM chain GROUP BY run_id")
def chain_anchor(spark, sf):
    return integrity.anchors(chained(spark, sf))


@query(f"WITH {STEPS} SELECT run_id, min(CASE WHEN event_id % 211 = 7 THEN index END) AS broken_index FROM steps GROUP BY run_id")
def chain_verify_tampered(spark, sf):
    changed = driver.event_steps(spark, sf).where("ord % 211 = 7").select("run_id", "pos", F.lit(True).alias("changed"))
    out = chained(spark, sf).join(changed, ["run_id", "pos"], "left").withColumn("canonical", F.when(F.col("changed"), F.concat("canonical", F.lit(" "))).otherwise(F.col("canonical")))
    return integrity.broken_links(out)


@query("SELECT 'anchors-' || event_id // 1000 AS file, event_id + 1 AS line, NOT (event_id % 50 = 3) AS ok FROM events")
def anchor_chain_breaks(spark, sf):
    """All events as anchor files of 1000 lines. Every other line chains to the unchained one before it; of each 50 lines one names a wrong predecessor."""
    base = driver.table(spark, sf, "events").select((F.col("event_id") + 1).alias("line"), F.col("event_id").cast("string").alias("id"), "event_id", F.sha2("props", 256).alias("h"))
    one = lambda prev: F.concat(F.lit('{"version":1,"runId":"'), "id", F.lit('","runHash":"'), "h", F.lit('"'), prev, F.lit("}"))
    plain = base.withColumn("raw", one(F.lit("")))
    before = plain.select((F.col("line") + 1).alias("line"), F.sha2("raw", 256).alias("prev"))
    chained_ = base.where("event_id % 2 = 1").join(before, "line").withColumn("raw", F.concat(F.lit('{"version":2,"runId":"'), "id", F.lit('","runHash":"'), "h", F.lit('","prev":"'), F.concat(F.substring("prev", 1, 63), F.when(F.col("event_id") % 50 == 3, "x").otherwise(F.substring("prev", 64, 1))), F.lit('"}')))
    file = F.concat(F.lit("anchors-"), F.floor(F.col("event_id") / 1000).cast("string")).alias("file")
    lines = plain.where("event_id % 2 = 0").select("line", "raw", file).unionByName(chained_.select("line", "raw", file))
    return anchors.read_lines(lines).select("file", "line", "ok")


@query("SELECT event_id, 'input.' || j.key AS path, CAST(j.value AS VARCHAR) AS value FROM events, json_each(props) AS j")
def leaf_walk(spark, sf):
    events = driver.table(spark, sf, "events").select("event_id", F.explode(canon.leaves_udf("input")(F.col("props"))).alias("x"))
    return events.select("event_id", "x.path", "x.value")


LEAF_SQL = """WITH p AS (SELECT event_id, props, lead(props) OVER (ORDER BY event_id) AS other FROM events), q AS (SELECT * FROM p WHERE other IS NOT NULL AND event_id % 2 = 0)
SELECT event_id, '.k' AS path, 'changed' AS status FROM q WHERE props <> other UNION ALL SELECT event_id, '.old', 'removed' FROM q WHERE event_id % 4 = 0 UNION ALL SELECT event_id, '.new', 'added' FROM q WHERE event_id % 6 = 0
UNION ALL SELECT event_id, '.gone', 'redacted' FROM q WHERE event_id % 10 = 0 UNION ALL SELECT event_id, '.gone', 'changed' FROM q WHERE event_id % 10 = 2"""


@query(LEAF_SQL)
def leaf_diff(spark, sf):
    """Payload leaves of each even event and the next one, all four states: every fourth event has a leaf that goes, every sixth one that
    comes, every tenth one that is redacted later, and of the even ones ending in 2 that leaf changes."""
    e = driver.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    even, own = F.col("event_id") % 2 == 0, F.col("event_id") - F.col("event_id") % 2
    gone = F.when(own % 10 == 2, F.when(even, "1").otherwise("2")).when((own % 10 == 0) & ~even, '"[trace:redacted]"').otherwise("1")
    text = F.concat(F.lit('{"gone":'), gone, F.lit(',"k":'), "k", F.when(even & (own % 4 == 0), ',"old":1').otherwise(""), F.when(~even & (own % 6 == 0), ',"new":1').otherwise(""), F.lit("}"))
    steps = e.select(F.col("event_id").cast("string").alias("run_id"), F.lit(0).cast("long").alias("pos"), text.alias("input")).withColumns({c: F.lit(None).cast("string") for c in ("output", "data_payload")}).withColumns({"commitments": F.lit(None).cast("map<string,string>"), "salts": F.lit(None).cast("map<string,string>"), "redactions": F.lit(None).cast("array<struct<path:string,at:string,reason:string,by:string>>"), "hash_version": F.lit(2)})
    pairs = e.where("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("pair"), F.col("event_id").cast("string").alias("a_run"), (F.col("event_id") + 1).cast("string").alias("b_run")).join(e.select(F.col("event_id").cast("string").alias("b_run")), "b_run", "left_semi")
    aligned = pairs.select("pair", F.lit(0).alias("ord"), F.lit(0).cast("long").alias("a_pos"), F.lit(0).cast("long").alias("b_pos"))
    out = diff.leaf_differences(aligned, pairs, diff.leaf_rows(steps))
    return out.select(F.col("pair").cast("long").alias("event_id"), F.substring("path", 6, 100).alias("path"), "status")


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS canonical FROM events")
def canonical_props(spark, sf):
    return driver.table(spark, sf, "events").select("event_id", canon.canonical(F.col("props")).alias("canonical"))


@query("SELECT event_id, sha256('s' || event_id || CAST(json_extract(props, '$.k') AS VARCHAR)) AS commitment FROM events")
def commitments(spark, sf):
    steps = payload_steps(spark, sf)
    return redact.commit(steps, salt=lambda step, path: f"s{step}").select(F.col("id").cast("long").alias("event_id"), F.map_values("commitments")[0].alias("commitment"))


def payload_steps(spark, sf):
    nothing = {"output": "string", "data_payload": "string", "commitments": "map<string,string>", "salts": "map<string,string>", "redactions": "array<struct<path:string,at:string,reason:string,by:string>>"}
    return driver.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("id"), F.col("props").alias("input")).withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})


@query("SELECT state, count(*) AS leaves FROM (SELECT CASE WHEN event_id % 10 = 0 THEN 'redacted' WHEN event_id % 10 = 1 THEN 'mismatched' ELSE 'verified' END AS state FROM events) GROUP BY state")
def commitments_checked(spark, sf):
    """Leaves that were erased with a log entry, changed, or left alone."""
    steps = redact.commit(payload_steps(spark, sf), salt=lambda step, path: f"s{step}")
    erased = redact.redact(steps.where("pos % 10 = 0"), "2024-01-01T00:00:00.000Z", paths=("input.k",)).drop("redacted_paths")
    changed = steps.where("pos % 10 = 1").withColumn("input", F.lit('{"k": -1}'))
    whole = erased.unionByName(changed).unionByName(steps.where("pos % 10 > 1"))
    return integrity.check_commitments(whole, 2).groupBy("state").agg(F.count(F.lit(1)).alias("leaves"))


@query(f"WITH {STEPS}, {RUNS} SELECT run_id, run_id % 7 <> 0 AS signature_ok FROM runs")
def signatures(spark, sf):
    """Each run signed, and every seventh one's hash changed afterwards."""
    from ..functions import crypto

    seed = bytes(range(32))
    private, public = crypto.pem(crypto.PKCS8 + seed, "PRIVATE KEY"), crypto.pem(crypto.SPKI + crypto.public_key(seed), "PUBLIC KEY")
    runs = integrity.anchors(chained(spark, sf)).select(F.col("run_id").cast("string").alias("run_id"), F.col("anchor").alias("run_hash"))
    signed = integrity.sign_runs(runs, private, public, "2024-01-01T00:00:00.000Z")
    changed = signed.withColumn("run_hash", F.when(F.col("run_id").cast("long") % 7 == 0, F.reverse("run_hash")).otherwise(F.col("run_hash")))
    return integrity.verify_signatures(changed).select(F.col("run_id").cast("long").alias("run_id"), "signature_ok")


# ---- redaction --------------------------------------------------------------------------------------------------

DUCK = {
    "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}", "credit-card": r"\b(?:[0-9][ -]*?){13,19}\b", "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "aadhaar": r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b",
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "bearer-token": r"\b(?:sk-|ghp_|Bearer\s+)[A-Za-z0-9_\-.]{16,}",
}
DUCK_HIT = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in DUCK.items()) + " END"


@query(f"SELECT doc_id, {DUCK_HIT} AS pattern FROM documents WHERE {DUCK_HIT} IS NOT NULL")
def pii_hits(spark, sf):
    return driver.table(spark, sf, "documents").select("doc_id", redact.first_hit(F.col("text")).alias("pattern")).where("pattern is not null")


@query(f"SELECT doc_id, {DUCK_HIT} IS NOT NULL AS scrubbed FROM documents")
def pii_scrubbed(spark, sf):
    empty = {"output": "string", "data_payload": "string", "commitments": "map<string,string>", "salts": "map<string,string>", "redactions": "array<struct<path:string,at:string,reason:string,by:string>>"}
    steps = driver.table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct("text")).alias("input")).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    return redact.scrub(steps, "2024-01-01T00:00:00.000Z").select("doc_id", (F.size("redactions") > 0).alias("scrubbed"))


# ---- sessions ---------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT conv_id, turn, role, regexp_replace(trim(text, ' ' || chr(9) || chr(10)), '\\s+', ' ', 'g') AS one, max(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, CASE WHEN role = 'user' THEN 'user_input' WHEN turn = last THEN 'final_output' ELSE 'llm_reasoning' END AS type,
CASE WHEN role = 'user' THEN CASE WHEN length(one) > 60 THEN substr(one, 1, 57) || '…' ELSE one END WHEN turn = last THEN 'Final output' ELSE 'Assistant' END AS label FROM t""")
def session_steps(spark, sf):
    """Conversations written as session logs and read back."""
    entries = driver.conversation_entries(spark, sf).where("type in ('user', 'assistant')")
    raw = F.to_json(F.struct("type", F.concat_ws("-", "file", "line").alias("uuid"), driver.iso(F.col("timestamp")).alias("timestamp"), F.col("file").cast("string").alias("sessionId"), F.struct(F.col("type").alias("role"), "model", F.col("text").alias("content"), F.struct("input_tokens", "output_tokens").alias("usage")).alias("message")))
    _, steps = traces.sessions(entries.select(F.col("file").cast("string").alias("file"), "line", raw.alias("raw")), prices(spark), (5.0, 25.0), prefix="")
    return steps.select(F.col("run_id").cast("long").alias("conv_id"), "index", "type", "label")


def prices(spark):
    """Model prices for the queries over conversations."""
    return spark.createDataFrame([("model-0", 1.0, 5.0, 0), ("model-1", 3.0, 15.0, 1), ("model-2-2025", 9.0, 9.0, 2), ("model-2", 10.0, 50.0, 3)], "model string, price_in double, price_out double, ord int")


@query("""WITH u AS (SELECT conv_id, conv_id % 1000 AS i, length(text) AS o, 'model-' || conv_id % 4 || CASE WHEN conv_id % 3 = 0 THEN '-20250101' ELSE '' END AS m FROM conversations WHERE role = 'assistant'),
p AS (SELECT *, CASE WHEN m LIKE 'model-0%' THEN 1 WHEN m LIKE 'model-1%' THEN 3 WHEN m LIKE 'model-2-2025%' THEN 9 WHEN m LIKE 'model-2%' THEN 10 ELSE 5 END AS pin, CASE WHEN m LIKE 'model-0%' THEN 5 WHEN m LIKE 'model-1%' THEN 15 WHEN m LIKE 'model-2-2025%' THEN 9 WHEN m LIKE 'model-2%' THEN 50 ELSE 25 END AS pout FROM u)
SELECT conv_id, round(sum(i * pin / 1000000.0 + o * pout / 1000000.0), 8) AS cost FROM p GROUP BY conv_id""")
def usage_cost(spark, sf):
    entries = driver.conversation_entries(spark, sf).where("type = 'assistant'")
    usage = F.from_json(F.to_json(F.struct("input_tokens", "output_tokens")), traces.USAGE)
    priced = traces.with_price(entries.withColumn("usage", usage), "model", prices(spark), (5.0, 25.0))
    cost = traces.usage_cost(F.col("usage"), F.col("price_in"), F.col("price_out"))
    return priced.groupBy(F.col("file").alias("conv_id")).agg(F.round(F.sum(cost), 8).alias("cost"))


def as_documents(spark, sf, shape: str) -> DataFrame:
    """The events of each user as one document (path, text): native JSON or an OTLP export."""
    e = driver.event_steps(spark, sf)
    if shape == "native":
        step = F.struct("ord", "type", "label", F.col("started_at").alias("startedAt"), F.col("duration_ms").alias("durationMs"), "tokens", "cost", F.col("tool_name").alias("toolName"))
        text = F.to_json(F.struct(F.col("run_id").cast("string").alias("id"), F.lit("run").alias("name"), F.col("steps")))
        return e.groupBy("run_id").agg(F.sort_array(F.collect_list(step)).alias("steps")).select(F.col("run_id").cast("string").alias("path"), text.alias("text"))
    s = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue"), F.lit(None).cast("double").alias("doubleValue")).alias("value"))
    d = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(F.lit(None).cast("string").alias("stringValue"), v.alias("doubleValue")).alias("value"))
    attributes = F.array(s("trace.step.type", F.col("type")), s("trace.tool.name", F.col("tool_name")), d("trace.cost", F.col("cost")), d("gen_ai.usage.total_tokens", F.col("tokens")))
    nanos = lambda ms: F.concat(ms.cast("string"), F.lit("000000"))
    start = F.unix_millis("ts")
    span = F.struct("ord", F.col("label").alias("name"), nanos(start).alias("startTimeUnixNano"), nanos(start + F.col("duration_ms").cast("long")).alias("endTimeUnixNano"), attributes.alias("attributes"))
    rs = F.struct(F.struct(F.array(s("trace.run.id", F.col("run_id")), s("trace.run.status", F.when(F.col("run_id") % 2 == 0, "failed"))).alias("attributes")).alias("resource"), F.array(F.struct(F.col("spans"))).alias("scopeSpans"))
    return e.groupBy("run_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).select(F.col("run_id").cast("string").alias("path"), F.to_json(F.struct(F.array(rs).alias("resourceSpans"))).alias("text"))


ROUND_TRIP = f"WITH {STEPS} SELECT CAST(run_id AS VARCHAR) AS run_id, index, type, tool_name, cost, tokens, duration_ms FROM steps"


@query(ROUND_TRIP)
def native_read_back(spark, sf):
    """Events written as native documents and read back."""
    docs = traces.with_format(as_documents(spark, sf, "native")).where("format = 'native'")
    return traces.native(docs)[1].select("run_id", "index", "type", "tool_name", "cost", "tokens", "duration_ms")


@query(ROUND_TRIP)
def otlp_read_back(spark, sf):
    """Events written as OTLP exports and read back."""
    docs = traces.with_format(written(as_documents(spark, sf, "otlp"), "documents")).where("format = 'otlp'")
    return traces.otlp(docs)[1].select("run_id", "index", "type", "tool_name", "cost", "tokens", "duration_ms")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) AS steps, CASE WHEN user_id % 3 = 0 THEN 'completed' END AS ended FROM events WHERE user_id % 7 <> 0 GROUP BY user_id")
def journal_recordings(spark, sf):
    """Events as journals: every third has ended, every seventh has a half-written line and is left out."""
    e = driver.event_steps(spark, sf).select(F.col("run_id").alias("u"), "index", "id", "type", "label")
    step = F.to_json(F.struct(F.lit("step").alias("kind"), F.struct("id", "index", "type", "label").alias("step")))
    users = e.select("u").distinct()
    row = lambda df, line, raw: df.select(F.col("u").cast("string").alias("file"), F.lit(None).cast("timestamp").alias("modified"), line.cast("int").alias("line"), raw.alias("raw"))
    meta = F.to_json(F.struct(F.lit("meta").alias("kind"), F.lit(1).alias("formatVersion"), F.col("u").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("USD").alias("currency")))
    lines = row(users, F.lit(1), meta).unionByName(row(e, F.col("index") + 2, step)).unionByName(row(users.where("u % 3 = 0"), F.lit(10**6), F.lit('{"kind":"end","status":"completed"}'))).unionByName(row(users.where("u % 7 = 0"), F.lit(10**6 + 1), F.lit('{"kind":"st')))
    return traces.journals(lines)[0].select("run_id", "steps", "ended")


@query("""WITH t AS (SELECT conv_id, turn, role, regexp_replace(trim(text, ' ' || chr(9) || chr(10)), '\\s+', ' ', 'g') AS one FROM conversations WHERE role IN ('user', 'assistant'))
SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN length(min_by(one, turn) FILTER (WHERE role = 'user')) > 100 THEN substr(min_by(one, turn) FILTER (WHERE role = 'user'), 1, 97) || '…' ELSE min_by(one, turn) FILTER (WHERE role = 'user') END AS prompt, count(*) AS messages FROM t GROUP BY conv_id""")
def session_list(spark, sf):
    """Conversations as session logs, one summary each."""
    entries = driver.conversation_entries(spark, sf).where("type in ('user', 'assistant')")
    raw = F.to_json(F.struct("type", F.concat_ws("-", "file", "line").alias("uuid"), driver.iso(F.col("timestamp")).alias("timestamp"), F.col("file").cast("string").alias("sessionId"), F.struct(F.col("text").alias("content")).alias("message")))
    return traces.session_summaries(entries.select(F.col("file").cast("string").alias("file"), "line", raw.alias("raw"))).select("session_id", "prompt", "messages")


@query(f"WITH {STEPS}, {LOOPS}, w AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY first_index) - 1 AS ord, first_index, last_index FROM loops) SELECT w.run_id, CAST(w.ord AS INT) AS ord, s.index FROM w JOIN steps s ON s.run_id = w.run_id AND s.index BETWEEN w.first_index AND w.last_index")
def loop_steps(spark, sf):
    """The steps that loop warnings name."""
    steps = driver.event_steps(spark, sf)
    return report.warning_steps(analyze.warnings(steps, by_tool=True).where("kind = 'loop'"), steps).select("run_id", "ord", "index")


# ---- differences ------------------------------------------------------------------------------------------------


def event_pairs(spark, sf):
    """Each even user's run beside the next user's, with run ids as text."""
    steps = driver.event_steps(spark, sf).withColumn("run_id", F.col("run_id").cast("string")).withColumn("id", F.concat_ws(":", "run_id", "index"))
    users = driver.table(spark, sf, "events").select(F.col("user_id").alias("u")).distinct()
    pairs = users.where("u % 2 = 0").select(F.col("u").cast("string").alias("pair"), F.col("u").cast("string").alias("a_run"), (F.col("u") + 1).cast("string").alias("b_run"), F.lit(False).alias("same_currency"))
    return pairs.join(users.select(F.col("u").cast("string").alias("b_run")), "b_run", "left_semi"), steps


PAIRS = "pairs AS (SELECT DISTINCT user_id AS a FROM events WHERE user_id % 2 = 0 AND user_id + 1 IN (SELECT user_id FROM events))"


@query(f"WITH {STEPS}, {PAIRS}, c AS (SELECT run_id, tool_name, count(*) AS n FROM steps WHERE type = 'tool_call' GROUP BY ALL), x AS (SELECT a AS pair, tool_name, n AS a, 0 AS b FROM pairs JOIN c ON run_id = a UNION ALL SELECT a, tool_name, 0, n FROM pairs JOIN c ON run_id = a + 1) SELECT CAST(pair AS VARCHAR) AS pair, tool_name, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(b) - sum(a) AS BIGINT) AS delta FROM x GROUP BY pair, tool_name")
def tool_delta(spark, sf):
    pairs, steps = event_pairs(spark, sf)
    return diff.tool_deltas(pairs, steps)


@query(f"WITH {STEPS}, {PAIRS}, t AS (SELECT run_id, count(*) AS n, sum(tokens) AS tokens, sum(duration_ms) AS ms FROM steps GROUP BY run_id) SELECT CAST(p.a AS VARCHAR) AS pair, y.n - x.n AS steps, y.tokens - x.tokens AS tokens, CAST(NULL AS DOUBLE) AS cost, y.ms - x.ms AS duration_ms FROM pairs p JOIN t x ON x.run_id = p.a JOIN t y ON y.run_id = p.a + 1")
def total_delta(spark, sf):
    pairs, steps = event_pairs(spark, sf)
    return diff.total_deltas(pairs, analyze.totals(steps))


@query()
def align_pairs(spark, sf):
    pairs, steps = event_pairs(spark, sf)
    return diff.alignments(pairs, steps).drop("degraded")


@query()
def diff_summary(spark, sf):
    pairs, steps = event_pairs(spark, sf)
    return diff.summary(diff.step_differences(diff.alignments(pairs, steps), pairs, steps))


@query()
def diff_warnings(spark, sf):
    pairs, steps = event_pairs(spark, sf)
    return diff.warning_differences(pairs, diff.alignments(pairs, steps), steps, analyze.warnings(steps, by_tool=True)).groupBy("pair", "state", "kind").agg(F.count(F.lit(1)).alias("n"))


KINDS = f"WITH {STEPS}, {LOOPS}, {HIGH}, {COUNTS}, {PAIRS}, k AS (SELECT DISTINCT run_id, kind FROM found), a AS (SELECT pairs.a AS pair, kind FROM pairs JOIN k ON run_id = pairs.a), b AS (SELECT pairs.a AS pair, kind FROM pairs JOIN k ON run_id = pairs.a + 1)"


@query(f"{KINDS} SELECT CAST(pair AS VARCHAR) AS pair, kind, 'persisted' AS state FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT CAST(pair AS VARCHAR), kind, 'cleared' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT CAST(pair AS VARCHAR), kind, 'appeared' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def warning_kinds_compared(spark, sf):
    pairs, steps = event_pairs(spark, sf)
    kinds = analyze.warnings(steps, by_tool=True).select("run_id", "kind").distinct()
    side = lambda r: pairs.select("pair", F.col(f"{r}_run").alias("run_id")).join(kinds, "run_id").select("pair", "kind")
    a, b = side("a"), side("b")
    state = lambda df, s: df.withColumn("state", F.lit(s))
    return state(a.intersect(b), "persisted").unionByName(state(a.subtract(b), "cleared")).unionByName(state(b.subtract(a), "appeared"))


# ---- streaming --------------------------------------------------------------------------------------------------


@query(f"WITH {STEPS}, {LOOPS} SELECT CAST(run_id AS VARCHAR) AS run_id, count(*) AS steps, round(sum(cost), 2) AS cost, (SELECT count(*) FROM loops l WHERE l.run_id = steps.run_id) AS loops FROM steps GROUP BY run_id")
def live_run_state(spark, sf):
    """The events as a stream, folded into the state of each run; the last state of each."""
    return live.replay(spark, sf)


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS steps, round(sum(value), 2) AS cost FROM events GROUP BY 1, 2")
def daily_rollup(spark, sf):
    out = live.rollup(driver.table(spark, sf, "events").select("ts", F.col("event_type").alias("tool"), F.col("value").alias("cost")), "1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("tool").alias("event_type"), "steps", F.round("cost", 2).alias("cost"))
