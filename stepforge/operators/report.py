"""Reports about one run, rendered on the driver from small collected frames."""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analyze import fixed

#: The steps of a run that a page shows; a longer run is cut there and says so.
SHOWN = 10_000


def ascii_html(x: object) -> str:
    """Text that is safe in HTML and in any encoding."""
    out = str("" if x is None else x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    return out.encode("ascii", "xmlcharrefreplace").decode()


def markdown_cell(x: object) -> str:
    return str("" if x is None else x).replace("\\", "\\\\").replace("|", "\\|").replace("`", "\\`").replace("<", "&lt;").replace("\r", "").replace("\n", " ")


def money(x: float, currency: str) -> str:
    return f"{currency} {fixed(x)}"


def duration_label(x: float) -> str:
    """Milliseconds below a second, else seconds."""
    return f"{fixed(x / 1000)} s" if x >= 1000 else f"{commas(x)} ms"


def commas(x: float) -> str:
    """A whole number with thousands separators; halves go up."""
    return f"{math.floor(x + 0.5):,}"


def human_bytes(n: int) -> str:
    """Bytes as a listing shows them, in binary units with one place."""
    if n < 1024:
        return f"{n} B"
    return f"{fixed(n / 1024, 1)} KiB" if n < 1024**2 else f"{fixed(n / 1024**2, 1)} MiB"


def age(then: str, now: str) -> str:
    """How long ago an ISO time was: minutes, hours, days or months; nothing for a time that can't be read."""
    try:
        a, b = (datetime.fromisoformat(x.replace("Z", "+00:00")) for x in (then, now))
        n = math.floor((b - a).total_seconds() / 60 + 0.5)
    except (AttributeError, TypeError, ValueError):
        return ""
    if n < 1:
        return "just now"
    for unit, size, limit in (("m", 1, 60), ("h", 60, 24), ("d", 24, 30)):
        n = math.floor(n / size + 0.5)
        if n < limit:
            return f"{n}{unit} ago"
    return f"{math.floor(n / 30 + 0.5)}mo ago"


def clock(iso: str) -> str:
    """The UTC time of day of an ISO time, with milliseconds."""
    return datetime.fromisoformat(iso.replace("Z", "+00:00")).astimezone(UTC).strftime("%H:%M:%S.%f")[:-3]


def compliance(runs: DataFrame, steps: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows (run_id, authentic, signed, key_id, steps, complete, approvals, data_steps, tables, redactions).

    complete: positions run from 0 without a gap and the stored count agrees. data_steps: steps with a data payload.
    """
    some = F.col("data_payload").isNotNull()
    n = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("low"), F.max("index").alias("high"), F.count_if(F.col("type") == "approval").alias("approvals"), F.count_if(some).alias("data_steps"), F.array_sort(F.collect_set(payload_table(F.col("data_payload")))).alias("tables"), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("redactions"), F.lit(0)))).alias("redactions"))
    out = runs.join(n, "run_id", "left").join(verdicts.select("run_id", "all_ok"), "run_id", "left")
    whole = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("totals.steps") == F.col("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("run_id", F.coalesce("all_ok", F.lit(False)).alias("authentic"), F.col("signature").isNotNull().alias("signed"), F.col("signature.keyId").alias("key_id"), F.coalesce("n", F.lit(0)).alias("steps"), F.coalesce(whole, F.lit(False)).alias("complete"), zero("approvals"), zero("data_steps"), "tables", zero("redactions"))


def access(payload: Column, kind: Column) -> Column:
    """READ or MUTATED: what a payload's `_access` says, else by the step's type; null without a payload."""
    said = F.upper(F.get_json_object(payload, "$._access"))
    record = payload.startswith("{")
    return F.when(payload.isNull() | (payload == "null"), None).when(record & said.isin("READ", "MUTATED"), said).when(record & kind.isin("final_output", "branch"), "MUTATED").otherwise("READ")


def payload_view(payload: Column) -> Column:
    """A payload's members without `_access`, as a map of JSON texts."""
    return F.map_filter(F.from_json(payload, "map<string,string>"), lambda k, v: k != "_access")


def payload_table(payload: Column) -> Column:
    """The table that a payload says it touched."""
    return F.get_json_object(payload, "$.table")


def warning_steps(warnings: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (run_id, ord, kind, index, label): the steps that each warning names."""
    named = warnings.select("run_id", "ord", "kind", F.explode("step_ids").alias("id"))
    return named.join(steps.select("run_id", "id", "index", "label"), ["run_id", "id"]).select("run_id", "ord", "kind", "index", "label")


def html(runs: DataFrame, steps: DataFrame, verdicts: DataFrame, warnings: DataFrame, run_id: str) -> str:
    """A standalone page about one run: header, verdict, warnings and steps."""
    own = lambda df: df.where(F.col("run_id") == run_id)
    run, verdict = own(runs).first(), own(verdicts).first()
    if run is None:
        raise ValueError(f"no run {run_id}")
    rows = own(steps).select("index", "type", "label", "tool_name", "started_at", "duration_ms", "cost", "hash").orderBy("pos").limit(SHOWN + 1).collect()
    e = ascii_html
    table = lambda head, body: "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(c)}</td>" for c in r) + "</tr>" for r in body) + "</table>"
    state = "intact" if verdict and verdict["all_ok"] else f"NOT intact ({verdict['failure'] or 'signature or seal'})" if verdict else "not verified"
    parts = [f"<h1>{e(run['name'])}</h1>", f"<p>Run {e(run_id)}, {e(run['status'])}, {e(run['started_at'])} to {e(run['ended_at'])}. Record: <b>{e(state)}</b>. Anchor: <code>{e(run['run_hash'])}</code></p>"]
    log = own(steps).select("index", F.explode("redactions").alias("r")).select("index", "r.path", F.coalesce("r.reason", F.lit("redacted")), F.coalesce("r.by", F.lit("manual")), "r.at")
    approved = own(steps).where(F.col("type") == "approval").select("index", "label", "started_at")
    data = own(steps).where("data_payload is not null").select("index", F.coalesce("tool_name", "type"), access(F.col("data_payload"), F.col("type")), F.substring("data_payload", 1, 160))
    for title, head, frame in (("Approvals", ("#", "label", "at"), approved), ("Redactions", ("#", "path", "reason", "by", "at"), log), ("Data read or mutated", ("#", "by", "access", "payload"), data)):
        parts += [f"<h2>{title}</h2>", table(head, frame.orderBy("index").limit(SHOWN).collect())]
    parts += ["<h2>Warnings</h2>", table(("kind", "message"), [(w["kind"], w["message"]) for w in own(warnings).orderBy("ord").limit(SHOWN).collect()])]
    parts += ["<h2>Steps</h2>", table(("#", "type", "label", "tool", "start", "ms", "cost", "hash"), rows[:SHOWN])] + ["<p>Further steps are left out.</p>"] * (len(rows) > SHOWN)
    return "<!doctype html><html><head><meta charset='utf-8'><title>" + e(run["name"]) + "</title></head><body>" + "".join(parts) + "</body></html>"


def ci_markdown(verdicts: DataFrame, violations: DataFrame, most: int = 50) -> str:
    """A summary for a pull request: what failed, and the first violations."""
    n = verdicts.agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("ok")).alias("bad")).first()
    out = [f"**{n['runs']} runs, {n['bad']} with an integrity failure**", "", "| run | rule | pattern | hits |", "|-|-|-|-|"]
    for v in violations.orderBy("run_id", "rule_ord").limit(most).collect():
        out.append("| " + " | ".join(markdown_cell(v[c]) for c in ("run_id", "rule", "pattern", "hits")) + " |")
    return "\n".join(out) + "\n"
