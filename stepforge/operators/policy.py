"""Guardrail policies: rules over runs, steps and warnings, each of which is read once and tagged with what it offends."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The rules of a policy document and what each one holds.
RULES = {
    "maxCostPerRun": float, "maxTokensPerRun": float, "maxSteps": int, "maxCostPerStep": float, "forbidTools": list,
    "requireApprovalFor": list, "forbidInputText": list, "requireSignature": bool, "forbidWarnings": list,
}


@dataclass(frozen=True)
class Policy:
    maxCostPerRun: float | None = None
    maxTokensPerRun: float | None = None
    maxSteps: int | None = None
    maxCostPerStep: float | None = None
    forbidTools: tuple[str, ...] = ()
    requireApprovalFor: tuple[str, ...] = ()
    forbidInputText: tuple[str, ...] = ()
    requireSignature: bool = False
    forbidWarnings: tuple[str, ...] = ()
    name: str | None = None


def parse_policy(text: str) -> Policy:
    """A policy from JSON; unknown members and values of a wrong kind are errors."""
    doc = json.loads(text)
    if not isinstance(doc, dict) or set(doc) - {"name", "rules"} or not isinstance(doc.get("rules"), dict):
        raise ValueError("a policy holds `rules`, and may hold `name`")
    if unknown := set(doc["rules"]) - set(RULES):
        raise ValueError(f"unknown rules: {', '.join(sorted(unknown))}")
    found = {}
    for name, value in doc["rules"].items():
        kind = RULES[name]
        number = isinstance(value, (int, float)) and not isinstance(value, bool) and value > 0
        good = {float: number, int: number and value == int(value) if number else False, bool: isinstance(value, bool), list: isinstance(value, list) and all(isinstance(x, str) and x for x in value)}[kind]
        if not good:
            raise ValueError(f"{name} holds a {kind.__name__}")
        found[name] = tuple(value) if kind is list else value
    return Policy(name=doc.get("name"), **found)


#: Zero-width code points that a folded tool name is without.
INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF])


def fold_name(name: str) -> str:
    return unicodedata.normalize("NFKC", name).translate(INVISIBLE).strip().lower()


@F.pandas_udf(T.StringType())
def folded_batch(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in names:
        yield x.map(fold_name, na_action="ignore")


def folded(tool: Column) -> Column:
    """fold_name() of a column: native for plain ASCII, a vectorised function for the rest."""
    plain = tool.rlike(r"\A[\x20-\x7e]*\z")
    return F.when(plain, F.lower(F.trim(tool))).otherwise(folded_batch(F.when(~plain, tool)))


def tool_matches(name: Column, pattern: str) -> Column:
    """`*`, `*suffix`, `prefix*` or the whole name; a star elsewhere stands for itself. name is folded already."""
    p = fold_name(pattern)
    if p == "*":
        return F.lit(True)
    if p.startswith("*"):
        return name.endswith(p[1:])
    return name.startswith(p[:-1]) if p.endswith("*") else name == p


HIT = "struct<rule_ord:int,at:int,rule:string,pattern:string>"


def hit(where: Column, order: int, rule: str, pattern: str | None = None, at: int = 0) -> Column:
    """What a row offends where the condition holds; `at` tells equal patterns of a rule apart."""
    one = F.struct(F.lit(order).alias("rule_ord"), F.lit(at).alias("at"), F.lit(rule).alias("rule"), F.lit(pattern).cast("string").alias("pattern"))
    return F.when(where, one.cast(HIT))


def exploded(df: DataFrame, hits: list[Column], *columns: str) -> DataFrame:
    """Rows (*columns, rule_ord, at, rule, pattern), one for each hit, from a single pass over df."""
    return df.select(*columns, F.explode(F.array_compact(F.array(*hits))).alias("x")).select(*columns, "x.*")


def offending_steps(steps: DataFrame, policy: Policy) -> DataFrame | None:
    """Rows (run_id, index, id, rule_ord, at, rule, pattern): each step that offends a rule on steps; None without such a rule."""
    call = (F.col("type") == "tool_call") & F.col("tool_name").isNotNull()
    hits = []
    if policy.maxCostPerStep is not None:
        hits.append(hit(F.col("cost") > policy.maxCostPerStep, 3, "maxCostPerStep"))
    named = lambda x: F.col("tool").isNotNull() & tool_matches(F.col("tool"), x)
    hits += [hit(named(x), 4, "forbidTools", x, i) for i, x in enumerate(policy.forbidTools)]
    # The first approval of a run decides, so that no range join is needed.
    early = F.col("approved").isNull() | (F.col("index") <= F.col("approved"))
    hits += [hit(early & named(x), 5, "requireApprovalFor", x, i) for i, x in enumerate(policy.requireApprovalFor)]
    hits += [hit(F.lower("input").contains(x.lower()), 6, "forbidInputText", x, i) for i, x in enumerate(policy.forbidInputText)]
    if not hits:
        return None
    if policy.forbidTools or policy.requireApprovalFor:
        steps = steps.withColumn("tool", folded(F.when(call, F.col("tool_name"))))
    if policy.requireApprovalFor:
        steps = steps.withColumn("approved", F.min(F.when(F.col("type") == "approval", F.col("index"))).over(Window.partitionBy("run_id")))
    return exploded(steps, hits, "run_id", "index", "id")


def evaluate(runs: DataFrame, steps: DataFrame, warnings: DataFrame, policy: Policy) -> DataFrame:
    """Rows (run_id, rule_ord, rule, pattern, hits, first_index, step_ids): all violations.

    runs: (run_id, cost, tokens, steps, signed), the stored totals. steps: run_id, index, id, type, tool_name, cost, input.
    warnings: (run_id, kind), the stored ones. Tool rules look at tool calls only; any approval with a lower index
    covers a call; input text is searched as it is serialised, in any case. Runs and steps are each read once, whatever
    the number of rules. A violation lists all its steps; offending_steps() has them one by one.
    """
    none, empty = F.lit(None).cast("long"), F.array().cast("array<string>")
    head = ["run_id", "rule_ord", "at", "rule", "pattern"]
    whole = [hit(F.col(column) > limit, order, rule) for order, (rule, column) in enumerate((("maxCostPerRun", "cost"), ("maxTokensPerRun", "tokens"), ("maxSteps", "steps"))) if (limit := getattr(policy, rule)) is not None]
    if policy.requireSignature:
        whole.append(hit(~F.col("signed"), 7, "requireSignature"))
    parts = [exploded(runs, whole or [F.lit(None).cast(HIT)], "run_id").select(*head, F.lit(1).cast("long").alias("hits"), none.alias("first_index"), empty.alias("step_ids"))]
    if (found := offending_steps(steps, policy)) is not None:
        ids = F.transform(F.array_sort(F.collect_list(F.struct("index", "id"))), lambda x: x["id"]).alias("step_ids")
        parts.append(found.groupBy(*head).agg(F.count(F.lit(1)).alias("hits"), F.min("index").alias("first_index"), ids))
    if policy.forbidWarnings:
        kinds = [*dict.fromkeys(policy.forbidWarnings)]
        some = warnings.where(F.col("kind").isin(kinds)).groupBy("run_id", F.col("kind").alias("pattern")).agg(F.count(F.lit(1)).alias("hits"))
        parts.append(some.select("run_id", F.lit(8).alias("rule_ord"), F.lit(0).alias("at"), F.lit("forbidWarnings").alias("rule"), "pattern", "hits", none.alias("first_index"), empty.alias("step_ids")))
    return reduce(DataFrame.unionByName, parts).drop("at")


def verdicts(runs: DataFrame, violations: DataFrame) -> DataFrame:
    """Rows (run_id, ok, violations): a warning of a forbidden kind is a violation each, any other rule and pattern one."""
    n = violations.groupBy("run_id").agg(F.sum(F.when(F.col("rule") == "forbidWarnings", F.col("hits")).otherwise(1)).alias("violations"))
    return runs.select("run_id").join(n, "run_id", "left").select("run_id", F.col("violations").isNull().alias("ok"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


assert {f.name for f in fields(Policy)} == {*RULES, "name"}
