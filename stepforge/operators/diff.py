"""Differences between pairs of runs: an alignment of steps, leaves, tools, totals and warnings.

A pair of runs is a row of `pairs` (pair, a_run, b_run). Steps align in three passes: a longest common subsequence of
(type, tool), what is left by equal identity first come first served, and within the gaps a subsequence by type.
Everything after the alignment is joins and aggregates.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import all_leaves
from ..schema import JSON_NAMES, PAYLOADS, Wire
from ..shared import apart

CELLS = 4_000_000
#: Bytes of rows that a search in bits keeps; beyond it, rows at intervals are kept and the others made again.
KEPT = 64 << 20


class BitRows:
    """Rows of a longest common subsequence's table as bits, from the last row up: bit k of row i is 0 where the length over the last k + 1 of b exceeds that over the last k.

    A row is made from the one below by a few operations on whole integers. All rows are kept if they are few bytes, else each
    so-manieth, between which a block of rows is made again as the walk comes to it: the root of their number, both times.
    """

    def __init__(self, a: Sequence, b: Sequence, kept: int = KEPT):
        self.a, self.m, self.full = a, len(b), (1 << len(b)) - 1
        places: dict[object, list[int]] = defaultdict(list)
        for k, x in enumerate(reversed(b)):
            places[x].append(k)
        self.where = {x: self.bits(ks) for x, ks in places.items()}
        n = len(a)
        self.step = 1 if n * len(b) // 8 <= kept else math.isqrt(n) + 1
        self.marks = {n: self.full}
        row = self.full
        for i in range(n - 1, -1, -1):
            row = self.above(row, i)
            if i % self.step == 0:
                self.marks[i] = row
        self.block: dict[int, int] = {}

    def bits(self, places: list[int]) -> int:
        out = bytearray(self.m // 8 + 1)
        for k in places:
            out[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(out, "little")

    def above(self, row: int, i: int) -> int:
        hit = row & self.where.get(self.a[i], 0)
        return ((row + hit) | (row - hit)) & self.full

    def row(self, i: int) -> int:
        if i in self.marks:
            return self.marks[i]
        if i not in self.block:
            low = i // self.step * self.step
            top = min(low + self.step, len(self.a))
            self.block, row = {}, self.marks[top]
            for k in range(top - 1, low, -1):
                self.block[k] = row = self.above(row, k)
        return self.block[i]

    def length(self, i: int, j: int) -> int:
        """Of a longest common subsequence of a from i and b from j on."""
        k = self.m - j
        return k - (self.row(i) & ((1 << k) - 1)).bit_count()


def exact_middle(a: Sequence, b: Sequence, kept: int = KEPT) -> list[tuple[int, int]]:
    """The pairs that subsequence() would find in a table, in memory that grows with one side and the root of the other."""
    rows, out, i, j = BitRows(a, b, kept), [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif not rows.row(i) >> (len(b) - 1 - j) & 1 or rows.length(i + 1, j) == rows.length(i, j):
            i += 1
        else:
            j += 1
    return out


def subsequence(a: Sequence, b: Sequence, cells: int = CELLS, exact: bool = False) -> tuple[list[tuple[int, int]], bool]:
    """(pairs of a longest common subsequence, whether it was too large to search).

    Common ends are paired without a search. Of equally long ones, the one that leaves out of `a` first is taken. Too
    large a middle pairs only the places where both agree; with exact it is searched in bits, and nothing is too large.
    """
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    most = min(len(a), len(b)) - head
    tail = next((k for k in range(most) if a[-1 - k] != b[-1 - k]), most)
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    out = [(k, k) for k in range(head)]
    n, m = len(mid_a), len(mid_b)
    large = n * m > cells
    if large and exact:
        out += [(head + i, head + j) for i, j in exact_middle(mid_a, mid_b)]
        large = False
    elif large:
        out += [(head + k, head + k) for k in range(min(n, m)) if mid_a[k] == mid_b[k]]
    elif n and m:
        codes = {x: i for i, x in enumerate(dict.fromkeys([*mid_a, *mid_b]))}
        right = np.array([codes[x] for x in mid_b])
        # best[i][j]: length from (i, j) on. A row is the running maximum, from the right, of what its cells offer.
        best = np.zeros((n + 1, m + 1), np.int32)
        for i in range(n - 1, -1, -1):
            offer = np.maximum(np.where(right == codes[mid_a[i]], best[i + 1, 1:] + 1, 0), best[i + 1, :-1])
            best[i, :m] = np.maximum.accumulate(offer[::-1])[::-1]
        i = j = 0
        while i < n and j < m:
            if codes[mid_a[i]] == right[j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1, j] >= best[i, j + 1]:
                i += 1
            else:
                j += 1
    return out + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)], large


def align(a: list[tuple], b: list[tuple], cells: int = CELLS, exact: bool = False) -> tuple[list[tuple[int | None, int | None, bool]], bool]:
    """([(place in a, place in b, moved)], degraded) in reading order; a and b hold (type, tool)."""
    anchors, degraded = subsequence(a, b, cells, exact)
    partner, moved = dict(anchors), set()
    taken = set(partner.values())
    free: dict[tuple, deque] = defaultdict(deque)
    for j, x in enumerate(b):
        if j not in taken:
            free[x].append(j)
    for i, x in enumerate(a):
        if i not in partner and free[x]:
            partner[i] = free[x].popleft()
            moved.add(i)
    taken = set(partner.values())
    edges = [(-1, -1), *anchors, (len(a), len(b))]
    for (a0, b0), (a1, b1) in zip(edges, edges[1:], strict=False):
        left = [i for i in range(a0 + 1, a1) if i not in partner]
        right = [j for j in range(b0 + 1, b1) if j not in taken]
        if left and right:
            found, large = subsequence([a[i][0] for i in left], [b[j][0] for j in right], cells, exact)
            degraded |= large
            partner |= {left[x]: right[y] for x, y in found}
    holder = {j: i for i, j in partner.items()}
    # Reading order follows a. Before a pair whose partner is still ahead, the steps only in b come, up to the next paired one.
    out: list[tuple[int | None, int | None, bool]] = []
    used: set[int] = set()
    j = 0

    def skip() -> None:
        nonlocal j
        while j < len(b) and j in used:
            j += 1

    for i in range(len(a)):
        p = partner.get(i)
        skip()
        while p is not None and j < len(b) and j != p and j not in holder:
            out.append((None, j, False))
            j += 1
            skip()
        if p is None:
            out.append((i, None, False))
        else:
            out.append((i, p, i in moved or j != p))
            used.add(p)
    out += [(None, k, False) for k in range(j, len(b)) if k not in used]
    return out, degraded


def alignments(pairs: DataFrame, steps: DataFrame, cells: int = CELLS, exact: bool = False) -> DataFrame:
    """Rows (pair, ord, a_pos, b_pos, moved, degraded). One pair's types and tools meet in one task, no payload does.

    cells: the product of lengths up to which a pair is searched in a table; exact: larger ones are searched too, and none is degraded.
    """
    slim = apart(steps.select("run_id", "pos", "type", F.coalesce("tool_name", F.lit("")).alias("tool")))
    side = lambda run: pairs.select("pair", F.col(run).alias("run_id")).join(slim, "run_id").select("pair", "pos", "type", "tool")

    both = side("a_run").withColumn("side", F.lit(0)).unionByName(side("b_run").withColumn("side", F.lit(1)))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cut: list[list] = [[], []]
        for which, *x in sorted(zip(*(rows.column(c).to_pylist() for c in ("side", "pos", "type", "tool")), strict=True)):
            cut[which].append(x)
        found, degraded = align(*[[(kind, tool) for _, kind, tool in x] for x in cut], cells, exact)
        place = lambda x, k: None if k is None else x[k][0]
        return pa.table({"pair": pa.array([key[0].as_py()] * len(found), pa.string()), "ord": pa.array(range(len(found)), pa.int64()), "a_pos": pa.array([place(cut[0], i) for i, _, _ in found], pa.int64()), "b_pos": pa.array([place(cut[1], j) for _, j, _ in found], pa.int64()), "moved": pa.array([m for _, _, m in found], pa.bool_()), "degraded": pa.array([degraded] * len(found), pa.bool_())})

    return both.groupBy("pair").applyInArrow(run, "pair string, ord long, a_pos long, b_pos long, moved boolean, degraded boolean")


def leaf_rows(steps: DataFrame, version: Column | None = None, wire: Wire = Wire()) -> DataFrame:
    """Rows (run_id, pos, path, value, redacted): every payload leaf. A leaf is redacted if it holds the marker, its salt
    is gone, or the log names it; a version 1 record names it by its ambiguous path."""
    version = F.coalesce(F.col("hash_version"), F.lit(1)) if version is None else version
    gone = F.array_union(F.coalesce(F.array_except(F.map_keys("commitments"), F.coalesce(F.map_keys("salts"), F.array().cast("array<string>"))), F.array().cast("array<string>")), F.coalesce(F.transform("redactions", lambda r: r["path"]), F.array().cast("array<string>")))
    out = steps.select("run_id", "pos", gone.alias("gone"), version.alias("v"), F.explode(all_leaves({c: JSON_NAMES[c] for c in PAYLOADS})).alias("x"))
    marker = F.lit('"' + wire.redacted + '"')
    return out.select("run_id", "pos", "x.path", "x.value", ((F.col("x.value") == marker) | F.array_contains("gone", F.when(F.col("v") == 2, F.col("x.path")).otherwise(F.col("x.legacy_path")))).alias("redacted"))


def leaf_differences(aligned: DataFrame, pairs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows (pair, ord, path, status, a, b): changed, added, removed, or redacted, which is never a change."""
    both = apart(aligned).where("a_pos is not null and b_pos is not null").join(pairs, "pair").select("pair", "ord", "a_run", "b_run", "a_pos", "b_pos")
    side = lambda r: both.join(apart(leaves).select(F.col("run_id").alias(f"{r}_run"), F.col("pos").alias(f"{r}_pos"), "path", F.col("value").alias(r), F.col("redacted").alias(f"{r}_gone")), [f"{r}_run", f"{r}_pos"]).select("pair", "ord", "path", r, f"{r}_gone")
    out = side("a").join(apart(side("b")), ["pair", "ord", "path"], "full_outer")
    status = F.when(F.col("b_gone").isNull(), "removed").when(F.col("a_gone").isNull(), "added").when(F.col("a_gone") | F.col("b_gone"), "redacted").when(F.col("a") != F.col("b"), "changed")
    return out.select("pair", "ord", "path", status.alias("status"), F.when(~F.col("a_gone"), F.col("a")).alias("a"), F.when(~F.col("b_gone"), F.col("b")).alias("b")).where("status is not null")


def step_differences(aligned: DataFrame, pairs: DataFrame, steps: DataFrame, leaf_diffs: DataFrame | None = None) -> DataFrame:
    """Rows (pair, ord, kind, moved, a_pos, b_pos, fields, tokens_delta, cost_delta, duration_delta, incomparable).

    kind: same, changed, added or removed. Durations never make a change; costs in two currencies have no delta, but differ
    if their numbers do. fields: which of label, type and tool differ.
    """
    cols = ["pos", "label", "type", "tool_name", "tokens", "cost", "duration_ms"]
    side = lambda r: apart(steps).select(F.col("run_id").alias(f"{r}_run"), *[F.col(c).alias(f"{r}_{c}") for c in cols])
    out = apart(aligned).join(pairs, "pair").join(side("a"), ["a_run", "a_pos"], "left").join(side("b"), ["b_run", "b_pos"], "left")
    n = leaf_diffs.groupBy("pair", "ord").agg(F.count_if(F.col("status") == "redacted").alias("gone"), F.count_if(F.col("status") != "redacted").alias("real")) if leaf_diffs is not None else None
    out = out.join(apart(n), ["pair", "ord"], "left") if n is not None else out.withColumns({"gone": F.lit(0), "real": F.lit(0)})
    both = F.col("a_pos").isNotNull() & F.col("b_pos").isNotNull()
    fields = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(n)) for c, n in (("label", "label"), ("type", "type"), ("tool_name", "toolName"))]))
    change = (F.size(fields) > 0) | (F.coalesce("real", F.lit(0)) > 0) | (F.col("a_tokens") != F.col("b_tokens")) | (F.col("a_cost") != F.col("b_cost"))
    kind = F.when(F.col("b_pos").isNull(), "removed").when(F.col("a_pos").isNull(), "added").when(change, "changed").otherwise("same")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    money = F.when(F.col("same_currency"), zero("b_cost") - zero("a_cost")) if "same_currency" in pairs.columns else zero("b_cost") - zero("a_cost")
    return out.select("pair", "ord", kind.alias("kind"), F.col("moved") & both, "a_pos", "b_pos", F.when(both, fields).otherwise(F.array().cast("array<string>")).alias("fields"), (zero("b_tokens") - zero("a_tokens")).alias("tokens_delta"), money.alias("cost_delta"), (zero("b_duration_ms") - zero("a_duration_ms")).alias("duration_delta"), F.coalesce("gone", F.lit(0)).alias("incomparable")).toDF("pair", "ord", "kind", "moved", "a_pos", "b_pos", "fields", "tokens_delta", "cost_delta", "duration_delta", "incomparable")


def summary(step_diffs: DataFrame) -> DataFrame:
    """Rows (pair, same, changed, added, removed, moved, incomparable)."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return step_diffs.groupBy("pair").agg(*map(count, ("same", "changed", "added", "removed")), F.count_if("moved").alias("moved"), F.sum("incomparable").alias("incomparable"))


def tool_deltas(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (pair, tool_name, a, b, delta), larger differences first within a pair."""
    calls = steps.where((F.col("type") == "tool_call") & F.col("tool_name").isNotNull()).groupBy("run_id", "tool_name").agg(F.count(F.lit(1)).alias("n"))
    side = lambda r: pairs.select("pair", F.col(f"{r}_run").alias("run_id")).join(apart(calls), "run_id").select("pair", "tool_name", F.col("n").alias(r))
    out = side("a").join(apart(side("b")), ["pair", "tool_name"], "full_outer").fillna(0, ["a", "b"])
    return out.withColumn("delta", F.col("b") - F.col("a")).orderBy("pair", F.desc(F.abs("delta")), "tool_name")


def total_deltas(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (pair, steps, tokens, cost, duration_ms): b - a; cost is null across currencies."""
    side = lambda r: apart(totals).select(F.col("run_id").alias(f"{r}_run"), *[F.col(c).alias(f"{r}_{c}") for c in ("steps", "tokens", "cost", "duration_ms")])
    out = pairs.join(side("a"), "a_run").join(side("b"), "b_run")
    delta = lambda c: (F.col(f"b_{c}") - F.col(f"a_{c}"))
    cost = F.when(F.col("same_currency"), delta("cost")) if "same_currency" in pairs.columns else delta("cost")
    return out.select("pair", delta("steps").alias("steps"), delta("tokens").alias("tokens"), cost.alias("cost"), delta("duration_ms").alias("duration_ms"))


def warning_differences(pairs: DataFrame, aligned: DataFrame, steps: DataFrame, warnings: DataFrame) -> DataFrame:
    """Rows (pair, state, kind, signature): persisted, cleared or appeared. a's step ids are read as their partners' in b;
    a's repeated warnings count each, b's once."""
    pairs, ids = apart(pairs), apart(steps).select("run_id", "pos", "id")
    partner = aligned.where("a_pos is not null and b_pos is not null").join(pairs, "pair").join(ids.select(F.col("run_id").alias("a_run"), F.col("pos").alias("a_pos"), F.col("id").alias("a_id")), ["a_run", "a_pos"]).join(ids.select(F.col("run_id").alias("b_run"), F.col("pos").alias("b_pos"), F.col("id").alias("b_id")), ["b_run", "b_pos"]).select("pair", "a_id", "b_id")
    mine = pairs.join(warnings.select(F.col("run_id").alias("a_run"), "ord", "kind", "step_ids"), "a_run").select("pair", "ord", "kind", F.explode_outer("step_ids").alias("a_id"))
    key = lambda x: F.array_join(F.array_sort(F.collect_list(x)), ",").alias("signature")
    a = mine.join(apart(partner), ["pair", "a_id"], "left").groupBy("pair", "ord", "kind").agg(key(F.coalesce("b_id", F.concat(F.lit("?"), "a_id"))))
    b = pairs.join(warnings.select(F.col("run_id").alias("b_run"), "kind", "step_ids"), "b_run").select("pair", "kind", F.array_join(F.array_sort("step_ids"), ",").alias("signature")).distinct()
    # One outer join, so that neither side is worked out for each state anew.
    both = a.withColumn("in_a", F.lit(True)).join(apart(b).withColumn("in_b", F.lit(True)), ["pair", "kind", "signature"], "full_outer")
    state = F.when(F.col("in_a").isNull(), "appeared").when(F.col("in_b").isNull(), "cleared").otherwise("persisted")
    return both.select("pair", state.alias("state"), "kind", "signature")


def caveats(pairs: DataFrame, diff_summary: DataFrame, aligned: DataFrame) -> DataFrame:
    """Rows (pair, caveats): why a comparison is less than whole. pairs with a_version, b_version, same_currency."""
    slow = aligned.groupBy("pair").agg(F.bool_or("degraded").alias("degraded"))
    found = [F.when(F.col("a_version") != F.col("b_version"), "hash-version-mismatch"), F.when(~F.col("a_version").isin(1, 2) | ~F.col("b_version").isin(1, 2), "unsupported-hash-version"), F.when(~F.col("same_currency"), "currency-mismatch"), F.when(F.col("incomparable") > 0, "redacted-leaves"), F.when(F.col("degraded"), "alignment-degraded")]
    return pairs.join(apart(diff_summary), "pair", "left").join(apart(slow), "pair", "left").select("pair", F.array_compact(F.array(*found)).alias("caveats"))


def equivalent(pairs: DataFrame, diff_summary: DataFrame, warning_diffs: DataFrame) -> DataFrame:
    """Rows (pair, equivalent): nothing changed, added, removed or moved, no warning came or went, one currency."""
    news = warning_diffs.where("state <> 'persisted'").groupBy("pair").agg(F.count(F.lit(1)).alias("news"))
    same = (F.col("changed") + F.col("added") + F.col("removed") + F.col("moved") == 0) & F.col("news").isNull() & (F.col("same_currency") if "same_currency" in pairs.columns else F.lit(True))
    return pairs.join(apart(diff_summary), "pair").join(apart(news), "pair", "left").select("pair", same.alias("equivalent"))
