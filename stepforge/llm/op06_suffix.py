"""Substring dedup by a sparse suffix array and a common-prefix-aware distributed merge sort.

Of all suffixes, those at minimisers are sorted: the least of the 16-byte hashes in the first 300 bytes of a window
of 400 depends on the window's bytes alone, so that two equal windows have it at the same offset, and a suffix for
about every 140 bytes is enough. A suffix whose bytes, from 284 before it to 400 after it, stand elsewhere too is repeated
as far as its windows reach. Of the others, those that share 116 bytes with another form sorted runs, front-coded,
which shards merge in loser trees: a key's known common prefix with the last winner decides most matches, and the rest
compare from there on. Along the merged order, the intervals of common prefixes give for each suffix how far its longest
match reaches to either side.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, gathered, sliced, small_batches, table, written

#: Bytes of a window, of the stretch that names its suffix, and of the hashed grams in it.
WINDOW, STRETCH, GRAM = 400, 300, 16
LEFT = STRETCH - GRAM
#: What a window's suffix shares with its equal's at least.
SHARED = WINDOW - LEFT
CHUNK = 2 << 20
#: Suffixes for each shard of the merge sort. A group of more that share SHARED bytes is compared window by window.
SHARD, HOT = 16_000, 20_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place on; the last places are padded with zeros."""
    n = len(data)
    data = np.append(data, np.zeros(32, np.uint8))
    word = np.empty(n + 8, np.uint64)
    for j in range(8):
        part = data[j : j + (n + 15 - j) // 8 * 8]
        part = part[: len(part) // 8 * 8].view("<u8")
        word[j::8] = part[: len(word[j::8])]
    with np.errstate(over="ignore"):
        h = word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ word[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


def least(keys: np.ndarray, size: int) -> np.ndarray:
    """The least of every `size` keys in a row: least suffixes and prefixes of blocks meet."""
    n = len(keys) - size + 1
    blocks = np.append(keys, np.full(-len(keys) % size, np.uint64(2**64 - 1))).reshape(-1, size)
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(tail[:n], head[size - 1 : size - 1 + n])


def minimisers(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The places that name a window of one of the texts that begin at `begin` (its last entry: the end)."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(24, int(len(data)).bit_length()))
    keys = gram_hashes(data) >> bits << bits | np.arange(len(data), dtype=np.uint64)
    low = least(keys, LEFT + 1)[: len(data) - WINDOW + 1]
    inside = np.zeros(len(data) + 1, np.int64)
    sizes = np.diff(begin)
    long = sizes >= WINDOW
    np.add.at(inside, begin[:-1][long], 1)
    np.add.at(inside, (begin[:-1] + sizes - WINDOW + 1)[long], -1)
    low = low[np.cumsum(inside)[: len(low)] > 0]
    return np.unique((low & np.uint64((1 << int(bits)) - 1)).astype(np.int64))


def suffixes(rows: DataFrame) -> DataFrame:
    """Rows (row, at, shared, whole): each suffix, hashes of the bytes it must share and of all its windows' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, 1, CHUNK):
            raw = [(x or "").encode() for x in block.column(1).to_pylist()]
            begin = np.append(0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))))
            data = b"".join(raw)
            places = minimisers(np.frombuffer(data, np.uint8), begin)
            doc = np.searchsorted(begin, places, side="right") - 1
            low, high = np.maximum(begin[doc], places - LEFT), np.minimum(begin[doc + 1], places + WINDOW)
            digest = xxhash.xxh3_64_intdigest
            shared = np.array([digest(data[p : p + SHARED]) for p in places.tolist()], np.uint64)
            whole = np.array([digest(data[a:b], p - a) for a, b, p in zip(low.tolist(), high.tolist(), places.tolist(), strict=True)], np.uint64)
            numbers = block.column(0).to_numpy()
            for i in range(0, len(places), 65536):
                j = slice(i, i + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(numbers[doc[j]]), pa.array((places - begin[doc])[j].astype(np.int32)), pa.array(shared[j].view(np.int64)), pa.array(whole[j].view(np.int64))], ["row", "at", "shared", "whole"])

    return rows.select("row", "text").mapInArrow(run, "row long, at int, shared long, whole long")


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    return n if x == y else n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


class Run:
    """A sorted run that is read front-coded: each key is a prefix of the one before it and what follows."""

    def __init__(self, entries: Iterable[tuple]):
        self.entries, self.key, self.lcp, self.rest = iter(entries), b"", 0, None
        self.step()

    def step(self) -> None:
        entry = next(self.entries, None)
        if entry is None:
            self.key, self.lcp = None, -1
        else:
            self.lcp, tail, *self.rest = entry
            self.key = self.key[: self.lcp] + tail


def front_coded(entries: list[tuple]) -> list[tuple]:
    """Sorted entries (key, ...) as (common prefix with the one before, rest of the key, ...)."""
    out, last = [], b""
    for key, *rest in entries:
        n = common(last, key)
        out.append((n, key[n:], *rest))
        last = key
    return out


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, list]]:
    """(common prefix with the last key, key, rest) in order, from a loser tree of common prefixes.

    A node keeps its loser and the loser's common prefix with the winner that went past it. Of two keys, the one that
    shares more with the last winner is the lesser; if they share as much, they are compared from there on.
    """
    n = 1 << max(0, len(runs) - 1).bit_length()
    runs = runs + [Run(()) for _ in range(n - len(runs))]
    lcp = [0 if r.key is not None else -1 for r in runs]

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser)"""
        if lcp[i] != lcp[j]:
            return (i, j) if lcp[i] > lcp[j] else (j, i)
        if lcp[i] < 0:
            return i, j
        a, b = runs[i].key, runs[j].key
        h = common(a, b, lcp[i])
        if (a[h:] or b"") <= (b[h:] or b""):
            lcp[j] = h
            return i, j
        lcp[i] = h
        return j, i

    loser = [0] * n

    def build(node: int) -> int:
        if node >= n:
            return node - n
        win, loser[node] = play(build(2 * node), build(2 * node + 1))
        return win

    win = build(1)
    while runs[win].key is not None:
        yield lcp[win], runs[win].key, runs[win].rest
        runs[win].step()
        lcp[win] = runs[win].lcp
        node = (win + n) // 2
        while node:
            win, loser[node] = play(win, loser[node])
            node //= 2


def reaches(order: Iterable[tuple[int, bytes, list]]) -> Iterator[tuple[int, int, int, int]]:
    """(row, at, bytes before, bytes after) of the matches of each suffix that stands alone with its whole surroundings.

    order: merged(), where rest is (reversed bytes before, row, at, times). Sets of suffixes join from the deepest
    common prefix up, the smaller into the larger, kept in order of the bytes before: there the neighbours share most.
    """
    found: dict[tuple[int, int], list[int]] = {}
    stack: list[tuple[int, list]] = []  # (common prefix with what stands below, ordered set)

    def tell(x: tuple, before: int, after: int) -> None:
        if x[3] == 1:
            best = found.setdefault((x[1], x[2]), [0, 0])
            best[0], best[1] = max(best[0], before), max(best[1], after)

    def join(a: list, b: list, depth: int) -> list:
        if len(a) < len(b):
            a, b = b, a
        pairs = []
        for x in b:
            k = bisect_left(a, x)
            pairs += [(x, a[j], common(x[0], a[j][0])) for j in (k - 1, k) if 0 <= j < len(a)]
        for x, y, before in pairs:
            if before + depth >= WINDOW:
                tell(x, before, depth)
                tell(y, before, depth)
        for x in b:
            insort(a, x)
        return a

    def fold(depth: int) -> None:
        while len(stack) > 1 and stack[-1][0] >= depth:
            h, top = stack.pop()
            below, under = stack.pop()
            stack.append((below, join(under, top, h)))

    for h, _, rest in order:
        if h < SHARED:
            fold(0)
            stack.clear()
            yield from ((*k, *v) for k, v in found.items())
            found.clear()
        else:
            fold(h + 1)
        stack.append((h, [tuple(rest)]))
    fold(0)
    yield from ((*k, *v) for k, v in found.items())


ENTRY = "array<struct<lcp:int,tail:binary,before:binary,row:long,at:int,times:long>>"


def merge_sort(near: DataFrame, shards: int) -> DataFrame:
    """Rows (row, at, before, after). near: (row, text, hold), hold an array of (at, shared, times)."""
    entry = pa.struct([("lcp", pa.int32()), ("tail", pa.binary()), ("before", pa.binary()), ("row", pa.int64()), ("at", pa.int32()), ("times", pa.int64())])
    names = [f.name for f in entry]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, 1, CHUNK):
            by_shard: dict[int, list[tuple]] = {}
            for row, text, hold in zip(*(block.column(i).to_pylist() for i in range(3)), strict=True):
                for x in hold:
                    at = x["at"]
                    by_shard.setdefault(x["shared"] % shards, []).append((text[at : at + WINDOW], text[max(0, at - LEFT) : at][::-1], row, at, x["times"]))
            for shard, entries in by_shard.items():
                entries.sort()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([[dict(zip(names, x, strict=True)) for x in front_coded(entries)]], pa.list_(entry))], ["shard", "run"])

    def merge(rows: pa.Table) -> pa.Table:
        out = list(reaches(merged([Run(tuple(x.values()) for x in run.as_py()) for run in rows.column("run")])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], ["row", "at", "before", "after"])

    return near.mapInArrow(runs, f"shard int, run {ENTRY}").groupBy("shard").applyInArrow(merge, "row long, at int, before int, after int")


def hot_windows(near: DataFrame) -> DataFrame:
    """Rows (row, at, before, after) as merge_sort() gives them, for suffixes whose group is too large for one task.

    A suffix has one row for each window that it may name; equal windows of a group meet by a 96-bit hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, hold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out = []
                for x in hold:
                    at = x["at"]
                    for before in range(max(0, at + WINDOW - len(text)), min(LEFT, at) + 1):
                        window = text[at - before : at - before + WINDOW]
                        h = xxhash.xxh3_128_intdigest(window)
                        out.append((row, at, x["shared"], before, (h & (1 << 64) - 1) - (1 << 63), (h >> 64 & (1 << 32) - 1) - (1 << 31), x["times"]))
                if out:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "at", "shared", "before", "a", "b", "times"])

    keys = ["shared", "before", "a", "b"]
    rows = near.mapInArrow(run, "row long, at int, shared long, before int, a long, b int, times long")
    twice = rows.groupBy(*keys).agg(F.sum("times").alias("all")).where("all > 1").select(*keys)
    same = rows.where("times = 1").join(twice, keys)
    return same.groupBy("row", "at").agg(F.max("before").alias("before"), (WINDOW - F.min("before")).cast("int").alias("after"))


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Rows (id_col, n_bytes, n_removed, n_spans, kept), one for each row of df: the bytes left of each text.

    A byte goes if a string of 400 bytes covers it that also starts anywhere else, in the same text or another; strings
    lie within one text. n_spans: maximal runs of removed bytes. Of repeated rows none is spared. Null and empty texts
    have no bytes; texts of any length are handled whole; an empty table gives an empty one. df is read once. digest: give the hex SHA-256 of the bytes left in their place.
    """
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    # Numbered and written once: whatever reads them again sees the same numbers, however files are split then.
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = written(rows, "rows", "zstd")
    places = written(suffixes(rows), "suffixes")
    kinds = places.groupBy("shared", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("row", "at")).alias("first"))
    several = kinds.groupBy("shared").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("times") == 1).alias("alone")).where("kinds > 1 and alone > 0")
    # Written, so that the joins have a shuffle on either side and adaptive execution can split a hot group's rows.
    several_at = written(several, "shared")
    kinds = written(kinds.join(several_at.hint("merge"), "shared", "left").where("times > 1 or kinds > 1"), "kinds")
    # What stands alone is its own first; of the others, every place is covered, and the first is there to compare with.
    spots = kinds.where("kinds > 1").select("first.row", "first.at", F.struct(F.col("first.at").alias("at"), "shared", "times").alias("hold"), F.lit(False).alias("full"), (F.col("kinds") > HOT).alias("hot"))
    full = places.join(kinds.where("times > 1").select("shared", "whole"), ["shared", "whole"]).select("row", "at", F.lit(None).cast("struct<at:int,shared:long,times:long>").alias("hold"), F.lit(True).alias("full"), F.lit(False).alias("hot"))
    marks = spots.unionByName(full).groupBy("row").agg(*[F.collect_list(F.when(c, x)).alias(n) for n, c, x in (("full", F.col("full"), F.col("at")), ("hold", ~F.col("full") & ~F.col("hot"), F.col("hold")), ("hot", F.col("hot"), F.col("hold")))])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode() for x in batch.column(2).to_pylist()]
            marked = batch.column(3).is_valid().to_pylist()
            kept = [None if m else hashlib.sha256(x).hexdigest().encode() if digest else x for x, m in zip(texts, marked, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, texts)), pa.int64()), pa.array([x if m else None for x, m in zip(texts, marked, strict=True)], pa.binary()), *batch.columns[3:], pa.array(kept, pa.binary())], ["row", "id", "n_bytes", "text", "full", "hold", "hot", "kept"])

    hold = "array<struct<at:int,shared:long,times:long>>"
    found = rows.join(marks.hint("shuffle_hash"), "row", "left").select("row", "id", "text", "full", "hold", "hot").mapInArrow(settle, f"row long, id {kind}, n_bytes long, text binary, full array<int>, hold {hold}, hot {hold}, kept binary")
    found = written(found, "marked", "zstd")
    dropped(rows, places, several_at, kinds)
    total = found.agg(F.sum(F.size("hold"))).first()[0] or 0
    reach = merge_sort(found.where("size(hold) > 0").select("row", "text", "hold"), max(1, total // SHARD)).unionByName(hot_windows(found.where("size(hot) > 0").select("row", "text", "hot")))
    reach = reach.groupBy("row").agg(F.collect_list(F.struct("at", "before", "after")).alias("reach"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, out = [], [], []
            for text, full, reach in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                cover = np.zeros(len(text) + 1, np.int64)
                for at, before, after in [(x, LEFT, WINDOW) for x in full or ()] + [(x["at"], x["before"], x["after"]) for x in reach or ()]:
                    cover[max(0, at - before)] += 1
                    cover[min(len(text), at + after)] -= 1
                gone = np.cumsum(cover)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append(hashlib.sha256(kept).hexdigest().encode() if digest else kept)
            yield from sliced([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(out, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept"], map(len, out))

    done = found.where("text is not null").select("row", "id", "n_bytes", "text", "full").join(reach, "row", "left").select("id", "n_bytes", "text", "full", "reach").mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    none = F.lit(0).cast("long")
    return found.where("text is null").select(F.col("id").alias(id_col), "n_bytes", none.alias("n_removed"), none.alias("n_spans"), "kept").unionByName(done)


def op6_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 400 bytes that occur twice."""
    out = drop_repeats(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
