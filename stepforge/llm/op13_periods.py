"""Periodic runs: stretches of words that repeat with a period.

For each power of two, the aligned blocks of so many words are keys of an automaton over integer sequences, which is
searched across the document. Where a block comes again at a distance of its own scale, the two are extended in both
directions while words that far apart are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, sliced, small_batches, table

#: A run has at least so many words and so many periods.
LEAST, TIMES = 24, 3
#: The smallest block; it finds all periods under twice its length. A run of LEAST words has two whole ones a period apart.
SMALLEST = 8


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal words alike."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def next_same(x: np.ndarray) -> np.ndarray:
    """How far on each number comes again; a large one where it doesn't."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), np.iinfo(np.int64).max)
    same = x[order[1:]] == x[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements of two arrays are equal, in steps that grow."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


@cache
def prime_factors(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def periodic_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; period is the smallest one.

    A run with period q of at least max(24, 3q) words holds, for the scale B of q (8 up to 15, else the power of two not above q), an aligned
    block of B words that comes again q words later, still in the run. So each run is seeded at its own scale. A block whose words don't
    all come again within 2B words can't be a seed, nor need one be tried whose whole reach lies in a run of a period up to B
    that is known: by Fine and Wilf's theorem what it would find there repeats that period.
    """
    n, found = len(x), {}
    if n < LEAST:
        return []
    reach, size = next_same(x), SMALLEST
    while TIMES * size <= n:
        low = 1 if size == SMALLEST else size
        blocks = np.arange(0, n - size + 1, size)
        seeds = blocks[np.maximum.reduceat(reach[: blocks[-1] + size], blocks) < 2 * size]
        if len(seeds):
            search_scale(x, size, low, seeds, found)
        size *= 2
    return sorted((start, length, period) for (start, period), length in found.items())


def search_scale(x: np.ndarray, size: int, low: int, seeds: np.ndarray, found: dict[tuple[int, int], int]) -> None:
    """Add the runs whose period is at least `low` and under twice `size` to found: (start, period) to length."""
    n = len(x)
    known = sorted((start, start + length) for (start, period), length in found.items() if period <= size)
    starts, ends = np.array([a for a, _ in known], np.int64), np.maximum.accumulate(np.array([b for _, b in known], np.int64)) if known else np.zeros(0, np.int64)
    inside = np.zeros(len(seeds), bool)
    if known:
        at = np.searchsorted(starts, seeds, side="right") - 1
        # The furthest end of the runs that start before may be another one's than the nearest's; it covers the reach all the same.
        inside = (at >= 0) & (ends[np.maximum(at, 0)] >= np.minimum(seeds + 3 * size, n))
    seeds = seeds[~inside]
    if not len(seeds):
        return
    keys: dict[int, tuple[int, ...]] = {int(j): tuple(x[j : j + size].tolist()) for j in seeds}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key in set(keys.values()):
        automaton.add_word(key, key)
    automaton.make_automaton()
    covered: dict[int, int] = {}
    small: list[tuple[int, int, int]] = []
    # Blocks whose reaches touch are searched in one go.
    cuts = np.flatnonzero(np.diff(seeds) > 3 * size) + 1
    for group in np.split(seeds, cuts):
        first, last = int(group[0]), min(n, int(group[-1]) + 3 * size)
        for end, key in automaton.iter(tuple(x[first:last].tolist())):
            s = first + end - size + 1
            for j in range((s - low) // size * size, s - 2 * size, -size):
                d = s - j
                if j < first or keys.get(j) != key or covered.get(d, -1) >= s + size or any(a <= j and s + size <= b and p < d for a, b, p in small):
                    continue
                begin = j - agree(x[:j][::-1], x[:s][::-1])
                stop = s + size + agree(x[j + size :], x[s + size :])
                covered[d] = stop
                length = stop - begin
                if length >= max(LEAST, TIMES * d) and not any(np.array_equal(x[begin : begin + d], x[begin + d // p : begin + d // p + d]) for p in prime_factors(d)):
                    found[begin, d] = length
                    if d <= size:
                        small = [r for r in small if r[1] > j][-8:] + [(begin, stop, d)]


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word lies in a run, after the run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


RUNS = "array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_words, runs, collapsed): every periodic run by start, then period, and the text with each run cut to one period.

    Words are what ASCII white space parts; collapsed joins those kept by one space. Null and empty texts have no words, no runs and
    an empty collapsed text. A text is taken whole, whatever its length; documents don't meet, so that nothing is shuffled and copies cost what they
    are. Repeated rows and null ids give rows like any other; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, every, texts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                runs = periodic_runs(numbered(words)) if len(words) >= LEAST else []
                if runs:
                    words = [words[i] for i in np.flatnonzero(~dropped_words(len(words), runs)).tolist()]
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(b" ".join(words).decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(every, run_type), pa.array(texts, pa.string())]
            yield from sliced(columns, [id_col, "n_words", "runs", "collapsed"], map(len, texts))
        give_back()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs {RUNS}, collapsed string")


def with_planted(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text): where crc32 of the decimal doc_id ends in 0, the text's words with a tail that repeats; a null id has none."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), 1)))
    sized = split.withColumns({"n": F.coalesce(F.size("words"), F.lit(0)).cast("long"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    tail = sized.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get(F.col("words"), source(i).cast("int"))), " ")
    return tail.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """Of runs in order, the first with the greatest exact length / period; null without any."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, b: F.when(better(a, b), b).otherwise(a))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of which have one planted: how many, the longest by periods, and digests."""
    found = find_runs(with_planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", longest(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
