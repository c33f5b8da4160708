"""Periodic runs against trying every period at every place."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from stepforge.llm.op13_periods import dropped_words, find_runs, periodic_runs, with_planted
from stepforge.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def plain(x):
    out = []
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q) and not any(x[i : i + length - r] == x[i + r : i + length] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def kept(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_core_on_random_sequences():
    rng = random.Random(7)
    for _ in range(400):
        k, x = rng.choice([1, 2, 2, 3, 5, 20]), []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.6:
                unit = [rng.randint(0, k) for _ in range(rng.randint(1, 40))]
                x += [unit[i % len(unit)] for i in range(rng.randint(1, 6 * len(unit)))]
            else:
                x += [rng.randint(0, k) for _ in range(rng.randint(0, 40))]
        assert periodic_runs(np.array(x, np.int64)) == plain(x)


def test_long_texts_take_little_time():
    for x in (np.zeros(200_000, np.int64), np.arange(200_000) % 7, np.arange(200_000) % 50_001, np.random.default_rng(0).integers(0, 2, 200_000)):
        for start, length, period in periodic_runs(x):
            assert np.array_equal(x[start : start + length - period], x[start + period : start + length])
    assert periodic_runs(np.arange(200_000) % 50_001) == [(0, 200_000, 50_001)]


def test_dropped_words():
    assert dropped_words(6, [(0, 6, 2)]).tolist() == [False, False, True, True, True, True]
    assert dropped_words(3, []).tolist() == [False] * 3


def test_query_matches_plain_version(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    some = 0
    for d in docs:
        words, r = planted(d.doc_id, d.text), rows[d.doc_id]
        number = {}
        runs = plain([number.setdefault(w, len(number)) for w in words])
        some += bool(runs)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)) and r.collapsed_sha256 == sha(kept(words, runs))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert some > 5


def test_odd_rows(spark):
    rep, big = "x y " * 20, " ".join(map(str, range(30_000)))
    texts = ["", None, " \t\n", "a", rep, rep, f"é{chr(0xA0)}é " * 30, "w\x0bw\x0c" * 30, f"{big} {big} {big}", "\x1c " * 24, "\x1c " * 23]
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(None, rep, "c")] * 2, "doc_id long, text string, runs string")
    rows = find_runs(df).collect()
    assert len(rows) == len(texts) + 2 and find_runs(df.where("false")).count() == 0
    for r in rows:
        words = WORD.findall((rep if r.doc_id is None else texts[r.doc_id]) or "")
        runs = [tuple(x) for x in r.runs]
        assert r.n_words == len(words) and r.collapsed == kept(words, runs)
        if len(words) < 1000:
            assert runs == plain(words)
    assert [tuple(x) for x in rows[8].runs] == [(0, 90_000, 30_000)]


def test_planting(spark):
    texts = {i: " ".join(f"w{j}" for j in range(i % 60)) for i in range(300)}
    df = spark.createDataFrame([*texts.items(), (None, "a b"), (301, None)], "doc_id long, text string")
    got = {r.doc_id: WORD.findall(r.text or "") for r in with_planted(df).collect()}
    assert got == {i: planted(i, x) for i, x in texts.items()} | {None: ["a", "b"], 301: []}
    assert with_planted(df.where(F.lit(False))).count() == 0
