"""Ranked search over treaps against scoring every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from stepforge.llm import op12_search
from stepforge.llm.op12_search import OP12_SQL, Best, Shard, ranked, search
from stepforge.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def plain(docs, items, k=50):
    """docs, items: (id, text) rows; {item: [(score, id)]}."""
    found = [(i, TERM.findall((x or "").translate(LOW))) for i, x in docs]
    found = [(i, x) for i, x in found if x]
    n_docs, total = len(found), sum(len(x) for _, x in found)
    df = Counter(t for _, x in found for t in set(x))
    out, asked = {}, {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOW)))
    for item, terms in asked.items():
        scores = []
        for i, x in found:
            tf, m = Counter(x), 100 - 50 + 50 * len(x) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out[item] = [(i, -s) for s, _, _, i in sorted(scores)[:k]]
    return {a: b for a, b in out.items() if b}


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.rank):
        assert r.rank == len(out.setdefault(r.item_id, [])) + 1
        out[r.item_id].append((r.doc_id, r.score))
    return out


def test_query_matches_plain_scores_and_sql(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = got(QUERIES["op12_treap_search"](spark, sf))
    assert found == plain(docs, items) and found
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = {}
    for item, _, doc, score in sorted(con.sql(OP12_SQL).fetchall()):
        sql.setdefault(item, []).append((doc, score))
    assert sql == found


ODD = [(1, "Hello hello WORLD"), (2, None), (3, ""), (4, "--- \t"), (5, "Éa é éA x0 0"), (6, "hello"), (6, "hello"), (None, "hello world"), (7, "world"), (8, "a" * 50000), (9, "a_b\x00c\x7fd"), (10, "hello hello hello " * 999)]
ASK = [(1, "hello"), (1, "WORLD, hello"), (2, None), (3, ""), (None, "é x0"), (4, "nowhere"), (5, "a b c d"), (6, "a" * 50000)]


@pytest.mark.parametrize("leaf, item_bytes, shard_bytes, k", [(2048, 1 << 20, 1 << 20, 50), (0, 20000, 4, 3), (1, 1 << 20, 40, 2)])
def test_odd_rows(spark, monkeypatch, leaf, item_bytes, shard_bytes, k):
    monkeypatch.setattr(op12_search, "LEAF", leaf)
    docs = spark.createDataFrame([(i, x, "clash", 1) for i, x in ODD], "doc_id long, text string, codes string, score int")
    items = spark.createDataFrame([(i, x, "clash") for i, x in ASK], "item_id long, text string, rank string")
    out = ranked(docs, items, k=k, item_bytes=item_bytes, shard_bytes=shard_bytes)
    assert got(out) == plain(ODD, ASK, k)
    assert ranked(docs.where("false"), items, k=k).count() == 0 and ranked(docs, items.where("false"), k=k).count() == 0


def test_terms_in_every_document_weigh_little_but_never_less_than_nothing(spark):
    docs, items = [(i, "all the same") for i in range(3000)], [(0, "all same"), (1, "the")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(ranked(df, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


@pytest.mark.parametrize("leaf, rounds", [(0, 10**6), (30, 64), (0, 2)])
@pytest.mark.parametrize("order", ["random", "rising", "equal"])
def test_treaps_against_all_scores(monkeypatch, leaf, rounds, order):
    monkeypatch.setattr(op12_search, "LEAF", leaf)
    monkeypatch.setattr(op12_search, "ROUNDS", rounds)
    rng, n, terms = np.random.default_rng(5), 400, 12
    term, doc, tf = [], [], []
    for d in range(n):
        for t in range(terms):
            if rng.random() < 0.9 / (1 + t):
                term.append(t), doc.append(d), tf.append(1 if order == "equal" else 1 + (d if order == "rising" else int(rng.integers(9))))
    term, doc, tf = map(np.array, (term, doc, tf))
    sizes = np.full(n, 10)
    shard = Shard.build(sizes, term, doc, tf, terms, lambda s: 20 * s)
    for t in range(terms):  # search order by document, heap order by impact
        a, b = shard.begin[t], shard.begin[t + 1]
        stack = [(shard.root[t], a, b)]
        while stack:
            x, lo, hi = stack.pop()
            assert lo <= x < hi and shard.impact[x] == shard.impact[lo:hi].max()
            for child, span in ((shard.left[x], (lo, x)), (shard.right[x], (x + 1, hi))):
                assert (child >= 0) == (span[0] < span[1])
                if child >= 0:
                    stack.append((child, *span))
    impact = 1_000_000_000 * tf // (1000 * tf + 200)
    for _ in range(40):
        own = np.array(sorted(random.Random(int(rng.integers(99))).sample(range(terms), int(rng.integers(1, terms)))))
        weight = rng.integers(1, 5, len(own))
        best = Best(7, 1)
        search(shard, own, weight, best)
        full = np.zeros(n, np.int64)
        for w, t in zip(weight, own, strict=True):
            np.add.at(full, doc[term == t], w * impact[term == t])
        want = sorted((-int(s), d) for d, s in enumerate(full) if s > 0)[:7]
        assert list(zip((-best.score).tolist(), best.doc.tolist(), strict=True)) == want
