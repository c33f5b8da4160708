"""Exact and near dedup against brute force."""

import random

import duckdb
import numpy as np
import pytest
import xxhash

from stepforge.llm import op04_exact, op10_simhash
from stepforge.llm.queries import QUERIES, SQL


def docs(spark, texts):
    rows = [(i, x, "clash", 1) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, fp int")


def test_exact_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({SQL['op4_exact_radix']})").fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in QUERIES["op4_exact_radix"](spark, sf).collect()) == want


def test_exact_odd_rows(spark):
    long = "Xy" * 70000
    texts = ["a" * 32, "a" * 33, "A" * 32, "", None, long, long.lower(), long + "!", "a" * 32 + "b" * 300, "a" * 32 + "b" * 301, "a" * 32 + "B" * 300, "É", "é"]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in op04_exact.group_equal(docs(spark, texts)).collect()}
    norm = ["".join(c.lower() if c.isascii() else c for c in x or "") for x in texts]
    assert got == {i: (max(j for j, y in enumerate(norm) if y == x), norm.count(x)) for i, x in enumerate(norm)}
    assert op04_exact.group_equal(docs(spark, texts).where("false")).count() == 0
    kept = op04_exact.without_copies(docs(spark, texts))
    assert kept.columns == docs(spark, texts).columns and sorted(r.doc_id for r in kept.collect()) == sorted({k for k, _ in got.values()})


def test_exact_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "y"), (2, "z"), (2, "q")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in op04_exact.group_equal(df).collect()), key=str)
    assert got == sorted([(1, 1, 3), (1, 1, 3), (None, 1, 3), (None, None, 1), (2, 2, 1), (2, 2, 1)], key=str)
    assert sorted(map(str, map(tuple, op04_exact.without_copies(df).collect()))) == sorted(map(str, [(1, "x"), (None, "y"), (2, "z"), (2, "q")]))


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fp):
    keys = np.array([fp[i] for i in sorted(fp)], np.uint64)
    ids, root = sorted(fp), {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(keys[i + 1 :] ^ keys[i]) <= 2) + i + 1:
            a, b = find(ids[i]), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fp = {i: plain_fingerprint(x) for i, x in texts.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_bitslice"](spark, sf).collect()}
    root = plain_components(fp)
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_links_find_every_near_pair(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {0, *base}
    for x in base:
        for _ in range(12):
            y = x
            for _ in range(rng.randint(1, 3)):
                y ^= 1 << rng.randrange(64)
            values.add(y)
    hot = rng.getrandbits(64) & ~((1 << 11) - 1)
    values |= {hot | i for i in range(0, 700, 3)}
    fp = dict(enumerate(sorted(values)))
    distinct = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fp.values()], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in op10_simhash.components(op10_simhash.links(distinct)).collect()}
    want = plain_components(fp)
    groups = {}
    for i, x in fp.items():
        groups.setdefault(want[i], set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_large_buckets_flip(monkeypatch):
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64) | np.uint64(7 << 40))
    pairs = lambda: {(min(a, b), max(a, b)) for x, y in op10_simhash.bucket_links(values) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    sliced = pairs()
    monkeypatch.setattr(op10_simhash, "FLIP_OVER", 1)
    assert pairs() == sliced == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if np.bitwise_count(values[i] ^ values[j]) <= 2}


def test_simhash_odd_rows(spark):
    texts = ["", None, " \n", "one", "ONE", "one two three four", "one two  three\tfour", "x" * 100000]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "lonely words here", "", 1), (5, "one two three four", "", 1)], "doc_id long, text string, keep_id string, fp int"))
    got = sorted(((r.doc_id, r.component_id) for r in op10_simhash.near_classes(df).collect()), key=str)
    assert got == sorted([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (5, 5), (6, 5), (7, 7), (None, None)], key=str)
    assert op10_simhash.near_classes(df.where("false")).count() == 0
    assert sorted(map(str, (r.doc_id for r in op10_simhash.one_of_each(df).collect()))) == sorted(map(str, [0, 3, 5, 5, 7, None]))


def plain_sets(texts, words=5):
    out = []
    for x in texts:
        w = "".join(c.lower() if c.isascii() else c for c in x or "").encode().split()
        out.append({b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def test_near_copies_by_jaccard(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = ["", " \n", "one two", "One  two", "one two three"]
    for n in (6, 12, 30, 80, 300):
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for edits in range(5):  # copies of copies, some of them below 0.8
                for _ in range(edits * n // 100 + (edits > 0)):
                    base[rng.randrange(n)] = word()
                texts.append(" ".join(base))
    sets = plain_sets(texts)
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r.doc_id: r.component_id for r in op10_simhash.similar_classes(docs(spark, texts)).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(texts) - 30
    # Groups too large for a task go by blocks, and give the same.
    for rule in (op10_simhash.Similar(whole=10, block=30), op10_simhash.Similar(whole=200, block=10**6)):
        assert {r.doc_id: r.component_id for r in op10_simhash.similar_classes(docs(spark, texts), rule).collect()} == got
    kept = op10_simhash.one_of_each(docs(spark, texts), similar=op10_simhash.Similar())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert op10_simhash.similar_classes(docs(spark, texts).where("false")).count() == 0


def test_one_row_stays_of_equal_texts_of_one_id(spark):
    rows = [(1, "Hello World", 5), (1, "hello world", 9), (1, "hello there", 0), (3, None, 1), (3, "", 2), (4, "Z", 1), (4, "Z", 2), (None, "n", 1), (None, "N", 2), (5, "hello there", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(5)
    for _ in range(2):
        got = sorted(map(tuple, op04_exact.without_copies(df.repartition(3, "extra")).collect()), key=str)
        assert [r[0] for r in got] == [1, 3, 4, 5, None, None] and got == sorted([(1, "hello world", 9), (3, "", 2), (4, "Z", 2), (5, "hello there", 7), (None, "N", 2), (None, "n", 1)], key=str)


def test_rows_that_share_an_id_go_by_their_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text + " more"), (2, "something else that nothing resembles at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(op10_simhash.one_of_each(df, similar=op10_simhash.Similar()).collect()) == sorted([rows[0], rows[2]])
    rows = [(1, "Same"), (2, "same"), (1, "other")]
    assert sorted(op04_exact.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(rows[1:])


def test_components_raise_rather_than_stop(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        op10_simhash.components(edges, most_rounds=1)
    assert {r.root for r in op10_simhash.components(edges).collect()} == {0}
