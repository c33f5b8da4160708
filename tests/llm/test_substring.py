"""Repeats of words and bytes against brute force."""

import hashlib
import random

import pytest

from stepforge.llm import op06_suffix, op09_blocks
from stepforge.llm.queries import QUERIES

sha = lambda x: hashlib.sha256(x).hexdigest()


def words_left(rows, size=op09_blocks.WINDOW):
    """(id, words, kept words) of each row."""
    first, split = {}, [(i, (x or "").encode().split()) for i, x in rows]
    for i, w in split:
        for p in range(len(w) - size + 1 if i is not None else 0):
            key = b" ".join(w[p : p + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for p in range(len(w) - size + 1 if i is not None else 0):
            if first[b" ".join(w[p : p + size])] < i:
                keep[p : p + size] = [False] * size
        out.append((i, w, [x for x, k in zip(w, keep, strict=True) if k]))
    return out


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_block_query(spark, scale):
    folder = f"/root/testdata/sf{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {i: (len(w), len(w) - len(k), sha(b" ".join(k))) for i, w, k in words_left(rows)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op9_substring_blocks"](spark, folder).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_block_odd_rows(spark, monkeypatch):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base[:120]), " ".join(base[100:160]), " ".join(base[37:87]), " ".join(["x"] * 200), " ".join(["x"] * 60), "", None, " ".join(base[:49]), "\t".join(base[10:300]), " ".join(base[7:57]) + " " + " ".join(base[:99])]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (11, texts[8]), (11, texts[8])]
    df = spark.createDataFrame([(i, x, 1, "clash") for i, x in rows], "doc_id long, text string, n_words int, words string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in op09_blocks.drop_repeats(df).collect()), key=str)
    assert got == sorted(((i, len(w), len(w) - len(k), b" ".join(k)) for i, w, k in words_left(rows)), key=str)
    assert op09_blocks.drop_repeats(df.where("false")).count() == 0
    for name in ("CHUNK", "SHARD"):
        monkeypatch.setattr(op09_blocks, name, 500)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in op09_blocks.drop_repeats(df).collect()), key=str) == got


def bytes_left(rows, size=op06_suffix.WINDOW):
    """(id, number of bytes, spans, kept bytes) of each row."""
    texts, seen = [(i, (x or "").encode()) for i, x in rows], {}
    for _, x in texts:
        for p in range(len(x) - size + 1):
            h = hash(x[p : p + size])
            seen[h] = seen.get(h, 0) + 1
    out = []
    for i, x in texts:
        spans, end = [], 0
        for p in range(len(x) - size + 1):
            if seen[hash(x[p : p + size])] > 1:
                if spans and p <= end:
                    end = spans[-1][1] = p + size
                else:
                    spans.append([p, end := p + size])
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + x[at:s], e
        out.append((i, len(x), spans, kept + x[at:]))
    return out


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_suffix_query(spark, scale):
    folder = f"/root/testdata/sf{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {i: (n, n - len(k), len(s), sha(k)) for i, n, s, k in bytes_left(rows)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op6_suffix_merge"](spark, folder).collect()}
    assert got == want and any(x[1] for x in want.values())


def hard_texts(seed, n=60):
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    base = [noise(1500), "ab" * 900, noise(20) * 60, "é" * 700]
    out = ["", None, "x" * 399, "x" * 400, "x" * 401, noise(399), noise(400)]
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(1, 3)):
            b = rng.choice(base)
            s = rng.randrange(len(b) - 300)
            text += b[s : s + rng.choice([300, 399, 400, 401, 450, 800])] + noise(rng.choice([0, 1, 50, 500]))
        out.append(text)
    return [*out, out[-1], out[-2]]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_hard_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(op06_suffix, "HOT", hot)
    monkeypatch.setattr(op06_suffix, "SHARD", 50)
    rows = [*enumerate(hard_texts(hot)), (None, "x" * 400), (2, "y" * 500)]
    df = spark.createDataFrame([(i, x, 1, "clash") for i, x in rows], "doc_id long, text string, n_spans int, row string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op06_suffix.drop_repeats(df).collect()), key=str)
    assert got == sorted(((i, n, n - len(k), len(s), k) for i, n, s, k in bytes_left(rows)), key=str)
    assert op06_suffix.drop_repeats(df.where("false")).count() == 0


def test_loser_tree_gives_order_and_common_prefixes():
    rng = random.Random(6)
    for k in (1, 2, 3, 7):
        runs = [sorted((bytes(rng.choices(b"ab", k=rng.randint(0, 12))), i) for _ in range(rng.randint(0, 40))) for i in range(k)]
        got = list(op06_suffix.merged([op06_suffix.Run(op06_suffix.front_coded(r)) for r in runs]))
        keys = [key for _, key, _ in got]
        assert keys == sorted(x for r in runs for x, _ in r)
        assert all(h == op06_suffix.common(a, b) for a, (h, b, _) in zip([b"", *keys], got))


@pytest.mark.parametrize("module,name", [(op06_suffix, "op6_suffix_merge"), (op09_blocks, "op9_substring_blocks")])
def test_files_split_otherwise_on_every_read(spark, sf, tmp_path, monkeypatch, module, name):
    spark.read.parquet(f"{sf}/documents.parquet").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(QUERIES[name](spark, sf).collect())
    turn, plain = iter(range(1, 99)), module.written

    def otherwise(df, *args):
        out = plain(df, *args)
        k = next(turn)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(3 + 5 * (k % 2) + k))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(20_000 * (1 + k % 3)))
        return out

    monkeypatch.setattr(module, "written", otherwise)
    try:
        got = sorted(QUERIES[name](spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
