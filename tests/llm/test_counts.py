"""Token counts through the cache against the libraries themselves."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from stepforge.llm import op11_counts
from stepforge.llm.op11_counts import Cache, Tokens, count_tokens
from stepforge.llm.queries import QUERIES
from stepforge.shared import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokens.read(PATH), Tokenizer.from_file(PATH)
COUNT = WHOLE[0].counter()
ODD = ["", None, " ", "ΑΣ σ <|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "a<|EndOfText|>b", "J̌ H̱", "ǰ ẖ", "they'll 'S İé é", "\x00\x1c\x85　", "x" * 30000, "Ab  c\n", "ab c", "ab\tC ", "ab\x0bc", "0123 ½ 中文 😀"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def frame(spark, texts):
    return spark.createDataFrame([(i, x, "clash", "clash") for i, x in enumerate(texts)] + [(None, "no id", None, None)] * 2, "doc_id long, text string, content string, n_tokens string")


def count(coder, text):
    return len(coder.encode(text or "", add_special_tokens=False).ids)


def test_query_matches_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op11_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = count(library, texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_odd_texts_with_both_libraries(spark, library):
    df = frame(spark, ODD)
    words = Tokens.read(PATH)
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, words).collect()}
    assert got == {i: count(library, x) for i, x in enumerate(ODD)} | {None: count(library, "no id")}
    assert count_tokens(df, words).count() == len(ODD) + 2 and count_tokens(df.where("false"), words).count() == 0
    pieces = Tokens.read(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, pieces).collect()}
    assert got == {i: len(model.encode(x or "")) for i, x in enumerate(ODD)} | {None: len(model.encode("no id"))}
    byte = Tokens.read(public_tokenizers.path("byte_bpe_50k.json"))
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert byte.special is None
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, byte).collect()} == {i: count(coder, x) for i, x in enumerate(ODD)} | {None: count(coder, "no id")}


def stored(cache, version):
    return cache.stored(version).count() if cache.folders(version) else 0


@pytest.mark.parametrize("sent", [op11_counts.SENT, 0])
def test_only_distinct_misses_are_encoded_and_appended(spark, library, monkeypatch, sent):
    monkeypatch.setattr(op11_counts, "SENT", sent)
    cache, tokens = Cache(spark, new_path(spark, "test-cache")), Tokens.read(PATH)
    first = ["a b", "A  b", "a\nb ", "c"] * 50
    count_tokens(frame(spark, first), tokens, cache)
    assert stored(cache, tokens.version) == 3 and len(cache.folders(tokens.version)) == 1  # a b, c, no id
    count_tokens(frame(spark, first), tokens, cache)
    assert len(cache.folders(tokens.version)) == 1
    more = [*first, "new text", "NEW  text", "é"]
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, more), tokens, cache).collect()}
    assert got == {i: count(library, x) for i, x in enumerate(more)} | {None: count(library, "no id")}
    assert len(cache.folders(tokens.version)) == 2 and spark.read.parquet(cache.folders(tokens.version)[0], cache.folders(tokens.version)[1]).count() == 5


def test_counts_come_from_the_cache_and_never_from_another_version(spark):
    cache, tokens = Cache(spark, new_path(spark, "test-cache")), Tokens.read(PATH)
    key = hashlib.sha256(b"a b").digest()
    cache.append(tokens.version, spark.createDataFrame([(key, 77)], op11_counts.CACHED))
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, ["A b", "b"]), tokens, cache).collect()}
    assert got[0] == 77 and got[1] == 1
    other = Tokens("json", tokens.data + b"\n")
    assert other.version != tokens.version
    assert {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, ["A b"]), other, cache).collect()}[0] == 2


def test_half_written_appends_double_ones_and_compaction(spark):
    cache, tokens = Cache(spark, new_path(spark, "test-cache")), Tokens.read(PATH)
    docs = frame(spark, ["a b", "c d e"])
    count_tokens(docs, tokens, cache)
    cache.append(tokens.version, cache.stored(tokens.version))  # as another writer at the same time would
    folder = cache.folders(tokens.version)[0]
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = sorted(map(tuple, count_tokens(docs, tokens, cache).collect()), key=str)
    assert len(rows) == 4
    cache.compact(tokens.version)
    assert len(cache.folders(tokens.version)) == 1 and sorted(map(tuple, count_tokens(docs, tokens, cache).collect()), key=str) == rows
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(cache.folders(tokens.version)[0], "_SUCCESS"), False)
    assert cache.folders(tokens.version) == []
    assert sorted(map(tuple, count_tokens(docs, tokens, cache).collect()), key=str) == rows


@settings(max_examples=1000, deadline=None)
@given(st.text(st.sampled_from("aBcJ̱̌́ \t\n\x0b\x1c\x85'!0é<|>Σ"), max_size=12), st.integers(0, 2))
def test_parts_of_a_text_add_up(text, specials):
    tokens, coder = WHOLE
    text = "<|endoftext|>".join([text, "x"][: specials + 1]) if specials else text
    assert COUNT([text, text]) == [count(coder, text)] * 2


def test_counts_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(op11_counts, "REMEMBERED", 2)
    monkeypatch.setattr(op11_counts, "AT_ONCE", 3)
    texts = ["a b c d e", "", "a  b", "f g h", "x" * 9]
    assert WHOLE[0].counter()(texts) == [count(WHOLE[1], x) for x in texts]


def test_texts_of_one_key_count_alike(spark, library):
    import itertools

    texts = ["".join(x) for n in (1, 2, 3) for x in itertools.product(["a", "B", "J", "̌", " ", "\t", "\x0b", "\x1c", "'", "S", "0", "é"], repeat=n)]
    texts += [f"{a}{b}{c}" for a in ("<|", "<| ") for b in ("endoftext", "ENDOFTEXT", "startOFtext") for c in ("|>", "|> x", " |>")]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("key", Tokens.read(PATH).normal(F.col("text"))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.key, set()).add(count(library, r.text))
    assert len(by) < len(set(texts)) and all(len(x) == 1 for x in by.values())
