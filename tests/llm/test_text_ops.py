"""The per-document operators against plain versions of their contracts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from stepforge.llm import op01_bpe, op02_chat, op03_pii, op07_media, op08_packing
from stepforge.llm.queries import QUERIES

ODD = ["", None, " ", "ΑΣ σ <|endoftext|>x<|startoftext|>", "aaaa aaaaa aaaaaaaaa", "they'll 'S İé é", "\x00\x1c\x85　", "a" * 30000, "!!" * 999, "0123 ½ 中文 😀", "same", "same"]
sha = lambda x: hashlib.sha256(x).hexdigest()


def docs(spark, texts=ODD):
    rows = [(i, x, "clash", "clash", 7) for i, x in enumerate(texts)] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, spans string, start long")


def texts_of(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def test_bpe_query_matches_library(spark, sf, word):
    texts = texts_of(spark, sf)
    rows = QUERIES["op1_bpe_pair_index"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = word[0].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(word[0].decode(ids, skip_special_tokens=False).encode())


def test_bpe_odd_texts_and_empty_table(spark, word):
    df = docs(spark)
    back = {r.doc_id: r for r in op01_bpe.decode(op01_bpe.encode(df, word[1]), word[1]).collect()}
    for i, x in enumerate(ODD):
        ids = word[0].encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(back[i].ids, "<u4").tolist() == ids
        assert back[i].decoded == word[0].decode(ids, skip_special_tokens=False)
    both = {r.doc_id: r for r in op01_bpe.encode(df, word[1], decode=True).collect()}
    assert both == back
    assert None in back and op01_bpe.encode(df.where("false"), word[1]).count() == 0


def test_every_code_point_is_split_as_the_library_splits_it(word):
    vocab = op01_bpe.Vocabulary(word[1])
    known = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    # Unassigned planes in between say the same thing over and over.
    known = known[: 0x32000 - 0x800] + known[0xE0000 - 0x800 : 0xE1000 - 0x800] + known[-300:]
    texts = [" ".join(f"a{c}b1{c}2!{c}?" for c in known[i : i + 400]) for i in range(0, len(known), 400)]
    rng = random.Random(5)
    marks = [c for c in known if op01_bpe.unicodedata.category(c) in ("Mn", "Mc", "Cn")]
    texts += ["".join(rng.choice(known if rng.random() < 0.3 else marks if rng.random() < 0.3 else "aeoSs' 1İΣé") for _ in range(60)) for _ in range(3000)]
    want = [e.ids for e in word[0].encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in op01_bpe.encode_texts(texts, vocab)] == want


def test_merges_do_not_depend_on_neighbours(word):
    vocab = op01_bpe.Vocabulary(word[1])
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("aehnot'", k=rng.randint(1, 30))) for _ in range(5)) for _ in range(400)]
    for x, ids in zip(texts, op01_bpe.encode_texts(texts, vocab), strict=True):
        assert ids.tolist() == word[0].encode(x, add_special_tokens=False).ids


def chat_by_hand(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        x = out.setdefault(conv, [0, "", ""])
        x[0] += 1
        x[1] += f"{role or ''}\n{text or ''}\n"
        x[2] += (text or "") if role == "assistant" else ""
    return {k: (n, sha(a.encode()), len(b), sha(b.encode())) for k, (n, a, b) in out.items()}


def test_chat_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "</s>[INST] ok [/INST]"
    want = chat_by_hand([*rows, (-1, 0, "user", hard), (-1, 1, "assistant", hard)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op2_chat_format"](spark, sf).collect()}
    assert got == want


def test_chat_odd_rows(spark):
    rows = [(1, 0, "assistant", "x"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "n"), (None, 0, "tool<|text|>", "\\<"), (2, 5, "system", ""), (2, 6, "user", "[ANS] a </s>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: r for r in op02_chat.read_back(op02_chat.format_chat(df)).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == chat_by_hand(rows)
    assert got[2].order_errors == 0 and got[1].order_errors == 3
    assert op02_chat.format_chat(df.where("false")).count() == 0


def test_chat_turns_survive_control_strings():
    chat, rng = op02_chat.Chat(), random.Random(1)
    parts = ["</s>", "[INST]", " ", "\\", "<", "s", ">", "/", "[ANS] ", "<|end|>", "<|text|>", "é", "\n", "<<SYS>>"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", "<s>"]), "".join(rng.choices(parts, k=rng.randint(0, 9)))) for _ in range(4)]
        out, at, back = "".join(s for r, t in turns for s, _ in chat.render(r, t)), 0, []
        while at < len(out):
            role, text, at = chat.read(out, at)
            back.append((role, text))
        assert back == turns


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_fuzz():
    rng = random.Random(5)
    parts = ["a.b", "@", "x@y.z", "..", "1", "255", "256", ".", "4111 1111 1111 1111", "-", " ", "+1", "(555)", "0" * 9, "12.", "é", "a@b", ".c", "%", "4111111111111111"]
    for _ in range(20000):
        x = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert op03_pii.base_spans(x) == plain_spans(x), x


def test_base_spans_take_linear_time():
    for x in ("a" * 300000, "1" * 300000, "@a" * 100000, "1." * 100000, "+1" * 100000, "a.b@" * 50000):
        op03_pii.base_spans(x)


def listed(spans):
    return ",".join(f"{op03_pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_pii_query_and_disclosures(spark, sf):
    texts = texts_of(spark, sf)
    rule, n = op03_pii.Disclosure(), len(texts)
    near = {i: op03_pii.near_terms(x, plain_spans(x), rule.window) for i, x in texts.items()}
    pair, entity, term = {}, {}, {}
    for i, found in near.items():
        for x in {(e, t) for e, t, _, _ in found}:
            pair.setdefault(x, set()).add(i)
        for s, k, e in plain_spans(texts[i]):
            entity.setdefault(f"{op03_pii.KINDS[k]}:{texts[i][s:e].lower()}", set()).add(i)
    for x in texts.values():
        for t in {*op03_pii.TERM.findall(x.lower())}:
            term[t] = term.get(t, 0) + 1
    told = {}
    for (e, t), rows in pair.items():
        if len(rows) >= rule.support and len(entity[e]) < n:
            told[e, t] = np.log(n * len(rows) / (term[t] * len(entity[e]))) / np.log(n / len(entity[e]))
    for r in QUERIES["op3_pii_disclosure"](spark, sf).collect():
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(listed(base).encode())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        more = {(s, 4, e) for x, t, s, e in near[r.doc_id] if told.get((x, t), 0) >= rule.generalise}
        assert r.spans == listed(sorted([*base, *more]))


def test_window_counts_words_not_characters():
    word = "".join(chr(97 + i % 26) for i in range(300))
    text = f"ninth first {word} " + "1 " * 600 + "x@corp.example " + "- " * 600 + f"{word} {word} last " + "w" * 100
    got = {(t, text[s:e].lower() == t) for _, t, s, e in op03_pii.near_terms(text, op03_pii.base_spans(text), 3)}
    assert got == {("ninth", True), ("first", True), (word, True), ("last", True)}


def test_pii_terms_are_told_and_removed(spark):
    rows = [(i, f"call Zorblatt at zed@corp.example now {i}", None) for i in range(3)] + [(i, "plain words at noon, call now", "x") for i in range(3, 40)] + [(99, None, None), (None, "zed@corp.example", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: r.text for r in op03_pii.sanitise(df).collect()}
    assert out[0] == "call  at [EMAIL] now 0" and out[5] == rows[5][1] and out[99] is None and out[None] == "[EMAIL]"
    assert op03_pii.sanitise(df).columns == df.columns and op03_pii.sanitise(df.where("false")).count() == 0


def test_planted_disclosures_are_found(spark):
    """Forty people, each with a nickname near the address in three documents of four, among words that anyone uses."""
    rng = random.Random(8)
    common = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(300)]
    words = lambda n: " ".join(rng.choices(common, k=n))
    name = lambda i: "Zq" + "".join(chr(107 + int(d)) for d in f"{i:03d}")
    rows = [f"{words(20)} {name(i)} {words(3)} person{i}@corp.example {words(20)}" for i in range(40) for _ in range(3)]
    rows += [f"{words(30)} person{i}@corp.example" for i in range(40)] + [words(60) for _ in range(2000)]
    got = op03_pii.all_spans(spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")).collect()
    found = [rows[r.doc_id][x.start : x.stop] for r in got for x in r.spans if x.kind == 4]
    planted = [name(i) for i in range(40) for _ in range(3)]
    right = sum(x in planted for x in found)
    assert right == len(planted) and right >= 0.9 * len(found), (right, len(found))


def test_near_terms_take_linear_time():
    text = "word a@b.cd " * 20_000
    spans = op03_pii.base_spans(text)
    assert len(op03_pii.near_terms(text, spans, 8)) == sum(min(8, k + 1) + min(8, 19_999 - k) for k in range(20_000))


def test_media_query(spark, sf):
    texts = texts_of(spark, sf)
    for r in QUERIES["op7_media_sniff"](spark, sf).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), sha(payload))
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.detected, r.media_bytes, r.media_sha256) == ("audio/wav", len(op07_media.as_wav(payload)), sha(op07_media.as_wav(payload)))


def png():
    import struct

    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d)) for n, d in ((b"IHDR", b"x" * 13), (b"IDAT", b"abc"), (b"IEND", b"")))


def test_sniffing_takes_linear_time():
    find = op07_media.automaton()
    for data in (b"PK\x03\x04" * 200_000, b"PK\x03\x04" * 200_000 + b"PK\x05\x06" + bytes(18), b"%PDF-" * 200_000):
        assert not op07_media.sniff(data, find)


def test_media_types_are_corrected_and_carved(spark):
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    values = [png(), b"junk" + png() + b"x" + gzip.compress(b"hello" * 50), z.getvalue(), b"RIFF", b"", None, b"\x1f\x8b\x08bad", png()[:-1], b"GIF89a" + b"\x01\0\x01\0\0\0\0" + b"\x21\xf9\x04abcd\0" + b"\x2c" + b"\0" * 9 + b"\x02\x01a\0;"]
    df = spark.createDataFrame([(i, len(x or b""), "image/gif", x, 1) for i, x in enumerate(values)], "doc_id long, n_bytes long, declared string, media binary, feature int")
    got = {r.doc_id: r for r in op07_media.inspect_media(df).collect()}
    assert [got[i].detected for i in range(9)] == ["image/png", None, "application/zip", None, None, None, None, None, "image/gif"]
    assert [(x.start, x.length, x.type) for x in got[1].carved][0] == (4, len(png()), "image/png") and len(got[1].carved) == 2
    assert [got[i].corrected for i in range(9)] == [True, False, True, *[False] * 6]
    assert op07_media.inspect_media(df.where("false")).count() == 0
    assert {r.payload_bytes for r in op07_media.inspect_media(op07_media.store_text(docs(spark, [None, ""]).limit(2))).collect()} == {64}


def check_packing(rows, want, limits=op08_packing.Limits()):
    pieces, used = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for x in used.values():
        x.sort(key=lambda r: r.offset)
        assert len(x) <= limits.segments and [r.offset for r in x] == [sum(y.length for y in x[:k]) for k in range(len(x))] and sum(r.length for r in x) <= limits.tokens
    return sum(map(len, want.values())) / (limits.tokens * len(used))


def test_packing_query(spark, sf):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = texts_of(spark, sf)
    want = {i: [*coder.encode(x, add_special_tokens=False).ids, 1] for i, x in texts.items()}
    assert check_packing(QUERIES["op8_vector_packing"](spark, sf).collect(), want) > 0.98


def test_packing_odd_texts(spark):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*coder.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(ODD)} | {None: [*coder.encode("no id", add_special_tokens=False).ids, 1]}
    check_packing(op08_packing.pack_documents(docs(spark)).collect(), want)
    assert op08_packing.pack_documents(docs(spark).where("false")).count() == 0


def test_every_limit_holds():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 300, 500)
    loss = (tokens * rng.random(500)).astype(int)
    limits = op08_packing.Limits(100, 4, 60, 8)
    seen, bins = {}, {}
    for i, start, n, b, offset in op08_packing.pack(tokens, loss, limits):
        assert start == seen.get(i, 0)
        seen[i] = seen.get(i, 0) + n
        x = bins.setdefault(b, [0, 0, 0])
        assert x[0] == offset
        x[0], x[1], x[2] = x[0] + n, x[1] + 1, x[2] + max(0, min(loss[i], start + n) - start)
    assert all(seen[i] == tokens[i] for i in range(500)) and all(a <= 100 and b <= 4 and c <= 60 for a, b, c in bins.values())


def test_three_axes_beat_one():
    """Instruction data whose tokens, segments and loss each bind somewhere: packing by tokens alone breaks limits, first-fit under all limits needs more sequences."""
    rng = np.random.default_rng(4)
    kinds = [(20, 10), (300, 280), (480, 30), (110, 110)]  # many short turns, mostly answers, long prompts, answers alone
    picks = rng.integers(0, len(kinds), 3000)
    tokens = np.array([kinds[k][0] for k in picks]) + rng.integers(0, 20, 3000)
    loss = np.minimum(tokens, np.array([kinds[k][1] for k in picks]) + rng.integers(0, 10, 3000))
    limits = op08_packing.Limits(1024, 8, 512, 10**9)  # no cutting
    bins = {}
    for i, _, n, b, _ in op08_packing.pack(tokens, loss, limits):
        bins.setdefault(b, np.zeros(3))[:] += (n, 1, loss[i])
    used = np.array([*bins.values()])
    assert (used <= (1024, 8, 512)).all()
    assert all((used[:, k] > 0.97 * cap).any() for k, cap in enumerate((1024, 8, 512)))  # each limit binds

    def first_fit(caps):
        room = np.zeros((0, 3))
        for i in np.argsort(-tokens, kind="stable"):
            need = np.array([tokens[i], 1, loss[i]])
            fits = np.flatnonzero((room + need <= caps).all(1))
            if len(fits):
                room[fits[0]] += need
            else:
                room = np.vstack([room, need])
        return room

    assert (first_fit(np.array([1024, np.inf, np.inf])) > (1024, 8, 512)).any()
    assert len(used) < len(first_fit(np.array([1024, 8, 512])))


def test_production_limits_bind(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op8_vector_packing"](spark, sf).collect()
    limits, bear, used, segments = op08_packing.Limits(), {}, {}, {}
    for r in rows:
        bear[r.sequence_id] = bear.get(r.sequence_id, 0) + min(r.length, r.doc_tokens - 1 - r.start)
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
        segments[r.sequence_id] = segments.get(r.sequence_id, 0) + 1
    assert max(bear.values()) == limits.loss < max(used.values()) <= limits.tokens and max(segments.values()) <= limits.segments
    assert sum(x == limits.loss for x in bear.values()) > 0.5 * len(bear) and sum(used.values()) > 0.99 * limits.tokens * len(used)
