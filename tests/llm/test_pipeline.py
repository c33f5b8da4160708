"""The pipeline's stages against plain versions of each, stage by stage on what the one before kept."""

import pytest
from test_quality import plain_verdicts
from test_text_ops import check_packing, plain_spans
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from stepforge import shared
from stepforge.llm import op03_pii
from stepforge.llm.common import table, written


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        done = written(stage(spark, docs, sf), "test-stage")
        out.append((name, docs.collect(), done.collect(), done.columns, docs.columns))
        docs = done
    return {name: rest for name, *rest in out}


def ids(rows):
    return {r.doc_id for r in rows}


def test_stages_keep_the_columns(stages):
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES]
    for name in list(stages)[:-1]:
        assert stages[name][2] == stages[name][3]


def test_quality_stage(spark, sf, stages):
    before, after, *_ = stages["quality classifier"]
    want = plain_verdicts([(r.doc_id, r.text, r.lang) for r in before], [tuple(r) for r in table(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()])
    for at, r in enumerate(before):
        bits, score, limit = want[at]
        if bits is None:
            assert r.doc_id in ids(after)
        elif abs(score - limit) > 4:  # thousandths round either way at the threshold itself
            assert (r.doc_id in ids(after)) == (score <= limit), r.doc_id
    assert ids(after) < ids(before)


def test_exact_stage(stages):
    before, after, *_ = stages["exact dedup"]
    last = {}
    for r in before:
        key = "".join(c.lower() if c.isascii() else c for c in r.text or "")
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r.doc_id in set(last.values()))


def plain_jaccard_components(texts):
    """{id: least id reachable over pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more}, all pairs compared."""
    sets = {}
    for i, text in texts.items():
        words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or {tuple(words)}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] < root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[b], changed = root[a], True
    return root


def test_near_stage(stages):
    before, after, *_ = stages["SimHash near-dedup"]
    root = plain_jaccard_components({r.doc_id: r.text for r in before})
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if root[r.doc_id] == r.doc_id)
    assert len(after) < len(before)


def test_private_stage(stages):
    before, after, *_ = stages["PII"]
    assert ids(before) == ids(after)
    text = {r.doc_id: r.text for r in after}
    for r in before:
        spans = plain_spans(r.text)
        if not spans:
            assert text[r.doc_id] == r.text
            continue
        assert "[" in text[r.doc_id] and not any(r.text[s:e] in text[r.doc_id] for s, k, e in spans if k == 0)
        assert sum(text[r.doc_id].count(f"[{k.upper()}]") for k in op03_pii.KINDS[:4]) >= 1
    assert all(r.n_chars == len(r.text) for r in after)


def test_packing_stage(stages):
    before, after, *_ = stages["packing"]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert check_packing(after, {r.doc_id: [*coder.encode(r.text or "", add_special_tokens=False).ids, 1] for r in before}) > 0.95


def test_run_gives_the_last_stage(spark, sf, stages):
    want, before = stages["packing"][1], {*shared.MADE}
    got = corpus_pipeline.run(spark, sf).collect()
    assert [p.split("/")[-1].split("-")[:2] for p in shared.MADE if p not in before] == [["stage", "PII"]]
    assert sorted((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == sorted((r.doc_id, r.doc_tokens) for r in want if r.start == 0)


ODD = "doc_id long, text string, lang string, source string, n_chars long, gone string, bad string, row string, spans string, text_key string, sha string, fp string, removed string, bad_lang string"


def test_stages_take_odd_rows(spark, sf):
    more = ("x",) * 9
    long = "plain words here and there " * 4000
    rows = [(1, "same text", "en", "s", 9, *more), (2, "Same Text", "en", None, None, *more), (3, None, None, None, None, *more), (4, "", "xx", "s", 0, *more), (5, long, "en", "s", 1, *more), (None, "no id bob@corp.example", None, None, None, *(None,) * 9), (5, long, "en", "s", 1, *more)]
    docs = spark.createDataFrame(rows, ODD)
    for frame in (docs, docs.where("false")):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, sf), "odd")
            if name != "packing":
                assert now.columns == docs.columns
            if frame is docs and name == "exact dedup":
                assert sorted(map(str, (r.doc_id for r in now.collect()))) == sorted(map(str, (2, 4, 5, None)))
            if frame is docs and name == "PII":
                assert {r.text for r in now.where("doc_id is null").collect()} == {"no id [EMAIL]"}
        assert (now.count() > 0) == (frame is docs)
