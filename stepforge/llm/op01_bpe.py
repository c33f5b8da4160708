"""BPE encoding and decoding with an index from each pair to all its places in a partition.

The distinct words of a block of rows lie in one array of symbols. The index maps the rank of a merge to
the places where its pair stands. Active ranks come off a heap in ascending order; each is applied to all
its places at once, and only the pairs beside those places enter or leave the index.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.normalizers import Normalizer

from .common import gathered, sliced, small_batches, table

#: Bytes of text whose words share one index.
BLOCK = 10 << 20
#: Bytes of ids in a batch of results.
OUT = 3 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def ranges(chars: list[str]) -> str:
    """These characters as the inside of a regex class."""
    codes = np.unique(np.fromiter(map(ord, chars), np.int64, len(chars)))
    cuts = np.flatnonzero(np.diff(codes) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[np.append(0, cuts + 1)].tolist(), codes[np.append(cuts, -1)].tolist(), strict=True))


@cache
def unlike(text: str, pattern: str) -> tuple[np.ndarray, regex.Pattern, Normalizer]:
    """(by code point, whether the tokenizers library and this Python's Unicode tables take it differently, or may; the pattern by
    the library's classes; the library's normaliser), found by asking it about every code point.

    text: the vocabulary's JSON. Characters that this Python doesn't know count as such, since they may combine.
    """
    coder = Tokenizer.from_str(text)
    normaliser, split = coder.normalizer, coder.pre_tokenizer.pre_tokenize_str
    known = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    parts = lambda x, by="": len(split(by + by.join(x) + by if by else x))
    sure = {"L": lambda x: parts(f"a{x}a") == 1, "": lambda x: parts(f"!{x}!") == 1, "s": lambda x: not split(x), "N": lambda x: parts(x, "a") == parts(x, "!") == 2 * len(x) + 1}
    classes = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), "s": regex.compile(r"\s")}
    groups: dict[str, list[str]] = {k: r.findall("".join(known)) for k, r in classes.items()}
    groups[""] = regex.findall(r"[^\s\p{L}\p{N}]", "".join(known))
    moved: dict[str, list[str]] = {k: [] for k in groups}

    def place(kind: str, chars: list[str]) -> None:
        """Halves until a group is all of its kind or a character stands alone."""
        if not sure[kind]("".join(chars)):
            if len(chars) == 1:
                moved[next(k for k in ("L", "s", "", "N") if sure[k](chars[0]))].append(chars[0])
            else:
                place(kind, chars[: len(chars) // 2])
                place(kind, chars[len(chars) // 2 :])

    for kind, chars in groups.items():
        if chars:
            place(kind, chars)
    at = [c for c in known if c != "\x01"]
    theirs = normaliser.normalize_str("\x01".join(at)).split("\x01")
    odd = [c for c, x in zip(at, theirs, strict=True) if unicodedata.category(c) == "Cn" or x != unicodedata.normalize("NFC", c).replace("Σ", "σ").lower() and not c.isspace()]
    other = {c for x in moved.values() for c in x}
    for k, escape in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s")):
        pattern = pattern.replace(escape, ranges([c for c in groups[k] if c not in other] + moved[k]))
    flags = np.zeros(0x110000, bool)
    flags[[ord(c) for c in (*odd, *other)]] = True
    return flags, regex.compile(pattern), normaliser


class Vocabulary:
    """A BPE vocabulary with word ends, read from the JSON of the tokenizers library."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = np.array([ids[x] for x in letters], np.int64)
        self.last = np.array([ids[x + end] for x in letters], np.int64)
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        left, right, made = np.array(pairs, np.int64).T
        code = left << 32 | right
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order
        self.left, self.right, self.made = left, right, made
        self.tokens = [""] * (1 + max(*ids.values(), *self.special.values(), 0))
        for token, i in (*ids.items(), *self.special.items()):
            self.tokens[i] = token
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern)
        self.odd, self.odd_words, self.normaliser = unlike(text, pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((self.code[at] == code) & (left >= 0) & (right >= 0), self.rank[at], -1)

    def pieces(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is special token, piece) in order; other pieces are words after normalisation."""
        for part in self.specials.split(text) if self.specials and any(x in text for x in self.special) else (text,):
            if part in self.special:
                yield True, part
            elif part:
                for word in self.split(part):
                    yield False, word

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, after normalisation."""
        if text.isascii():
            return self.words.findall(text.lower())
        if self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self.odd_words.findall(self.normaliser.normalize_str(text))
        # Lower-casing is by character: a capital sigma never becomes a final one.
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, and where each word's ids begin (one entry more than words)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    symbol = np.append(vocab.inner[data], -1).astype(np.int32)
    ends = np.cumsum(sizes)[sizes > 0] - 1
    symbol[ends] = vocab.last[data[ends]]
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends], before[n] = n, n
    before[np.append(0, ends[:-1] + 1)] = n
    after[n] = n
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(places: np.ndarray) -> None:
        ranks = vocab.ranks(symbol[places], symbol[after[places]])
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, some in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
            if rank in index:
                index[rank].append(some)
            else:
                index[rank] = [some]
                heapq.heappush(heap, rank)

    add(np.arange(n, dtype=np.int32))
    while heap:
        rank = heapq.heappop(heap)
        found = index.pop(rank)
        places = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        a, b = vocab.left[rank], vocab.right[rank]
        places = places[(symbol[places] == a) & (symbol[after[places]] == b)]
        if a == b and len(places) > 1:
            # Of overlapping places the leftmost merges first.
            taken, keep = -1, []
            for p, q in zip(places.tolist(), after[places].tolist(), strict=True):
                if p != taken:
                    keep.append(p)
                    taken = q
            places = np.array(keep)
        if not len(places):
            continue
        gone = after[places]
        beyond = after[gone]
        symbol[places], symbol[gone] = vocab.made[rank], -1
        after[places] = beyond
        before[beyond] = places
        before[n] = n
        left = before[places]
        add(np.unique(np.concatenate([left[left < n], places])))
    alive = symbol[:n] >= 0
    return symbol[:n][alive], np.append(0, np.cumsum(np.bincount(word[alive], minlength=len(words))))


class Numbered(dict):
    """Numbers its keys in the order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def encode_texts(texts: list[str], vocab: Vocabulary) -> Iterator[np.ndarray]:
    """Token ids of each text; all texts share one pair index."""
    seen = Numbered()
    rows = []
    for text in texts:
        if vocab.specials and any(x in text for x in vocab.special):
            rows.append(np.fromiter((-1 - vocab.special[x] if kind else seen[x] for kind, x in vocab.pieces(text)), np.int32))
        else:
            rows.append(np.array(list(map(seen.__getitem__, vocab.split(text))), np.int32))
    ids, begins = merge_words([x.encode() for x in seen], vocab)
    special = sorted(vocab.special.values())
    flat = np.concatenate([ids, special]).astype(np.int64)
    begin = np.concatenate([begins[:-1], len(ids) + np.arange(len(special))])
    size = np.concatenate([np.diff(begins), np.ones(len(special), np.int64)])
    place = {x: len(seen) + i for i, x in enumerate(special)}
    for row in rows:
        row = row.astype(np.int64)
        for i in np.flatnonzero(row < 0):
            row[i] = place[-1 - int(row[i])]
        n = size[row]
        starts = np.repeat(begin[row] - np.append(0, np.cumsum(n)[:-1]), n) if len(row) else np.zeros(0, np.int64)
        yield flat[starts + np.arange(len(starts))].astype("<u4")


def decoded(ids: np.ndarray, tokens: list[str]) -> str:
    """The tokens of ids, special ones too, joined by a space."""
    return " ".join(map(tokens.__getitem__, ids.tolist()))


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """Rows (id_col, ids): ids are little-endian unsigned 32-bit token ids, one after another.

    vocabulary: the JSON text of a vocabulary. decode: add what the ids decode to, so that one worker does both. Null
    and empty texts give no ids; equal rows give equal rows; an empty table gives an empty one. Memory holds one
    block of texts, and no row is cut.
    """
    small_batches(df.sparkSession)
    vocab = Vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in gathered(batches, 1, BLOCK):
            keys, out, texts, size, start = block.column(0).combine_chunks(), [], [], 0, 0
            for i, ids in enumerate(encode_texts([x or "" for x in block.column(1).to_pylist()], vocab), 1):
                out.append(ids.tobytes())
                texts += [decoded(ids, vocab.tokens)] if decode else []
                size += len(out[-1])
                if size > OUT or i == len(keys):
                    columns = [keys[start:i], pa.array(out, pa.binary())] + ([pa.array(texts, pa.string())] if decode else [])
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "decoded"][: len(columns)])
                    out, texts, size, start = [], [], 0, i

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary" + ", decoded string" * decode)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id_col, ids, decoded): the tokens of ids, special ones too, joined by a space; null ids give ''."""
    small_batches(df.sparkSession)
    tokens = Vocabulary(vocabulary).tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decoded(np.frombuffer(x or b"", "<u4"), tokens) for x in batch.column(1).to_pylist()]
            yield from sliced([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, "ids", "decoded"], map(len, texts), OUT)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def op1_bpe_pair_index(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    coded = encode(table(spark, sf_dir, "documents"), vocabulary, decode=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
