"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

A block of documents packs within its task. The open bin takes, of the items that fit on every axis, the one
with the largest dot product of its size and the room left. Where none fits, a cut fills a gap worth filling.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: Tokens that pack together: a block's arrays stay small, and what its last bin wastes is under a thousandth.
BLOCK = 6_000_000


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold: tokens, segments, and tokens that bear loss, of which a few less than there is room for.

    gap: a smaller one is padded, a larger one filled by cutting.
    """

    tokens: int = 2048
    segments: int = 16
    loss: int = 2040
    gap: int = 32


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, start, length, bin, offset) of every piece; an item's last `tokens - loss` tokens bear no loss.

    Items without tokens give no piece.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], float)
    most = min(limits.tokens, limits.loss)
    n_bin = 0
    rest = []
    for i, (n, bear) in enumerate(zip(tokens.tolist(), loss.tolist(), strict=True)):
        at = 0
        while n - at > limits.tokens or bear - at > limits.loss:
            yield i, at, most, n_bin, 0
            at, n_bin = at + most, n_bin + 1
        if n > at:
            rest.append((i, at, n - at, max(0, bear - at)))
    if not rest:
        return
    item, start, size, bear = np.array(rest, np.int64).T
    order = np.lexsort((item, -bear, -size))
    item, start, size, bear = item[order], start[order], size[order], bear[order]
    need = np.stack([size, np.ones_like(size), bear]) / cap[:, None]
    open_ = np.ones(len(size), bool)
    left, first = len(size), 0
    while left:
        if left < len(size) // 2:
            keep = np.flatnonzero(open_)
            item, start, size, bear, need = item[keep], start[keep], size[keep], bear[keep], need[:, keep]
            open_, first = np.ones(left, bool), 0
        room, offset = cap.copy(), 0
        while left:
            fits = np.flatnonzero(open_[first:] & (size[first:] <= room[0]) & (bear[first:] <= room[2])) + first if room[1] else ()
            if len(fits):
                k = int(fits[np.argmax((room / cap) @ need[:, fits])])
                taken = int(size[k])
                open_[k] = False
                left -= 1
                while first < len(open_) and not open_[first]:
                    first += 1
                yield int(item[k]), int(start[k]), taken, n_bin, offset
                room -= (taken, 1, bear[k])
            else:
                taken = int(min(room[0], room[2])) if room[1] else 0
                if taken < limits.gap:
                    break
                # What is left of the largest item is shorter; it keeps its place in the order by size only roughly.
                k = first
                taken = min(taken, int(bear[k]))
                if taken < limits.gap:
                    break
                yield int(item[k]), int(start[k]), taken, n_bin, offset
                start[k] += taken
                size[k] -= taken
                bear[k] -= taken
                need[:, k] = np.array([size[k], 1, bear[k]]) / cap
                room -= (taken, 1, taken)
            offset += taken
        n_bin += 1


class Coder:
    """Token ids as the tokenizers library gives them for a byte-level vocabulary, computed by tiktoken's kernel.

    The kernel takes the vocabulary's own merges: an id that a merge makes is its rank.
    """

    def __init__(self, text: str, pattern: str):
        import json

        from .op01_bpe import byte_letters

        spec = json.loads(text)
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.parts = (pattern, ranks, special)

    def __call__(self) -> Callable[[str], np.ndarray]:
        import tiktoken

        pattern, ranks, special = self.parts
        coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

        def run(text: str) -> np.ndarray:
            named = any(x in text for x in special)
            return np.array(coder.encode(text, allowed_special="all") if named else coder.encode_ordinary(text), "<u4")

        return run


def pack_texts(df: DataFrame, coder: Callable[[], Callable[[str], np.ndarray]], end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, start, length, ids, doc_tokens, sequence_id, offset): where each piece of each text lies.

    coder: makes a function from a text to its ids, once in each task. end_id follows the ids of every text and bears
    no loss. Null texts are empty and so give one piece with end_id alone. Repeated rows are packed as often as they
    come. Any long text is cut into full sequences; any number of equal ones is packed in many tasks. Sequence ids
    are unique over the tasks.
    """
    small_batches(df.sparkSession)
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base = coder(), TaskContext.get().partitionId() << 32
        keys, docs, total, kind = [], [], 0, None

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            size = np.array([len(x) for x in docs], np.int64)
            top, rows = -1, []
            for i, start, n, b, offset in pack(size, size - 1, limits):
                rows.append((keys[i], start, n, docs[i][start : start + n].tobytes(), int(size[i]), base + b, offset))
                top = max(top, b)
                if len(rows) == 2048:
                    yield records(rows)
                    rows = []
            if rows:
                yield records(rows)
            base += top + 1

        def records(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(code(text.as_py() or ""), np.array([end_id], "<u4"))
                keys.append(key)
                docs.append(ids)
                total += len(ids)
                if total >= BLOCK:
                    yield from packed()
                    keys, docs, total = [], [], 0
        if docs:
            yield from packed()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def coder_of(path: str | None = None) -> Coder:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return Coder(f.read(), public_tokenizers.PATTERN)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    from pyspark.sql import functions as F

    pieces = pack_texts(docs, coder_of(path))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
