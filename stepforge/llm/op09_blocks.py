"""Substring dedup with fixed-block anchors.

Every document's non-overlapping blocks of 25 words are the reference index. Every rolling window of 25 words probes it:
a repeat of 50 words holds a whole block of the other document. Tasks send their windows to shards as sorted,
delta-coded fingerprints, a few bytes each, and get back those that are a block and stand in two documents. Around these
hits, windows of 50 words are extended word by word: exact repeats join by their 96-bit hashes, document by document.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, gathered, sliced, small_batches, table, written

WINDOW, BLOCK = 50, 25
#: Bytes of text that a task handles at once, and bytes of text for each shard of the index.
CHUNK, SHARD = 5 << 20, 12 << 20
#: Repeated whole texts that are few enough to send to every task, at 32 bytes each.
COPIES = 500_000
#: Odd multipliers of the rolling hashes.
M1, M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def rolling(words: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """The hash of every window of `size` words: a polynomial modulo 2^64, then mixed."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.append(np.uint64(1), np.full(n - 1, multiplier, np.uint64)), dtype=np.uint64)
        prefix = np.append(np.uint64(0), np.cumsum(words * power, dtype=np.uint64))
        inverse = np.cumprod(np.append(np.uint64(1), np.full(n - size, pow(multiplier, -1, 1 << 64), np.uint64)), dtype=np.uint64)
        out = (prefix[size:] - prefix[:-size]) * inverse
        out ^= out >> np.uint64(32)
        out *= np.uint64(M2)
        return out ^ out >> np.uint64(29)


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(len(values).to_bytes(8, "little") + steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


class Chunk:
    """The words of some texts, one after another."""

    def __init__(self, texts: list[str | None], known: WordHashes):
        self.words = [(x or "").encode().split() for x in texts]  # bytes split at ASCII white space only
        self.size = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.begin = np.append(0, np.cumsum(self.size))
        self.hashes = np.fromiter((known[w] for x in self.words for w in x), np.uint64, int(self.begin[-1]))
        self.doc = np.repeat(np.arange(len(texts)), self.size)

    def starts(self, size: int) -> np.ndarray:
        """Where a window of `size` words starts within one text."""
        n = max(0, len(self.hashes) - size + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :]) if n else np.zeros(0, np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) for each run of rows with the same number in column 0. Where a file is cut within a chunk, either part comes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1) if len(numbers) else ():
            if held and held[0].column(0)[0].as_py() != int(numbers[part[0]]):
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(part[0]), len(part)))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def numbered(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows (chunk, row, id_col, size, text), written: whatever reads them again sees the same numbers, however files are split then."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 20
        for number, block in enumerate(gathered(batches, 1, CHUNK), first):
            ids, texts = (block.column(i).combine_chunks() for i in (0, 1))
            n = len(ids)
            sizes = np.fromiter((len((x.as_py() or "").encode()) for x in texts), np.int64, n)
            yield from sliced([pa.array(np.full(n, number)), pa.array(np.arange(n) + (number << 24)), ids, pa.array(sizes), texts], ["chunk", "row", id_col, "size", "text"], sizes.tolist())

    return written(rows.mapInArrow(run, f"chunk long, row long, `{id_col}` {kind}, size long, text string"), "chunks", "zstd")


def block_hits(texts: DataFrame, bits: int, shards: int) -> DataFrame:
    """Rows (chunk, hits): the fingerprints of windows in a chunk that are a block somewhere and stand in two rows or more."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for number, rows in chunks(batches):
            c = Chunk(rows.column(1).to_pylist(), known)
            at = c.starts(BLOCK)
            if not len(at):
                continue
            fp = rolling(c.hashes, BLOCK, M1)[at] >> np.uint64(64 - bits)
            order = np.argsort(fp, kind="stable")
            fp, doc, block = fp[order], c.doc[at][order], ((at - c.begin[c.doc[at]]) % BLOCK == 0)[order]
            first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
            # The order is stable, so that equal fingerprints stand by document.
            several = doc[first] != doc[np.append(first[1:], len(fp)) - 1]
            value = fp[first] << np.uint64(2) | np.logical_or.reduceat(block, first).astype(np.uint64) << np.uint64(1) | several.astype(np.uint64)
            cuts = np.searchsorted(value, np.array([(i << bits) // shards << 2 for i in range(1, shards)], np.uint64))
            parts = [(i, packed(x)) for i, x in enumerate(np.split(value, cuts)) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["shard", "chunk", "data"])

    def meet(rows: pa.Table) -> pa.Table:
        values = [unpacked(x.as_py()) for x in rows.column("data")]
        fps = np.concatenate([x >> np.uint64(2) for x in values])
        flags = np.concatenate([x & np.uint64(3) for x in values]).astype(np.uint8)
        order = np.argsort(fps, kind="stable")
        ranked, flags = fps[order], flags[order]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        flag = np.bitwise_or.reduceat(flags, first)
        times = np.diff(np.append(first, len(ranked)))
        hot = ranked[first][(flag & 2 > 0) & ((times > 1) | (flag & 1 > 0))]
        found = [np.intersect1d(x >> np.uint64(2), hot, assume_unique=True) for x in values]
        keep = [i for i, x in enumerate(found) if len(x)]
        return pa.table({"chunk": rows.column("chunk").take(pa.array(keep, pa.int64())), "hits": pa.array([packed(found[i]) for i in keep], pa.binary())})

    return texts.select("chunk", "text").mapInArrow(probe, "shard int, chunk long, data binary").groupBy("shard").applyInArrow(meet, "chunk long, hits binary")


def finish(words: list[bytes], digest: bool) -> bytes | str:
    kept = b" ".join(words)
    return hashlib.sha256(kept).hexdigest().encode() if digest else kept


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Rows (id_col, n_words, n_removed, kept), one for each row of df: the words left, joined by spaces, as UTF-8 bytes.

    A word goes if a window of 50 words covers it whose words also start in a row with a smaller id. Rows without an
    id are neither a source nor changed; rows that share an id are no source for each other. Null and empty texts have
    no words; texts of any length are handled whole; an empty table gives an empty one. df must give the same rows when
    read again, in any order. digest: give the hex SHA-256 of the kept bytes in their place.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, F.col(text_col).cast("string").alias("text"))
    rows, copies = without_copies(rows, id_col)
    found = candidates(rows, id_col, digest)
    near = found.where("words is not null").withColumnRenamed(id_col, "id")
    places = near.select("row", "id", F.explode(F.arrays_zip("at", "a", "b")).alias("x")).select("row", "id", "x.*")
    # Written, so that the join has a shuffle on either side and adaptive execution can split a hot window's rows.
    sources = written(places.groupBy("a", "b").agg(F.min("id").alias("source"), F.max("id").alias("last")).where("source < last").drop("last"), "sources")
    repeats = places.join(sources, ["a", "b"]).where("source < id").groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("repeats"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, out = [], []
            for n, words, at in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words, cover = words.split(b" "), np.zeros(n + 1, np.int64)
                if at:
                    at = np.array(at)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + WINDOW, -1)
                keep = np.cumsum(cover)[:n] == 0
                gone.append(int(n - keep.sum()))
                out.append(finish([w for w, k in zip(words, keep.tolist(), strict=True) if k], digest))
            yield from sliced([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(out, pa.binary())], [id_col, "n_words", "n_removed", "kept"], map(len, out))

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [x.encode().split() for x in batch.column(1).to_pylist()]
            size = list(map(len, words))
            out = [finish([] if n >= WINDOW else w, digest) for w, n in zip(words, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array([n if n >= WINDOW else 0 for n in size], pa.int64()), pa.array(out, pa.binary())], [id_col, "n_words", "n_removed", "kept"])

    schema = f"`{id_col}` {kind}, n_words long, n_removed long, kept binary"
    done = near.select("row", "id", "n_words", "words").join(repeats, "row", "left").select("id", "n_words", "words", "repeats").mapInArrow(cut, schema)
    out = found.where("words is null").select(id_col, "n_words", F.lit(0).cast("long").alias("n_removed"), "kept").unionByName(done)
    return out if copies is None else out.unionByName(copies.mapInArrow(copied, schema))


def without_copies(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows without copies of a whole text that a smaller id has, those copies), or (rows, None).

    What a copy holds its first holds too, so that copies need no search. Without this the result is the same; it is
    done where the list of repeated texts is small enough for every task, by 128-bit hashes.
    """
    keys = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    several = written(keys.where("text is not null").groupBy("k1", "k2").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "copies")
    if several.limit(COPIES + 1).count() > COPIES:
        return rows, None
    keys = keys.join(F.broadcast(several), ["k1", "k2"], "left").withColumn("copy", F.coalesce(F.col("first") < F.col(id_col), F.lit(False)))
    return keys.where("not copy").select(id_col, "text"), keys.where("copy").select(id_col, "text")


def candidates(rows: DataFrame, id_col: str, digest: bool) -> DataFrame:
    """Rows (row, id_col, n_words, words, at, a, b, kept): a text near whose blocks something repeats has its words and, for
    each window of 50 words there, its place and hashes; any other text is finished."""
    kind = rows.schema[id_col].dataType.simpleString()
    texts = numbered(rows, id_col)
    n_bytes = texts.agg(F.sum("size")).first()[0] or 1
    bits = min(60, math.ceil(math.log2(n_bytes)) + 10)
    hits = block_hits(texts, bits, max(1, n_bytes // SHARD))

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(left.column("text").to_pylist(), WordHashes())
        hot = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpacked(x.as_py()) for x in right.column("hits"))]))
        at = c.starts(BLOCK)
        near = np.zeros(len(c.hashes) + 1, np.int64)
        if len(at) and len(hot):
            fp = rolling(c.hashes, BLOCK, M1)[at] >> np.uint64(64 - bits)
            hit = at[hot[np.minimum(np.searchsorted(hot, fp), len(hot) - 1)] == fp]
            # A window of 50 words that holds a hit starts at most 25 words before it.
            np.add.at(near, np.maximum(hit - (WINDOW - BLOCK), 0), 1)
            np.add.at(near, hit + 1, -1)
        at = c.starts(WINDOW)
        at = at[np.cumsum(near)[at] > 0]
        a, b = (rolling(c.hashes, WINDOW, m)[at] for m in (M1, M2))
        cut = np.searchsorted(at, c.begin)
        per = np.diff(cut)
        lists = lambda x, k: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x, k))
        some = per > 0
        joined = [b" ".join(w) if s else None for w, s in zip(c.words, some, strict=True)]
        return pa.table({
            "row": left.column("row"), id_col: left.column(id_col), "n_words": pa.array(c.size),
            "words": pa.array(joined, pa.binary()),
            "at": lists((at - c.begin[c.doc[at]]).astype(np.int32), pa.int32()), "a": lists(a.view(np.int64), pa.int64()), "b": lists((b >> np.uint64(32)).astype(np.uint32).view(np.int32), pa.int32()),
            "kept": pa.array([None if s else finish(w, digest) for w, s in zip(c.words, some, strict=True)], pa.binary()),
        })

    found = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, f"row long, `{id_col}` {kind}, n_words long, words binary, at array<int>, a array<long>, b array<int>, kept binary")
    found = written(found, "blocks")
    dropped(texts)
    return found


def op9_substring_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that repeat an earlier document's windows."""
    out = drop_repeats(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))
