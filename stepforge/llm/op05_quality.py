"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text and language-specific quantiles.

Symbols are bytes, n-grams are of six, and the alphabet is all 256 of them, so that the model grows with the text it is
counted from. Counts of all orders are tables sharded by n-gram. Scoring is a join with them: a chunk of documents asks
each shard once for the distinct n-grams that it holds, as sorted, delta-coded numbers (a byte or two each), and gets the
counts back in the same order. Nothing of the model goes to the driver or to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, files_cleaned, give_back, small_batches, table, written
from .op03_pii import key_of

ORDER, BASE = 6, 256
#: An n-gram's number: its bytes in the low 48 bits, its order above them. Order 0 is the empty context.
LEVEL = 8 * ORDER
PAD = b" " * (ORDER - 1)
#: A discount is no smaller, so that every context leaves something to what it hasn't seen.
LEAST = 0.1
#: Bytes of text whose positions are handled at once, n-grams that a task counts before it hands them on, n-grams of a shard.
PIECE, HELD, SHARD = 1 << 20, 1 << 20, 500_000
#: What a shard knows of an n-gram: its count; as a context the sum of the counts after it, and how many are 1, 2 and more.
FACTS = ("n", "total", "n1", "n2", "n3")


def pieces(texts: Iterable[str | None], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams of the highest order, one for each byte of some texts, bytes of each of these texts); blanks precede a text."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size >= (most or PIECE):
            yield grams(held), np.fromiter(map(len, held), np.int64, len(held))
            held, size = [], 0
    if held:
        yield grams(held), np.fromiter(map(len, held), np.int64, len(held))


def grams(texts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(x for t in texts for x in (PAD, t)) + PAD, np.uint8)
    n = len(data) - ORDER + 1
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out <<= 8
        out |= data[k : k + n]
    lengths = np.array([len(t) for t in texts])
    inside = np.tile([True, False], len(texts))
    return out[: int(lengths.sum()) + len(PAD) * len(texts)][np.repeat(inside, np.stack([lengths, np.full(len(texts), len(PAD))], 1).ravel())]


def once(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by sorting, which takes a tenth of the time and memory that numpy's own hashing takes."""
    numbers = np.sort(numbers)
    return numbers[np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))] if len(numbers) else numbers


def lower(gram: np.ndarray, order: int) -> np.ndarray:
    """The last `order` symbols."""
    return gram & (1 << 8 * order) - 1


def asked(top: np.ndarray) -> list[np.ndarray]:
    """From the distinct n-grams of the highest order, sorted, those of each order from 0 on: suffixes of suffixes, and the
    blanks before a text, which are the context of its first bytes."""
    out = [top]
    for k in range(ORDER - 1, -1, -1):
        out.append(once(np.append(lower(out[-1], k), int.from_bytes(PAD[:k]))))
    return out[::-1]


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (key ^ key >> 23) % 2_147_483_647 % shards


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def count_grams(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (gram, n) of the highest order over all rows of df: each task counts first, then the shards add up."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            gram = np.concatenate([g for g, _ in held])
            order = np.argsort(gram, kind="stable")
            first = np.flatnonzero(np.diff(gram[order], prepend=-1))
            return gram[order][first], np.add.reduceat(np.concatenate([n for _, n in held])[order], first)

        for batch in batches:
            for found, _ in pieces(batch.column(0).to_pylist()):
                if len(found):
                    found = np.sort(found)
                    first = np.flatnonzero(np.diff(found, prepend=-1))
                    held.append((found[first], np.diff(np.append(first, len(found)))))
                    size += len(held[-1][0])
            if size > HELD:
                held = [added()]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["gram", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added()], ["gram", "n"])
        del held
        give_back()

    return df.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def all_orders(counts: DataFrame) -> list[DataFrame]:
    """Rows (gram, n) of the orders from 1 on, from those of the highest: below it, an n-gram counts the symbols seen before it."""
    out = [written(counts, f"grams-{ORDER}")]
    for k in range(ORDER - 1, 0, -1):
        out.append(written(out[-1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}"))
    return out[::-1]


def discounts(levels: DataFrame) -> dict[int, tuple[float, float, float]]:
    """Chen and Goodman's three of each order; without counts to estimate it from, a discount is half of what it may take."""
    out = {}
    for r in levels.groupBy("level").agg(*[F.count_if(F.col("n") == i).alias(f"c{i}") for i in (1, 2, 3, 4)]).collect():
        c = [r.c1, r.c2, r.c3, r.c4]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] + 2 * c[1] else 0.5
        out[r.level] = tuple(max(LEAST, min(i, i - (i + 1) * y * c[i] / c[i - 1])) if c[i - 1] and c[i] else i / 2 for i in (1, 2, 3))
    return {k: out.get(k, (0.5, 1.0, 1.5)) for k in range(1, ORDER + 1)}


@dataclass(frozen=True)
class Model:
    """facts: rows (shard, data) of FACTS by n-gram, packed; cuts: discounts by order."""

    facts: DataFrame
    shards: int
    cuts: dict[int, tuple[float, float, float]]


def kneser_ney(counts: DataFrame) -> Model:
    """The sharded model from (gram, n) of the highest order. Totals and discounts are read off the counts themselves."""
    orders = all_orders(counts)
    levels = reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("level"), "gram", "n") for k, x in enumerate(orders, 1)])
    key = lambda level, gram: F.shiftleft(level.cast("long"), LEVEL).bitwiseOR(gram)
    zero = F.lit(0).cast("long")
    own = levels.select(key(F.col("level"), F.col("gram")).alias("key"), "n", *[zero.alias(c) for c in FACTS[1:]])
    after = levels.select(key(F.col("level") - 1, F.shiftright("gram", 8)).alias("key"), zero.alias("n"), F.col("n").alias("total"), *[(c).cast("long").alias(f"n{i}") for i, c in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))])
    facts = written(own.unionByName(after).groupBy("key").agg(*[F.sum(c).alias(c) for c in FACTS]), "facts")
    shards = max(1, -(-facts.count() // SHARD))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        column = lambda c: rows.column(c).to_numpy()
        data = [np.diff(column("key"), prepend=0), *map(column, FACTS)]
        return pa.table({"shard": pa.array([int(rows.column("shard")[0].as_py())], pa.int32()), "data": pa.array([squeezed(np.concatenate(data))], pa.binary())})

    mixed = F.col("key").bitwiseXOR(F.shiftright("key", 23))
    packed = written(facts.withColumn("shard", (mixed % 2_147_483_647 % shards).cast("int")).groupBy("shard").applyInArrow(pack, "shard int, data binary"), "kneser-ney")
    cuts = discounts(levels)
    dropped(facts, *orders)
    return Model(packed, shards, cuts)


def probabilities(orders: list[np.ndarray], n: list[np.ndarray], after: list[np.ndarray], cuts: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """The probability of the last symbol of each of orders[ORDER], from the counts of all orders and, as contexts, FACTS[1:] of all but the highest."""
    low = np.full(1, 1 / BASE)
    for k in range(1, ORDER + 1):
        d1, d2, d3 = cuts[k]
        at = np.searchsorted(orders[k - 1], orders[k] >> 8)
        back = low[np.searchsorted(orders[k - 1], lower(orders[k], k - 1)) if k > 1 else np.zeros(len(at), np.int64)]
        total, n1, n2, n3 = after[k - 1]
        held = np.maximum(total, 1)
        back *= np.where(total > 0, (d1 * n1 + d2 * n2 + d3 * n3) / held, 1.0)[at]
        low = (n[k] - np.select([n[k] == 0, n[k] == 1, n[k] == 2], [0.0, d1, d2], d3)) / held[at]
        low += back
    return low


def distinct(texts: Iterable[str | None]) -> np.ndarray:
    """The n-grams of the highest order in some texts, sorted."""
    held, size = [np.zeros(0, np.int64)], 0
    for found, _ in pieces(texts):
        held.append(once(found))
        size += len(held[-1])
        if size > HELD:
            held, size = [once(np.concatenate(held))], 0
    return once(np.concatenate(held))


def parted(orders: list[np.ndarray], shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its n-grams by number, their places among all orders one after another)"""
    numbers = np.concatenate([x | k << LEVEL for k, x in enumerate(orders)])
    of = shard_of(numbers, shards)
    place = np.argsort(of, kind="stable")
    for i, x in enumerate(np.split(place, np.searchsorted(of[place], np.arange(1, shards)))):
        if len(x):
            yield i, numbers[x], x


def answered(numbers: np.ndarray, known: np.ndarray, facts: np.ndarray) -> bytes:
    """FACTS of some n-grams: all counts, then what is known of those below the highest order as contexts."""
    at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
    at[known[at] != numbers] = len(known)
    upto = int(np.searchsorted(numbers, ORDER << LEVEL))
    return squeezed(np.concatenate([facts[0][at], facts[1:, at[:upto]].ravel()]))


def bits_of(texts: Callable[[], Iterable[str | None]], answers: dict[int, bytes], shards: int, cuts: dict) -> Iterator[tuple[int, int | None]]:
    """(bytes, thousandths of a bit for each) of some texts, which are gone through twice; answers: answered() of each shard."""
    top = distinct(texts())
    log = np.zeros(0)
    if len(top):
        orders = asked(top)
        sizes = np.cumsum([len(x) for x in orders])
        n, after = np.zeros(sizes[-1], np.int64), np.zeros((len(FACTS) - 1, sizes[-2]), np.int64)
        for i, numbers, place in parted(orders, shards):
            got, upto = unsqueezed(answers.pop(i)), int(np.searchsorted(numbers, ORDER << LEVEL))
            n[place] = got[: len(place)]
            after[:, place[:upto]] = got[len(place) :].reshape(len(FACTS) - 1, -1)
        log = np.log2(probabilities(orders, np.split(n, sizes[:-1]), np.split(after, sizes[:-2], axis=1), cuts))
        del orders, n, after
    for found, lengths in pieces(texts()):
        code, own = pd.factorize(found)
        upto = np.zeros(len(code) + 1)
        np.cumsum(log[np.searchsorted(top, own)][code], out=upto[1:])
        end = np.cumsum(lengths)
        for total, size in zip((upto[end] - upto[end - lengths]).tolist(), lengths.tolist(), strict=True):
            yield size, round(-1000 * total / size) if size else None


#: Chunks whose asks of a shard one task answers; with more, a shard's facts go to several tasks.
ASKING = 512


def perplexity(df: DataFrame, model: Model, id_col: str, text_col: str, lang_col: str, chunk: int = 12 << 20, key: Column | None = None) -> DataFrame:
    """Rows (id_col, lang, key, n_symbols, bits): bits for each symbol, in thousandths as a long; null for an empty text.

    A row belongs to the chunk that the hash of its id and text names, whatever its place in the files. chunk: bytes of
    text, about; rows that repeat an id and a text until they exceed it are scored once, and come as often as they came. key: passed on.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = F.col(text_col).cast("string")
    hashed = F.xxhash64(F.col(id_col), text)
    repeats = df.groupBy(F.col(id_col).alias("id"), hashed.alias("hash")).agg(F.sum(F.octet_length(text)).alias("size"), F.count(F.lit(1)).alias("n"))
    with files_cleaned(spark):
        size, most = repeats.agg(F.sum("size"), F.max(F.when(F.col("n") > 1, F.col("size")))).first()
    chunks = max(1, -(-(size or 1) // chunk))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), (F.lit(None).cast("binary") if key is None else key).alias("key"), text.alias("text"), hashed.alias("hash"))
    if repeated := (most or 0) > chunk:
        rows = counted_once(rows, written(repeats.where((F.col("size") > chunk) & (F.col("n") > 1)).select(F.col("id").alias("of"), F.col("hash").alias("is")), "repeats"))
    more = ["times"] * repeated
    rows = rows.select("id", "lang", "key", *more, "text", F.pmod("hash", F.lit(chunks)).alias("chunk"))
    shards, cuts, salts = model.shards, model.cuts, max(1, chunks // ASKING)

    def ask(rows: pa.Table) -> pa.Table:
        top = distinct(x.as_py() for x in rows.column("text"))
        found = [(i, squeezed(np.diff(numbers, prepend=0))) for i, numbers, _ in parted(asked(top), shards)] if len(top) else []
        give_back()
        return pa.table({"shard": pa.array([i for i, _ in found], pa.int32()), "chunk": pa.array([rows.column("chunk")[0].as_py()] * len(found), pa.int64()), "data": pa.array([x for _, x in found], pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's facts come first (chunk -1), then what the chunks ask of it, one after another."""
        nothing = np.zeros(1, np.int64), np.zeros((len(FACTS), 2), np.int64)
        now, (known, facts) = -1, nothing
        for batch in batches:
            for i in range(batch.num_rows):
                shard, number, data = (batch.column(k)[i].as_py() for k in range(3))
                numbers = unsqueezed(data)
                if number < 0:
                    numbers = numbers.reshape(len(FACTS) + 1, -1)
                    now, known, facts = shard, np.cumsum(numbers[0]), np.pad(numbers[1:], ((0, 0), (0, 1)))
                    continue
                if shard != now:
                    now, (known, facts) = shard, nothing
                out = (number, shard, answered(np.cumsum(numbers), known, facts))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["chunk", "shard", "data"])

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        column = docs.column("text")
        found = [*bits_of(lambda: (x.as_py() for x in column), dict(zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True)), shards, cuts)]
        give_back()
        return pa.table({id_col: docs.column("id"), "lang": docs.column("lang"), "key": docs.column("key"), **{c: docs.column(c) for c in more}, "n_symbols": pa.array([n for n, _ in found], pa.int64()), "bits": pa.array([b for _, b in found], pa.int64())})

    asks = rows.groupBy("chunk").applyInArrow(ask, "shard int, chunk long, data binary")
    known = model.facts.select("shard", F.lit(-1).cast("long").alias("chunk"), "data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    salted = known.unionByName(asks.withColumn("salt", F.pmod("chunk", F.lit(salts)).cast("long"))).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "chunk")
    answers = salted.select("shard", "chunk", "data").mapInArrow(answer, "chunk long, shard int, data binary")
    kind = df.schema[id_col].dataType.simpleString()
    out = rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"`{id_col}` {kind}, lang string, key binary, {'times long, ' * repeated}n_symbols long, bits long")
    return out.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("time", "times") if repeated else out


def counted_once(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """rows (id, lang, key, text, hash) with `times`, and one for all that repeat an (id, hash) of heavy (of, is). They meet in each task before the shuffle."""
    same = rows["id"].eqNullSafe(heavy["of"]) & (rows["hash"] == heavy["is"])
    alike = rows.join(heavy, same, "left_semi").groupBy("id", "lang", "key", "hash").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    return rows.join(heavy, same, "left_anti").withColumn("times", F.lit(1).cast("long")).unionByName(alike)


@dataclass(frozen=True)
class Rule:
    """A document is rejected beyond the quantile `high` of its language's held-out trusted documents.

    prior: symbols of the language's median that are mixed into a document, so that a few odd words reject nothing.
    heldout: one in so many trusted documents sets the quantiles and doesn't train the model.
    broadcast_ids, broadcast_langs: with more trusted documents or languages, a join by shuffle finds them.
    """

    high: float = 0.99
    prior: int = 60
    heldout: int = 5
    broadcast_ids: int = 2_000_000
    broadcast_langs: int = 50_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Rows (doc_id): those that labels call good and never bad or toxic."""
    x = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return x.where("q = 1 and t = 0").select("doc_id")


def quantile(value: str, at: float) -> Column:
    """The least value with at least a share `at` of the values up to it, from exact counts that each task makes first."""
    return F.expr(f"percentile_disc({at}) within group (order by {value})").cast("long")


def judged(docs: DataFrame, labels: DataFrame, rule: Rule, id_col: str, text_col: str, lang_col: str, key: Column | None = None) -> DataFrame:
    """What classify() returns, with a column `key`."""
    ids = written(trusted_ids(labels).select(F.col("doc_id").alias(id_col)), "trusted")
    own = F.broadcast(ids) if ids.limit(rule.broadcast_ids + 1).count() <= rule.broadcast_ids else ids
    fold = F.pmod(F.xxhash64(F.col(id_col)), F.lit(rule.heldout))
    model = kneser_ney(count_grams(docs.select(id_col, text_col).where(fold > 0).join(own, id_col, "left_semi"), text_col))
    scores = written(perplexity(docs, model, id_col, text_col, lang_col, key=key), "perplexity")
    dropped(model.facts)
    fair = scores.where(F.col("bits").isNotNull() & (fold == 0)).join(own, id_col, "left_semi").select("lang", "bits", "n_symbols")

    def by_language(rows: DataFrame) -> DataFrame:
        rows = written(rows, "languages")
        return F.broadcast(rows) if rows.limit(rule.broadcast_langs + 1).count() <= rule.broadcast_langs else rows

    def mixed(x: DataFrame) -> DataFrame:
        return x.withColumn("score", F.round((F.col("bits") * F.col("n_symbols") + F.col("middle") * rule.prior) / (F.col("n_symbols") + rule.prior)).cast("long"))

    middle = by_language(fair.groupBy("lang").agg(quantile("bits", 0.5).alias("own_middle")))
    median = fair.agg(quantile("bits", 0.5)).first()[0]
    near = lambda x: mixed(x.join(middle, "lang", "left").withColumn("middle", F.coalesce("own_middle", F.lit(median).cast("long"))))
    limit = by_language(near(fair).groupBy("lang").agg(quantile("score", rule.high).alias("own_limit")))
    whole = near(fair).agg(quantile("score", rule.high)).first()[0]
    out = near(scores).join(limit, "lang", "left").withColumn("threshold", F.coalesce("own_limit", F.lit(whole).cast("long")))
    return out.select(id_col, "lang", "key", "n_symbols", "bits", "score", "threshold", F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id_col, lang, n_symbols, bits, score, threshold, kept), one for each row of docs.

    bits: thousandths of a bit for each byte (perplexity = 2^(bits/1000)), null for empty and null texts, which have
    nothing against them and are kept. score: bits with the prior. Null languages count as one language; a
    language without trusted text takes the quantile over all trusted documents, and without any everything is kept.
    Ties with the threshold are kept; repeated rows get the same result; an empty table gives an empty one.
    """
    return judged(docs, labels, rule, id_col, text_col, lang_col).drop("key")


def good_documents(docs: DataFrame, labels: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rejected ones. Of rows that share an id, those with a rejected text go."""
    key = key_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    bad = judged(docs, labels, rule, id_col, text_col, lang_col, key).where("not kept").select(F.col(id_col).alias("bad"), F.col("lang").alias("bad_lang"), F.col("key").alias("bad_key")).distinct().hint("merge")
    same = docs[id_col].eqNullSafe(bad["bad"]) & (F.coalesce(docs[lang_col].cast("string"), F.lit("")) == bad["bad_lang"])
    return docs.join(bad, same & (key_of(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == bad["bad_key"]), "left_anti")


def op5_quality_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and verdict for every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
