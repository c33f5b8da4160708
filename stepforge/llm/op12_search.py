"""Ranked lexical search over inverted treaps.

The postings of a term are a treap: a search tree by document, a heap by impact, so that the root of a subtree has the
greatest impact in its range of documents. A query goes down the treaps of all its terms at once, by ranges of
documents: the sum of the roots' impacts bounds every score in a range, and a range that can't reach the k-th best score
so far is left out with all its subtrees.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import gathered, give_back, small_batches, table, written

#: Bytes of items' texts that make a block of queries: a block's terms go to every task.
ITEMS = 32 << 20
#: Bytes of a shard's document numbers: 2,000,000 postings, whose treaps take about 60 MB.
SHARD = 8 << 20
#: A range with so few postings is scored in one go.
LEAF = 2048
#: After so many splits what is left is scored in one go, however unbalanced treaps are.
ROUNDS = 64
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters, digits and all characters beyond ASCII; A-Z are lower-cased."""
    return (text or "").encode().translate(TABLE).split()


def postings(docs: DataFrame, codes: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, codes, tfs) of the documents with a term: n terms in all, and of those in `codes` the numbers and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, numbers, tfs = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    found = Counter(map(codes.get, words))
                    found.pop(None, None)
                    rows.append(i)
                    sizes.append(len(words))
                    numbers.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                    tfs.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(numbers, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "codes", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, codes binary, tfs binary")


def joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4")


def document_counts(found: DataFrame, n_codes: int) -> np.ndarray:
    """In how many documents each code occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_codes, np.int64)
        for batch in batches:
            total += np.bincount(joined(batch.column(0)), minlength=n_codes)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "df"])

    out = np.zeros(n_codes, np.int64)
    for r in found.select("codes").mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():
        out[r.code] = r.df
    return out


@dataclass
class Shard:
    """The treaps of some documents, one after another: a term's nodes lie in order of document between begin[term] and begin[term + 1].

    key: term * documents + document; impact: by node; left, right: nodes, -1 for none; root: by term.
    """

    n_docs: int
    begin: np.ndarray
    key: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: np.ndarray

    @classmethod
    def build(cls, sizes: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_terms: int, length: Callable[[np.ndarray], np.ndarray]) -> Shard:
        """sizes: terms of each document; (term, doc, tf): postings in any order; length: what a document's size adds under the fraction."""
        n_docs = len(sizes)
        key = term.astype(np.int64) * n_docs + doc
        order = np.argsort(key)
        key, doc, tf = key[order], doc[order].astype(np.int32), tf[order].astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + length(sizes)[doc])
        begin = np.searchsorted(key, np.arange(n_terms + 1, dtype=np.int64) * n_docs)
        left, right, root = np.full(len(key), -1, np.int32), np.full(len(key), -1, np.int32), np.full(n_terms, -1, np.int32)
        # Equal impacts are told apart by chance, so that they don't make a list of a tree.
        rank = impact << 20 | np.random.default_rng(len(key)).integers(0, 1 << 20, len(key))
        for t in np.flatnonzero(np.diff(begin)).tolist():
            a, b = int(begin[t]), int(begin[t + 1])
            root[t] = a + heap(rank[a:b].tolist(), a, left[a:b], right[a:b])
        return cls(n_docs, begin, key, doc, impact, left, right, root)


def heap(rank: list[int], base: int, left: np.ndarray, right: np.ndarray) -> int:
    """Fill in the children of the treap over nodes in order; the root's place among them."""
    if len(rank) == 1:
        return 0
    lefts, rights, spine = [-1] * len(rank), [-1] * len(rank), []
    for i, x in enumerate(rank):
        last = -1
        while spine and rank[spine[-1]] < x:
            last = spine.pop()
        if last >= 0:
            lefts[i] = base + last
        if spine:
            rights[spine[-1]] = base + i
        spine.append(i)
    left[:], right[:] = lefts, rights
    return spine[0]


class Best:
    """The k best of the scores so far, equal ones by document; floor: what a score must reach to matter."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(1, floor)
        self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        fit = score >= self.floor
        if fit.any():
            score, doc = np.concatenate([self.score, score[fit]]), np.concatenate([self.doc, doc[fit]])
            order = np.lexsort((doc, -score))[: self.k]
            self.score, self.doc = score[order], doc[order]
            if len(order) == self.k:
                self.floor = max(self.floor, int(self.score[-1]))


def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [a, b), one range after another."""
    n = b - a
    return np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))


def search(shard: Shard, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Add the best documents of a shard for a query: its terms, each once, and their weights, all above 0."""
    some = shard.root[terms] >= 0
    terms, weight = terms[some], weight[some]
    if not len(terms):
        return
    # One entry for each range of documents and term: the slice of the term's nodes in the range, and a node to go down from.
    low, high = np.array([-1]), np.array([shard.n_docs])
    at, term, a, b, node = np.zeros(len(terms), np.int64), np.arange(len(terms)), shard.begin[terms], shard.begin[terms + 1], shard.root[terms].astype(np.int64)
    later: list[tuple[np.ndarray, ...]] = []
    for turn in range(ROUNDS + 1):
        while True:
            doc = shard.doc[node]
            over, under = doc <= low[at], doc >= high[at]
            move = np.flatnonzero(over | under)
            if not len(move):
                break
            node[move] = np.where(over[move], shard.right[node[move]], shard.left[node[move]])
        gain = weight[term] * shard.impact[node]
        bound, size = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        np.add.at(bound, at, gain)
        np.add.at(size, at, b - a)
        live = bound >= best.floor
        whole = live & ((size <= LEAF) | (turn == ROUNDS))
        if whole.any():
            pick = whole[at]
            number = np.cumsum(whole) - 1
            later.append((bound[whole], number[at[pick]], term[pick], a[pick], b[pick]))
        split = live & ~whole
        if not split.any():
            break
        pick = split[at]
        number = np.cumsum(split) - 1
        at, term, a, b, node, gain, low, high = number[at[pick]], term[pick], a[pick], b[pick], node[pick], gain[pick], low[split], high[split]
        # The root with the greatest share of the bound parts the range; its document is scored in all treaps.
        order = np.lexsort((-gain, at))
        first = np.append(True, at[order][1:] != at[order][:-1])
        pivot = shard.doc[node[order[first]]].astype(np.int64)
        key = terms[term].astype(np.int64) * shard.n_docs + pivot[at]
        place = np.searchsorted(shard.key, key)
        hit = (place < b) & (shard.key[np.minimum(place, len(shard.key) - 1)] == key)
        score = np.zeros(len(low), np.int64)
        np.add.at(score, at[hit], weight[term[hit]] * shard.impact[place[hit]])
        best.add(score, pivot)
        lefts, rights = place > a, place + hit < b
        n = len(low)
        at = np.concatenate([at[lefts], at[rights] + n])
        a, b = np.concatenate([a[lefts], (place + hit)[rights]]), np.concatenate([place[lefts], b[rights]])
        term, node = np.concatenate([term[lefts], term[rights]]), np.concatenate([node[lefts], node[rights]])
        low, high = np.concatenate([low, pivot]), np.concatenate([pivot, high])
        if not len(at):
            break
        used = np.bincount(at, minlength=2 * n) > 0
        at, low, high = (np.cumsum(used) - 1)[at], low[used], high[used]
    if later:
        score_ranges(shard, weight, later, best)


def score_ranges(shard: Shard, weight: np.ndarray, later: list[tuple[np.ndarray, ...]], best: Best) -> None:
    """Score what is left range by range, those with the highest bounds first, until no bound reaches the k-th best score."""
    bases = np.append(0, np.cumsum([len(x[0]) for x in later])[:-1])
    bound = np.concatenate([x[0] for x in later])
    at = np.concatenate([x[1] + base for x, base in zip(later, bases.tolist(), strict=True)])
    term, a, b = (np.concatenate([x[i] for x in later]) for i in (2, 3, 4))
    rank = np.empty(len(bound), np.int64)
    rank[np.argsort(-bound, kind="stable")] = np.arange(len(bound))
    order = np.argsort(rank[at], kind="stable")
    at, term, a, b, bound = rank[at][order], term[order], a[order], b[order], -np.sort(-bound)
    done, step = 0, 16
    while done < len(bound) and bound[done] >= best.floor:
        upto = min(done + step, int(np.searchsorted(-bound, -best.floor, side="right")))
        x, y = np.searchsorted(at, [done, upto])
        node = spread(a[x:y], b[x:y])
        score = np.bincount(shard.doc[node], np.repeat(weight[term[x:y]], b[x:y] - a[x:y]) * shard.impact[node], shard.n_docs).astype(np.int64)
        found = np.flatnonzero(score)
        best.add(score[found], found)
        done, step = upto, step * 2


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_bytes: int = ITEMS, shard_bytes: int = SHARD) -> DataFrame:
    """Rows (item_col, rank, id_col, score): each item's k best documents with a score above 0.

    Documents are scored by how rare an item's terms are and how often, for its length, a document has them; equal scores go by
    ascending id, null first. Rows that share an item id, null among them, are one item with the terms of all. Null and empty texts have no terms:
    such a document isn't counted, such an item has no rows. Rows of docs that share an id are documents of their own. Empty tables give an empty one.

    Items are taken in blocks of item_bytes of text, each against all documents. Postings of a block's terms stay in the partitions
    that read the documents; every task builds treaps for shards of them, one at a time, and hands on its k best of each item.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = f"`{item_col}` {items.schema[item_col].dataType.simpleString()}, `{id_col}` {docs.schema[id_col].dataType.simpleString()}, score long"
    size, n = items.agg(F.coalesce(F.sum(F.octet_length(item_text)), F.lit(0)), F.count_distinct(item_col)).first()
    blocks = 1 + min(size // item_bytes, n)
    parts = [items.where(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == i) for i in range(blocks)] if blocks > 1 else [items]
    out = None
    for part in parts:
        rows = best_of_block(docs, part.select(item_col, item_text), k, id_col, text_col, kinds, shard_bytes)
        out = rows if out is None else out.unionByName(rows)
    place = F.row_number().over(Window.partitionBy(item_col).orderBy(F.desc("score"), F.asc_nulls_first(id_col)))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select(item_col, "rank", id_col, "score")


def best_of_block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str, kinds: str, shard_bytes: int) -> DataFrame:
    """Every task's k best documents of each item."""
    asked: dict[object, set[bytes]] = {}
    for item, text in items.collect():  # a block's texts are bounded
        asked.setdefault(item, set()).update(terms_of(text))
    codes = {t: i for i, t in enumerate(sorted(set().union(*asked.values())))}
    found = written(postings(docs, codes, id_col, text_col), "postings", "zstd")
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_counts(found, len(codes))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    queries = []
    for item, words in asked.items():
        own = np.array(sorted(codes[w] for w in words), np.int64)
        queries.append((item, own[weight[own] > 0] if len(own) else own))
    length = lambda n: 20 * (50 + 50 * n * n_docs // n_terms)
    item_type = to_arrow_type(items.schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list[tuple]] = [[] for _ in queries]
        kind, names = None, [c.split()[0].strip("`") for c in kinds.split(", ")]
        for block in gathered(batches, 2, shard_bytes):
            block = block.take(pc.array_sort_indices(block.column(0), null_placement="at_start"))
            kind, ids = block.schema.field(0).type, block.column(0)
            each = pc.binary_length(block.column(2)).to_numpy() // 4
            shard = Shard.build(block.column(1).to_numpy(), joined(block.column(2)), np.repeat(np.arange(block.num_rows), each), joined(block.column(3)), len(codes), length)
            for i, (_, own) in enumerate(queries):
                top = tops[i]
                best = Best(k, top[-1][0] if len(top) == k else 1)
                search(shard, own, weight[own], best)
                if len(best.score):
                    rows = [(s, x is not None, x) for s, x in zip(best.score.tolist(), ids.take(pa.array(best.doc)).to_pylist(), strict=True)]
                    tops[i] = sorted(top + rows, key=lambda r: (-r[0], r[1], r[2] if r[1] else 0))[:k]
        rows = [(queries[i][0], x, s) for i, top in enumerate(tops) for s, _, x in top]
        if rows:
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, item_type), pa.array(b, kind), pa.array(c, pa.int64())], names)
        give_back()

    return found.mapInArrow(run, kinds)


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, total),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM sized, total),
scored AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM placed WHERE rank <= 50
"""
