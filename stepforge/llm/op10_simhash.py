"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints meet in buckets of equal bits: of six bands, two differing bits leave four whole. Within a
bucket, planes hold one bit of many fingerprints; carry-save counters add the differing bits of 64 pairs in a word, and
a block is left as soon as all its pairs are over the radius. A bucket gives a spanning forest of its links, not the
links, and components come from distributed star contraction.

Near copies by the similarity of their shingle sets are another matter: at a Jaccard similarity of 0.8 fingerprints differ in
10 bits or so, too many to search for. There links of fingerprints give the close candidates, MinHash bands those beyond the
radius, and the sets themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, give_back, small_batches, table, written
from .op03_pii import key_of
from .op04_exact import normalised

RADIUS, WORDS = 2, 3
#: Bands of 64 bits; RADIUS differing bits leave len(BANDS) - RADIUS of them whole.
BANDS = (11, 11, 11, 11, 10, 10)
#: Larger buckets are searched by flipping bits of each fingerprint, which is exact as well and takes linear time.
FLIP_OVER = 4096


def masks() -> list[int]:
    """The masks under which two fingerprints within the radius agree at least once."""
    band, at = [], 0
    for n in BANDS:
        band.append(((1 << n) - 1) << at)
        at += n
    return [sum(x) for x in combinations(band, len(BANDS) - RADIUS)]


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The hash of each run of so many words; a shorter text is one run, and one without words has none."""
    data = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not data:
        return np.zeros(0, np.uint64)
    joined = b" ".join(data)
    if len(data) < words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    starts = np.append(0, np.cumsum(sizes + 1)[:-1])
    ends = starts + sizes
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)], np.uint64)


def fingerprint(text: str) -> int:
    return simhash(shingles(text))


def simhash(hashes: np.ndarray) -> int:
    """Each bit is set if it is in over half the hashes; zero without any."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, fp): the fingerprint as a signed long. Null texts are empty; without words it is zero."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x or "") for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id_col, "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def planes(values: np.ndarray) -> list[np.ndarray]:
    """For each bit, a bit vector over the values, in whole 64-bit words."""
    n = -(-len(values) // 64) * 8
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    out = np.zeros((64, n), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return list(out.view(np.uint64))


def within(vertical: list[np.ndarray], query: int, n: int, radius: int = RADIUS) -> np.ndarray:
    """Which of n values, stored as planes, differ from the query in at most `radius` bits (radius 2).

    ones and twos count the differing bits of each lane modulo 4; a lane that reaches 3 is over for good.
    """
    blocks = np.arange(len(vertical[0]))
    ones, twos, over = (np.zeros(len(blocks), np.uint64) for _ in range(3))
    full = np.uint64(2**64 - 1)
    for k, plane in enumerate(vertical):
        differ = plane[blocks] ^ (full if query >> k & 1 else np.uint64(0))
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        over |= ones & twos
        if k % 8 == 7:
            alive = over != full
            if not alive.all():
                blocks, ones, twos, over = blocks[alive], ones[alive], twos[alive], over[alive]
                if not len(blocks):
                    break
    lanes = np.zeros(len(vertical[0]), np.uint64)
    lanes[blocks] = ~over
    return np.flatnonzero(np.unpackbits(lanes.view(np.uint8), bitorder="little")[:n])


def near_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of values differ in at most two bits; the lanes of the planes are the pairs."""
    return within(planes(a ^ b), 0, len(a))


def find(parent: dict[int, int], x: int) -> int:
    while (p := parent.get(x, x)) != x:
        parent[x] = parent.get(p, p)
        x = p
    return x


def bucket_links(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the links within one bucket of distinct values; every link comes at least once."""
    if len(values) <= FLIP_OVER:
        vertical = planes(values)
        for i, x in enumerate(values.tolist()):
            j = within(vertical, x, len(values))
            j = j[j > i]
            yield np.full(len(j), i), j
        return
    order = np.argsort(values)
    ranked = values[order]
    spread = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [np.uint64(1 << k) for k in range(64) if spread >> k & 1]
    for flip in bits + [x | y for x, y in combinations(bits, 2)]:
        other = ranked ^ flip
        at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
        hit = np.flatnonzero((ranked[at] == other) & (ranked < other))
        yield order[hit], order[at[hit]]


def links(distinct: DataFrame) -> DataFrame:
    """Rows (a, b): a spanning forest of the links among distinct fingerprints in column fp, bucket by bucket.

    A bucket's values agree but for two bands, so that it has 2^22 of them at most, whatever the size of the input.
    """
    small_batches(distinct.sparkSession)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks())]))
    placed = distinct.select("fp", keys.alias("x")).select("x.t", "x.k", "fp").repartition("t", "k").sortWithinPartitions("t", "k", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole buckets."""
            cut = np.flatnonzero((np.diff(part[0]) != 0) | (np.diff(part[1]) != 0)) + 1
            begin, end = np.append(0, cut), np.append(cut, part.shape[1])
            size = end - begin
            fp = part[2].view(np.uint64)
            parent: dict[int, int] = {}
            out: list[tuple[int, int]] = []

            def link(a: np.ndarray, b: np.ndarray, scope: dict[int, int]) -> None:
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    x, y = find(scope, x), find(scope, y)
                    if x != y:
                        scope[max(x, y)] = min(x, y)
                        out.append((x, y))

            small = np.flatnonzero((size > 1) & (size <= 16))
            room = np.zeros(part.shape[1], np.int64)
            room[np.concatenate([np.arange(b, e) for b, e in zip(begin[small], end[small], strict=True)]) if len(small) else []] = np.repeat(end[small], size[small])
            for d in range(1, 16):
                i = np.flatnonzero(room > np.arange(part.shape[1]) + d)
                if not len(i):
                    break
                near = i[near_pairs(fp[i], fp[i + d])]
                link(near, near + d, parent)
            for b, e in zip(begin[size > 16].tolist(), end[size > 16].tolist(), strict=True):
                for x, y in bucket_links(fp[b:e]):
                    link(x + b, y + b, parent)
            if out:
                a, b = np.array(out).T
                yield pa.RecordBatch.from_arrays([pa.array(part[2][a]), pa.array(part[2][b])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]))
            if held[0][1, 0] == held[-1][1, -1] and held[0][0, 0] == held[-1][0, -1]:
                continue
            part = np.concatenate(held, axis=1)
            last = np.flatnonzero((part[0] != part[0, -1]) | (part[1] != part[1, -1]))[-1] + 1
            yield from work(part[:, :last])
            held = [part[:, last:]]
        if held:
            yield from work(np.concatenate(held, axis=1))

    return placed.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b): root is the least node of its component.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for turn in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # What joins with the edges is written first, so that adaptive execution can split a hub's edges.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"least-{turn}")
        large = written(both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"large-{turn}")
        own = written(large.groupBy("a").agg(F.min("b").alias("m")), f"own-{turn}")
        small = large.join(own.hint("merge"), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, written(small, f"links-{turn}")
        dropped(before, least, large, own)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, fp, component_id), one for each row of df.

    component_id: the least id reachable by links between fingerprints at most RADIUS bits apart, itself included; null
    where no row of the component has an id. Texts without words share fingerprint zero. Repeated rows come as
    often as they do in df; an empty table gives an empty one.
    """
    rows = written(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(distinct.select("fp")))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, "roots")
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


@dataclass(frozen=True)
class Similar:
    """Documents are linked whose sets of shingles of `words` words have a Jaccard similarity of at least `jaccard`.

    bands, rows: MinHash values, of which a candidate pair shares all rows of a band. With these a pair at 0.8 is no candidate
    with probability (1 - 0.8^5)^48 = 5e-9, and a closer one with less.
    whole, block: shingles of a group that one task compares, and of each block of a larger group.
    """

    words: int = 5
    jaccard: float = 0.8
    bands: int = 48
    rows: int = 5
    whole: int = 2_000_000
    block: int = 1_000_000


@cache
def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    flip, times = np.random.default_rng(10).integers(0, 2**64 - 1, (2, n, 1), np.uint64, True)
    return flip, times | np.uint64(1)


def band_hashes(found: np.ndarray, rule: Similar, step: int = 1 << 12) -> np.ndarray:
    """A number for each band, from the least of each of bands x rows hashes of the set."""
    flip, times = seeds(rule.bands * rule.rows)
    least = np.full(rule.bands * rule.rows, 2**64 - 1, np.uint64)
    for i in range(0, len(found), step):
        x = found[i : i + step] ^ flip
        x *= times
        np.minimum(least, x.min(axis=1), out=least)
    data = least.reshape(rule.bands, rule.rows)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(data)], np.uint64)


def sketches(df: DataFrame, rule: Similar, id_col: str, text_col: str) -> DataFrame:
    """Rows (id_col, text_key, node, size, fp, bands), one for each row of df. node: 16 bytes that name the set of shingles, size: how many, fp: its fingerprint."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, fp, bands = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = np.unique(shingles(text, rule.words))
                size.append(len(found))
                node.append(xxhash.xxh128_digest(found.tobytes()))
                fp.append(simhash(found))
                bands.append(band_hashes(found, rule).view(np.int64) if len(found) else [])
            prints = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(size, pa.int64()), prints, pa.array(bands, pa.list_(pa.int64()))], [id_col, "text_key", "node", "size", "fp", "bands"])
        give_back()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), key_of(normalised(text_col)).alias("text_key"), text.alias("text")).mapInArrow(run, f"`{id_col}` {kind}, text_key binary, node binary, size long, fp long, bands array<long>")


def linked(sets: list[np.ndarray], jaccard: float) -> np.ndarray:
    """For each set the index of the first one in its component; links are the pairs at least so similar.

    Each set reached is compared with all that aren't reached yet, so that a group of near copies takes a few passes.
    """
    size = np.array([len(x) for x in sets])
    tokens, number = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.append(0, np.cumsum(size))
    first, left = np.full(len(sets), -1), np.arange(len(sets))
    seen = np.zeros(len(tokens), bool)
    while len(left):
        root, reached = int(left[0]), [int(left[0])]
        left = left[1:]
        first[root] = root
        pool, at = (np.concatenate([number[begin[i] : begin[i + 1]] for i in left]), np.append(0, np.cumsum(size[left]))[:-1]) if len(left) else (number[:0], left)
        while reached and len(left):
            i = reached.pop()
            own = number[begin[i] : begin[i + 1]]
            seen[own] = True
            both = np.add.reduceat(seen[pool], at, dtype=np.int64)
            seen[own] = False
            near = both >= jaccard * (size[i] + size[left] - both) - 1e-9
            if near.any():
                first[left[near]] = root
                reached += left[near].tolist()
                pool, left = pool[np.repeat(~near, size[left])], left[~near]
                at = np.append(0, np.cumsum(size[left]))[:-1]
    return first


def compared(groups: DataFrame, keys: list[str], rule: Similar) -> DataFrame:
    """Rows (node, lead): for each set of each group the first one that it is linked with, through sets of the group.

    groups: (*keys, node, text). A group's sets are in memory together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(nodes: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([nodes[i] for i in linked(sets, rule.jaccard).tolist()], pa.binary())], ["node", "lead"])

        now, nodes, sets = None, [], []
        for batch in batches:
            for *group, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != now and nodes:
                    yield work(nodes, sets)
                    nodes, sets = [], []
                now = group
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    sets.append(np.unique(shingles(text, rule.words)))
        if nodes:
            yield work(nodes, sets)
        del nodes, sets
        give_back()

    return groups.select(*keys, "node", "text").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "node binary, lead binary")


def near_pivot(held: DataFrame, rule: Similar) -> DataFrame:
    """held (root, pivot, node, text, ...) with `near`: whether a row is linked with the pivot of its group, itself included.

    The pivots are joined to their groups, so that adaptive execution can split a large group's rows over many tasks.
    """
    pivots = held.where("node = pivot").select("root", F.col("text").alias("pivot_text")).dropDuplicates(["root"])
    names = held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            near = []
            for root, pivot_text, text in zip(*(batch.column(c).to_pylist() for c in ("root", "pivot_text", "text")), strict=True):
                if root != now:
                    now, own = root, np.unique(shingles(pivot_text, rule.words))
                found = np.unique(shingles(text, rule.words))
                both = len(np.intersect1d(own, found, assume_unique=True))
                near.append(both >= rule.jaccard * (len(own) + len(found) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(near, pa.bool_())], [*names, "near"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return held.join(written(pivots, "pivots").hint("merge"), "root").mapInArrow(run, f"{schema}, near boolean")


def large_links(held: DataFrame, rule: Similar) -> DataFrame:
    """Rows (a, b) that connect what is linked within groups too large for one task. held: (root, pivot, node, size, text).

    One pass compares a group with its pivot. What is linked with it, the core, is connected already. The rest falls into
    blocks, and each pair of blocks of which one at least is of the rest is compared in a task of its own: no task holds
    more than two blocks, and a group of close copies has hardly any rest.
    """
    held = written(near_pivot(held, rule), "pivoted", "zstd")
    part = lambda where: F.ceil(F.sum(F.when(where, F.col("size")).otherwise(0)) / rule.block).cast("long")
    counts = written(held.groupBy("root").agg(part(~F.col("near")).alias("rest"), part(F.col("near")).alias("core")), "blocks")
    rows = held.join(counts.hint("merge"), "root").where("rest > 0")
    own = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.lit(1).cast("long"), n))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    rest, core = F.col("rest"), F.col("core")
    mine = F.concat(F.transform(upto(rest), lambda k: cell("rest", F.least(own(rest), k), F.greatest(own(rest), k))), F.transform(upto(core), lambda k: cell("core", own(rest), k)))
    cells = F.when(F.col("near"), F.transform(upto(rest), lambda k: cell("core", k, own(core)))).otherwise(mine)
    spread = rows.select("root", F.explode(cells).alias("x"), "node", "text").select("root", "x.*", "node", "text")
    found = compared(spread, ["root", "kind", "i", "j"], rule).where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return found.unionByName(held.where("near and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))


def print_links(rows: DataFrame) -> DataFrame:
    """Rows (a, b): nodes that connect all sets whose fingerprints are linked. rows: (node, size, fp); sets without shingles have no part in it."""
    held = written(rows.where("size > 0").groupBy("node").agg(F.first("fp").alias("fp")), "prints")
    heads = written(held.groupBy("fp").agg(F.min("node").alias("b")), "heads")
    same = held.join(heads.hint("merge"), "fp").where("node <> b").select(F.col("node").alias("a"), "b")
    head = lambda name: heads.select(F.col("fp").alias(name), F.col("b").alias(f"{name}_node"))
    near = links(heads.select("fp")).join(head("a"), "a").join(head("b"), "b")
    return same.unionByName(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def similar_classes(df: DataFrame, rule: Similar = Similar(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, text_key, component_id), one for each row of df: the least id reachable by links, as in near_classes.

    Candidates, sets whose fingerprints are linked or that share a band, form groups that are much the same as the components themselves. A group's sets are compared in one task
    if they hold up to rule.whole shingles, and by blocks in many tasks beyond that; either way the texts of those groups
    alone are read anew. Texts without words are one component.
    """
    rows = written(sketches(df, rule, id_col, text_col), "sketches")
    placed = rows.select("node", F.explode("bands").alias("band"))
    # Equal sets need no comparing; written, so that adaptive execution can split a hot band's rows.
    shared = written(placed.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("band", "b"), "bands")
    banded = placed.join(shared.hint("merge"), "band").select(F.col("node").alias("a"), "b")
    groups = written(components(print_links(rows).unionByName(banded)), "candidates")
    chosen = written(rows.groupBy("node").agg(F.min(F.struct(F.col(id_col).alias("id"), "text_key")).alias("x"), F.first("size").alias("size")).join(groups, "node").select("node", "root", "size", F.col("x.id").alias("id"), F.col("x.text_key").alias("key")), "chosen")
    totals = written(chosen.groupBy("root").agg(F.sum("size").alias("total"), F.min("node").alias("pivot")), "totals")
    texts = df.select(F.col(id_col).alias("own"), key_of(normalised(text_col)).alias("own_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def held(where: str) -> DataFrame:
        some = chosen.join(totals.where(where).hint("merge"), "root")
        return texts.join(some, texts["own"].eqNullSafe(some["id"]) & (texts["own_key"] == some["key"])).select("root", "pivot", "node", "size", "text")

    leads = written(compared(held(f"total <= {rule.whole}"), ["root"], rule), "leads")
    if not totals.where(f"total > {rule.whole}").isEmpty():
        # A set may have several rows, of which one will do.
        links_ = large_links(held(f"total > {rule.whole}").dropDuplicates(["node"]), rule)
        leads = leads.unionByName(written(components(links_).select("node", F.col("root").alias("lead")), "leads-large"))
    distinct = rows.groupBy("node").agg(F.min(id_col).alias("least")).join(leads, "node", "left").select("node", "least", F.coalesce("lead", "node").alias("lead"))
    distinct = written(distinct, "roots")
    named = distinct.join(distinct.groupBy("lead").agg(F.min("least").alias("component_id")), "lead").select("node", "component_id")
    return rows.select(id_col, "text_key", "node").join(named, "node").select(id_col, "text_key", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: Similar | None = None) -> DataFrame:
    """docs without the rows whose component has a row with a smaller id. Rows without an id stay if their component has none.

    Links are those of near_classes, or with `similar` those of similar_classes.
    """
    late = F.col("component_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("component_id")) & F.col(id_col).isNotNull()
    if similar:
        gone = similar_classes(docs, similar, id_col, text_col).where(late).select(F.col(id_col).alias("gone"), F.col("text_key").alias("gone_key")).distinct().hint("merge")
        return docs.join(gone, (docs[id_col] == gone["gone"]) & (key_of(normalised(text_col)) == gone["gone_key"]), "left_anti")
    gone = near_classes(docs, id_col, text_col).where(late).select(F.col(id_col).alias("gone")).distinct().hint("merge")
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")


def op10_simhash_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
