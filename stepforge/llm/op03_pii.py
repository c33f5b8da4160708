"""Personal data, and the terms that give it away.

Patterns find emails, IP addresses, card and phone numbers: the protected entities. A term near an entity's mention
discloses it by their pointwise mutual information over the corpus, as a share of the entity's information content.
Terms above one threshold are generalised, above a higher one removed, in the places where they stand near the entity.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, table, written

#: The kinds of entity, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


@dataclass(frozen=True)
class Disclosure:
    """window: words to either side of a mention. support: documents that must hold term and entity together."""

    window: int = 8
    support: int = 2
    generalise: float = 0.85
    remove: float = 0.97
    #: With more candidate terms than this, their document counts come from a join, not from a broadcast set.
    broadcast_terms: int = 100_000


def luhn(digits: str) -> bool:
    rest = digits[::-1]
    return (sum(map(int, rest[::2])) + sum(sum(divmod(2 * int(x), 10)) for x in rest[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the entities, by start, then kind; each kind leftmost and without overlaps.

    Time is linear in the text: a look-behind or a search from the sign that a match must hold takes the place of
    trying each start.
    """
    out = []
    if "@" in text:
        past = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > past and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                past = m.end()
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def entity_of(text: str, span: tuple[int, int, int]) -> str:
    start, kind, end = span
    return f"{KINDS[kind]}:{text[start:end].lower()}"


def near_terms(text: str, spans: list[tuple[int, int, int]], window: int) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms within a window of each mention, without those inside any entity."""
    terms = [m.span() for m in TERM.finditer(text)]
    starts, ends = [s for s, _ in terms], [e for _, e in terms]
    # Spans by start, with the furthest end so far: what begins before a term's end overlaps it if one of these ends after its start.
    begins, reach = [s for s, _, _ in spans], [*accumulate((e for _, _, e in spans), max)]

    def inside(s: int, e: int) -> bool:
        k = bisect_left(begins, e)
        return k > 0 and reach[k - 1] > s

    out = []
    for start, kind, end in spans:
        entity = entity_of(text, (start, kind, end))
        # A run of letters that goes on into the mention counts without what the mention holds, if that leaves three.
        i, j = bisect_left(starts, start), bisect_right(ends, end)
        left = [(s, min(e, start)) for s, e in terms[max(0, i - window - 1) : i]]
        right = [(max(s, end), e) for s, e in terms[j : j + window + 1]]
        before, after = ([(text[s:e].lower(), s, e) for s, e in x if e - s >= 3] for x in (left, right))
        before, after = before[-window:], after[:window]
        out += [(entity, *x) for x in before + after if not inside(x[1], x[2])]
    return out


MENTION = "array<struct<entity:string,term:string,start:long,stop:long>>"
SPAN = "array<struct<start:long,kind:int,stop:long>>"


def find_entities(df: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, text_key, spans, near, entities): base spans, the terms near them, and each entity once. Null texts are empty.

    text_key: 16 bytes of the text's SHA-256, the same for equal texts.
    """
    small_batches(df.sparkSession)
    kinds = [pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])), pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, near, entities = [], [], []
            for text in batch.column(2).to_pylist():
                found = base_spans(text)
                entities.append([*dict.fromkeys(entity_of(text, x) for x in found)])
                spans.append([{"start": s, "kind": k, "stop": e} for s, k, e in found])
                near.append([dict(zip(("entity", "term", "start", "stop"), x, strict=True)) for x in near_terms(text, found, rule.window)] if found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kinds[0]), pa.array(near, kinds[1]), pa.array(entities, pa.list_(pa.string()))], [id_col, "text_key", "spans", "near", "entities"])
        give_back()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), key_of(text).alias("text_key"), text.alias("text")).mapInArrow(run, f"`{id_col}` {kind}, text_key binary, spans {SPAN}, near {MENTION}, entities array<string>")


def key_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def term_counts(df: DataFrame, terms: DataFrame, rule: Disclosure, text_col: str) -> DataFrame:
    """Rows (term, n_term): in how many rows of df each candidate term occurs."""
    some = [r[0] for r in terms.limit(rule.broadcast_terms + 1).collect()]
    if len(some) <= rule.broadcast_terms:
        wanted = frozenset(some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist() if wanted else ():
                    n.update(wanted.intersection(TERM.findall((text or "").lower())))
            yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], ["term", "n"])

        counted = df.select(text_col).mapInArrow(run, "term string, n long")
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    n.update({*TERM.findall((text or "").lower())})
                yield pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64())], ["term", "n"])

        counted = df.select(text_col).mapInArrow(run, "term string, n long").join(terms, "term", "left_semi")
    return counted.groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosures(df: DataFrame, found: DataFrame, rule: Disclosure = Disclosure(), text_col: str = "text") -> DataFrame:
    """Rows (entity, term, share): the pairs in which the term gives away at least `generalise` of the entity.

    share = PMI(term; entity) / IC(entity), from counts of documents over the whole corpus: an entity or a term counts
    once for each row that holds it, a pair once for each row that holds the term in a window of the entity.
    """
    size = found.agg(F.count(F.lit(1)).alias("n_rows"))
    mentions = found.where(F.size("near") > 0).select(F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(x["entity"].alias("entity"), x["term"].alias("term"))))).alias("x"))
    pairs = mentions.groupBy("x.entity", "x.term").agg(F.count(F.lit(1)).alias("n_pair")).where(F.col("n_pair") >= rule.support)
    entities = found.where(F.size("entities") > 0).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = written(pairs.join(entities, "entity"), "pii-pairs")
    counts = term_counts(df, pairs.select("term").distinct(), rule, text_col)
    n = F.col("n_rows")
    # PMI = ln(n p / (t e)) and IC = ln(n / e); an entity in every row has no information to lose.
    share = F.when(n > F.col("n_entity"), F.ln(n * F.col("n_pair") / (F.col("n_term") * F.col("n_entity"))) / F.ln(n / F.col("n_entity")))
    return pairs.join(counts, "term").crossJoin(F.broadcast(size)).select("entity", "term", share.alias("share")).where(F.col("share") >= rule.generalise)


def all_spans(df: DataFrame, rule: Disclosure = Disclosure(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, text_key, spans, removed): base spans and disclosing terms (kind 4) by start, then kind.

    removed: the spans of the terms to be removed. Rows with null or empty texts have no spans; repeated rows have the
    same ones; an empty table gives an empty one.
    """
    found = written(find_entities(df, rule, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    told = disclosures(df, found, rule, text_col)
    near = found.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    terms = near.join(told, ["entity", "term"]).groupBy("row", "start", "stop").agg(F.max("share").alias("share"))
    # A row has as many of these as words near its own entities.
    terms = terms.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "stop", "share")).alias("terms"))
    bare = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))
    added = F.when(F.col("terms").isNotNull(), F.transform("terms", bare)).otherwise(F.array().cast(SPAN))
    removed = F.when(F.col("terms").isNotNull(), F.transform(F.filter("terms", lambda x: x["share"] >= rule.remove), bare)).otherwise(F.array().cast(SPAN))
    return found.join(terms, "row", "left").select(id_col, "text_key", F.array_sort(F.concat("spans", added)).alias("spans"), removed.alias("removed"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with text_col sanitised: entities become [EMAIL], [IP], [CARD] or [PHONE], disclosing terms [TERM] or nothing.

    Where spans overlap, the one that starts first names the replacement of their union. Other columns stay.
    """
    small_batches(docs.sparkSession)
    spans = all_spans(docs, rule, id_col, text_col).where(F.size("spans") > 0).groupBy("text_key").agg(F.first("spans").alias("spans"), F.first("removed").alias("removed"))
    # Written, so that the join has a shuffle on either side and adaptive execution can split a hot text's rows.
    spans = written(spans, "pii-spans").hint("merge")
    key = key_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    names = docs.columns
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("text_key")).join(spans, "text_key", "left")

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found, gone in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                drop, out, at = {(x["start"], x["stop"]) for x in gone or ()}, [], 0
                for x in found or ():
                    if x["start"] >= at:
                        out += [text[at : x["start"]], "" if x["kind"] == 4 and (x["start"], x["stop"]) in drop else f"[{KINDS[x['kind']].upper()}]"]
                    at = max(at, x["stop"])
                texts.append(text if not found else "".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(3)], ["text", "row"])

    done = joined.select(F.col("row")[text_col].alias("text"), "spans", "removed", "row").mapInArrow(swap, f"text string, row {joined.schema['row'].dataType.simpleString()}")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["stop"])), ",")


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each kind, and the spans of every document."""
    spans = all_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return spans.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
