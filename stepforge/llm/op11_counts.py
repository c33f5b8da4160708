"""Token counts through a cache of digests.

A text's key is the digest of its normalised content and that of the tokenizer's version. Keys are joined to
stored counts; of the texts whose key has none, one for each key is encoded, and the counts are appended.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path
from .common import give_back, small_batches, table, written

#: Keys that every task may be sent, so that the texts of others needn't be shuffled (32 MB); beyond it they are joined.
SENT = 1_000_000
#: Characters that are encoded at once: the library holds about 120 bytes a token.
AT_ONCE = 1 << 19
#: Parts of texts whose counts a task remembers, besides those of a batch; then it begins anew.
REMEMBERED = 500_000
CACHED = "content binary, n_tokens long"
#: The normaliser and splitter of a vocabulary that takes no notice of ASCII letters' case or of how much white space there is.
CASELESS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
DROPPED = {"behavior": "Removed", "invert": True}


@dataclass(frozen=True)
class Tokens:
    """A tokenizer that counts. kind: `json` for the tokenizers library, `model` for sentencepiece; data: the file's bytes."""

    kind: str
    data: bytes

    @classmethod
    def read(cls, path: str) -> Tokens:
        with open(path, "rb") as f:
            return cls("model" if path.endswith(".model") else "json", f.read())

    @cached_property
    def special(self) -> list[str] | None:
        """The special strings of a vocabulary of the caseless kind; None for any other."""
        if self.kind != "json":
            return None
        spec = json.loads(self.data)
        normaliser, splitter = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
        first = (splitter.get("pretokenizers") or [{}])[0]
        plain = not any(x["normalized"] or x["single_word"] or set(x["content"]) & set(" \t\n\v\f\r") for x in spec["added_tokens"])
        same = normaliser.get("normalizers") == CASELESS and first.get("type") == "Split" and DROPPED.items() <= first.items() and "[^\\s" in first["pattern"]["Regex"]
        return [x["content"] for x in spec["added_tokens"]] if same and plain and not spec["post_processor"] else None

    def normal(self, text: Column) -> Column:
        """A column such that texts with equal values have equal counts.

        Of a caseless vocabulary: ASCII texts in lower case, with single spaces. Others stay, since letters with marks may
        compose in one case only; so do texts in which a special string stands or lower case would make one.
        """
        if (special := self.special) is None:
            return text
        low = F.lower(text)
        plain = F.octet_length(text) == F.char_length(text)
        for x in special:
            plain &= ~F.contains(low, F.lit(x.lower()))
        return F.when(plain, F.trim(F.regexp_replace(low, "[\\x20\\x09-\\x0D]+", " "))).otherwise(text)

    @property
    def version(self) -> str:
        """A digest of all that a count depends on: the file, the library and the normalisation."""
        import sentencepiece
        import tokenizers

        library = {"json": tokenizers.__version__, "model": sentencepiece.__version__}[self.kind]
        return hashlib.sha256(f"1 {self.kind} {library} {self.special} ".encode() + self.data).hexdigest()

    def library(self) -> Callable[[list[str]], list[int]]:
        """Counts of texts, without special tokens added, truncation or padding."""
        if self.kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has a core; threads would only wait for each other
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(self.data.decode())
        coder.no_truncation()
        coder.no_padding()
        return lambda texts: [len(x) for x in coder.encode_batch_fast(texts, add_special_tokens=False)]

    def counter(self) -> Callable[[list[str]], list[int]]:
        """Counts of texts. Of a caseless vocabulary, a text's count is the sum of what ASCII white space parts, since no token spans it.

        The library then sees each such part once while it is remembered; of other vocabularies, whole texts, AT_ONCE characters together.
        """
        library = self.library()

        def whole(texts: list[str]) -> list[int]:
            out, first, size = [], 0, 0
            for i, text in enumerate(texts, 1):
                size += len(text)
                if size >= AT_ONCE or i == len(texts):
                    out += library(texts[first:i])
                    first, size = i, 0
            return out

        known: dict[bytes, int] = {}

        def by_parts(texts: list[str]) -> list[int]:
            if len(known) > REMEMBERED:
                known.clear()
            parts = [x.encode().split() for x in texts]
            new = list(set().union(*parts).difference(known))
            known.update(zip(new, whole([x.decode() for x in new]), strict=True))
            return [sum(map(known.__getitem__, x)) for x in parts]

        return whole if self.special is None else by_parts


class Cache:
    """Stored counts: a folder for each append under path/version. One that wasn't written to its end isn't read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def folders(self, version: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{version}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        every = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(x.toString() for x in every if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def stored(self, version: str) -> DataFrame | None:
        """Rows (content, n_tokens), each key once, though writers at one time may have stored it twice."""
        found = self.folders(version)
        if not found:
            return None
        out = self.spark.read.schema(CACHED).parquet(*found)
        return out if len(found) == 1 else out.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, version: str, counts: DataFrame) -> None:
        counts.write.option("compression", "zstd").parquet(f"{self.path}/{version}/{uuid.uuid4().hex}")

    def compact(self, version: str) -> None:
        """All appends of a version as one; what was read before goes only after it is written."""
        if len(old := self.folders(version)) > 1:
            self.append(version, self.stored(version))
            for x in old:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(x)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def encoded_counts(texts: DataFrame, tokens: Tokens) -> DataFrame:
    """Rows (content, n_tokens) of rows (content, text), each text encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens.counter()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])
        give_back()

    return texts.select("content", "text").mapInArrow(run, CACHED)


def count_tokens(docs: DataFrame, tokens: Tokens, cache: Cache | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens), one for each row of docs, repeated rows and null ids too.

    cache: where counts are stored and looked up; without one, a new one that ends with the session's intermediates. Null
    texts are empty, with 0 tokens. A text of any length is encoded whole. Equal keys meet before the shuffle, so that copies, however many, cost a key. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache, version = cache or Cache(spark, new_path(spark, "token-cache")), tokens.version
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"n_bytes": F.octet_length("text").cast("long"), "content": F.unhex(F.sha2(tokens.normal(F.col("text")).cast("binary"), 256))})
    rows = written(keyed.drop("text"), "token-keys", "zstd")
    texts, have = keyed.select("content", "text"), cache.stored(version)
    if have is not None:
        misses = written(rows.select("content").distinct().join(have, "content", "left_anti"), "token-misses", "zstd")
        n = misses.count()
        texts = texts.join(F.broadcast(misses) if n <= SENT else misses, "content", "left_semi") if n else None
    if texts is not None:
        cache.append(version, encoded_counts(texts.dropDuplicates(["content"]), tokens))
    return rows.join(cache.stored(version), "content", "left").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def op11_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, cache: str | None = None) -> DataFrame:
    """Tokens of every document, and whether they are more than 2048. cache: a folder whose counts are used and added to."""
    import public_tokenizers

    tokens = Tokens.read(path or public_tokenizers.path("word_bpe_49k.json"))
    out = count_tokens(table(spark, sf_dir, "documents"), tokens, Cache(spark, cache) if cache else None)
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)
