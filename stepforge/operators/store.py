"""The run store: Parquet parts and a log of commits.

A commit names the parts that make up every table, under the next number; the rename that publishes it fails if another
writer has taken that number. Nothing that a commit names is changed in place, and whatever an operation does to several tables
is one commit, so that a crash anywhere leaves the store as it was before or as it is afterwards.

Parts that a commit no longer names are listed in it as gone, with the time; they stay on disk for a while, so that a DataFrame
opened before goes on reading what it named. What a redaction replaces is erased with its commit, or by the next one after a crash.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import part_index, search

SCHEMA_VERSION = 3
TABLES = ("runs", "steps")
#: Hours that a part stays on disk after the last commit that names it, for readers, and that one may lie unnamed before it counts as the rest of a crash.
GRACE = 24


def not_stored(candidates: DataFrame, stored: DataFrame, key: str = "run_id") -> DataFrame:
    return candidates.join(stored.select(key), key, "left_anti")


def split_older(runs: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): pruned was ingested before the cutoff; a run without a time is kept."""
    old = F.coalesce(F.col("ingested_at").cast("timestamp") < F.lit(cutoff).cast("timestamp"), F.lit(False))
    return runs.where(~old), runs.where(old)


def named(tables: dict) -> set[str]:
    """The parts of all tables."""
    return {p["path"] for t in tables.values() for p in t["parts"]}


class Conflict(Exception):
    """Another writer has committed first."""


class Store:
    """runs and steps under one path. A part is {path, first, last}: a folder, and the times of ingest it spans."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.fs_path(self.path).getFileSystem(self.conf)
        self.migrate()

    def migrate(self) -> None:
        """Stamp a new store; take over one of version 1, whose tables were plain folders, or 2, whose log named tables alone; refuse a later one."""
        marker = f"{self.path}/_schema_version"
        found = None
        if self.fs.exists(self.fs_path(marker)):
            found = json.loads("".join(r[0] for r in self.spark.read.text(marker).collect()))["version"]
            if found > SCHEMA_VERSION:
                raise ValueError(f"the store has schema version {found}; this code knows {SCHEMA_VERSION}")
        if found == SCHEMA_VERSION:
            return
        if found == 1:
            old = [n for n in TABLES if self.fs.exists(self.fs_path(f"{self.path}/{n}"))]
            self.update(lambda tables: {n: self.entry(n, [n], self.spark.read.parquet(f"{self.path}/{n}").drop("day").schema) for n in old} or tables)
        self.spark.createDataFrame([(json.dumps({"version": SCHEMA_VERSION}),)], "value string").coalesce(1).write.mode("overwrite").text(marker)

    # ---- commits

    def state(self) -> tuple[int, dict]:
        """(number of the last commit, what it says): tables, each {schema, parts}; gone, parts no longer named; batches, the last of each stream."""
        folder = self.fs_path(f"{self.path}/_log")
        names = [x.getPath().getName() for x in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        last = max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)
        if not last:
            return 0, {"tables": {}, "gone": [], "batches": {}}
        said = json.loads(self.spark.read.option("wholetext", "true").text(f"{self.path}/_log/{last:010d}.json").first()[0])
        return last, said if "tables" in said else {"tables": said, "gone": [], "batches": {}}

    def read(self) -> tuple[int, dict]:
        last, said = self.state()
        return last, said["tables"]

    def commit(self, number: int, said: dict) -> None:
        temp, at = self.fs_path(f"{self.path}/_log/_{uuid.uuid4().hex}"), self.fs_path(f"{self.path}/_log/{number:010d}.json")
        out = self.fs.create(temp)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        jvm = self.spark._jvm
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        no_overwrite[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.conf).rename(temp, at, no_overwrite)
        except Exception as e:
            self.fs.delete(temp, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(str(number)) from e
            raise

    def update(self, change: Callable[[dict], dict], erase: bool = False, batch: tuple[str, int] | None = None) -> bool:
        """Commit what change() makes of the tables, again from the newest ones as often as others come first.

        What is named no more is listed as gone; with erase it goes at once. batch: a stream and the number of its trigger, recorded with the
        commit; one that the stream has stored already, or a later one, is left out, and then this is False.
        """
        while True:
            last, said = self.state()
            if batch and said["batches"].get(batch[0], -1) >= batch[1]:
                return False
            tables = {**said["tables"], **change(said["tables"])}
            lost = named(said["tables"]) - named(tables)
            now = int(time.time() * 1000)
            gone = [x for x in said["gone"] if self.fs.exists(self.fs_path(f"{self.path}/{x['path']}"))] + [{"path": p, "at": now, "erase": erase} for p in sorted(lost)]
            try:
                self.commit(last + 1, {"tables": tables, "gone": gone, "batches": {**said["batches"], **(dict([batch]) if batch else {})}})
            except Conflict:
                time.sleep(0.05)
                continue
            self.erase([x["path"] for x in gone if x["erase"]])
            return True

    # ---- parts

    def frame(self, schema: T.StructType, parts: list[dict]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p['path']}" for p in parts])

    def entry(self, name: str, paths: list[str], schema: T.StructType, tables: dict | None = None, without: tuple[str, ...] = ()) -> dict:
        """A table with further parts, but without some of those it had; its schema has the columns of both."""
        parts = [p for p in (tables or {}).get(name, {}).get("parts", []) if p["path"] not in without]
        for path in paths:
            low, high = self.spark.read.schema("ingested_at timestamp").parquet(f"{self.path}/{path}").agg(F.min("ingested_at").cast("string"), F.max("ingested_at").cast("string")).first()
            parts.append({"path": path, "first": low, "last": high})
        old = T.StructType.fromJson(tables[name]["schema"]) if tables and name in tables else T.StructType()
        known = {f.name for f in old}
        return {"schema": T.StructType([*old, *(f for f in schema if f.name not in known)]).jsonValue(), "parts": parts}

    def written(self, name: str, df: DataFrame, by_day: bool = False) -> list[str]:
        """Folders of a new part, or of one for each day."""
        path = f"data/{uuid.uuid4().hex}/{name}"
        if not by_day:
            df.write.parquet(f"{self.path}/{path}")
            return [path]
        day = F.coalesce(F.to_date("ingested_at"), F.lit("1970-01-01").cast("date"))
        df.withColumn("day", day).hint("rebalance", "day").write.partitionBy("day").parquet(f"{self.path}/{path}")
        return [f"{path}/{x.getPath().getName()}" for x in self.fs.listStatus(self.fs_path(f"{self.path}/{path}")) if x.isDirectory()]

    def erase(self, paths: list[str]) -> None:
        for p in paths:
            self.fs.delete(self.fs_path(f"{self.path}/{p}"), True)

    def undo(self, made: dict[str, list[str]]) -> None:
        """Erase what was written for a commit that didn't come about."""
        self.erase(sorted({p for paths in made.values() for p in paths} - named(self.read()[1])))

    def table(self, name: str) -> DataFrame | None:
        tables = self.read()[1]
        return self.frame(T.StructType.fromJson(tables[name]["schema"]), tables[name]["parts"]) if name in tables else None

    # ---- operations

    def save(self, runs: DataFrame, steps: DataFrame, ingested_at: str, batch: tuple[str, int] | None = None) -> bool:
        """Insert only: an id that is stored already, or twice in runs, is an error, and then nothing is stored.

        Runs and steps appear together. Ids are looked up in the very state that the commit builds on. batch: a stream and its trigger's
        number; a trigger that is replayed after its commit stores nothing, isn't an error, and gives False.
        """
        stamp = F.lit(ingested_at).cast("timestamp")
        frames = {"steps": steps.withColumn("ingested_at", stamp), "runs": runs.withColumn("ingested_at", stamp)}
        made = {name: self.written(name, df) for name, df in frames.items()}
        own = self.spark.read.schema(frames["runs"].schema).parquet(f"{self.path}/{made['runs'][0]}").select("run_id")

        def add(tables: dict) -> dict:
            hit = own.groupBy("run_id").count().where("count > 1").select("run_id")
            if "runs" in tables:
                hit = hit.unionByName(own.join(self.frame(T.StructType.fromJson(tables["runs"]["schema"]), tables["runs"]["parts"]).select("run_id"), "run_id", "left_semi"))
            if (found := hit.first()) is not None:
                raise ValueError(f"run {found[0]} is stored already")
            return {name: self.entry(name, paths, frames[name].schema, tables) for name, paths in made.items()}

        try:
            return self.update(add, batch=batch)
        finally:
            self.undo(made)

    def get(self, run_id: str) -> DataFrame:
        return self.run(run_id)[0]

    def list(self) -> DataFrame:
        return self.table("runs").select("run_id", "name", "started_at", "ended_at", "status", "currency", "ingested_at").orderBy(F.desc("ingested_at"))

    def swap(self, changes: dict[str, tuple[list[dict], DataFrame | None]], by_day: bool = False, erase: bool = False) -> None:
        """In one commit, for each table rows in place of some of its parts. erase: what the old parts held goes from disk with it."""
        made = {name: self.written(name, fresh, by_day) if fresh is not None else [] for name, (_, fresh) in changes.items()}

        def change(tables: dict) -> dict:
            out = {}
            for name, (old, fresh) in changes.items():
                gone = tuple(p["path"] for p in old)
                if not set(gone) <= {p["path"] for p in tables[name]["parts"]}:
                    raise RuntimeError(f"other writers have replaced parts of {name} meanwhile; run it again")
                out[name] = self.entry(name, made[name], fresh.schema if fresh is not None else T.StructType(), tables, gone)
            return out

        try:
            self.update(change, erase)
        finally:
            self.undo(made)

    def replace(self, fresh: dict[str, DataFrame]) -> None:
        """Put redacted rows in place of the stored ones of their runs, in all these tables at once; only the parts they lie in are rewritten.

        What these held is erased: a reader that opened them before fails rather than show what was redacted.
        """
        tables, changes = self.read()[1], {}
        for name, rows in fresh.items():
            schema, ids = T.StructType.fromJson(tables[name]["schema"]), rows.select("run_id").distinct()
            files = [r[0] for r in self.frame(schema, tables[name]["parts"]).select("run_id", F.col("_metadata.file_path").alias("file")).join(ids, "run_id", "left_semi").select(F.regexp_replace("file", "/[^/]*$", "").alias("folder")).distinct().collect()]
            old = [p for p in tables[name]["parts"] if any(f"/{p['path']}" in f for f in files)]
            if not old:
                raise ValueError("no such run")
            part = self.frame(schema, old)
            place = part.join(ids, "run_id", "left_semi").select("run_id", "ingested_at").distinct()
            changes[name] = old, part.join(ids, "run_id", "left_anti").unionByName(rows.drop("ingested_at", "day").join(place, "run_id"), allowMissingColumns=True)
        self.swap(changes, erase=True)

    def prune(self, cutoff: str, erase: bool = False) -> DataFrame:
        """Drop exactly the runs ingested before a time, and their steps, in one commit; returns them, written beside the store as its audit.

        Parts that end before it go whole; only those that it divides are rewritten. Readers that are open read on for the time of grace,
        after which later calls delete the parts; with erase they are deleted now.
        """
        report = f"{self.path}/_pruned/{uuid.uuid4().hex}"
        tables = self.read()[1]
        _, gone = split_older(self.frame(T.StructType.fromJson(tables["runs"]["schema"]), tables["runs"]["parts"]), cutoff)
        gone.select("run_id", "ingested_at").write.parquet(report)
        at = self.spark.range(1).select(F.lit(cutoff).cast("timestamp").cast("string")).first()[0]
        changes = {}
        for name, table in tables.items():
            whole = [p for p in table["parts"] if p["last"] is not None and p["last"] < at]
            some = [p for p in table["parts"] if p not in whole and p["first"] is not None and p["first"] < at]
            if whole or some:
                changes[name] = whole + some, split_older(self.frame(T.StructType.fromJson(table["schema"]), some), cutoff)[0] if some else None
        if changes:
            self.swap(changes, by_day=True, erase=erase)
        self.sweep()
        return self.spark.read.schema("run_id string, ingested_at timestamp").parquet(report)

    def sweep(self, grace_hours: float = GRACE) -> None:
        """Delete parts that have been gone for the time of grace, and those that are to be erased."""
        old = time.time() * 1000 - grace_hours * 3_600_000
        self.erase([x["path"] for x in self.state()[1]["gone"] if x["erase"] or x["at"] <= old])

    def bytes(self) -> int:
        return self.fs.getContentSummary(self.fs_path(self.path)).getLength()

    def vacuum(self, grace_hours: float = GRACE) -> dict[str, int]:
        """Rewrite what isn't a part a day as such, in one commit, and delete commits and parts beyond the time of grace; (before, after, reclaimed) in bytes.

        Readers that are open read on for that time, during which the store holds both.
        """
        before = self.bytes()
        day = lambda p: (p["first"] or "")[:10]
        changes = {}
        for name, table in self.read()[1].items():
            days = [day(p) for p in table["parts"]]
            mixed = {day(p) for p in table["parts"] if day(p) != (p["last"] or "")[:10]}
            if len(set(days)) < len(days) or mixed or any("/" not in p["path"] for p in table["parts"]):
                changes[name] = table["parts"], self.frame(T.StructType.fromJson(table["schema"]), table["parts"])
        if changes:
            self.swap(changes, by_day=True)
        self.sweep(grace_hours)
        last, said = self.state()
        keep = {p.split("/")[1] for p in named(said["tables"]) | {x["path"] for x in said["gone"] if self.fs.exists(self.fs_path(f"{self.path}/{x['path']}"))} if "/" in p}
        old = time.time() * 1000 - grace_hours * 3_600_000
        for folder in self.fs.listStatus(self.fs_path(f"{self.path}/data")) if self.fs.exists(self.fs_path(f"{self.path}/data")) else ():
            if folder.getPath().getName() not in keep and (folder.getModificationTime() <= old or self.fs.getContentSummary(folder.getPath()).getFileCount() == 0):
                self.fs.delete(folder.getPath(), True)
        for x in self.fs.listStatus(self.fs_path(f"{self.path}/_log")) if last else ():
            n = x.getPath().getName()[:-5]
            if n.isdigit() and int(n) < last and x.getModificationTime() <= old:
                self.fs.delete(x.getPath(), False)
        self.index()
        after = self.bytes()
        return {"before": before, "after": after, "reclaimed": max(0, before - after)}

    # ---- lookups

    def index(self, fields: tuple[str, ...] = search.FIELDS) -> int:
        """Make filters of the parts that have none, of run ids in every table and of the texts of steps in these fields; how many parts that were.

        Filters of parts that are gone are left behind when all are written anew, once half of them are.
        """
        tables = self.read()[1]
        have = {r[0] for r in self.stats().select("part").distinct().collect()}
        todo = [(name, p["path"]) for name, t in tables.items() for p in t["parts"] if p["path"] not in have]
        fresh = None
        for name, path in todo:
            rows = self.frame(T.StructType.fromJson(tables[name]["schema"]), [{"path": path}])
            own = part_index.id_filters(rows, path)
            texts = tuple(f for f in fields if f in rows.columns) if name == "steps" else ()
            own = own.unionByName(part_index.text_filters(rows, path, texts)) if texts else own
            fresh = own if fresh is None else fresh.unionByName(own)
        if fresh is not None:
            stale = len(have - named(tables)) * 2 > len(have)
            old = self.stat_folders()
            if stale:
                live = self.spark.createDataFrame([(p,) for p in sorted(named(tables))], "part string")
                fresh = fresh.unionByName(self.stats().join(F.broadcast(live), "part", "left_semi"))
            fresh.coalesce(max(1, len(todo) // 64)).write.parquet(f"{self.path}/_stats/{uuid.uuid4().hex}")
            if stale:
                self.erase([x.removeprefix(self.path + "/") for x in old])
        return len(todo)

    def stat_folders(self) -> list[str]:
        folder = self.fs_path(f"{self.path}/_stats")
        names = [x.getPath().getName() for x in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return [f"{self.path}/_stats/{n}" for n in sorted(names) if self.fs.exists(self.fs_path(f"{self.path}/_stats/{n}/_SUCCESS"))]

    def stats(self) -> DataFrame:
        folders = self.stat_folders()
        return self.spark.read.schema(part_index.FILTERS).parquet(*folders) if folders else self.spark.createDataFrame([], part_index.FILTERS)

    def holding(self, name: str, keys: list[tuple[str, str]]) -> DataFrame:
        """A table's rows from the parts in which some field may have all its keys; keys: (field, key)."""
        table = self.read()[1][name]
        wanted = self.spark.createDataFrame(sorted(set(keys)), "field string, key string")
        out = {r[0] for r in part_index.excluded(self.stats(), wanted).collect()} if keys and self.stat_folders() else set()
        parts = [p for p in table["parts"] if p["path"] not in out]
        schema = T.StructType.fromJson(table["schema"])
        return self.frame(schema, parts) if parts else self.spark.createDataFrame([], schema)

    def run(self, run_id: str) -> tuple[DataFrame, DataFrame]:
        """(runs, steps) of one run, from the parts that may hold it."""
        return tuple(self.holding(name, [("run_id", run_id)]).where(F.col("run_id") == run_id) for name in TABLES)

    def search(self, needle: str, limit: int | None = 50, fields: tuple[str, ...] = search.FIELDS) -> DataFrame:
        """search.search() over the stored steps, from the parts whose texts have every piece of the needle."""
        low = self.spark.range(1).select(F.explode(part_index.grams(F.lit(needle)))).collect()
        return search.search(self.holding("steps", [(f, r[0]) for f in fields for r in low]), needle, limit, fields)

    def audit(self, event: str, detail: dict, at: str) -> None:
        line = json.dumps({"at": at, "event": event, **detail}, sort_keys=True)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/audit")
