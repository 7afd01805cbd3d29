"""Sharding by size-tiered compaction under a versioned manifest.

append() writes arrivals as small immutable Parquet shards. compact() takes the shards of one size tier, packs them into
runs of up to the target size and merges each run in one task into one file; it repeats tier by tier. Each step commits
a new version of the manifest: a JSON file made by exclusive create under the next version's name, so of two writers one
gets a Conflict, and a reader sees one version or the next, never a mixture. A manifest that is not yet whole is no version
for readers, and a conflict for writers; repair() removes the one that a dead writer left. After a conflict append() commits
again on the newest version, and so does compact() if that still names all that it has merged.

Old versions stay readable until vacuum(), which nothing calls by itself, deletes the files that none of the newest `keep`
versions names and that are older than `older_s`, the longest that a writer may take from data to commit. Exclusive create is
atomic in HDFS and in object stores with conditional puts; a local folder is for one writer at a time. The manifest, a name and
a size for each shard, is read by the driver. All file handling goes through Hadoop's file system, in the store of the root folder.

Defined cases: nulls, empty and very long texts, ties and repeated rows are stored as they are; any columns are stored, the
same for all appends; an empty arrival commits a version without shards; a table without shards reads as empty with the
schema of the first append.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder

TARGET = 64 * 2**20
FANOUT = 4
ROWS_A_SHARD = 2_000
#: Runs merged by one Spark job, a task each.
RUNS_A_JOB = 256


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self, folder: str) -> list[dict]:
        return [{"file": str(s.getPath().toString()), "bytes": int(s.getLen())} for s in self.fs.listStatus(self.path(folder)) if s.getPath().getName().endswith(".parquet")]

    def _numbers(self) -> list[int]:
        folder = self.path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), reverse=True)

    def _named(self, version: int):
        return self.path(f"{self.root}/manifest/v{version:012d}.json")

    def _load(self, version: int) -> dict | None:
        """None if it isn't whole."""
        stream = self.fs.open(self._named(version))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        for n in self._numbers() if version is None else [version] if version else []:
            if found := self._load(n):
                return found
        return {"version": 0, "schema": None, "shards": []}

    def version(self) -> int:
        return self.manifest()["version"]

    def commit(self, seen: dict, shards: list[dict], schema: str | None = None) -> dict:
        """The next version after the one seen."""
        made = {"version": seen["version"] + 1, "schema": seen["schema"] or schema, "shards": sorted(shards, key=lambda s: s["file"])}
        if any(n > seen["version"] for n in self._numbers()):
            raise Conflict(f"version {made['version']} is taken")
        try:
            out = self.fs.create(self._named(made["version"]), False)
        except Exception as e:  # of the Java side: the file is there
            raise Conflict(f"version {made['version']} is taken") from e
        try:
            out.write(bytearray(json.dumps(made).encode()))
        finally:
            out.close()
        return made

    def repair(self) -> None:
        """Removes manifests that a writer left unfinished. Only when no writer is at work."""
        for n in self._numbers():
            if self._load(n) is None:
                self.fs.delete(self._named(n), False)

    def append(self, rows: DataFrame, rows_a_shard: int = ROWS_A_SHARD, tries: int = 20) -> dict:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", rows_a_shard).parquet(folder)
        new = self._files(folder)
        for left in reversed(range(tries)):
            seen = self.manifest()
            try:
                return self.commit(seen, seen["shards"] + new, rows.schema.json())
            except Conflict:
                if not left:
                    raise
                time.sleep(0.1)

    def runs(self, shards: list[dict], target: int, fanout: int) -> list[list[dict]]:
        """Runs of similarly sized shards of the lowest tier that has enough of them; each run at most the target, or one pair."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            tier, edge = 0, target / fanout**3
            while s["bytes"] > edge and edge < target:
                tier, edge = tier + 1, edge * fanout
            if s["bytes"] < 0.75 * target:
                tiers.setdefault(tier, []).append(s)
        for tier in sorted(tiers):
            if len(tiers[tier]) < 2 or len(tiers[tier]) < fanout and tier != max(tiers):
                continue
            out, run, size = [], [], 0
            for s in sorted(tiers[tier], key=lambda s: (s["bytes"], s["file"])):
                if run and size + s["bytes"] > target:
                    out, run, size = [*out, run], [], 0
                run, size = [*run, s], size + s["bytes"]
            out = [r for r in [*out, run] if len(r) > 1]
            if out:
                return out
        return []

    def compact(self, target: int = TARGET, fanout: int = FANOUT, vacuum_s: float | None = None) -> dict:
        """Until no tier has shards to merge; each round is a version of its own. vacuum_s: vacuum after each round all that the
        newest version doesn't name and that is older."""
        seen = self.manifest()
        while runs := self.runs(seen["shards"], target, fanout):
            gone, new = set(), []
            for i in range(0, len(runs), RUNS_A_JOB):
                folder = f"{self.root}/data/{uuid.uuid4().hex}"
                merged = [self._read([s["file"] for s in run], seen["schema"]).coalesce(1) for run in runs[i : i + RUNS_A_JOB]]
                reduce(DataFrame.union, merged).write.parquet(folder)
                new += self._files(folder)
                gone |= {s["file"] for run in runs[i : i + RUNS_A_JOB] for s in run}
            before = len(seen["shards"])
            seen = self._swap(seen, gone, new)
            if vacuum_s is not None:
                self.vacuum(older_s=vacuum_s)
            if len(seen["shards"]) >= before:
                break
        return seen

    def _swap(self, seen: dict, gone: set[str], new: list[dict]) -> dict:
        """Commits new in place of gone, on the newest version as long as that names all of gone."""
        while True:
            try:
                return self.commit(seen, [s for s in seen["shards"] if s["file"] not in gone] + new)
            except Conflict:
                later = self.manifest()
                if later["version"] == seen["version"] or not gone <= {s["file"] for s in later["shards"]}:
                    raise
                seen = later

    def vacuum(self, keep: int = 1, older_s: float = 86_400) -> None:
        """Deletes data files that none of the newest `keep` versions names and that are older than older_s seconds."""
        kept = [m for m in map(self._load, self._numbers()) if m][:keep]
        named, data = {s["file"] for m in kept for s in m["shards"]}, self.path(f"{self.root}/data")
        before = (time.time() - older_s) * 1000
        for folder in self.fs.listStatus(data) if self.fs.exists(data) else ():
            for s in self.fs.listStatus(folder.getPath()):
                if s.getPath().getName().endswith(".parquet") and s.getPath().toString() not in named and s.getModificationTime() <= before:
                    self.fs.delete(s.getPath(), False)

    def _read(self, files: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*files)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["shards"]:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(m["schema"])) if m["schema"] else T.StructType([]))
        return self._read([s["file"] for s in m["shards"]], m["schema"])


def query(docs: DataFrame) -> DataFrame:
    """Two arrivals, compacted; what the newest version holds."""
    store = ShardStore(docs.sparkSession, shared_folder(docs.sparkSession, "shards"))
    half = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2))
    for k in (0, 1):
        store.append(docs.filter(half == k))
    store.compact(vacuum_s=0)  # the store is this query's own
    return store.read().select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL = "select doc_id, octet_length(encode(text))::bigint as n_bytes, sha256(text) as text_sha256 from documents"
