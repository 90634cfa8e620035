"""Size-tiered compaction of shards under a versioned manifest.

A store is a folder. ``append`` writes an arrival as small immutable Parquet shards and commits a
manifest that adds them to the live ones; ``compact`` merges runs of similarly sized shards (equal
powers of ``FACTOR`` of their bytes, ``RUN`` or more in a tier) into files of about the target size and
commits a manifest in which the merged files stand for them. A manifest lists what it adds to and removes
from the version before; every ``FULL`` versions one lists all shards, so that a commit costs what it
changes and a reader replays few files. A manifest is written to a temporary name and renamed to its
version, which fails if that version exists: readers see one whole version or the next, and of two
writers one has to try again. That holds where a rename without overwriting is atomic, as on HDFS and
local disks; an object store needs one that offers it. ``sweep`` deletes shards that the newest version
does not list and what lost writers left behind; until then older versions can be read.

Manifests name files and their sizes, a line each; the rows stay on the executors. An empty arrival
commits a manifest without shards. Rows are stored as they are: nulls, empty and long texts, repeated rows and
extra columns of any name are kept; in ``compacted`` rows without an id are an arrival's like others.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takerank.llm.cluster import free_name

FACTOR = 4
RUN = 4
TARGET = 128 << 20
FULL = 16
ARRIVAL = "_arrival"


class Store:
    """A sharded table in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET):
        self.spark, self.path, self.target = spark, path.rstrip("/"), target
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _lines(self, version: int) -> list[dict]:
        source = self._fs.open(self._path(f"{self.path}/_manifest/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return [json.loads(line) for line in text.splitlines()]

    def shards(self, version: int | None = None) -> list[dict]:
        """The shards of a version, the newest by default: file (under the store), bytes, level."""
        if version is None:
            version = (self.versions() or [0])[-1]
        changes: list[list[dict]] = []
        while version:
            changes.append(self._lines(version))
            if changes[-1][0]["full"]:
                break
            version -= 1
        live: dict[str, dict] = {}
        for lines in reversed(changes):
            for line in lines[1:]:
                if "bytes" in line:
                    live[line["file"]] = line
                else:
                    live.pop(line["file"], None)
        return list(live.values())

    def commit(self, added: list[dict], removed: list[str], base: int) -> int:
        """Make version base + 1 of version base and the change; an error if another writer was first."""
        full = base % FULL == 0
        lines = added + [{"file": f} for f in removed]
        if full and base:
            gone = set(removed)
            lines = [s for s in self.shards(base) if s["file"] not in gone] + added
        self._put([{"full": full}, *lines], base + 1, False)
        return base + 1

    def _put(self, lines: list[dict], version: int, replace: bool) -> None:
        """Write a manifest under a temporary name and rename it to its version."""
        temporary = self._path(f"{self.path}/_manifest/.{uuid.uuid4().hex}.tmp")
        final = self._path(f"{self.path}/_manifest/v{version:08d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray("\n".join(json.dumps(x, sort_keys=True) for x in lines).encode()))
        out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._gateway.new_array(rename, 1)
        option[0] = rename.OVERWRITE if replace else rename.NONE
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(final), option)

    def _new(self, folder: str, level: int) -> list[dict]:
        """The Parquet files under a folder of the store, by arrival if it is partitioned."""
        out = []
        files = self._fs.listFiles(self._path(f"{self.path}/{folder}"), True)
        root = self._fs.makeQualified(self._path(self.path)).toString()
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString()
            if name.endswith(".parquet"):
                out.append({"file": name[len(root) + 1 :], "bytes": f.getLen(), "level": level})
        return sorted(out, key=lambda s: s["file"])

    def append(self, df: DataFrame) -> int:
        """Store an arrival."""
        base = (self.versions() or [0])[-1]
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return self.commit(self._new(folder, 0), [], base)

    def append_all(self, df: DataFrame, arrival: str) -> int:
        """Store several arrivals, told apart by a column of numbers that is not stored, in one pass; a version each."""
        base = (self.versions() or [0])[-1]
        folder = f"data/{uuid.uuid4().hex}"
        df.write.partitionBy(arrival).parquet(f"{self.path}/{folder}")
        arrivals: dict[str, list[dict]] = defaultdict(list)
        for s in self._new(folder, 0):
            arrivals[s["file"].split("/")[-2]].append(s)
        for name in sorted(arrivals, key=lambda n: int(n.split("=")[1])) or [""]:
            base = self.commit(arrivals.get(name, []), [], base)
        return base

    def tiers(self) -> list[list[dict]]:
        """Runs of similarly sized shards below the target that are due for merging."""
        by: dict[int, list[dict]] = defaultdict(list)
        for s in self.shards():
            if s["bytes"] < self.target // 2:
                by[max(0, s["bytes"].bit_length() - 1) // (FACTOR.bit_length() - 1)].append(s)
        return [run for _, run in sorted(by.items()) if len(run) >= RUN]

    def compact(self) -> int:
        """Merge due runs until none is left; the version that is live then."""
        schema = None
        while runs := self.tiers():
            base = self.versions()[-1]
            merged: list[dict] = []
            gone: set[str] = set()
            for run in runs:
                files = [f"{self.path}/{s['file']}" for s in run]
                total = sum(s["bytes"] for s in run)
                schema = schema or self.spark.read.parquet(files[0]).schema
                df = self.spark.read.schema(schema).parquet(*files)
                n = max(1, -(-total // self.target))
                folder = f"data/{uuid.uuid4().hex}"
                # few input splits are put together without a shuffle
                (df.coalesce(n) if n <= df._jdf.rdd().getNumPartitions() else df.repartition(n)).write.parquet(f"{self.path}/{folder}")
                merged += self._new(folder, 1 + max(s["level"] for s in run))
                gone |= {s["file"] for s in run}
            self.commit(merged, sorted(gone), base)
            if len(merged) >= sum(len(r) for r in runs):
                break  # nothing was put together
        return (self.versions() or [0])[-1]

    def sweep(self) -> None:
        """Delete all shards that the newest version does not list, older versions and what unfinished writers left.

        No writer may be at work meanwhile: what it has not committed yet would go too.
        """
        found = self.versions()
        if not found:
            return
        if not self._lines(found[-1])[0]["full"]:  # the newest version may not rest on older ones
            self._put([{"full": True}, *self.shards()], found[-1], True)
        live = {s["file"] for s in self.shards()}
        for s in self._new("data", 0):
            if s["file"] not in live:
                self._fs.delete(self._path(f"{self.path}/{s['file']}"), False)
        for v in found[:-1]:
            self._fs.delete(self._path(f"{self.path}/_manifest/v{v:08d}.json"), False)
        for status in self._fs.listStatus(self._path(f"{self.path}/_manifest")):
            if status.getPath().getName().endswith(".tmp"):
                self._fs.delete(status.getPath(), False)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version; schema: that of the arrivals."""
        files = [f"{self.path}/{s['file']}" for s in self.shards(version)]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*files)


def compacted(docs: DataFrame, path: str, arrivals: int = 8, target: int = TARGET) -> DataFrame:
    """Store docs as so many arrivals (by a hash of the row's id), compact, and read the newest version back."""
    store = Store(docs.sparkSession, path, target)
    arrival = free_name(docs, ARRIVAL)
    store.append_all(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), arrival)
    store.compact()
    store.sweep()
    return store.read(docs.schema)
