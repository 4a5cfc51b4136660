"""An append-only log of records with compaction.

Appended segments are folders of Parquet files that count once their writer has finished. Compaction
merges segments into runs that hold one record an id, and runs of a level into one of the next, so a record is
rewritten once a level and not each time. What a reader sees is named by a version file: folders are
written first, the version that points to them is published last, so a crash between leaves a folder
that nothing refers to, and the log as it was.

    segments/<name>/   appended records
    runs/<name>/       merged records, one an id
    versions/<n>.json  runs by level, segments that they cover
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import SourceError

#: Runs of a level from which they are merged into one.
FAN = 8


@dataclass
class Version:
    number: int = 0
    runs: list[dict] = field(default_factory=list)
    covered: list[str] = field(default_factory=list)


class RecordLog:
    """Records (an id, attempts, other columns) under a path that driver and executors share.

    The record of an id is the one with the most attempts; of equal ones the greatest by its other columns, so
    a segment that is appended twice changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "qa_id"):
        self.spark, self.path, self.id = spark, path.rstrip("/"), id_col
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    # ---- writing

    def append(self, records: DataFrame, name: str | None = None) -> str:
        """Add a segment; a ``name`` (say, a stream's batch) that was appended before is not written again."""
        name = name or uuid.uuid4().hex
        if self._done(name) or name in self.version().covered:
            return name
        records.write.mode("overwrite").parquet(f"{self.path}/segments/{name}")
        return name

    def _done(self, name: str) -> bool:
        return self._fs.exists(self._path("segments", name, "_SUCCESS"))

    def _publish(self, version: Version) -> None:
        """Make a version the current one: written beside its place and moved there whole, which only one writer can do."""
        jvm = self.spark._jvm
        beside = self._path("versions", f"_{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray(json.dumps({"runs": version.runs, "covered": version.covered}).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plainly = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(beside, self._path("versions", f"{version.number:012d}.json"), plainly)
        except Exception as e:
            self._fs.delete(beside, False)
            raise SourceError(f"{self.path}: another writer published version {version.number}") from e

    # ---- reading

    def version(self) -> Version:
        """The current version; before the first one nothing is merged."""
        names = [n for n in self._names("versions") if n.endswith(".json") and not n.startswith(("_", "."))]
        if not names:
            return Version()
        got = json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{names[-1]}").collect()))
        return Version(int(names[-1][:-5]), got["runs"], got["covered"])

    def segments(self, version: Version | None = None) -> list[str]:
        """Finished segments that no run of the version covers."""
        covered = set((version or self.version()).covered)
        return [n for n in self._names("segments") if n not in covered and self._done(n)]

    def _merged(self, folders: list[str]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{f}") for f in folders]
        columns = parts[0].columns
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        rest = [c for c in columns if c not in (self.id, "attempts")]
        best = F.max(F.struct("attempts", *rest)).alias("_best")
        return rows.groupBy(self.id).agg(best).select(*(F.col(c) if c == self.id else F.col(f"_best.{c}").alias(c) for c in columns))

    def read(self) -> DataFrame:
        """One record an id, of the runs and segments that are there now."""
        version = self.version()
        folders = [f"runs/{r['name']}" for r in version.runs] + [f"segments/{n}" for n in self.segments(version)]
        if not folders:
            raise SourceError(f"{self.path}: no records")
        return self._merged(folders)

    # ---- compaction

    def compact(self, fan: int = FAN) -> Version:
        """Merge the segments into a run, and runs of a level into one of the next where there are ``fan`` of them."""
        if fan < 2:
            raise ValueError("fan must be 2 or more")
        now = self.version()
        new = self.segments(now)
        runs, covered = list(now.runs), [*now.covered, *new]
        if new:
            runs.append(self._run([f"segments/{n}" for n in new], 1))
        level = 1
        while any(r["level"] >= level for r in runs):
            own = [r for r in runs if r["level"] == level]
            if len(own) >= fan:
                runs = [r for r in runs if r["level"] != level] + [self._run([f"runs/{r['name']}" for r in own], level + 1)]
            level += 1
        if runs == now.runs:
            return now
        version = Version(now.number + 1, runs, covered)
        self._publish(version)
        return version

    def _run(self, folders: list[str], level: int) -> dict:
        name = uuid.uuid4().hex
        self._merged(folders).write.parquet(f"{self.path}/runs/{name}")
        return {"name": name, "level": level}

    def vacuum(self) -> int:
        """Delete folders that the current version does not need; readers of earlier versions must be done. Returns their number."""
        now = self.version()
        keep = {r["name"] for r in now.runs}
        gone = [("runs", n) for n in self._names("runs") if n not in keep] + [("segments", n) for n in self._names("segments") if n in set(now.covered)]
        for folder, name in gone:
            self._fs.delete(self._path(folder, name), True)
        return len(gone)
