"""Size-tiered sharding with DataFrame functions only.

A store is a folder of immutable runs. Arrivals are appended as small runs, one
shard for each input partition. Runs fall into tiers by size (powers of
`fan`); when a tier holds `fan` runs, they are merged into one run of files of
about `target` bytes, without a shuffle: their partitions are coalesced. Each
change ends with a new version of the manifest. It is written whole under a name
of its own and then renamed to the version's name, which fails where that name
is taken. The rename is the commit: what a failed or overtaken job has written is
in no manifest, and vacuum() deletes it. A file under a version's name that is
not a whole manifest is no version; the next commit takes the number after it.
Readers of a version see its runs and nothing else; vacuum() keeps the runs of
the last `keep` versions for them. The manifest lists runs, whose number grows
with the logarithm of the data.

The rename must be atomic and not overwrite, as HDFS and local folders do it; an
object store needs a file system that offers that.

Rows are kept as they are, nulls and repeats included. An empty arrival makes an
empty run, so that a store has a schema from its first arrival on.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Overtaken(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Run:
    name: str
    bytes: int
    rows: int
    files: int


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target: int = 128 << 20, fan: int = 4, smallest: int = 1 << 20, codec: str = "zstd"):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fan, self.smallest, self.codec = target, fan, smallest, codec

    # Files of a few kB and names of folders: the only things that pass through the driver.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        """Numbers that are taken, the latest first."""
        return sorted((int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json")), reverse=True)

    def _manifest(self, version: int) -> list[Run] | None:
        """The runs of a version; None if its file is torn."""
        fs, p = self._fs(f"{self.path}/manifest/v{version:010d}.json")
        stream = fs.open(p)
        try:
            found = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return [Run(**r) for r in json.loads(found)["runs"]]
        except (ValueError, KeyError, TypeError):
            return None

    def _latest(self, numbers: list[int]) -> int:
        """The latest whole version of a listing."""
        return next((n for n in numbers if self._manifest(n) is not None), 0)

    def version(self) -> int:
        """The latest whole version; 0 before the first commit."""
        return self._latest(self._numbers())

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        found = self._manifest(version)
        if found is None:
            raise ValueError(f"version {version} of {self.path} is torn")
        return found

    def commit(self, runs: list[Run], base: int) -> int:
        """Make these runs the version after base, unless someone else has committed since.

        The look at the latest version and the choice of the number go by one listing: whoever commits after it takes
        that number, and the rename fails.
        """
        taken = self._numbers()
        if self._latest(taken) != base:
            raise Overtaken(f"version {base} of {self.path} is not the latest")
        number = max(taken, default=0) + 1
        fs, made = self._fs(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(made, False)
        try:
            out.write(bytearray(json.dumps({"version": number, "runs": [asdict(r) for r in runs]}).encode()))
        finally:
            out.close()
        _, final = self._fs(f"{self.path}/manifest/v{number:010d}.json")
        if not self._rename(made, final):
            fs.delete(made, False)
            raise Overtaken(f"version {number} of {self.path}")
        return number

    def _rename(self, made, final) -> bool:
        """Rename unless the name is taken, atomically."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        context = jvm.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(made), context.makeQualified(final), none)
        except Exception:
            if context.util().exists(final):
                return False
            raise
        return True

    def _write(self, df: DataFrame) -> Run:
        name = uuid.uuid4().hex
        df.write.option("compression", self.codec).parquet(f"{self.path}/runs/{name}")
        shards = self.shards_of([name])
        size = shards.agg(F.sum("bytes"), F.sum("rows"), F.count("*")).first()
        return Run(name, int(size[0] or 0), int(size[1] or 0), int(size[2] or 0))

    def shards_of(self, names: list[str]) -> DataFrame:
        """(run, shard, bytes, rows), from file metadata alone."""
        files = self.spark.read.parquet(*[f"{self.path}/runs/{n}" for n in names])
        found = files.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return found.select(F.element_at(F.split("path", "/"), -2).alias("run"), F.element_at(F.split("path", "/"), -1).alias("shard"), "bytes", "rows")

    def append(self, df: DataFrame, retries: int = 20) -> int:
        run = self._write(df)
        for _ in range(retries):
            base = self.version()
            try:
                return self.commit([*self.runs(base), run], base)
            except Overtaken:
                continue
        raise Overtaken(self.path)

    def tier(self, run: Run) -> int:
        return max(0, int(math.log(max(run.bytes, 1) / self.smallest, self.fan) + 1e-9)) if run.bytes > self.smallest else 0

    def compact(self) -> int | None:
        """Merge the smallest tier that is full, and commit; None if no tier is."""
        base = self.version()
        runs = self.runs(base)
        tiers: dict[int, list[Run]] = {}
        for r in runs:
            tiers.setdefault(self.tier(r), []).append(r)
        full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan), None)
        if full is None:
            return None
        files = max(1, -(-sum(r.bytes for r in full) // self.target))
        merged = self._write(self._read(full).coalesce(files))
        gone = {r.name for r in full}
        try:
            return self.commit([*(r for r in runs if r.name not in gone), merged], base)
        except Overtaken:  # appended to meanwhile: the merged runs are still the same
            base = self.version()
            runs = self.runs(base)
            if not gone <= {r.name for r in runs}:
                raise
            return self.commit([*(r for r in runs if r.name not in gone), merged], base)

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/runs/{r.name}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        runs = self.runs(version)
        if not runs:
            raise ValueError(f"{self.path} holds nothing yet")
        return self._read(runs)

    def manifest(self, version: int | None = None) -> DataFrame:
        """(run, shard, bytes, rows) of a version."""
        return self.shards_of([r.name for r in self.runs(version)])

    def vacuum(self, keep: int = 10, grace: float = 0) -> None:
        """Delete runs that none of the last `keep` versions lists, older manifests and torn ones.

        Runs and files that no version lists may be another writer's, on the way to its commit: they go once they are
        `grace` seconds old. With a grace of 0 no writer may be at work.
        """
        whole = {n: runs for n in self._numbers() if (runs := self._manifest(n)) is not None}
        kept = sorted(whole, reverse=True)[:keep]
        live = {r.name for n in kept for r in whole[n]}
        known = {r.name for runs in whole.values() for r in runs}
        now = time.time()

        def old(fs, p) -> bool:
            return not grace or now - fs.getFileStatus(p).getModificationTime() / 1000 > grace

        for n in self._names("runs"):
            fs, p = self._fs(f"{self.path}/runs/{n}")
            if n not in live and (n in known or old(fs, p)):
                fs.delete(p, True)
        for n in self._names("manifest"):
            number = int(n[1:-5]) if n.startswith("v") and n.endswith(".json") else None
            fs, p = self._fs(f"{self.path}/manifest/{n}")
            if number not in kept and (number is not None or old(fs, p)):
                fs.delete(p, False)


#: Seconds that a writer has from its run to its commit.
GRACE = 86_400


def shard(spark: SparkSession, arrivals: list[DataFrame], path: str, keep: int = 10, **options) -> ShardStore:
    """A store of the arrivals, compacted after each as far as tiers are full; runs that only versions before the last `keep` list are deleted as it goes.

    Other writers may be at work: what they have written and not yet committed stays for GRACE seconds.
    """
    store = ShardStore(spark, path, **options)
    for df in arrivals:
        store.append(df)
        while store.compact() is not None:
            pass
        store.vacuum(keep, GRACE)
    return store
