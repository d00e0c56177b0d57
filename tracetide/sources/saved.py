"""Waveforms kept as Parquet: catalog tables as they are, changes sorted by signal and time.

The sort order lets a filter on signals or times skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = ("meta", "scopes", "vars", "signals", "enums")


def save(source, path: str, codec: str = "zstd") -> None:
    """Write what a reader yields. The folder must not exist."""
    for name in CATALOG:
        source.table(name).write.parquet(f"{path}/{name}")
    source.steps().repartitionByRange("file", "time").sortWithinPartitions("file", "time").write.option("compression", codec).parquet(f"{path}/steps")
    changes = source.changes().repartitionByRange("file", "signal_id", "time").sortWithinPartitions("file", "signal_id", "time", "seq")
    changes.write.option("compression", codec).parquet(f"{path}/changes")


def is_saved(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/changes")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class SavedWaves:
    """The tables that save() wrote, with the readers' interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def steps(self) -> DataFrame:
        return self.table("steps")

    def changes(self, signals: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        df = self.table("changes")
        if start is not None:
            df = df.filter(F.col("time") >= start)
        if end is not None:
            df = df.filter(F.col("time") <= end)
        return df if signals is None else df.join(signals.select("file", "signal_id"), ["file", "signal_id"], "left_semi")
