"""Rows of a live log are written once for each pass that needs them as a table."""

import os

from pyspark.sql import functions as F

from tracetide.plans import catalog
from tracetide.storage import shared_dir


def test_rows_are_not_copied_again(spark):
    folder = f"{shared_dir(spark)}/tracetide"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = spark.range(60).select(F.lit("").alias("file"), (F.col("id") % 3).alias("signal"), F.floor(F.col("id") / 4).alias("time"), F.col("id").alias("seq"), (F.floor(F.col("id") / 9) % 2).cast("string").alias("value"))
    live = catalog.grown(rows, (F.col("seq") > 33).cast("int"), 2)
    made = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert "on-time" in made and not made & {"pieces", "judged"}
    last = {r.signal: (r.time, r.value) for r in live.values().collect()}
    want = {s: (x.time, x.value) for s in range(3) for x in [max((r for r in catalog.ChangeLog(rows).dedup().df.collect() if r.signal == s), key=lambda r: r.seq)]}
    assert last == want
