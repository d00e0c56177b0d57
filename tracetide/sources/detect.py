"""Which kind of waveform a file is, by its first bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tracetide.sources.ghw import is_ghw
from tracetide.sources.vcd import is_vcd

HEAD = 4096


def head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, fs.getFileStatus(p).getLen())))
    finally:
        stream.close()


def detect(start: bytes) -> str:
    """vcd, fst, ghw or unknown. An FST file begins with a header block (type 0) of 329 bytes, or a wrapped one (254)."""
    if is_vcd(start.decode("latin-1")) or start.lstrip()[:1] == b"$" and start.lstrip()[1:].split(None, 1)[:1] in ([b"date"], [b"version"], [b"comment"], [b"timescale"], [b"scope"], [b"var"]):
        return "vcd"
    if is_ghw(start):
        return "ghw"
    if len(start) >= 9 and (start[0] == 254 or start[0] == 0 and int.from_bytes(start[1:9], "big") == 329):
        return "fst"
    return "unknown"


def file_format(spark: SparkSession, path: str) -> str:
    return detect(head(spark, path))
