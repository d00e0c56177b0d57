"""Removal of lines that many documents share, with DataFrame functions only.

Every text is exploded into its lines. A line's key is the line without white
space at its ends and with A-Z in lower case; keys of at least `min_chars` code
points are kept as two 64-bit hashes. Keys that at least `min_docs` documents hold
lose all their lines, but for those in the document with the largest id among the
holders. What stays is put together again by position: the runs of lines between
the dropped ones.

Counting is combined before each shuffle. The lines of frequent keys meet them in
one of two ways: keys with over 1/10,000 of all lines (there are at most 10,000)
are broadcast, the others are shuffled, and none of them can fill a task. Only
hashes and positions travel for this; the texts themselves are shuffled once, by
document.

Null texts count as empty ones; an empty text has one empty line. Rows of one id
are one document for the count, and if it is the largest all of them keep their
lines. Rows without an id are together one document, smaller than all others.
Repeated rows are judged alike and all returned. Lines end at \n alone, so \r is
white space at the end of a line. Empty tables give empty results. Other columns,
whatever their names, are passed on unchanged by deduplicate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracetide.llm.common import materialize, require

# White space and letters of the contract.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys with more than this share of all lines are broadcast; so there are at most this many of them.
HOT = 10_000


def line_key(line: Column) -> Column:
    stripped = F.trim(line, F.lit(WHITE))
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_key(id_: Column, text: Column) -> Column:
    return F.xxhash64(id_.cast("string"), F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, row_key, pos, h1, h2): the lines that are long enough, by the hashes of their keys."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _row_key(F.col(id_col), F.col(text)).alias("row_key"), F.posexplode(text_lines(F.col(text))).alias("pos", "line"))
    keys = rows.filter(F.octet_length("line") >= min_chars).select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("line_key")).filter(F.char_length("line_key") >= min_chars)
    return keys.select("doc_id", "row_key", "pos", F.xxhash64("line_key").alias("h1"), F.xxhash64(F.lit("second"), "line_key").alias("h2"))


def frequent_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, n_lines, keeper): keys in at least min_docs documents, and the largest id that holds them."""
    by_document = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    by_key = by_document.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"), F.max("doc_id").alias("keeper"))
    return by_key.filter(F.col("n_docs") >= min_docs)


def dropped_positions(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row_key, doc_id, cuts): the sorted positions of a document's dropped lines."""
    total = lines.count()  # of a written table: file metadata
    is_hot = F.col("n_lines") * HOT > total
    keys = ["h1", "h2"]
    hot = F.broadcast(frequent.filter(is_hot).select(*keys, "keeper"))  # at most HOT rows
    rare = frequent.filter(~is_hot).select(*keys, "keeper")
    met = lines.join(hot, keys).unionByName(lines.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rare, keys))
    lost = met.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("row_key", "doc_id").agg(F.sort_array(F.collect_set("pos")).alias("cuts"))


def _between(lines: Column, cuts: Column) -> Column:
    """The lines that are not cut: the runs between the cuts, side by side."""
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda p: p + 1))
    ends = F.concat(cuts, F.array(F.size(lines)))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.flatten(runs)


def _cut(docs: DataFrame, text: str, id_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(row, lines, cuts): each row as a struct, its lines, and the positions dropped (null: none)."""
    require(docs, id_col, text)
    lines = materialize(keyed_lines(docs, id_col, text, min_chars), "lines")
    frequent = materialize(frequent_keys(lines, min_docs), "frequent-lines")
    cuts = dropped_positions(lines, frequent).select(F.col("row_key").alias("cut_key"), F.col("doc_id").alias("cut_id"), "cuts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), _row_key(F.col(id_col), F.col(text)).alias("own_key"), text_lines(F.col(text)).alias("lines"))
    same = (F.col("own_key") == F.col("cut_key")) & F.col("own_id").eqNullSafe(F.col("cut_id"))
    return rows.join(cuts, same, "left").select("row", "lines", "cuts")


def _kept(text: Column) -> Column:
    return F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(_between(F.col("lines"), F.col("cuts")), "\n"))


def report(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): for each row its lines before, those dropped, and what is left as text."""
    found = _cut(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id", min_chars, min_docs)
    kept = _kept(F.coalesce("row.text", F.lit("")))
    dropped = F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts"))
    return found.select("row.doc_id", F.size("lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept"))


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs without the lines that others share; texts that lose none, null ones too, are as they were."""
    found = _cut(docs, text, id_col, min_chars, min_docs)
    return found.select(*[_kept(F.col(f"row.`{c}`")).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])
