"""Benchmark decontamination with DataFrame functions only.

The normalised windows of the benchmark form a hash set that is broadcast while
the measured bytes of all that would be sent allow it, and shuffled beyond. A document is scanned once:
of each window length L every (L - k + 1)-th k-gram is probed, so that each
occurrence of a window holds exactly one probed k-gram. Only the context of a
probe that hits is expanded into full windows, and those are compared as text.

Words are runs of ASCII letters and digits and of all characters above ASCII,
with A-Z lower-cased. Null texts have no words. Every row gives a row; equal ids
with different texts are separate documents. Windows of benchmark rows without
an id are hits as all others, but there is no id to list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracetide.llm.common import document_key, require

#: Word characters before lower-casing; A-Z become a-z afterwards.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | Column) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD), F.lit(0))


def _phrase(words: Column, start, length) -> Column:
    return F.concat_ws(" ", F.slice(words, start, length))


def _exact(phrase: Column) -> Column:
    return F.translate(phrase, UPPER, LOWER)


def _probe(words: Column, start, k: int) -> Column:
    """Hash of a k-gram under a folding that merges at least what _exact merges."""
    return F.xxhash64(F.lower(_phrase(words, start, F.lit(k))))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = 13) -> DataFrame:
    """One row (length, win, items) for each distinct window; a shorter item is one window."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(text).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    starts = words.select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("w") - length + 1)).alias("at"))
    return starts.groupBy("length", _exact(_phrase(F.col("w"), F.col("at"), F.col("length"))).alias("win")).agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13, gram: int = 4, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per document (rows equal in id and text, counted in n_rows) its number of words, the starts of hit windows and the items hit.

    broadcast_bytes bounds the tables that are broadcast, windows with their items and probes; larger ones are joined by shuffle.
    """
    require(docs, doc_id, text)
    require(benchmark, item, item_text)
    wins = benchmark_windows(benchmark, item, item_text, n)
    item_bytes = F.aggregate(F.transform("items", F.octet_length), F.lit(0).cast("bigint"), lambda x, y: x + y + 16)
    sizes = wins.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.octet_length("win") + item_bytes + 64).alias("bytes")).collect()  # at most n rows
    lengths = sorted(r.length for r in sizes)
    grams = {length: min(gram, length) for length in lengths}
    small = sum(r.bytes + 40 * r.n * (r.length - grams[r.length] + 1) for r in sizes) <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)

    w, size = F.col("w"), F.col("n_words")

    def probes(length: int) -> Column:
        k = grams[length]
        step = length - k + 1

        def one(i: Column) -> Column:
            low = F.greatest(i - (step - 1), F.lit(1))
            return F.struct(_probe(w, i, k).alias("h"), F.lit(length).alias("length"), low.alias("low"), F.slice(w, low, i + (length - low)).alias("ctx"))

        return F.when(size >= length, F.transform(F.sequence(F.lit(1), size - (k - 1), F.lit(step)), one)).otherwise(F.array().cast("array<struct<h:bigint,length:int,low:int,ctx:array<string>>>"))

    # the first element carries the document itself through the joins; no window has length 0, and its hash spreads it over partitions
    itself = F.array(F.struct(F.col("key").alias("h"), F.lit(0).alias("length"), F.lit(0).alias("low"), F.lit(None).cast("array<string>").alias("ctx")))
    scanned = docs.select(F.col(doc_id).alias("doc_id"), document_key(doc_id, text).alias("key"), words_of(text).alias("w")).withColumn("n_words", F.size("w"))
    probed = scanned.select("doc_id", "key", "n_words", F.explode(F.concat(itself, *map(probes, lengths))).alias("p")).select("doc_id", "key", "n_words", "p.*")

    if lengths:
        def grams_of(length: int) -> DataFrame:
            own, k = wins.filter(F.col("length") == length).select(F.split("win", " ").alias("w")), grams[length]
            return own.select(F.lit(length).alias("length"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(length - k + 1)), lambda i: _probe(w, i, k))).alias("h"))

        sets = reduce(DataFrame.union, map(grams_of, lengths))
        found = probed.join(hint(sets.distinct().withColumn("hit", F.lit(True))), ["length", "h"], "left").filter(F.col("hit") | (F.col("length") == 0))
        starts = F.when(F.col("length") > 0, F.sequence(F.lit(1), F.size("ctx") - F.col("length") + 1))
        tried = found.select("doc_id", "key", "n_words", "length", "low", "ctx", F.explode_outer(starts).alias("at"))
        tried = tried.select("doc_id", "key", "n_words", "length", (F.col("low") + F.col("at") - 1).alias("start"), F.when(F.col("length") > 0, _exact(_phrase(F.col("ctx"), F.col("at"), F.col("length")))).otherwise(F.col("key").cast("string")).alias("win"))
        checked = tried.join(hint(wins), ["length", "win"], "left").filter(F.col("items").isNotNull() | (F.col("length") == 0))
    else:
        checked = probed.select("doc_id", "key", "n_words", "length", F.lit(None).cast("int").alias("start"), F.lit(None).cast("array<string>").alias("items"))
    hit = F.when(F.col("length") > 0, F.struct("start", "length"))
    return checked.groupBy("doc_id", "key").agg(F.max("n_words").cast("long").alias("n_words"), F.count(F.when(F.col("length") == 0, 1)).alias("n_rows"), F.collect_set(hit).alias("windows"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, share: int = 20, **names) -> DataFrame:
    """judged() with a row for each row of docs."""
    return judged(docs, benchmark, share, **names).withColumn("n_rows", F.explode(F.array_repeat(F.lit(1), F.col("n_rows").cast("int")))).drop("n_rows")


def judged(docs: DataFrame, benchmark: DataFrame, share: int = 20, **names) -> DataFrame:
    """hits() with the number of words inside hit windows and the verdict: hit words are at least 1 / share of all."""
    inside = F.array_distinct(F.flatten(F.transform("windows", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    return hits(docs, benchmark, **names).withColumn("positions", inside).withColumn("n_hit", F.size("positions").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def _same(doc_id: str, key: str) -> Column:
    """Equal in id and in the hash of id and text."""
    return (F.col("__key") == F.col(key)) & F.col(doc_id).eqNullSafe(F.col("__id"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words of any document taken out of its text."""
    found = judged(docs, benchmark, doc_id=doc_id, text=text, **names)
    keyed = docs.withColumn("__key", document_key(doc_id, text))
    if remove == "documents":
        bad = found.filter("contaminated").select(F.col("key").alias("__bad"), F.col("doc_id").alias("__id"))
        return keyed.join(bad, _same(doc_id, "__bad"), "left_anti").select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    dirty = found.filter("n_hit > 0").select(F.col("key").alias("__dirty"), F.col("doc_id").alias("__id"), F.col("positions").alias("__at"))
    joined = keyed.join(dirty, _same(doc_id, "__dirty"), "left")
    gaps, words = F.split(F.col(text), WORD, -1), words_of(text)
    rebuilt = F.array_join(F.transform(gaps, lambda gap, i: F.when((i < F.size(words)) & ~F.array_contains("__at", i + 1), F.concat(gap, F.get(words, i))).otherwise(gap)), "")
    return joined.select(*[F.when(F.col("__at").isNotNull(), rebuilt).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
