"""Filters that interact: what each removes in every order of applying them.

With k filters there are k * 2**(k-1) edges of the lattice of subsets: a set of
filters already applied, and the next one (80 for five). Documents are judged by
each filter once, and counted by the part that they belong to and the set of
filters that they fail, at most 2**k rows a part. Each of these rows adds to all
edges; the edges are summed; and the steps of all k! orders, which are paths
through the lattice, look up their edge. No document is taken through an order.

The last filter of `audit` fails documents whose text a smaller id has too. Copies
have one hash, and all that the other filters see of them is equal; so copies are
counted by hash, part, failures and labels before hashes meet, and a group of
copies never gathers as documents: only the smallest id of each such row is kept,
with the number of rows that have it.

Null texts count as empty ones. A document without an id has no smaller id and is
none: it never fails the filter for copies nor makes others fail. Rows of one id
and text are copies of which none is smaller. Null parts are the empty string. A
document counts as good (toxic) if any row of labels with its id says so; labels
without id say nothing. Empty tables give no rows: there is no part.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracetide.llm.common import materialize, require

# White space between words, and the characters of filter D.
WHITE = " \t\n\x0b\f\r"
MARKS = "[#$%&*|]"


def content_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails: too few words, too few distinct ones, too many capitals, marks of code or tables."""
    stripped = F.trim(text, F.lit(WHITE))
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"[\x20\x09-\x0D]+"))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike(MARKS),
    }


def bits(conditions: list[Column]) -> Column:
    """One bit for each condition that holds, the first the lowest."""
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out + F.when(c, 1 << i).otherwise(0)
    return out


def judged(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], id_col: str, text: str, part: str) -> DataFrame:
    """(part, failed, good, toxic, n): documents counted by the bits of the filters that they fail; copies are the bit after those of `filters`."""
    require(docs, id_col, text, part)
    require(labels, id_col, "quality", "toxic")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits(list(filters.values())).alias("failed"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit("second"), body).alias("h2"))
    rows = materialize(rows, "judged")
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    labelled = rows.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left").select(*rows.columns, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    labelled = labelled.unionByName(rows.filter(F.col("doc_id").isNull()).select(*rows.columns, no.alias("good"), no.alias("toxic")))

    same = ["h1", "h2", "part", "failed", "good", "toxic"]
    by_id = labelled.groupBy("doc_id", *same).agg(F.count("*").alias("n"))
    has_id = F.col("doc_id").isNotNull()
    copies = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("loose"))
    # one row for each part, set of failures and pair of labels in a group of copies
    first = F.min("least.doc_id").over(Window.partitionBy("h1", "h2"))
    passing = F.col("loose") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = copies.withColumn("first", first).withColumn("passing", passing)
    repeat = 1 << len(filters)
    split = F.explode(F.array(F.struct(F.col("failed"), F.col("passing").alias("n")), F.struct((F.col("failed") + repeat).alias("failed"), (F.col("n") - F.col("passing")).alias("n")))).alias("as")
    return both.select("part", "good", "toxic", split).groupBy("part", "as.failed", "good", "toxic").agg(F.sum("as.n").alias("n"))


def edges(counts: DataFrame, k: int) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost): sums over the documents of a part, for each edge of the lattice of k filters."""
    half = 1 << (k - 1)
    rest, f = F.pmod(F.col("edge"), F.lit(half)), F.floor(F.col("edge") / half).cast("int")
    own = F.expr("shiftleft(1, filter)")
    applied = 2 * rest - rest.bitwiseAND(own - 1)  # the bits from the filter's own on move up by one
    each = counts.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(k * half - 1)))).withColumn("filter", f).withColumn("applied", applied.cast("int"))
    before, fails = F.col("failed").bitwiseAND(F.col("applied")) != 0, F.col("failed").bitwiseAND(own) != 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    removed = ~before & fails
    return each.groupBy("part", "applied", "filter").agg(
        total(~before & ~fails).alias("kept"), total(removed).alias("removed"), total(before & fails).alias("redundant"), total(F.col("failed") == own).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"),
    )


def paths(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, applied, filter) of every step of every order."""
    out = []
    for order in permutations(range(len(names))):
        applied = 0
        for step, f in enumerate(order):
            out.append(("".join(names[i] for i in order), step + 1, applied, f))
            applied |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeats: str = "E", id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row for each part, order and step.

    filters: names (a letter each) and conditions over docs under which a document fails, functions of its text
    alone; `repeats` names the filter for copies, which comes on top. shapley: what the step's filter removes, summed
    over all orders.
    """
    filters = content_filters(F.coalesce(F.col(text), F.lit(""))) if filters is None else filters
    names = [*filters, repeats]
    k = len(names)
    lattice = materialize(edges(judged(docs, labels, filters, id_col, text, part), k), "lattice")
    # an edge after s filters lies on s! * (k - 1 - s)! paths
    weights = F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)])
    shapley = lattice.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.get(weights, F.bit_count("applied"))).alias("shapley"))
    steps = docs.sparkSession.createDataFrame(paths(names), "filter_order string, step int, applied int, filter int")  # k! * k rows
    found = lattice.join(shapley, ["part", "filter"]).join(F.broadcast(steps), ["applied", "filter"])
    return found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
