"""Queries on a tree of scopes and variables held in DataFrames.

Nodes have id, parent_id (null at the top), ord (position among siblings) and
name. Paths are found by pointer doubling: each round joins a node's path to that
of the ancestor it has reached, so that a tree of depth d takes log2(d) joins and
there is no limit on depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracetide.storage import materialize

SEPARATOR = "."


def with_paths(nodes: DataFrame) -> DataFrame:
    """nodes with path (names from the root) and ords (positions from the root)."""
    own = nodes.select("id", F.col("parent_id").alias("up"), F.array("name").alias("path"), F.array("ord").alias("ords"))
    while True:
        own = materialize(own, "paths")
        if own.filter(F.col("up").isNotNull()).isEmpty():
            break
        above = own.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("lead"), F.col("ords").alias("leads"))
        own = own.join(above, "up", "left").select("id", F.col("next").alias("up"), F.concat(F.coalesce("lead", F.array().cast("array<string>")), "path").alias("path"), F.concat(F.coalesce("leads", F.array().cast("array<int>")), "ords").alias("ords"))
    return nodes.join(own.drop("up"), "id")


def full_name(path: Column) -> Column:
    return F.array_join(path, SEPARATOR)


def post_order_key(ords: Column) -> Column:
    """Sorts children before their parent, and siblings by position."""
    return F.concat(F.array_join(F.transform(ords, lambda o: F.lpad(o.cast("string"), 9, "0")), SEPARATOR), F.lit("~"))


def post_order(nodes: DataFrame) -> DataFrame:
    """nodes with their place in a depth-first walk that gives leaves first."""
    return with_paths(nodes).withColumn("key", post_order_key(F.col("ords")))


def top(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("parent_id").isNull())


def children(nodes: DataFrame, parent: int) -> DataFrame:
    return nodes.filter(F.col("parent_id") == parent)


def below(pathed: DataFrame, path: list[str]) -> DataFrame:
    """All nodes under a path, without its own node."""
    return pathed.filter((F.size("path") > len(path)) & (F.slice("path", 1, len(path)) == F.array(*map(F.lit, path))) if path else F.lit(True))


def lookup(pathed: DataFrame, path: list[str]) -> DataFrame:
    """The node with this path; the first, if siblings share a name."""
    found = pathed.filter(F.col("path") == F.array(*map(F.lit, path)))
    return found.orderBy("ords").limit(1)


def lookup_var(pathed: DataFrame, path: list[str], msb: int | None = None, lsb: int | None = None) -> DataFrame:
    found = pathed.filter(F.col("path") == F.array(*map(F.lit, path)))
    if msb is not None:
        found = found.filter((F.col("msb") == msb) & (F.col("lsb") == (msb if lsb is None else lsb)))
    return found.orderBy("ords").limit(1)


def longest_prefix(asked: DataFrame, names: DataFrame, word: str = "word", name: str = "name") -> DataFrame:
    """For each asked word the longest name that it begins with, the smallest id first.

    The prefixes of a word are its candidates, so that the join is an equality.
    """
    prefixes = asked.select(word, F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.col(word), F.lit(1), i))).alias(name))
    found = prefixes.join(names, name)
    w = Window.partitionBy(word).orderBy(F.desc(F.length(name)), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def merge_equal_scopes(scopes: DataFrame, keys: tuple[str, ...] = ("parent_id", "name")) -> DataFrame:
    """(id, kept): scopes of one name under one parent are the first of them."""
    first = scopes.groupBy(*keys).agg(F.min("id").alias("kept"))
    on = [scopes[k].eqNullSafe(first[k]) for k in keys]
    return scopes.join(first, on).select(scopes["id"], "kept")


def flatten_unnamed(nodes: DataFrame) -> DataFrame:
    """nodes without those of an empty name; their children hang from the nearest named ancestor."""
    own = nodes.select("id", "name", "parent_id")
    moved = nodes
    while True:
        up = own.select(F.col("id").alias("parent_id"), F.col("name").alias("up_name"), F.col("parent_id").alias("up"))
        moved = materialize(moved.join(up, "parent_id", "left").withColumn("skip", F.col("up_name").eqNullSafe("")), "flat")
        if moved.filter("skip").isEmpty():
            break
        moved = moved.withColumn("parent_id", F.when(F.col("skip"), F.col("up")).otherwise(F.col("parent_id"))).select(*nodes.columns)
    return moved.select(*nodes.columns).filter("name <> ''")


def aliases(variables: DataFrame) -> DataFrame:
    """(signal_id, names): all variables of a signal."""
    return variables.groupBy("signal_id").agg(F.array_sort(F.collect_set("full_name")).alias("names"))


def with_labels(values: DataFrame, enums: DataFrame) -> DataFrame:
    """values (enum_id, bits, ...) with the label of an enum's value, if it has one."""
    labels = enums.select("enum_id", F.explode("mapping").alias("m")).select("enum_id", F.col("m.value").alias("bits"), F.col("m.label").alias("label"))
    return values.join(labels, ["enum_id", "bits"], "left")


def bit_islands(variables: DataFrame) -> DataFrame:
    """variables (parent_id, ord, name, msb, lsb) with the run they belong to: neighbours of one name whose indexes join without a gap.

    island is the position of the run's first member.
    """
    w = Window.partitionBy("parent_id").orderBy("ord")
    joins = (F.lag("name").over(w) == F.col("name")) & (F.lag("lsb").over(w) - 1 == F.col("msb"))
    start = F.when(F.coalesce(joins, F.lit(False)), None).otherwise(F.col("ord"))
    return variables.withColumn("start", start).withColumn("island", F.last("start", ignorenulls=True).over(w)).drop("start")


def merge_bits(variables: DataFrame) -> DataFrame:
    """One row for each run of bit_islands: its name, outer indexes and the signals from the most significant."""
    return bit_islands(variables).groupBy("parent_id", "island", "name").agg(F.max("msb").alias("msb"), F.min("lsb").alias("lsb"), F.array_sort(F.collect_list(F.struct("ord", "signal_id"))).alias("members")).withColumn("signals", F.col("members.signal_id")).drop("members")


def resolve(names: DataFrame, items: DataFrame) -> DataFrame:
    """(name, id, kind, hints) for names (name): the variable or scope that each leads to.

    items: (id, parent_id, ord, name, kind), with kind scope or var. A name is followed from the top, one level in a
    round for all names together: of the items whose own name begins the rest, the longest is taken, without a way
    back. What follows a scope is nothing or a point; what follows a variable holds no point, and is not looked at.
    Where a level has none, id is null and hints holds the level's first five names. Each beginning of the rest meets
    items by equality of parent and name, so that scopes with many items are no products.
    """
    top = F.lit(-1).cast("bigint")
    items = materialize(items.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("parent_id").cast("bigint"), top).alias("at"), "ord", F.col("name").alias("begin"), "kind"), "items")
    open_ = names.select("name").distinct().select("name", top.alias("at"), F.col("name").alias("rest"))
    done: list[DataFrame] = []
    while True:
        open_ = materialize(open_, "open-names")
        cut = F.explode(F.sequence(F.lit(0), F.char_length("rest")))
        begun = open_.withColumn("cut", cut).select("name", "at", "cut", F.expr("substring(rest, 1, cut)").alias("begin"), F.expr("substring(rest, cut + 1)").alias("after"))
        ends = (F.col("after") == "") | F.startswith("after", F.lit("."))
        fits = F.when(F.col("kind") == "scope", ends).otherwise(~F.contains("after", F.lit(".")))
        met = begun.join(items, ["at", "begin"]).filter(fits)
        best = F.max_by(F.struct("id", "kind", "after"), F.struct("cut", -F.col("ord"))).alias("best")
        found = materialize(open_.join(met.groupBy("name").agg(best), "name", "left"), "met-names")
        on = (F.col("best.kind") == "scope") & (F.col("best.after") != "")
        done.append(found.filter(F.col("best").isNull() | ~on).select("name", "at", "best.id", "best.kind"))
        open_ = found.filter(on).select("name", F.col("best.id").alias("at"), F.expr("substring(best.after, 2)").alias("rest"))
        if open_.isEmpty():
            break
    told = reduce(DataFrame.unionByName, done)
    lost = told.filter("id is null").select("at").distinct()
    near = items.join(lost, "at", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("at").orderBy("ord", "id"))).filter("k <= 5")
    hints = near.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("k", "begin")))["begin"].alias("hints"))
    told = told.join(hints, "at", "left")
    return told.select("name", "id", "kind", F.when(F.col("id").isNull(), F.coalesce("hints", F.array().cast("array<string>"))).alias("hints"))
