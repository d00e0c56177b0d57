"""The registered queries over the driver's tables, each with its SQL.

Change-log views: E (events: user, time, event), L (lineitem: supplier, ship date),
O (orders: customer, order date), C (conversations). H is the tree region > nation > customer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracetide.api import Waveform
from tracetide.builder import HierarchyBuilder, encoded
from tracetide.functions import values
from tracetide.operators import derived, hierarchy
from tracetide.operators.changelog import ChangeLog, accepted_steps, delta_times, numbered, undelta_times
from tracetide.sources import writers
from tracetide.sources.detect import file_format
from tracetide.sources.fst import FstFiles
from tracetide.sources.ghw import GhwFiles
from tracetide.sources.kept import KeptLog
from tracetide.sources.progress import StreamProgress
from tracetide.sources import vcd_source
from tracetide.sources.vcd import VcdFiles
from tracetide.storage import materialize, shared_dir
from tracetide.streaming import steps
from tracetide.streaming.live import LiveLog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def events(spark, d, value=None) -> ChangeLog:
    value = F.col("value") if value is None else value
    return ChangeLog(table(spark, d, "events").select(F.col("user_id").alias("signal"), micros("ts").alias("time"), F.col("event_id").alias("seq"), value.alias("value")))


def items(spark, d) -> ChangeLog:
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    return ChangeLog(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("signal"), micros("l_shipdate").alias("time"), seq.alias("seq"), F.col("l_quantity").alias("value")))


def orders(spark, d) -> ChangeLog:
    return ChangeLog(table(spark, d, "orders").select(F.col("o_custkey").alias("signal"), micros("o_orderdate").alias("time"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value")))


def bit():
    return F.when(F.col("value") > 100, "1").otherwise("0")


E = "e AS (SELECT user_id AS signal, epoch_us(ts) AS time, event_id AS seq, value, event_type FROM events)"
EB = "eb AS (SELECT user_id AS signal, epoch_us(ts) AS time, event_id AS seq, CASE WHEN value > 100 THEN '1' ELSE '0' END AS value FROM events)"
L = "l AS (SELECT l_suppkey AS signal, epoch_us(l_shipdate) AS time, l_orderkey AS s1, l_linenumber AS s2, l_partkey AS s3, l_quantity AS value FROM lineitem)"
O = "o AS (SELECT o_custkey AS signal, epoch_us(o_orderdate) AS time, o_orderkey AS seq, o_orderstatus AS value FROM orders)"  # noqa: E741


def deduped(source: str, extra: str = "") -> str:
    return f"d AS (SELECT signal, time, seq, value FROM (SELECT *, lag(value) OVER w AS p, row_number() OVER w AS n FROM {source} WINDOW w AS (PARTITION BY signal ORDER BY time, seq)) WHERE n = 1 OR value IS DISTINCT FROM p{extra})"


@query("SELECT row_number() OVER (ORDER BY time) - 1 AS time_idx, time FROM (SELECT DISTINCT epoch_us(ts) AS time FROM events)")
def q01_time_table(spark, d):
    return events(spark, d).time_table()


@query(f"WITH {E} SELECT min(time) AS first_time, max(time) AS last_time, count(DISTINCT time) AS n_times, count(*) AS n_changes FROM e")
def q02_span(spark, d):
    return events(spark, d).span()


@query(f"WITH {EB}, {deduped('eb')} SELECT * FROM d")
def q03_dedup_bit(spark, d):
    return events(spark, d, bit()).dedup().df


@query(f"WITH {EB}, {deduped('eb')} SELECT * FROM d")
def q03_dedup_bit_sliced(spark, d):
    log = events(spark, d, bit())
    log.slices = 5
    return log.dedup().df


@query(f"WITH {O}, {deduped('o')} SELECT * FROM d")
def q04_dedup_string(spark, d):
    return orders(spark, d).dedup().df


@query(f"WITH c AS (SELECT conv_id AS signal, turn AS time, turn AS seq, role AS value FROM conversations), {deduped('c')} SELECT * FROM d")
def q04_dedup_role(spark, d):
    return ChangeLog(table(spark, d, "conversations"), "conv_id", "turn", "turn", "role").dedup().df


@query(f"WITH e AS (SELECT user_id AS signal, epoch_us(ts) AS time, event_id AS seq, floor(value / 50) AS value FROM events), {deduped('e')} SELECT * FROM d")
def q05_dedup_real(spark, d):
    return events(spark, d, F.floor(F.col("value") / 50).cast("double")).dedup().df


@query(f"""WITH e AS (SELECT user_id AS signal, epoch_us(ts) AS time, event_id AS seq, event_type AS value FROM events), {deduped('e', " OR value = 'error'")} SELECT * FROM d""")
def q06_events_kept(spark, d):
    return events(spark, d, F.col("event_type")).dedup(F.col("value") == "error").df


@query(f"WITH {L} SELECT signal, time, arg_max(value, (s1, s2, s3)) AS value, count(*) AS elements FROM l GROUP BY signal, time")
def q07_delta_last(spark, d):
    return items(spark, d).steps()


@query(f"WITH {L} SELECT signal, time, value, element FROM (SELECT *, row_number() OVER (PARTITION BY signal, time ORDER BY s1, s2, s3) - 1 AS element FROM l) WHERE element = 1")
def q08_delta_k(spark, d):
    return items(spark, d).elements(1).select("signal", "time", "value", "element")


def probes(spark, d) -> DataFrame:
    return table(spark, d, "events").select((F.col("event_id") % 150).alias("signal"), (micros("ts") + 1).alias("time"), F.col("event_id").alias("probe_id"))


P = "p AS (SELECT event_id % 150 AS signal, epoch_us(ts) + 1 AS time, event_id AS probe_id FROM events)"
ASOF = f"WITH {E}, {P} SELECT p.signal, p.time, p.probe_id, coalesce(e.time, -1) AS found_time, e.value FROM p ASOF LEFT JOIN e ON p.signal = e.signal AND p.time >= e.time"


@query(ASOF)
def q09_value_at(spark, d):
    return events(spark, d).value_at(probes(spark, d)).fillna(-1, ["found_time"])


@query(ASOF)
def q09_value_at_sliced(spark, d):
    log = events(spark, d)
    log.slices = 4
    return log.value_at(probes(spark, d)).fillna(-1, ["found_time"])


@query(f"WITH {E}, {P} SELECT p.signal, p.time, p.probe_id, e.time AS found_time, e.value FROM p ASOF JOIN e ON p.signal = e.signal AND p.time >= e.time")
def q09_value_at_or_error(spark, d):
    return events(spark, d).value_at(probes(spark, d), keep_missing=False)


@query(f"""WITH {L}, s AS (SELECT signal, time, arg_max(value, (s1, s2, s3)) AS value, count(*) AS elements FROM l GROUP BY signal, time),
n AS (SELECT *, lead(time) OVER (PARTITION BY signal ORDER BY time) AS next_time FROM s), f AS (SELECT signal, min(time) AS first_time FROM l GROUP BY signal),
p AS (SELECT o_orderkey AS probe_id, o_orderkey % 12 AS signal, epoch_us(o_orderdate) AS time FROM orders)
SELECT p.signal, p.time, p.probe_id, coalesce(n.time, -1) AS start_time, n.value, coalesce(n.elements, -1) AS elements, n.time = p.time AS time_match, coalesce(CASE WHEN n.time IS NULL THEN f.first_time ELSE n.next_time END, -1) AS next_time
FROM p ASOF LEFT JOIN n ON p.signal = n.signal AND p.time >= n.time LEFT JOIN f ON p.signal = f.signal""")
def q10_get_offset(spark, d):
    asked = table(spark, d, "orders").select((F.col("o_orderkey") % 12).alias("signal"), micros("o_orderdate").alias("time"), F.col("o_orderkey").alias("probe_id"))
    return items(spark, d).offsets(asked).fillna(-1, ["start_time", "elements", "next_time"])


@query(f"WITH {E} SELECT signal, min(time) AS first_time FROM e GROUP BY signal")
def q11_first_time(spark, d):
    return events(spark, d).first_times()


@query(f"WITH {EB}, {deduped('eb')}, t AS (SELECT row_number() OVER (ORDER BY time) - 1 AS time_idx, time FROM (SELECT DISTINCT time FROM eb)) SELECT signal, time_idx, time, value FROM d JOIN t USING (time)")
def q12_iter_changes(spark, d):
    log = events(spark, d, bit())
    return log.dedup().df.join(log.time_table(), "time").select("signal", "time_idx", "time", "value")


POS = "n AS (SELECT *, row_number() OVER w - 1 AS idx, row_number() OVER w - 1 - count(*) OVER (PARTITION BY signal) AS from_end FROM e WINDOW w AS (PARTITION BY signal ORDER BY time, seq))"


@query(f"WITH {E}, {POS} SELECT signal, time, value, idx FROM n WHERE idx >= 2 AND from_end < -3 AND (idx - 2) % 2 = 0")
def q13_slice(spark, d):
    return events(spark, d).slice(2, -3, 2).select("signal", "time", "value", "idx")


@query(f"WITH {E}, {POS} SELECT signal, time, value FROM n WHERE from_end = -2")
def q14_negative_index(spark, d):
    return events(spark, d).at(-2).select("signal", "time", "value")


@query(f"WITH {E} SELECT signal, count(*) AS n_changes FROM e GROUP BY signal")
def q15_length(spark, d):
    return events(spark, d).lengths()


@query(f"WITH {E}, b AS (SELECT min(time) + (max(time) - min(time)) // 4 AS lo, min(time) + (max(time) - min(time)) // 2 AS hi FROM e) SELECT signal, time, seq, value FROM e, b WHERE time BETWEEN lo AND hi")
def q16_time_filter(spark, d):
    log = events(spark, d)
    low, high = log.df.agg(F.min("time"), F.max("time")).first()
    return log.between(low + (high - low) // 4, low + (high - low) // 2).df


@query(f"WITH {E} SELECT signal, time, seq, value FROM e WHERE signal IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q17_signal_filter(spark, d):
    keys = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return events(spark, d).only(keys).df


STEPS = f"WITH {L}, dd AS (SELECT * FROM (SELECT *, lag(value) OVER w AS p FROM l WINDOW w AS (PARTITION BY signal ORDER BY time, s1, s2, s3)) WHERE value IS DISTINCT FROM p)"


@query(f"{STEPS} SELECT time, signal, arg_max(value, (s1, s2, s3)) AS value, count(*) AS transitions FROM dd GROUP BY time, signal")
def q18_time_steps(spark, d):
    return items(spark, d).time_steps()


@query(f"WITH {E}, t AS (SELECT min(time) + (max(time) - min(time)) // 2 AS mid FROM e) SELECT signal, arg_max(value, (time, seq)) AS value FROM e, t WHERE time <= mid GROUP BY signal")
def q19_snapshot(spark, d):
    log = events(spark, d)
    low, high = log.df.agg(F.min("time"), F.max("time")).first()
    return log.snapshot(low + (high - low) // 2)


@query(f"{STEPS} SELECT time, array_to_string(list_sort(list(DISTINCT signal)), ',') AS signals FROM dd GROUP BY time")
def q20_changed(spark, d):
    found = items(spark, d).changed()
    return found.select("time", F.array_join(F.transform("signals", lambda x: x.cast("string")), ",").alias("signals"))


@query("""WITH s AS (SELECT user_id AS file, event_id AS seq, floor(value / 10) AS time FROM events),
m AS (SELECT *, max(time) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
f AS (SELECT *, CASE WHEN m IS NULL OR time > m THEN 1 WHEN time < m THEN 0 END AS flag FROM m)
SELECT file, seq, time FROM (SELECT *, last_value(flag IGNORE NULLS) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM f) WHERE ok = 1""")
def q21_decreasing_time(spark, d):
    steps = table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 10).cast("double").alias("time"))
    return accepted_steps(steps, within=["file"])


def tree(spark, d) -> DataFrame:
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    a = region.select(F.col("r_regionkey").cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_regionkey").cast("int").alias("ord"), F.col("r_name").alias("name"), F.lit("scope").alias("kind"))
    b = nation.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("name"), F.lit("scope").alias("kind"))
    c = customer.select((F.col("c_custkey") + 1000).alias("id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"), F.col("c_custkey").cast("int").alias("ord"), F.col("c_name").alias("name"), F.lit("var").alias("kind"))
    return a.union(b).union(c)


H = """h AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, CAST(r_regionkey AS INT) AS ord, r_name AS name, 'scope' AS kind FROM region
UNION ALL SELECT n_nationkey + 100, n_regionkey, n_nationkey, n_name, 'scope' FROM nation UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, CAST(c_custkey AS INT), c_name, 'var' FROM customer)"""
HP = f"""WITH RECURSIVE {H}, w AS (SELECT id, parent_id, name, kind, name AS full_name, lpad(CAST(ord AS VARCHAR), 9, '0') AS key FROM h WHERE parent_id IS NULL
UNION ALL SELECT h.id, h.parent_id, h.name, h.kind, w.full_name || '.' || h.name, w.key || '.' || lpad(CAST(h.ord AS VARCHAR), 9, '0') FROM h JOIN w ON h.parent_id = w.id)"""


@query(f"{HP} SELECT id, full_name FROM w")
def q22_full_name(spark, d):
    return hierarchy.with_paths(tree(spark, d)).select("id", hierarchy.full_name(F.col("path")).alias("full_name"))


@query(f"{HP} SELECT id, row_number() OVER (ORDER BY key || '~') AS place FROM w")
def q23_all_items(spark, d):
    walked = numbered(hierarchy.post_order(tree(spark, d)).select("id", "key"), "key", "place")
    return walked.select("id", (F.col("place") + 1).alias("place"))


@query(f"WITH {H} SELECT id, name, kind FROM h WHERE parent_id = 2")
def q24_children(spark, d):
    return hierarchy.children(tree(spark, d), 2).select("id", "name", "kind")


@query(f"WITH {H} SELECT id, name, kind FROM h WHERE parent_id IS NULL")
def q24_top(spark, d):
    return hierarchy.top(tree(spark, d)).select("id", "name", "kind")


@query(f"{HP} SELECT id, full_name FROM w WHERE starts_with(full_name, (SELECT name FROM h WHERE id = 1) || '.')")
def q24_below(spark, d):
    nodes = tree(spark, d)
    name = nodes.filter("id = 1").first()["name"]
    return hierarchy.below(hierarchy.with_paths(nodes), [name]).select("id", hierarchy.full_name(F.col("path")).alias("full_name"))


@query(f"{HP} SELECT id, full_name FROM w WHERE id = 107")
def q25_lookup_scope(spark, d):
    pathed = hierarchy.with_paths(tree(spark, d))
    path = pathed.filter("id = 107").first()["path"]
    return hierarchy.lookup(pathed, path).select("id", hierarchy.full_name(F.col("path")).alias("full_name"))


@query("SELECT c_custkey AS id, c_name AS name, c_custkey % 32 AS msb, c_custkey % 8 AS lsb FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM customer)")
def q26_lookup_var_with_index(spark, d):
    variables = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.array("c_name").alias("path"), F.array("c_custkey").alias("ords"), (F.col("c_custkey") % 32).alias("msb"), (F.col("c_custkey") % 8).alias("lsb"))
    last = variables.orderBy(F.desc("id")).first()
    return hierarchy.lookup_var(variables, last["path"], last["msb"], last["lsb"]).select("id", F.col("c_name").alias("name"), "msb", "lsb")


@query("""WITH a AS (SELECT DISTINCT p_name AS word FROM part), n AS (SELECT p_partkey AS id, substr(p_name, 1, 1 + CAST(p_partkey % 9 AS INT)) AS name FROM part),
r AS (SELECT word, name, id, row_number() OVER (PARTITION BY word ORDER BY length(name) DESC, id) AS k FROM a JOIN n ON starts_with(word, name)) SELECT word, name, id FROM r WHERE k = 1""")
def q27_longest_prefix(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.col("p_partkey").alias("id"), F.substring(F.col("p_name"), F.lit(1), (1 + F.col("p_partkey") % 9).cast("int")).alias("name"))
    return hierarchy.longest_prefix(part.select(F.col("p_name").alias("word")).distinct(), names).select("word", "name", "id")


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_size, p_brand) AS kept FROM part")
def q28_scope_dedup(spark, d):
    scopes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("parent_id"), F.col("p_brand").alias("name"))
    return hierarchy.merge_equal_scopes(scopes)


@query(f"""WITH RECURSIVE {H}, u AS (SELECT id, parent_id, CASE WHEN id BETWEEN 100 AND 999 AND id % 3 = 0 THEN '' ELSE name END AS name FROM h),
w AS (SELECT id, name, parent_id AS up FROM u UNION ALL SELECT w.id, w.name, u.parent_id FROM w JOIN u ON w.up = u.id WHERE u.name = '')
SELECT w.id, w.name, coalesce(w.up, -1) AS parent_id FROM w LEFT JOIN u ON w.up = u.id WHERE w.name <> '' AND (w.up IS NULL OR u.name <> '')""")
def q29_flatten_unnamed(spark, d):
    nodes = tree(spark, d).select("id", "parent_id", F.when(F.col("id").between(100, 999) & (F.col("id") % 3 == 0), "").otherwise(F.col("name")).alias("name"))
    return hierarchy.flatten_unnamed(nodes).select("id", "name", "parent_id").fillna(-1, ["parent_id"])


NAMED = "CASE p_partkey % 4 WHEN 0 THEN p_name || '[' || p_size || ':' || (p_size % 7) || ']' WHEN 1 THEN p_name || ' [' || (p_size - 20) || ']' WHEN 2 THEN p_name || ' [ 7 : -' || p_size || ' ]' ELSE p_name END"


@query(rf"""WITH p AS (SELECT p_partkey AS id, {NAMED} AS raw FROM part), x AS (SELECT id, raw, regexp_extract(raw, '^(.*?)\s*\[\s*(-?\d+)\s*(?::\s*(-?\d+)\s*)?\]$', ['base', 'm', 'l']) AS g, regexp_matches(raw, '\]$') AS ok FROM p)
SELECT id, CASE WHEN ok THEN g.base ELSE raw END AS base, CASE WHEN ok THEN g.m ELSE '' END AS msb, CASE WHEN ok THEN CASE WHEN g.l = '' THEN g.m ELSE g.l END ELSE '' END AS lsb FROM x""")
def q30_parse_name(spark, d):
    named = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(NAMED).alias("raw"))
    base, msb, lsb = values.scalar_name(F.col("raw"))
    return named.select("id", base.alias("base"), msb.cast("string").alias("msb"), lsb.cast("string").alias("lsb")).fillna("")


@query("""WITH c AS (SELECT p_partkey AS id, chr(CAST(33 + p_partkey % 94 AS INT)) || CASE WHEN p_partkey % 3 > 0 THEN chr(CAST(33 + p_size % 94 AS INT)) ELSE '' END AS code FROM part)
SELECT id, CAST(ascii(code) - 33 + CASE WHEN length(code) > 1 THEN (ascii(substr(code, 2, 1)) - 32) * 94 ELSE 0 END AS BIGINT) AS number FROM c""")
def q31_id_number(spark, d):
    code = F.concat(F.chr((33 + F.col("p_partkey") % 94).cast("int")), F.when(F.col("p_partkey") % 3 > 0, F.chr((33 + F.col("p_size") % 94).cast("int"))).otherwise(""))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), values.id_number(code).cast("long").alias("number"))


ORDER_BITS = "lpad(CASE WHEN o_orderkey = 0 THEN '0' ELSE ltrim(format('{:b}', o_orderkey), '0') END, 20, '0')"


def order_bits():
    return values.leading(F.col("o_orderkey"), 20)


@query(f"SELECT o_orderkey AS id, {ORDER_BITS} AS bits FROM orders")
def q32_to_bits(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), order_bits().alias("bits"))


@query(f"SELECT o_orderkey AS id, substr({ORDER_BITS}, 20 - 11, 8) AS bits FROM orders")
def q33_slice_bits(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), values.slice_bits(order_bits(), 11, 4).alias("bits"))


@query(f"SELECT o_orderkey AS id, substr({ORDER_BITS}, 17, 4) || substr({ORDER_BITS}, 1, 4) AS bits FROM orders")
def q34_concat_bits(spark, d):
    bits = order_bits()
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), values.concat_bits(values.slice_bits(bits, 3, 0), values.slice_bits(bits, 19, 16)).alias("bits"))


@query("""WITH v AS (SELECT l_orderkey AS parent_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_returnflag AS name, 20 - 2 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + l_linenumber % 2 AS lsb FROM lineitem),
j AS (SELECT *, CASE WHEN lag(name) OVER w = name AND lag(lsb) OVER w - 1 = lsb + 1 THEN NULL ELSE ord END AS start FROM v WINDOW w AS (PARTITION BY parent_id ORDER BY ord))
SELECT parent_id, ord, name, last_value(start IGNORE NULLS) OVER (PARTITION BY parent_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM j""")
def q34b_bit_islands(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.row_number().over(w).cast("long").alias("ord"), F.col("l_returnflag").alias("name"), (20 - 2 * F.row_number().over(w) + F.col("l_linenumber") % 2).alias("lsb"))
    return hierarchy.bit_islands(v.withColumn("msb", F.col("lsb") + 1)).select("parent_id", "ord", "name", "island")


@query("""WITH a AS (SELECT o_custkey AS signal, epoch_us(o_orderdate) AS time, arg_max(CASE WHEN o_totalprice > 100000 THEN '1' ELSE '0' END, o_orderkey) AS v FROM orders GROUP BY ALL),
b AS (SELECT user_id AS signal, epoch_us(ts) AS time, arg_max(CASE WHEN value > 50 THEN '10' ELSE '01' END, event_id) AS v FROM events GROUP BY ALL),
m AS (SELECT signal, time, max(l) AS l, max(r) AS r FROM (SELECT signal, time, v AS l, NULL AS r FROM a UNION ALL SELECT signal, time, NULL, v FROM b) GROUP BY signal, time),
c AS (SELECT signal, time, coalesce(last_value(l IGNORE NULLS) OVER w, 'x') || coalesce(last_value(r IGNORE NULLS) OVER w, 'xx') AS value FROM m WINDOW w AS (PARTITION BY signal ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT signal, time, value FROM (SELECT *, lag(value) OVER (PARTITION BY signal ORDER BY time) AS p FROM c) WHERE value IS DISTINCT FROM p""")
def q35_derived_merge(spark, d):
    left = ChangeLog(table(spark, d, "orders").select(F.col("o_custkey").alias("signal"), micros("o_orderdate").alias("time"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_totalprice") > 100000, "1").otherwise("0").alias("value")))
    right = events(spark, d, F.when(F.col("value") > 50, "10").otherwise("01"))
    return derived.merge_keyed(left, right, 1, 2).df.select("signal", "time", "value")


@query("""WITH s AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END AS k, epoch_us(l_shipdate) AS time, arg_max(CASE WHEN l_quantity > 25 THEN '10' ELSE '01' END, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS v FROM lineitem GROUP BY ALL),
m AS (SELECT time, max(v) FILTER (k = 0) AS l, max(v) FILTER (k = 1) AS r FROM s GROUP BY time),
c AS (SELECT time, coalesce(last_value(l IGNORE NULLS) OVER w, 'xx') || substr(coalesce(last_value(r IGNORE NULLS) OVER w, 'xx'), 2, 1) AS value FROM m WINDOW w AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT time, value FROM (SELECT *, lag(value) OVER (ORDER BY time) AS p FROM c) WHERE value IS DISTINCT FROM p""")
def q35_derived_sliced(spark, d):
    """A concatenation of two signals with many changes each, evaluated in parts of time."""
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    log = ChangeLog(table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(1).alias("signal"), micros("l_shipdate").alias("time"), seq.alias("seq"), F.when(F.col("l_quantity") > 25, "10").otherwise("01").alias("value")), slices=6)
    return derived.Derived([derived.Extract(0, 1, 0), derived.Extract(1, 0, 0)]).evaluate(log)


NINE = "translate(substr(p_type, 1, 3) || CASE WHEN p_size % 2 = 0 THEN '01' ELSE 'X' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01xz01xzhu01xz01xzwl-01xz0')"


def nine():
    return F.translate(F.concat(F.substring("p_type", 1, 3), F.when(F.col("p_size") % 2 == 0, "01").otherwise("X")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01xz01xzhu01xz01xzwl-01xz0")


STATES = "CASE WHEN regexp_matches(s, '[huwl-]') THEN 2 WHEN regexp_matches(s, '[xz]') THEN 1 ELSE 0 END"


@query(f"SELECT p_partkey AS id, s, {STATES} AS states FROM (SELECT p_partkey, {NINE} AS s FROM part)")
def q36_states(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), nine().alias("s")).withColumn("states", values.states(F.col("s")))


@query(f"SELECT p_brand AS signal, max({STATES}) AS max_states FROM (SELECT p_brand, {NINE} AS s FROM part) GROUP BY p_brand")
def q37_max_states(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("signal"), nine().alias("s")).groupBy("signal").agg(values.states_of_set(F.col("s")).alias("max_states"))


TOKENS = "CASE p_partkey % 5 WHEN 0 THEN 'b0b101' WHEN 1 THEN 'bX' WHEN 2 THEN 'bz1' WHEN 3 THEN 'b1' ELSE 'b11110000' END"


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '00000101' WHEN 1 THEN 'xxxxxxxx' WHEN 2 THEN 'zzzzzzz1' WHEN 3 THEN '00000001' ELSE '11110000' END AS bits, CASE p_partkey % 5 WHEN 0 THEN '1' WHEN 1 THEN 'x' WHEN 2 THEN '1' WHEN 3 THEN '1' ELSE '0' END AS last_bit FROM part")
def q38_extend(spark, d):
    token = F.substring(F.expr(TOKENS), 2, 100)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), values.from_vcd(token, 8).alias("bits"), values.from_vcd(token, 1).alias("last_bit"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'x1' WHEN o_orderkey % 7 = 1 THEN '1' ELSE {ORDER_BITS} END AS bits FROM orders)
SELECT id, CASE WHEN id % 7 = 0 THEN -1 WHEN id % 7 = 1 THEN 1 ELSE id END AS whole, CASE WHEN id % 7 = 1 THEN TRUE END AS truth, CAST(CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN 1 ELSE id END AS DOUBLE) AS real FROM o""")
def q39_numbers(spark, d):
    whole = values.from_int(F.col("o_orderkey"), 63)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "x1").when(F.col("o_orderkey") % 7 == 1, "1").otherwise(whole).alias("bits"))
    bits = F.col("bits")
    return o.select("id", values.to_long(bits).cast("long").alias("whole"), values.to_bool(bits).alias("truth"), values.to_real(bits).alias("real")).fillna(-1, ["whole"])


@query(f"SELECT id, bit, substr(bits, 20 - CAST(bit AS INT), 1) AS state FROM (SELECT o_orderkey AS id, {ORDER_BITS} AS bits, unnest(range(0, 20)) AS bit FROM orders)")
def q40_get_bit(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), order_bits().alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("bit"))
    return o.select("id", F.col("bit").cast("long").alias("bit"), values.get_bit(F.col("bits"), F.col("bit")).alias("state"))


@query("SELECT o_orderkey AS id, o_orderstatus AS bits, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS label FROM orders")
def q41_enum_label(spark, d):
    enums = spark.sql("SELECT 1 AS enum_id, 'status' AS name, array(named_struct('value', 'F', 'label', 'finished'), named_struct('value', 'O', 'label', 'open')) AS mapping")
    found = table(spark, d, "orders").select(F.lit(1).alias("enum_id"), F.col("o_orderstatus").alias("bits"), F.col("o_orderkey").alias("id"))
    return hierarchy.with_labels(found, enums).select("id", "bits", "label")


@query("""SELECT p_partkey AS id, CAST(CASE (p_size - 21) - 3 * CAST(floor((p_size - 21) / 3.0) AS INT) WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END AS INT) AS factor,
CASE CAST(floor((p_size - 21) / 3.0) AS INT) WHEN -7 THEN 'zs' WHEN -6 THEN 'as' WHEN -5 THEN 'fs' WHEN -4 THEN 'ps' WHEN -3 THEN 'ns' WHEN -2 THEN 'us' WHEN -1 THEN 'ms' WHEN 0 THEN 's' ELSE 'unknown' END AS unit FROM part""")
def q42_timescale(spark, d):
    factor, unit = values.timescale(F.col("p_size") - 21)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), factor.alias("factor"), unit.alias("unit"))


@query(r"SELECT p_partkey AS id, replace(replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE chr(9) END), 'zzz', '') AS text FROM part")
def q43_unescape(spark, d):
    escape = F.when(F.col("p_partkey") % 4 == 0, r"\040").when(F.col("p_partkey") % 4 == 2, r"\x20").otherwise(r"\t")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), values.unescape(F.replace(F.col("p_name"), F.lit(" "), escape)).alias("text"))


@query("SELECT c_nationkey AS signal_id, array_to_string(list_sort(list(DISTINCT c_name)), ',') AS names FROM customer GROUP BY c_nationkey")
def q44_aliases(spark, d):
    variables = table(spark, d, "customer").select(F.col("c_nationkey").alias("signal_id"), F.col("c_name").alias("full_name"))
    return hierarchy.aliases(variables).select("signal_id", F.array_join("names", ",").alias("names"))


@query(f"WITH {E} SELECT signal, time, seq, value FROM e WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = signal)")
def q45_unknown_signals(spark, d):
    return events(spark, d).unknown(table(spark, d, "supplier").select("s_suppkey")).df


@query("""WITH a AS (SELECT o_custkey AS signal, epoch_us(o_orderdate) AS time, o_orderstatus AS value FROM orders), b AS (SELECT o_custkey AS signal, epoch_us(o_orderdate) AS time, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 13 > 0)
SELECT *, 'left' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'right' AS side FROM (FROM b EXCEPT ALL FROM a)""")
def q46_signal_diff(spark, d):
    log = orders(spark, d)
    other = ChangeLog(log.df.filter("seq % 13 > 0").withColumn("value", F.when(F.col("seq") % 11 == 0, "X").otherwise(F.col("value"))))
    return log.difference(other)


@query("SELECT time, time - coalesce(lag(time) OVER (ORDER BY time), 0) AS delta FROM (SELECT DISTINCT epoch_us(ts) AS time FROM events)")
def q47_delta_encode(spark, d):
    return delta_times(events(spark, d).times()).select("time", "delta")


@query("SELECT DISTINCT epoch_us(ts) AS time FROM events")
def q47_delta_round_trip(spark, d):
    return undelta_times(delta_times(events(spark, d).times()).drop("time"), "time_idx", span=100).select("time")


@query("SELECT o_custkey AS signal, count(*) AS n_changes, count(DISTINCT epoch_us(o_orderdate)) AS n_times, CAST(sum(strlen(o_orderstatus)) AS BIGINT) AS n_bytes, max(strlen(o_orderstatus)) AS widest FROM orders GROUP BY o_custkey")
def q48_statistics(spark, d):
    return orders(spark, d).statistics()


@query("SELECT block, min(time) AS start_time, count(*) AS n_times FROM (SELECT (row_number() OVER (ORDER BY time) - 1) // 100 AS block, time FROM (SELECT DISTINCT epoch_us(ts) AS time FROM events)) GROUP BY block")
def q49_blocks(spark, d):
    t = events(spark, d).time_table()
    return t.groupBy(F.floor(F.col("time_idx") / 100).alias("block")).agg(F.min("time").alias("start_time"), F.count("*").alias("n_times"))


@query("SELECT p_partkey AS id, substr('ux01zwlh-', CAST(p_size % 9 AS INT) + 1, 1) AS state FROM part")
def q50_std_logic(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), values.std_logic(F.col("p_size") % 9).alias("state"))


@query("""WITH b AS (SELECT user_id AS signal, epoch_us(ts) // 3600000000 AS time, event_id AS seq, event_id % 4 AS bit, CASE WHEN value > 50 THEN '1' ELSE '0' END AS v FROM events),
x AS (SELECT signal, time, bit, arg_max(v, seq) AS v FROM b GROUP BY ALL),
p AS (SELECT signal, time, max(v) FILTER (bit = 0) AS b0, max(v) FILTER (bit = 1) AS b1, max(v) FILTER (bit = 2) AS b2, max(v) FILTER (bit = 3) AS b3 FROM x GROUP BY signal, time)
SELECT signal, time, coalesce(last_value(b3 IGNORE NULLS) OVER w, 'u') || coalesce(last_value(b2 IGNORE NULLS) OVER w, 'u') || coalesce(last_value(b1 IGNORE NULLS) OVER w, 'u') || coalesce(last_value(b0 IGNORE NULLS) OVER w, 'u') AS value FROM p WINDOW w AS (PARTITION BY signal ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q51_bits_to_vector(spark, d):
    bits = table(spark, d, "events").select(F.col("user_id").alias("signal"), F.floor(micros("ts") / 3_600_000_000).alias("time"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("bit"), F.when(F.col("value") > 50, "1").otherwise("0").alias("value"))
    return derived.assemble_bits(bits, 4)


@query(f"WITH {E} SELECT DISTINCT time FROM e")
def q52_chunk_union(spark, d):
    log = events(spark, d)
    first, second = (ChangeLog(log.df.filter(f)) for f in ("seq <= 400", "seq >= 400"))
    return first.union(second).times()


HEADER = "$timescale 1us $end\n$scope module events $end\n$var wire 1 ! over $end\n$upscope $end\n$enddefinitions $end"


def vcd_text(rows: DataFrame) -> DataFrame:
    """(signal, time, seq, value): the lines of a VCD file for each signal of bits, the header first."""
    lines = rows.select("signal", "time", "seq", F.concat(F.lit("#"), F.col("time").cast("string"), F.lit("\n"), F.col("value"), F.lit("!")).alias("value"))
    heads = rows.select("signal").distinct().select("signal", F.lit(-1).cast("bigint").alias("time"), F.lit(-1).cast("bigint").alias("seq"), F.lit(HEADER).alias("value"))
    return lines.union(heads)


def write_vcd(text: DataFrame, path: str) -> None:
    """A file for each signal, all in one folder, written one after another by the task that holds the signals' lines."""
    path = path.removeprefix("file:")
    vcd_source.made(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = 0
        runs = ((s, v) for b in batches for s, v in vcd_source.runs(b.column(0), b.column(1)))
        for signal, lines in groupby(runs, lambda run: run[0]):
            vcd_source.put(f"{path}/signal={signal}.txt", (v.encode() for _, v in lines))
            files += 1
        yield pa.RecordBatch.from_pydict({"n": [files]})

    files = text.repartition("signal").sortWithinPartitions("signal", "time", "seq").select("signal", F.concat("value", F.lit("\n")).alias("value"))
    files.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def vcd_files(spark, d) -> str:
    """Each user's log, written as a VCD file; their folder."""
    path = f"{shared_dir(spark)}/tracetide/vcd-{uuid.uuid4().hex}"
    write_vcd(vcd_text(events(spark, d, bit()).df), path)
    return path


@query(f"WITH {EB} SELECT signal, time, value FROM eb")
def q54_vcd_round_trip(spark, d):
    """Each user's log is written as a VCD file and read back."""
    read = VcdFiles(spark, vcd_files(spark, d)).changes()
    return read.select(F.regexp_extract("file", r"signal=(\d+)", 1).cast("bigint").alias("signal"), "time", F.col("bits").alias("value"))


def written(spark: SparkSession, rows: DataFrame, key: str, suffix: str, content) -> str:
    """A folder of files, one for each key, written one after another by the tasks that hold the keys' rows.

    content(times, seqs, values) makes bytes of a key's rows in the order of (time, seq).
    """
    folder = f"{shared_dir(spark)}/tracetide/{suffix}-{uuid.uuid4().hex}".removeprefix("file:")
    vcd_source.made(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = 0
        pieces = ((b.column(0)[i].as_py(), [b.column(c)[i:j].to_pylist() for c in (1, 2, 3)]) for b in batches for i, j in vcd_source.stretches(b.column(0)))
        for k, of in groupby(pieces, lambda piece: piece[0]):
            times, seqs, values = ([x for part in c for x in part] for c in zip(*(own for _, own in of), strict=True))
            vcd_source.put(f"{folder}/{k}.{suffix}", [content(times, seqs, values)])
            files += 1
        yield pa.RecordBatch.from_pydict({"n": [files]})

    ordered = rows.repartition(key).sortWithinPartitions(key, "time", "seq").select(key, "time", "seq", "value")
    ordered.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return folder


def user_of(file: str = "file"):
    return F.regexp_extract(file, r"(\d+)\.\w+$", 1).cast("bigint")


def as_ghw(times: list[int], seqs: list[int], values: list[str]) -> bytes:
    """Every event is a cycle: it sets the bit `over` and one element of the vector q."""
    return writers.ghw("events", "over", "q", 4, [(t, [(0, v), (1 + s % 4, v)]) for t, s, v in zip(times, seqs, values, strict=True)])


@query(f"""WITH {EB}, q AS (SELECT *, seq % 4 AS k, min(time) OVER (PARTITION BY signal) AS begin FROM eb),
v AS (SELECT signal, time, seq, lead(time) OVER s AS next, lead(k) OVER s AS next_k, lead(value) OVER s AS next_value, value, begin,
  coalesce(last_value(CASE WHEN k = 0 THEN value END IGNORE NULLS) OVER s, 'u') || coalesce(last_value(CASE WHEN k = 1 THEN value END IGNORE NULLS) OVER s, 'u') || coalesce(last_value(CASE WHEN k = 2 THEN value END IGNORE NULLS) OVER s, 'u') || coalesce(last_value(CASE WHEN k = 3 THEN value END IGNORE NULLS) OVER s, 'u') AS bits
  FROM q WINDOW s AS (PARTITION BY signal ORDER BY time, seq))
SELECT signal, 'events.over' AS full_name, time, value AS bits FROM eb UNION ALL SELECT signal, 'events.over', min(time), 'u' FROM eb GROUP BY signal
UNION ALL SELECT signal, 'events.q', time, bits FROM v WHERE next IS DISTINCT FROM time UNION ALL SELECT signal, 'events.q', min(time), 'uuuu' FROM eb GROUP BY signal""")
def q55_ghw(spark, d):
    """Each user's log is written as a GHW file and read back: a bit, and a vector put together from its elements."""
    rows = events(spark, d, bit()).df
    waves = GhwFiles(spark, written(spark, rows, "signal", "ghw", as_ghw))
    found = waves.changes().join(waves.table("vars").select("file", "signal_id", "full_name"), ["file", "signal_id"])
    return found.select(user_of().alias("signal"), "full_name", "time", "bits")


def as_fst(times: list[int], seqs: list[int], values: list[str]) -> bytes:
    """Two variables: the events with even and with odd numbers."""
    index = {t: k for k, t in enumerate(dict.fromkeys(times))}
    own = [[(index[t], int(v)) for t, s, v in zip(times, seqs, values, strict=True) if s % 2 == odd] for odd in (0, 1)]
    return writers.fst("events", ["even", "odd"], list(index), own)


@query(f"""WITH {EB} SELECT signal, CASE WHEN seq % 2 = 0 THEN 'events.even' ELSE 'events.odd' END AS full_name, time, value AS bits FROM eb
UNION ALL SELECT signal, n, min(time), 'x' FROM eb, (VALUES ('events.even'), ('events.odd')) t(n) GROUP BY signal, n""")
def q56_fst(spark, d):
    """Each user's log is written as an FST file and read back; x is the value before the first change."""
    waves = FstFiles(spark, written(spark, events(spark, d, bit()).df, "signal", "fst", as_fst))
    found = waves.changes().join(waves.table("vars").select("file", "signal_id", "full_name"), ["file", "signal_id"])
    return found.select(user_of().alias("signal"), "full_name", "time", "bits")


LINES = f"lines AS (SELECT signal, strlen('#' || time || chr(10) || value || '!') + 1 AS bytes FROM eb UNION ALL SELECT DISTINCT signal, strlen('{HEADER}') + 1 FROM eb)"


@query(f"""WITH {EB}, {LINES}, parts AS (SELECT unnest(range(0, 3)) AS piece)
SELECT piece, (SELECT count(DISTINCT signal) FROM eb WHERE signal % 3 <= piece) AS files, CAST((SELECT sum(bytes) FROM lines WHERE signal % 3 <= piece) AS BIGINT) AS bytes,
(SELECT count(*) FROM eb WHERE signal % 3 <= piece) AS steps, (SELECT count(*) FROM eb WHERE signal % 3 <= piece) AS changes FROM parts""")
def q70_progress(spark, d):
    """Users' VCD files that come in three parts, followed as one stream: bytes, steps and changes read so far, after each."""
    vcd_source.register(spark)
    path = f"{shared_dir(spark)}/tracetide/progress-{uuid.uuid4().hex}"
    text = vcd_text(events(spark, d, bit()).df)
    progress, told = StreamProgress(), []
    spark.streams.addListener(progress)
    try:
        for k in range(3):
            write_vcd(text.filter(F.col("signal") % 3 == k), f"{path}/in")
            rows = spark.readStream.format("vcd").option("complete", "true").load(f"{path}/in")
            running = progress.counted(rows).writeStream.format("noop").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            running.awaitTermination()
            told.append((k, *progress.wait(running.runId)))
    finally:
        spark.streams.removeListener(progress)
    return spark.createDataFrame(told, "piece bigint, files bigint, bytes bigint, steps bigint, changes bigint")


@query(f"""WITH {EB}, {deduped('eb')}, u AS (SELECT DISTINCT signal FROM eb WHERE signal IN (SELECT signal FROM eb ORDER BY signal LIMIT 1))
SELECT 'change' AS what, time, value FROM d JOIN u USING (signal)
UNION ALL SELECT 'length', CAST(count(*) AS BIGINT), '' FROM d JOIN u USING (signal)
UNION ALL SELECT 'first', min(time), arg_min(value, time) FROM d JOIN u USING (signal)
UNION ALL SELECT 'at', max(time), arg_max(value, time) FROM d JOIN u USING (signal)
UNION ALL SELECT 'variable', 1, 'events.over'""")
def q59_objects(spark, d):
    """The first user's log as a VCD file, asked through objects."""
    log = events(spark, d, bit())
    first = log.df.agg(F.min("signal")).first()[0]
    own = log.df.filter(F.col("signal") == first)
    text = lambda times, _, values: (HEADER + "\n" + "".join(f"#{t}\n{v}!\n" for t, v in zip(times, values, strict=True))).encode()
    wave = Waveform(spark, f"{written(spark, own, 'signal', 'vcd', text)}/{first}.vcd")
    var = wave["events.over"]
    signal = var.signal
    changes = signal.log.df.select(F.lit("change").alias("what"), "time", "value")
    time, value = signal[0]
    last = signal[-1][0]
    told = [("length", len(signal), ""), ("first", time, str(value)), ("at", last, str(var[last])), ("variable", len(wave.all_vars()), var.full_name)]
    return changes.union(spark.createDataFrame(told, "what string, time bigint, value string"))


@query("SELECT * FROM (VALUES ('vcd', 'vcd'), ('ghw', 'ghw'), ('fst', 'fst'), ('parquet', 'unknown')) t(name, file_format)")
def q53_detect(spark, d):
    """Files of each format, told by their first bytes."""
    rows = events(spark, d, bit()).df
    user = rows.agg(F.min("signal")).first()[0]
    first = rows.filter(F.col("signal") == user)
    made = [("ghw", as_ghw), ("fst", as_fst), ("vcd", lambda *_: f"{HEADER}\n#0\n0!\n".encode())]
    kinds = [(kind, file_format(spark, f"{written(spark, first, 'signal', kind, content)}/{user}.{kind}")) for kind, content in made]
    kinds.append(("parquet", file_format(spark, table(spark, d, "events").inputFiles()[0])))
    return spark.createDataFrame(kinds, "name string, file_format string")


@query("""WITH s AS (SELECT user_id AS file, event_id AS seq, event_id % 3 AS signal, CAST(floor(value / 10) AS BIGINT) AS time, event_type, value FROM events),
m AS (SELECT *, max(time) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
f AS (SELECT *, CASE WHEN m IS NULL OR time > m THEN 1 WHEN time < m THEN 0 END AS flag FROM m),
a AS (SELECT * FROM (SELECT *, last_value(flag IGNORE NULLS) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM f) WHERE ok = 1)
SELECT file, seq, time, CASE signal WHEN 0 THEN 'events.code' WHEN 1 THEN 'events.kind' ELSE 'events.value' END AS full_name,
CASE WHEN signal > 0 THEN '' WHEN seq % 7 = 0 THEN 'xxxx' ELSE lpad(bin(seq % 8), 4, '0') END AS bits, CASE WHEN signal = 1 THEN event_type ELSE '' END AS str, CASE WHEN signal = 2 THEN value ELSE -1 END AS real FROM a""")
def q57_builder(spark, d):
    """A catalog made in a program, and every event encoded by it: a vector, a string and a number, each user a file."""
    b = HierarchyBuilder(spark)
    b.push_scope("events")
    b.add_var("code", b.new_signal("bits", 4), msb=3, lsb=0)
    b.add_var("kind", b.new_signal("string"))
    b.add_var("value", b.new_signal("real"))
    made = b.finish()
    number, signal = F.col("event_id"), F.col("event_id") % 3
    value = F.when(signal == 1, F.col("event_type")).when(signal == 2, F.col("value").cast("string")).when(number % 7 == 0, "X").otherwise(F.bin(number % 8))
    rows = table(spark, d, "events").select(F.col("user_id").alias("file"), number.alias("seq"), signal.alias("signal_id"), F.floor(F.col("value") / 10).cast("bigint").alias("time"), value.alias("value"))
    found = encoded(rows, made["signals"]).join(F.broadcast(made["vars"].select("signal_id", "full_name")), "signal_id")
    return found.select("file", "seq", "time", "full_name", "bits", "str", "real").fillna("", ["bits", "str"]).fillna(-1.0, ["real"])


@query(f"WITH {EB}, {deduped('eb')} SELECT * FROM d")
def q58_streaming(spark, d):
    """q03 as a stream."""
    static = table(spark, d, "events")
    folder, _, name = static.inputFiles()[0].rpartition("/")  # the table is a file or a folder of files
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", name if name == "events.parquet" else "*.parquet").parquet(folder)
    changes = stream.select(F.col("user_id").alias("signal"), micros("ts").alias("time"), F.col("event_id").alias("seq"), bit().alias("value"))
    path = f"{shared_dir(spark)}/tracetide/stream-{uuid.uuid4().hex}"
    return steps.run_available(steps.real_changes(changes), f"{path}/out", f"{path}/state")


def grown(rows: DataFrame, piece, pieces: int, **options) -> LiveLog:
    """rows (file, signal, time, seq, value) as a folder that is appended to piece by piece, and taken by a stream after each."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/tracetide/grown-{uuid.uuid4().hex}"
    for k in range(pieces):
        rows.filter(piece == k).write.mode("append").parquet(f"{folder}/in")
        live = LiveLog(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/live", **options).run()
    return live


def item_rows(spark, d, signal, value) -> DataFrame:
    seq = F.struct(micros("l_shipdate").alias("time"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select(F.lit("").alias("file"), signal.alias("signal"), micros("l_shipdate").alias("time"), seq.alias("seq"), value.cast("string").alias("value"))


def inside_times(rows: DataFrame, pieces: int):
    """The piece of a row: cuts lie inside a time, before and after an order number."""
    times, order = rows.agg(F.percentile_approx("time", F.array(*[F.lit(i / pieces) for i in range(1, pieces)])), F.percentile_approx("seq.l_orderkey", F.lit(0.5))).first()
    time, number = F.col("time"), F.col("seq.l_orderkey")
    return sum((((time > t) | ((time == t) & (number > order))).cast("int") for t in times or []), F.lit(0))


def file_user():
    return F.regexp_extract("file", r"signal=(\d+)", 1).cast("bigint").alias("user")


@query(f"WITH {EB}, b AS (SELECT min(time) + (max(time) - min(time)) // 4 AS lo, min(time) + (max(time) - min(time)) // 2 AS hi FROM eb) SELECT signal AS user, time, value FROM eb, b WHERE time BETWEEN lo AND hi")
def q63_vcd_source(spark, d):
    """Users' VCD files through the registered source; the times' bounds reach the reader."""
    vcd_source.register(spark)
    files = vcd_files(spark, d)
    low, high = events(spark, d).df.agg(F.min("time"), F.max("time")).first()
    rows = spark.read.format("vcd").load(files).filter(F.col("time").between(low + (high - low) // 4, low + (high - low) // 2))
    log = vcd_source.valued(rows, spark.read.format("vcd").option("table", "signals").load(files))
    return log.filter("signal is not null").select(file_user(), "time", "value")


@query(f"WITH {EB}, {deduped('eb')} SELECT signal AS user, time, arg_max(value, seq) AS value, count(*) AS transitions FROM d GROUP BY signal, time")
def q64_vcd_stream(spark, d):
    """The same files as a stream of byte ranges: time steps of each."""
    vcd_source.register(spark)
    files = vcd_files(spark, d)
    stream = spark.readStream.format("vcd").option("complete", "true").load(files)
    signals = spark.read.format("vcd").option("table", "signals").load(files)
    live = LiveLog(vcd_source.valued(stream, signals), f"{shared_dir(spark)}/tracetide/live-{uuid.uuid4().hex}").run()
    return live.steps().select(file_user(), "time", "value", "transitions")


@query(f"{STEPS} SELECT time, signal, arg_max(value, (s1, s2, s3)) AS value, count(*) AS transitions FROM dd GROUP BY time, signal")
def q60_live_steps(spark, d):
    """q18 over a stream that was cut three times inside a time: each step is told once."""
    rows = item_rows(spark, d, F.col("l_suppkey"), F.col("l_quantity"))
    live = grown(rows, inside_times(rows, 4), 4)
    return live.steps().select("time", "signal", F.col("value").cast("double").alias("value"), "transitions")


@query("""WITH s AS (SELECT user_id AS file, event_id AS seq, CAST(floor(value / 10) AS BIGINT) AS time FROM events),
m AS (SELECT *, max(time) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
f AS (SELECT *, CASE WHEN m IS NULL OR time > m THEN 1 WHEN time < m THEN 0 END AS flag FROM m)
SELECT file, seq % 3 AS signal, seq, time FROM (SELECT *, last_value(flag IGNORE NULLS) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM f) WHERE ok = 1""")
def q61_live_late(spark, d):
    """q21 over a stream: what one signal's times say of late steps holds for the file's other signals, over all pieces."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 3).alias("signal"), F.floor(F.col("value") / 10).cast("bigint").alias("time"), F.col("event_id").alias("seq"), F.lit("").alias("value"))
    cuts = rows.agg(F.percentile_approx("seq", F.array(F.lit(0.3), F.lit(0.7)))).first()[0] or []
    live = grown(rows, sum(((F.col("seq") > c).cast("int") for c in cuts), F.lit(0)), 3, raw=True)
    return live.changes().select("file", "signal", "seq", "time")


@query("""WITH s AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END AS k, epoch_us(l_shipdate) AS time, arg_max(CASE WHEN l_quantity > 25 THEN '10' ELSE '01' END, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS v FROM lineitem GROUP BY ALL),
m AS (SELECT time, max(v) FILTER (k = 0) AS l, max(v) FILTER (k = 1) AS r FROM s GROUP BY time),
c AS (SELECT time, coalesce(last_value(l IGNORE NULLS) OVER w, 'xx') || substr(coalesce(last_value(r IGNORE NULLS) OVER w, 'xx'), 2, 1) AS value FROM m WINDOW w AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT time, value FROM (SELECT *, lag(value) OVER (ORDER BY time) AS p FROM c) WHERE value IS DISTINCT FROM p""")
def q62_live_derived(spark, d):
    """q35_derived_sliced over a stream: the derived signal follows the ground changes of a time, whatever piece they came in."""
    rows = item_rows(spark, d, F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(1), F.when(F.col("l_quantity") > 25, "10").otherwise("01"))
    parts = spark.createDataFrame([("", 9, 0, 0, 1, 0), ("", 9, 1, 1, 0, 0)], "file string, signal int, pos int, input int, msb int, lsb int")
    live = grown(rows, inside_times(rows, 3), 3, derived=parts)
    return live.steps().filter("signal = 9").select("time", "value")


@query(f"""{HP}, n AS (SELECT id, kind, full_name, CASE WHEN kind = 'scope' THEN full_name WHEN id % 4 = 0 THEN full_name WHEN id % 4 = 1 THEN full_name || '[1:0]' WHEN id % 4 = 2 THEN full_name || 'XYZ' ELSE replace(full_name, '.', '.no') END AS name FROM w)
SELECT name, coalesce(max(CASE WHEN kind = 'var' AND id % 4 = 3 THEN -1 ELSE id END), -1) AS id FROM n GROUP BY name""")
def q67_resolve(spark, d):
    """Names of scopes and variables, with an index or other text at their end, and names that lead nowhere."""
    nodes = tree(spark, d)
    full = hierarchy.with_paths(nodes).select("id", "kind", hierarchy.full_name(F.col("path")).alias("full"))
    rest = F.when(F.col("id") % 4 == 0, F.col("full")).when(F.col("id") % 4 == 1, F.concat("full", F.lit("[1:0]"))).when(F.col("id") % 4 == 2, F.concat("full", F.lit("XYZ"))).otherwise(F.replace("full", F.lit("."), F.lit(".no")))
    names = full.select(F.when(F.col("kind") == "scope", F.col("full")).otherwise(rest).alias("name"))
    return hierarchy.resolve(names, nodes).select("name", "id").fillna(-1, ["id"])


WIDE = 6
WIDE_FACTOR = sum(1 << 20 * i for i in range(WIDE))


@query(f"SELECT o_orderkey AS id, CAST(CAST(o_orderkey AS HUGEINT) * CAST('{WIDE_FACTOR}' AS HUGEINT) AS VARCHAR) AS number FROM orders")
def q65_wide_numbers(spark, d):
    """Vectors of 120 bits and more as decimal numbers."""
    bits = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), values.side_by_side(F.col("o_orderkey"), 20, WIDE).alias("bits"))
    return bits.select("id", values.number_text(F.col("bits")).alias("number"))


@query(f"""WITH {L}, a AS (SELECT signal, time, value, row_number() OVER (PARTITION BY signal ORDER BY time, s1, s2, s3) - 1 AS idx FROM l),
b AS (SELECT signal, time, value, row_number() OVER (PARTITION BY signal ORDER BY time, CASE WHEN signal % 5 = 0 THEN -s1 ELSE s1 END, s2, s3) - 1 AS idx FROM l WHERE signal <> 3 OR s1 % 2 = 0)
SELECT coalesce(a.signal, b.signal) AS signal, coalesce(a.idx, b.idx) AS idx, coalesce(a.time, -1) AS left_time, a.value AS left_value, coalesce(b.time, -1) AS right_time, b.value AS right_value
FROM a FULL JOIN b ON a.signal = b.signal AND a.idx = b.idx WHERE (a.time, a.value) IS DISTINCT FROM (b.time, b.value) OR (a.idx IS NULL) <> (b.idx IS NULL)""")
def q66_ordered_difference(spark, d):
    """Two logs that hold the changes of a time in another order for every fifth signal; one signal lacks changes."""
    log = items(spark, d)
    number = F.col("seq.l_orderkey")
    seq = F.struct(F.when(F.col("signal") % 5 == 0, -number).otherwise(number).alias("l_orderkey"), "seq.l_linenumber", "seq.l_partkey")
    other = ChangeLog(log.df.filter((F.col("signal") != 3) | (number % 2 == 0)).withColumn("seq", seq))
    return log.ordered_difference(other).fillna(-1, ["left_time", "right_time"])


def appended(rows: DataFrame, piece, pieces: int) -> KeptLog:
    """rows (signal, time, seq, value) as a kept log that was appended to piece by piece."""
    rows = materialize(rows.withColumn("piece", piece), "pieces")
    log = KeptLog.create(rows.sparkSession, f"{shared_dir(rows.sparkSession)}/tracetide/kept-{uuid.uuid4().hex}", rows, buckets=16)
    for k in range(pieces):
        log.append(rows.filter(F.col("piece") == k))
    return log


@query(f"""WITH s AS (SELECT user_id AS signal, event_id AS seq, event_id // 5 - CASE WHEN event_id % 11 = 0 THEN 3 ELSE 0 END AS time, CASE WHEN value > 100 THEN '1' ELSE '0' END AS value FROM events),
m AS (SELECT *, max(time) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
f AS (SELECT *, CASE WHEN m IS NULL OR time > m THEN 1 WHEN time < m THEN 0 END AS flag FROM m),
a AS (SELECT signal, time, seq, value FROM (SELECT *, last_value(flag IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM f) WHERE ok = 1),
t AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS time_idx FROM (SELECT DISTINCT time FROM a)), {deduped('a')}
SELECT signal, time, seq, value, time_idx FROM d JOIN t USING (time)""")
def q68_appended(spark, d):
    """One log with steps that go back in time, written by three appends: real changes and the numbers of their times."""
    number = F.col("event_id")
    time = F.floor(number / 5) - F.when(number % 11 == 0, 3).otherwise(0)
    rows = table(spark, d, "events").select(F.col("user_id").alias("signal"), time.cast("bigint").alias("time"), number.alias("seq"), bit().alias("value"))
    cuts = rows.agg(F.percentile_approx("seq", F.array(F.lit(0.3), F.lit(0.7)))).first()[0] or []
    log = appended(rows, sum(((F.col("seq") > c).cast("int") for c in cuts), F.lit(0)), 3)
    return log.changes().join(log.time_table(), "time").select("signal", "time", "seq", "value", "time_idx")


@query(f"WITH {EB}, {deduped('eb')}, {P} SELECT p.signal, p.time, p.probe_id, coalesce(d.time, -1) AS found_time, d.value FROM p ASOF LEFT JOIN d ON p.signal = d.signal AND p.time >= d.time")
def q69_kept_value_at(spark, d):
    """As-of lookups in a kept log, appended to twice inside the times of the events."""
    rows = events(spark, d, bit()).df.withColumn("seq", F.struct("time", "seq"))
    middle = rows.agg(F.percentile_approx("time", F.lit(0.5))).first()[0]
    log = appended(rows, (F.col("time") > (middle or 0)).cast("int"), 2)
    return log.value_at(probes(spark, d)).fillna(-1, ["found_time"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
