"""The registered queries of the numbered operators and their SQL, where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm import bloom_lm as op7
from tracetide.llm import cross_polytope as op2
from tracetide.llm import decontaminate as op5
from tracetide.llm import filter_audit as op11
from tracetide.llm import heap_bpe as op4
from tracetide.llm import html_crf as op10
from tracetide.llm import line_dedup as op12
from tracetide.llm import packing as op3
from tracetide.llm import page_samples
from tracetide.llm import sharding as op9
from tracetide.llm import simhash as op1
from tracetide.llm import suffixes as op8
from tracetide.llm import toxicity as op6
from tracetide.llm import vector_file as op13
from tracetide.llm.common import shared_dir, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op5.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", op1.hex_digits().alias("fingerprint"), "component_id")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return op2.search(vectors, vectors.filter("vec_id % 50 = 0"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def _held_out(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2


def toxicity_lexicon(spark: SparkSession, sf_dir: str) -> op6.Lexicon:
    """Learnt from the labelled rows of the table that are not held out."""
    return op6.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~_held_out(4)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = op6.score(docs, toxicity_lexicon(spark, sf_dir), name="score")
    return scored.select("doc_id", F.coalesce(_held_out(4), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.score(table(spark, sf_dir, "documents"), _held_out(7))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8.removed(table(spark, sf_dir, "documents"))
    doc_id = F.when(F.col("id") != op8.NO_ID, F.col("id")).alias("doc_id")
    return found.select(doc_id, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = op4.count_tokens(docs, tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


#: Arrivals of op9_sharding; with a fan of 4 the first tier fills, and merges, twice and more.
ARRIVALS = 9


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in nine arrivals, by a hash of id and text; what the latest version holds is read back whole.

    shards_merged: the latest version has fewer runs than there were arrivals.
    """
    docs = table(spark, sf_dir, "documents")
    n = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ARRIVALS))
    store = op9.shard(spark, [docs.filter(n == i) for i in range(ARRIVALS)], f"{shared_dir(spark)}/tracetide/store-{uuid.uuid4().hex}", keep=2)
    runs = store.runs()
    text = F.coalesce("text", F.lit(""))
    held = store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    counted = held.groupBy(*held.columns).agg(F.count("*").alias("n_rows"))
    return counted.withColumn("shards_merged", F.lit(len(runs) < ARRIVALS))


@cache
def page_model() -> op10.Field:
    return op10.train(op10.training_set(page_samples.pages(900, seed=1), page_samples.SIGN))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = op10.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), page_model())
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op12.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return op13.mine(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op10_html_text": op10_html_text, "op11_filter_audit": op11_filter_audit, "op12_line_dedup": op12_line_dedup, "op13_hard_negatives": op13_hard_negatives, "op4_token_counts": op4_token_counts, "op1_simhash": op1_simhash, "op2_neighbours": op2_neighbours, "op3_packing": op3_packing, "op5_decontaminate": op5_decontaminate, "op6_toxicity": op6_toxicity, "op7_lm_scores": op7_lm_scores, "op8_suffixes": op8_suffixes, "op9_sharding": op9_sharding}


OP5_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM bl)),
ks AS (SELECT DISTINCT k FROM win),
cand AS (SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw CROSS JOIN ks WHERE len(w) >= k)),
hit AS (SELECT r, cand.k, s, item_id FROM cand JOIN win ON cand.k = win.k AND cand.win = win.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM hit WHERE item_id IS NOT NULL GROUP BY r)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN pos ON dw.r = pos.r LEFT JOIN its ON dw.r = its.r
"""


OP8_SQL = """
WITH h AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
o AS (SELECT *, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, x) AS d FROM h),
w AS (SELECT DISTINCT d, doc_id, s, substr(x, 2 * s + 1, 200) AS win FROM (SELECT d, doc_id, x, unnest(range(0, n - 99)) AS s FROM o WHERE n >= 100)),
late AS (SELECT d, s FROM (SELECT d, s, row_number() OVER (PARTITION BY win ORDER BY d, s) AS k FROM w) WHERE k > 1),
edge AS (SELECT d, s, CASE WHEN s <= lag(s) OVER (PARTITION BY d ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM late),
span AS (SELECT d, min(s) AS a, max(s) + 100 AS b FROM (SELECT d, s, sum(new) OVER (PARTITION BY d ORDER BY s) AS run FROM edge) GROUP BY d, run),
gap AS (SELECT d, coalesce(lag(b) OVER (PARTITION BY d ORDER BY a), 0) AS f, a AS t FROM span UNION ALL SELECT d, max(b), 1000000000 FROM span GROUP BY d),
texts AS (SELECT DISTINCT d, x FROM o),
kept AS (SELECT gap.d, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS kx FROM gap JOIN texts USING (d) GROUP BY gap.d),
cut AS (SELECT d, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY d)
SELECT o.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kx, x))) AS kept_sha256
FROM o LEFT JOIN cut USING (d) LEFT JOIN kept USING (d)
"""

OP9_SQL = """
SELECT doc_id, lang, source, n_chars, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, count(*) AS n_rows, true AS shards_merged
FROM documents GROUP BY doc_id, lang, source, n_chars, n_bytes, text_sha256
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM d),
m AS (SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS i), letters AS (SELECT i, 'ABCDE'[i] AS x FROM l),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS ix FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
st AS (SELECT filter_order, CAST(i AS INT) AS step, ix[i] AS own, ix[1 : i - 1] AS before FROM o, l),
z AS (SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS here, len(list_filter(before, lambda k: fails[k])) > 0 AS earlier, len(list_filter(fails, lambda k: k)) = 1 AS alone FROM m, st),
g AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (here AND alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (here AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT earlier), 0) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) + CAST(count(*) > count(doc_id) AS INT) >= 5),
g AS (SELECT r, doc_id, pos, line, f.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY r, doc_id
"""


OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND len(a.v) = len(r.v) AND (a.label <> r.label OR a.vec_id <> r.vec_id)),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score
FROM (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score) WHERE k <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5_SQL, "op8_suffixes": OP8_SQL, "op9_sharding": OP9_SQL, "op11_filter_audit": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
