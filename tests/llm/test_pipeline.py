import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import brute_components, brute_fingerprint


def tables(spark, path):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = {i: prose(r.randint(60, 200)) for i in range(160)}
    toxic = {i for i in texts if i % 8 == 1}
    for i in toxic:
        words = texts[i].split()
        for _ in range(8):
            words.insert(r.randint(0, len(words)), r.choice(["vilename", "scumbagly", "1diotic", "wr3tched"]))
        texts[i] = " ".join(words)
    passage = prose(70)
    for i in (2, 10, 20):
        texts[i] = f"{prose(60)} {passage} {prose(50)}"
    texts[200], texts[201] = texts[4], texts[4] + " tail"
    bench = {1: prose(20), 2: prose(40)}
    texts[30] = f"{prose(10)} {bench[2]} {prose(10)}"
    texts[31], texts[32] = "", None
    docs = [(i, t, "en", "src", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts if i < 150], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts, toxic, bench, passage


def test_stages_against_brute_force(spark, tmp_path):
    path = str(tmp_path)
    texts, toxic, bench, passage = tables(spark, path)
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        kept.append(rows)
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    after_toxic, after_simhash, after_suffix, after_bench = kept
    assert set(after_toxic) == set(texts) - toxic
    label = brute_components([(i, brute_fingerprint(texts[i])) for i in after_toxic])
    assert set(after_simhash) == {i for i in after_toxic if label[i] == i} and 200 not in after_simhash
    seen = set()
    for i in sorted(after_simhash):
        raw = (texts[i] or "").encode()
        mark = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                mark[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        want = bytes(c for c, m in zip(raw, mark) if not m).decode()
        assert (after_suffix[i].text or "") == want and (texts[i] is None) == (after_suffix[i].text is None)
    assert passage in after_suffix[2].text and passage not in after_suffix[10].text and passage not in after_suffix[20].text
    assert set(after_suffix) - set(after_bench) == {30}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for p in pieces:
        ids = [*t.encode(after_bench[p.doc_id].text or "", add_special_tokens=False).ids, 0]
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert sum(p.length for p in pieces) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in after_bench.values())


def test_run_gives_the_last_stage(spark, tmp_path):
    tables(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert "sequence_id" in out.columns and out.count() > 100


def test_empty_tables_and_repeated_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = lambda k: " ".join(f"{chr(97 + k)}{i}x" for i in range(80))
    rows = [(7, prose(0), "en", "s", 1), (7, prose(1), "en", "s", 1), (7, prose(1), "en", "s", 1), (None, prose(1), "en", "s", 1), (None, prose(2), "en", "s", 1), (None, None, None, None, None)]
    for name, given in (("empty", []), ("repeats", rows)):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(given, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[1:]:
            out = f(spark, docs, path)
            docs = spark.createDataFrame(out.collect(), out.schema)
            if stage == "simhash":
                kept = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
        assert kept == (sorted([(7, prose(0)), (7, prose(1)), (-1, prose(2)), (-1, "")]) if given else [])
        assert docs.select("doc_id", "start").count() >= len(kept) and (given or docs.count() == 0)
        assert given or corpus_pipeline.run(spark, path).count() == 0
