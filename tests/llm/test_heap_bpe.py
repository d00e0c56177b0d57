import random

import public_tokenizers
import sentencepiece

from tracetide.llm import heap_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_as_the_library(spark):
    r = random.Random(4)
    chars = "aabcdethinon   \t\n\n\r déß€😀梦ﬁ12<>/s▁.,\x00　\xa0"
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "   ", "\n", " \n ", "\n\n  a", "a\n", "<s> a </s> <unk>", "<0x0A>", "▁", "▁▁a", "the thing " * 500, "x" * 5000, " " * 3000]
    texts += ["".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(300)]
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts, num_threads=1)]
    c = heap_bpe.counter(PATH)
    got = [c.tokens(t) for t in texts]
    assert [(t, a, b) for t, a, b in zip(texts, got, want) if a != b] == []
    rows = [(1, None, 1), (1, "", 2), (None, "a b", 3), (2, "a b", 4), (2, "a b", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    assert sorted((x.doc_id or -1, x.n_tokens) for x in heap_bpe.count_tokens(df, PATH).collect()) == [(-1, 2), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert heap_bpe.count_tokens(df.limit(0), PATH).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(heap_bpe, "CACHE", 3)
    c = heap_bpe.Counter(PATH)
    assert c.tokens("one two three four five one") == len(sentencepiece.SentencePieceProcessor(model_file=PATH).encode("one two three four five one"))
    assert len(c) <= 4
