import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tracetide.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_hilbert_neighbours_differ_by_one_step():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = packing.hilbert(points, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    walk = points[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_round_trip_against_tokenizers(spark):
    r = random.Random(2)
    chars = "abc  \t\n\r  déß€😀's 12 <|endoftext|>!? 　 \x1c\x85"
    rows = [(i, "".join(r.choice(chars) for _ in range(r.randint(0, 3000)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a <|endoftext|> b"), (103, "x" * 20_000), (105, "a" + " " * 6000 + "b" + "\n" * 6000 + "<|endoftext|>" + "\u3000" * 6000), (106, "\t" * 5000 + " it's"), (104, "it's " * 3000), (104, "it's " * 3000), (None, "no id")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, length int").repartition(3)
    pieces = packing.pack(df, PATH).collect()
    t = Tokenizer.from_file(PATH)
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    seen, sequences = {}, {}
    for p in pieces:
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, ids in want.items():
        copies = 2 if i == 104 else 1
        assert sorted(x for s, n in seen[i] for x in range(s, s + n)) == sorted(list(range(len(ids))) * copies)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_white_space_beyond_what_the_pattern_can_look_over():
    t, own = Tokenizer.from_file(PATH), packing.encoder(PATH)
    for text in ("a" + " " * 200_000 + "b", "\n" * 150_000 + "\t x" + " " * 150_000, "12" + " \n" * 100_000 + "<|endoftext|>" + " " * 100_000 + "y"):
        assert own.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(own.ids(" " * 3_000_000 + "x")) > 1000


def test_vectors_do_not_depend_on_blocks(monkeypatch):
    texts = [b"some words here", b"", b" lead and trail ", b"x" * 50]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = packing.curve_keys(offsets, data)
    for i, t in enumerate(texts):
        assert packing.curve_keys(np.array([0, len(t)]), np.frombuffer(t, np.uint8))[0] == whole[i]
