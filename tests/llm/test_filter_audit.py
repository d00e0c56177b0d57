import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from tracetide.llm import filter_audit as fa


def failures(rows):
    """The set of filters that each row fails."""
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        out.append({f for f, x in fails.items() if x})
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    fails, out = failures(rows), {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        removed_in = {}
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                before = set(order[:step])
                here = [i for i, f in mine if name in f and not f & before]
                out[part, "".join(order), step + 1] = [
                    sum(not f & (before | {name}) for _, f in mine), len(here), sum(name in f and bool(f & before) for _, f in mine),
                    sum(f == {name} for _, f in mine), sum(i in good for i in here), sum(i in toxic for i in here),
                ]
                removed_in[name] = removed_in.get(name, 0) + len(here)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_in[order[step - 1]])
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def corpus():
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "é", "x1", " ", "|", "#a"] + [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(60):
        some = rng.sample(words, rng.randint(1, len(words)))
        texts.append(rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t\n", "  "]).join(rng.choice(some) for _ in range(rng.randint(0, 120))))
    rows = [(i, rng.choice(texts), rng.choice(["a", "a", "b", None])) for i in range(200)]
    rows += [(1000 - i, "copies of one text " * 20, "hot") for i in range(150)] + [(300, "only " * 60, "one")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 1000, 2)]
    return rows, labels


DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def test_audit_against_brute_force(spark):
    rows, labels = corpus()
    found = got(fa.audit(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)))
    assert found == brute(rows, labels)
    assert len(found) == 600 * 5
    for part in "ab":  # what all filters remove in an order doesn't hang on the order
        assert len({sum(found[part, "".join(o), s][1] for s in range(1, 6)) for o in permutations("ABCDE")}) == 1


def test_words_and_limits(spark):
    texts = ["", " ", "w " * 49, "w " * 50, " ".join(f"w{i}" for i in range(65)) + " w0" * 35, " ".join(f"w{i}" for i in range(64)) + " w0" * 36, "A" + "b" * 19, "AA" + "b" * 38 + "A", "É" * 9, "50%", "a b", "x" * 3000 + " y" * 300_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    assert got(fa.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS))) == brute(rows, [])


def test_nulls_repeats_and_clashing_columns(spark):
    text = "A text."
    rows = [(None, text, "s"), (None, text, None), (5, text, ""), (5, text, ""), (5, text, "t"), (7, text, "s"), (8, None, "s"), (9, "", "s"), (None, None, "t"), (10, "other", "s"), (10, "another", "t")]
    labels = [(5, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, 1), (10, 1, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS + ", failed int, part string, n int")
    marks = spark.createDataFrame([(*r, "y") for r in labels], LABELS + ", text string")
    found = got(fa.audit(docs, marks))
    assert found == brute(rows, labels)
    assert {k[0] for k in found} == {"", "s", "t"}
    assert fa.audit(docs.limit(0), marks).count() == 0 and len(got(fa.audit(docs, marks.limit(0)))) == 1800


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "a", "s")], DOCS)
    found = got(fa.audit(docs, spark.createDataFrame([], LABELS), {"S": F.char_length("text") < 2}, repeats="R"))
    assert found == {("s", "SR", 1): [1, 2, 0, 1, 0, 0, 3], ("s", "SR", 2): [1, 0, 1, 0, 0, 0, 1], ("s", "RS", 1): [2, 1, 0, 0, 0, 0, 1], ("s", "RS", 2): [1, 1, 1, 1, 0, 0, 3]}
