import math
import random
import time

from tracetide.llm import toxicity


def test_folding():
    assert toxicity.words("1d10t! IDIOT, іdіоt ídiót ＩＤＩＯＴ id​iot 2024 $cum") == ["idiot", "idiot", "idiot", "idiot", "idiot", "idiot", "2024", "scum"]
    assert toxicity.words("") == toxicity.words(" ., ") == []


def corpus():
    r = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        w = [r.choice("red green blue car tree house walk run the of and".split()) for _ in range(r.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(max(1, len(w) // 15)):
                w.insert(r.randint(0, len(w)), r.choice(["vilename", "grumble1x", "foulish", "foulest"]))
        elif i % 63 == 1:
            w.insert(3, "famous vilename")
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_terms_exceptions_and_scores(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([x for x in labels if x[0] % 4] + [(None, 1), (1, None)], "doc_id long, toxic int")
    lex = toxicity.learn(docs, marks)
    assert " famous viiename " in lex.exceptions
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, lex).collect()}
    held = [(got[i] >= 0.3, y) for i, y in labels if i % 4 == 0]
    assert sum(bool(a) == bool(y) for a, y in held) >= 0.97 * len(held)
    assert lex.score("a famous vilename walks") < 0.3 < lex.score("the vi1ename walks") and 0 <= lex.score("") < 0.3 and lex.score(None) == lex.score("")
    assert toxicity.reject(docs, lex).columns == docs.columns


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "x " * 100_000)], "doc_id long, text string")
    lex = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.toxicity <= 1 for r in toxicity.score(docs, lex).collect())
    assert toxicity.score(docs.limit(0), lex).count() == 0


def plain_score(lex, text):
    """The score by looking for every term at every word, without an automaton."""
    found = toxicity.words(text or "")
    line = " " + " ".join(found) + " "
    spared = [(k, k + len(e)) for e in lex.exceptions for k in range(len(line)) if line.startswith(e, k)]
    total = 0.0
    for k, c in enumerate(line[:-1]):
        here = [w for t, w in lex.terms.items() if line.startswith(t, k)]
        if c == " " and here and not any(a <= k < b - 1 for a, b in spared):
            total += max(here)
    x = lex.slope * (total if found else 0.0) / math.sqrt(1 + len(text or "") / 100) + lex.offset
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def plain_weights(rows, labels, least):
    """Log ratios of the shares of toxic and other documents that hold a word or a beginning of 3 to 8 letters, by dictionaries."""
    y = {i: t for i, t in labels if i is not None and t is not None}
    n, counts = [0, 0], {}
    for i, text, *_ in rows:
        if i in y:
            n[y[i]] += 1
            for t in {t for w in toxicity.words(text) for t in (f" {w} ", *(f" {w[:k]}" for k in range(3, 9) if len(w) > k))}:
                counts.setdefault(t, [0, 0])[y[i]] += 1
    return {t: math.log((c[1] + 0.5) / (n[1] + 1)) - math.log((c[0] + 0.5) / (n[0] + 1)) for t, c in counts.items() if sum(c) >= least}


def test_against_brute_force(spark):
    rows, labels = corpus()
    marks = [x for x in labels if x[0] % 4]
    docs = spark.createDataFrame([*rows, (600, "vi1ename " * 20_000, "x"), (601, None, "x"), (602, "", "x"), (None, "foulish", "x")], "doc_id long, text string, other string").repartition(3)
    lex = toxicity.learn(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    want = plain_weights(rows, marks, 4)
    assert all(abs(lex.terms[t] - want[t]) < 1e-9 for t in lex.terms)
    assert set(lex.terms) == set(toxicity._without_longer({t: w for t, w in want.items() if w >= 3.0}))
    for r in toxicity.score(docs, lex).collect():
        assert math.isclose(r.toxicity, plain_score(lex, r.text), rel_tol=1e-9)


def test_a_repeated_id_teaches_once(spark):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, many = (toxicity.learn(spark.createDataFrame(rows + [rows[5]] * k, "doc_id long, text string, x string").repartition(2), marks, sample=500) for k in (0, 300))
    assert one == many


def test_matches_and_exceptions_of_a_long_text_are_merged():
    lex = toxicity.Lexicon({" viiename ": 5.0, " fou": 4.0}, [" famous viiename ", " viiename famous ", " not fouii "])
    r = random.Random(7)
    short = " ".join(r.choice(["famous", "vilename", "foul", "not", "tree"]) for _ in range(600))
    assert math.isclose(lex.score(short), plain_score(lex, short), rel_tol=1e-9)
    long = "famous vilename foul " * 50_000  # over a megabyte, 100,000 matches and 50,000 exceptions
    began = time.perf_counter()
    total, n = lex.evidence(long)
    assert (total, n) == (50_000 * 4.0, 50_000) and time.perf_counter() - began < 10
