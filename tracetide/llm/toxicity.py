"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

A text is folded first: compatibility forms and case, combining marks of Latin
letters, letters of other scripts that look Latin, digits and signs that stand
for letters inside a word (1 and | stand for i and l, which fold into i). Terms are words or word beginnings of the folded
text, with weights learnt from labelled rows: the log ratio of the shares of
toxic and other documents that hold the term. Exception phrases are two-word
phrases that hold a term but are not rarer in other documents than in toxic
ones; a match inside one does not count. The evidence is the sum of weights of
matched terms, normalised by the length of the text, through a logistic curve.

Null and empty texts have no evidence and score as the curve does at none.
Learning reads at most `sample` labelled rows (those with the smallest hashes
of id and text); scoring reads whole texts.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tracetide.llm.common import materialize, require

# Letters of other scripts that look like Latin ones, and the
# digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class _Fold(dict):
    """Character table for str.translate, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", chr(code)).casefold():
            for d in unicodedata.normalize("NFKD", c):
                if not unicodedata.combining(d) and d not in INVISIBLE:
                    out.append(LOOKALIKES.get(d, d))
        found = "".join(out)
        if not found.isascii():
            found = "".join(c if c.isascii() or c.isalpha() else " " for c in found)
        self[code] = "".join("i" if c == "l" else c if c.isalnum() or c in SUBSTITUTES else " " for c in found)
        return self[code]


FOLD = _Fold()
DIGITS = str.maketrans(SUBSTITUTES)


def words(text: str) -> list[str]:
    """Folded words. Substitutes at a word's end are punctuation; a word without a letter keeps its digits."""
    out = []
    for w in text.translate(FOLD).split():
        if not w.isalpha():
            w = w.rstrip("!|+") or w
            if any(c.isalpha() for c in w):
                w = w.translate(DIGITS)
        out.append(w)
    return out


@dataclass
class Lexicon:
    """terms: weight by term, a word as " word " and a beginning as " begin". exceptions: two-word phrases as " a b "."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0
    _automaton: object = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(t, (len(t), w))
            for t in self.exceptions:
                a.add_word(t, (len(t), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def evidence(self, text: str | None) -> tuple[float, int]:
        """The sum of weights and the number of matches outside exception phrases; of terms that begin at one word the heaviest counts."""
        found = words(text or "")
        a = self.automaton()
        if not found or not len(a):
            return 0.0, 0
        heaviest: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in a.iter(" " + " ".join(found) + " "):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > heaviest.get(start, -1e9):
                heaviest[start] = weight
        if spared:
            covered = _inside(sorted(heaviest), sorted(spared))
            heaviest = {s: w for s, w in heaviest.items() if s not in covered}
        return sum(heaviest.values()), len(heaviest)

    def score(self, text: str | None) -> float:
        total, _ = self.evidence(text)
        return self.curve(total, len(text or ""))

    def curve(self, total: float, length: int) -> float:
        """Logistic in the evidence per root of the length in hundreds of characters."""
        x = self.slope * total / math.sqrt(1 + length / 100) + self.offset
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _inside(starts: list[int], spans: list[tuple[int, int]]) -> set[int]:
    """Starts of matches inside a span; both lists are in order and are gone through once."""
    out, i, reach = set(), 0, -1
    for s in starts:
        while i < len(spans) and spans[i][0] <= s:
            reach = max(reach, spans[i][1] - 1)
            i += 1
        if s < reach:
            out.add(s)
    return out


def _counts(sample: DataFrame, least: int, prefixes: range) -> DataFrame:
    """(term, toxic, other): documents that hold each term; terms in fewer than `least` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text or "")
                terms = {f" {x} " for x in w} | {f" {x[:k]}" for x in w for k in prefixes if len(x) > k}
                terms |= {f" {x} {y} " for x, y in zip(w, w[1:], strict=False)}
                for t in terms:
                    counted.setdefault(t, [0, 0])[1 - y] += 1
            if len(counted) > 500_000:
                yield send(counted)
                counted = {}
        if counted:
            yield send(counted)

    def send(counted: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array([c[0] for c in counted.values()], pa.int64()), pa.array([c[1] for c in counted.values()], pa.int64())], ["term", "toxic", "other"])

    return sample.select("text", "y").mapInArrow(run, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(F.col("toxic") + F.col("other") >= least)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000, least: int = 4, ratio: float = 3.0) -> Lexicon:
    """A lexicon from labelled documents; rows without a label or id teach nothing.

    sample bounds the labelled documents read; of several rows with one id the one
    with the smallest hash of its text teaches. The lexicon holds every term and
    exception phrase that at least `least` of them hold, and so grows with their words.
    """
    require(docs, doc_id, text)
    require(labels, doc_id, label)
    marks = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    marks = marks.orderBy(F.xxhash64("id"), "id").limit(sample)
    taught = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(marks), "id")  # at most sample rows
    taught = taught.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    taught = materialize(taught.select("text", (F.col("y") > 0).cast("int").alias("y")), "taught")
    totals = {r.y: r["count"] for r in taught.groupBy("y").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        return Lexicon({}, [], 1.0, math.log((toxic + 0.5) / (other + 0.5)))
    counted = _counts(taught, least, range(3, 9)).withColumn("weight", F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1)))
    counted = materialize(counted.withColumn("is_phrase", F.size(F.split(F.trim("term"), " ")) == 2), "terms")
    top = counted.filter(~F.col("is_phrase") & (F.col("weight") >= ratio)).select("term", "weight").collect()
    terms = _without_longer({r.term: r.weight for r in top})
    phrases = counted.filter("is_phrase and weight <= 0")
    exceptions = _holding(phrases, terms) if terms else []
    lexicon = Lexicon(terms, exceptions)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lexicon.evidence(t)[0] / math.sqrt(1 + len(t or "") / 100), y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([round(min(200.0, x), 2) for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.int32())], ["x", "y"])

    points = taught.select("text", "y").mapInArrow(evidence, "x double, y int").groupBy("x", "y").count().collect()  # at most sample rows
    lexicon.slope, lexicon.offset = _logistic([(r.x, r.y, r["count"]) for r in points])
    return lexicon


def _holding(phrases: DataFrame, terms: dict[str, float]) -> list[str]:
    """Phrases of which a word is a term or begins with one; terms come from the bounded sample and are broadcast."""
    listed = phrases.sparkSession.createDataFrame([(t,) for t in terms], "part string")
    sizes = sorted({len(t) - 1 for t in terms if not t.endswith(" ")})

    def parts(w):
        return F.array(F.concat(F.lit(" "), w, F.lit(" ")), *[F.concat(F.lit(" "), F.substring(w, 1, k)) for k in sizes])

    split = phrases.select("term", F.explode(F.flatten(F.transform(F.split(F.trim("term"), " "), parts))).alias("part"))
    return [r.term for r in split.join(F.broadcast(listed), "part", "left_semi").select("term").distinct().orderBy("term").collect()]


def _without_longer(terms: dict[str, float]) -> dict[str, float]:
    """Terms of which no beginning is a term of about the same weight or more."""
    out: dict[str, float] = {}
    for t in sorted(terms, key=len):
        if not any(t[:k] in out and out[t[:k]] >= terms[t] - 1.0 for k in range(2, len(t))):
            out[t] = terms[t]
    return out


def _logistic(points: list[tuple[float, int, int]], rounds: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method."""
    a, b = 0.1, -1.0
    for _ in range(rounds):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, a * x + b))))
            d, w = (p - y) * n, p * (1 - p) * n
            g0, g1, h00, h01, h11 = g0 + d * x, g1 + d, h00 + w * x * x, h01 + w * x, h11 + w
        g0, h00, h11 = g0 + ridge * a, h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        if det < 1e-12:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 1e-3), b


def score(docs: DataFrame, lexicon: Lexicon, doc_id: str = "doc_id", text: str = "text", name: str = "toxicity") -> DataFrame:
    """docs with the score as one more column."""
    require(docs, doc_id, text)
    if name in docs.columns:
        raise ValueError(f"docs already has a column {name}")
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([lexicon.score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, DoubleType())]))


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs that score under the threshold."""
    return score(docs, lexicon, doc_id, text, "__score").filter(F.col("__score") < threshold).drop("__score")
