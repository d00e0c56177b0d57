"""Token counts by heap-and-linked-list byte-pair merging.

Symbols start as characters; a heap yields the adjacent pair of lowest rank
(ties: leftmost) and linked symbols merge until no pair is a piece. The count
is the number of initial symbols minus the number of merges, where a character
that is no piece counts as its UTF-8 bytes. No identifiers are made.

Pieces hold the space sign only in front and no line feed, so that merges never
cross from a word to the following space or over a line feed: texts are cut
there and each distinct cut is merged once per worker and `CACHE` cuts.

Null and empty texts have no tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracetide.llm.common import require

SPACE = "▁"
#: Counts kept by a worker before it starts anew; it bounds memory, not results.
CACHE = 1_500_000


class Counter(dict):
    """Tokens by cut. A key is a word after one space; after k spaces it begins with k - 1 of them, and right after a line feed with one."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = sorted({model.get_score(i) for i in normal}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = {model.id_to_piece(i): order[model.get_score(i)] for i in normal}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.rank) or not model.is_byte(model.piece_to_id("<0x0A>")) or model.normalize("a  ﬁ ") != f"{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("needs a model with byte fallback, no normalisation, and spaces only in front of pieces")

    def __missing__(self, key: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        if key.startswith("\n"):
            cut = key[1:]
        else:
            word = key.lstrip(" ")
            cut = SPACE * (1 + len(key) - len(word)) + word
        n = self[key] = self.merge(cut)
        return n

    def merge(self, s: str) -> int:
        """Initial symbols minus merges."""
        rank, n = self.rank, len(s)
        count = sum(1 if c in rank else len(c.encode()) for c in s)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the symbol that starts at i
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(s[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if end[i] != j or end[j] != stop:
                continue  # one of the two has merged meanwhile
            end[i], end[j] = stop, 0
            before[stop] = i
            count -= 1
            if i and (r := rank.get(s[(p := before[i]) : stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
            if stop < n and (r := rank.get(s[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        return count

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for k, line in enumerate(text.replace(SPACE, " ").split("\n")):
            parts = line.split(" ")
            if k:
                total += 1 + (self["\n" + parts[0]] if parts[0] else 0)
                parts = parts[1:]
            if "" in parts:
                total += self.spaced(parts)
            else:
                total += sum(map(self.__getitem__, parts))
        return total

    def spaced(self, parts: list[str]) -> int:
        """An empty part is one more space before the next word."""
        total = held = 0
        for p in parts:
            if p:
                total += self[" " * held + p]
                held = 0
            else:
                held += 1
        return total + (self[" " * (held - 1)] if held else 0)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, model: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text as one more column."""
    require(docs, text)
    if name in docs.columns:
        raise ValueError(f"docs already has a column {name}")

    @F.arrow_udf(LongType())
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = counter(model).tokens
        for b in batches:
            yield pa.array([of(t) for t in b.to_pylist()], pa.int64())

    return docs.withColumn(name, tokens(text))
