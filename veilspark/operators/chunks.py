"""Chunks of passwords by a unigram model that is learned without labels.

A word is a chain of pieces; its likelihood is the sum over all chains of the product of their pieces' probabilities.
Pieces are frequent substrings, of which the PIECES that cover most letters are kept, and all single characters.
Expectation-maximisation alternates expected uses of the pieces, by forward and backward sums in tasks
added up by a grouped aggregate, with new probabilities; pieces that are hardly used go. Words are
then cut along their likeliest chain.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of more than one character; characters of the longest; rounds; (expected) uses below which a piece of several goes.
PIECES, LONGEST, ROUNDS, LEAST = 8000, 12, 5, 5.0
#: Log-probability of a character that the model doesn't know.
UNKNOWN = -20.0


def beginnings(pieces: Iterable[str]) -> set[str]:
    """What longer pieces begin with."""
    return {x[:k] for x in pieces for k in range(1, len(x))}


def lattice(word: str, logp: dict[str, float], longest: int, begun: set[str] | None = None) -> list[list[tuple[int, float]]]:
    """For each end the (start, log-probability) of the pieces that end there; with `begun` no start is followed further than pieces go."""
    out: list[list[tuple[int, float]]] = [[] for _ in range(len(word) + 1)]
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            p = logp.get(word[i:j])
            if p is None and j == i + 1:
                p = UNKNOWN
            if p is not None:
                out[j].append((i, p))
            if begun is not None and word[i:j] not in begun:
                break
    return out


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def expected(word: str, logp: dict[str, float], longest: int, begun: set[str] | None = None) -> dict[str, float]:
    """Expected uses of each piece over all chains of the word."""
    ends, n = lattice(word, logp, longest, begun), len(word)
    forward, backward = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    forward[0] = backward[n] = 0.0
    for j in range(1, n + 1):
        for i, p in ends[j]:
            forward[j] = _add(forward[j], forward[i] + p)
    for j in range(n, 0, -1):
        for i, p in ends[j]:
            backward[i] = _add(backward[i], backward[j] + p)
    out: dict[str, float] = defaultdict(float)
    for j in range(1, n + 1):
        for i, p in ends[j]:
            out[word[i:j]] += math.exp(forward[i] + p + backward[j] - forward[n])
    return out


def likeliest(word: str, logp: dict[str, float], longest: int, begun: set[str] | None = None) -> list[str]:
    """The likeliest chain; ties go to the longer last piece."""
    ends, n = lattice(word, logp, longest, begun), len(word)
    best, last = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        for i, p in sorted(ends[j]):
            if best[i] + p > best[j] + 1e-12:
                best[j], last[j] = best[i] + p, i
    out, j = [], n
    while j:
        out.append(word[last[j] : j])
        j = last[j]
    return out[::-1]


def _uses(logp: dict[str, float], longest: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, float] = defaultdict(float)
        begun = beginnings(logp)
        for batch in batches:
            for word, n in zip(batch.column("password").to_pylist(), batch.column("cnt").to_pylist(), strict=True):
                for piece, x in expected(word, logp, longest, begun).items():
                    total[piece] += n * x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["piece", "uses"])

    return task


def fit(counted: DataFrame, pieces: int = PIECES, longest: int = LONGEST, rounds: int = ROUNDS) -> dict[str, float]:
    """Log-probabilities of the pieces; counted: password, cnt of distinct words."""
    words = counted.filter("password <> ''").select("password", F.col("cnt").cast("long").alias("cnt"))
    n = F.length("password")
    starts = F.sequence(F.lit(1), n)
    all_pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i + 1)), lambda k: F.substr("password", i, k))))
    seen = words.select(F.explode(all_pieces).alias("piece"), "cnt").groupBy("piece").agg(F.sum("cnt").alias("n"))
    single = seen.filter(F.length("piece") == 1)  # an alphabet
    often = seen.filter((F.length("piece") > 1) & (F.col("n") >= LEAST)).orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(pieces)
    held = {r["piece"]: float(r["n"]) for r in single.unionByName(often).collect()}
    total = sum(held.values()) or 1.0
    logp = {x: math.log(v / total) for x, v in held.items()}
    for _ in range(rounds):
        uses = words.mapInArrow(_uses(logp, longest), "piece string, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # a row per piece
        kept = {r["piece"]: max(r["uses"], 1e-9) for r in uses if len(r["piece"]) == 1 or r["uses"] >= LEAST}
        total = sum(kept.values()) or 1.0
        logp = {x: math.log(v / total) for x, v in kept.items()}
    return logp


def cut_words(words: DataFrame, logp: dict[str, float], word: str = "password", longest: int = LONGEST) -> DataFrame:
    """words with chunks; null for a null word, none for the empty one."""
    from pyspark.sql import types as T

    names = words.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = beginnings(logp)
        for batch in batches:
            chunks = [None if w is None else likeliest(w, logp, longest, begun) for w in batch.column(word).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.list_(pa.string()))], names=[*names, "chunks"])

    return words.mapInArrow(task, T.StructType([*words.schema.fields, T.StructField("chunks", T.ArrayType(T.StringType()))]))
