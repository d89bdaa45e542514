"""How many guesses a password withstands: the cheapest way to put it together from known parts.

Parts are words of a ranked dictionary (in any case), repeats, sequences, keyboard walks, dates and years, and
single characters; a part costs the guesses that an attacker needs who knows its kind. A dynamic program
over the places of the word finds the cheapest chain of parts. The dictionary is the head of a ranking, of at most
LENGTH words, so each task holds it; words are scored where they lie, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segment import adjacent

#: Words of the dictionary; letters of its longest and shortest word.
LENGTH, LONGEST, SHORTEST = 30_000, 24, 3
#: Guesses below which a score is 0, 1, 2 and 3.
LIMITS = (1e3, 1e6, 1e8, 1e10)
YEAR, SPAN = 2025, 20
KEYS = 47

Part = tuple[int, int, str, float]
_DATE = re.compile(r"(?=(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])((?:19|20)[0-9]{2}))")
_SHORT_DATE = re.compile(r"(?=(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])([0-9]{2}))")
_YEAR = re.compile(r"(?=((?:19|20)[0-9]{2}))")


def cases(word: str) -> float:
    """Ways to set the capitals of a word like this one."""
    upper = sum(c.isupper() for c in word)
    lower = sum(c.islower() for c in word)
    if not upper:
        return 1.0
    if not lower or upper == 1 and (word[0].isupper() or word[-1].isupper()):
        return 2.0
    return float(sum(math.comb(upper + lower, i) for i in range(1, min(upper, lower) + 1)))


def _stretches(n: int, joined) -> Iterator[tuple[int, int]]:
    """Maximal stretches [a, b) in which every step i (from i to i + 1) is joined to the one before."""
    a = 0
    for i in range(1, n):
        if not joined(a, i):
            yield a, i
            a = i
    if n:
        yield a, n


def _years(y: int) -> int:
    return max(abs(y - YEAR), SPAN)


def parts(word: str, rank: dict[str, int], longest: int = LONGEST) -> Iterator[Part]:
    """(start, end, kind, guesses) of every known part but single characters."""
    low, n = word.lower(), len(word)
    if len(low) == n:  # some letters change their length with their case
        for i in range(n):
            for j in range(i + SHORTEST, min(n, i + longest) + 1):
                if (r := rank.get(low[i:j])) is not None:
                    yield i, j, "word", r * cases(word[i:j])
    for a, b in _stretches(n, lambda a, i: word[i] == word[a]):
        if b - a >= 3:
            yield a, b, "repeat", 12.0 * (b - a)
    same = lambda x, y: x.isdigit() and y.isdigit() or x.islower() and y.islower() or x.isupper() and y.isupper()
    steps = [ord(y) - ord(x) if same(x, y) and abs(ord(y) - ord(x)) == 1 else 0 for x, y in pairwise(word)]
    for a, b in _stretches(len(steps), lambda a, i: steps[i] == steps[a]):
        if steps[a] and b - a >= 2:
            yield a, b + 1, "sequence", (10.0 if word[a].isdigit() else 26.0) * (b - a + 1) * (1 if steps[a] > 0 else 2)
    for a, b in _stretches(n, lambda a, i: word[i] != word[i - 1] and adjacent(word[i - 1], word[i])):
        if b - a >= 4:
            turns = sum(ord(z) - ord(y) != ord(y) - ord(x) for x, y, z in zip(word[a:b], word[a + 1 : b], word[a + 2 : b], strict=False))
            yield a, b, "keys", KEYS * (b - a) * 2.0 ** min(turns, 60)
    for p, size in ((_DATE, 8), (_SHORT_DATE, 6)):
        for m in p.finditer(word):
            y = int(m[3])
            yield m.start(), m.start() + size, "date", 365.0 * _years(y if size == 8 else y + (1900 if y > YEAR % 100 else 2000))
    for m in _YEAR.finditer(word):
        yield m.start(), m.start() + 4, "year", float(_years(int(m[1])))


def cheapest(word: str, rank: dict[str, int], longest: int = LONGEST) -> tuple[float, list[str]]:
    """(log10 of the guesses, kinds of the parts in order); ties go to the part that begins first."""
    n = len(word)
    ends: list[list[Part]] = [[] for _ in range(n + 1)]
    for part in parts(word, rank, longest):
        ends[part[1]].append(part)
    best, last = [0.0] * (n + 1), [(0, "")] * (n + 1)
    for j in range(1, n + 1):
        best[j], last[j] = best[j - 1] + 1.0, (j - 1, "char")
        for i, _, kind, guesses in sorted(ends[j]):
            cost = best[i] + math.log10(max(guesses, 1.0) + 1.0)
            if cost < best[j] - 1e-12:
                best[j], last[j] = cost, (i, kind)
    out, j = [], n
    while j:
        i, kind = last[j]
        out.append(kind)
        j = i
    return best[n], out[::-1]


def score(guesses: float) -> int:
    """0 (weak) to 4; guesses as log10."""
    return sum(guesses >= math.log10(x) for x in LIMITS)


def scored(words: DataFrame, ranking: DataFrame, word: str = "password", length: int = LENGTH) -> DataFrame:
    """words with guesses (log10, to 6 digits), score (0 to 4) and parts; ranking: password, rank from 1.

    Null words have null in all three, the empty word needs one guess. Of dictionary words that differ in case the
    best rank counts.
    """
    head = ranking.filter((F.col("rank") <= length) & (F.length("password") >= SHORTEST)).groupBy(F.lower("password").alias("w")).agg(F.min("rank").alias("rank"))
    rank = {r["w"]: int(r["rank"]) for r in head.collect()}  # `length` words at most
    longest = min(LONGEST, max(map(len, rank), default=0))
    names = words.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if w is None else cheapest(w, rank, longest) for w in batch.column(word).to_pylist()]
            told = [pa.array([f and round(f[0], 6) for f in found], pa.float64()), pa.array([None if f is None else score(f[0]) for f in found], pa.int32()), pa.array([f and f[1] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*names, "guesses", "score", "parts"])

    from pyspark.sql import types as T

    schema = T.StructType([*words.schema.fields, T.StructField("guesses", T.DoubleType()), T.StructField("score", T.IntegerType()), T.StructField("parts", T.ArrayType(T.StringType()))])
    return words.mapInArrow(task, schema)


def extremes(words: DataFrame, n: int, strongest: bool = True, word: str = "password") -> DataFrame:
    """The n distinct words of `scored` that need the most or the fewest guesses; ties by word."""
    some = words.filter(F.col(word).isNotNull()).select(word, "guesses", "score").distinct()
    return some.orderBy(F.desc("guesses") if strongest else F.asc("guesses"), word).limit(n)
