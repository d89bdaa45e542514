"""Fixtures and plain versions that the tests compare with."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, places string, dig int, score double, kept string"

ODD = [
    (None, None), (None, "a null id with some words in it"), (9001, ""), (9002, None), (9003, " \t\n"), (9004, "one"), (9005, "One two three four five"), (9006, "one TWO three four five"),
    (9007, "x " * 300), (9008, "y" * 1500), (9009, "aé ñ" * 200), (9010, "same\n" * 40), (9010, "same\n" * 40), (9011, "dup id one " * 30), (9011, "dup id two " * 30), (9012, "tail space "), (9014, "ends <|endoftext|> here"), (9013, "  double  spaces  "),
]


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those that operators use."""
    full = [(i, t, "en", "p", 7, 0.5, "k") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def documents(spark, small, n=None):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    return rows[:n] if n else rows


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, percent=75):
    """{doc_id: (set size, smallest reachable doc_id)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    shared = Counter((min(a, b), max(a, b)) for v in where.values() for j, a in enumerate(v) for b in v[:j])
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def repeats(units, length):
    """Masks of what lies in a window that starts twice or more."""
    seen = Counter(tuple(u[s : s + length]) for u in units for s in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for s in range(len(u) - length + 1):
            if seen[tuple(u[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        out.append(gone)
    return out
