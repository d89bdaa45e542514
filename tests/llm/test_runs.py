"""Periodic runs: a plain version over every period."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from veilspark.llm import queries, runs

from .common import ODD, WORD, documents, frame


def plain(words, least=24, times=3):
    """Every maximal stretch with words q apart equal, of the smallest q."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def bent(i, text):
    words, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if i is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (k - a) % p] if k >= a else w for k, w in enumerate(words)]


def expected(i, words):
    found = sorted(plain(words), key=lambda r: (r[0], r[2]))
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (i, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_periodic_runs(spark, small):
    rnd = random.Random(5)
    rows = documents(spark, small, 120) + ODD + [(40000 + i, " ".join(rnd.choice("ab") * rnd.randrange(1, 3) for _ in range(60))) for i in range(60)]
    got = runs.digests(runs.find(runs.planted(frame(spark, rows)))).collect()
    want = [expected(i, bent(i, t)) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r["n_runs"] > 0 for r in got) > 20
    assert runs.find(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_few_words(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        n, k = rnd.randrange(1, 90), rnd.randrange(1, 4)
        words = [rnd.randrange(k) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            a, p = rnd.randrange(n), rnd.randrange(1, 9)
            for i in range(a, min(n, a + rnd.randrange(40))):
                words[i] = words[a + (i - a) % p]
        for least, times in ((24, 3), (4, 2), (6, 3)):
            got = runs.runs_of(np.array(words), least, times)
            assert got == sorted(plain(words, least, times), key=lambda r: (r[0], r[2]))
            assert not got or runs.may_hold([bytes([w]) for w in words], least, times)


def test_suffix_array_and_nodes():
    rnd = random.Random(1)
    for _ in range(60):
        codes = np.array([rnd.randrange(3) for _ in range(rnd.randrange(1, 40))])
        order, rank = runs.suffixes(codes)
        tails = [codes[i:].tolist() for i in range(len(codes))]
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: tails[i])
        assert rank[order].tolist() == list(range(len(codes)))


@pytest.mark.parametrize("text", ["a " * 200_000, "a b " * 100_000, " ".join(f"w{i % 70_000}" for i in range(220_000)), " ".join(str(bin(i).count("1") % 2) for i in range(200_000)), "x" * 10**6], ids=range(5))
def test_long_texts(text):
    words = text.encode().split()
    number = {}
    began = time.time()
    got = runs.runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
    assert time.time() - began < 60
    for s, n, q in got[:50]:
        assert words[s : s + n - q] == words[s + q : s + n]
        assert (s == 0 or words[s - 1] != words[s - 1 + q]) and (s + n == len(words) or words[s + n] != words[s + n - q])
    if text.startswith("a"):
        assert got == [(0, 200_000, 1 + text.startswith("a b"))]


def test_same_as_sql(same):
    same(queries.QUERIES["op11_periodic_runs"], queries.SQL["op11_periodic_runs"])
