"""Runs of repeating words by branching tandem repeats of a suffix tree.

The suffix tree of a document's words is held as its suffix array and the common prefixes of
neighbours: a place k of the array with a common prefix of q words parts the leaves of a node of depth q
into those left and those right of it. For each such place the smaller half of its leaves is walked: a leaf i
finds a branching tandem repeat of period q where leaf i + q or i - q lies in the other half (one look at
the ranks), so all walks together visit n log n leaves. The words after the two copies differ there, so each
maximal run has exactly one such repeat per multiple of its period, the one that ends where the run ends.
Rotating it word by word to the left, as long as the repeat stays one, gives all repeats of the run;
they are merged into one span. A repeat of a multiple of the run's period gives the same span and is dropped.

Documents in which no 16 words repeat can't hold a run of the least length (2/3 of it, at least
16 words, stand again one period on) and are told by their windows' hashes; trees are built for the rest, with the
words numbered, not hashed. Suffixes are sorted by doubling, only those not yet told apart.

Defined results: null and empty texts have no words and no run; equal rows get equal results each; a null
doc_id is carried as it is; extra columns are ignored; an empty table gives no rows. A run needs as
many words as `least` and `times` its period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import buffers, trimmed

LEAST, TIMES = 24, 3
#: Leaves that are walked at once.
LEAVES = 1 << 20
#: Rows of a batch of results.
OUT_ROWS = 2000


def may_hold(words: list[bytes], least: int, times: int) -> bool:
    """Whether any window that a run would repeat stands twice; equal windows have equal hashes."""
    size = max(-(-least * (times - 1) // times), 1)
    if len(words) < least:
        return False
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    width = 1
    while 2 * width <= size:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + (h[width:] ^ (h[width:] >> np.uint64(29)))
        width *= 2
    h = np.sort(h)
    return bool((h[1:] == h[:-1]).any())


def suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks): sorted by the first words, then by twice as many, among those still equal."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    first = np.ones(n, bool)
    first[1:] = codes[order[1:]] != codes[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    k = 1
    while True:
        alone = first & np.append(first[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order, rank[:n]
        at = order[open_]
        key = rank[at] * (n + 1) + rank[np.minimum(at + k, n)] + 1
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        order[open_] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first[open_] = new
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        k *= 2


def common(codes: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Common prefixes of neighbours in the array; that of the first is 0."""
    n, h, out = len(codes), 0, [0] * len(codes)
    for i in range(n):
        r = rank[i]
        if not r:
            h = 0
            continue
        j = order[r - 1]
        most = n - max(i, j)
        while h < most and codes[i + h] == codes[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out


def nodes(shared: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the array the first leaf left of it and the last one right of it that it parts.

    Of places of equal depth in one node the first parts its leaves from all others, and so on, so each pair of
    leaves is parted by one place.
    """
    n = len(shared)
    left, right, stack = [0] * n, [n - 1] * n, []
    for k in range(n):
        q = shared[k]
        while stack and shared[stack[-1]] > q:
            right[stack.pop()] = k - 1
        if stack:
            left[k] = stack[-1]
        stack.append(k)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of all branching tandem repeats, by smaller halves."""
    order, rank = suffixes(codes)
    shared = common(codes.tolist(), order.tolist(), rank.tolist())
    left, right = nodes(shared)
    depth = np.array(shared, np.int64)
    n = len(codes)
    # a repeat of q words and q again fits only where 2 q <= n
    place = np.flatnonzero((depth > 0) & (2 * depth <= n))
    small_left = place - left[place] <= right[place] - place + 1
    a = np.where(small_left, left[place], place)
    b = np.where(small_left, place, right[place] + 1)
    oa = np.where(small_left, place, left[place])
    ob = np.where(small_left, right[place] + 1, place)
    ends = np.cumsum(b - a)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i = 0
    while i < len(place):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LEAVES)))
        size = (b - a)[i:j]
        own = np.repeat(np.arange(i, j), size)
        leaf = order[np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + a[own]]
        q = depth[place[own]]
        for other, start in ((leaf + q, leaf), (leaf - q, leaf - q)):
            there = np.flatnonzero((other >= 0) & (other < n))
            r = rank[other[there]]
            hit = there[(r >= oa[own[there]]) & (r < ob[own[there]])]
            starts.append(start[hit])
            periods.append(q[hit])
        i = j
    return np.concatenate(starts), np.concatenate(periods)


def rotated(codes: np.ndarray, start: int, q: int) -> int:
    """Start of the run that the repeat at `start` ends."""
    step = 32
    while start:
        low = max(0, start - step)
        other = np.flatnonzero(codes[low:start] != codes[low + q : start + q])
        if len(other):
            return low + int(other[-1]) + 1
        start, step = low, 2 * step
    return 0


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run, by start and period."""
    n = len(codes)
    start, q = branching(codes)
    # a run of three or more periods rotates at least once
    if times > 2:
        keep = np.flatnonzero((start > 0) & (codes[start - 1] == codes[start - 1 + q]))
        start, q = start[keep], q[keep]
    order = np.lexsort((start, q))
    found: dict[int, list[tuple[int, int]]] = {}
    out = set()
    for s, p in zip(start[order].tolist(), q[order].tolist(), strict=True):
        end = s + 2 * p
        if end > n or any(p % p0 == 0 and s0 <= s for p0, s0 in found.get(end, ())):
            continue  # a multiple of a shorter period
        s = rotated(codes, s, p)
        found.setdefault(end, []).append((p, s))
        if end - s >= max(least, times * p):
            out.add((s, end - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; ties by start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _task(least: int, times: int, texts: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            view = memoryview(raw)
            for at in range(0, batch.num_rows, OUT_ROWS):
                rows = range(at, min(at + OUT_ROWS, batch.num_rows))
                counts, lists, bests, digests, kept_texts = [], [], [], [], []
                for row in rows:
                    words = bytes(view[offsets[row] : offsets[row + 1]]).split()
                    found = []
                    if may_hold(words, least, times):
                        number: dict[bytes, int] = {}
                        found = runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64), least, times)
                    if found:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for s, length, p in found:
                            gone[s + p] += 1
                            gone[s + length] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    kept = b" ".join(words)
                    counts.append(len(found))
                    lists.append([{"start": s, "length": length, "period": p} for s, length, p in found])
                    top = _best(found)
                    bests.append(top and {"start": top[0], "length": top[1], "period": top[2]})
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if texts:
                        kept_texts.append(kept.decode())
                columns = [batch.column("doc_id").slice(at, len(rows)), pa.array(counts, pa.int64()), pa.array(lists, kind), pa.array(bests, kind.value_type), pa.array(digests, pa.string())]
                names = ["doc_id", "n_runs", "runs", "best", "collapsed_sha256"]
                if texts:
                    columns.append(pa.array(kept_texts, pa.string()))
                    names.append("collapsed")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, texts: bool = False) -> DataFrame:
    """doc_id, n_runs, runs (start, length, period in words), best (the run of the greatest exponent), collapsed_sha256; with `texts` also collapsed.

    collapsed: the words that no run holds after its first period, joined by single spaces.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    run = "struct<start:long,length:long,period:long>"
    return rows.mapInArrow(trimmed(_task(least, times, texts)), f"doc_id long, n_runs long, runs array<{run}>, best {run}, collapsed_sha256 string" + ", collapsed string" * texts)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic end in every tenth document (by the CRC-32 of its id)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def bent(h: Column) -> Column:
        n = F.size("w").cast("long")
        g = F.floor(h / 10).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("w", at(i))), " ")

    held = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    return held.select("doc_id", F.when(F.size("w") > 0, bent(F.col("h"))).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    line = F.transform("runs", lambda r: F.concat(*(x.cast("string") if not isinstance(x, str) else F.lit(x) for x in (r["start"], ",", r["length"], ",", r["period"], "\n"))))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), "collapsed_sha256")


# DuckDB; documents with unique ids. 16 words that stand again q words on, chained, are the runs.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)), lambda y, t: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, h, w, len(w) AS n FROM (SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
e AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w
  FROM (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM d))),
g AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS k, n FROM (SELECT doc_id, w, n, unnest(range(0, n - 15)) AS i FROM e)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs),
wide AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 16 + q AS length FROM isles GROUP BY doc_id, q, g),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM wide WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM e) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period, (1000 * b.length // b.period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
