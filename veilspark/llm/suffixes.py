"""Suffix-array dedup over bytes by a common-prefix-aware distributed merge sort.

Sorting every suffix of a corpus moves many times its size, so the array is sparse: a suffix
starts at the region of each winnowed anchor (`repeats`), which no repeat of `length` bytes can
avoid, and ends where the region ends. Anchors that occur once are dropped before (their suffixes
have a unique prefix, so they need no order).

1. Runs: each task sorts its suffixes, folds equal ones, cuts the run at shared splitters and
   writes every part front-coded: length of the prefix shared with the suffix before, and the rest.
2. Exchange: parts go to the task of their key range.
3. Merge: a loser tree over the runs of a range. Every run's head carries the length of the prefix
   it shares with the last winner; a longer one wins or loses without looking at any byte, and
   equal ones are compared from there on, so no known prefix is compared again.

The merged order puts equal suffixes side by side, which gives the distinct regions and their
numbers of places; what differs in part is finished as in `repeats`.

Defined results: null text counts as empty; empty texts keep nothing; equal rows repeat each
other; extra columns are ignored; an empty table gives no rows; a null doc_id is carried as it is.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .repeats import covered, keyed, listed, places_of, repeated_places, shared_anchors, with_places
from .textcore import buffers, columns, trimmed

FIELDS = ("h", "r1", "r2", "n", "doc_id", "dig", "lo", "hi", "at")
RUN = "part int, run long, shared array<int>, rest array<binary>, " + ", ".join(f"{f} array<long>" for f in FIELDS)
REGION = ", ".join(f"{f} long" for f in FIELDS)
#: Bytes of distinct suffixes that a task holds before it writes a run, and sampled suffixes for the splitters.
RUN_BYTES, SAMPLE = 48 << 20, 4096


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, which agree before `start`."""
    most = min(len(a), len(b))
    step = 16
    while start < most:
        x, y = a[start : start + step], b[start : start + step]
        if x == y:
            start += min(len(x), len(y))
            step *= 2
            continue
        if step <= 16:
            for p, q in zip(x, y):  # noqa: B905
                if p != q:
                    return start
                start += 1
            return start
        step = 16
    return most


class LoserTree:
    """Merges front-coded sorted runs; each yields (prefix shared with its last item, item, payload)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, tuple]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.head: list = [None] * self.size
        self.known = [0] * self.size
        for i, run in enumerate(runs):
            first = next(run, None)
            self.head[i] = first and (first[1], first[2])
        self.tree = [0] * self.size
        self.winner = self._build(1) if runs else 0

    def _beats(self, a: int, b: int) -> bool:
        """Whether a's head comes first; the loser's known prefix becomes the one shared with the winner."""
        x, y = self.head[a], self.head[b]
        if x is None:
            return False
        if y is None:
            return True
        p, q = self.known[a], self.known[b]
        if p != q:
            return p > q
        c = common(x[0], y[0], p)
        first = x[0][c:] <= y[0][c:]
        self.known[b if first else a] = c
        return first

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.tree[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, tuple]]:
        """(prefix shared with the item before, item, payload) in order."""
        while self.runs and self.head[self.winner] is not None:
            i = self.winner
            yield self.known[i], *self.head[i]
            following = next(self.runs[i], None)
            self.head[i] = following and (following[1], following[2])
            self.known[i] = following[0] if following else 0
            node, win = (i + self.size) >> 1, i
            while node:
                if self._beats(self.tree[node], win):
                    win, self.tree[node] = self.tree[node], win
                node >>= 1
            self.winner = win


def front_code(items: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared = [0] + [common(a, b) for a, b in zip(items, items[1:])]  # noqa: B905
    return shared, [x[c:] for x, c in zip(items, shared, strict=True)]


def front_decode(shared: list[int], rest: list[bytes], payload: list[tuple]) -> Iterator[tuple[int, bytes, tuple]]:
    last = b""
    for c, tail, own in zip(shared, rest, payload, strict=True):
        last = last[:c] + tail
        yield c, last, own


def _places(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, tuple]]:
    """(suffix, (h, r1, r2, doc_id, dig, lo, hi, at)) of each listed place."""
    raw, offsets = buffers(batch.column("text"))
    off, fields = places_of(batch, "h", "r1", "r2", "lo", "hi", "at")
    fields = [f.tolist() for f in fields]
    ids, digs = batch.column("doc_id").to_pylist(), batch.column("dig").to_pylist()
    for row in range(batch.num_rows):
        data = raw[offsets[row] : offsets[row + 1]].tobytes()
        for i in range(off[row], off[row + 1]):
            h, r1, r2, lo, hi, at = (f[i] for f in fields)
            yield data[lo : hi + length], (h, r1, r2, ids[row], digs[row], lo, hi, at)


def _run_task(splitters: list[bytes], length: int):
    def cut(held: dict, run: int) -> Iterator[pa.RecordBatch]:
        items = sorted(held)
        edges = [0, *(bisect_right(items, s) for s in splitters), len(items)]
        for part, (a, b) in enumerate(zip(edges, edges[1:])):  # noqa: B905
            if a == b:
                continue
            shared, rest = front_code(items[a:b])
            own = [held[x] for x in items[a:b]]
            values = {f: [[o[j] for o in own]] for j, f in enumerate(("n", "h", "r1", "r2", "doc_id", "dig", "lo", "hi", "at"))}
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([run], pa.int64()), pa.array([shared], pa.list_(pa.int32())), pa.array([rest], pa.list_(pa.binary())), *(pa.array(values[f], pa.list_(pa.int64())) for f in FIELDS)],
                names=["part", "run", "shared", "rest", *FIELDS],
            )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, run = {}, 0, 0
        for batch in batches:
            for item, own in _places(batch, length):
                old = held.get(item)
                if old is None:
                    held[item] = [1, *own]
                    size += len(item) + 300
                else:
                    old[0] += 1
            if size > RUN_BYTES:
                yield from cut(held, run)
                held, size, run = {}, 0, run + 1
        yield from cut(held, run)

    return task


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of a key range, which come together and in the order of `part`."""
    schema = pa.schema([(f, pa.int64()) for f in FIELDS])

    def merged(runs: list) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        last = None
        for shared, item, own in LoserTree([front_decode(*r) for r in runs]):
            if last is not None and shared == len(item) == last:
                out[-1][3] += own[3]
            else:
                out.append(list(own))
            last = len(item)
            if len(out) > 50_000:
                yield columns(schema, **{f: [o[j] for o in out[:-1]] for j, f in enumerate(FIELDS)})
                out = out[-1:]
        if out:
            yield columns(schema, **{f: [o[j] for o in out] for j, f in enumerate(FIELDS)})

    part, runs = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                yield from merged(runs)
                part, runs = row["part"], []
            runs.append((row["shared"], row["rest"], list(zip(*(row[f] for f in FIELDS), strict=True))))
    yield from merged(runs)


def _splitters(rows: DataFrame, shared: DataFrame, parts: int, length: int) -> list[bytes]:
    """parts - 1 keys from at most SAMPLE distinct suffixes, chosen by their fingerprint."""
    some = shared.groupBy("r1").agg(*(F.first(c).alias(c) for c in ("h", "r2", "doc_id", "dig", "lo", "hi", "at")))
    some = some.orderBy("r1").limit(SAMPLE)

    def texts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in _places(batch, length)], pa.binary())], names=["suffix"])

    few = F.broadcast(listed(some, "h", "r1", "r2", "lo", "hi", "at"))  # SAMPLE rows at most
    found = sorted({bytes(r[0]) for r in with_places(rows, few, "inner").mapInArrow(texts, "suffix binary").collect()})
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if len(found) >= parts else found


def regions_by_merge(rows: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """Distinct regions with their number of places and one place each, by the distributed merge sort."""
    spark = rows.sparkSession
    parts = scratch.partitions(spark)
    splitters = _splitters(rows, shared, parts, length)
    runs = with_places(rows, listed(shared, "h", "r1", "r2", "lo", "hi", "at"), "inner").mapInArrow(trimmed(_run_task(splitters, length)), RUN)
    dealt = runs.repartitionById(max(parts, len(splitters) + 1), F.col("part"))
    return dealt.sortWithinPartitions("part").mapInArrow(trimmed(_merge_task), REGION)


def _cut(digest: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
        schema = pa.schema([*names, ("kept_sha256", pa.string()) if digest else ("kept", pa.binary()), ("spans", span)])
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            off, (s, e) = places_of(batch, "s", "e")
            n_bytes, n_removed, n_spans, kept, runs = [], [], [], [], []
            for row in range(batch.num_rows):
                data = raw[offsets[row] : offsets[row + 1]]
                own, a, b = data, [], []
                if off[row + 1] > off[row]:
                    gone = covered(len(data), s[off[row] : off[row + 1]], e[off[row] : off[row + 1]])
                    step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                    a, b = np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()
                    own = data[~gone]
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(own))
                n_spans.append(len(a))
                kept.append(hashlib.sha256(own.tobytes()).hexdigest() if digest else own.tobytes())
                runs.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
            yield columns(schema, doc_id=batch.column("doc_id"), n_bytes=n_bytes, n_removed=n_removed, n_spans=n_spans, spans=runs, **{"kept_sha256" if digest else "kept": kept})

    return task


def remove_repeats(docs: DataFrame, length: int = 200, k: int = 24, digest: bool = False) -> DataFrame:
    """Removes every byte that lies in a string of `length` bytes which starts elsewhere too.

    Returns doc_id, n_bytes, n_removed, n_spans, the maximal removed spans in bytes, and the
    remaining bytes (`kept`, or with digest their `kept_sha256`).
    """
    if not 1 <= k <= length:
        raise ValueError("k must be between 1 and length")
    spark = docs.sparkSession
    base = scratch.folder(spark)
    rows = keyed(docs)
    shared = shared_anchors(rows, "byte", k, length, base)
    regions = scratch.save(regions_by_merge(rows, shared, length), f"{base}/regions")
    scratch.release(spark)
    places = repeated_places(rows, shared, regions, "byte", length, base)
    kept = "kept_sha256 string" if digest else "kept binary"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}, spans array<struct<start:long,end:long>>"
    return with_places(rows, listed(places, "s", "e"), "left").mapInArrow(trimmed(_cut(digest)), schema)
