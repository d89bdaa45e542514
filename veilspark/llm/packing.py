"""Packing by Karmarkar-Karp multiway differencing.

Each task packs its documents in batches, with no shuffle. Documents of a window's size or more
give full windows first. What remains is dealt over m windows: a partial partition holds m sums;
the two with the largest difference between their sums are merged by adding the largest sums of
one to the smallest of the other, until one partition is left, whose windows are near equal.
A window that still exceeds its capacity loses the end of its last document to windows with room,
so a batch cuts one document per such window at most; where all windows together are too small, or
with cut=False any one is, m rises. A batch ends inside a document where its ids fill m windows but
for a small slack.

Defined results: null text counts as empty and has only the end id; equal rows are packed
separately; a null doc_id is carried as it is; extra columns are ignored; an empty table gives no
rows. Every id lies in exactly one piece. With cut=False a document is in one piece unless it is
longer than a window or stands at the edge of a batch.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .textcore import give_back

#: Windows of a batch, and ids per window that a batch leaves free.
WINDOWS, SLACK = 64, 8
#: Characters that are encoded together, and pieces kept: packing follows other work, whose memory its executor still holds.
TOGETHER, KEEP = 2 << 20, 200_000


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Deals items over m groups of near-equal sums; lists of item numbers, by falling sum."""
    if not sizes:
        return [[] for _ in range(m)]
    left: list[int] = []
    right: list[int] = []
    n = len(sizes)
    heap: list[tuple] = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(m, np.int64), np.full(m, -1)
        sums[0], nodes[0] = s, i
        heap.append((-s, i, sums, nodes))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, p = heapq.heappop(heap)
        _, _, b, q = heapq.heappop(heap)
        sums, q = a + b[::-1], q[::-1]
        nodes = np.where(p < 0, q, p)
        both = np.flatnonzero((p >= 0) & (q >= 0))
        nodes[both] = n + len(left) + np.arange(len(both))
        left += p[both].tolist()
        right += q[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tick, sums, nodes))
        tick += 1
    out = []
    for node in heap[0][3].tolist():
        own, stack = [], [node] if node >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                own.append(x)
            else:
                stack += (left[x - n], right[x - n])
        out.append(own)
    return out


def pack(sizes: list[int], capacity: int, m: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length) of items of at most `capacity` ids each."""
    m = max(m, -(-sum(sizes) // capacity))
    while True:
        windows = [[(i, 0, sizes[i]) for i in sorted(g)] for g in differencing(sizes, m)]
        sums = [sum(x[2] for x in w) for w in windows]
        if max(sums) <= capacity:
            break
        if cut:
            level(windows, sums, capacity)
            break
        m += 1
    return [w for w in windows if w]


def level(windows: list[list[tuple[int, int, int]]], sums: list[int], capacity: int) -> None:
    """Moves what exceeds the capacity from the ends of windows to those with most room."""
    rooms = sorted(((s, w) for w, s in enumerate(sums) if s < capacity), reverse=True)
    for w, total in enumerate(sums):
        over = total - capacity
        while over > 0:
            item, start, length = windows[w].pop()
            moved = min(over, length)
            if moved < length:
                windows[w].append((item, start, length - moved))
            over -= moved
            at = start + length - moved
            while moved:
                have, to = rooms.pop()
                part = min(moved, capacity - have)
                windows[to].append((item, at, part))
                at, moved = at + part, moved - part
                if have + part < capacity:
                    rooms.append((have + part, to))


class Packer:
    """Takes documents one by one and gives finished batches of windows."""

    def __init__(self, capacity: int, cut: bool = True):
        self.capacity, self.cut, self.room = capacity, cut, WINDOWS * max(1, capacity - SLACK)
        self.window = 0
        self.items: list[tuple[int, int, int]] = []  # document, start, length
        self.size = 0

    def add(self, doc: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, window, offset) of what is finished."""
        start = 0
        while n - start >= self.capacity:
            yield doc, start, self.capacity, self.window, 0
            self.window += 1
            start += self.capacity
        while n > start:
            some = min(n - start, self.room - self.size)
            self.items.append((doc, start, some))
            self.size += some
            start += some
            if self.size == self.room:
                yield from self.flush(WINDOWS)

    def flush(self, m: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
        if not self.items:
            return
        for own in pack([x[2] for x in self.items], self.capacity, m or -(-self.size // self.capacity), self.cut):
            at = 0
            for i, a, length in own:
                doc, start, _ = self.items[i]
                yield doc, start + a, length, self.window, at
                at += length
            self.window += 1
        self.items, self.size = [], 0


def _pack_task(path: str, end_id: int, capacity: int, digest: bool, cut: bool):
    longs = pa.list_(pa.int64())
    names = ["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else longs, pa.int64(), pa.int64(), pa.int64()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, KEEP), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        packer = Packer(capacity, cut)
        docs: dict[int, tuple] = {}
        rows: list[tuple] = []
        count = 0

        def out(found) -> None:
            for doc, start, length, window, offset in found:
                doc_id, data = docs[doc]
                own = data[4 * start : 4 * (start + length)]
                value = zlib.crc32(own) if digest else np.frombuffer(own, "<u4").astype(np.int64)
                rows.append((doc_id, start, length, value, len(data) // 4, first + window, offset))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return made

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                for doc_id, own in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text"), TOGETHER), strict=True):
                    docs[count] = doc_id, own + end
                    out(packer.add(count, len(own) // 4 + 1))
                    count += 1
                open_docs = {x[0] for x in packer.items}
                docs = {k: v for k, v in docs.items() if k in open_docs}
                if rows:
                    yield batch_of()
        out(packer.flush())
        docs.clear()
        enc.forget()
        if rows:
            yield batch_of()
        give_back()

    return task


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, digest: bool = False, cut: bool = True) -> DataFrame:
    """doc_id, start, length, ids (or with digest ids_crc32), doc_tokens, sequence_id, offset of each piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    last = "ids_crc32 long" if digest else "ids array<long>"
    return rows.mapInArrow(_pack_task(tokenizer, end_id, capacity, digest, cut), f"doc_id long, start long, length long, {last}, doc_tokens long, sequence_id long, offset long")
