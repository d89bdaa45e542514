"""Token ids of a corpus in files of independently decodable rANS blocks.

Three passes: (1) documents are dealt into ranges of ascending doc_id, encoded by the tokenizer
and cut into segments of whole documents; (2) one frequency table is counted over all ids; (3)
every segment is written as rANS blocks (`rans`) with the ids and lengths of its documents. The
files are Parquet rows of segments, so any store, split and retry works, and each row decodes by
itself with the table beside them.

Defined results: null text counts as empty and has only the end id; rows with the same doc_id stay
separate and are ordered by text; a null doc_id comes first; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans, scratch
from .encoding import encoder
from .textcore import give_back

#: Characters that are encoded together: the more there are, the fewer distinct pieces to look up.
TOGETHER = 16 << 20
#: Ids after which a segment ends with its document.
SEGMENT = 1 << 17
TOKENS = "part int, seq long, start long, doc_ids array<long>, lengths array<long>, ids binary"
BLOCK = "struct<n:int,crc:long,at:array<int>,states:binary,words:binary>"
SEGMENTS = f"part int, seq long, start long, n_tokens long, doc_ids array<long>, lengths array<long>, blocks array<{BLOCK}>"
LONGS = pa.list_(pa.int64())


def _tokenize(path: str, end_id: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        end, kind = np.array([end_id], "<u4").tobytes(), "<u2" if enc.size <= 65536 else "<u4"
        seq = start = 0
        ids: list[int | None] = []
        held: list[bytes] = []

        def cut() -> pa.RecordBatch:
            nonlocal seq, start, ids, held
            lengths = [len(x) // 4 for x in held]
            data = np.frombuffer(b"".join(held), "<u4").astype(kind).tobytes()
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([start], pa.int64()), pa.array([ids], LONGS), pa.array([lengths], LONGS), pa.array([data], pa.binary())]
            seq, start, ids, held = seq + 1, start + sum(lengths), [], []
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "start", "doc_ids", "lengths", "ids"])

        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                some = batch.slice(i, 8192)
                for doc_id, own in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text"), TOGETHER), strict=True):
                    ids.append(doc_id)
                    held.append(own + end)
                    size += len(own) // 4 + 1
                    if size >= SEGMENT:
                        yield cut()
                        size = 0
        if ids:
            yield cut()
        give_back()

    return task


def _count(wide: bool, size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                counts += np.bincount(np.frombuffer(x.as_py(), "<u4" if wide else "<u2"), minlength=size)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["id", "n"])

    return task


def _write(freq: np.ndarray, wide: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        most = rans.LANES * rans.STEPS
        for whole in batches:
            for k in range(0, whole.num_rows, 16):
                batch = whole.slice(k, 16)
                pieces, owner = [], []
                for row, x in enumerate(batch.column("ids")):
                    ids = np.frombuffer(x.as_py(), "<u4" if wide else "<u2")
                    for i in range(0, len(ids), most):
                        pieces.append(ids[i : i + most])
                        owner.append(row)
                rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for row, block in zip(owner, rans.encode(pieces, table), strict=True):
                    rows[row].append(block)
                kind = pa.list_(pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("at", pa.list_(pa.int32())), ("states", pa.binary()), ("words", pa.binary())]))
                totals = pa.array([sum(b["n"] for b in r) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), batch.column("start"), totals, batch.column("doc_ids"), batch.column("lengths"), pa.array(rows, kind)], names=["part", "seq", "start", "n_tokens", "doc_ids", "lengths", "blocks"])

    return task


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Writes the ids of docs under `path`: segments in ascending doc_id order, and the table."""
    spark = docs.sparkSession
    work = scratch.folder(spark)
    n = scratch.partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = scratch.save(ordered.mapInArrow(_tokenize(tokenizer, end_id), TOKENS), f"{work}/tokens")
    scratch.release(spark)
    size = max(encoder(tokenizer).size, end_id + 1)
    wide = size > 65536
    counts = np.zeros(size, np.int64)
    # a row for each id of the vocabulary at most
    for r in tokens.select("ids").mapInArrow(_count(wide, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    freq = rans.Table.fit(counts).freq.astype(np.int64)
    held = [(i, int(f)) for i, f in enumerate(freq) if f]
    spark.createDataFrame(held, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")
    tokens.mapInArrow(_write(freq, wide), SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    scratch.drop(spark, work)
    scratch.release(spark)


def _read(freq: np.ndarray, digest: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(freq)
        for whole in batches:
            for k in range(0, whole.num_rows, 16):
                batch = whole.slice(k, 16)
                blocks = batch.column("blocks").to_pylist()
                got = iter(rans.decode([b for row in blocks for b in row], table))
                ids, starts, sizes, values = [], [], [], []
                for row, own, lengths, start in zip(blocks, batch.column("doc_ids").to_pylist(), batch.column("lengths").to_pylist(), batch.column("at").to_pylist(), strict=True):
                    data = np.concatenate([next(got) for _ in row]).astype("<u4").tobytes()
                    at = 0
                    for doc_id, n in zip(own, lengths, strict=True):
                        part = data[4 * at : 4 * (at + n)]
                        ids.append(doc_id)
                        starts.append(start + at)
                        sizes.append(n)
                        values.append(zlib.crc32(part) if digest else np.frombuffer(part, "<u4").astype(np.int64))
                        at += n
                last = pa.array(values, pa.int64() if digest else LONGS)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return task


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, and ids or with digest ids_crc32."""
    found = spark.read.parquet(f"{path}/table").collect()  # at most the vocabulary
    freq = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    for r in found:
        freq[r["id"]] = r["freq"]
    segments = spark.read.parquet(f"{path}/segments")
    # one row per written partition: their running sum is small whatever the corpus holds
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.selectExpr("part", "sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before")
    rows = segments.join(parts, "part").withColumn("at", F.col("start") + F.col("before")).select("at", "doc_ids", "lengths", "blocks")
    return rows.mapInArrow(_read(freq, digest), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")
