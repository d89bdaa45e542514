"""Encodings of text files, told by their bytes in one pass.

Lines are read as raw bytes, split by split, and each task adds up a few counts per file, so neither the size nor the
number of files matters. Rules decide in this order: byte-order marks; many zero bytes (UTF-16, its order told by the
file's first bytes); no byte above 127 (ASCII); lines that all are UTF-8; else one byte per character: bytes
128-159 speak for Windows-1252 (unless it doesn't define them), none of them for Latin-1. A file that is UTF-8 but for less than BROKEN
of the lines with such bytes is called UTF-8, with the share of its good lines as confidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of zero bytes from which a file is UTF-16; share of bad lines up to which it still is UTF-8.
ZEROS, BROKEN = 0.2, 0.2
COUNTS = ("lines", "bytes", "zeros", "high", "high_lines", "bad_lines", "controls", "undefined")
# fixed values: bytes that Windows-1252 doesn't define
UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def _valid(line: bytes) -> bool:
    try:
        line.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for file, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), strict=True):
            kinds = np.bincount(np.frombuffer(line, np.uint8), minlength=256)
            high = int(kinds[128:].sum())
            own = totals.setdefault(file, np.zeros(len(COUNTS), np.int64))
            own += [1, len(line), kinds[0], high, high > 0, high > 0 and not _valid(line), kinds[128:160].sum(), kinds[list(UNDEFINED)].sum()]
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), *(pa.array([int(t[i]) for t in totals.values()], pa.int64()) for i in range(len(COUNTS)))], names=["file", *COUNTS])


def detect(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, encoding (null if none fits), confidence (0 to 1), lines. The reader drops a UTF-8 mark, so such a file is utf-8; empty files have no row."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    sums = rows.select("file", "line").mapInArrow(_count, "file string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("file").agg(*(F.sum(c).alias(c) for c in COUNTS))
    first = rows.filter("split = 0").groupBy("file").agg(F.min_by(F.hex(F.substring("line", 1, 4)), "at").alias("head"))
    met = sums.join(first, "file", "left").fillna("", ["head"])
    zeros, good = F.try_divide("zeros", "bytes"), 1 - F.col("bad_lines") / F.greatest("high_lines", F.lit(1))
    starts = lambda x: F.startswith("head", F.lit(x))
    encoding = (
        F.when(starts("FFFE") | starts("FEFF"), "utf-16")
        .when(zeros >= ZEROS, F.when(starts("00"), "utf-16-be").otherwise("utf-16-le"))
        .when(F.col("high") == 0, "ascii").when(good >= 1 - BROKEN, "utf-8")
        .when(F.col("undefined") > 0, F.lit(None)).when(F.col("controls") > 0, "windows-1252").otherwise("latin-1")
    )
    confidence = F.when(encoding.isNull(), 0.0).when(encoding == "utf-8", good).when(encoding.isin("latin-1", "windows-1252"), 1 - good).otherwise(1.0)
    return met.select("file", encoding.alias("encoding"), F.round(confidence, 6).alias("confidence"), "lines")
