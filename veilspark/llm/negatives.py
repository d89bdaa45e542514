"""Hard negatives by a full score sort of each anchor, in blocks.

Anchors (a stated query set) meet all rows in cells of a grid: rows are dealt into blocks by their
hash, anchors into others, and a cell holds one block of each. In a cell every anchor's integer
scores with all rows of the block are computed by one matrix product and sorted in full, by falling score
and then by id. The positives are the first rows of the anchor's label in that order; the firsts of all
blocks are merged by a window. In a second round over the same grid each positive's upper limit is
found in the sorted scores by binary search, and the first different-label rows from there down to the
lower limit are read; again the firsts of all blocks are merged. The first k of a union are among
the firsts of its parts, so the blocks change nothing, and no task ever holds more than a cell.

Scores are exact: products of floats where all sums stay below 2**53, Python's integers elsewhere
(scores, like components, are held at the ends of 64 bits).

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take
no part; rows equal in id, label and vector count once, while rows of one id that differ are rows of
their own, and only an anchor's very own row is barred from its positives; vectors of different
lengths are filled up with zeros; ties go by smaller id, then by row; an anchor without
another row of its label gives no rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

#: Rows and anchors of a cell; a row of a block is copied once per block of anchors, and an anchor once per block of rows.
ROWS, ANCHORS = 8192, 4096
#: Anchors whose scores are held at once.
CHUNK = 64
END = (1 << 63) - 1


def prepare(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """vec_id, label and the integer components (as doubles) of the rows that take part, each once."""
    whole = "embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    code = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return vectors.filter(F.expr(whole)).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), code.alias("code")).distinct()


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Components by row, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = values
    return out


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products, anchors by rows."""
    top = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, anchors.shape[1])
    if top < 1 << 53:
        return (anchors @ rows.T).astype(np.int64)
    whole = [[sum(int(x) * int(y) for x, y in zip(a, r, strict=True)) for r in rows] for a in anchors]
    return np.array([[min(END, max(-END, s)) for s in line] for line in whole], np.int64).reshape(len(anchors), len(rows))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _cell(read: Callable, names: list[tuple[str, pa.DataType]]):
    """A task over one cell; read(anchor's place, its table, order, sorted scores, labels, rows) gives places in the sort, with values that lead the rows."""
    schema = pa.schema(names)

    def task(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return schema.empty_table()
        rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        width = int(max(pa.compute.max(pa.compute.list_value_length(t.column("code"))).as_py() for t in (rows, anchors)))
        own, ids, labels = _numbers(rows, "row"), _numbers(rows, "vec_id"), _numbers(rows, "label")
        right, left = matrix(rows.column("code"), width), matrix(anchors.column("code"), width)
        at, kinds, extra = _numbers(anchors, "row"), _numbers(anchors, "label"), anchors.column("positives").to_pylist() if "positives" in anchors.column_names else None
        out: list[list[np.ndarray]] = [[] for _ in names]
        for first in range(0, len(at), CHUNK):
            found = scores(left[first : first + CHUNK], right)
            for i, line in enumerate(found, first):
                order = np.argsort(-line, kind="stable")  # ids ascend, so ties go by id
                ranked = line[order]
                for lead, places in read(at[i], kinds[i], extra and extra[i], order, ranked, labels, own):
                    held = order[places]
                    for to, values in zip(out, (*(np.full(len(places), x, np.int64) for x in (at[i], *lead)), ids[held], own[held], ranked[places]), strict=True):
                        to.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in out], schema=schema)

    return task


def _first_of_label(count: int):
    def read(at, kind, _, order, ranked, labels, own):
        same = np.flatnonzero((labels[order] == kind) & (own[order] != at))[:count]
        return [((), same)] if len(same) else []

    return read


def _below_limits(count: int, lower: int, upper: int):
    def read(at, kind, positives, order, ranked, labels, own):
        other = np.flatnonzero(labels[order] != kind)
        falling = -ranked[other]
        for p in positives or []:
            high, low = upper * p["score"] // 100, -(-lower * p["score"] // 100)
            first = int(np.searchsorted(falling, -high, side="left"))
            places = other[first : first + count]
            places = places[ranked[places] >= low]
            if len(places):
                yield (p["j"],), places

    return read


def _grid(rows: DataFrame, anchors: DataFrame, n: int, m: int, per_block: tuple[int, int], read: Callable, lead: list[str]) -> DataFrame:
    """read's rows of every cell."""
    down, across = -(-n // per_block[0]), -(-m // per_block[1])
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda count: F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")
    left = rows.select(own(down).alias("r"), every(across).alias("a"), "row", "vec_id", "label", "code").groupBy("a", "r")
    right = anchors.withColumn("a", own(across)).withColumn("r", every(down)).groupBy("a", "r")
    names = ["row", *lead, "other_id", "other", "score"]
    return left.cogroup(right).applyInArrow(_cell(read, [(x, pa.int64()) for x in names]), ", ".join(f"{x} long" for x in names))


def mine(vectors: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, scale: int = 256, per_block: tuple[int, int] = (ROWS, ANCHORS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, label, embedding; anchor tells which vec_id are anchors. Negatives score at least `lower`
    and at most `upper` hundredths of the positive.
    """
    spark = vectors.sparkSession
    base = scratch.folder(spark)
    rows = scratch.save(prepare(vectors, F.col("label") if label is None else label, scale).withColumn("row", F.monotonically_increasing_id()), f"{base}/rows")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(anchor, 1)).alias("m")).first()
    anchors = spark.read.parquet(f"{base}/rows").filter(anchor)  # columns of their own
    n, m = max(1, told["n"]), max(1, told["m"])
    first = lambda df, count, *key: df.withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "other_id", "other"))).filter(F.col("k") <= count)
    same = first(_grid(rows, anchors, n, m, per_block, _first_of_label(positives), []), positives, "row")
    same = scratch.save(same.select("row", F.col("k").cast("long").alias("j"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), f"{base}/positives")
    lists = same.groupBy("row").agg(F.collect_list(F.struct("j", F.col("positive_score").alias("score"))).alias("positives"))  # of `positives` entries at most
    asking = anchors.join(lists, "row")
    other = first(_grid(rows, asking, n, m, per_block, _below_limits(negatives, lower, upper), ["j"]), negatives, "row", "j")
    named = anchors.select("row", F.col("vec_id").alias("anchor_id")).join(same, "row")
    out = other.join(named, ["row", "j"])
    return out.select("anchor_id", "positive_id", F.col("k").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


# DuckDB; rows with unique ids
SQL = """
WITH v AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, a.label AS al, b.id AS b, b.label AS bl, list_inner_product(a.c, b.c)::BIGINT AS s FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.p, p.ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.b) AS k
  FROM p JOIN s ON s.a = p.a WHERE s.al <> s.bl AND 50 * ps <= 100 * s.s AND 100 * s.s <= 95 * ps)
SELECT a AS anchor_id, p AS positive_id, k::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 3
"""
