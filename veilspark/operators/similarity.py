"""Vector similarity: neighbours of stated queries in cells, decoy similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors and queries that meet in one task; a cell of more is dealt over several.
ROWS, QUERIES = 8192, 4096
#: Queries whose similarities are held at once.
HELD = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _best(n: int, digits: int, names: tuple[str, str], schema: pa.Schema):
    """The n best vectors of a block for each query of another, by rounded similarity, then id; the query's own id is left out."""

    def task(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        vectors = vectors.sort_by(names[1])
        q, v = _matrix(queries.column("q")), _matrix(vectors.column("v"))
        asked, ids = queries.column(names[0]).to_pylist(), vectors.column(names[1]).to_pylist()
        own = {x: i for i, x in enumerate(ids)}
        at, hit, value = [], [], []
        for first in range(0, len(q), HELD):
            found = np.round(q[first : first + HELD] @ v.T, digits)
            for i, line in enumerate(found, first):
                if asked[i] in own:
                    line[own[asked[i]]] = -np.inf
                edge = np.partition(line, len(line) - n)[len(line) - n] if len(line) > n else -np.inf
                some = np.flatnonzero((line >= edge) & (line > -np.inf))
                some = some[np.argsort(-line[some], kind="stable")][:n]  # ids ascend
                at += [asked[i]] * len(some)
                hit += [ids[j] for j in some.tolist()]
                value.append(line[some])
        return pa.Table.from_arrays([pa.array(at, schema.types[0]), pa.array(hit, schema.types[1]), pa.array(np.concatenate(value))], schema=schema)

    return task


def in_cells(queries: DataFrame, vectors: DataFrame, n: int, names: tuple[str, str] = ("query_id", "vec_id"), digits: int = 9) -> DataFrame:
    """query, vector, similarity, rank: the n most similar vectors of each query among the cells that it names.

    queries: id, cell, q; vectors: id, cell, v (unit vectors, ids unique). A cell is a grid of blocks of vectors and
    blocks of queries; one task computes one product of two blocks and keeps the best n of each query,
    which a window merges. So no task holds more than two blocks, however many share a cell.
    """
    cell = ["cell"]
    counts = vectors.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows")).join(queries.groupBy(*cell).agg(F.count(F.lit(1)).alias("asked")), cell)
    sizes = counts.select("cell", F.ceil(F.col("rows") / ROWS).cast("int").alias("down"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("across"))  # a row per cell, of which there are few
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = lambda key, count: F.pmod(F.xxhash64(key), F.col(count)).cast("int")
    sizes = F.broadcast(sizes)
    right = vectors.join(sizes, cell).withColumn("r", own(names[1], "down")).withColumn("c", every("across"))
    left = queries.join(sizes, cell).withColumn("c", own(names[0], "across")).withColumn("r", every("down"))
    left, right = left.select(*cell, "r", "c", names[0], "q"), right.select(*cell, "r", "c", names[1], "v")
    kinds = [left.schema[names[0]].dataType, right.schema[names[1]].dataType]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([(names[0], to_arrow_type(kinds[0])), (names[1], to_arrow_type(kinds[1])), ("similarity", pa.float64())])
    met = left.groupBy(*cell, "r", "c").cogroup(right.groupBy(*cell, "r", "c"))
    some = met.applyInArrow(_best(n, digits, names, schema), f"{names[0]} {kinds[0].simpleString()}, {names[1]} {kinds[1].simpleString()}, similarity double")
    final = W.partitionBy(names[0]).orderBy(F.desc("similarity"), names[1])
    return some.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)


def nearest(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """query_id, vec_id, similarity, rank of the n nearest vectors of each query, itself left out; every query meets every vector, block by block."""
    q = queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("cell"), unit(F.col("embedding")).alias("q"))
    return in_cells(q, vectors.select("vec_id", F.lit(0).alias("cell"), unit(F.col("embedding")).alias("v")), n)


def list_similarity(rows: DataFrame) -> DataFrame:
    """user_id, similarity: mean cosine of each user's real vector and decoy vectors (columns real, decoys); 1 without decoys."""
    mean = F.aggregate(F.transform("decoys", lambda d: dot(unit(F.col("real")), unit(d))), F.lit(0.0), lambda s, x: s + x) / F.size("decoys")
    return rows.select("user_id", F.when(F.size("decoys") > 0, mean).otherwise(1.0).alias("similarity"))
