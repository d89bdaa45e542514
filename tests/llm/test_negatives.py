"""Hard negatives: a plain version over every pair."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score double, row string, positives string"


def plain(rows, every=5, positives=5, count=3):
    whole = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in (r for r in whole if r[0] % every == 0):
        dot = lambda r: sum(x * y for x, y in zip(a[2], r[2], strict=False))  # noqa: B023, E731
        ranked = sorted((r for r in whole if r != a), key=lambda r: (-dot(r), r[0]))
        for p in [r for r in ranked if r[1] == a[1]][:positives]:
            fit = [r for r in ranked if r[1] != a[1] and 50 * dot(p) <= 100 * dot(r) <= 95 * dot(p)][:count]
            out += [(a[0], p[0], k, r[0], dot(p), dot(r)) for k, r in enumerate(fit, 1)]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 0.5, "x", "y") for i, v, y in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("per_block", [(8192, 4096), (7, 4)])
def test_hard_negatives(spark, per_block):
    rnd = random.Random(3)
    point = lambda: [round(rnd.uniform(-1, 1), 1) for _ in range(4)]
    rows = [(i, point(), rnd.randrange(3)) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(12)]  # ties
    rows += [rows[5], rows[5], (10, point(), 1), (10, point(), 2)]  # repeated rows, one id twice
    rows += [(200, None, 1), (205, [None, 1.0], 1), (210, [float("nan"), 1.0], 1), (215, [float("inf"), 1.0], 2), (None, point(), 1), (220, point(), None)]
    rows += [(225, [], 1), (230, [1.0], 1), (235, [0.3] * 9, 1)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, per_block=per_block).collect()
    want = plain(rows)
    assert len(want) > 50
    assert Counter(tuple(r) for r in got) == want


def test_no_rows(spark):
    assert negatives.mine(frame(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    assert negatives.mine(frame(spark, [(5, [1.0], 1)]), F.col("vec_id") % 5 == 0).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 1.0], 1), (2, [2.7e6, 1.0], 2), (3, [2.7e6, 2.0], 2), (4, [1e30, 0.0], 3)]
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, k, i, (3 * 10**6 * 256) ** 2 + 256**2, 3 * 10**6 * 256 * 27 * 10**5 * 256 + 256**2 * f) for k, i, f in ((1, 3, 2), (2, 2, 1))]


def test_same_as_sql(same):
    same(queries.QUERIES["op12_hard_negatives"], queries.SQL["op12_hard_negatives"])
