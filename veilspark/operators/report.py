"""Curves and tables for reports. Curves are rows (curve, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mean_of_curves(curves: DataFrame) -> DataFrame:
    return curves.groupBy("x").agg(F.avg("y").alias("y"))


def truncated_mean(curves: DataFrame) -> DataFrame:
    """Mean over curves cut to an integer, as in older reports."""
    return curves.groupBy("x").agg(F.floor(F.sum("y") / F.count(F.lit(1))).alias("y"))


def normalised(curves: DataFrame, users: int) -> DataFrame:
    return curves.withColumn("y", F.col("y") / users)


def by_last(curves: DataFrame) -> DataFrame:
    """Each curve over its last value."""
    last = curves.groupBy("curve").agg(F.max_by("y", "x").alias("last"))
    return curves.join(last, "curve").withColumn("y", F.col("y") / F.col("last")).drop("last")


def baseline(spark, k: int) -> DataFrame:
    """x, y of perfect flatness: x / k."""
    return spark.range(1, k + 1).select(F.col("id").alias("x"), (F.col("id") / k).alias("y"))


def perfect_success(spark, failures: int, k: int) -> DataFrame:
    return spark.range(0, failures + 1).select(F.col("id").alias("x"), (F.col("id") / (k - 1)).alias("y"))


def interpolated(curves: DataFrame, grid: DataFrame) -> DataFrame:
    """curve, x, y at the grid's points: linear between neighbours, constant outside.

    The grid is dealt to each curve with its points and the neighbours come from windows, so no range join is needed.
    """
    ids = curves.select("curve").distinct()
    points = curves.groupBy("curve", "x").agg(F.max("y").alias("y")).select("curve", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(False).alias("asked"))
    asked = ids.crossJoin(F.broadcast(grid.select(F.col("x").cast("double").alias("x")))).select("curve", "x", F.lit(None).cast("double").alias("y"), F.lit(True).alias("asked"))  # grid points
    w = W.partitionBy("curve").orderBy("x", "asked")
    known = lambda c: F.when(~F.col("asked"), F.col(c))
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    all_ = points.unionByName(asked).withColumns({"x0": F.last(known("x"), True).over(back), "y0": F.last(known("y"), True).over(back), "x1": F.first(known("x"), True).over(ahead), "y1": F.first(known("y"), True).over(ahead)})
    y = F.when(F.col("x0").isNull(), F.col("y1")).when(F.col("x1").isNull() | (F.col("x1") == F.col("x0")) | (F.col("x0") == F.col("x")), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return all_.filter("asked").select("curve", "x", y.alias("y"))


def cosine_to(curves: DataFrame, base: DataFrame) -> DataFrame:
    """curve, cosine of each curve with a baseline of the same points."""
    both = curves.join(base.select("x", F.col("y").alias("b")), "x")
    return both.groupBy("curve").agg((F.sum(F.col("y") * F.col("b")) / (F.sqrt(F.sum(F.col("y") * F.col("y"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))))).alias("cosine"))


def success_at(curves: DataFrame, t2: int) -> DataFrame:
    """Mean index of the first point above t2 (or just behind one equal to it), else the last index; cut to an integer."""
    above, equal = F.min(F.when(F.col("y") > t2, F.col("x"))), F.min(F.when(F.col("y") == t2, F.col("x") + 1))
    per = curves.groupBy("curve").agg(F.coalesce(F.least(above, equal), F.max("x")).alias("z"))
    return per.agg(F.floor(F.avg("z")).alias("successes"))


def method_table(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("method").agg(F.avg("epsilon").alias("epsilon"), F.avg("success").alias("success"))


def latex(table: DataFrame) -> str:
    """A table of methods as LaTeX rows; as long as there are methods."""
    rows = table.orderBy("method").select(F.format_string("%s & %.4f & %.4f\\%% \\\\", "method", "epsilon", F.col("success") * 100)).collect()
    return "\n".join(["\\begin{tabular}{lrr}", *[r[0] for r in rows], "\\end{tabular}"])


def completeness(lists: DataFrame, least: int = 19) -> DataFrame:
    """Rows with enough decoys, and rows that repeat the real word (columns real, decoys)."""
    clean = F.filter("decoys", lambda d: (F.trim(d) != "") & (F.lower(d) != "nan"))
    return lists.agg(F.count_if(F.size(clean) >= least).alias("complete"), F.count_if(F.array_contains("decoys", F.col("real"))).alias("repeats_real"))


# fixed values: share of study participants that found the real word within 1 to 5 guesses
USER_STUDY = (0.063636364, 0.121212121, 0.163636364, 0.184848485, 0.239393939)


def against_study(measured: DataFrame) -> DataFrame:
    """t, study, share, gap: a measured curve (t, share) beside the published one of a study with people, where both have t."""
    study = F.get(F.array(*map(F.lit, USER_STUDY)), F.col("t") - 1)
    rows = measured.filter((F.col("t") >= 1) & (F.col("t") <= len(USER_STUDY))).withColumn("study", study)
    return rows.select("t", "study", F.round("share", 9).alias("share"), F.round(F.col("share") - F.col("study"), 9).alias("gap"))
