"""Queries over single words: strength by guesses, learned chunks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import chunks as K
from ..operators import strength as T
from . import domain
from .registry import registry

QUERIES, SQL, query = registry()


def _scored(spark, d):
    """Passwords by their guesses, with the commonest words of the documents and the names of parts as dictionary."""
    listed = domain.word_counts(spark, d).unionByName(domain.passwords(spark, d).select(F.explode(F.regexp_extract_all("password", F.lit("[A-Za-z]+"), F.lit(0))).alias("password")).groupBy("password").agg(F.count(F.lit(1)).alias("cnt")))
    top = listed.groupBy("password").agg(F.sum("cnt").alias("cnt")).orderBy(F.desc("cnt"), "password").limit(T.LENGTH)
    ranking = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("cnt"), "password")))  # the dictionary's length
    return T.scored(domain.passwords(spark, d), ranking)


@query()
def password_strength(spark, d):
    """Guesses (log10), score from 0 to 4 and parts of every password."""
    return _scored(spark, d)


@query()
def strongest_by_guesses(spark, d):
    """A top-200 by the guesses needed."""
    return T.extremes(_scored(spark, d), 200)


@query()
def weakest_by_guesses(spark, d):
    return T.extremes(_scored(spark, d), 200, strongest=False)


@query()
def password_chunks(spark, d):
    """Every password along the likeliest pieces of a model learned from all of them."""
    words = domain.passwords(spark, d)
    counted = words.groupBy("password").agg(F.count(F.lit(1)).alias("cnt"))
    return K.cut_words(words, K.fit(counted))
