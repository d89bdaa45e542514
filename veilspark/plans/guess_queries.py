"""Queries over guesses in the order of fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guesses as E
from ..operators import markov as M
from ..operators import pcfg as P
from ..session import cut
from . import domain
from .domain import PASSWORDS
from .model_queries import GRAMMAR, LETTERS
from .registry import registry

QUERIES, SQL, query = registry()

#: Guesses in a report; the highest letter rank that is laid out.
TOP, RANK = 2000, 44


def run_segments(words):
    """words with segs and structure by plain runs of letters, digits and other characters."""
    kind = lambda x: F.when(x.rlike("^[a-zA-Z]"), "A").when(x.rlike("^[0-9]"), "D").otherwise("O")
    runs = F.regexp_extract_all("password", F.lit("[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))
    segs = F.transform(runs, lambda x: F.struct(kind(x).alias("type"), F.length(x).alias("len"), x.alias("value")))
    name = F.array_join(F.transform("segs", lambda s: F.concat(s["type"], s["len"].cast("string"))), "")
    return words.withColumn("segs", segs).withColumn("structure", name)


RUNS = PASSWORDS + """, segs AS MATERIALIZED (SELECT pid, list_transform(regexp_extract_all(password, '[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9]+'), lambda x: {'t': CASE WHEN regexp_matches(x, '^[a-zA-Z]') THEN 'A' WHEN regexp_matches(x, '^[0-9]') THEN 'D' ELSE 'O' END, 'n': length(x), 'v': x}) AS s FROM passwords),
  x AS (SELECT pid, unnest(s) AS e FROM segs),
  items AS (SELECT e.t AS t, e.n AS n, CASE WHEN e.t = 'A' THEN lower(e.v) ELSE e.v END AS v FROM x UNION ALL SELECT 'C', e.n, regexp_replace(regexp_replace(e.v, '[^a-z]', 'U', 'g'), '[a-z]', 'L', 'g') FROM x WHERE e.t = 'A'),
  terms AS MATERIALIZED (SELECT t, n, v, count(*) / sum(count(*)) OVER (PARTITION BY t, n) AS p FROM items GROUP BY t, n, v),
  structures AS (SELECT structure, count(*) / sum(count(*)) OVER () AS p FROM (SELECT list_aggregate(list_transform(s, lambda y: y.t || y.n), 'string_agg', '') AS structure FROM segs) GROUP BY 1)"""


GROWN = """grown AS (SELECT structure, '' AS word, p, structure AS rest, NULL::VARCHAR AS held FROM structures
  UNION ALL SELECT g.structure, g.word || CASE WHEN t.t = 'A' THEN '' WHEN t.t = 'C' THEN list_aggregate(list_transform(range(1, length(g.held) + 1), lambda i: CASE WHEN t.v[i] = 'U' THEN upper(g.held[i]) ELSE g.held[i] END), 'string_agg', '') ELSE t.v END,
        g.p * t.p, CASE WHEN t.t = 'A' THEN 'C' || t.n || regexp_replace(g.rest, '^[A-Z][0-9]+', '') ELSE regexp_replace(g.rest, '^[A-Z][0-9]+', '') END, CASE WHEN t.t = 'A' THEN t.v END
      FROM grown g JOIN terms t ON g.rest <> '' AND t.t = g.rest[1] AND t.n = CAST(regexp_extract(g.rest, '^[A-Z]([0-9]+)', 1) AS INTEGER))"""
BEST = f"SELECT row_number() OVER (ORDER BY p DESC, word, structure)::INTEGER AS rank, word, structure, round(p, 12) AS prob FROM grown WHERE rest = '' ORDER BY p DESC, word, structure LIMIT {TOP}"


@query(f"WITH RECURSIVE {RUNS}, {GROWN} {BEST}")
def run_guesses(spark, d):
    """The likeliest guesses of a grammar of plain runs."""
    probs = P.probabilities(P.items(run_segments(domain.passwords(spark, d))))
    return E.best_first(probs, TOP).withColumn("prob", F.round("prob", 12))


@query(f"WITH RECURSIVE {GRAMMAR}, structures AS (SELECT v AS structure, p FROM terms WHERE t = 'S'), {GROWN} {BEST}")
def pcfg_guesses(spark, d):
    """The likeliest guesses of the whole grammar, with its keyboard and context segments."""
    return E.best_first(cut(P.probabilities(P.items(P.parsed(domain.passwords(spark, d))))), TOP).withColumn("prob", F.round("prob", 12))


@query(
    f"""WITH RECURSIVE {LETTERS}, w AS (SELECT c AS word, rank, c FROM ranks WHERE prev IS NULL AND rank <= {RANK} UNION ALL SELECT word || r.c, w.rank + r.rank, r.c FROM w JOIN ranks r ON r.prev = w.c WHERE w.rank + r.rank <= {RANK} AND length(word) < 16)
    SELECT row_number() OVER (ORDER BY rank, length(word), word) - 1 AS position, word, rank::INTEGER AS rank FROM w"""
)
def markov_guesses(spark, d):
    """All words up to a total letter rank, by rank, length and word."""
    return E.rank_words(M.letter_ranks(domain.passwords(spark, d)), 1, RANK)
