"""Queries over fitted models: Markov chains, letter ranks, grammars, personal data."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import pii
from ..functions import strings as S
from ..functions.segment import CONTEXT, LOOKALIKES, ROWS, SHIFTED, SHORTEST_RUN, STEPS, segment, structure
from ..operators import decoys as G
from ..operators import guesses as E
from ..operators import markov as M
from ..operators import pcfg as P
from ..session import cut
from . import domain
from .domain import PASSWORDS, USERS
from .draw_sql import ASSEMBLED, chain, grammar
from .registry import registry

QUERIES, SQL, query = registry()


def chain_of(rows: str) -> str:
    """win, trans and starts of rows(password)."""
    return f"""win AS (SELECT CASE WHEN length(password) < 4 THEN password ELSE substr(pw, i, 4) END AS ctx, CASE WHEN length(password) < 4 THEN chr(10) ELSE substr(pw, i + 4, 1) END AS nxt
    FROM (SELECT password, password || chr(10) AS pw, unnest(range(1, greatest(length(password) - 3, 1) + 1)) AS i FROM {rows})),
  trans AS (SELECT ctx, nxt, n, n / sum(n) OVER (PARTITION BY ctx) AS p FROM (SELECT ctx, nxt, count(*) AS n FROM win GROUP BY ALL)),
  starts AS (SELECT start, n, n / (SELECT count(*) FROM {rows})::DOUBLE AS p FROM (SELECT substr(password, 1, 4) AS start, count(*) AS n FROM {rows} GROUP BY 1))"""


CHAIN = f"{PASSWORDS}, {chain_of('passwords')}"


@query(f"WITH {CHAIN} SELECT start, n, p FROM starts")
def markov_starts(spark, d):
    return M.starts(domain.passwords(spark, d))


@query(f"WITH {CHAIN} SELECT ctx, nxt, n, round(p, 9) AS p FROM trans")
def markov_transitions(spark, d):
    return M.transitions(domain.passwords(spark, d)).withColumn("p", F.round("p", 9))


@query(
    f"""WITH {CHAIN}, steps AS (SELECT password, CASE WHEN length(password) < 4 THEN password ELSE substr(pw, i, 4) END AS ctx, CASE WHEN length(password) < 4 THEN chr(10) ELSE substr(pw, i + 4, 1) END AS nxt
      FROM (SELECT password, password || chr(10) AS pw, unnest(range(1, greatest(length(password) - 3, 1) + 1)) AS i FROM (SELECT DISTINCT password FROM passwords)))
    SELECT s.password, round(sum(ln(t.p)) + max(ln(b.p)), 6) AS logp FROM steps s JOIN trans t USING (ctx, nxt) JOIN starts b ON b.start = substr(s.password, 1, 4) GROUP BY 1"""
)
def markov_logprob(spark, d):
    c = domain.passwords(spark, d)
    return M.log_probability(c, M.transitions(c), M.starts(c)).withColumn("logp", F.round("logp", 6))


@query(f"WITH RECURSIVE {CHAIN}, {USERS}, {chain(210)}, {ASSEMBLED}")
def markov_decoys(spark, d):
    """Decoy lists sampled from the chain."""
    c, u = domain.passwords(spark, d), domain.users(spark, d)
    transitions, starts = cut(M.transitions(c)), cut(M.starts(c))
    draws = G.in_rounds(u, lambda some, at: M.sample(some, transitions, starts, at, 67), 20, None, 30)
    return G.assemble(draws, u, 20, 67)


LETTERS = PASSWORDS + """, ch AS (SELECT NULL::VARCHAR AS prev, c FROM (SELECT unnest(string_split(password, '')) AS c FROM passwords)
    UNION ALL SELECT substr(password, i - 1, 1), substr(password, i, 1) FROM (SELECT password, unnest(range(2, length(password) + 1)) AS i FROM passwords)),
  ranks AS (SELECT prev, c, n, greatest(1, CAST(round_even(-10 * log10(n / sum(n) OVER (PARTITION BY prev)), 0) AS INTEGER)) AS rank FROM (SELECT prev, c, count(*) AS n FROM ch GROUP BY ALL))"""


@query(f"WITH {LETTERS} SELECT prev, c, n, rank FROM ranks")
def jtr_letter_ranks(spark, d):
    return M.letter_ranks(domain.passwords(spark, d))


HIST = LETTERS + """, totals AS (SELECT pid, sum(rank)::BIGINT AS total_rank FROM (SELECT pid, CASE WHEN i > 1 THEN substr(password, i - 1, 1) END AS prev, substr(password, i, 1) AS c FROM (SELECT pid, password, unnest(range(1, length(password) + 1)) AS i FROM passwords)) x
    JOIN ranks r ON x.c = r.c AND x.prev IS NOT DISTINCT FROM r.prev GROUP BY pid)"""


@query(f"WITH {HIST} SELECT total_rank, count(*)::BIGINT AS n FROM totals GROUP BY 1")
def rank_histogram(spark, d):
    c = domain.passwords(spark, d)
    return M.rank_histogram(M.word_ranks(c, M.letter_ranks(c)))


SPACES = """dp AS (SELECT 1 AS len, rank, c, 1::HUGEINT AS k FROM ranks WHERE prev IS NULL UNION ALL
    SELECT len, rank, c, sum(k) FROM (SELECT d.len + 1 AS len, d.rank + r.rank AS rank, r.c, d.k FROM dp d JOIN ranks r ON r.prev = d.c WHERE d.len < 16 AND d.rank + r.rank <= 1000) GROUP BY ALL),
  sizes AS (SELECT i::INTEGER AS rank, coalesce(k, 0) AS size, sum(coalesce(k, 0)) OVER (ORDER BY i) - coalesce(k, 0) AS before FROM range(1, 1001) r(i) LEFT JOIN (SELECT rank, sum(k) AS k FROM dp GROUP BY rank) ON rank = i),
  seen AS (SELECT s.rank, size, n FROM sizes s LEFT JOIN (SELECT total_rank, count(*) AS n FROM totals GROUP BY 1) ON total_rank = s.rank WHERE before <= 1e12),
  grouped AS (SELECT max(rank) AS rank, max(n) AS n, sum(size) AS size FROM (SELECT *, sum((n IS NOT NULL)::INTEGER) OVER (ORDER BY rank DESC) AS g FROM seen) WHERE g > 0 GROUP BY g)"""


@query(f"WITH RECURSIVE {HIST}, {SPACES} SELECT rank::BIGINT AS rank, n::BIGINT AS n, size::BIGINT AS size, round(CASE WHEN size > 0 THEN n / (size * (SELECT sum(n) FROM grouped))::DOUBLE ELSE 0 END, 15) AS p FROM grouped")
def rank_rollup(spark, d):
    """Observed ranks with the number of words up to 16 letters that share them."""
    c = domain.passwords(spark, d)
    ranks = cut(M.letter_ranks(c))
    spaces = cut(E.rank_sizes(ranks)).withColumn("size", F.col("size").cast("long"))
    return M.rollup_ranks(M.rank_histogram(M.word_ranks(c, ranks)), spaces).withColumn("p", F.round("p", 15))


@query(f"WITH {PASSWORDS} SELECT c, count(*) AS n FROM (SELECT unnest(string_split(password, '')) AS c FROM passwords WHERE length(password) >= 4) WHERE c <> '' AND c <> chr(9) GROUP BY 1 ORDER BY n DESC, c LIMIT 30")
def alphabet_top(spark, d):
    """The 30 commonest characters."""
    return M.alphabet(domain.passwords(spark, d), 30)


TAGS = USERS + """, tags AS (SELECT user_id, password, unnest([{'tag': 'N1', 'value': first_name || last_name}, {'tag': 'N2', 'value': first_name[1] || last_name[1]}, {'tag': 'N3', 'value': last_name}, {'tag': 'N4', 'value': first_name},
    {'tag': 'N5', 'value': first_name[1] || last_name}, {'tag': 'N6', 'value': last_name || first_name[1]}, {'tag': 'N7', 'value': upper(last_name[1]) || last_name[2:]},
    {'tag': 'B1', 'value': birthday[5:8] || birthday[3:4] || birthday[1:2]}, {'tag': 'B2', 'value': birthday[3:4] || birthday[1:2] || birthday[5:8]}, {'tag': 'B3', 'value': birthday}, {'tag': 'B4', 'value': birthday[1:4]}, {'tag': 'B5', 'value': birthday[5:8]},
    {'tag': 'B6', 'value': birthday[5:8] || birthday[3:4]}, {'tag': 'B7', 'value': birthday[3:8]}, {'tag': 'B8', 'value': birthday[7:8] || birthday[3:4] || birthday[1:2]}, {'tag': 'B9', 'value': birthday[3:4] || birthday[1:2] || birthday[7:8]}, {'tag': 'B10', 'value': birthday[1:4] || birthday[7:8]},
    {'tag': 'U1', 'value': username}, {'tag': 'U2', 'value': regexp_extract(username, '([a-zA-Z]+)([0-9]+)', 1)}, {'tag': 'U3', 'value': regexp_extract(username, '([a-zA-Z]+)([0-9]+)', 2)},
    {'tag': 'E1', 'value': string_split(email, '@')[1]}, {'tag': 'E2', 'value': regexp_extract(string_split(email, '@')[1], '([a-zA-Z]+)([0-9]+)', 1)}, {'tag': 'E3', 'value': regexp_extract(string_split(email, '@')[1], '([a-zA-Z]+)([0-9]+)', 2)}]) AS t FROM users)"""


def _tags():
    return pii.tag_values(F.col("first_name"), F.col("last_name"), F.col("username"), F.col("email"), F.col("birthday"))


@query(f"WITH {TAGS} SELECT user_id, t.tag AS tag, t.value AS value FROM tags WHERE t.value <> ''")
def pii_tags(spark, d):
    return domain.users(spark, d).select("user_id", F.explode(_tags()).alias("t")).select("user_id", "t.tag", "t.value")


@query(
    f"""WITH RECURSIVE {TAGS}, own AS (SELECT user_id, password, list(t) FILTER (t.value <> '') AS tags FROM tags GROUP BY ALL),
    places AS (SELECT *, list_sort(flatten(list_transform(list_filter(tags, lambda t: length(t.value) >= 2), lambda t: list_transform(list_filter(range(1, length(password) + 1), lambda i: substr(password, i, length(t.value)) = t.value), lambda i: {{'pos': i, 'neg': -length(t.value), 'tag': t.tag}})))) AS found FROM own),
    walk AS (SELECT user_id, password, tags, found, 1::BIGINT AS nxt, []::VARCHAR[] AS segs FROM places
      UNION ALL SELECT user_id, password, tags, found, CASE WHEN x IS NULL THEN length(password) + 1 ELSE x.pos - x.neg END,
        list_concat(segs, CASE WHEN x IS NULL THEN [password[nxt:]] WHEN x.pos > nxt THEN [password[nxt:x.pos - 1], '<' || x.tag || '>'] ELSE ['<' || x.tag || '>'] END)
      FROM (SELECT *, list_filter(found, lambda p: p.pos >= nxt)[1] AS x FROM walk WHERE nxt <= length(password)))
    SELECT user_id, segs, list_aggregate(list_transform(segs, lambda s: coalesce(list_filter(tags, lambda t: '<' || t.tag || '>' = s)[1].value, s)), 'string_agg', '') AS back, password FROM walk WHERE nxt > length(password)"""
)
def pii_tagged_password(spark, d):
    u = domain.users(spark, d).withColumn("tags", _tags())
    seg = u.withColumn("segs", pii.tagged(F.col("password"), F.col("tags")))
    return seg.select("user_id", "segs", pii.substituted(F.col("segs"), F.col("tags")).alias("back"), "password")


def _quoted(*words: str) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(*words: str) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_KEYS = ", ".join(f"({r}, {_quoted(row)})" for rows in (ROWS, SHIFTED) for r, row in enumerate(rows))
_NEAR = " OR ".join(f"(r - pr = {down} AND i - pi IN ({', '.join(map(str, along))}))" for down, along in STEPS.items())


def segments_of(rows: str, name: str = "segs") -> str:
    """name(pid, s): the segments of each of rows(pid, password) in order, as (t, n, v)."""
    return f"""keys AS (SELECT r, unnest(string_split(k, '')) AS c, unnest(range(0, length(k))) AS i FROM (VALUES {_KEYS}) v(r, k)),
  signs AS (SELECT pid, j, password[j] AS c, r, i FROM (SELECT pid, password, unnest(range(1, length(password) + 1)) AS j FROM {rows}) LEFT JOIN keys ON keys.c = password[j]),
  steps AS (SELECT *, lag(r) OVER w AS pr, lag(i) OVER w AS pi FROM signs WINDOW w AS (PARTITION BY pid ORDER BY j)),
  grouped AS (SELECT pid, j, c, sum(CASE WHEN {_NEAR} THEN 0 ELSE 1 END) OVER (PARTITION BY pid ORDER BY j) AS g FROM steps),
  runs AS (SELECT pid, g, string_agg(c, '' ORDER BY j) AS run FROM grouped GROUP BY ALL),
  judged AS (SELECT *, length(run) >= {SHORTEST_RUN} AND run[:2] <> 'er' AND run[2:3] <> 'er' AND run[:3] <> 'tty' AND NOT regexp_matches(lower(run), '{_any(*LOOKALIKES)}')
      AND regexp_matches(run, '[a-zA-Z]')::INTEGER + regexp_matches(run, '[0-9]')::INTEGER + regexp_matches(run, '[^a-zA-Z0-9]')::INTEGER > 1 AS keyboard FROM runs),
  parts AS (SELECT pid, m, keyboard, string_agg(run, '' ORDER BY g) AS part FROM (SELECT *, sum(keyboard::INTEGER) OVER (PARTITION BY pid ORDER BY g) AS m FROM judged) GROUP BY ALL),
  cuts AS (SELECT pid, m, keyboard, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS a FROM (SELECT *, CASE WHEN keyboard THEN [part] ELSE string_split(regexp_replace(part, '({_any(*CONTEXT)})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) END AS pieces FROM parts)),
  kinds AS (SELECT pid, m, keyboard, a, CASE WHEN keyboard THEN [{{'t': 'K', 'n': length(piece), 'v': piece}}] WHEN a % 2 = 0 THEN [{{'t': 'X', 'n': length(piece), 'v': piece}}]
      ELSE list_transform(regexp_extract_all(piece, '[0-9]+|[a-zA-Z]+|[^a-zA-Z0-9]+'), lambda x: {{'t': CASE WHEN regexp_matches(x, '^[0-9]') THEN 'D' WHEN regexp_matches(x, '^[a-zA-Z]') THEN 'A' ELSE 'O' END, 'n': length(x), 'v': x}}) END AS own FROM cuts),
  {name} AS MATERIALIZED (SELECT pid, flatten(list(own ORDER BY m, NOT keyboard, a)) AS s FROM kinds GROUP BY pid)"""


#: Training passwords only.
SEGMENTS = f"""{PASSWORDS}, trained AS (SELECT * FROM passwords WHERE password <> '' AND NOT contains(password, chr(9)) AND NOT regexp_matches(password, '\\.(com|org|edu|gov|mil)')),
  {segments_of('trained')}"""
#: items(t, n, v) of each password and terms with their probabilities; structures; counted items of all types.
STATISTICS = """x AS (SELECT pid, unnest(s) AS e FROM segs), named AS (SELECT pid, list_aggregate(list_transform(s, lambda y: y.t || y.n), 'string_agg', '') AS structure FROM segs),
  items AS (SELECT pid, e.t AS t, e.n AS n, CASE WHEN e.t = 'A' THEN lower(e.v) ELSE e.v END AS v FROM x UNION ALL SELECT pid, 'C', e.n, regexp_replace(regexp_replace(e.v, '[^a-z]', 'U', 'g'), '[a-z]', 'L', 'g') FROM x WHERE e.t = 'A' UNION ALL SELECT pid, 'S', 0, structure FROM named),
  terms AS MATERIALIZED (SELECT t, n, v, count(*) AS num, count(*) / sum(count(*)) OVER (PARTITION BY t, n) AS p FROM items GROUP BY t, n, v)"""
GRAMMAR = f"{SEGMENTS}, {STATISTICS}"


@query(f"WITH {SEGMENTS}, f AS (SELECT pid, generate_subscripts(s, 1) - 1 AS slot, unnest(s) AS e FROM segs) SELECT pid, slot::INTEGER AS slot, e.t AS type, e.n::INTEGER AS len, e.v AS value FROM f")
def pcfg_segments(spark, d):
    """The grammar segments of each training password, a row each."""
    parts = P.parsed(domain.passwords(spark, d)).select("pid", F.posexplode("segs").alias("slot", "s"))
    return parts.select("pid", "slot", "s.type", "s.len", "s.value")


@query(f"WITH {GRAMMAR} SELECT structure, count(*) AS n FROM named GROUP BY 1")
def pcfg_structures(spark, d):
    """Base structures by their number of passwords."""
    return P.parsed(domain.passwords(spark, d)).groupBy("structure").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GRAMMAR} SELECT t AS type, n::INTEGER AS len, v AS item, num, round(CASE WHEN t = 'S' THEN p * 0.6::DOUBLE ELSE p END, 12) AS prob FROM terms UNION ALL SELECT 'S', 0, 'M', 0, 0.4::DOUBLE")
def pcfg_probabilities(spark, d):
    """Terminals, masks and structures with a coverage of 0.6; the rest goes to the chain."""
    return P.probabilities(P.items(P.parsed(domain.passwords(spark, d))), 0.6).withColumn("prob", F.round("prob", 12))


@query(f"WITH {PASSWORDS} SELECT regexp_replace(regexp_replace(w, '[^a-z]', 'U', 'g'), '[a-z]', 'L', 'g') AS mask, count(*) AS n FROM (SELECT unnest(regexp_extract_all(password, '[a-zA-Z]+')) AS w FROM passwords) GROUP BY 1")
def cap_masks(spark, d):
    words = domain.passwords(spark, d).select(F.explode(F.regexp_extract_all("password", F.lit("[a-zA-Z]+"), F.lit(0))).alias("w"))
    return words.groupBy(S.cap_mask(F.col("w")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {GRAMMAR}, levels AS (SELECT t, n, p, count(*) AS k FROM terms GROUP BY ALL),
    heads AS (SELECT t, n, max(p) AS head FROM levels GROUP BY ALL UNION ALL SELECT h.t, h.n, max(l.p) FROM heads h JOIN levels l ON l.t = h.t AND l.n = h.n AND l.p < h.head * (1 - 0.01::DOUBLE) GROUP BY h.t, h.n, h.head),
    told AS (SELECT l.t, l.n, l.p, l.k, min(h.head) AS head FROM levels l JOIN heads h ON l.t = h.t AND l.n = h.n AND h.head >= l.p GROUP BY ALL),
    means AS (SELECT t, n, head, sum(p * k) / sum(k) AS smooth FROM told GROUP BY ALL)
    SELECT t AS type, n::INTEGER AS len, v AS item, num, round(smooth, 12) AS prob FROM terms JOIN told USING (t, n, p) JOIN means USING (t, n, head)"""
)
def pcfg_smoothed(spark, d):
    """Probabilities with the mean of each run of nearly equal ones."""
    found = P.smoothed(P.probabilities(P.items(P.parsed(domain.passwords(spark, d)))), 0.01)
    return found.withColumn("prob", F.round("prob", 12))


@query(f"WITH {GRAMMAR}, one AS (SELECT password, min(pid) AS pid FROM trained GROUP BY 1) SELECT password, round(exp(sum(ln(p))), 12) AS prob FROM one JOIN items USING (pid) JOIN terms USING (t, n, v) GROUP BY password")
def pcfg_score(spark, d):
    c = domain.passwords(spark, d)
    return P.score(c, P.probabilities(P.items(P.parsed(c)))).withColumn("prob", F.round("prob", 12))


@query(f"WITH {GRAMMAR}, {USERS}, {grammar(210)}, {ASSEMBLED}")
def pcfg_decoys(spark, d):
    """Decoy lists sampled from the grammar."""
    c, u = domain.passwords(spark, d), domain.users(spark, d)
    probs = cut(P.probabilities(P.items(P.parsed(c))))
    return G.assemble(G.in_rounds(u, lambda some, draws: P.sample(some, probs, draws, 67), 20, None, 30), u, 20, 67)
