"""Queries over whole analyses, dataset building and targeted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii
from ..operators import attack as A
from ..operators import corpus as C
from ..operators import decoys as G
from ..operators import embedding as V
from ..operators import markov as M
from ..operators import pcfg as P
from ..operators import report as R
from ..session import cut
from . import domain
from .attack_queries import IDX, RANKS, T1, T2, TRIES, weights
from .domain import COUNTS, CORPUS, PASSWORDS, SWEETWORDS, USERS, u32
from .draw_sql import ASSEMBLED, chain, grammar, weighted
from .model_queries import STATISTICS, TAGS, chain_of, segments_of
from .registry import registry

QUERIES, SQL, query = registry()


@query(
    f"""WITH {SWEETWORDS}, lists AS (SELECT user_id, idx, is_real, lower(word) AS word FROM sweet), c AS (SELECT lower(password) AS word, count(*) AS cnt FROM corpus GROUP BY 1),
    low AS (SELECT l.*, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, idx) AS j FROM lists l JOIN c USING (word)), real AS (SELECT user_id, word FROM lists WHERE is_real)
    SELECT user_id, min(j) AS rank FROM low JOIN real USING (user_id, word) GROUP BY 1"""
)
def first_place_rank(spark, d):
    """Rank of the real word in lists that, in lower case, repeat words."""
    lists = domain.sweetwords(spark, d).withColumn("word", F.lower("word"))
    counted = domain.corpus(spark, d).groupBy(F.lower("password").alias("password")).agg(F.count(F.lit(1)).alias("cnt"))
    return A.first_place(A.lookup(lists, counted, F.lit(1))).select("user_id", F.col("rank").cast("long").alias("rank"))


FIRST = f"""{SWEETWORDS}, slice AS (SELECT password, count(*) AS cnt FROM corpus WHERE source = 'src0' GROUP BY 1), seen AS (SELECT user_id, idx, word, coalesce(cnt, 0) AS p FROM sweet LEFT JOIN slice ON password = word),
  per AS (SELECT user_id, sum(p) AS mass, arg_max(word, (p, -idx)) AS top, max(p) AS p, arg_min(word, idx) AS head FROM seen GROUP BY 1)"""


def _first(spark, d, by_order: bool):
    counted = domain.corpus(spark, d).filter("source = 'src0'").groupBy("password").agg(F.count(F.lit(1)).alias("cnt"))
    return A.choice(A.lookup(domain.sweetwords(spark, d), counted, F.lit(1)), by_order)


@query(f"WITH {FIRST} SELECT user_id, CASE WHEN mass > 0 THEN top ELSE head END AS word, CASE WHEN mass > 0 THEN round(p / mass, 12) ELSE 0 END::DOUBLE AS pi FROM per")
def choice_by_order(spark, d):
    """The next guess of an attacker who knows one source, taking the list's order where nothing is known."""
    return _first(spark, d, True)


@query(f"WITH {FIRST} SELECT user_id, CASE WHEN mass > 0 THEN top END AS word, CASE WHEN mass > 0 THEN round(p / mass, 12) ELSE 0 END::DOUBLE AS pi FROM per")
def choice_known_only(spark, d):
    return _first(spark, d, False)


MEANS = "cracked AS (SELECT user_id, sum((NOT is_real)::INTEGER) AS fails FROM curve GROUP BY 1 HAVING max(is_real::INTEGER) = 1), means AS (SELECT count(*) AS cracked, coalesce(avg(fails + 1), 0) AS mean_guesses, coalesce(avg(fails), 0) AS mean_failures FROM cracked)"


@query(f"WITH {TRIES}, {IDX}, {MEANS} SELECT cracked, round(mean_guesses, 9) AS mean_guesses, round(mean_failures, 9) AS mean_failures FROM means")
def crack_means(spark, d):
    """Mean guesses and failures before a crack in the capped attack."""
    found = A.crack_means(A.curve(A.index_key(A.attempts(weights(spark, d), T1)), T2))
    return found.select("cracked", F.round("mean_guesses", 9).alias("mean_guesses"), F.round("mean_failures", 9).alias("mean_failures"))


@query(
    f"""WITH {TRIES}, {IDX}, {MEANS}, total AS (SELECT count(DISTINCT user_id) AS users FROM sweet),
    capped AS (SELECT count(*) AS guesses, coalesce(max(failures), 0) AS failures, coalesce(max(successes), 0) AS successes FROM curve),
    tied AS (SELECT avg(hit / n::DOUBLE) AS e FROM (SELECT user_id, max(is_real::INTEGER) AS hit, count(*) AS n FROM (SELECT *, max(p) OVER (PARTITION BY user_id) AS best FROM probs) WHERE p = best GROUP BY 1)),
    mass AS (SELECT max(r / s) AS e FROM (SELECT user_id, sum(p) AS s, max(p) FILTER (is_real) AS r FROM probs GROUP BY 1)),
    first AS (SELECT avg((j = 1)::INTEGER) AS e FROM ranked WHERE is_real)
    SELECT users, guesses, failures, successes, round(successes / users::DOUBLE, 9) AS success_rate, cracked, round(mean_guesses, 9) AS mean_guesses, round(mean_failures, 9) AS mean_failures,
      round(tied.e, 9) AS epsilon_ties, round(mass.e, 9) AS epsilon_mass, round(first.e, 9) AS epsilon_first, (SELECT count(*) FROM tries) AS free_guesses, (SELECT sum(is_real::INTEGER) FROM tries)::BIGINT AS free_successes FROM total, capped, means, tied, mass, first"""
)
def attack_analysis(spark, d):
    """The whole analysis of the lists in one row."""
    found = A.analysis(weights(spark, d), T1, T2)
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(
    f"""WITH {SWEETWORDS}, src AS (SELECT source, password, count(*) AS cnt FROM corpus GROUP BY ALL), names AS (SELECT DISTINCT source FROM src),
    known AS (SELECT n.source, s.user_id, s.idx, s.is_real, coalesce(c.cnt, 0) AS p FROM sweet s CROSS JOIN names n LEFT JOIN src c ON c.source = n.source AND c.password = s.word),
    first AS (SELECT source, user_id, arg_max(is_real::INTEGER, (p, -idx)) AS hit FROM known GROUP BY ALL)
    SELECT round(avg(share), 9) AS epsilon FROM (SELECT source, avg(hit) AS share FROM first GROUP BY 1)"""
)
def epsilon_over_attackers(spark, d):
    """Mean share of first guesses that are right, over attackers who know one source each."""
    known = domain.corpus(spark, d).groupBy("source", "password").agg(F.count(F.lit(1)).alias("cnt"))
    per = A.first_hits(domain.sweetwords(spark, d), cut(known)).withColumnRenamed("source", "attacker")
    return A.mean_first_share(per).select(F.round("epsilon", 9).alias("epsilon"))


@query(f"WITH {CORPUS}, p AS (SELECT doc_id, unnest(w) AS password, generate_subscripts(w, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents)) SELECT password, min((doc_id, i))[1] AS doc_id, min((doc_id, i))[2]::INTEGER AS i FROM p WHERE length(password) BETWEEN 8 AND 32 GROUP BY 1")
def first_seen_words(spark, d):
    """Words of 8 to 32 letters once each, with the place where they come first."""
    return C.first_seen(domain.corpus(spark, d).filter("length(password) BETWEEN 8 AND 32"), "doc_id", "i")


@query(f"WITH {COUNTS} SELECT password, unnest(range(0, cnt)) AS copy FROM counts WHERE length(password) >= 8")
def expanded_counts(spark, d):
    return C.expand(domain.word_counts(spark, d).filter("length(password) >= 8"))


SCORE = "length(password) + 10 * (regexp_matches(password, '[a-z]')::INTEGER + regexp_matches(password, '[A-Z]')::INTEGER + regexp_matches(password, '[0-9]')::INTEGER + regexp_matches(password, '[^a-zA-Z0-9]')::INTEGER)"


def _score():
    """A stand-in for a strength library: length and kinds of characters."""
    kinds = sum((F.col("password").rlike(x).cast("int") for x in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), F.lit(0))
    return F.length("password") + 10 * kinds


@query(f"WITH {PASSWORDS} SELECT DISTINCT password, ({SCORE})::INTEGER AS score FROM passwords ORDER BY score DESC, password LIMIT 200")
def strongest_words(spark, d):
    """A top-200 by a given score."""
    return C.extremes(domain.passwords(spark, d), _score().cast("int"), 200)


@query(f"WITH {PASSWORDS} SELECT DISTINCT password, ({SCORE})::INTEGER AS score FROM passwords ORDER BY score, password LIMIT 200")
def weakest_words(spark, d):
    return C.extremes(domain.passwords(spark, d), _score().cast("int"), 200, strongest=False)


@query(f"WITH {PASSWORDS} SELECT pid, ((row_number() OVER (ORDER BY {u32(14, 'pid')}, pid) - 1) * 2 // count(*) OVER ())::INTEGER AS part FROM passwords")
def shuffled_halves(spark, d):
    return C.equal_parts(domain.passwords(spark, d), 14, 2, "pid").select("pid", "part")


SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


@query(f"SELECT c_custkey AS user_id, list_aggregate(list_transform(range(1, 9), lambda i: substr('{SIGNS}', {u32(15, 'c_custkey', 'i')} % 62 + 1, 1)), 'string_agg', '') AS word FROM customer")
def random_passwords(spark, d):
    """Eight random letters and digits for each user."""
    return C.random_words(domain.users(spark, d).select("user_id"), 15, 8, "user_id").select("user_id", "word")


def _codes(kind: str) -> str:
    return "[" + ", ".join(f"chr({ord(c)})" for t, c in pii.CODES.items() if t[0] == kind) + "]"


def _pick(kind: str, name: str) -> str:
    return f"({_codes(kind)})[1 + {u32(16, 'pid', repr(name))} % {sum(t[0] == kind for t in pii.CODES)}]"


def _put(kind: str) -> str:
    return f"substr(password, 1, spot - 1) || {_pick(kind, 'a')} || substr(password, spot + 1)"


_MADE = [_put("B"), _put("U"), _put("N"), _put("E"), _pick("U", "a"), f"{_pick('N', 'a')} || {_pick('B', 'b')}", _pick("B", "a"), _pick("E", "a"), f"{_pick('U', 'a')} || {_pick('B', 'b')}"]
_UPTO = [sum(list(pii.CASES.values())[: i + 1]) for i in range(len(pii.CASES))]


INJECTED = (
    f"{PASSWORDS}, injected AS (SELECT pid, CASE "
    + " ".join(f"WHEN u < {n} THEN {made}" for n, made in zip(_UPTO, _MADE, strict=True))
    + f" ELSE password END AS coded FROM (SELECT *, {u32(16, 'pid', repr('case'))} % 100000 AS u, ({u32(16, 'pid', repr('at'))} % length(password) + 1)::BIGINT AS spot FROM passwords))"
)


@query(f"WITH {INJECTED} SELECT pid, coded FROM injected")
def injected_passwords(spark, d):
    """Passwords with codes of made-up personal data, by weighted case."""
    return domain.passwords(spark, d).select("pid", pii.injected(F.col("password"), 16, "pid").alias("coded"))


TAG_ROWS = ", ".join(f"('{t}', chr({ord(c)}))" for t, c in pii.CODES.items())


@query(f"WITH {INJECTED}, uses AS (SELECT c AS code, count(*) AS n FROM (SELECT unnest(string_split(coded, '')) AS c FROM injected) GROUP BY 1) SELECT tag, code, ord(code)::INTEGER AS number, coalesce(n, 0)::BIGINT AS n FROM (VALUES {TAG_ROWS}) t(tag, code) LEFT JOIN uses USING (code)")
def tag_codes(spark, d):
    """The control character of each tag and how often the coded passwords hold it."""
    made = domain.passwords(spark, d).select(pii.injected(F.col("password"), 16, "pid").alias("coded"))
    uses = made.select(F.explode(F.split("coded", "")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    tags = spark.createDataFrame([(t,) for t in pii.CODES], "tag string")
    known = tags.withColumn("code", pii.coded(F.array(F.concat(F.lit("<"), "tag", F.lit(">"))))[0]).withColumn("number", F.ascii("code"))
    return known.join(uses, "code", "left").select("tag", "code", "number", F.coalesce("n", F.lit(0)).alias("n"))


STUDY_ROWS = ", ".join(f"({t}, {x})" for t, x in enumerate(R.USER_STUDY, 1))


@query(f"WITH {RANKS} SELECT t::INTEGER AS t, x::DOUBLE AS study, round((SELECT count(*) FROM ranks WHERE rank <= t) / (SELECT count(*) FROM ranks)::DOUBLE, 9) AS share, round((SELECT count(*) FROM ranks WHERE rank <= t) / (SELECT count(*) FROM ranks)::DOUBLE - x, 9) AS gap FROM (VALUES {STUDY_ROWS}) v(t, x)")
def user_study_curve(spark, d):
    """The share of users found within t guesses beside that of the published study with people."""
    measured = A.found_within(A.real_rank(weights(spark, d)), domain.K)
    return R.against_study(measured)


def _tagged_users(spark, d, held=True):
    u = domain.users(spark, d)
    u = u.withColumn("tags", pii.tag_values(F.col("first_name"), F.col("last_name"), F.col("username"), F.col("email"), F.col("birthday")))
    u = u.withColumn("own", pii.by_code(F.col("tags")))
    return cut(u) if held else u


def _coded(spark, d, held=True):
    """The tagged users; pid, coded: training passwords with injected codes. The protected users' own passwords teach the models nothing."""
    made = domain.passwords(spark, d).select("pid", pii.injected(F.col("password"), 16, "pid").alias("coded"))
    return _tagged_users(spark, d, held), cut(made)


def _own(u, make):
    """Draws of coded words as words with each user's own values."""
    return lambda some, draws: make(some, draws).join(u.select("user_id", "own"), "user_id").select("user_id", "draw", pii.replaced(F.col("word"), F.col("own")).alias("word"))


TARGETED = f"""{INJECTED}, {TAGS}, codes AS (SELECT * FROM (VALUES {TAG_ROWS}) v(tag, code)),
  owned AS MATERIALIZED (SELECT user_id, map_from_entries(list((code, t.value))) AS own FROM tags JOIN codes ON codes.tag = t.tag WHERE t.value <> '' GROUP BY user_id)"""
FILLED = "SELECT user_id, draw, list_aggregate(list_transform(string_split(word, ''), lambda c: coalesce(own[c], c)), 'string_agg', '') AS word FROM coded_draws JOIN owned USING (user_id)"


@query(f"WITH {TARGETED}, known AS (SELECT coded AS word, count(*) AS cnt FROM injected GROUP BY 1), {weighted('known', 600, 'coded_draws')}, drawn AS ({FILLED}), {ASSEMBLED}")
def targeted_decoys(spark, d):
    """Decoys from coded training passwords drawn by frequency, filled with one's own data."""
    u, corpus = _coded(spark, d)
    counted = cut(corpus.groupBy(F.col("coded").alias("password")).agg(F.count(F.lit(1)).alias("cnt")))
    return G.assemble(G.in_rounds(u, _own(u, lambda some, at: G.from_rows(some, counted, at, 67)), 20, None, 40), u, 20, 67)


@query(f"WITH RECURSIVE {TARGETED}, taught AS (SELECT coded AS password FROM injected), {chain_of('taught')}, {chain(210, 'coded_draws')}, drawn AS ({FILLED}), {ASSEMBLED}")
def targeted_markov_decoys(spark, d):
    """Chains over coded passwords, filled with one's own data."""
    u, corpus = _coded(spark, d, held=False)  # each user is read once
    chain, first = cut(M.transitions(corpus, "coded")), cut(M.starts(corpus, "coded"))
    words = M.walker(chain, first, 67)
    u = u if words else cut(u)
    make = _own(u, lambda some, at: M.sample(some, chain, first, at, 67))
    if words is None:
        return G.assemble(G.in_rounds(u, make, 20, None, 30), u, 20, 67)

    def drawn(r, draws):
        own = {c: v for c, v in r["own"] if v is not None}
        return ("".join(own.get(c, c) for c in word) for word in words(r["user_id"], draws))

    return G.walked(u.select("user_id", "password", "own"), drawn, make, 20, 30, 67)


_SIGNS = "".join(f"\\x{ord(c):02x}" for c in pii.CODES.values())
#: Segments of coded passwords: a code is one of type T, the text between is parsed as usual.
CODED = f"""pieces AS (SELECT pid, unnest(ps) AS piece, generate_subscripts(ps, 1) AS a FROM (SELECT pid, regexp_extract_all(coded, '[{_SIGNS}]|[^{_SIGNS}]+') AS ps FROM injected)),
  plain AS (SELECT pid * 100 + a AS pid, piece AS password FROM pieces WHERE NOT regexp_matches(piece, '^[{_SIGNS}]$')), {segments_of('plain', 'gaps')},
  segs AS MATERIALIZED (SELECT pid // 100 AS pid, flatten(list(s ORDER BY pid)) AS s FROM (SELECT pid, s FROM gaps UNION ALL SELECT pid * 100 + a, [{{'t': 'T', 'n': 1, 'v': piece}}] FROM pieces WHERE regexp_matches(piece, '^[{_SIGNS}]$')) GROUP BY 1), {STATISTICS}"""


@query(f"WITH {TARGETED}, {CODED}, {grammar(210, 'coded_draws')}, drawn AS ({FILLED}), {ASSEMBLED}")
def targeted_pcfg_decoys(spark, d):
    """A grammar of coded passwords, filled with one's own data."""
    u, corpus = _coded(spark, d)
    probs = cut(P.probabilities(P.items(P.parsed_coded(corpus, "pid"))))
    return G.assemble(G.in_rounds(u, _own(u, lambda some, at: P.sample(some, probs, at, 67)), 20, None, 30), u, 20, 67)


def _neighbours(spark, d):
    """user_id, neighbour, similarity: the nearest words of the whole training vocabulary by learned vectors."""
    u = domain.users(spark, d).select("user_id", "password")
    known = domain.passwords(spark, d).select(F.col("password").alias("word"))
    near = cut(V.neighbours(u.select(F.col("password").alias("word")), known, 8))
    return u, u.join(near, F.col("password") == F.col("query")).select("user_id", F.col("word").alias("neighbour"), "similarity")


@query()
def vocabulary_neighbours(spark, d):
    """Five nearest words of the vocabulary for each user's password."""
    u = domain.users(spark, d).select(F.col("password").alias("word"))
    return V.neighbours(u, domain.passwords(spark, d).select(F.col("password").alias("word")), 5)


@query()
def hybrid_decoys(spark, d):
    """Twenty words: the password, its three nearest words and four variants of each."""
    u, near = _neighbours(spark, d)
    return G.hybrid(u, near, 20, 4, 67)


@query()
def pcfg_hybrid_decoys(spark, d):
    """Twenty words with the base that each stands for: four bases and grammar words."""
    u, near = _neighbours(spark, d)
    corpus = domain.passwords(spark, d)
    probs = cut(P.probabilities(P.items(P.parsed(corpus))))
    return G.grammar_hybrid(u, near, 20, 4, lambda some, draws: P.sample(some, probs, draws, 67))
