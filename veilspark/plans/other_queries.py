"""Queries over filters, vectors, reports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bloom import judged, salted_hash
from ..functions.rng import draw32, uniform
from ..operators import bernoulli as B
from ..operators import report as R
from ..operators import similarity as V
from ..session import spread, table
from ..streaming import logins
from . import domain
from .attack_queries import weights
from .domain import SWEETWORDS, USERS, u32
from .registry import registry

QUERIES, SQL, query = registry()
P_H = 0.05

SALT = "substr(sha256('67:salt:' || user_id), 1, 32)"


def _indices(salt: str, word: str) -> str:
    return f"list_sort(list_distinct(list_transform(range(0, 20), lambda i: CAST(('0x' || substr(sha256(i || ':' || sha256({salt} || {word})), 57, 8))::BIGINT % 128 + 1 AS INTEGER))))"


ACCOUNTS = f"""{USERS}, acc AS MATERIALIZED (SELECT user_id, password, salt, tr, list_sort(list_concat(tr, list_transform(list_sort(list_transform(list_filter(range(1, 129), lambda i: NOT list_contains(tr, i::INTEGER)), lambda i: {{'r': ('0x' || substr(sha256('67:' || user_id || ':b:' || i), 1, 8))::BIGINT, 'i': i::INTEGER}}))[1:greatest(CAST(round_even(pow({P_H}, 1 / 20.0) * 128, 0) AS INTEGER) - len(tr), 0)], lambda x: x.i))) AS b
  FROM (SELECT user_id, password, {SALT} AS salt, {_indices(SALT, 'password')} AS tr FROM users))"""


@query(f"WITH {ACCOUNTS} SELECT user_id, salt, tr AS true_indices, b FROM acc")
def bloom_indices(spark, d):
    return B.register(domain.users(spark, d), P_H, 67).select("user_id", "salt", F.col("true").alias("true_indices"), "b")


LENGTH = 100_000
RANKING = f"SELECT rank, password FROM (SELECT password, row_number() OVER (ORDER BY cnt DESC, password) AS rank FROM counts) WHERE rank <= {LENGTH}"


def _ranking(spark, d, length: int = LENGTH):
    """The commonest words with their rank: a top-k of the attack's length."""
    from pyspark.sql import Window as W

    top = domain.word_counts(spark, d).orderBy(F.desc("cnt"), "password").limit(length)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("cnt"), "password")).cast("long")).select("rank", "password")  # the attack's length


# the first words settle nearly all accounts, so the rest of the ranking meets few
PROBE = f"""{ACCOUNTS}, {domain.COUNTS}, ranking AS MATERIALIZED ({RANKING}), early AS MATERIALIZED (SELECT user_id, min(rank) AS rank FROM acc, ranking WHERE rank <= 256 AND list_has_all(b, {_indices('salt', 'ranking.password')}) GROUP BY 1),
  left_over AS MATERIALIZED (SELECT * FROM acc ANTI JOIN early USING (user_id)), late AS (SELECT user_id, min(rank) AS rank FROM left_over acc, ranking WHERE rank > 256 AND list_has_all(b, {_indices('salt', 'ranking.password')}) GROUP BY 1),
  probe AS (SELECT * FROM early UNION ALL SELECT * FROM late),
  breach AS (SELECT a.user_id, p.rank, CASE WHEN p.rank IS NULL THEN 'no_candidate' WHEN r.password = a.password THEN 'undetected' ELSE 'detected' END AS outcome FROM acc a LEFT JOIN probe p USING (user_id) LEFT JOIN ranking r USING (rank))"""


def _breach(spark, d):
    u = domain.users(spark, d)
    return B.breach(B.best_candidates(B.register(u, P_H, 67), _ranking(spark, d)), u)


@query(f"WITH {PROBE} SELECT user_id, rank, outcome FROM breach")
def bloom_probe(spark, d):
    return _breach(spark, d)


@query(f"WITH {PROBE} SELECT outcome, count(*) AS n FROM breach GROUP BY 1")
def breach_outcomes(spark, d):
    return B.outcome_counts(_breach(spark, d))


TDP = "tries AS (SELECT user_id, outcome, trial, row_number() OVER (PARTITION BY trial ORDER BY rank, user_id) AS pos FROM (SELECT *, " + u32(67, "user_id") + " % 50 AS trial FROM breach WHERE outcome <> 'no_candidate')), firsts AS (SELECT trial, min(pos) FILTER (outcome = 'detected') AS f FROM tries GROUP BY 1)"


@query(f"WITH {PROBE}, {TDP} SELECT n::INTEGER AS n, avg(coalesce(f <= n, false)::INTEGER) AS tdp FROM firsts, range(1, 51) r(n) GROUP BY 1")
def tdp_by_n(spark, d):
    return B.detection_by_n(_breach(spark, d), 50, 50, 67)


@query(f"WITH {PROBE} SELECT row_number() OVER w AS n, sum((outcome = 'undetected')::INTEGER) OVER w::BIGINT AS successes, (row_number() OVER w - sum((outcome = 'undetected')::INTEGER) OVER w)::BIGINT AS alarms FROM breach WHERE outcome <> 'no_candidate' WINDOW w AS (ORDER BY rank, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def success_vs_alarm(spark, d):
    return B.success_vs_alarm(_breach(spark, d))


def _chance(*keys: str) -> str:
    return u32(67, *keys) + " / 4294967296.0"


def _walk(after: str, low: int, high: int, name: str) -> str:
    """The best words of rank low + 1..high for the (user_id, l) of a table, and what is left after them."""
    return f"""who_{name} AS MATERIALIZED (SELECT * FROM acc SEMI JOIN {after} USING (user_id)),
  tried_{name} AS MATERIALIZED (SELECT user_id, rank, {_indices('salt', 'ranking.password')} AS ix FROM who_{name} acc, ranking WHERE rank > {low} AND rank <= {high}),
  hit_{name} AS MATERIALIZED (SELECT user_id, l, min(rank) AS rank FROM {after} JOIN tried_{name} USING (user_id) WHERE list_has_all(m, ix) GROUP BY ALL),
  open_{name} AS MATERIALIZED (SELECT * FROM {after} ANTI JOIN hit_{name} USING (user_id, l))"""


def _watched(levels: list[int]) -> str:
    return f"""{ACCOUNTS}, {domain.COUNTS}, ranking AS MATERIALIZED ({RANKING}),
  marked AS MATERIALIZED (SELECT *, list_filter(b, lambda i: list_contains(tr, i) OR {_chance("user_id", "'m'", "i")} < 0.95) AS m, list_filter(range(1, 42), lambda t: {_chance("user_id", "'renew'", "t")} < 0.065) AS rs FROM acc),
  seen AS MATERIALIZED (SELECT user_id, l, list_filter(m, lambda i: list_contains(tr, i) OR len(list_filter(rs, lambda t: t <= l AND {_chance("user_id", "t", "i")} >= 0.95)) = 0) AS m FROM marked, (SELECT unnest({levels}) AS l)),
  {_walk("seen", 0, 128, "a")}, {_walk("open_a", 128, 512, "b")}, {_walk("open_b", 512, 2048, "c")}, {_walk("open_c", 2048, LENGTH, "d")},
  best AS MATERIALIZED (SELECT user_id, l, rank FROM seen LEFT JOIN (SELECT * FROM hit_a UNION ALL SELECT * FROM hit_b UNION ALL SELECT * FROM hit_c UNION ALL SELECT * FROM hit_d) USING (user_id, l))"""


SEEN, MORE = [0, 5, 10, 15, 20], [1, 6, 11, 16, 21]
OUTCOMES = f"""{_watched(SEEN)}, chosen AS MATERIALIZED (SELECT b.user_id, l, b.rank, tr, rs, {_indices('salt', 'r.password')} AS ix FROM best b JOIN marked USING (user_id) LEFT JOIN ranking r ON r.rank = b.rank),
  steps AS (SELECT *, list_max(list_filter(rs, lambda t: t > l AND t <= l + delta)) AS last FROM chosen, (SELECT unnest([1, 6, 11, 16, 21]) AS delta)),
  watched AS (SELECT user_id, l, delta, rank, CASE WHEN rank IS NULL THEN 'no_candidate' WHEN last IS NOT NULL AND len(list_filter(tr, lambda i: NOT list_contains(ix, i) AND {_chance("user_id", "last", "i")} >= 0.95)) > 0 THEN 'detected' ELSE 'undetected' END AS outcome FROM steps)"""


def _marked(spark, d):
    u = domain.users(spark, d)
    return u, B.register(u, P_H, 67, p_mark=B.P_MARK)


@query(f"WITH {_watched([0])} SELECT user_id, rank FROM best")
def marked_probe(spark, d):
    """The first ranked word in each account's filter and marks."""
    return B.best_candidates(_marked(spark, d)[1], _ranking(spark, d), marks=True).select("user_id", "rank")


@query(f"WITH {OUTCOMES} SELECT l, delta, outcome, count(*) AS n FROM watched GROUP BY ALL")
def watched_outcomes(spark, d):
    """Breaches by the numbers of the owner's and the attacker's logins."""
    a = _marked(spark, d)[1]
    return B.told(B.watched_lists(a, _ranking(spark, d), SEEN, MORE, 67), SEEN, MORE).groupBy("l", "delta", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query()
def watched_detection(spark, d):
    """The five by five table of detection rates; SQL would hash the whole ranking for accounts with few marks left, so a test has a plain loop."""
    a = _marked(spark, d)[1]
    lists = B.watched_lists(a, _ranking(spark, d), SEEN, MORE, 67).withColumn("rank", F.col("steps")[SEEN.index(0)]["rank"])
    return B.detection_rates(B.told(B.best_half(lists, 50, 67), SEEN, MORE, "trial"))


ATTEMPTS = f"attempts AS (SELECT event_id, ts, CASE WHEN e.user_id % 97 = 0 THEN -1 ELSE e.user_id END AS user_id, CASE WHEN {u32(11, 'event_id')} % 3 = 0 THEN u.password ELSE e.event_type || {u32(12, 'event_id')} % 50 END AS word FROM events e LEFT JOIN users u USING (user_id))"
LOGIN = f"{ACCOUNTS}, {ATTEMPTS}, logins AS (SELECT event_id, ts, t.user_id, CASE WHEN salt IS NULL OR word IS NULL OR NOT list_has_all(b, {_indices('salt', 'word')}) THEN 'failure' WHEN {_indices('salt', 'word')} = tr THEN 'success' ELSE 'alarm' END AS outcome FROM attempts t LEFT JOIN acc USING (user_id))"


def _attempts(spark, d):
    u = domain.users(spark, d).select(F.col("user_id").alias("uid"), "password")
    e = spread(table(spark, d, "events"), "event_id")
    word = F.when(draw32(11, "event_id") % 3 == 0, F.col("password")).otherwise(F.concat("event_type", (draw32(12, "event_id") % 50).cast("string")))
    return e.join(u, e["user_id"] == u["uid"], "left").select("event_id", "ts", F.when(F.col("user_id") % 97 == 0, -1).otherwise(F.col("user_id")).alias("user_id"), word.alias("word"))


@query(f"WITH {LOGIN} SELECT event_id, user_id, outcome FROM logins")
def login_outcomes(spark, d):
    return logins.alarms(_attempts(spark, d), B.register(domain.users(spark, d), P_H, 67)).select("event_id", "user_id", "outcome")


@query(f"WITH {LOGIN} SELECT time_bucket(INTERVAL '1 hour', ts) AS start, outcome, count(*) AS n FROM logins GROUP BY ALL")
def alarm_windows_stream(spark, d):
    """Tumbling alarm counts (an extension), here over the whole table at once; tests run it as a stream."""
    return logins.alarm_windows(logins.alarms(_attempts(spark, d), B.register(domain.users(spark, d), P_H, 67)))


@query("SELECT user_id, max_by(event_id % 20, (ts, event_id))::INTEGER AS idx FROM events GROUP BY user_id HAVING max_by(event_type, (ts, event_id)) <> 'error'")
def sugar_store(spark, d):
    e = table(spark, d, "events").select(F.struct("ts", "event_id").alias("ts"), "user_id", F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), (F.col("event_id") % 20).cast("int").alias("idx"))
    return logins.sugar_store(e)


REMARKED = f"""{ACCOUNTS}, {ATTEMPTS},
  tried AS (SELECT event_id AS step, t.user_id, word, salt, b, {_indices('salt', 'word')} AS ix FROM attempts t LEFT JOIN acc USING (user_id)),
  known AS MATERIALIZED (SELECT step, user_id, ix, word IS NOT NULL AND list_has_all(b, ix) AS inside,
    CASE WHEN {_chance("user_id", "step", "'renew'")} < 0.065 THEN list_filter(b, lambda i: list_contains(ix, i) OR {_chance("user_id", "step", "i")} < 0.95) END AS fresh, row_number() OVER (PARTITION BY user_id ORDER BY step) AS n FROM tried WHERE salt IS NOT NULL),
  walk AS (SELECT user_id, 0::BIGINT AS n, list_filter(b, lambda i: list_contains(tr, i) OR {_chance("user_id", "'m'", "i")} < 0.95) AS m, NULL::BIGINT AS step, NULL::VARCHAR AS outcome FROM acc
    UNION ALL SELECT w.user_id, l.n, CASE WHEN inside AND list_has_all(w.m, ix) AND fresh IS NOT NULL THEN fresh ELSE w.m END, l.step, CASE WHEN NOT inside THEN 'failure' WHEN list_has_all(w.m, ix) THEN 'success' ELSE 'alarm' END
    FROM walk w JOIN known l ON l.user_id = w.user_id AND l.n = w.n + 1)"""


@query(f"WITH RECURSIVE {REMARKED} SELECT user_id, step, outcome, m AS marks FROM walk WHERE step IS NOT NULL UNION ALL SELECT user_id, step, 'failure', NULL FROM tried WHERE salt IS NULL")
def remarked_logins(spark, d):
    """Logins that renew marks, in order of time, with the marks after each."""
    acc = B.register(domain.users(spark, d), P_H, 67, p_mark=0.95)
    return logins.remarked_logins(_attempts(spark, d).withColumnRenamed("event_id", "step"), acc, 0.065, 67)


BLIND = [0.05, 0.01, 0.001, 0.0001, 0.00001]
FAILED = "failed AS (SELECT n AS attempts, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM logins WHERE outcome <> 'success' AND user_id >= 0 GROUP BY 1) GROUP BY 1)"


def _failed(spark, d):
    """attempts, users: how many users have so many logins without success."""
    tried = logins.alarms(_attempts(spark, d), B.register(domain.users(spark, d), P_H, 67)).filter("outcome <> 'success' AND user_id >= 0")
    per = tried.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"))
    return per.groupBy("attempts").agg(F.count(F.lit(1)).alias("users"))


@query(f"WITH {LOGIN}, {FAILED} SELECT attempts, users, p_h, round(1 - pow(1 - p_h, attempts), 9) AS fdp FROM failed, (SELECT unnest({BLIND}::DOUBLE[]) AS p_h)")
def fdp_table(spark, d):
    """Chance of a false alarm if a user's failed logins were blind guesses, by their number."""
    return B.false_detection(_failed(spark, d), BLIND).withColumn("fdp", F.round("fdp", 9))


@query(f"WITH {LOGIN}, {FAILED} SELECT attempts, users, (SELECT max(p) FROM (SELECT pow(10.0, -i) AS p FROM range(1, 13) r(i)) WHERE 1 - pow(1 - p, attempts) <= 0.1) AS p_h FROM failed")
def fdp_bound(spark, d):
    """The largest safe setting by the number of failed logins."""
    return B.largest_safe(_failed(spark, d))


@query(f"WITH {ACCOUNTS} SELECT avg(list_has_all(b, {_indices('salt', 'wrong')})::INTEGER) AS observed, {P_H}::DOUBLE AS configured FROM (SELECT *, 'x' || {u32(13, 'user_id')} AS wrong FROM acc)")
def observed_false_rate(spark, d):
    a = B.register(domain.users(spark, d), P_H, 67).withColumn("wrong", F.concat(F.lit("x"), draw32(13, "user_id").cast("string")))
    return a.agg(F.avg((judged(salted_hash(F.encode("salt", "utf-8"), F.col("wrong")), F.col("true"), F.col("b")) > 0).cast("int")).alias("observed")).withColumn("configured", F.lit(P_H))


NORM = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"WITH {NORM}, s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query_id, rank, similarity FROM r WHERE rank <= 10")
def nearest_vectors(spark, d):
    """Ten nearest vectors of every vector whose id is divisible by 100, against all."""
    v = table(spark, d, "embeddings")
    got = V.nearest(v.filter("vec_id % 100 = 0"), v, 10)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {NORM}, f AS (SELECT a.vec_id AS user_id, a.e AS real, list(b.e ORDER BY b.vec_id) AS decoys FROM v a JOIN v b ON b.vec_id // 10 = a.vec_id // 10 AND b.vec_id <> a.vec_id WHERE a.vec_id % 10 = 0 GROUP BY ALL) SELECT user_id, round(list_avg(list_transform(decoys, lambda x: list_cosine_similarity(real, x))), 6) AS similarity FROM f")
def hw_similarity(spark, d):
    v = table(spark, d, "embeddings").withColumn("user_id", F.floor(F.col("vec_id") / 10) * 10)
    per = v.groupBy("user_id").agg(F.max(F.when(F.col("vec_id") == F.col("user_id"), F.col("embedding"))).alias("real"), F.transform(F.array_sort(F.collect_list(F.when(F.col("vec_id") != F.col("user_id"), F.struct("vec_id", "embedding")))), lambda x: x["embedding"]).alias("decoys"))
    return V.list_similarity(per.filter("real IS NOT NULL AND size(decoys) > 0")).withColumn("similarity", F.round("similarity", 6))


def _curves(spark, d):
    """A growing curve for each brand: running part count over sizes."""
    from pyspark.sql import Window as W

    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("curve"), F.col("p_size").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return p.withColumn("y", F.sum("n").over(W.partitionBy("curve").orderBy("x")).cast("double")).select("curve", "x", "y")


CURVES = "curves AS (SELECT curve, x, sum(n) OVER (PARTITION BY curve ORDER BY x)::DOUBLE AS y FROM (SELECT p_brand AS curve, p_size AS x, count(*) AS n FROM part GROUP BY ALL))"


@query(f"WITH {CURVES} SELECT x, round(avg(y), 6) AS y FROM curves GROUP BY 1")
def curve_mean(spark, d):
    return R.mean_of_curves(_curves(spark, d)).withColumn("y", F.round("y", 6))


@query(f"WITH {CURVES} SELECT x, floor(sum(y) / count(*))::BIGINT AS y FROM curves GROUP BY 1")
def curve_truncated_mean(spark, d):
    return R.truncated_mean(_curves(spark, d))


@query(f"WITH {CURVES} SELECT curve, x, round(y / max(y) OVER (PARTITION BY curve), 9) AS y FROM curves")
def curve_normalise(spark, d):
    return R.by_last(_curves(spark, d)).select("curve", "x", F.round("y", 9).alias("y"))


@query(
    f"""WITH {CURVES}, grid AS (SELECT i / 4.0::DOUBLE AS x FROM range(0, 220) r(i)), b AS (SELECT c.curve, g.x, (SELECT max(x) FROM curves k WHERE k.curve = c.curve AND k.x <= g.x) AS x0, (SELECT min(x) FROM curves k WHERE k.curve = c.curve AND k.x >= g.x) AS x1 FROM (SELECT DISTINCT curve FROM curves) c, grid g)
    SELECT b.curve, b.x, round(CASE WHEN x0 IS NULL THEN q.y WHEN x1 IS NULL OR x0 = x1 THEN p.y ELSE p.y + (q.y - p.y) * (b.x - x0) / (x1 - x0) END, 6) AS y FROM b LEFT JOIN curves p ON p.curve = b.curve AND p.x = x0 LEFT JOIN curves q ON q.curve = b.curve AND q.x = x1"""
)
def curve_interpolate(spark, d):
    grid = spark.range(220).select((F.col("id") / 4).alias("x"))
    return R.interpolated(_curves(spark, d), grid).withColumn("y", F.round("y", 6))


@query(f"WITH {CURVES} SELECT curve, round(sum(y * x / 50.0) / (sqrt(sum(y * y)) * sqrt(sum((x / 50.0) * (x / 50.0)))), 6) AS cosine FROM curves WHERE x BETWEEN 1 AND 50 GROUP BY 1")
def curve_cosine(spark, d):
    return R.cosine_to(_curves(spark, d), R.baseline(spark, 50)).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {CURVES}, z AS (SELECT curve, coalesce(least(min(x) FILTER (y > 10), min(x + 1) FILTER (y = 10)), max(x)) AS z FROM curves GROUP BY 1) SELECT floor(avg(z))::BIGINT AS successes FROM z")
def curve_success_at(spark, d):
    return R.success_at(_curves(spark, d), 10)


@query(f"WITH {SWEETWORDS}, m AS (SELECT 'm' || user_id % 4 AS method, CASE WHEN j = 1 THEN 1.0 ELSE 0.0 END AS epsilon, CASE WHEN j <= 3 THEN 1.0 ELSE 0.0 END AS success FROM ranked WHERE is_real) SELECT method, round(avg(epsilon), 9) AS epsilon, round(avg(success), 9) AS success FROM m GROUP BY 1")
def method_metrics_table(spark, d):
    from ..operators.attack import real_rank

    r = real_rank(weights(spark, d))
    m = r.select(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("method"), (F.col("rank") == 1).cast("double").alias("epsilon"), (F.col("rank") <= 3).cast("double").alias("success"))
    return R.method_table(m).select("method", F.round("epsilon", 9).alias("epsilon"), F.round("success", 9).alias("success"))


@query(f"WITH {SWEETWORDS}, l AS (SELECT user_id, max(word) FILTER (is_real) AS real, list(word) FILTER (NOT is_real) AS decoys FROM sweet GROUP BY 1) SELECT count(*) FILTER (len(decoys) >= 19) AS complete, count(*) FILTER (list_contains(decoys, real)) AS repeats_real FROM l")
def list_completeness(spark, d):
    s = domain.sweetwords(spark, d)
    return R.completeness(s.groupBy("user_id").agg(F.max(F.when(F.col("is_real"), F.col("word"))).alias("real"), F.collect_list(F.when(~F.col("is_real"), F.col("word"))).alias("decoys")))


@query(f"SELECT vec_id, {u32(21, 'vec_id')} / 4294967296.0 AS u FROM embeddings")
def vector_draws(spark, d):
    return table(spark, d, "embeddings").select("vec_id", uniform(21, "vec_id").alias("u"))
