"""The engine's inputs from the driver tables, as DataFrames and as SQL that DuckDB runs.

corpus: ASCII words of documents; passwords: composites of part and customer; users: customers with
a composite password and made-up personal data; vocabulary blocks give each user decoys without
pairing users with words: users and words meet in hash blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rng import draw32
from ..operators.freqdb import prefix_sums
from ..session import cut, spread, table

SEED, K, BLOCKS = 67, 20, 64
#: A vocabulary of so many words goes to every task; a larger one meets the users by a shuffle.
HELD = 500_000


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, password, source."""
    docs = table(spark, sf_dir, "documents")
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    return docs.select("doc_id", "source", F.posexplode(found).alias("i", "password"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("password").agg(F.count(F.lit(1)).alias("cnt"))


def passwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, password."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.concat(F.translate("p_name", " ", "_"), F.lit("#"), F.col("p_size").cast("string")).alias("password"))
    cust = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000000000).alias("pid"), F.concat("c_mktsegment", F.lit("!"), F.col("c_custkey").cast("string")).alias("password"))
    return spread(part.unionByName(cust), "pid")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, password and personal data of every customer."""
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.translate("n_name", "_", "")).alias("last"))
    both = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # a row per nation
    key = F.col("c_custkey")
    day = F.lpad((draw32(1, key) % 28 + 1).cast("string"), 2, "0")
    month = F.lpad((draw32(2, key) % 12 + 1).cast("string"), 2, "0")
    year = (draw32(3, key) % 60 + 1945).cast("string")
    name = F.concat(F.lit("user"), key.cast("string"))
    first = F.lower("c_mktsegment")
    kind = key % 4
    pw = F.when(kind == 0, F.concat(first, F.lit("#"), year)).when(kind == 1, F.concat("last", F.lit("_"), day, month)).when(kind == 2, F.concat(name, F.lit("!"))).otherwise(F.concat(first, F.lit("!"), key.cast("string")))
    return both.select(key.alias("user_id"), pw.alias("password"), first.alias("first_name"), F.col("last").alias("last_name"), F.concat(name, F.lit("@example.org")).alias("email"), F.concat(day, month, year).alias("birthday"), name.alias("username"))


def sweetwords(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """user_id, idx, word, is_real: k words of the user's hash block; hash chooses the words, their order and the real one."""
    return counted_sweetwords(spark, sf_dir, k).drop("cnt")


def counted_sweetwords(spark: SparkSession, sf_dir: str, k: int = K, held: int = HELD) -> DataFrame:
    """sweetwords with cnt, each word's number of places in the corpus, which comes with the word and needs no look-up."""
    v = word_counts(spark, sf_dir).filter("cnt >= 2").select(F.col("password").alias("word"), (draw32(5, "password") % BLOCKS).alias("g"), F.lit(1).cast("long").alias("one"), "cnt")
    placed = cut(prefix_sums(v, ["g"], ["word"], "one").select("g", "upto", "word", "cnt"))
    sizes = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    own = spread(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("user_id"), (draw32(6, "c_custkey") % BLOCKS).alias("g"), draw32(7, "c_custkey").alias("start"), draw32(8, "c_custkey").alias("real"))
    own = own.join(F.broadcast(sizes), "g").withColumn("k", F.least(F.lit(k).cast("long"), F.col("n")))  # a row per block
    # k places of the block: a hash start and steps of one, so they differ; users and words meet on (block, place)
    asked = own.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    asked = asked.select("user_id", "g", ((F.col("start") + F.col("i")) % F.col("n") + 1).alias("upto"), (F.col("real") % F.col("k")).alias("at"))
    # met in place, a user's words stay in the task where the user was dealt
    picked = asked.join(F.broadcast(placed) if placed.count() <= held else placed, ["g", "upto"])
    order = W.partitionBy("user_id").orderBy(draw32(SEED, "user_id", "word"), "word")
    placed = picked.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
    return placed.select("user_id", "word", "cnt", "idx", (F.col("idx") == F.col("at")).alias("is_real"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reg, password: one for each part in key order, a base-ten composite."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("reg"), F.concat(F.translate("p_name", " ", "_"), F.lit("#"), F.col("p_size").cast("string")).alias("password")).filter("reg % 2 = 1")


def base_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other parts' composites."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("reg"), F.concat(F.translate("p_name", " ", "_"), F.lit("#"), F.col("p_size").cast("string")).alias("password")).filter("reg % 2 = 0")


def _u(seed: int, *keys: str) -> str:
    return "('0x' || substr(sha256('" + str(seed) + "' || " + " || ".join(f"':' || CAST({k} AS VARCHAR)" for k in keys) + "), 1, 8))::BIGINT"


u32 = _u

CORPUS = "corpus AS (SELECT doc_id, source, unnest(w) AS password FROM (SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents))"
COUNTS = CORPUS + ", counts AS (SELECT password, count(*) AS cnt FROM corpus GROUP BY 1)"
PASSWORDS = """passwords AS (SELECT p_partkey AS pid, replace(p_name, ' ', '_') || '#' || p_size AS password FROM part
  UNION ALL SELECT c_custkey + 1000000000, c_mktsegment || '!' || c_custkey FROM customer)"""
USERS = f"""users AS (SELECT c_custkey AS user_id,
    CASE c_custkey % 4 WHEN 0 THEN first || '#' || y WHEN 1 THEN last || '_' || d || m WHEN 2 THEN username || '!' ELSE first || '!' || c_custkey END AS password,
    first AS first_name, last AS last_name, username || '@example.org' AS email, d || m || y AS birthday, username
  FROM (SELECT c_custkey, lower(c_mktsegment) AS first, lower(replace(n_name, '_', '')) AS last, 'user' || c_custkey AS username,
      lpad(CAST({_u(1, 'c_custkey')} % 28 + 1 AS VARCHAR), 2, '0') AS d, lpad(CAST({_u(2, 'c_custkey')} % 12 + 1 AS VARCHAR), 2, '0') AS m, CAST({_u(3, 'c_custkey')} % 60 + 1945 AS VARCHAR) AS y
    FROM customer JOIN nation ON c_nationkey = n_nationkey))"""
SWEETWORDS = COUNTS + f""", blocks AS (SELECT g, list(password ORDER BY password) AS words FROM (SELECT password, {_u(5, 'password')} % {BLOCKS} AS g FROM counts WHERE cnt >= 2) GROUP BY g),
  own AS (SELECT c_custkey AS user_id, words FROM (SELECT c_custkey, {_u(6, 'c_custkey')} % {BLOCKS} AS g FROM customer) JOIN blocks USING (g)),
  picked AS (SELECT user_id, words[1 + ({_u(7, 'user_id')} + i) % len(words)] AS word FROM (SELECT user_id, words, unnest(range(0, least({K}, len(words)))) AS i FROM own)),
  placed AS (SELECT user_id, word, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {_u(SEED, 'user_id', 'word')}, word) - 1 AS INTEGER) AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM picked),
  sweet AS (SELECT user_id, idx, word, idx = {_u(8, 'user_id')} % n AS is_real FROM placed),
  probs AS (SELECT s.*, CAST(c.cnt AS DOUBLE) / (SELECT sum(cnt) FROM counts) AS p FROM sweet s JOIN counts c ON c.password = s.word),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, idx) AS j FROM probs),
  prio AS (SELECT *, round(p / sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 12) AS pi FROM ranked)"""
