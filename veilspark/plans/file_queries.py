"""Queries through files: a table goes out in a file layout, comes back by its reader and is compared as rows.

The files lie in the folder that the cluster shares and are deleted once the rows are cut off from them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import profile_tokens, structure_parts
from ..operators import decoys as G
from ..operators import freqdb as D
from ..operators import markov as M
from ..operators import pcfg as P
from ..session import cut, shared_folder, table
from ..sources import files
from . import domain
from .domain import CORPUS, PASSWORDS, SWEETWORDS, USERS
from .model_queries import GRAMMAR, LETTERS
from .registry import registry

QUERIES, SQL, query = registry()


def _through(spark: SparkSession, write: Callable[[str], object], read: Callable[[str], DataFrame]) -> DataFrame:
    """read(path) after write(path); the files don't outlive the call."""
    path = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    write(path)
    out = cut(read(path))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return out


def _texts(rows: DataFrame, line) -> Callable[[str], None]:
    return lambda path: rows.select(line.alias("value")).write.text(path)


def _counted(rows: DataFrame, key: str = "password") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


LINES = "lines AS (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n')) AS line FROM documents)"
BLANK = "[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}]"


@query(f"WITH {LINES} SELECT password, count(*) AS n FROM (SELECT regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') AS password FROM lines) WHERE password <> '' GROUP BY 1")
def password_file(spark, d):
    """Lines of the documents as a list of passwords: white space at the ends is cut, blank lines are dropped."""
    docs = table(spark, d, "documents")
    return _counted(_through(spark, _texts(docs, F.coalesce("text", F.lit(""))), lambda p: files.passwords(spark, p)))


@query(f"WITH {LINES} SELECT line AS password, count(*) AS n FROM lines WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY 1")
def corpus_file(spark, d):
    """Lines of the documents as a corpus: kept as they are, comments and empty ones dropped."""
    docs = table(spark, d, "documents")
    return _counted(_through(spark, _texts(docs, F.coalesce("text", F.lit(""))), lambda p: files.corpus_lines(spark, p)))


@query("SELECT l_linestatus || ':' || l_returnflag || l_suppkey AS password, count(*) AS cnt FROM lineitem GROUP BY 1")
def count_files(spark, d):
    """Counts of two files, merged; words hold colons themselves, so lines part at the last one."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 2).alias("half"), F.concat("l_linestatus", F.lit(":"), "l_returnflag", F.col("l_suppkey").cast("string")).alias("password"))
    per = rows.groupBy("half", "password").agg(F.count(F.lit(1)).alias("cnt"))

    def write(path: str) -> None:
        for half in (0, 1):
            _texts(per.filter(F.col("half") == half), F.concat("password", F.lit(":"), F.col("cnt").cast("string")))(f"{path}/{half}")

    return _through(spark, write, lambda p: files.counts(spark, [f"{p}/0", f"{p}/1"], strict=True))


@query(f"WITH {CORPUS} SELECT password, count(*) AS cnt FROM corpus GROUP BY 1")
def sorted_count_file(spark, d):
    """Counts written as word, tab, count by ranges of words."""
    counted = domain.word_counts(spark, d)
    write = lambda p: counted.repartitionByRange("password").sortWithinPartitions("password").write.option("sep", "\t").csv(p)
    return _through(spark, write, lambda p: files.aggregated(spark, p))


@query(f"WITH {CORPUS} SELECT password, count(*) AS cnt FROM corpus GROUP BY 1")
def raw_count_file(spark, d):
    """Counts written as a padded count and the word."""
    line = F.concat(F.lpad(F.col("cnt").cast("string"), 12, " "), F.lit(" "), "password")
    return _through(spark, _texts(domain.word_counts(spark, d), line), lambda p: files.raw_counts(spark, p))


@query(f"WITH {CORPUS} SELECT source, password, count(*) AS n FROM corpus GROUP BY ALL")
def dump_folders(spark, d):
    """user:password lines in a folder per source."""
    rows = domain.corpus(spark, d).select("source", F.concat(F.lit("u:"), F.col("doc_id").cast("string"), F.lit(":"), "password").alias("value"))
    got = _through(spark, lambda p: rows.write.partitionBy("source").text(p), lambda p: files.dump_folder(spark, p))
    return got.groupBy(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"), "password").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {USERS} SELECT password, first_name, last_name, email, birthday, username FROM users")
def user_file(spark, d):
    """Users with personal data as CSV with a header."""
    u = domain.users(spark, d).select("password", "first_name", "last_name", "email", "birthday", "username")
    return _through(spark, lambda p: u.write.option("header", True).csv(p), lambda p: files.train_and_test(spark, p, targeted=True)[0])


@query(f"WITH {PASSWORDS} SELECT pid::VARCHAR || ':' || password AS password, 1::BIGINT AS n FROM passwords")
def hash_file(spark, d):
    """hash:password lines; a password may hold colons, comments are dropped."""
    line = F.concat(F.sha2("password", 256), F.lit(":"), F.col("pid").cast("string"), F.lit(":"), "password")
    rows = domain.passwords(spark, d).select(F.explode(F.array(line, F.concat(F.lit("# "), line))).alias("value"))
    return _counted(_through(spark, _texts(rows, F.col("value")), lambda p: files.hash_lines(spark, p)))


OWN_LISTS = SWEETWORDS + ", own_lists AS (SELECT user_id, max(word) FILTER (is_real) AS real, list(word ORDER BY idx) FILTER (NOT is_real) AS decoys, list(word ORDER BY idx) AS words FROM sweet GROUP BY 1)"


def _lists(spark, d):
    words = F.array_sort(F.collect_list(F.struct("idx", "word", "is_real")))
    per = domain.sweetwords(spark, d).groupBy("user_id").agg(F.max(F.when(F.col("is_real"), F.col("word"))).alias("real"), words.alias("all"))
    names = lambda x: F.transform(x, lambda s: s["word"])
    return cut(per.select("user_id", "real", names(F.filter("all", lambda s: ~s["is_real"])).alias("decoys"), names(F.col("all")).alias("words")))


@query(f"WITH {OWN_LISTS} SELECT layout, real, list_aggregate(decoys, 'string_agg', ' ') AS decoys, count(*) AS n FROM own_lists, (VALUES ('plain'), ('interleaved')) v(layout) WHERE list_aggregate(decoys, 'string_agg', ' ') IS NOT NULL GROUP BY ALL")
def wide_list_files(spark, d):
    """Lists as wide CSV in both layouts, with blanks, nan and the real word again, which are no decoys."""
    lists = _lists(spark, d)
    out = None
    for layout, gap in (("plain", ","), ("interleaved", ",0.5,")):
        line = F.array_join(F.concat(F.array("real"), F.col("decoys"), F.array(F.lit("nan"), F.lit(" "), F.col("real"))), gap)
        got = _through(spark, _texts(lists, line), lambda p, x=layout: files.wide_lists(spark, p, x == "interleaved"))
        got = got.filter(F.size("decoys") > 0).select(F.lit(layout).alias("layout"), "real", F.array_join("decoys", " ").alias("decoys"))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("layout", "real", "decoys").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SWEETWORDS} SELECT user_id, idx, word, is_real FROM sweet")
def list_cache(spark, d):
    """Lists as a cache of JSON lines in a folder named by the run's parameters."""
    lists = _lists(spark, d).select("user_id", F.col("real").alias("real_password"), F.col("words").alias("sweetwords"))
    at = lambda p: files.cache_path(p, k=domain.K, seed=domain.SEED)
    got = _through(spark, lambda p: files.write_lists(lists, at(p)), lambda p: files.read_lists(spark, at(p)))
    return got.select("user_id", "real_password", F.posexplode("sweetwords").alias("idx", "word")).select("user_id", "idx", "word", (F.col("word") == F.col("real_password")).alias("is_real"))


@query(f"WITH {OWN_LISTS} SELECT real, list_aggregate(arg_max(words, user_id), 'string_agg', ' ') AS words FROM own_lists WHERE real IS NOT NULL GROUP BY 1")
def word_map_file(spark, d):
    """Lists as {real: words}; of users with one real word the last one's list stays."""
    got = _through(spark, lambda p: files.write_word_map(domain.sweetwords(spark, d), p), lambda p: files.read_word_map(spark, p))
    return got.select("real", F.array_join("words", " ").alias("words"))


@query(f"WITH {OWN_LISTS} SELECT user_id, real, to_json(decoys)::VARCHAR AS decoys FROM own_lists WHERE decoys IS NOT NULL")
def stage_file(spark, d):
    """A stage's rows as CSV with a header, arrays as JSON."""
    rows = _lists(spark, d).filter(F.size("decoys") > 0).select("user_id", "real", "decoys")
    return _through(spark, lambda p: files.write_csv(rows, p), lambda p: spark.read.option("header", True).option("escape", "\\").schema("user_id long, real string, decoys string").csv(p))


FREQS = PASSWORDS + """, found AS (SELECT unnest(regexp_extract_all(password, '[a-zA-Z]+|[0-9]+|[^a-zA-Z0-9]+')) AS v FROM passwords),
  freqs AS (SELECT CASE WHEN regexp_matches(v, '^[a-zA-Z]') THEN 'A' WHEN regexp_matches(v, '^[0-9]') THEN 'D' ELSE 'S' END AS type, CASE WHEN regexp_matches(v, '^[a-zA-Z]') THEN lower(v) ELSE v END AS token, count(*) AS freq FROM found GROUP BY ALL)"""


@query(f"WITH {FREQS} SELECT type, token, freq FROM freqs")
def frequency_file(spark, d):
    """Token frequencies as JSON lines."""
    freqs = D.token_counts(domain.passwords(spark, d)).filter("type <> 'P'")
    return _through(spark, lambda p: files.write_frequency_json(freqs, p), lambda p: files.read_frequency_json(spark, p))


@query(f"WITH {GRAMMAR} SELECT t AS type, n::INTEGER AS len, round(p, 12) AS prob, count(*) AS n, min(v) AS first, max(v) AS last FROM terms GROUP BY t, n, round(p, 12)")
def ruleset_files(spark, d):
    """A grammar as a ruleset of files in falling order, read back with the values of equal probability together."""
    probs = cut(P.probabilities(P.items(P.parsed(domain.passwords(spark, d)))))
    got = _through(spark, lambda p: files.write_ruleset(probs, p), lambda p: files.read_ruleset(spark, p, grouped=True))
    return got.select("type", "len", F.round("prob", 12).alias("prob"), F.size("values").cast("long").alias("n"), F.col("values")[0].alias("first"), F.element_at("values", -1).alias("last"))


@query(f"WITH {LETTERS} SELECT prev, c, n, rank FROM ranks")
def rank_model_files(spark, d):
    """Letter ranks through a model's files."""
    ranks = cut(M.letter_ranks(domain.passwords(spark, d)))
    rolled = ranks.groupBy("rank").agg(F.sum("n").alias("p"))
    return _through(spark, lambda p: files.write_rank_model(ranks, rolled, p), lambda p: files.read_rank_model(spark, p)[0])


@query(f"WITH {GRAMMAR}, holes AS (SELECT structure, unnest(regexp_extract_all(structure, '[A-Z][0-9]+')) AS part FROM (SELECT DISTINCT structure FROM named)) SELECT structure, part[1] AS type, part[2:]::INTEGER AS len, count(*) AS n FROM holes GROUP BY ALL")
def structure_slots(spark, d):
    """The slots of each base structure by type and length."""
    named = P.parsed(domain.passwords(spark, d)).select("structure").distinct()
    return named.select("structure", F.explode(structure_parts(F.col("structure"))).alias("x")).groupBy("structure", "x.type", "x.len").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {USERS}, t AS (SELECT user_id, concat_ws(' ', first_name, last_name, email, birthday, password) AS t FROM users),
    f AS (SELECT user_id, 'alpha' AS kind, lower(unnest(regexp_extract_all(t, '[A-Za-z]{{2,}}'))) AS token FROM t UNION ALL SELECT user_id, 'digit', unnest(regexp_extract_all(t, '[0-9]+')) FROM t
      UNION ALL SELECT user_id, 'special', unnest(regexp_extract_all(t, '[^A-Za-z0-9\\s]+')) FROM t) SELECT DISTINCT user_id, kind, token FROM f"""
)
def profile_token_rows(spark, d):
    """Words, numbers and specials of each user's profile."""
    p = profile_tokens(F.col("first_name"), F.col("last_name"), F.col("email"), F.col("birthday"), F.col("password"))
    held = domain.users(spark, d).select("user_id", p.alias("p"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p.{k}").alias("tokens")) for k in ("alpha", "digit", "special")])
    return held.select("user_id", F.explode(kinds).alias("x")).select("user_id", "x.kind", F.explode("x.tokens").alias("token"))


@query(f"WITH {OWN_LISTS}, numbered AS (SELECT user_id, real, decoys, user_id % (len(decoys) + 1) AS place FROM own_lists WHERE decoys IS NOT NULL), made AS (SELECT user_id, list_concat(list_concat(decoys[1:place], [real]), decoys[place + 1:]) AS w FROM numbered) SELECT user_id, generate_subscripts(w, 1) - 1 AS idx, unnest(w) AS word FROM made")
def inserted_sugar(spark, d):
    """The real word put in among its decoys."""
    lists = _lists(spark, d).filter(F.size("decoys") > 0)
    made = G.insert_sugar(F.col("decoys"), F.col("real"), (F.col("user_id") % (F.size("decoys") + 1)).cast("int"))
    return lists.select("user_id", F.posexplode(made).alias("idx", "word")).select("user_id", F.col("idx").cast("long").alias("idx"), "word")
