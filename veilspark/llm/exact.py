"""Exact dedup by skew-safe combining, in DataFrame operations only.

1. Each row gets a digest (SHA-256) and a salt. (digest, salt) groups are counted, first within each
   task; those whose digest occurs twice or more are the marks. Only digests and counts move.
2. Rows are dealt by (digest, salt), so a group of copies that holds a third of all rows is spread over
   SALTS tasks from the first shuffle of texts on. Marked ones are combined by (digest, salt,
   text), again first within each task.
3. The salts' winners are combined by (digest, text); every salt then learns its group's winner, and
   the rows, which lie where they were dealt, learn it from their salt.

Every stage compares the text itself beside its digest, so equal means equal content. No join has a
key with more than a salt's share of a group on one side and SALTS rows on the other.

Defined results: null text counts as empty; equal texts are one group whatever their doc_id; of
rows with the same largest doc_id each is kept; a null doc_id is smaller than any other, and a
group of nulls alone keeps them; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, (d.doc_id IS NOT DISTINCT FROM g.keep_id) AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def label_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs with keep_id, group_size, kept and text_sha256 beside their own columns."""
    rows = docs.withColumns({"_text": F.coalesce(F.col("text"), F.lit("")), "_id": F.col("doc_id").cast("long")})
    # never null, so that no join adds a filter and its shuffle of the rows can serve both joins;
    # the salt depends on the row alone, so a task that runs again deals alike
    digest = F.coalesce(F.unhex(F.sha2(F.col("_text"), 256)), F.lit(b""))
    rows = rows.withColumns({"_digest": digest, "_salt": F.coalesce(F.pmod(F.xxhash64("_id"), F.lit(SALTS)), F.lit(0))})
    salts = rows.groupBy("_digest", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # SALTS salts of a digest at most
    twice = salts.groupBy("_digest").agg(F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salts")).filter("_n > 1")
    marks = twice.select("_digest", F.explode("_salts").alias("_salt"))
    copies = rows.select("_id", "_text", "_digest", "_salt").join(marks, ["_digest", "_salt"], "left_semi")
    salted = copies.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_max"), F.count(F.lit(1)).alias("_count"))
    best = salted.groupBy(F.col("_digest").alias("w_digest"), F.col("_text").alias("w_text")).agg(F.max("_max").alias("w_keep"), F.sum("_count").alias("w_size"), F.collect_list("_salt").alias("w_salts"))
    wins = best.select("w_digest", "w_text", "w_keep", "w_size", F.explode("w_salts").alias("w_salt"))
    # dealt by digest and salt alone, as before; the text is compared as a condition
    same = (F.col("_digest") == F.col("w_digest")) & (F.col("_salt") == F.col("w_salt")) & (F.col("_text") <= F.col("w_text")) & (F.col("_text") >= F.col("w_text"))
    keep = F.when(F.col("w_size").isNull(), F.col("_id")).otherwise(F.col("w_keep"))
    found = rows.join(wins, same, "left").withColumns({"keep_id": keep, "group_size": F.coalesce("w_size", F.lit(1).cast("long"))})
    found = found.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))
    own = [F.col("_id").alias(c) if c == "doc_id" and dict(docs.dtypes)[c] == "bigint" else F.col(c) for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    return found.select(*own, "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the largest doc_id, with the columns of docs; equal rows stay once."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    back = {v: k for k, v in names.items()}
    kept = label_copies(docs.withColumnsRenamed(names)).filter("kept")
    single = kept.filter("group_size = 1")
    # rows that share the largest doc_id: one of them
    many = kept.filter("group_size > 1").dropDuplicates(["text_sha256", "text"])
    return single.unionByName(many).drop("keep_id", "group_size", "kept", "text_sha256").withColumnsRenamed(back).select(*docs.columns)
