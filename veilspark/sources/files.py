"""Readers and writers of the file layouts, all as Spark sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space at a line's ends.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0]"
USER_CSV = "password string, first_name string, last_name string, email string, birthday string, username string"
LISTS = "user_id long, real_password string, sweetwords array<string>"


def strip(c):
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def passwords(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One password per line, stripped, blanks dropped."""
    out = spark.read.text(path).select(strip(F.col("value")).alias("password")).filter("password <> ''")
    return out if limit is None else out.limit(limit)


def corpus_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lines as they are; comments (#) and empty ones dropped."""
    out = spark.read.text(path).select(F.col("value").alias("password")).filter("password <> '' AND NOT startswith(password, '#')")
    return out if limit is None else out.limit(limit)


def counts(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """password:count lines, split at the last colon; bad and non-positive counts dropped, files merged.

    strict: a line that isn't blank and has no count raises instead.
    """
    line = spark.read.text(path)
    if strict:
        bad = (strip(F.col("value")) != "") & ~F.col("value").rlike(r"^.*:\s*-?[0-9]+\s*$")
        line = line.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("no count in line: "), "value"))).otherwise(F.regexp_replace("value", r":\s*(-?[0-9]+)\s*$", ":$1")))
    found = line.select(F.regexp_extract("value", r"^(.*):([0-9]+)$", 1).alias("password"), F.regexp_extract("value", r"^(.*):([0-9]+)$", 2).alias("n")).filter("n <> ''")
    return found.select("password", F.col("n").cast("long").alias("cnt")).filter("cnt > 0").groupBy("password").agg(F.sum("cnt").alias("cnt"))


def raw_counts(spark: SparkSession, path: str) -> DataFrame:
    """count password lines."""
    line = spark.read.text(path)
    return line.select(F.regexp_extract("value", r"^\s*([0-9]+)\s(.*)$", 2).alias("password"), F.regexp_extract("value", r"^\s*([0-9]+)\s(.*)$", 1).cast("long").alias("cnt")).filter("cnt IS NOT NULL")


def aggregated(spark: SparkSession, path: str) -> DataFrame:
    """password, tab, count."""
    return spark.read.option("sep", "\t").option("quote", "").schema("password string, cnt long").csv(path)


def dump_folder(spark: SparkSession, path: str) -> DataFrame:
    """user:password lines of nested files: path, password after the last colon; lines without one dropped."""
    line = spark.read.option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), "value")
    return line.filter(F.col("value").contains(":")).select("path", F.substring_index("value", ":", -1).alias("password"))


def users_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(USER_CSV).csv(path)


def train_and_test(spark: SparkSession, test: str, train: str | None = None, targeted: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(test, train or None): CSV with a header and personal data for targeted models, else one password per line."""
    read = users_csv if targeted else passwords
    return read(spark, test), None if train is None else read(spark, train)


def hash_lines(spark: SparkSession, path: str) -> DataFrame:
    """hash:password lines, the password after the first colon; # lines dropped."""
    line = spark.read.text(path).filter("NOT startswith(value, '#') AND instr(value, ':') > 0")
    return line.select(F.expr("substring(value, instr(value, ':') + 1)").alias("password"))


def has_hash_lines(spark: SparkSession, path: str, lines: int = 5000) -> bool:
    """Whether all of the first lines look like hash:password."""
    some = spark.read.text(path).limit(lines).filter("value <> '' AND NOT startswith(value, '#')")
    r = some.agg(F.count(F.lit(1)), F.count_if(F.col("value").rlike(r"^(\$|\{)?[A-Za-z0-9$./{}*=+-]{6,}:"))).first()
    return bool(r[0]) and r[0] == r[1]


def wide_lists(spark: SparkSession, path: str, interleaved: bool) -> DataFrame:
    """user_id by line, real, decoys of a CSV without header; interleaved ones have a number after each word. Blanks, nan and copies of the real word are no decoys."""
    line = spark.read.text(path).withColumn("user_id", F.monotonically_increasing_id())
    cells = F.transform(F.split("value", ","), lambda c: strip(c))
    kept = F.filter(cells, lambda c, i: ((i % 2 == 0) if interleaved else F.lit(True)) & (c != ""))
    real = F.get(kept, F.lit(0))
    decoys = F.array_remove(F.filter(kept, lambda c, i: (i > 0) & (F.lower(c) != "nan")), real)
    return line.select("user_id", real.alias("real"), decoys.alias("decoys")).filter("real IS NOT NULL")


def write_lists(lists: DataFrame, path: str) -> None:
    lists.write.mode("overwrite").json(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTS).json(path)


def cache_path(folder: str, **run: object) -> str:
    """A folder per set of run parameters."""
    return "/".join([folder.rstrip("/"), *(f"{k}={run[k]}" for k in sorted(run))])


def write_frequencies(freqs: DataFrame, path: str) -> None:
    freqs.write.mode("overwrite").partitionBy("type").parquet(path)


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, freq long, type string").parquet(path).select("type", "token", "freq")


def write_result(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """file, label, k, epsilon, success rate and curve of result documents in either layout.

    The curve is the whole campaign's (success_curve or success_number); the capped one (attack_stats) stands in where there is none.
    """
    schema = "attack_stats struct<fail:array<long>,succ:array<long>>, epsilon_flatness double, attack_success_rate double, flatness_graph array<long>, cracked_by_t1 array<long>, success_number struct<fail:array<long>,succ:array<long>>, label string, k int, epsilon double, ranks array<long>, success_curve array<array<double>>, n_users long"
    got = spark.read.schema(schema).option("multiLine", True).json(path)
    points = lambda c: F.zip_with(f"{c}.fail", f"{c}.succ", lambda f, s: F.array(f.cast("double"), s.cast("double")))
    curve = F.coalesce(F.col("success_curve"), points("success_number"), points("attack_stats"))
    return got.select(F.input_file_name().alias("file"), "label", "k", F.coalesce("epsilon", "epsilon_flatness").alias("epsilon"), F.col("attack_success_rate").alias("success"), curve.alias("curve"), F.coalesce("flatness_graph", "cracked_by_t1").alias("flatness"), "ranks", "n_users")


def write_grammar(probs: DataFrame, path: str) -> None:
    probs.write.mode("overwrite").partitionBy("type", "len").parquet(path)


def read_grammar(spark: SparkSession, path: str, grouped: bool = False) -> DataFrame:
    """type, len, item, num, prob; grouped: values of equal probability together."""
    rows = spark.read.schema("item string, num long, prob double, type string, len int").parquet(path)
    if not grouped:
        return rows.select("type", "len", "item", "num", "prob")
    return rows.groupBy("type", "len", "prob").agg(F.array_sort(F.collect_list("item")).alias("values"))


# fixed values: sections of a ruleset's config.ini, their folder and type
SECTIONS = {
    "START": ("Grammar", "S"), "BASE_A": ("Alpha", "A"), "CAPITALIZATION": ("Capitalization", "C"), "BASE_D": ("Digits", "D"),
    "BASE_O": ("Other", "O"), "BASE_K": ("Keyboard", "K"), "BASE_X": ("Context", "X"),
}
WHOLE = "Grammar.txt"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_ruleset(probs: DataFrame, path: str) -> None:
    """A grammar as files: a folder per type with value, tab, probability lines per length, most likely first, and config.ini.

    Each file is sorted and written by one task as a stream, and then takes its name; an older ruleset at path is replaced.
    """
    spark = probs.sparkSession
    folder = F.element_at(F.create_map(*(F.lit(x) for f, t in SECTIONS.values() for x in (t, f))), F.col("type"))
    rows = probs.select(folder.alias("folder"), "len", F.concat("item", F.lit("\t"), F.col("prob").cast("string")).alias("line"), "prob", "item")
    sorted_ = rows.repartition("folder", "len").sortWithinPartitions("folder", "len", F.desc("prob"), "item")
    at, fs = _fs(spark, path)
    fs.delete(at, True)
    sorted_.select("folder", "len", "line").write.partitionBy("folder", "len").text(f"{path}/_parts")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    held: dict[str, list[str]] = {}
    for own in fs.globStatus(path_of(f"{path}/_parts/folder=*/len=*/part-*")):  # a file per type and length
        n, f = (own.getPath().getParent().getName(), own.getPath().getParent().getParent().getName())
        f, n = f.removeprefix("folder="), n.removeprefix("len=")
        name = WHOLE if f == "Grammar" else f"{n}.txt"
        fs.mkdirs(path_of(f"{path}/{f}"))
        fs.rename(own.getPath(), path_of(f"{path}/{f}/{name}"))
        held.setdefault(f, []).append(name)
    fs.delete(path_of(f"{path}/_parts"), True)
    lines = []
    for section, (f, t) in SECTIONS.items():
        if f in held:
            names = sorted(held[f], key=lambda x: (len(x), x))
            lines += [f"[{section}]", f"directory = {f}", f"type = {t}", f"filenames = {json.dumps(names)}", ""]
    out = fs.create(path_of(f"{path}/config.ini"), True)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()


def read_ruleset(spark: SparkSession, path: str, grouped: bool = False) -> DataFrame:
    """type, len, item, prob of the files that config.ini names; grouped: the values of equal probability together.

    A line without exactly one tab or with a bad number raises, as does a file whose probabilities rise. The order is looked at within each
    split of a file and then between the splits' ends, so a long file isn't read by one task.
    """
    import configparser

    from pyspark.sql import Window as W

    config = configparser.ConfigParser()
    config.read_string(spark.read.text(f"{path}/config.ini", wholetext=True).first()[0])
    files = [(config[s]["directory"], config[s]["type"], x) for s in config.sections() for x in json.loads(config[s]["filenames"])]
    kind = F.element_at(F.create_map(*(F.lit(x) for f, t in {(f, t) for f, t, _ in files} for x in (f, t))), F.element_at(F.split("file", "/"), -2))
    line = spark.read.text([f"{path}/{f}/{x}" for f, _, x in files]).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    cells = F.split("value", "\t")
    number = F.element_at(cells, 2).try_cast("double")
    prob = F.when((F.size(cells) == 2) & number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("no value and probability in line: "), "value")))
    length = F.coalesce(F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"^([0-9]+)\.txt$", 1).try_cast("int"), F.lit(0))
    rows = line.select("file", "split", "at", kind.alias("type"), length.alias("len"), cells[0].alias("item"), prob.alias("prob"))
    rising = F.coalesce(F.col("prob") > F.lag("prob").over(W.partitionBy("file", "split").orderBy("at")), F.lit(False))
    per = rows.withColumn("rising", rising).groupBy("file", "split").agg(F.max("rising").alias("rising"), F.max("prob").alias("top"), F.min("prob").alias("low"))
    after = F.coalesce(F.col("top") > F.lag("low").over(W.partitionBy("file").orderBy("split")), F.lit(False))  # a row per split
    bad = per.withColumn("after", after).filter("rising OR after").select("file").first()
    if bad:
        raise ValueError(f"the probabilities of {bad['file']} don't fall")
    if grouped:
        return rows.groupBy("type", "len", "prob").agg(F.array_sort(F.collect_list("item")).alias("values"))
    return rows.select("type", "len", "item", "prob")


def legacy_statistics(spark: SparkSession, path: str) -> DataFrame:
    """file, attacker, x, y of text files with a name line and then a line of numbers each."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\n").alias("lines"))
    named = whole.select("file", F.posexplode("lines").alias("i", "line")).filter("line <> ''")
    number = named["line"].rlike(r"^[\s\[\]0-9.,eE+-]+$")
    from pyspark.sql import Window as W

    w = W.partitionBy("file").orderBy("i")
    held = named.withColumn("attacker", F.last(F.when(~number, F.col("line")), True).over(w)).filter(number)
    return held.select("file", "attacker", F.posexplode(F.transform(F.regexp_extract_all("line", F.lit(r"([0-9.eE+-]+)"), F.lit(1)), lambda x: x.cast("double"))).alias("x", "y"))


def write_chain(transitions: DataFrame, starts: DataFrame, path: str) -> None:
    """A fitted character chain: two tables under one folder."""
    transitions.write.mode("overwrite").parquet(f"{path}/transitions")
    starts.write.mode("overwrite").parquet(f"{path}/starts")


def read_chain(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/transitions"), spark.read.parquet(f"{path}/starts")


def write_rank_model(ranks: DataFrame, rollup: DataFrame, path: str) -> None:
    """Letter ranks and the ranks' probabilities over their key spaces."""
    ranks.write.mode("overwrite").parquet(f"{path}/letters")
    rollup.write.mode("overwrite").parquet(f"{path}/ranks")


def read_rank_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(letter ranks, ranks by falling probability)."""
    return spark.read.parquet(f"{path}/letters"), spark.read.parquet(f"{path}/ranks").orderBy(F.desc("p"), "rank")


def write_frequency_json(freqs: DataFrame, path: str) -> None:
    """A line {"type", "token", "freq"} for each token, so that any reader can split the file."""
    freqs.select("type", "token", "freq").write.mode("overwrite").json(path)


def read_frequency_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("type string, token string, freq long").json(path)


def write_word_map(lists: DataFrame, path: str) -> None:
    """A line {real: [words]} for each list (user_id, idx, word, is_real); of lists with the same real word the last user's stays."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"])
    per = lists.groupBy("user_id").agg(F.max(F.when(F.col("is_real"), F.col("word"))).alias("real"), words.alias("words")).filter("real IS NOT NULL")
    last = per.groupBy("real").agg(F.max_by("words", "user_id").alias("words"))
    last.select(F.to_json(F.create_map("real", "words")).alias("value")).write.mode("overwrite").text(path)


def read_word_map(spark: SparkSession, path: str) -> DataFrame:
    """real, words."""
    line = spark.read.text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return line.select(F.explode("m").alias("real", "words"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A stage's rows as CSV with a header; arrays as JSON."""
    flat = [F.to_json(F.col(c)).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
