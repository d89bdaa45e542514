"""Grammar models: segment statistics, smoothing, scoring and sampling."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import zip_longest

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.pii import CODES
from ..functions.segment import segment, structure
from ..functions.strings import apply_mask, cap_mask, training_valid
from ..session import cut, spread
from .freqdb import prefix_sums

#: Items of a grammar that every task may hold.
HELD = 200_000
ASKED = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.struct([("slot", pa.int32()), ("type", pa.string()), ("len", pa.int32()), ("u", pa.float64()), ("mask", pa.string())])))


def parsed(corpus: DataFrame, word: str = "password") -> DataFrame:
    """corpus with `segs` and `structure`, valid words only."""
    out = corpus.filter(training_valid(F.col(word))).withColumn("segs", segment(F.col(word)))
    return out.withColumn("structure", structure(F.col("segs")))


def parsed_coded(rows: DataFrame, key: str, word: str = "coded") -> DataFrame:
    """key, segs, structure of coded passwords: a code is a segment of type T, text between is parsed as usual."""
    signs = "".join(f"\\x{ord(c):02x}" for c in CODES.values())
    pieces = F.regexp_extract_all(word, F.lit(f"([{signs}]|[^{signs}]+)"), F.lit(1))
    split = rows.select(key, F.posexplode(pieces).alias("at", "piece"))
    tag, empty = F.col("piece").rlike(f"^[{signs}]$"), F.array().cast("array<struct<type:string,len:int,value:string>>")
    code = F.array(F.struct(F.lit("T").alias("type"), F.lit(1).alias("len"), F.col("piece").alias("value")))
    split = split.withColumn("own", segment(F.when(tag, F.lit("")).otherwise(F.col("piece"))))
    split = split.withColumn("own", F.when(tag, code).otherwise(F.coalesce("own", empty)))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"]))
    return split.groupBy(key).agg(whole.alias("segs")).withColumn("structure", structure(F.col("segs")))


def items(parsed_: DataFrame) -> DataFrame:
    """type, len, item, num: terminals of each type and length (letters lower-cased), masks (C), structures (S)."""
    lower = lambda s: F.when(s["type"] == "A", F.lower(s["value"])).otherwise(s["value"])
    kinds = F.transform("segs", lambda s: F.struct(s["type"].alias("type"), s["len"].alias("len"), lower(s).alias("item")))
    masks = F.transform(F.filter("segs", lambda s: s["type"] == "A"), lambda s: F.struct(F.lit("C").alias("type"), s["len"].alias("len"), cap_mask(s["value"]).alias("item")))
    whole = F.array(F.struct(F.lit("S").alias("type"), F.lit(0).alias("len"), F.col("structure").alias("item")))
    return parsed_.select(F.explode(F.concat(kinds, masks, whole)).alias("x")).groupBy("x.type", "x.len", "x.item").agg(F.count(F.lit(1)).alias("num"))


def probabilities(counted: DataFrame, coverage: float = 1.0) -> DataFrame:
    """counted with prob within (type, len); with coverage below 1 a structure M holds the rest."""
    share = counted.groupBy("type", "len").agg(F.sum("num").alias("total"))
    out = counted.join(F.broadcast(share), ["type", "len"]).withColumn("prob", F.col("num") / F.col("total") * F.when(F.col("type") == "S", coverage).otherwise(1.0)).drop("total")  # types times lengths
    if coverage < 1:
        rest = counted.sparkSession.createDataFrame([("S", 0, "M", 0, 1 - coverage)], "type string, len int, item string, num long, prob double")
        out = out.unionByName(rest)
    return out


def smoothed(probs: DataFrame, factor: float = 0.01) -> DataFrame:
    """Runs of nearly equal probabilities get their mean: a run goes on while p >= head * (1 - factor).

    The head resets along the sorted list, so distinct probabilities (few, they are counts) are
    folded per (type, len) in Python and joined back.
    """
    levels = probs.groupBy("type", "len", "prob").agg(F.count(F.lit(1)).alias("k"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("prob", ascending=False)
        run, head, runs = 0, None, []
        for p in pdf["prob"]:
            if head is None or p < head * (1 - factor):
                run, head = run + 1, p
            runs.append(run)
        pdf["run"] = runs
        mean = (pdf["prob"] * pdf["k"]).groupby(pdf["run"]).sum() / pdf["k"].groupby(pdf["run"]).sum()
        pdf["smooth"] = pdf["run"].map(mean)
        return pdf[["type", "len", "prob", "smooth"]]

    means = levels.groupBy("type", "len").applyInPandas(fold, "type string, len int, prob double, smooth double")
    return probs.join(means, ["type", "len", "prob"]).select("type", "len", "item", "num", F.col("smooth").alias("prob"))


def score(words: DataFrame, probs: DataFrame, word: str = "password") -> DataFrame:
    """word, prob: product over structure, terminals and masks; 0 where any part is unseen."""
    p = parsed(words.select(word).distinct(), word)
    lower = lambda s: F.when(s["type"] == "A", F.lower(s["value"])).otherwise(s["value"])
    kinds = F.transform("segs", lambda s: F.struct(s["type"].alias("type"), s["len"].alias("len"), lower(s).alias("item")))
    masks = F.transform(F.filter("segs", lambda s: s["type"] == "A"), lambda s: F.struct(F.lit("C").alias("type"), s["len"].alias("len"), cap_mask(s["value"]).alias("item")))
    whole = F.array(F.struct(F.lit("S").alias("type"), F.lit(0).alias("len"), F.col("structure").alias("item")))
    parts = p.select(word, F.explode(F.concat(kinds, masks, whole)).alias("x")).select(word, "x.*")
    hit = parts.join(probs.select("type", "len", "item", "prob"), ["type", "len", "item"], "left")
    return hit.groupBy(word).agg(F.when(F.count_if(F.col("prob").isNull()) > 0, 0.0).otherwise(F.exp(F.sum(F.log("prob")))).alias("prob"))


def _drawn(tables: dict[tuple[str, int], tuple[list[float], list[str]]], wide: set[tuple[str, int]], draws: range, seed: int):
    """A task that draws words from the tables; a slot of a wide type stays null and is asked for."""
    parts = {s: [(x[0], int(x[1:])) for x in re.findall("[A-Z][0-9]+", s)] for s in tables.get(("S", 0), ([], []))[1]}
    draws = draws if parts else range(0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for user in batch.column("user_id").to_pylist():
                for at in draws:
                    head = sha256(f"{seed}:{user}:{at}:".encode())

                    def number(key: str) -> float:
                        h = head.copy()
                        h.update(key.encode())
                        return min(int.from_bytes(h.digest()[:4], "big") / 4294967296.0, 0.999999999)

                    def item(kind: tuple[str, int], u: float) -> str:
                        lows, items_ = tables[kind]
                        return items_[max(bisect_right(lows, u) - 1, 0)]

                    values, asked = [], []
                    for slot, kind in enumerate(parts[item(("S", 0), number("s"))]):
                        mask = item(("C", kind[1]), number(f"{slot}:c")) if kind[0] == "A" else None
                        u = number(f"{slot}:t")
                        if kind in wide:
                            values.append(None)
                            asked.append({"slot": slot, "type": kind[0], "len": kind[1], "u": u, "mask": mask})
                            continue
                        value = item(kind, u)
                        values.append(value if mask is None else "".join(c.upper() if m == "U" else c for c, m in zip_longest(value, mask, fillvalue="")))
                    out.append((user, at, values, asked))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (batch.schema.field("user_id").type, *ASKED), strict=True)], names=["user_id", "draw", "values", "asked"])

    return task


def sample(users: DataFrame, probs: DataFrame, per_user: int | range, seed: int, held: int = HELD) -> DataFrame:
    """user_id, draw, word: a structure by its probability, then a terminal and a mask for each slot.

    Tasks hold the types with fewest items, `held` items in all, and the structures and masks. Of wider types the unit interval is cut
    into as many cells as there are items; an item is listed in every cell that its interval meets, and a draw looks into its own one
    by a join, so it meets two items or so whatever their number.
    """
    draws = per_user if isinstance(per_user, range) else range(per_user)
    known = probs.filter("(item <> 'M' OR type <> 'S') AND prob > 0").select("type", "len", "item", "prob", (-F.col("prob")).alias("key"))
    per = cut(known.groupBy("type", "len").agg(F.sum("prob").alias("mass"), F.count(F.lit(1)).alias("cells")))
    cdf = prefix_sums(known, ["type", "len"], ["key", "item"], "prob").join(F.broadcast(per), ["type", "len"])  # types times lengths
    high = F.col("upto") / F.col("mass")
    cdf = cut(cdf.withColumns({"low": F.greatest(high - F.col("prob") / F.col("mass"), F.lit(0.0)), "high": high}).select("type", "len", "item", "low", "high", "cells"))
    own, wide, total = [], set(), 0
    for r in sorted(per.collect(), key=lambda r: (r["type"] not in "SC", r["cells"], r["type"], r["len"])):  # types times lengths
        total += r["cells"]
        if total > held and r["type"] not in "SC":
            wide.add((r["type"], r["len"]))
        else:
            own.append(r)
    few = F.broadcast(users.sparkSession.createDataFrame([(r["type"], r["len"]) for r in own], "type string, len int"))
    tables: dict[tuple[str, int], tuple[list[float], list[str]]] = {}
    for r in cdf.join(few, ["type", "len"]).orderBy("type", "len", "low", "high").select("type", "len", "low", "item").collect():
        lows, items_ = tables.setdefault((r["type"], r["len"]), ([], []))
        lows.append(r["low"])
        items_.append(r["item"])
    kind = users.schema["user_id"].dataType.simpleString()
    rows = users.select("user_id").mapInArrow(_drawn(tables, wide, draws, seed), f"user_id {kind}, draw int, values array<string>, asked array<struct<slot:int,type:string,len:int,u:double,mask:string>>")
    if not wide:
        return rows.select("user_id", "draw", F.array_join("values", "").alias("word"))
    cell = lambda x: F.least(F.floor(x * F.col("cells")), F.col("cells") - 1)
    sizes = F.broadcast(per.select(F.col("type").alias("a_type"), F.col("len").alias("a_len"), "cells"))
    listed = cdf.join(few, ["type", "len"], "left_anti").withColumn("b", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))).select("type", "len", "b", "low", "high", "item")
    asked = rows.select("user_id", "draw", "values", F.explode_outer("asked").alias("a")).select("user_id", "draw", "values", "a.slot", F.col("a.type").alias("a_type"), F.col("a.len").alias("a_len"), "a.u", "a.mask")
    # a word that asks for nothing has a key of its own, or all of them would meet in one task
    asked = asked.join(sizes, ["a_type", "a_len"], "left").withColumns({"a_type": F.coalesce("a_type", F.lit("")), "a_len": F.coalesce("a_len", F.lit(0)), "a_b": F.coalesce(cell(F.col("u")), F.xxhash64("user_id", "draw"))}).drop("cells")
    met = asked.join(listed, (F.col("a_type") == F.col("type")) & (F.col("a_len") == F.col("len")) & (F.col("a_b") == F.col("b")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")), "left")
    value = F.when(F.col("mask").isNull(), F.col("item")).otherwise(apply_mask(F.col("item"), F.col("mask")))
    found = spread(met.select("user_id", "draw", "values", F.struct("slot", value.alias("value")).alias("x")), "user_id").groupBy("user_id", "draw", "values").agg(F.map_from_entries(F.filter(F.collect_list("x"), lambda x: x["slot"].isNotNull())).alias("found"))
    whole = F.transform("values", lambda v, i: F.coalesce(v, F.try_element_at("found", i), F.lit("")))
    return found.select("user_id", "draw", F.array_join(whole, "").alias("word"))
