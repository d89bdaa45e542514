"""Secrets, licenses, decontamination and toxicity."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.llm import decontam, licenses, queries, secretscan, toxicity
from veilspark.llm.automaton import compile_all

from .common import ODD, documents, frame

BASE = (
    re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile(r"AKIA[A-Z0-9]+"),
    re.compile(r"[0-9a-f]+"),
)
LEAST = (6, 20, 24)


def base_spans(t):
    found = sorted((m.start(), k, m.end()) for k, p in enumerate(BASE) for m in p.finditer(t) if len(m[m.lastindex or 0]) >= LEAST[k])
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found]


def test_secrets(spark, small):
    rnd = random.Random(1)
    bits = ["password", "PassWd", "api_key", "apikey", "=", ":", " ", '"', "'", "token", "a", "0123456789abcdef01234567", "AKIA", "ABCDEFGH12345678", "é", "\n", "xyz123", "-", ".", "ghp_" + "a1" * 20, "secret", " = "]
    rows = documents(spark, small) + ODD + [(30000 + i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(30)))) for i in range(400)]
    got = secretscan.scan(frame(spark, rows)).collect()
    want = Counter()
    for i, t in rows:
        s = base_spans(t or "")
        want[i, *(sum(x.startswith(k) for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(s).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert any("code_host:" in r["spans"] for r in got)
    added = [(r.kind, re.compile(r.pattern), r.least) for r in secretscan.ADDED]
    for r in got:
        own = [f"{k}:{m.start()}:{m.end()}" for k, p, n in added for t in [dict(rows)[r["doc_id"]] or ""] for m in p.finditer(t) if m.end() - m.start() >= n]
        if sum(i == r["doc_id"] for i, _ in rows) == 1:
            assert sorted(x for x in r["spans"].split(",") if x and x.split(":")[0] not in ("assign", "access", "hex")) == sorted(own)
    assert secretscan.scan(frame(spark, [])).count() == 0


def scanned(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return secretscan.scan_texts(data, np.array([0, len(data)]), (*secretscan.BASE, *secretscan.ADDED), secretscan.compiled((*secretscan.BASE, *secretscan.ADDED)))[0]


@pytest.mark.parametrize("text", ["eyJ" * 350_000, "a" * 10**6, "eyJ" * 300_000 + ".eyJa.b", "Z" * 10**6, "AKIA" * 250_000, "token=" * 160_000, "0123456789abcdefg" * 60_000], ids=range(7))
def test_secrets_in_a_megabyte_without_white_space(text):
    import time

    scanned("a")
    began = time.time()
    got = scanned(text)
    assert time.time() - began < 30
    base = [(m.start(), k, m.end()) for k, p in enumerate(BASE) for m in p.finditer(text) if len(m[m.lastindex or 0]) >= LEAST[k]]
    assert [x for x in got if x[1] < 3] == sorted(base)
    assert (len(got) > len(base)) == (".eyJ" in text)


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[a-c]{2,3}x?", "(ab|a)(c|bcd)", "[^a]b+", r"\x61\.b", "a{0,2}b"])
def test_automaton_matches_like_re(pattern):
    rnd = random.Random(2)
    m = compile_all([(pattern, False)], False)
    whole = re.compile(pattern.encode())
    for _ in range(400):
        t = "".join(rnd.choice("abcdx.") for _ in range(rnd.randrange(8))).encode()
        state = 0
        for b in t:
            state = int(m.move[state * 256 + b])
        assert bool(m.accepts[state]) == bool(whole.fullmatch(t))


def test_automaton_is_minimal():
    assert compile_all([("ab|ab", False)], False).states == compile_all([("ab", False)], False).states == 4


def test_licenses_base_is_sql(spark, small, duck):
    got = sorted((tuple(r)[:6] for r in licenses.scan(spark.read.parquet(f"{small}/documents.parquet")).collect()), key=str)
    assert got == sorted(duck.sql(licenses.SQL).fetchall(), key=str)


def test_licenses_cases(spark):
    rows = [*ODD, (1, "Licensed under the Apache License, Version 2.0"), (2, "MIT-License CC BY, cc by"), (3, "released under the very MIT license"), (4, "mitlicense gnu general public"), (5, "...mit license")]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["labels"]) == (1, 3, "apache,apache-2.0")
    assert (got[2]["n_base"], got[2]["base_labels"], got[2]["first_word"], got[2]["last_word"]) == (3, "cc-by,mit", 0, 4)
    assert got[3]["n_base"] == 1 and got[3]["labels"] == "mit"
    assert got[4]["n_base"] == 0 and got[4]["first_word"] is None and got[4]["base_labels"] == ""
    assert (got[5]["n_words"], got[5]["first_word"]) == (2, 0)
    assert got[9001]["n_words"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert licenses.scan(frame(spark, [])).count() == 0


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]


def leaks(docs, items):
    """Pairs with an item-sized window of similarity 0.75 or more."""
    out = set()
    for item, text in items:
        w = words(text)
        if not w:
            continue
        g = min(5, len(w))
        bag = Counter(tuple(w[i : i + g]) for i in range(len(w) - g + 1))
        m = sum(bag.values())
        for doc, t in docs:
            d = words(t)
            sh = [tuple(d[i : i + g]) for i in range(len(d) - g + 1)]
            for s in range(len(sh) - m + 1):
                c = sum((Counter(sh[s : s + m]) & bag).values())
                if c / (2 * m - c) >= 0.75:
                    out.add((doc, item))
                    break
    return out


def test_decontamination_is_every_window(spark):
    rnd = random.Random(8)
    vocabulary = [f"t{i}" for i in range(500)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice((18, 30, 31, 50)))) for i in range(25)] + [(90, "just three words"), (91, ""), (92, None), (93, "rep " * 20)]
    docs = [(i, text(rnd.randrange(5, 200))) for i in range(40)]
    for i, (_, t) in enumerate(items[:25]):
        w = t.split()
        whole, dropped, changed, half = t, " ".join(w[:9] + w[10:]), " ".join([*w[:4], "zz", *w[5:]]), " ".join(w[: len(w) // 2])
        docs += [(100 + 4 * i + j, f"{text(rnd.randrange(9))} {x.upper() if j == 0 else x}. {text(rnd.randrange(9))}") for j, x in enumerate((whole, dropped, changed, half))]
    docs += [(500, "Just, three words!"), (501, "rep " * 25), *ODD]
    got = decontam.find(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    want = leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 40
    kept = decontam.clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, _ in docs} - {d for d, _ in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(frame(spark, docs), none).count() == 0 and decontam.clean(frame(spark, docs), none).count() == len(docs)
    assert decontam.find(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def cut_leaks(docs, items):
    """`leaks`, and the pairs of which the document as a whole has fewer shingles than the item."""
    out = leaks(docs, items)
    for item, text in items:
        w = words(text)
        g = min(5, len(w))
        bag = Counter(tuple(w[i : i + g]) for i in range(len(w) - g + 1)) if w else Counter()
        for doc, t in docs:
            d = words(t)
            own = Counter(tuple(d[i : i + g]) for i in range(len(d) - g + 1)) if w else Counter()
            if 0 < own.total() < bag.total():
                c = (own & bag).total()
                if c / (own.total() + bag.total() - c) >= 0.75:
                    out.add((doc, item))
    return out


def test_decontamination_meets_cut_off_copies(spark):
    rnd = random.Random(12)
    text = lambda n: " ".join(f"t{rnd.randrange(500)}" for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((40, 15, 16, 23, 31, 59, 50))] + [(90, "rep " * 20), (91, "five words are an item"), (92, "a few words"), (93, "")]
    docs = []
    for i, t in items:
        w = t.split()
        for cut in range(len(w) // 2):
            for j, x in enumerate((w[: len(w) - cut], w[cut:], w[cut // 2 : len(w) - (cut - cut // 2)])):
                ends = (("", ""), ("", "."), ("(", ""), ("...", "!"))[rnd.randrange(4)]
                docs.append((10000 * (i + 1) + 10 * cut + j, ends[0] + " ".join(x) + ends[1]))
    docs += [(5, " ".join(items[0][1].split()[:38])), (6, " ".join(items[0][1].split()[:38]) + "."), *ODD]
    frames = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find(*frames).collect()}
    want = cut_leaks(docs, items)
    assert set(got) == want and {(5, 0), (6, 0)} <= want - leaks(docs, items)
    assert [(r["start"], r["n_words"], round(r["similarity"], 6)) for r in (got[5, 0], got[6, 0])] == [(0, 38, round(34 / 36, 6))] * 2
    assert {r["doc_id"] for r in decontam.clean(*frames).select("doc_id").collect()} == {i for i, _ in docs} - {d for d, _ in want}


def test_long_texts(spark):
    rnd = random.Random(3)
    item = " ".join(f"t{i}" for i in range(40))
    filler = lambda n: " ".join(rnd.choice(("of", "the", "license", "to", "x")) + f" q{rnd.randrange(1000)}" for _ in range(n))
    long = " ".join([filler(60_000), item, "the " * 30_000, filler(60_000), "released under the mit license"])
    dense = " ".join([item] * 400)
    docs = frame(spark, [(1, long), (1, "clean row of the same id"), (2, dense), (None, item), (None, "clean")])
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find(docs, items).collect()}
    assert got == {(1, 7): 1.0, (2, 7): 1.0, (None, 7): 1.0}
    assert sorted(r["text"] for r in decontam.clean(docs, items).collect()) == ["clean", "clean row of the same id"]
    # more shingles than a 16-bit counter holds
    bag = lambda n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), (i % 3).cast("string")))
    few, many, narrow = spark.range(1).select(decontam._simhash(bag(30)), decontam._simhash(bag(90_000)), decontam._counted(bag(30), 2)).first()
    assert few == many == narrow
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect() if r["n_words"] > 100}
    assert found[1]["base_labels"] == "mit" and found[1]["n_base"] == 1 and found[2]["n_base"] == 0


def test_decontamination_at_the_threshold(spark):
    # 6 of 7 shingles shared: a similarity of exactly 0.75, where fingerprints lie farthest apart
    rnd = random.Random(21)
    items = [(i, " ".join(f"t{rnd.randrange(10**6)}" for _ in range(11))) for i in range(1200)]
    docs = [(i, "zz " + t.split(" ", 1)[1]) for i, t in items]
    got = decontam.find(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i, _ in items}


def test_toxicity_on_held_out(spark, small):
    import os

    folder = small.replace("sf0.001", "sf0.1") if os.path.exists(small.replace("sf0.001", "sf0.1")) else small
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "score")
    rows = scored.join(labels, "doc_id").filter(toxicity.held_out(labels["doc_id"])).select("score", "toxic").collect()
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows) / len(rows)
    assert right > 0.93


def test_toxicity_cases(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["sun", "tree", "lake", "bird", "stone"]) for _ in range(6)) + "."
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        parts = [good() for _ in range(5)]
        if bad:
            parts[rnd.randrange(5)] = "You grobian and snarfling."
        rows.append((i, " ".join(parts)))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark, rows), lab)
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, rows + ODD), model).collect()}
    assert all((got[i]["score"] >= 0.5) == (i % 3 == 0) for i in range(300))
    s = got[0]["sentences"][0]
    assert b"grobian" in bytes(got[0]["text"])[s["start"] : s["end"]] and len(got[0]["sentences"]) == 1
    assert got[9001]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.reject(frame(spark, rows), model)
    assert kept.count() == 200 and kept.columns == frame(spark, []).columns
    assert toxicity.fit(frame(spark, rows), lab.filter("toxic = 0")) is None
    assert toxicity.score(frame(spark, []), model).count() == 0
    assert np.isfinite(model.bias)


def test_toxicity_is_a_plain_noisy_or(spark):
    import math

    rnd = np.random.default_rng(4)
    model = toxicity.Model(rnd.normal(0, 0.5, toxicity.BUCKETS), -2.0)
    rows = [(1, "One two. Three four five! six"), (2, "same words same words\nagain"), (3, "?!.."), (4, "Ünïcode wörds, 12 of them"), *ODD]
    got = sorted((str(r["doc_id"]), round(r["score"], 9), len(r["sentences"])) for r in toxicity.score(frame(spark, rows), model).collect())

    def plain(text):
        miss, bad = 1.0, 0
        for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
            found = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(toxicity.LOWER[np.frombuffer(sentence, np.uint8)]))
            if not found:
                continue
            z = model.bias
            for w in found:
                raw = np.frombuffer(w, np.uint8)
                bucket, *_ = toxicity.instances(raw, np.array([0, len(raw)]))
                z += sum(model.weight[b] for b in bucket)
            miss *= 1 - 1 / (1 + math.exp(-z))
            bad += z >= 0
        return round(1 - miss, 9), bad

    assert got == sorted((str(i), *plain(t)) for i, t in rows)


def test_queries_run(spark, small):
    for name in ("op4_decontamination", "op5_toxicity", "op7_secrets", "op9_licenses"):
        assert "doc_id" in queries.QUERIES[name](spark, small).columns
