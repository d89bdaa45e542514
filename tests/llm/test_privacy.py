"""Personal data: base spans by plain regular expressions, added ones on planted texts."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import privacy, queries

from .common import ODD, documents, frame

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = [int(c) for c in s if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def base_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if passes(k, m[0])]


def test_base_spans(spark, small):
    rnd = random.Random(4)
    bits = ["a", "b.c", "@", ".", "-", "@x.org", " ", "+", "1", "23", "4111 1111-1111 1111", "255", ".256", "1.2.3.4", "(0", ") ", "+49 30 1234567", "é", "٣", "_", "%", "00"]
    rows = documents(spark, small) + ODD + [(50000 + i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))) for i in range(600)]
    docs = frame(spark, rows)
    got = privacy.digests(privacy.scan(docs, privacy.fit(docs))).collect()
    want = Counter()
    for i, t in rows:
        s = base_spans(t or "")
        want[i, *(sum(x.startswith(k + ":") for x in s) for k in BASE), hashlib.sha256(",".join(s).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert spans == sorted(spans, key=lambda x: (privacy.KINDS.index(x[0]), int(x[1])))
        if sum(i == r["doc_id"] for i, _ in rows) == 1:
            assert [":".join(x) for x in spans if x[0] in BASE] == base_spans(dict(rows)[r["doc_id"]] or "")
    assert all(r["spans"] == "" for r in got if not re.search("[0-9@]", dict(rows).get(r["doc_id"]) or ""))


def test_added_spans(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(600):
        left, right = (" ".join(word() for _ in range(8)) for _ in range(2))
        kind = i % 10
        digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))  # noqa: E731, B023
        mid = [
            f"mail {word()}@{word()}.com", f"contact {word()} (at) {word()} (dot) org", f"call (31{rnd.randrange(10)}) 555-{digits(4)}", f"ssn 5{rnd.randrange(10, 99)}-4{rnd.randrange(1, 9)}-{rnd.randrange(1000, 9999)}",
            f"+1 (415) 555-{digits(4)}", f"version 20{digits(7)}", f"build/{digits(9)}/x", "plain words only", "host 10.0.0.7", f"order 1234567{digits(4)}a",
        ][kind]
        rows.append((i, f"{left} {mid} {right}"))
        want[i] = {0: "email", 1: "masked_email", 2: "local_phone", 3: "id_number", 4: "phone", 8: "ip"}.get(kind)
    docs = frame(spark, rows)
    model = privacy.fit(docs)
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in privacy.scan(docs, model).collect()}
    good = sum(found[i] == [k] if k else not found[i] for i, k in want.items())
    assert good >= 0.98 * len(rows)
    again = privacy.fit(docs.repartition(7))
    assert np.array_equal(model.weight, again.weight)


def test_reliabilities_are_found():
    rnd = np.random.default_rng(2)
    n, right, asked = 20_000, [0.95, 0.8, 0.7, 0.6, 0.85, 0.5], [1, 0.9, 0.6, 0.8, 0.3, 1]
    truth = rnd.random(n) < 0.4
    votes = np.stack([np.where(rnd.random(n) < a, np.where(rnd.random(n) < p, 1, -1) * np.where(truth, 1, -1), 0) for p, a in zip(right, asked, strict=True)], axis=1)
    post, reliability, prior = privacy.agree(np.zeros(n, np.int64), votes, np.ones(n))
    assert ((post > 0.5) == truth).mean() > 0.95
    assert abs(prior[0] - 0.4) < 0.05
    for j, (p, a) in enumerate(zip(right, asked, strict=True)):
        assert abs(reliability[j, 1, 2] - p * a) < 0.05


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "only words"), (2, None), (3, "")])
    assert [tuple(r) for r in privacy.scan(docs, privacy.fit(docs)).orderBy("doc_id").collect()] == [(1, []), (2, []), (3, [])]
    none = frame(spark, [])
    assert privacy.scan(none, privacy.fit(none)).count() == 0


@pytest.mark.parametrize("text", ["1" * 10**6, "a@" * 500_000, "a" * 10**6 + "@", "+1 " * 300_000, "1.1." * 250_000, "12-" * 300_000, "a@b.c " * 150_000, "4111111111111111 +49 30 1234567 " * 30_000, "+1" + " " * 10**6, "Mr Abc 555-12-3456 " * 40_000], ids=range(10))
def test_long_texts(text):
    began = time.time()
    found = privacy.spans_of(privacy.candidates(text, True, True, True), privacy.Model(np.zeros(privacy.BUCKETS), np.zeros(0), np.zeros(0)), 0.4)
    assert time.time() - began < 60
    if not text.startswith(("1" * 9, "12-", "aa", "1.1.")):  # the plain expressions are quadratic there
        assert [f"{privacy.KINDS[k]}:{a}:{b}" for k, a, b, _, own in found if own] == base_spans(text)


def test_registered(spark, small):
    got = queries.QUERIES["op13_personal_data"](spark, small)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
