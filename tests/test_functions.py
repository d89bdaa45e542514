"""Worked examples of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import bloom, pii, segment
from veilspark.functions import strings as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("pw", "runs", "pattern"), [("shadow_77x", ["shadow", "_", "77", "x"], "AS1DA"), ("pass@2023!", ["pass", "@", "2023", "!"], "AS1DS1"), ("Hi!There9", ["Hi", "!", "There", "9"], "AS1AD"), ("a!!1", ["a", "!!", "1"], "AS2D")])
def test_tokens_and_pattern(spark, pw, runs, pattern):
    t = one(spark, S.tokens(F.col("p")), p=pw)
    assert [x["value"] for x in t] == runs
    assert one(spark, S.pattern(F.col("p")), p=pw) == pattern
    assert [(x["kind"], x["len"]) for x in one(spark, S.parse_pattern(F.lit("AS12D")), p=pw)] == [("A", None), ("S", 12), ("D", None)]


@pytest.mark.parametrize(("pw", "reason"), [("shadow_77x", None), ("short1!", "length"), ("alicepass1!", "substring"), ("allletters!!!", "class")])
def test_policy(spark, pw, reason):
    assert one(spark, S.policy_violation(F.lit("alice"), F.col("p")), p=pw) == reason
    assert one(spark, S.policy_violation(F.lit("al"), F.lit("alicepass1!")), p=pw) is None


def test_levenshtein(spark):
    assert one(spark, F.levenshtein("a", "b"), a="password1!", b="password1@") == 1
    assert one(spark, F.levenshtein("a", "b"), a="shadow_77x", b="dragon88!") == 8


@pytest.mark.parametrize(
    ("pw", "want"),
    [
        ("test1qaztest", [("test", "A"), ("1qaz", "K"), ("test", "A")]),
        ("test#1test", [("test", "A"), ("#1", "X"), ("test", "A")]),
        ("test123test", [("test", "A"), ("123", "D"), ("test", "A")]),
        ("pass12", [("pass", "A"), ("12", "D")]),
        ("!!?", [("!!?", "O")]),
        ("", []),
    ],
)
def test_segments(pw, want):
    assert segment.segments(pw) == want


def test_runs_that_are_words_stay_letters():
    assert segment.segments("deer43") == [("deer", "A"), ("43", "D")]
    assert not segment.adjacent("a", "é")


def test_masks(spark):
    assert one(spark, S.cap_mask(F.col("p")), p="PaSs") == "ULUL"
    assert one(spark, S.apply_mask(F.lit("pass"), F.col("m")), m="ULUL") == "PaSs"


def test_numbered_reply(spark):
    reply = "Here:\n1. alpha1 x\n2) real!\n3. be:ta\n4. gamma_2\n5. ---"
    assert one(spark, S.parse_numbered_reply(F.col("r"), F.lit("real!")), r=reply) == ["alpha1", "gamma_2"]


def test_salted_hash_and_indices(spark):
    import hashlib

    h = hashlib.sha256(b"saltpw").hexdigest()
    assert one(spark, bloom.salted_hash(F.encode(F.lit("salt"), "utf-8"), F.col("p")), p="pw") == h
    for b in (128, 100):
        want = sorted({int(hashlib.sha256(f"{i}:{h}".encode()).hexdigest(), 16) % b + 1 for i in range(20)})
        assert one(spark, bloom.indices(F.col("h"), 20, b), h=h) == want


def test_tags(spark):
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(v).alias("value")) for t, v in (("N4", "anna"), ("N1", "annasmith"), ("B5", "1990"), ("X", "a"))])
    seg = pii.tagged(F.col("p"), tags)
    assert one(spark, seg, p="xannasmith1990!") == ["x", "<N1>", "<B5>", "!"]
    assert one(spark, seg, p="bob") == ["bob"]
    assert one(spark, pii.substituted(seg, tags), p="xanna!") == "xanna!"
