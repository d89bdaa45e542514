"""Readers of the file layouts."""

import pytest

from veilspark.operators import freqdb
from veilspark.sources import files


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def col(df, name="password"):
    return sorted(r[name] for r in df.collect())


def test_lists_of_passwords(spark, tmp_path):
    p = write(tmp_path / "a.txt", "  one \n\n# two\nthree\t\n")
    assert col(files.passwords(spark, p)) == ["# two", "one", "three"]
    assert col(files.corpus_lines(spark, p)) == ["  one ", "three\t"]
    assert files.passwords(spark, p, 1).count() == 1


def test_counts(spark, tmp_path):
    a, b = write(tmp_path / "a", "x:y:3\nbad\nz:0\nq:x\n"), write(tmp_path / "b", "x:y:4\n:5\n")
    assert {r["password"]: r["cnt"] for r in files.counts(spark, [a, b]).collect()} == {"x:y": 7, "": 5}
    assert [tuple(r) for r in files.raw_counts(spark, write(tmp_path / "c", "  12 pass word\n")).collect()] == [("pass word", 12)]
    assert [tuple(r) for r in files.aggregated(spark, write(tmp_path / "d", "pw\t9\n")).collect()] == [("pw", 9)]


def test_dump_and_hash_lines(spark, tmp_path):
    (tmp_path / "n" / "m").mkdir(parents=True)
    write(tmp_path / "n" / "m" / "x", "u:a:secret\nnone\n")
    assert col(files.dump_folder(spark, str(tmp_path / "n"))) == ["secret"]
    p = write(tmp_path / "pot", "# c\n$HEX$abc:p:w\n")
    assert col(files.hash_lines(spark, p)) == ["p:w"]
    assert files.has_hash_lines(spark, p)


def test_wide_lists(spark, tmp_path):
    p = write(tmp_path / "w.csv", "real,1.,d1,2.,d2,3.\n")
    r = files.wide_lists(spark, p, True).first()
    assert (r["real"], r["decoys"]) == ("real", ["d1", "d2"])
    assert files.wide_lists(spark, write(tmp_path / "v.csv", "real,d1,,d2\n"), False).first()["decoys"] == ["d1", "d2"]


def test_frequencies_and_results(spark, tmp_path):
    f = freqdb.token_counts(spark.createDataFrame([("ab#1",), ("ab!2",)], "password string"))
    files.write_frequencies(f, str(tmp_path / "f"))
    assert sorted(map(tuple, files.read_frequencies(spark, str(tmp_path / "f")).collect())) == sorted(map(tuple, f.collect()))
    write(tmp_path / "r1.json", '{"epsilon_flatness": 0.5, "attack_success_rate": 0.1, "success_number": {"fail": [0, 1], "succ": [0, 1]}}')
    write(tmp_path / "r2.json", '{"label": "x", "k": 20, "epsilon": 0.25, "success_curve": [[0, 0], [1, 2]], "n_users": 3}')
    got = sorted((r["epsilon"], r["curve"]) for r in files.read_results(spark, str(tmp_path / "r*.json")).collect())
    assert got == [(0.25, [[0.0, 0.0], [1.0, 2.0]]), (0.5, [[0.0, 0.0], [1.0, 1.0]])]
    s = write(tmp_path / "s.txt", "first\n[1, 2, 3]\nsecond\n4 5\n")
    assert sorted((r["attacker"], r["x"], r["y"]) for r in files.legacy_statistics(spark, s).collect()) == [("first", 0, 1.0), ("first", 1, 2.0), ("first", 2, 3.0), ("second", 0, 4.0), ("second", 1, 5.0)]


def test_strict_counts(spark, tmp_path):
    p = write(tmp_path / "c.txt", "a:3\n\nb: 4 \na:-2\n")
    assert {r["password"]: r["cnt"] for r in files.counts(spark, p, strict=True).collect()} == {"a": 3, "b": 4}
    with pytest.raises(Exception, match="no count in line"):
        files.counts(spark, write(tmp_path / "d.txt", "a:3\nbad\n"), strict=True).collect()


def test_lists_of_any_length(spark, tmp_path):
    p = write(tmp_path / "w.csv", "real," + ",".join(f"d{i}" for i in range(12_000)) + ",nan,real\n")
    assert files.wide_lists(spark, p, False).first()["decoys"] == [f"d{i}" for i in range(12_000)]


def test_the_whole_campaign_comes_first(spark, tmp_path):
    write(tmp_path / "a1.json", '{"success_number": {"fail": [1], "succ": [2]}, "attack_stats": {"fail": [7], "succ": [8]}}')
    write(tmp_path / "a2.json", '{"attack_stats": {"fail": [7], "succ": [8]}}')
    assert sorted(r["curve"] for r in files.read_results(spark, str(tmp_path / "a*.json")).collect()) == [[[1.0, 2.0]], [[7.0, 8.0]]]


def test_train_and_test(spark, tmp_path):
    plain, csv = write(tmp_path / "p.txt", "one\n\ntwo\n"), write(tmp_path / "t.csv", "password,first_name,last_name,email,birthday,username\npw,a,b,c,01021990,u\n")
    test, train = files.train_and_test(spark, csv, targeted=True)
    assert test.first()["birthday"] == "01021990" and train is None
    test, train = files.train_and_test(spark, plain, plain)
    assert test.count() == train.count() == 2


def test_ruleset(spark, small, tmp_path):
    from veilspark.operators import pcfg as P
    from veilspark.plans import domain

    probs = P.probabilities(P.items(P.parsed(domain.passwords(spark, small))), 0.6).select("type", "len", "item", "prob")
    path = str(tmp_path / "rules")
    files.write_ruleset(probs, path)
    files.write_ruleset(probs, path)  # again, over the first
    own = sorted(map(tuple, probs.collect()))
    assert sorted(map(tuple, files.read_ruleset(spark, path).collect())) == own
    assert (tmp_path / "rules/Grammar/Grammar.txt").read_text().splitlines()[0].split("\t")[1] == str(max(r[3] for r in own if r[0] == "S"))
    groups = files.read_ruleset(spark, path, grouped=True).collect()
    assert sorted((r["type"], r["len"], v, r["prob"]) for r in groups for v in r["values"]) == own
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert files.read_ruleset(spark, path).count() == len(own)
        digits = sorted((tmp_path / "rules/Digits").glob("*.txt"))[0]
        lines = digits.read_text().splitlines()
        (tmp_path / "rules/Digits/.x").unlink(missing_ok=True)
        digits.write_text("\n".join([*lines, "x\t0.9999"]) + "\n")
        for x in (tmp_path / "rules/Digits").glob(".*.crc"):
            x.unlink()
        with pytest.raises(ValueError, match="don't fall"):
            files.read_ruleset(spark, path)
        digits.write_text("no probability\n")
        with pytest.raises(Exception, match="no value and probability"):
            files.read_ruleset(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_encodings(spark, tmp_path):
    from veilspark.sources import encodings

    text = "Grüße aus Köln\nplain\nniño – “x”\n" * 50
    latin = "Grüße\nplain\nniño\n" * 50
    cases = {
        "a.txt": (b"only plain\nlines\n" * 9, "ascii"), "u.txt": (text.encode(), "utf-8"), "s.txt": (text.encode("utf-8-sig"), "utf-8"), "l.txt": (latin.encode("latin-1"), "latin-1"), "w.txt": (text.encode("cp1252"), "windows-1252"),
        "le.txt": (latin.encode("utf-16-le"), "utf-16-le"), "be.txt": (latin.encode("utf-16-be"), "utf-16-be"), "bom.txt": (latin.encode("utf-16"), "utf-16"), "broken.txt": (text.encode() + b"\xff\xfe bad\n", "utf-8"), "none.txt": (b"\x81\x8d x\n\xff\x90\n" * 20, None),
    }
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = {r["file"].rsplit("/", 1)[-1]: r for r in encodings.detect(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: r["encoding"] for k, r in got.items()} == {k: e for k, (_, e) in cases.items()}
    assert 0.9 < got["broken.txt"]["confidence"] < 1 == got["u.txt"]["confidence"] and got["none.txt"]["confidence"] == 0
