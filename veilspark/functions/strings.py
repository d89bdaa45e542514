"""Scalar functions on passwords: character filters, tokens, patterns, policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = "([a-zA-Z]+|[0-9]+|[^a-zA-Z0-9]+)"


def is_ascii(pw: Column) -> Column:
    return pw.rlike(r"^[\x00-\x7F]*$")


def strip_non_ascii(pw: Column) -> Column:
    return F.regexp_replace(pw, r"[^\x00-\x7F]", "")


def breach_line(pw: Column) -> Column:
    """8 to 32 printable ASCII characters."""
    return F.length(pw).between(8, 32) & pw.rlike(r"^[\x21-\x7E]+$")


def training_valid(pw: Column) -> Column:
    """Not empty, no tab, no mail or web address ending."""
    return (pw != "") & ~pw.contains("\t") & ~pw.rlike(r"\.(com|org|edu|gov|mil)")


def tokens(pw: Column) -> Column:
    """Runs of letters, digits and specials as structs (kind A, D or S, value); ASCII rows."""
    kind = lambda v: F.when(v.rlike("^[a-zA-Z]"), "A").when(v.rlike("^[0-9]"), "D").otherwise("S")
    return F.transform(F.regexp_extract_all(pw, F.lit(TOKENS), F.lit(1)), lambda v: F.struct(kind(v).alias("kind"), v.alias("value")))


def pattern(pw: Column) -> Column:
    """Kinds of the runs, specials with their length: shadow_77x is AS1DA."""
    part = lambda t: F.when(t["kind"] == "S", F.concat(F.lit("S"), F.length(t["value"]).cast("string"))).otherwise(t["kind"])
    return F.array_join(F.transform(tokens(pw), part), "")


def parse_pattern(p: Column) -> Column:
    """Parts of a pattern as structs (kind, len); len is null for A and D."""
    parts = F.regexp_extract_all(p, F.lit("(A|D|S[0-9]*)"), F.lit(1))
    number = lambda x: F.when(F.length(x) > 1, F.substring(x, 2, 9).cast("int"))
    return F.transform(parts, lambda x: F.struct(F.substring(x, 1, 1).alias("kind"), number(x).alias("len")))


def shape(p: Column) -> Column:
    """A pattern without lengths."""
    return F.regexp_replace(p, "[0-9]", "")


def policy_violation(username: Column, pw: Column) -> Column:
    """The first rule that a password breaks: length, class or substring; null if none.

    Every user name substring of three or more letters holds one of exactly three.
    """
    grams = F.when(F.length(username) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(username) - 2, F.lit(1))), lambda i: F.substr(F.lower(username), i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    named = F.exists(grams, lambda g: F.contains(F.lower(pw), g))
    classes = pw.rlike("[a-zA-Z]") & pw.rlike("[0-9]") & pw.rlike("[^a-zA-Z0-9]")
    return F.when(F.length(pw) < 8, "length").when(~classes, "class").when(named, "substring")


def cap_mask(pw: Column) -> Column:
    """L for lower-case letters, U for the rest."""
    return F.regexp_replace(F.regexp_replace(pw, "[^a-z]", "U"), "[a-z]", "L")


def apply_mask(word: Column, mask: Column) -> Column:
    pairs = F.zip_with(F.split(word, ""), F.split(mask, ""), lambda c, m: F.when(m == "U", F.upper(c)).otherwise(c))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "")


def decoy_accepted(decoy: Column, real: Column, min_distance: int = 3, max_growth: int = 3) -> Column:
    """Not empty, not the real word, of similar length and far enough by edits."""
    return (decoy != "") & (decoy != real) & (F.abs(F.length(decoy) - F.length(real)) <= max_growth) & (F.levenshtein(decoy, real) >= min_distance)


def shared_tokens(a: Column, b: Column) -> Column:
    low = lambda x: F.transform(tokens(x), lambda t: F.lower(t["value"]))
    return F.size(F.array_intersect(low(a), low(b)))


def parse_numbered_reply(reply: Column, real: Column, most: int = 19) -> Column:
    """Decoys of a numbered text reply: first word of each numbered line, without the real one."""
    lines = F.filter(F.split(reply, "\n"), lambda x: x.rlike(r"^\s*[0-9]+[.)]"))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*[0-9]+[.)]\s*", "")))
    good = F.filter(bare, lambda x: ~x.contains(":") & x.rlike("[A-Za-z0-9]"))
    return F.slice(F.filter(F.transform(good, lambda x: F.split(x, r"\s+")[0]), lambda x: x != real), 1, most)


def chunk_prompt(chunks: Column) -> Column:
    """Chunks as text for a prompt."""
    return F.concat_ws("', '", chunks)


def profile_tokens(*fields: Column) -> Column:
    """Distinct lower-case words of two letters or more, digits and specials of a profile's fields."""
    text = F.concat_ws(" ", *fields)
    return F.struct(
        F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]{2,})"), F.lit(1)), F.lower)).alias("alpha"),
        F.array_distinct(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))).alias("digit"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"([^A-Za-z0-9\s]+)"), F.lit(1))).alias("special"),
    )


def structure_parts(structure: Column) -> Column:
    """A4D2 as structs (type, len)."""
    whole = F.regexp_extract_all(structure, F.lit("([A-Z][0-9]+)"), F.lit(1))
    return F.transform(whole, lambda x: F.struct(F.substring(x, 1, 1).alias("type"), F.substring(x, 2, 9).cast("int").alias("len")))
