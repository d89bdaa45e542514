"""Grammar segments of a password: keyboard runs (K), context items (X), digits (D), letters (A), others (O).

A pandas UDF: the segmentation walks characters with state, which built-in functions can't express.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: keyboard rows, plain and shifted; context items; words that only look like runs
ROWS = ("1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("!@#$%^&*()_+", "QWERTYUIOP{}|", 'ASDFGHJKL:"', "ZXCVBNM<>?")
CONTEXT = ("<3", ";p", ":p", "*0*", "#1")
LOOKALIKES = ("deer", "drew", "kiki", "tree", "pollo", "pool", "poop", "look", "fred", "loop", "were")
SHORTEST_RUN = 4

KEYS = {c: (r, i) for rows in (ROWS, SHIFTED) for r, row in enumerate(rows) for i, c in enumerate(row)}
#: Column steps that count as neighbours, by the step between rows.
STEPS = {0: (-1, 0, 1), 1: (-1, 0), -1: (0, 1)}
ITEM = re.compile("|".join(map(re.escape, sorted(CONTEXT, key=len, reverse=True))))


def adjacent(a: str, b: str) -> bool:
    if a not in KEYS or b not in KEYS:
        return False
    (r, i), (s, j) = KEYS[a], KEYS[b]
    return j - i in STEPS.get(s - r, ())


def worth_keeping(run: str) -> bool:
    """A run of mixed character classes that isn't part of a common word."""
    low = run.lower()
    if len(run) < 3 or run[:2] == "er" or run[1:3] == "er" or run[:3] == "tty" or any(w in low for w in LOOKALIKES):
        return False
    return len({"a" if c.isalpha() else "d" if c.isdigit() else "s" for c in run}) > 1


def keyboard(text: str) -> list[tuple[str, str]]:
    """(text, kind) with kind K for runs and empty for the rest."""
    runs, begin = [], 0
    for i in range(1, len(text) + 1):
        if i == len(text) or not adjacent(text[i - 1], text[i]):
            if i - begin >= SHORTEST_RUN and worth_keeping(text[begin:i]):
                runs.append((begin, i))
            begin = i
    out, at = [], 0
    for a, b in runs:
        out += [(text[at:a], ""), (text[a:b], "K")]
        at = b
    return [x for x in [*out, (text[at:], "")] if x[0]]


def _split(parts: list[tuple[str, str]], pattern: re.Pattern, kind: str) -> list[tuple[str, str]]:
    out = []
    for text, known in parts:
        if known:
            out.append((text, known))
            continue
        at = 0
        for m in pattern.finditer(text):
            out += [(text[at : m.start()], ""), (m[0], kind)]
            at = m.end()
        out.append((text[at:], ""))
    return [x for x in out if x[0]]


def segments(pw: str) -> list[tuple[str, str]]:
    parts = _split(keyboard(pw), ITEM, "X")
    parts = _split(parts, re.compile(r"\d+"), "D")
    parts = _split(parts, re.compile(r"[^\W\d_]+"), "A")
    return [(t, k or "O") for t, k in parts]


def _segment(pw: pd.Series) -> pd.Series:
    return pw.map(lambda x: [{"type": k, "len": len(t), "value": t} for t, k in segments(x or "")])


def segment(pw: Column) -> Column:
    """Array of (type, len, value)."""
    return F.pandas_udf(_segment, "array<struct<type:string,len:int,value:string>>")(pw)


def structure(parts: Column) -> Column:
    """A4D2 from segments."""
    return F.array_join(F.transform(parts, lambda s: F.concat(s["type"], s["len"].cast("string"))), "")
