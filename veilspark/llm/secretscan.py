"""Secret scans by one combined deterministic automaton.

All rules, as they stand, are compiled into one minimal automaton (`automaton`) that reads texts from
their end: after each byte its state tells which rules have a match that begins there. The texts of
a batch are laid end to end, parted by a byte that takes every state back to the start, and cut into
lanes of near-equal length that step together through the transition array, so one pass over the
bytes serves all rules. Lanes are cut at such bytes; where none is near, a lane begins in a state
that is assumed, and is read again if the lane before it ends in another.

From the leftmost beginning of a rule that lies behind its last match, the rule's anchored automaton
is read on to the longest end. A match exists there, so every byte is read once per match that covers it.

A rule's `least` is the shortest text of its value (the run at its end); a match below that is
dropped, but it is used up all the same.

Defined results: null text counts as empty; equal rows get equal results each; extra columns are
ignored; an empty table gives no rows; a null doc_id is carried as it is. Offsets count code points.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_all
from .textcore import buffers

#: Bytes of a lane, and of the texts that are scanned together.
LANE, TOGETHER = 2048, 8 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fold: bool = False
    #: Shortest value; the value is what follows the last match of `lead`, or all.
    least: int = 1
    lead: str = ""


_KEY = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
# fixed values: base rules in their order, then added ones
BASE = (
    Rule("assign", _KEY + r"[A-Za-z0-9+/_.=\-]+", True, 6, _KEY),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    # a run of hex digits is a match or none: a short one holds no other
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9\-]+", least=15),
    Rule("cloud_key", r"AIza[A-Za-z0-9_\-]+", least=39),
    Rule("signed", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", least=30),
)


@functools.lru_cache(4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, int, list[tuple[Automaton, Automaton | None]]]:
    """The combined backward automaton, a byte that resets it, and each rule's anchored ones."""
    whole = compile_all([(r.pattern, r.fold) for r in rules], True, backward=True)
    resets = np.flatnonzero((whole.move.reshape(-1, 256) == 0).all(axis=0))
    if not len(resets):
        raise ValueError("no byte ends every rule, so texts can't be laid end to end")
    byte = 10 if 10 in resets else int(resets[0])
    own = [(compile_all([(r.pattern, r.fold)], False), compile_all([(r.lead, r.fold)], False) if r.lead else None) for r in rules]
    return whole, byte, own


def _lanes(data: np.ndarray, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes start, and which of them start after a byte that doesn't reset the automaton."""
    stops = np.flatnonzero(resets[data]) + 1
    goal = np.arange(LANE, len(data), LANE)
    at = np.searchsorted(stops, goal)
    good = np.unique(stops[at[at < len(stops)]])
    edges = np.concatenate([[0], good[good < len(data)], [len(data)]])
    parts = np.maximum(1, np.diff(edges) // LANE)
    first = np.repeat(edges[:-1], parts)
    step = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    return first + step * LANE, step > 0


def _run(data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray, automaton: Automaton):
    """Steps lanes together; (last states, [places, accepted rules] of every byte at which a rule accepts)."""
    order = np.argsort(-length, kind="stable")
    begin, size, ends = start[order], length[order], np.empty(len(start), np.int32)
    now = state[order]
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left").tolist()
    places, rules = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t, m in enumerate(active):
        if m < len(now):
            ends[order[m : len(now)]] = now[m:]
            now = now[:m]
        now = automaton.move[(now << 8) + data[begin[:m] + t]]
        if now.max() >= automaton.first_accepting:
            lanes = np.flatnonzero(now >= automaton.first_accepting)
            places.append(begin[lanes] + t)
            rules.append(automaton.accepts[now[lanes]])
    ends[order[: len(now)]] = now
    return ends, np.concatenate(places), np.concatenate(rules)


def beginnings(texts: np.ndarray, offsets: np.ndarray, automaton: Automaton, reset: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, bits of the rules that have a match from there), by place in all texts laid end to end."""
    n, size = len(offsets) - 1, np.diff(offsets)
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # one reset byte after each text
    joined = np.full(len(texts) + n, reset, np.uint8)
    joined[np.arange(len(texts)) + np.repeat(np.arange(n), size)] = texts
    data = joined[::-1].copy()
    start, assumed = _lanes(data, (automaton.move.reshape(-1, 256) == 0).all(axis=0))
    length = np.diff(np.append(start, len(data)))
    state, ends = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    again = np.arange(len(start))
    while len(again):
        # what a lane found from a wrong state goes
        if found:
            gone = np.zeros(len(start), bool)
            gone[again] = True
            found = [(p[keep], r[keep]) for p, r in found for keep in [~gone[np.searchsorted(start, p, side="right") - 1]]]
        ends[again], places, rules = _run(data, start[again], length[again], state[again], automaton)
        found.append((places, rules))
        before = np.concatenate([[0], ends[:-1]]).astype(np.int32)
        again = np.flatnonzero(assumed & (before != state))
        state[again] = before[again]
    places, rules = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    places = len(data) - 1 - places
    order = np.argsort(places, kind="stable")
    places, rules = places[order], rules[order]
    return places - np.searchsorted(offsets[1:] + np.arange(n), places, side="left"), rules


def longest(automaton: Automaton, data: bytes, at: int) -> int:
    """End of the longest match that begins at `at`, or -1."""
    (move, accepts), dead = automaton.lists, automaton.dead
    state, end = 0, -1
    for i in range(at, len(data)):
        state = move[state << 8 | data[i]]
        if state == dead:
            break
        if accepts[state]:
            end = i + 1
    return end


def _spans(rule: Rule, own: Automaton, lead: Automaton | None, data: bytes, starts: np.ndarray) -> list[tuple[int, int]]:
    """Leftmost and longest matches without overlaps; starts: every place where a match begins, in order."""
    out, i = [], 0
    while i < len(starts):
        at = int(starts[i])
        end = longest(own, data, at)
        value = longest(lead, data, at) if lead else at
        if end - value >= rule.least:
            out.append((at, end))
        i = int(np.searchsorted(starts, end, side="left"))
    return out


def scan_texts(raw: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...], ready: tuple) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) in bytes of every text's matches, in that order; ready: compiled(rules)."""
    whole, reset, own = ready
    places, bits = beginnings(raw, offsets, whole, reset)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    rows = np.searchsorted(offsets, places, side="right") - 1
    first = np.searchsorted(rows, np.arange(len(offsets)))
    for row in np.unique(rows).tolist():
        data = raw[offsets[row] : offsets[row + 1]].tobytes()
        at, kinds = places[first[row] : first[row + 1]] - offsets[row], bits[first[row] : first[row + 1]]
        out[row] = sorted((a, i, b) for i, r in enumerate(rules) if (kinds >> i & 1).any() for a, b in _spans(r, *own[i], data, at[kinds >> i & 1 == 1]))
    return out


def _task(rules: tuple[Rule, ...], base: int, ready: tuple):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            first = 0
            found: list[list[tuple[int, int, int]]] = []
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + TOGETHER, side="right")) - 1)
                last = min(last, batch.num_rows)
                found += scan_texts(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], rules, ready)
                first = last
            counts, digests, lists = [[] for _ in range(base)], [], []
            for row, own in enumerate(found):
                for i in range(base):
                    counts[i].append(sum(x[1] == i for x in own))
                if not own:
                    digests.append(empty)
                    lists.append("")
                    continue
                # bytes that begin a code point, counted up to each offset
                points = np.concatenate([[0], np.cumsum((raw[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)])
                told = [(i, f"{rules[i].kind}:{points[a]}:{points[b]}") for a, i, b in own]
                digests.append(hashlib.sha256(",".join(x for i, x in told if i < base).encode()).hexdigest())
                lists.append(",".join(x for _, x in told))
            longs = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs, pa.array(digests, pa.string()), pa.array(lists, pa.string())], names=["doc_id", *(f"n_{r.kind}" for r in rules[:base]), "base_sha256", "spans"])

    return task


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """doc_id, a count for each base rule, base_sha256 and spans (kind:start:end, comma-joined)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rules = (*base, *added)
    counts = ", ".join(f"n_{r.kind} long" for r in base)
    return rows.mapInArrow(_task(rules, len(base), compiled(rules)), f"doc_id long, {counts}, base_sha256 string, spans string")
