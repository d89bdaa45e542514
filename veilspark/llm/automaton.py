"""Regular expressions to one minimal deterministic automaton over bytes.

Supports literals, escapes (\\xHH and punctuation), classes, groups, |, ?, *, + and {m}, {m,},
{m,n}. Several patterns become one automaton whose accepting states carry a bit per pattern:
Thompson's construction, subset construction over byte classes, and minimisation by partition
refinement. The result is a flat transition array.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np


class _Parser:
    """Builds a Thompson automaton: edges[state] = [(byte set or None, target)]."""

    def __init__(self, backward: bool = False) -> None:
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []
        self.backward = backward

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def parse(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.text, self.at, self.fold = pattern, 0, fold
        out = self._either()
        if self.at != len(pattern):
            raise ValueError(f"unexpected {pattern[self.at]!r} in {pattern!r}")
        return self._build(out)

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def _either(self):
        found = [self._sequence()]
        while self._peek() == "|":
            self._take()
            found.append(self._sequence())
        return found[0] if len(found) == 1 else ("or", found)

    def _sequence(self):
        found = []
        while self._peek() and self._peek() not in "|)":
            found.append(self._repeat())
        return ("cat", found)

    def _repeat(self):
        node = self._atom()
        while (c := self._peek()) and c in "?*+{":
            self._take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                node = ("times", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("times", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def _escape(self) -> int:
        c = self._take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if c.isalnum():
            raise ValueError(f"unknown escape {c!r}")
        return ord(c)

    def _atom(self):
        c = self._take()
        if c == "(":
            node = self._either()
            if self._take() != ")":
                raise ValueError("a group isn't closed")
            return node
        if c == "[":
            return ("set", self._class())
        return ("set", self._folded({self._escape() if c == "\\" else ord(c)}))

    def _folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return frozenset(found)

    def _class(self) -> frozenset[int]:
        negate = self._peek() == "^" and bool(self._take())
        found: set[int] = set()
        while (c := self._take()) != "]":
            low = self._escape() if c == "\\" else ord(c)
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self._take()
                d = self._take()
                found |= set(range(low, (self._escape() if d == "\\" else ord(d)) + 1))
            else:
                found.add(low)
        found = set(self._folded(found))
        return frozenset(set(range(256)) - found if negate else found)

    def _build(self, node) -> tuple[int, int]:
        a, b = self.state(), self.state()
        if node[0] == "set":
            self.edges[a].append((node[1], b))
        elif node[0] == "or":
            for part in node[1]:
                x, y = self._build(part)
                self.edges[a].append((None, x))
                self.edges[y].append((None, b))
        elif node[0] == "cat":
            last = a
            for part in node[1][::-1] if self.backward else node[1]:
                x, y = self._build(part)
                self.edges[last].append((None, x))
                last = y
            self.edges[last].append((None, b))
        else:
            _, part, low, high = node
            last = a
            for _ in range(low):
                x, y = self._build(part)
                self.edges[last].append((None, x))
                last = y
            if high is None:
                x, y = self._build(part)
                self.edges[last] += [(None, x), (None, b)]
                self.edges[y] += [(None, x), (None, b)]
            else:
                for _ in range(high - low):
                    x, y = self._build(part)
                    self.edges[last] += [(None, x), (None, b)]
                    last = y
                self.edges[last].append((None, b))
        return a, b


@dataclass
class Automaton:
    """move[state * 256 + byte] is the next state; accepts[state] has a bit per pattern; state 0 starts.

    States are numbered so that those from `first_accepting` on accept something.
    """

    move: np.ndarray
    accepts: np.ndarray
    first_accepting: int

    @property
    def states(self) -> int:
        return len(self.accepts)

    @functools.cached_property
    def lists(self) -> tuple[list[int], list[int]]:
        return self.move.tolist(), self.accepts.tolist()

    @functools.cached_property
    def dead(self) -> int:
        """The state that leads nowhere, or -1."""
        move = self.move.reshape(-1, 256)
        found = np.flatnonzero((move == np.arange(self.states)[:, None]).all(axis=1) & (self.accepts == 0))
        return int(found[0]) if len(found) else -1


def compile_all(patterns: list[tuple[str, bool]], search: bool, backward: bool = False) -> Automaton:
    """One automaton for (pattern, ignore case) pairs; with search a match may begin at any byte.

    A backward automaton reads texts from their end and accepts where a match begins.
    """
    nfa = _Parser(backward)
    begin = nfa.state()
    final: dict[int, int] = {}
    for bit, (pattern, fold) in enumerate(patterns):
        a, b = nfa.parse(pattern, fold)
        nfa.edges[begin].append((None, a))
        final[b] = final.get(b, 0) | 1 << bit
    if search:
        nfa.edges[begin].append((frozenset(range(256)), begin))

    # bytes that no set tells apart form a class
    sets = list({s for edges in nfa.edges for s, _ in edges if s is not None})
    marks: dict[tuple, int] = {}
    kind = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)])
    sample = [int(np.argmax(kind == c)) for c in range(len(marks))]

    def closure(states: set[int]) -> frozenset[int]:
        stack, seen = list(states), set(states)
        while stack:
            for s, t in nfa.edges[stack.pop()]:
                if s is None and t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(x for x in seen if x in final or any(s is not None for s, _ in nfa.edges[x]))

    first = closure({begin})
    number, todo, table = {first: 0}, [first], []
    while len(table) < len(todo):
        own = todo[len(table)]
        row = []
        for byte in sample:
            target = closure({t for x in own for s, t in nfa.edges[x] if s is not None and byte in s})
            if target not in number:
                number[target] = len(todo)
                todo.append(target)
            row.append(number[target])
        table.append(row)
    moves = np.array(table)
    accepts = np.array([sum({final[x] for x in own if x in final}) for own in todo], np.int64)

    # states stay together while they accept the same and move to the same groups
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    # the start comes first, accepting groups last
    chosen = [int(np.argmax(group == g)) for g in range(group.max() + 1)]
    order = sorted(range(len(chosen)), key=lambda g: (accepts[chosen[g]] != 0, g != group[0]))
    place = np.argsort(order)
    small = place[group[moves[[chosen[g] for g in order]]]][:, kind]
    flags = accepts[[chosen[g] for g in order]]
    return Automaton(small.reshape(-1).astype(np.int32), flags, int(np.argmax(flags != 0)) if flags.any() else len(flags))
