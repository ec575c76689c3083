"""Deterministic automata over bytes for a set of regular expressions.

The expressions are read by Python's own parser, laid out as one automaton with empty moves, made deterministic by subset
construction and minimised by refining a partition of its states. The result is a transition array that serves all rules.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

_CATEGORIES = {
    sre.CATEGORY_DIGIT: set(b"0123456789"),
    sre.CATEGORY_SPACE: set(b" \t\n\r\f\v"),
    sre.CATEGORY_WORD: set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"),
}


class _Moves:
    """An automaton with empty moves: ``steps[s]`` holds (bytes, state), ``free[s]`` the states reached without a byte."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, items, at: int, fold: bool) -> int:
        """Lay out parsed items from state ``at``; returns the state after them."""
        for kind, value in items:
            if kind is sre.LITERAL:
                at = self._step(at, self._cases({value}, fold))
            elif kind is sre.NOT_LITERAL:
                at = self._step(at, set(range(256)) - self._cases({value}, fold))
            elif kind is sre.IN:
                at = self._step(at, self._set(value, fold))
            elif kind is sre.SUBPATTERN:
                _, on, off, inner = value
                at = self.add(inner, at, (fold or bool(on & sre.SRE_FLAG_IGNORECASE)) and not off & sre.SRE_FLAG_IGNORECASE)
            elif kind is sre.BRANCH:
                end = self.state()
                for option in value[1]:
                    start = self.state()
                    self.free[at].append(start)
                    self.free[self.add(option, start, fold)].append(end)
                at = end
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, inner = value
                for _ in range(low):
                    at = self.add(inner, at, fold)
                if high is sre.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.free[at].append(end)
                    for _ in range(high - low):
                        at = self.add(inner, at, fold)
                        self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        return at

    def _step(self, at: int, bytes_: set[int]) -> int:
        to = self.state()
        self.steps[at].append((frozenset(bytes_), to))
        return to

    @staticmethod
    def _cases(bytes_: set[int], fold: bool) -> set[int]:
        if not fold:
            return bytes_
        return bytes_ | {b ^ 32 for b in bytes_ if 65 <= b <= 90 or 97 <= b <= 122}

    def _set(self, items, fold: bool) -> set[int]:
        out: set[int] = set()
        negate = False
        for kind, value in items:
            if kind is sre.NEGATE:
                negate = True
            elif kind is sre.LITERAL:
                out.add(value)
            elif kind is sre.RANGE:
                out.update(range(value[0], value[1] + 1))
            elif kind is sre.CATEGORY:
                out |= _CATEGORIES[value]
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        out = self._cases(out, fold)
        return set(range(256)) - out if negate else out


@dataclass(frozen=True)
class Automaton:
    """``moves[state, byte]``; state 0 is the start. ``accepts[state]`` numbers the set of rules that end there, 0 for none;
    ``member[set, k]`` tells whether rule k is in it. So any number of rules costs one number a byte."""

    moves: np.ndarray
    accepts: np.ndarray
    member: np.ndarray

    @property
    def dead(self) -> int:
        """The state that no byte leaves and no rule ends in, or -1."""
        own = np.arange(len(self.moves))[:, None]
        lost = np.flatnonzero((self.moves == own).all(axis=1) & (self.accepts == 0))
        return int(lost[0]) if len(lost) else -1

    def resets(self) -> np.ndarray:
        """Bytes that lead to the start from every state: nothing before one matters after it."""
        return np.flatnonzero((self.moves == 0).all(axis=0))


def compile_rules(rules: list[str], anywhere: bool = True) -> Automaton:
    """One minimal automaton for all rules; with ``anywhere`` a match may begin at every byte."""
    net = _Moves()
    start = net.state()
    ends: dict[int, int] = {}
    for k, rule in enumerate(rules):
        own = net.state()
        net.free[start].append(own)
        ends[net.add(parser.parse(rule), own, False)] = k
    return _minimal(*_deterministic(net, start, ends, anywhere))


def compile_backward(rule: str) -> Automaton:
    """The automaton of a rule read from its end to its start, from a fixed end."""
    net, back = _Moves(), _Moves()
    start = net.state()
    end = net.add(parser.parse(rule), start, False)
    for _ in net.steps:
        back.state()
    for s, steps in enumerate(net.steps):
        for bytes_, to in steps:
            back.steps[to].append((bytes_, s))
        for to in net.free[s]:
            back.free[to].append(s)
    return _minimal(*_deterministic(back, end, {start: 0}, False))


def _closure(net: _Moves, states: set[int]) -> frozenset[int]:
    todo, seen = list(states), set(states)
    while todo:
        for s in net.free[todo.pop()]:
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return frozenset(seen)


def _deterministic(net: _Moves, start: int, ends: dict[int, int], anywhere: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = _closure(net, {start})
    number = {first: 0}
    rows: list[np.ndarray] = []
    todo = [first]
    for current in todo:  # grows while it is read
        to: dict[int, set[int]] = defaultdict(set)
        for s in current:
            for bytes_, end in net.steps[s]:
                for b in bytes_:
                    to[b].add(end)
        row = np.zeros(256, dtype=np.int64)
        known: dict[frozenset[int], int] = {}
        for b in range(256):
            key = frozenset(to.get(b, ()))
            if key not in known:
                target = _closure(net, set(key) | ({start} if anywhere else set()))
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                known[key] = number[target]
            row[b] = known[key]
        rows.append(row)
    sets = {frozenset(): 0}
    accepts = np.array([sets.setdefault(frozenset(ends[s] for s in current if s in ends), len(sets)) for current in todo])
    member = np.zeros((len(sets), len(ends)), dtype=bool)
    for own, n in sets.items():
        member[n, list(own)] = True
    return np.array(rows), accepts, member


def _minimal(moves: np.ndarray, accepts: np.ndarray, member: np.ndarray) -> Automaton:
    """Merge states that no input tells apart."""
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    order = np.full(group.max() + 1, -1)
    found = []
    for s in range(len(group)):  # the start keeps number 0
        if order[group[s]] < 0:
            order[group[s]] = len(found)
            found.append(s)
    return Automaton(order[group[moves[found]]].astype(np.int32), accepts[found], member)
