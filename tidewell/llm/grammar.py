"""A small weighted finite-state machine over token classes.

A pattern is a sequence of terms separated by blanks; a term is a class (upper case), a word (lower
case) or ``_`` (any token inside a clause), or alternatives ``a|b|C``, with an optional ``?``, ``*``
or ``{m,n}``. All patterns are joined to one machine that is determinised while it runs: a state is
a set of pattern positions, an input symbol is the set of classes a token has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: States and symbols that the determinised part keeps before it starts anew; bounds memory only.
CACHE = 200_000
STOP = "."
_TERM = re.compile(r"^(.+?)(\?|\*|\{(\d+),(\d+)\})?$")


@dataclass(frozen=True)
class Pattern:
    category: str
    weight: float
    text: str


def _expand(text: str) -> list[tuple[frozenset[str], bool, bool]]:
    """(symbols, may be skipped, may repeat) for each term."""
    out = []
    for raw in text.split():
        body, mark, low, high = _TERM.match(raw).groups()
        symbols = frozenset(body.split("|"))
        if mark is None:
            out.append((symbols, False, False))
        elif mark == "?":
            out.append((symbols, True, False))
        elif mark == "*":
            out.append((symbols, True, True))
        else:
            out += [(symbols, i >= int(low), False) for i in range(int(high))]
    return out


class Machine:
    """Finds where patterns end in a sequence of symbol sets."""

    def __init__(self, patterns: list[Pattern]) -> None:
        self.patterns = patterns
        self.terms = [_expand(p.text) for p in patterns]
        self.alphabet = frozenset(s for t in self.terms for x in t for s in x[0])
        self.start = frozenset(x for k in range(len(patterns)) for x in self._closure(k, 0))
        self._next: dict[tuple[frozenset, frozenset], tuple[frozenset, tuple[int, ...]]] = {}

    def _closure(self, k: int, i: int) -> set[tuple[int, int]]:
        out = {(k, i)}
        while i < len(self.terms[k]) and self.terms[k][i][1]:
            i += 1
            out.add((k, i))
        return out

    def _step(self, state: frozenset, symbols: frozenset) -> tuple[frozenset, tuple[int, ...]]:
        key = (state, symbols)
        if key not in self._next:
            if len(self._next) > CACHE:
                self._next.clear()
            to: set[tuple[int, int]] = set()
            for k, i in state:
                if i < len(self.terms[k]):
                    want, _, repeat = self.terms[k][i]
                    if want & symbols or ("_" in want and STOP not in symbols):
                        to |= self._closure(k, i + 1)
                        if repeat:
                            to |= self._closure(k, i)
            done = tuple(sorted({k for k, i in to if i == len(self.terms[k])}))
            self._next[key] = (frozenset(to) | self.start, done)
        return self._next[key]

    def run(self, tokens: list[frozenset[str]]) -> list[tuple[int, int]]:
        """(pattern, position of its last token), for every end of every match."""
        state, out = self.start, []
        for at, symbols in enumerate(tokens):
            state, done = self._step(state, symbols & self.alphabet if STOP not in symbols else frozenset([STOP]))
            out += [(k, at) for k in done]
        return out

    def begin(self, k: int, tokens: list[frozenset[str]], end: int, *, longest: bool = False) -> int:
        """The latest begin of a match of pattern k that ends at ``end``, or the earliest."""
        terms = self.terms[k]
        seen = {(len(terms), end)}
        todo, best = list(seen), -1
        while todo:
            i, at = todo.pop()
            if i == 0:
                best = at + 1 if best < 0 else min(best, at + 1) if longest else max(best, at + 1)
                continue
            want, skip, repeat = terms[i - 1]
            moves = [(i - 1, at)] if skip else []
            if at >= 0 and (want & tokens[at] or ("_" in want and STOP not in tokens[at])):
                moves += [(i - 1, at - 1)] + ([(i, at - 1)] if repeat else [])
            for m in moves:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return max(best, 0)
