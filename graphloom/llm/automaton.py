"""Generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All substrings of the added sequences.

    State 0 is the root.  next[v]: symbol -> state; link[v]: state of the longest suffix in another
    class; length[v]: longest substring of the class.  About two states for each added symbol.
    """

    __slots__ = ("next", "link", "length")

    def __init__(self, sequences: Iterable[Sequence] = ()) -> None:
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        for sequence in sequences:
            self.add(sequence)

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.next) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state for the strings of q no longer than length[p] + 1."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: Sequence) -> None:
        last = 0
        for symbol in sequence:
            known = self.next[last].get(symbol)
            if known is not None:
                exact = self.length[known] == self.length[last] + 1
                last = known if exact else self._split(last, symbol, known)
                continue
            p, last = last, self._state(self.length[last] + 1, 0, {})
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, symbol, q)

    def step(self, state: int, matched: int, symbol) -> tuple[int, int]:
        """State and length of the longest suffix, with this symbol, that some sequence contains."""
        while True:
            to = self.next[state].get(symbol)
            if to is not None:
                return to, matched + 1
            if state == 0:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]

    def suffix(self, state: int, n: int) -> int:
        """The state of the suffix of n symbols of a match at state (n at most the match's length)."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def walk(self, sequence: Iterable) -> Iterable[tuple[int, int]]:
        """Matching statistics: state and matched length after each symbol."""
        state = matched = 0
        for symbol in sequence:
            state, matched = self.step(state, matched, symbol)
            yield state, matched
