"""A generalised suffix automaton over token sequences, and matching statistics against it."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator, Sequence


class SuffixAutomaton:
    """Accepts every contiguous run of the added sequences.

    State 0 is the root.  ``length[s]`` is the longest run of state s, ``link[s]`` the state of
    its longest suffix in another state; a state holds the runs with lengths in
    (length[link[s]], length[s]], which all end at the same places.
    """

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _extend(self, last: int, token: Hashable) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(token)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._split(last, token, known)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, token, q)
        return new

    def _split(self, p: int, token: Hashable, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(token) == q:
            nxt[p][token] = clone
            p = link[p]
        return clone

    def add(self, tokens: Iterable[Hashable]) -> int:
        """Adds a sequence; returns the state of the whole of it."""
        last = 0
        for t in tokens:
            last = self._extend(last, t)
        return last

    def walk(self, tokens: Sequence[Hashable]) -> Iterator[tuple[int, int]]:
        """Matching statistics: for each place, the state and length of the longest run that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        for t in tokens:
            while state and t not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(t)
            if to is None:
                state = size = 0
            else:
                state = to
                size += 1
            yield state, size

    def at_length(self, state: int, size: int) -> int:
        """The state of the suffix with ``size`` tokens of a run that is in ``state``."""
        link, length = self.link, self.length
        while length[link[state]] >= size:
            state = link[state]
        return state
