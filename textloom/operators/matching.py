"""Common stretches of two texts, by searches for a longer one than so far, or by suffix automata.

Of texts whose lengths have a product up to SEARCHED, as lines have, each place of the one is tried with a stretch one longer than the longest so far, which the
interpreter looks up in the other much faster than an automaton of it is built; a search takes that product at most. Longer ones take automata. The automaton of a text has a state for each set of places where some stretches of it end; it is built in one pass, and another text is run through it in
one pass, which gives the longest stretch that both have. What lies left and right of it is compared in the same way.
"""

from __future__ import annotations

#: The greatest product of two lengths that are searched rather than made an automaton of.
SEARCHED = 1 << 20


class Automaton:
    """Of a text: transitions, the state of the longest proper ending with other places, the longest stretch's length, where it ends first."""

    def __init__(self, text: str):
        self.to: list[dict[str, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [-1]
        last = 0
        for place, ch in enumerate(text):
            own = self._state({}, self.size[last] + 1, place)
            at = last
            while at >= 0 and ch not in self.to[at]:
                self.to[at][ch] = own
                at = self.link[at]
            if at < 0:
                self.link[own] = 0
            else:
                nxt = self.to[at][ch]
                if self.size[nxt] == self.size[at] + 1:
                    self.link[own] = nxt
                else:
                    twin = self._state(dict(self.to[nxt]), self.size[at] + 1, self.first[nxt])
                    self.link[twin] = self.link[nxt]
                    while at >= 0 and self.to[at].get(ch) == nxt:
                        self.to[at][ch] = twin
                        at = self.link[at]
                    self.link[nxt] = self.link[own] = twin
            last = own

    def _state(self, to: dict[str, int], size: int, first: int) -> int:
        self.to.append(to)
        self.link.append(0)
        self.size.append(size)
        self.first.append(first)
        return len(self.to) - 1

    def longest(self, text: str, start: int, end: int) -> tuple[int, int, int]:
        """(place in the text, place in the automaton's, length) of the longest common stretch; the first of the text, and the first there."""
        best, state, size = (0, 0, 0), 0, 0
        for place in range(start, end):
            ch = text[place]
            while state and ch not in self.to[state]:
                state = self.link[state]
                size = self.size[state]
            if ch in self.to[state]:
                state, size = self.to[state][ch], size + 1
            if size > best[2]:
                best = place - size + 1, self.first[state] - size + 1, size
        return best


def searched(a: str, a0: int, a1: int, b: str, b0: int, b1: int) -> tuple[int, int, int]:
    """(place in a, place in b, length) of the longest common stretch of a[a0:a1] and b[b0:b1]; the first of a, and the first in b."""
    at, size, i = 0, 0, a0
    while i + size < a1:
        j = b.find(a[i : i + size + 1], b0, b1)
        if j < 0:
            i += 1
            continue
        at, size = i, size + 1
        while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
            size += 1
    return at, b.find(a[at : at + size], b0, b1), size


def blocks(a: str, b: str, whole: Automaton | None = None) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of common stretches, in order: the longest of all, then the longest left and right of it, and so on.

    Of equally long ones the first of a counts, then the first of b. Stretches that touch in both texts are one. whole: b's automaton, if it is at hand.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        own = whole if whole is not None and b0 == 0 and b1 == len(b) else None
        if own is None and (a1 - a0) * (b1 - b0) <= SEARCHED:
            i, j, n = searched(a, a0, a1, b, b0, b1)
        else:
            i, j, n = (own or Automaton(b[b0:b1])).longest(a, a0, a1)
            j += b0
        if n:
            found.append((i, j, n))
            todo += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def changes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """(op, a1, a2, b1, b2) of the spans between common stretches: replace, delete or insert."""
    out, i, j = [], 0, 0
    for x, y, n in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + n, y + n
    return out
