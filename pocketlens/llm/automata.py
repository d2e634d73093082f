"""Minimal acyclic acceptors of word lists, and their composition with a one-edit transducer.

The composed machine reads a pair of words.  Before its one edit both sides are in the
same state of the acceptor, as it is deterministic; the edit replaces a letter or leaves
one out; after it both sides read the same letters, so what is left is the intersection
of the languages of two states.  States are shared by all words with the same endings,
and each state and pair of states is worked out once.  Words are known by their number in
sorted order: a state's accepted endings are numbered, and numbers add up along a path.
"""

from __future__ import annotations


class Acceptor:
    """Minimal deterministic acceptor of sorted, different words (children have smaller numbers than parents)."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.edges: list[dict[str, int]] = []
        #: number of accepted endings, and by letter the number of endings before the letter's
        self.count: list[int] = []
        self.before: list[dict[str, int]] = []
        self.shortest: list[int] = []
        self.longest: list[int] = []
        known: dict[tuple, int] = {}
        path, last = [[False, {}]], ""  # the states of the last word that may still get edges

        def close(keep: int) -> None:
            for depth in range(len(last), keep, -1):
                path[depth - 1][1][last[depth - 1]] = self._state(known, *path.pop())

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared)
            path += [[False, {}] for _ in range(len(word) - shared)]
            path[-1][0] = True
            last = word
        close(0)
        self.start = self._state(known, *path.pop())

    def _state(self, known: dict, final: bool, edges: dict[str, int]) -> int:
        name = final, tuple(edges.items())
        state = known.get(name)
        if state is None:
            state = known[name] = len(self.final)
            before, total = {}, int(final)
            for letter, to in edges.items():
                before[letter] = total
                total += self.count[to]
            self.final.append(final)
            self.edges.append(edges)
            self.count.append(total)
            self.before.append(before)
            self.shortest.append(0 if final or not edges else 1 + min(self.shortest[to] for to in edges.values()))
            self.longest.append(1 + max((self.longest[to] for to in edges.values()), default=-1))
        return state


class OneEdit:
    """The acceptor composed with the one-edit transducer and itself."""

    def __init__(self, acceptor: Acceptor):
        self.a = acceptor
        self.common: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _ready(self, p: int, q: int) -> list[tuple[int, int]] | None:
        """Endings that both states accept, as pairs of their numbers; None if not worked out yet."""
        a = self.a
        if p == q:
            return [(i, i) for i in range(a.count[p])]
        if a.longest[p] < a.shortest[q] or a.longest[q] < a.shortest[p]:
            return []
        if p > q:
            held = self.common.get((q, p))
            return None if held is None else [(j, i) for i, j in held]
        return self.common.get((p, q))

    def both(self, p: int, q: int) -> list[tuple[int, int]]:
        held = self._ready(p, q)
        if held is not None:
            return held
        a, todo = self.a, [(min(p, q), max(p, q))]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.common:
                todo.pop()
                continue
            found, waits = [(0, 0)] if a.final[x] and a.final[y] else [], False
            one, two = a.edges[x], a.edges[y]
            for letter in one.keys() & two.keys():
                below = self._ready(one[letter], two[letter])
                if below is None:
                    todo.append((min(one[letter], two[letter]), max(one[letter], two[letter])))
                    waits = True
                elif not waits:
                    i, j = a.before[x][letter], a.before[y][letter]
                    found += [(i + m, j + n) for m, n in below]
            if not waits:
                self.common[x, y] = found
                todo.pop()
        return self._ready(p, q)

    def edits_at(self, p: int) -> list[tuple[int, int]]:
        """Pairs of endings of a state that differ by an edit of their first letter."""
        a, out = self.a, []
        steps, before, final = list(a.edges[p].items()), a.before[p], a.final[p]
        for at, (letter, to) in enumerate(steps):
            start = before[letter]
            for other, beside in steps[at + 1 :]:  # replaced
                second = before[other]
                out += [(start + m, second + n) for m, n in self.both(to, beside)]
            if a.final[to] and final:  # left out, at the end
                out.append((start, 0))
            for after, beside in a.edges[to].items():  # left out, before another letter
                if after != letter and after in before:
                    first, second = start + a.before[to][after], before[after]
                    out += [(first + m, second + n) for m, n in self.both(beside, a.edges[p][after])]
        return out

    def pairs(self, deepest: int) -> list[tuple[int, int]]:
        """Pairs of word numbers that differ by one edit behind at most ``deepest`` common letters, each pair once."""
        a = self.a
        edits = [self.edits_at(p) for p in range(len(a.final))]
        useful = []
        for p in range(len(a.final)):
            useful.append(bool(edits[p]) or any(useful[to] for to in a.edges[p].values()))
        out, todo = [], [(a.start, 0, 0)]
        while todo:
            p, base, depth = todo.pop()
            if depth > deepest or not useful[p]:
                continue
            out += [(base + m, base + n) for m, n in edits[p]]
            todo += [(to, base + a.before[p][letter], depth + 1) for letter, to in a.edges[p].items()]
        return out
