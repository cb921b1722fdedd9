"""A suffix automaton over word hashes, with the matching statistics of a streamed sequence."""

from __future__ import annotations


class Automaton:
    """Holds every substring of the sequences added; two sequences never match across their border."""

    def __init__(self):
        self.next, self.link, self.length, self.last, self.added = [{}], [-1], [0], 0, 0

    def add(self, words: list[int]) -> None:
        for w in words:
            self.extend(w)
        self.added += 1
        self.extend(-self.added)  # a border that no text holds

    def extend(self, w: int) -> None:
        step, link, length = self.next, self.link, self.length
        new = len(length)
        length.append(length[self.last] + 1)
        link.append(0)
        step.append({})
        p = self.last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = copy
                    p = link[p]
                link[q] = link[new] = copy
        self.last = new

    def matches(self, words: list[int]) -> list[int]:
        """For each place, the length of the longest substring ending there that the automaton holds."""
        step, link, length = self.next, self.link, self.length
        state = run = 0
        out = []
        for w in words:
            while state and w not in step[state]:
                state = link[state]
                run = length[state]
            if w in step[state]:
                state, run = step[state][w], run + 1
            out.append(run)
        return out
