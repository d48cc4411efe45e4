"""Suffix arrays by linear grouping construction, over numpy arrays."""

from __future__ import annotations

import numpy as np

#: Groups of so many suffixes or fewer go one by one, larger ones as arrays.
FEW = 24


class Groups:
    """Suffixes grouped by their longest Lyndon prefix, the groups in order.

    A group is named by its first place in the suffix array. `of` has each suffix's group, `length` each group's prefix length, `prev` the
    nearest suffix to the left that lies in a smaller group, -1 if none does.
    """

    def __init__(self, text: np.ndarray):
        """text: small non-negative integers; the last one alone is the least."""
        n = len(text)
        count = np.bincount(text)
        start = np.cumsum(count) - count
        self.of = start[text].astype(np.int32)
        self.prev = np.arange(-1, n - 1, dtype=np.int32)
        self.members: dict[int, np.ndarray | list[int]] = {}
        self.length: dict[int, int] = {}
        self._end: dict[int, int] = {}
        self._first = np.full(n, -1, np.int32)  # of the group that ends at a place
        order = np.argsort(text, kind="stable").astype(np.int32)
        for c in np.flatnonzero(count).tolist():
            a, b = int(start[c]), int(start[c] + count[c])
            self.members[a], self.length[a], self._end[a], self._first[b - 1] = order[a:b], 1, b, a
        self._of, self._prev, first = memoryview(self.of), memoryview(self.prev), memoryview(self._first)
        end = n
        while end > 0:
            group = first[end - 1]
            own = self.members[group]
            if end - group == 1:
                self._single(group, own)
            elif end - group <= FEW:
                self._small(group, own)
            else:
                self._large(group, own)
            end = group

    def _single(self, group: int, own) -> None:
        of, prev = self._of, self._prev
        if len(own) == 1:
            i = own[0]
        else:
            i = next(x for x in own if of[x] == group)
        p = i - 1
        while p >= 0 and of[p] >= group:
            p = prev[p]
        prev[i] = p
        self.members[group] = (i,)
        if p >= 0:
            self._move(of[p], self.length[group], [(1, [p])], 1)

    def _small(self, group: int, own) -> None:
        """The group's prefix goes behind those of the suffixes that its members' pointers lead to."""
        of, prev = self._of, self._prev
        own = sorted([x for x in own if of[x] == group] if isinstance(own, list) else [x for x in own.tolist() if of[x] == group])
        self.members[group] = own
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and of[p] >= group:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if len(times) == 1:
            (p, k), = times.items()
            self._move(of[p], self.length[group], [(k, [p])], 1)
            return
        by: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            by.setdefault(of[p], {}).setdefault(k, []).append(p)
        for h, parts in by.items():
            self._move(h, self.length[group], sorted(parts.items()), sum(map(len, parts.values())))

    def _large(self, group: int, own) -> None:
        own = np.sort(own[self.of[own] == group])
        self.members[group] = own
        p = own - 1
        todo = np.flatnonzero(p >= 0)
        todo = todo[self.of[p[todo]] >= group]
        while len(todo):  # a member's pointer so far is a shortcut for the members to its right
            p[todo] = self.prev[p[todo]]
            self.prev[own[todo]] = p[todo]
            todo = todo[p[todo] >= 0]
            todo = todo[self.of[p[todo]] >= group]
        self.prev[own] = p
        at = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        times = np.diff(np.append(at, len(p)))
        to = p[at]
        times, to = times[to >= 0], to[to >= 0]
        if not len(to):
            return
        h = self.of[to]
        order = np.lexsort((times, h))
        to, h, times = to[order], h[order], times[order]
        cut = np.flatnonzero((h[1:] != h[:-1]) | (times[1:] != times[:-1])) + 1
        bounds = [0, *cut.tolist(), len(to)]
        heads, counts = h[bounds[:-1]].tolist(), times[bounds[:-1]].tolist()
        step, k = self.length[group], 0
        while k < len(heads):
            j = k
            parts = []
            while j < len(heads) and heads[j] == heads[k]:
                parts.append((counts[j], to[bounds[j] : bounds[j + 1]]))
                j += 1
            self._move(heads[k], step, parts, bounds[j] - bounds[k])
            k = j

    def _move(self, h: int, step: int, parts: list, moved: int) -> None:
        """Members of group h, by how often the prefix follows theirs, become groups of their own behind the rest of h, more often further behind."""
        end, length = self._end[h], self.length[h]
        at = end - moved
        if at > h:  # something stays
            self._end[h], self._first[at - 1] = at, h
        for k, own in parts:
            self.length[at] = length + k * step
            after = at + len(own)
            self._end[at], self._first[after - 1] = after, at
            if at != h:
                self.members[at] = own
                if len(own) > FEW:
                    self.of[own] = at
                else:
                    of = self._of
                    for x in own if isinstance(own, list) else own.tolist():
                        of[x] = at
            at = after


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes in order, of small non-negative integers of which the last one alone is the least.

    First, groups of suffixes are processed from the greatest to the least: each member's previous-smaller pointer says behind which suffix's
    prefix the group's own one goes. Then each group has one Lyndon word, and what follows it is a smaller suffix, already in order; so
    groups are emitted from the least to the greatest, each ordered by its members' followers. No text is renamed or sorted again.
    """
    groups = Groups(text)
    rank = groups.of.copy()  # a group of one suffix needs no more
    cell, of = memoryview(rank), memoryview(groups.of)
    for start in sorted(k for k, own in groups.members.items() if len(own) > 1):
        own, step, place = groups.members[start], groups.length[start], start
        while FEW >= len(own) > 0:
            ready = sorted((cell[x + step], x) for x in own if of[x + step] != start)
            own = [x for x in own if of[x + step] == start]
            for place, (_, x) in enumerate(ready, place):
                cell[x], of[x] = place, -1
            place += 1
        own = np.asarray(own, np.int32)
        while len(own):  # one turn, but for repeats: a follower in the same group has one repeat less, and comes first
            again = groups.of[own + step] == start
            ready = own[~again]
            rank[ready[np.argsort(rank[ready + step], kind="stable")]] = np.arange(place, place + len(ready))
            place += len(ready)
            groups.of[ready] = -1
            own = own[again]
    out = np.empty(len(text), np.int32)
    out[rank] = np.arange(len(text), dtype=np.int32)
    return out
