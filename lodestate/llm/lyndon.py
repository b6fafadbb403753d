"""Suffix arrays of integer strings by linear grouping.

Phase 1 groups suffixes by their longest Lyndon prefix. Groups are taken in descending order; every suffix of a group
is hung to its previous smaller suffix, and the suffixes that were hung to are moved ahead of the rest of their own
group, in one step for each number of equal neighbours. Phase 2 emits the order: each suffix that is placed
places the suffix before it, and along its previous-smaller pointers, at the front of what is left of their groups.
Groups are never renamed or compared again. Two sorts remain beside the linear phases: one of the symbols, to begin
with, and one of each group's members by place, which together see every suffix once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of the integers in text, in lexicographic order (a suffix that ends early comes first)."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # a smallest symbol behind the text makes every suffix end where it is least
    order = np.concatenate([[n], np.argsort(text, kind="stable")])
    symbols = text[order[1:]]
    heads = np.concatenate([[0, 1], np.nonzero(symbols[1:] != symbols[:-1])[0] + 2])
    group = np.empty(n + 1, np.int64)
    group[order] = np.repeat(heads, np.diff(np.append(heads, n + 1)))
    previous, group = _group(order.tolist(), group.tolist(), heads.tolist(), n + 1)
    return np.array(_emit(previous, group, n + 1)[1:])


def _group(slots: list[int], group: list[int], heads: list[int], m: int) -> tuple[list[int], list[int]]:
    """(previous smaller suffix of each, first slot of each one's Lyndon group).

    slots: suffixes by group; a group is a range of slots and is named by its first. where: slot of each suffix.
    """
    where = [0] * m
    for slot, suffix in enumerate(slots):
        where[suffix] = slot
    size = [0] * m
    for a, b in zip(heads, [*heads[1:], m], strict=True):
        size[a] = b - a
    previous = [-1] * m
    end = m
    while end > 0:
        head = group[slots[end - 1]]
        members = slots[head:end]
        end = head
        if head == 0:
            break
        hung: dict[int, int] = {}
        for s in sorted(members):
            # previous smaller: the nearest on the left whose group is lower; larger ones are jumped over
            p = s - 1
            while p >= 0 and group[p] > head:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                # a neighbour of the same group hands its own previous smaller on, one repetition up
                if group[p] == head:
                    previous[s] = p = previous[p]
                    if p < 0:
                        continue
                hung[p] = hung.get(p, 0) + 1
        if not hung:
            continue
        by_count: dict[int, list[int]] = {}
        for p, times in hung.items():
            by_count.setdefault(times, []).append(p)
        for times in sorted(by_count, reverse=True):
            ahead: dict[int, int] = {}
            for p in by_count[times]:  # to the end of its group
                g = group[p]
                k = ahead.get(g, 0) + 1
                ahead[g] = k
                slot, last = where[p], g + size[g] - k
                other = slots[last]
                slots[slot], slots[last] = other, p
                where[other], where[p] = slot, last
            for g, k in ahead.items():  # which becomes a group of its own
                start = g + size[g] - k
                size[g] -= k
                size[start] = k
                for slot in range(start, start + k):
                    group[slots[slot]] = start
    return previous, group


def _emit(previous: list[int], group: list[int], m: int) -> list[int]:
    """The suffix order from the groups."""
    out = [-1] * m
    out[0] = m - 1
    front = list(range(m))  # next free slot of the group that begins here
    placed = [False] * m
    placed[m - 1] = True
    for i in range(m):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = True
            s = previous[s]
    return out
