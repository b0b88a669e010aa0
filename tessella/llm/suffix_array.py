"""Suffix arrays in linear time by Lyndon grouping.

Suffixes are first grouped by their first symbol. Groups are processed from the highest down: each member's
previous-smaller pointer (the nearest position to the left in a lower group) names a suffix whose Lyndon prefix
extends by the member's; such suffixes leave their group for a higher one of their own, those reached by more
repetitions of the member's prefix above those reached by fewer. After that the groups hold suffixes of equal
Lyndon prefix in final order, and one pass from the smallest suffix up emits each group's order: a suffix on the
pointer chain left of an emitted one is the next of its group. No ranks are renamed and nothing recurses. A long text's state is
in arrays of 32 bits, some 30 bytes a symbol; a short one's is in lists, which are faster.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence


#: Symbols from which state is held in arrays.
SMALL = 1 << 15


def room(value: int, n: int) -> list[int] | array:
    return [value] * n if n <= SMALL else array("i", [value]) * n


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of text, smallest first. Symbols are integers from 0 on."""
    n = len(text)
    if n < 2:
        return list(range(n))
    top = max(text) + 1
    count = [0] * top
    for c in text:
        count[c] += 1
    # position n is an end below all symbols, alone in group 0; as index -1 it also guards the left of the text
    begin, at = [0] * top, 1
    for c in range(top):
        begin[c] = at
        at += count[c]
    sa, isa, group = room(n, n + 1), room(0, n + 1), room(0, n + 1)
    size, prev = room(0, n + 1), room(n, n + 1)
    size[0] = 1
    for c in range(top):
        if count[c]:
            size[begin[c]] = count[c]
    fill = begin[:]
    for i, c in enumerate(text):
        at = fill[c]
        fill[c] = at + 1
        sa[at], isa[i], group[i] = i, at, begin[c]

    end = n + 1
    while end > 1:
        i = sa[end - 1]
        g = group[i]
        if end - g == 1:  # most groups have one member
            end = g
            p = i - 1
            while group[p] > g:
                p = prev[p]
            prev[i] = p
            q = group[p]
            if q and size[q] > 1:
                size[q] -= 1
                last = q + size[q]
                x, at = sa[last], isa[p]
                sa[at], isa[x] = x, at
                sa[last], isa[p], group[p] = p, last, last
                size[last] = 1
            continue
        times: dict[int, int] = {}
        for i in sorted(sa[g:end]):
            p = i - 1
            while group[p] > g:
                p = prev[p]
            if group[p] == g:  # the member before it: one more repetition
                p = prev[p]
                times[p] += 1
            else:
                times[p] = 1
            prev[i] = p
        end = g
        times.pop(-1, None)
        times.pop(n, None)
        by: dict[int, list[int]] = {}
        for p, k in times.items():
            by.setdefault(k, []).append(p)
        for k in sorted(by, reverse=True):
            came = []
            for p in by[k]:
                q = group[p]
                size[q] -= 1
                last = q + size[q]
                x, at = sa[last], isa[p]
                sa[at], isa[x] = x, at
                sa[last], isa[p] = p, last
                came.append(q)
            for p, q in zip(by[k], came, strict=True):
                group[p] = q + size[q]
            for p in by[k]:  # sizes of the new groups, once their starts are known
                q = group[p]
                if isa[p] == q:
                    size[q] = 0
            for p in by[k]:
                size[group[p]] += 1

    placed = bytearray(n + 1)
    placed[n] = 1
    sa[0] = n
    fill = list(range(n + 1)) if n < SMALL else array("i", range(n + 1))
    for r in range(n + 1):
        s = sa[r] - 1
        while not placed[s]:
            placed[s] = 1
            g = group[s]
            sa[fill[g]] = s
            fill[g] += 1
            s = prev[s]
    return sa[1:] if n < SMALL else sa[1:].tolist()
