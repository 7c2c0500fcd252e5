"""Definitions by brute force, for tables of some fifteen rows only."""

from itertools import combinations


def edges(rows, fds):
    """Conflicting pairs of row positions."""
    found = set()
    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if any(all(a[c] == b[c] for c in fd.lhs) and a[fd.rhs] != b[fd.rhs] for fd in fds):
            found.add((i, j))
    return found


def minimum_cover(pairs, n):
    """Smallest set of rows touching every pair: n minus the largest set of rows without a pair."""
    near = [0] * n
    for i, j in pairs:
        near[i] |= 1 << j
        near[j] |= 1 << i
    free = bytearray(1 << n)
    free[0] = 1
    best = 0
    for mask in range(1, 1 << n):
        top = mask.bit_length() - 1
        rest = mask ^ (1 << top)
        if free[rest] and not near[top] & rest:
            free[mask] = 1
            best = max(best, mask.bit_count())
    return n - best
