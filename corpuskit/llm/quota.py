"""Feasible quotas: shares of a total within floors and capacities. Pure arithmetic over the few rows of a target table."""

from __future__ import annotations

from math import floor


def feasible(total: int, shares: list[float], floors: list[int], caps: list[int]) -> list[int]:
    """Whole numbers, each within its floor and capacity, in proportion to ``shares`` as far as these allow, that sum to
    ``total`` or, where all capacities together are less, to those; floors hold even if they sum to more. What an
    exhausted one leaves goes to the others in proportion to their shares. Remainders go to the largest fractions, ties
    to the earlier."""
    floors = [min(f, c) for f, c in zip(floors, caps)]
    goal = min(max(total, sum(floors)), sum(caps))

    def at(x: float) -> list[float]:
        return [min(max(x * s, f), c) for s, f, c in zip(shares, floors, caps)]

    low, high = 0.0, 1.0
    while sum(at(high)) < goal and high < 1e300:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(at(mid)) < goal else (low, mid)
    real = at(high)
    out = [min(max(floor(q + 1e-9), f), c) for q, f, c in zip(real, floors, caps)]
    order = sorted(range(len(out)), key=lambda i: (out[i] - real[i], i))
    while sum(out) < goal:
        took = False
        for i in order:
            if sum(out) < goal and out[i] < caps[i] and (shares[i] > 0 or all(out[j] >= caps[j] for j in order if shares[j] > 0)):
                out[i] += 1
                took = True
        if not took:
            break
    return out
