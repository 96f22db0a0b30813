"""Hierarchical Pitman-Yor restaurants over bounded tables of counts.

A restaurant stands for a context and its dishes for what follows. Every customer sits at a
table that serves one dish, and every table is a customer of the parent restaurant, which
all contexts with the same shorter context share. Gibbs sweeps draw the number of tables of
each (restaurant, dish) anew, given all others; what is predicted is averaged over sweeps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Customers up to which a seating is drawn from its exact conditional distribution; those
#: beyond join in blocks of a sixteenth.
EXACT = 256


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: seatings of c customers at t tables,
    weighted by the tables' sizes; row c, column t."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c]
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def drawn_tables(c: np.ndarray, others: np.ndarray, p0: np.ndarray, discount: float, strength: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn given its customers ``c``, the other dishes' tables in the
    restaurant and the parent's probability of the dish."""
    t = np.minimum(c, 1)
    log_p = np.log(p0)
    start = np.minimum(c, EXACT)
    for n in np.unique(start[start > 1]):
        cells = np.flatnonzero(start == n)
        for some in np.array_split(cells, max(1, len(cells) * int(n) // 250_000)):
            opened = np.cumsum(np.log(strength + discount * (others[some, None] + np.arange(n))), axis=1)
            weight = stirling[n, 1 : n + 1] + opened + log_p[some, None] * np.arange(1, n + 1)
            weight = np.exp(weight - weight.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[some] = 1 + (weight < rng.random(len(some))[:, None] * weight[:, -1:]).sum(axis=1)
    large = np.flatnonzero(c > EXACT)
    seated = np.full(len(large), EXACT)
    while len(large):
        more = np.minimum(c[large] - seated, seated // 16)
        fresh = (strength + discount * (others[large] + t[large])) * p0[large]
        t[large] += rng.binomial(more, fresh / (fresh + seated - discount * t[large]))
        seated = seated + more
        left = seated < c[large]
        large, seated = large[left], seated[left]
    return t


class Level:
    """The restaurants of one context length, and their (restaurant, dish) cells."""

    def __init__(self, keys: np.ndarray, parent: np.ndarray, rest: np.ndarray, dish: np.ndarray, own: np.ndarray, up: np.ndarray | None):
        self.keys, self.parent = keys, parent  # contexts, and the place of each one's parent a level up
        self.rest, self.dish, self.own, self.up = rest, dish, own, up
        self.tables = np.ones(len(rest), np.int64)
        self.customers = own

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.rest, values, minlength=len(self.keys))

    def settle(self, below: Level | None) -> None:
        self.customers = self.own + (np.bincount(below.up, below.tables, minlength=len(self.rest)).astype(np.int64) if below else 0)


def build(own: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shorter: Callable[[np.ndarray, int], np.ndarray], dishes: int) -> list[Level]:
    """Levels from the root, of (context, dish, count) at each depth; ``shorter`` gives the
    context of the parent. A dish of a context is a dish of all its parents."""
    codes, counts, keys = [], [], []
    from_below = np.empty(0, np.int64)
    for depth in range(len(own) - 1, -1, -1):
        k, d, n = own[depth]
        known = np.unique(np.concatenate([k, from_below // dishes, np.zeros(int(depth == 0), np.int64)]))
        code, place = np.unique(np.concatenate([k * dishes + d, from_below]), return_inverse=True)
        codes.append(code)
        keys.append(known)
        counts.append(np.bincount(place, np.concatenate([n, np.zeros(len(from_below))]), minlength=len(code)).astype(np.int64))
        from_below = np.unique(shorter(code // dishes, depth) * dishes + code % dishes) if depth else from_below
    codes, counts, keys = codes[::-1], counts[::-1], keys[::-1]
    levels = []
    for depth, (code, n, known) in enumerate(zip(codes, counts, keys)):
        rest = np.searchsorted(known, code // dishes)
        parent = np.searchsorted(keys[depth - 1], shorter(known, depth)) if depth else np.zeros(1, np.int64)
        up = np.searchsorted(codes[depth - 1], shorter(code // dishes, depth) * dishes + code % dishes) if depth else None
        levels.append(Level(known, parent, rest, code % dishes, n, up))
    return levels


class Restaurants:
    """The whole hierarchy: a uniform base of ``dishes`` dishes above the root."""

    def __init__(self, levels: list[Level], dishes: int, strength: float = 1.0, seed: int = 1):
        self.levels, self.dishes, self.strength = levels, dishes, strength
        self.rng = np.random.default_rng(seed)
        self.settle()
        self.discounts = []
        for level in levels:
            once, twice = (int((level.customers == k).sum()) for k in (1, 2))
            self.discounts.append(float(np.clip(once / max(1, once + 2 * twice), 0.05, 0.95)))
        self.stirling = [log_stirling(d) for d in self.discounts]

    def settle(self) -> None:
        below = None
        for level in reversed(self.levels):
            level.settle(below)
            level.tables = np.minimum(level.tables, level.customers)
            below = level

    def _seen_from(self, depth: int) -> np.ndarray:
        """The probability of each cell of a level."""
        level, d = self.levels[depth], self.discounts[depth]
        c, t = level.customers, level.tables
        above = self._seen_from(depth - 1)[level.up] if depth else np.full(len(c), 1 / self.dishes)
        all_c, all_t = level.sums(c)[level.rest], level.sums(t)[level.rest]
        return (np.maximum(c - d * t, 0) + (self.strength + d * all_t) * above) / (all_c + self.strength)

    def sweep(self) -> None:
        """Draw the tables of every cell once, the deepest restaurants first.

        The cells of a level are drawn at once, given the last draw of the others. The
        customers that a cell itself sends are taken out of the parent's probability.
        """
        for depth in range(len(self.levels) - 1, -1, -1):
            self.settle()
            level = self.levels[depth]
            others = level.sums(level.tables)[level.rest] - level.tables
            if depth:
                p0 = self._parent_without(depth)
            else:
                p0 = np.full(len(level.rest), 1 / self.dishes)
            level.tables = drawn_tables(level.customers, others, p0, self.discounts[depth], self.strength, self.stirling[depth], self.rng)
        self.settle()

    def _parent_without(self, depth: int) -> np.ndarray:
        level, above, d = self.levels[depth], self.levels[depth - 1], self.discounts[depth - 1]
        up = level.up
        c = above.customers[up] - level.tables
        t = np.minimum(above.tables[up], c)
        all_c, all_t = above.sums(above.customers)[above.rest][up] - level.tables, above.sums(above.tables)[above.rest][up]
        higher = self._seen_from(depth - 2)[above.up][up] if depth > 1 else 1 / self.dishes
        return (np.maximum(c - d * t, 0) + (self.strength + d * all_t) * higher) / (all_c + self.strength)

    def tables_of_probabilities(self) -> list[np.ndarray]:
        """(restaurants, dishes) of each level: what each context predicts now."""
        out, above = [], np.full((1, self.dishes), 1 / self.dishes)
        for level, d in zip(self.levels, self.discounts):
            c, t = level.customers, level.tables
            total = level.sums(c) + self.strength
            above = above[level.parent] * ((self.strength + d * level.sums(t)) / total)[:, None]
            above[level.rest, level.dish] += np.maximum(c - d * t, 0) / total[level.rest]
            out.append(above)
        return out

    def averaged(self, sweeps: int, burn: int) -> list[np.ndarray]:
        """Predictive probabilities, averaged over the sweeps after the first ``burn``."""
        total: list[np.ndarray] = []
        for k in range(sweeps):
            self.sweep()
            if k >= burn:
                now = self.tables_of_probabilities()
                total = [np.add(a, b, out=a) for a, b in zip(total, now)] if total else now
                del now
        return [np.divide(a, sweeps - burn, out=a) for a in total]
