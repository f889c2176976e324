"""Chinese-restaurant seating of a Pitman-Yor model, sampled by Gibbs moves, on numpy arrays.

A restaurant is a context.  Its entries are the words seen after it; the customers of an entry are the
word's occurrences there, and they sit at tables that all serve this word.  Every table sends one customer
to the parent restaurant.  Given the parent's probabilities, the weight with which a customer opens a
table of its entry is ``opening``, and a table of s customers draws with weight s - discount.

Every sweep gets all customers of all entries up, in ``STEPS`` steps: an entry of n customers takes min(n, STEPS)
steps of n / min(n, STEPS) customers each, so small entries move one at a time and large ones in equal
shares.  The customers of a step sit down by the weights that hold when they have left: tables opened
are a binomial draw and the others an exact multinomial draw, so a step costs the number of tables and not
the number of customers.  At the start all customers of an entry sit at one table.  The tests hold the number
of tables against its exact distribution and against full one-by-one Gibbs sampling of large entries.
"""

from __future__ import annotations

import numpy as np

#: Discount and strength of the two levels: contexts, and the root that they share.
DISCOUNT, STRENGTH = (0.75, 0.65), (3.0, 4.0)
#: Steps of a sweep.
STEPS = 16


class Seating:
    """Table sizes of the entries of one level; ``tables`` holds their number for each entry."""

    def __init__(self, n: np.ndarray, discount: float, rng: np.random.Generator):
        self.d, self.rng = discount, rng
        self.tables = np.minimum(n, 1).astype(np.float64)
        several = np.flatnonzero(n > 1)  # one customer has one table for ever
        self.entry = several[np.argsort(-n[several], kind="stable")]  # large ones first, so active entries are a prefix
        self.n = n[self.entry].astype(np.int64)
        self.owner, self.size = np.arange(len(self.entry)), self.n.copy()

    def _draw(self, entries: np.ndarray, weight: np.ndarray, start: np.ndarray, total: np.ndarray) -> np.ndarray:
        """A table for each of ``entries`` (with repeats) in proportion to ``weight``."""
        upto = np.cumsum(weight)
        base = np.where(start > 0, upto[start - 1], 0.0)
        end = np.r_[start[1:], len(weight)]
        slot = np.searchsorted(upto, base[entries] + self.rng.random(len(entries)) * total[entries], side="right")
        return np.clip(slot, start[entries], end[entries] - 1)

    def _arrive(self, owner: np.ndarray, size: np.ndarray, many: np.ndarray, opening: np.ndarray):
        """Seat ``many[e]`` customers of each of the first len(many) entries; ``owner`` and ``size`` are their tables."""
        rng, e = self.rng, len(many)
        open_ = size > 0
        owner, size = owner[open_], size[open_]
        weight = size - self.d
        total = np.bincount(owner, weights=weight, minlength=e)
        new = rng.binomial(many, np.clip(opening / np.maximum(total + opening, 1e-300), 0.0, 1.0))
        new = np.where(total > 0, new, many)
        old = many - new
        start = np.searchsorted(owner, np.arange(e))
        # A multinomial draw of ``old``: Poisson counts of a somewhat smaller mean, filled up one by one.
        mean = np.maximum(old - 4 * np.sqrt(old), 0.0)
        drawn = np.zeros(len(size), np.int64)
        if mean.any():
            drawn = rng.poisson((mean / np.maximum(total, 1e-300))[owner] * weight)
            over = np.bincount(owner, weights=drawn, minlength=e) > old
            drawn[over[owner]] = 0
        rest = old - np.bincount(owner, weights=drawn, minlength=e).astype(np.int64)
        who = np.repeat(np.arange(e), rest)
        if len(who):
            drawn += np.bincount(self._draw(who, weight, start, total), minlength=len(size))
        size = size + drawn
        opened = np.repeat(np.arange(e), new)
        at = np.searchsorted(owner, opened, side="right")
        return np.insert(owner, at, opened), np.insert(size, at, 1)

    def _count(self) -> None:
        self.tables[self.entry] = np.bincount(self.owner, minlength=len(self.entry))

    def sweep(self, opening: np.ndarray) -> None:
        """Every customer gets up once, on average, and sits down by the conditional."""
        a, rng = opening[self.entry], self.rng
        for s in range(STEPS):
            active = int(np.searchsorted(-self.n, -s, side="left"))  # entries of more than s customers
            if not active:
                break
            cut = int(np.searchsorted(self.owner, active))
            owner, size = self.owner[:cut], self.size[:cut]
            big = int(np.searchsorted(-self.n, -STEPS, side="left"))
            table = int(np.searchsorted(owner, big))
            left = np.zeros(cut, np.int64)
            left[:table] = rng.binomial(size[:table], 1.0 / STEPS)
            few = np.arange(big, active)
            if len(few):
                start = np.searchsorted(owner, np.arange(active))
                left[self._draw(few, size.astype(np.float64), start, self.n[:active].astype(np.float64))] += 1
            many = np.bincount(owner, weights=left, minlength=active).astype(np.int64)
            owner, size = self._arrive(owner, size - left, many, a[:active])
            self.owner, self.size = np.r_[owner, self.owner[cut:]], np.r_[size, self.size[cut:]]
        self._count()

    def state(self) -> list[np.ndarray]:
        return [np.bincount(self.owner, minlength=len(self.entry)), self.size]

    def resume(self, per_entry: np.ndarray, size: np.ndarray) -> None:
        self.owner, self.size = np.repeat(np.arange(len(self.entry)), per_entry.astype(np.int64)), size.astype(np.int64)
        self._count()


def sample_contexts(seats: Seating, context, n, parent, tables_elsewhere, customers, sweeps: int, keep: int):
    """Sweep the restaurants of some contexts; give the average predictive probability of the last ``keep`` sweeps.

    ``parent`` is the parent's probability of each entry's word, ``customers`` the customers of each
    context in all, ``tables_elsewhere`` the tables that it has in other tasks.
    """
    d, strength = seats.d, STRENGTH[0]
    total, count = np.zeros(len(n)), len(customers)
    for s in range(sweeps):
        opening = (strength + d * (tables_elsewhere + np.bincount(context, weights=seats.tables, minlength=count))[context]) * parent
        seats.sweep(opening)
        if s >= sweeps - keep:
            t = tables_elsewhere + np.bincount(context, weights=seats.tables, minlength=count)
            total += (n - d * seats.tables + (strength + d * t)[context] * parent) / (strength + customers)[context]
    return total / keep if keep else total
