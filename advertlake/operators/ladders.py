"""Order statistics of many capped sets of comparables over sorted lists, without a matrix of targets by candidates.

Targets of one kind share their candidates. Moving prices to a target's mileage keeps the order of the rows of known mileage (by price and own mileage) and
leaves the others as they are, so two sorted lists serve all targets of known mileage, and one serves the rest. Places, counts and ranks are then found by
bisection, in steps that grow with the logarithm of the candidates. Only rows of sellers with more than max_per_seller rows depend on the target: those, and
no others, are taken as a matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from advertlake.operators.cells import Cell, _runs

MOST = 2  # rows of a seller that are counted; pairs below rest on it


class Counts:
    """Points in the order of their places with whole values: how many of a span of places lie below a value, and the value of a rank (a wavelet matrix)."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.before = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.before.append(np.r_[0, np.cumsum(~one)])
            values = np.r_[values[~one], values[one]]

    def below(self, a: np.ndarray, z: np.ndarray, value: np.ndarray) -> np.ndarray:
        all_, total = value >= 1 << self.bits, 0
        whole = z - a
        for level, before in enumerate(self.before):
            one, n = (value >> (self.bits - 1 - level)) & 1 == 1, before[-1]
            a0, z0 = before[a], before[z]
            total = total + np.where(one, z0 - a0, 0)
            a, z = np.where(one, a - a0 + n, a0), np.where(one, z - z0 + n, z0)
        return np.where(all_, whole, total)

    def at(self, a: np.ndarray, z: np.ndarray, rank: np.ndarray, further: Callable) -> np.ndarray:
        """The value of this 0-based rank among the points of the span and further ones: further(low, high) counts those of a value in [low, high)."""
        value = np.zeros(len(rank), np.int64)
        for level, before in enumerate(self.before):
            mid, n = value + (1 << (self.bits - 1 - level)), before[-1]
            a0, z0 = before[a], before[z]
            low = z0 - a0 + further(value, mid)
            up = rank >= low
            rank = np.where(up, rank - low, rank)
            a, z, value = np.where(up, a - a0 + n, a0), np.where(up, z - z0 + n, z0), np.where(up, mid, value)
        return value


class Ladder:
    """The candidates (cols) of targets of one kind as sorted lists. moved: the targets' mileage is known, and prices are moved to it."""

    def __init__(self, cell: Cell, cols: np.ndarray, moved: bool):
        self.cell, self.slope = cell, cell.s.km_adjust_per_10k
        price, km, seller = cell.price[cols], cell.km[cols], cell.seller[cols]
        logs = np.log(price)
        first = np.zeros(len(cols), bool) if not moved else ~np.isnan(km)
        key = np.where(first, logs + self.slope * km / 10000, price) if moved else price
        order = np.lexsort((key, ~first))
        self.mid = int(first.sum())
        self.rows = cols[order]
        self.price, self.km, self.seller = price[order], km[order], seller[order]
        self.steps, self.log_rest, self.rest = key[order][: self.mid], logs[order][self.mid :], self.price[self.mid :]
        self.place = np.empty(len(cols), np.int64)
        self.place[order] = np.arange(len(cols))
        start, size = _runs(seller)
        each = np.repeat(size, size)
        self.many = np.flatnonzero(each > MOST)  # in the order of sellers
        self.many_place = self.place[self.many]
        base = (each <= MOST)[order]
        self.base, self.sums = base, _sums(base)
        self.idle, self.unknown = _sums(base & ~cell.active[self.rows]), _sums(base & (self.seller < 0))
        self.years = np.unique(cell.year[self.rows])
        self.by_year = [_sums(base & (cell.year[self.rows] == y)) for y in self.years]
        known = base & ~np.isnan(self.km)
        self.kms, code = np.unique(self.km, return_inverse=True)
        self.kms = self.kms[~np.isnan(self.kms)]
        self.code = np.where(np.isnan(self.km), -1, code.reshape(-1))
        self.known, self.by_km = _sums(known), Counts(self.code[known], len(self.kms))
        two = start[(size == 2) & (seller[start] >= 0)] if len(start) else start
        a, b = self.place[two], self.place[two + 1] if len(two) else self.place[:0]
        self.partner = np.full(len(cols), -1)
        self.partner[a], self.partner[b] = b, a
        low, high = np.minimum(a, b), np.maximum(a, b)
        by = np.argsort(low)
        self.pair_low, self.pairs = low[by], Counts(high[by], len(cols))

    def ask(self, targets: np.ndarray, own: np.ndarray) -> Asked:
        """own: the place of a target's own row, -1 where it is no candidate."""
        return Asked(self, targets, own)


class Asked:
    """Questions of targets to a ladder: what is counted for each, and where. Whoever asks is named by an index (who)."""

    def __init__(self, ladder: Ladder, targets: np.ndarray, own: np.ndarray):
        self.l, self.targets, self.own = ladder, targets, own
        cell = ladder.cell
        self.t_km = cell.t_km[targets]
        self.shift = ladder.slope * self.t_km / 10000
        self.own_base = (own >= 0) & ladder.base[own]
        rows = ladder.rows[ladder.many_place]
        self.kept = cell.capped(targets, rows) if len(rows) else np.zeros((len(targets), 0), bool)
        by = np.argsort(ladder.many_place)
        self.sums = np.zeros((len(targets), len(rows) + 1), np.int32)
        np.cumsum(self.kept[:, by], axis=1, out=self.sums[:, 1:])
        self.own_at = np.where(self.own_base, own, len(ladder.rows))  # beyond all places: no row is left out

    def count(self, who: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Counted rows before a place."""
        n = self.l.sums[place]
        return n + self.sums[who, place - n] - (self.own_at[who] < place)

    def value(self, who: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The price at a place, moved to the mileage of who asks."""
        price = self.l.price[place]
        if not self.l.mid:
            return price
        adj = price * np.exp(-self.l.slope * (self.t_km[who] - self.l.km[place]) / 10000)
        return np.where(np.isnan(adj), price, adj)

    def _nth(self, who: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The place of the n-th counted row, from 1."""
        return _bisect(np.zeros(len(n), np.int64), np.full(len(n), len(self.l.rows)), lambda i, p: self.count(who[i], p + 1) < n[i], n > 0)

    def at(self, who: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The price of this 0-based rank among the counted rows of both lists."""
        lad = self.l
        mid = np.full(len(who), lad.mid)
        upto = self.count(who, mid)

        def early(i: np.ndarray, p: np.ndarray) -> np.ndarray:
            w = who[i]
            j = lad.mid + np.searchsorted(lad.log_rest, lad.steps[p] - self.shift[w])
            return self.count(w, p) + self.count(w, j) - upto[i] <= rank[i]

        a = self.count(who, _bisect(np.zeros(len(who), np.int64), mid, early)) if lad.mid else np.zeros(len(who), np.int64)
        b = rank + 1 - a
        last = len(lad.rows) - 1
        x, y = (self.value(who, np.minimum(self._nth(who, n), last)) for n in (a, upto + b))
        return np.where(a == 0, y, np.where(b == 0, x, np.maximum(x, y)))

    def quantiles(self, who: np.ndarray, start: np.ndarray | int, n: np.ndarray, *shares: float) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The quantiles of n prices from a rank on, ends included, and the two prices that the first one lies between."""
        ends = [f((n - 1) * x) for x in shares for f in (np.floor, np.ceil)]
        got = self.at(np.tile(who, len(ends)), np.concatenate([start + e.astype(np.int64) for e in ends])).reshape(len(ends), -1)
        out = []
        for x, low, high, a, b in zip(shares, ends[::2], ends[1::2], got[::2], got[1::2], strict=True):
            at = (n - 1) * x
            out.append(np.where(low == high, a, (high - at) * a + (at - low) * b))
        return out, (got[0], got[1])

    def spans(self, who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the rows of prices from lo to hi are: start and end in the first list, start and end in the other."""
        lad = self.l
        zero, mid = np.zeros(len(who), np.int64), np.full(len(who), lad.mid)
        a = _bisect(zero, mid, lambda i, p: self.value(who[i], p) < lo[i])
        z = _bisect(zero, mid, lambda i, p: self.value(who[i], p) <= hi[i])
        return np.stack([a, np.maximum(a, z), (c := lad.mid + np.searchsorted(lad.rest, lo)), np.maximum(c, lad.mid + np.searchsorted(lad.rest, hi, "right"))])

    def inside(self, who: np.ndarray, span: np.ndarray) -> np.ndarray:
        """The matrix rows that are counted within the spans."""
        a, z, c, e = (x[:, None] for x in span)
        p = self.l.many_place
        return self.kept[who] & ((p >= a) & (p < z) | (p >= c) & (p < e))

    def own_in(self, who: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Whether the own row, one of those outside the matrix, lies in the spans."""
        return self.own_base[who] & _within(self.own[who], span)

    def total(self, who: np.ndarray, span: np.ndarray, inside: np.ndarray, sums: np.ndarray, mark: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """How many counted rows of a mark lie in the spans. sums: of the marked rows outside the matrix. mark: of rows by place."""
        n = sums[span[1]] - sums[span[0]] + sums[span[3]] - sums[span[2]]
        n = n - (self.own_in(who, span) & mark(self.own[who]))
        return n + inside[:, mark(self.l.many_place)].sum(1) if inside.shape[1] else n

    def sellers(self, who: np.ndarray, span: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Known sellers within the spans."""
        lad = self.l
        n = self.total(who, span, inside, lad.sums - lad.unknown, lambda p: lad.seller[p] >= 0)
        if inside.shape[1]:
            start, size = _runs(lad.seller[lad.many_place])
            known = lad.seller[lad.many_place[start]] >= 0
            n = n - inside[:, np.repeat(known, size)].sum(1) + np.logical_or.reduceat(inside, start, axis=1)[:, known].sum(1)
        if not len(lad.pair_low):
            return n

        def both(a: np.ndarray, z: np.ndarray, c: np.ndarray, e: np.ndarray) -> np.ndarray:
            a, z = np.searchsorted(lad.pair_low, a), np.searchsorted(lad.pair_low, z)
            return lad.pairs.below(a, z, e) - lad.pairs.below(a, z, c)

        a, z, c, e = span
        pairs = both(c, e, c, e)
        if lad.mid:
            pairs = pairs + both(a, z, a, z) + both(a, z, c, e)
        other = lad.partner[self.own[who]]
        return n - pairs + (self.own_in(who, span) & (other >= 0) & _within(other, span))

    def years(self, who: np.ndarray, span: np.ndarray, inside: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Median year of n rows within the spans."""
        year = self.l.cell.year[self.l.rows]
        upto = np.cumsum([self.total(who, span, inside, sums, lambda p, y=y: year[p] == y) for y, sums in zip(self.l.years, self.l.by_year, strict=True)], axis=0)
        return _between((n - 1) * 0.5, lambda rank: self.l.years[(upto <= rank).sum(0)])

    def mileages(self, who: np.ndarray, span: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of mileages above 0 within the spans, their median, and how many known ones lie near the target's."""
        lad = self.l
        at = span[:2] if lad.mid else span[2:]
        a, z = lad.known[at[0]], lad.known[at[1]]
        own = np.where(self.own_in(who, span), lad.code[self.own[who]], -1)
        code = lad.code[lad.many_place]
        by = np.argsort(code, kind="stable")
        sums = np.zeros((len(who), len(by) + 1), np.int32)
        np.cumsum(inside[:, by], axis=1, out=sums[:, 1:])
        upto = np.searchsorted(code[by], np.arange(len(lad.kms) + 2))
        row, last = np.arange(len(who)), len(lad.kms) + 1

        def further(low: np.ndarray, high: np.ndarray, i: np.ndarray = row) -> np.ndarray:
            return sums[i, upto[np.minimum(high, last)]] - sums[i, upto[np.minimum(low, last)]] - ((own[i] >= low) & (own[i] < high))

        def below(code: np.ndarray) -> np.ndarray:
            return lad.by_km.below(a, z, code) + further(np.zeros(len(who), np.int64), code)

        top = np.full(len(who), len(lad.kms))
        none = below(np.full(len(who), np.searchsorted(lad.kms, 0, "right")))
        n = below(top) - none
        some = np.flatnonzero(n > 0)
        median = np.full(len(who), np.nan)
        median[some] = _between((n[some] - 1) * 0.5, lambda rank: lad.kms[lad.by_km.at(a[some], z[some], (none[some] + rank).astype(np.int64), lambda x, y: further(x, y, some))])
        near = self.l.cell.s.km_near_limit
        t_km = np.nan_to_num(self.t_km[who])
        return n, median, below(np.searchsorted(lad.kms, t_km + near, "right")) - below(np.searchsorted(lad.kms, t_km - near))

    def spread(self, who: np.ndarray, span: np.ndarray, mid: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Median distance of the logarithms of n rows within the spans from mid; most: the largest."""
        lad = self.l

        def at(i: np.ndarray, rank: np.ndarray) -> np.ndarray:
            """The distance of this 0-based rank: halved until no number lies between."""
            w, m, (a, z, c, e), low, high = who[i], mid[i], span[:, i], np.zeros(len(i)), most[i] * (1 + 1e-12) + 1e-15
            far = m + self.shift[w] if lad.mid else m
            for _ in range(53):
                r = (low + high) / 2
                k = _count_in(self, w, c, e, lad.mid + np.searchsorted(lad.log_rest, m - r), lad.mid + np.searchsorted(lad.log_rest, m + r, "right"))
                if lad.mid:
                    k = k + _count_in(self, w, a, z, np.searchsorted(lad.steps, far - r), np.searchsorted(lad.steps, far + r, "right"))
                enough = k > rank
                low, high = np.where(enough, low, r), np.where(enough, r, high)
            return high

        half = (n - 1) // 2
        out = at(np.arange(len(who)), half)
        even = np.flatnonzero(n % 2 == 0)
        out[even] = (out[even] + at(even, half[even] + 1)) / 2
        return out


def _count_in(asked: Asked, who: np.ndarray, a: np.ndarray, z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    low = np.minimum(np.maximum(a, low), z)
    return asked.count(who, np.maximum(low, np.minimum(z, high))) - asked.count(who, low)


def _sums(mark: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(mark)]


def _within(place: np.ndarray, span: np.ndarray) -> np.ndarray:
    a, z, c, e = span
    return (place >= a) & (place < z) | (place >= c) & (place < e)


def _between(at: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The value at a rank that may lie between two."""
    low, high = np.floor(at), np.ceil(at)
    a, b = of(low), of(high)
    return np.where(low == high, a, (high - at) * a + (at - low) * b)


def _bisect(low: np.ndarray, high: np.ndarray, true: Callable[[np.ndarray, np.ndarray], np.ndarray], ask: np.ndarray | None = None) -> np.ndarray:
    """The first place from low on where true() no longer holds, high where it always does; true(i, place) of the i-th."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high) if ask is None else np.flatnonzero(ask & (low < high))
    while len(open_):
        p = (low[open_] + high[open_]) // 2
        up = true(open_, p)
        low[open_[up]] = p[up] + 1
        high[open_[~up]] = p[~up]
        open_ = open_[low[open_] < high[open_]]
    return low


_YEAR, _UNKNOWN, _LOW = 1e11, 5e10, -4e10  # a node's key: year, then mileage; beyond all mileages


def nearest(cell: Cell, like: np.ndarray, cols: np.ndarray, rank: np.ndarray, k: int) -> list[np.ndarray]:
    """For targets of one kind: target, rank from 1, row and distance of its k nearest candidates. Targets have a price above 0. rank: of all rows by id.

    Rows lie in nodes of one year and mileage, by price. Of equal rows only the first by id can be wanted. The rows around the target's place give a
    bound of the distance; only what lies within it is compared."""
    known = (~np.isnan(cell.t_km[like]) & (cell.t_km[like] != 0))
    parts = [_nearest(cell, own, cols, rank, k, moved) for own, moved in ((like[known], True), (like[~known], False)) if len(own)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _nearest(cell: Cell, like: np.ndarray, cols: np.ndarray, rank: np.ndarray, k: int, moved: bool) -> list[np.ndarray]:
    km = np.where(moved & ~np.isnan(cell.km[cols]) & (cell.km[cols] != 0), cell.km[cols], _UNKNOWN)
    key = (cell.year[cols] - cell.year[cols].min()) * _YEAR + km
    order = np.lexsort((rank[cols], cell.price[cols], key))
    start, size = _runs_of(key[order], cell.price[cols][order])
    wanted = np.arange(len(cols)) - np.repeat(start, size) < k + np.bincount(cell.key[cols]).max()
    rows, key = cols[order][wanted], key[order][wanted]
    price = cell.price[rows]
    start, size = _runs_of(key)
    nodes, node_year, node_km = key[start], cell.year[rows[start]], km[order][wanted][start]
    t_year, t_km, t_price = cell.t_year[like], np.where(moved, cell.t_km[like], _UNKNOWN), cell.t_price[like]
    first = cell.year[cols].min()

    def distance(i: np.ndarray, at: np.ndarray) -> np.ndarray:
        """As in the matrix: of the i-th targets and the rows at these places; the target itself is infinitely far."""
        apart = np.abs(cell.km[rows[at]] - cell.t_km[like[i]]) / 30000
        apart = np.where(np.isnan(apart) | (cell.km[rows[at]] == 0) | (cell.t_km[like[i]] == 0), 1.0, apart)
        d = np.abs(cell.year[rows[at]] - t_year[i]) + apart + 0.1 * np.abs(price[at] - t_price[i]) / t_price[i]
        return np.where(cell.key[rows[at]] == cell.t_key[like[i]], np.inf, d)

    who = np.arange(len(like))
    node = np.minimum(np.searchsorted(nodes, (t_year - first) * _YEAR + t_km), len(nodes) - 1)
    place = _bisect(start[node], start[node] + size[node], lambda i, p: price[p] < t_price[i])
    around = place[:, None] + np.arange(-k - 3, k + 3)
    inside = (around >= 0) & (around < len(rows))
    d = np.where(inside, distance(np.repeat(who, around.shape[1]), np.clip(around, 0, len(rows) - 1).ravel()).reshape(around.shape), np.inf)
    most = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-9

    pairs = []
    for year in np.unique(node_year):
        left = most - np.abs(year - t_year)
        low, high = (np.searchsorted(nodes, (year - first) * _YEAR + np.clip(t_km + f * 30000 * left, _LOW, _UNKNOWN - 1), side) for f, side in ((-1, "left"), (1, "right")))
        i, n = _spread(np.where((left >= 0) & (t_km < _UNKNOWN), low, 0), np.where((left >= 0) & (t_km < _UNKNOWN), high, 0))
        other = np.searchsorted(nodes, (year - first) * _YEAR + _UNKNOWN)
        far = np.flatnonzero(left >= 1) if other < len(nodes) and nodes[other] == (year - first) * _YEAR + _UNKNOWN else who[:0]
        pairs += [(i, n), (far, np.full(len(far), other))]
    i, n = (np.concatenate(c) for c in zip(*pairs, strict=True))
    apart = np.where((node_km[n] == _UNKNOWN) | (t_km[i] == _UNKNOWN), 1.0, np.abs(node_km[n] - t_km[i]) / 30000)
    reach = (most[i] - np.abs(node_year[n] - t_year[i]) - apart + 1e-9) * 10 * t_price[i]
    low = _bisect(start[n], start[n] + size[n], lambda j, p: price[p] < t_price[i[j]] - reach[j])
    high = _bisect(start[n], start[n] + size[n], lambda j, p: price[p] <= t_price[i[j]] + reach[j])
    order = np.argsort(i, kind="stable")
    i, low, high = i[order], low[order], np.maximum(low, high)[order]
    out = []
    for part in _cut(i, high - low):
        j, at = _spread(low[part], high[part])
        w = i[part][j]
        d = distance(w, at)
        near = (d <= most[w]) & (d < np.inf)
        w, at, d = w[near], at[near], d[near]
        by = np.lexsort((rank[rows[at]], d, w))
        w, at, d = w[by], at[by], d[by]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        out.append([like[w[place < k]], place[place < k] + 1, rows[at[place < k]], d[place < k]])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]


def _runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that are equal in all keys."""
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
    start = np.flatnonzero(new)
    return start, np.diff(np.r_[start, len(new)])


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from low up to high, and whose they are."""
    n = np.maximum(high - low, 0)
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + low[who]


def _cut(who: np.ndarray, n: np.ndarray, most: int = 1 << 21) -> list[slice]:
    """Slices of about so many entries at most, each with all that belongs to its targets."""
    group = np.cumsum(n) // most
    last = np.flatnonzero(np.r_[who[1:] != who[:-1], True]) + 1
    ends = last[np.flatnonzero(np.diff(np.r_[group[last - 1], -1]))]
    return [slice(a, z) for a, z in zip(np.r_[0, ends[:-1]], ends, strict=True)] if len(who) else []
