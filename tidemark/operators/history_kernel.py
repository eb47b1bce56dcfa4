"""The history features of many customers at once, from structures that answer questions about any range of rows.

Rows come sorted by customer and order, so the past of a row, whether the newest 512 rows, a drawn number of them or
all, is the range [lo, i) of rows before it. Counts and sums over ranges are prefix sums or a tree of moments, medians and ranks come from a
wavelet matrix, distinct values from a wavelet matrix over the places of each value's occurrence before, and conditions on keys
from rows sorted by key. A time window is one range for each stretch of rows whose times do not fall (order is phase
first, so a customer has as many as phases at most). All rows are answered together in numpy, in about log(rows) steps each,
whatever the length of the past.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np

DAY = 86_400
#: The least denominator of the ratios that have one.
TINY = 1e-9
Ranges = list[tuple[np.ndarray, np.ndarray]]


class Moments:
    """Tree over numbers, of which some count: number, mean, sum of squared deviations, least and largest over ranges."""

    def __init__(self, values: np.ndarray, counts: np.ndarray | None = None):
        size = 1 << max(0, (max(1, len(values)) - 1).bit_length())
        self.size = size
        n, mean, spread = np.zeros(2 * size), np.zeros(2 * size), np.zeros(2 * size)
        low, high = np.full(2 * size, np.inf), np.full(2 * size, -np.inf)
        own = np.ones(len(values), bool) if counts is None else counts
        at = np.flatnonzero(own) + size
        n[at], mean[at], low[at], high[at] = 1.0, values[own], values[own], values[own]
        self.parts = (n, mean, spread, low, high)
        while size > 1:
            left, right, up = slice(size, 2 * size, 2), slice(size + 1, 2 * size, 2), slice(size // 2, size)
            for part, merged in zip(self.parts, self._merged(*[tuple(p[s] for p in self.parts) for s in (left, right)])):
                part[up] = merged
            size //= 2

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        apart = b[1] - a[1]
        share = b[0] / np.maximum(n, 1.0)
        mean = np.where(a[0] == 0, b[1], a[1] + apart * share)
        spread = a[2] + b[2] + np.where((a[0] > 0) & (b[0] > 0), apart * apart * a[0] * share, 0.0)
        return n, mean, spread, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])

    def over(self, ranges: Ranges) -> dict[str, np.ndarray]:
        rows = len(ranges[0][0])
        out = [np.zeros(rows), np.zeros(rows), np.zeros(rows), np.full(rows, np.inf), np.full(rows, -np.inf)]

        def take(which: np.ndarray, nodes: np.ndarray) -> None:
            for o, merged in zip(out, self._merged(tuple(o[which] for o in out), tuple(p[nodes] for p in self.parts))):
                o[which] = merged

        for first, last in ranges:
            l, r = first + self.size, np.maximum(first, last) + self.size
            rows_left = np.flatnonzero(l < r)
            l, r = l[rows_left], r[rows_left]
            while len(rows_left):
                odd = (l & 1).astype(bool)
                take(rows_left[odd], l[odd])
                l = (l + 1) >> 1
                odd = (r & 1).astype(bool)
                take(rows_left[odd], r[odd] - 1)
                r = r >> 1
                go = l < r
                rows_left, l, r = rows_left[go], l[go], r[go]
        n, mean, spread, low, high = out
        some = n > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            return {
                "n": n, "sum": n * mean, "mean": np.where(some, mean, np.nan), "std": np.where(n > 1, np.sqrt(spread / (n - 1)), np.nan),
                "min": np.where(some, low, np.nan), "max": np.where(some, high, np.nan),
            }


class Ranks:
    """Wavelet matrix: the k-th smallest value of some ranges together, and how many are below a value."""

    def __init__(self, values: np.ndarray):
        self.values, ranks = np.unique(values, return_inverse=True)
        self.bits = max(1, int(len(self.values)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (ranks >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))).astype(np.int32))
            ranks = np.concatenate((ranks[~one], ranks[one]))

    def kth(self, ranges: Ranges, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) in each row's ranges; NaN where they have fewer."""
        k, rank = k.astype(np.int64), np.zeros(len(k), np.int64)
        now = [(a, np.maximum(a, b)) for a, b in ranges]
        there = (k >= 0) & (k < sum(b - a for a, b in now))
        for zeros in self.zeros:
            low = [(zeros[a], zeros[b]) for a, b in now]
            n = sum(b.astype(np.int64) - a for a, b in low)
            up = k >= n
            total = zeros[-1]
            now = [(np.where(up, total + a - x, x), np.where(up, total + b - y, y)) for (a, b), (x, y) in zip(now, low)]
            k = np.where(up, k - n, k)
            rank = rank << 1 | up
        if not len(self.values):
            return np.full(len(k), np.nan)
        return np.where(there, self.values[np.minimum(rank, len(self.values) - 1)], np.nan)

    def below(self, ranges: Ranges, value: np.ndarray, side: str = "left") -> np.ndarray:
        """How many values of each row's ranges are below its own value (at or below, for the right side)."""
        rank = np.searchsorted(self.values, value, side)
        now = [(a, np.maximum(a, b)) for a, b in ranges]
        out = np.zeros(len(value), np.int64)
        for bit, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            up = (rank >> bit & 1).astype(bool)
            low = [(zeros[a], zeros[b]) for a, b in now]
            out += np.where(up, sum(b.astype(np.int64) - a for a, b in low), 0)
            total = zeros[-1]
            now = [(np.where(up, total + a - x, x), np.where(up, total + b - y, y)) for (a, b), (x, y) in zip(now, low)]
        return out


class Keyed:
    """The rows of each key, in order; ``of`` turns ranges of rows into ranges of the rows with each row's own key."""

    def __init__(self, codes: np.ndarray, kept: np.ndarray | None = None):
        self.codes, self.rows = codes, len(codes)
        there = codes >= 0 if kept is None else (codes >= 0) & kept
        at = np.flatnonzero(there)
        self.places = at[np.argsort(codes[at], kind="stable")]
        self.keys = codes[self.places] * (self.rows + 1) + self.places

    def of(self, ranges: Ranges) -> Ranges:
        own = np.where(self.codes >= 0, self.codes, 0) * (self.rows + 1)
        none = self.codes < 0
        out = []
        for a, b in ranges:
            x = np.searchsorted(self.keys, own + a)
            out.append((x, np.where(none, x, np.maximum(x, np.searchsorted(self.keys, own + b)))))
        return out

    def count(self, ranges: Ranges) -> np.ndarray:
        return sum(b - a for a, b in self.of(ranges))

    @cached_property
    def before(self) -> np.ndarray:
        """The place of each row's key before it, -1 for none; -2 for rows that are not kept."""
        out = np.full(self.rows, -2, np.int64)
        same = np.concatenate(([False], self.codes[self.places[1:]] == self.codes[self.places[:-1]])) if len(self.places) else np.zeros(0, bool)
        out[self.places] = np.where(same, np.concatenate(([0], self.places[:-1])) if len(self.places) else 0, -1)
        return out

    def distinct(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Different keys among the kept rows of one range a row: those without an occurrence before in the range."""
        kept = np.concatenate(([0], np.cumsum(self.before > -2)))
        a, b = kept[first], kept[np.maximum(first, last)]
        return Ranks(self.before[self.before > -2]).below([(a, b)], first)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of pairs of codes; a pair with a missing part is missing."""
    return np.where((a >= 0) & (b >= 0), a * (int(b.max(initial=0)) + 1) + b, -1)


def last_marked(marks: np.ndarray) -> np.ndarray:
    """For each place, the last marked place before it; -1 for none."""
    at = np.where(marks, np.arange(len(marks)), -1)
    return np.concatenate(([-1], np.maximum.accumulate(at)[:-1])) if len(marks) else at


def run_starts(new: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


class History:
    """Features over the ranges [lo, i). ``column`` gives t, amt (missing: NaN), key codes (missing: -1) and flags by name."""

    def __init__(self, opens: np.ndarray, column: Callable[[str], np.ndarray], cap: int | None = None, lengths: np.ndarray | None = None):
        n = len(opens)
        self.column, self.i = column, np.arange(n)
        self.opens = opens
        self.lo = run_starts(opens)
        for limit in (cap, lengths):
            if limit is not None:
                self.lo = np.maximum(self.lo, self.i - np.maximum(limit, 0))
        self.n = self.i - self.lo
        self.past: Ranges = [(self.lo, self.i)]
        self._kept: dict = {}

    def _once(self, key: tuple, make: Callable):
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    # ---- ranges

    @cached_property
    def timed(self) -> np.ndarray:
        return ~np.isnan(self.column("t"))

    @cached_property
    def paid(self) -> np.ndarray:
        return ~np.isnan(self.column("amt"))

    @cached_property
    def _stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Times with gaps filled, stretch of each row, stretch starts (and the end), and how many a customer has at most."""
        t, rows = self.column("t"), len(self.i)
        known = last_marked(self.timed)
        start = run_starts(self.opens)
        filled = np.where(self.timed, t, np.where(known >= start, t[known], -np.inf))
        new = self.opens | np.concatenate(([True], filled[1:] < filled[:-1]))[:rows]
        stretch = np.cumsum(new) - 1
        return filled, stretch, np.append(np.flatnonzero(new), rows), int((stretch - stretch[start]).max(initial=0)) + 1

    def since(self, seconds: int) -> Ranges:
        """Ranges of the past at or after the row's time less so many seconds, with rows without a time among them; none for a row without a time."""

        def make() -> Ranges:
            filled, stretch, starts, most = self._stretches
            levels, rank = np.unique(filled, return_inverse=True)
            keys = stretch * (len(levels) + 1) + rank
            bound = np.searchsorted(levels, self.column("t") - seconds)
            out = []
            for back in range(most):
                s = stretch - back
                there = (s >= 0) & self.timed
                s = np.maximum(s, 0)
                a = np.maximum(np.maximum(self.lo, starts[s]), np.searchsorted(keys, s * (len(levels) + 1) + bound))
                b = np.minimum(self.i, starts[s + 1])
                out.append((a, np.where(there, np.maximum(a, b), a)))
            return out

        return self._once(("since", seconds), make)

    def tail(self, first: np.ndarray, last: np.ndarray, size: int) -> Ranges:
        return [(np.maximum(first, last - size), last)]

    # ---- counts and structures

    def counted(self, marks: np.ndarray, ranges: Ranges) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(marks)))
        return sum(sums[np.maximum(a, b)] - sums[a] for a, b in ranges)

    def keyed(self, *names: str, timed: bool = False, paid: bool = False, flag: str | None = None) -> Keyed:
        def make() -> Keyed:
            codes = self.column(names[0])
            for name in names[1:]:
                codes = paired(codes, self.column(name))
            kept = np.ones(len(codes), bool)
            for wanted, marks in ((timed, lambda: self.timed), (paid, lambda: self.paid), (flag, lambda: self.column(flag))):
                if wanted:
                    kept = kept & marks()
            return Keyed(codes, kept)

        return self._once(("keyed", names, timed, paid, flag), make)

    def amounts(self, seconds: int) -> dict[str, np.ndarray]:
        """Moments of the amounts since so many seconds."""
        tree = self._once(("timed amounts",), lambda: Moments(self.column("amt"), self.timed & self.paid))
        return self._once(("amounts", seconds), lambda: tree.over(self.since(seconds)))

    @cached_property
    def _paid_past(self) -> tuple[np.ndarray, np.ndarray]:
        """The past as a range of the rows with an amount."""
        sums = np.concatenate(([0], np.cumsum(self.paid)))
        return sums[self.lo], sums[self.i]

    @cached_property
    def _paid_values(self) -> np.ndarray:
        return self.column("amt")[self.paid]

    @cached_property
    def _paid_tree(self) -> Moments:
        return Moments(self._paid_values)

    @cached_property
    def all_amounts(self) -> dict[str, np.ndarray]:
        return self._paid_tree.over([self._paid_past])

    @cached_property
    def _paid_ranks(self) -> Ranks:
        return Ranks(self._paid_values)

    def nth_amount(self, k: np.ndarray) -> np.ndarray:
        return self._paid_ranks.kth([self._paid_past], k)

    def median(self, ranks: Ranks, ranges: Ranges) -> np.ndarray:
        size = sum(b - a for a, b in ranges)
        return (ranks.kth(ranges, (size - 1) // 2) + ranks.kth(ranges, size // 2)) / 2

    @cached_property
    def _timed_past(self) -> tuple[np.ndarray, np.ndarray]:
        sums = np.concatenate(([0], np.cumsum(self.timed)))
        return sums[self.lo], sums[self.i]

    @cached_property
    def _times(self) -> np.ndarray:
        return self.column("t")[self.timed]

    @cached_property
    def _gaps(self) -> np.ndarray:
        """The time between each row with a time and the one before it."""
        return np.diff(self._times, prepend=self._times[:1])

    @cached_property
    def _gap_tree(self) -> Moments:
        return Moments(self._gaps)

    def gap(self, back: int) -> np.ndarray:
        """The newest gap of the past, or the one before it and so on; NaN where the past has too few."""
        a, b = self._timed_past
        return np.where(b - a > back, self._gaps[np.maximum(b - back, 0)] if len(self._gaps) else np.nan, np.nan) if len(self._gaps) else np.full(len(a), np.nan)

    def gaps(self, newest: int | None = None) -> dict[str, np.ndarray]:
        a, b = self._timed_past
        first = np.minimum(a + 1, b)
        return self._gap_tree.over(self.tail(first, b, newest) if newest else [(first, b)])

    @cached_property
    def span(self) -> np.ndarray:
        found = self._once(("times",), lambda: Moments(self._times)).over([self._timed_past])
        return found["max"] - found["min"]

    def same_mcc(self, what: str) -> dict[str, np.ndarray]:
        def make():
            key = self.keyed("mcc", paid=what == "amt")
            t = self.column("t")
            values = self.column("amt") if what == "amt" else np.where(self.timed, np.floor(np.mod(t, DAY) / 3600), -1.0)
            return Moments(values[key.places]).over(key.of(self.past))

        return self._once(("same mcc", what), make)

    def same_mcc_5d(self) -> tuple[Keyed, Ranges]:
        key = self.keyed("mcc", timed=True, paid=True)
        return key, self._once(("5d",), lambda: key.of(self.since(5 * DAY)))

    def new_key(self, *names: str, known: str | None = None) -> np.ndarray:
        """1 where the row has the key, or keys, and its past has not."""
        key = self.keyed(*names)
        has = (key.codes >= 0) & (self.column(known) if known else True)
        return (has & (key.before < self.lo)).astype(float)

    def share(self, name: str, known: str | None = None) -> np.ndarray:
        same = self.keyed(name).count(self.past)
        return over(np.where(self.column(known), same, 0) if known else same, self.n)

    def since_change(self, name: str, has: np.ndarray) -> np.ndarray:
        """Time since the newest row of the past with a time and another value."""
        codes, at = self.column(name)[self.timed], np.flatnonzero(self.timed)
        if not len(at):
            return np.full(len(self.i), np.nan)
        starts = run_starts(np.concatenate(([True], codes[1:] != codes[:-1])))
        last = np.maximum(self._timed_past[1] - 1, 0)
        other = np.where(codes[last] != self.column(name), last, starts[last] - 1)
        there = has & (other >= self._timed_past[0]) & (self._timed_past[1] > self._timed_past[0])
        return np.where(there, self.column("t") - self._times[np.maximum(other, 0)], np.nan)

    def switches(self, name: str) -> np.ndarray:
        codes = self.column(name)
        changed = np.concatenate(([False], codes[1:] != codes[:-1]))[: len(codes)]
        first = np.minimum(np.maximum(self.lo, self.i - 20) + 1, self.i)
        return self.counted(changed, [(first, self.i)])

    def monotone(self, rising: bool) -> np.ndarray:
        values, (a, b) = self._paid_values, self._paid_past
        if not len(values):
            return np.zeros(len(a))
        step = np.concatenate(([False], values[1:] > values[:-1] if rising else values[1:] < values[:-1]))
        runs = np.arange(len(values)) - run_starts(~step)
        return np.where(b - a > 1, np.minimum(runs[np.maximum(b - 1, 0)], b - a - 1), 0)

    def hours_active(self) -> np.ndarray:
        hour = np.where(self.timed, np.floor(np.mod(self.column("t"), DAY) / 3600), -1)
        return sum(self.counted(hour == h, self.since(DAY)) > 0 for h in range(24)) / 24

    def distinct_descriptions(self) -> np.ndarray:
        """Different descriptions of a day. Where its rows are in several ranges (times fell), they are counted one row at a time."""
        key, ranges = self.keyed("descr", timed=True), self.since(DAY)
        out = np.zeros(len(self.i))
        for a, b in ranges:
            out += key.distinct(a, b)
        codes = np.where(key.before > -2, key.codes, -1)
        for i in np.flatnonzero(sum(b > a for a, b in ranges) > 1):
            seen = np.unique(np.concatenate([codes[a[i] : b[i]] for a, b in ranges]))
            out[i] = np.sum(seen >= 0)
        return over(out, np.maximum(1, self.counted(self.timed, ranges)))

    def previous(self, name: str) -> np.ndarray:
        values = self.column(name)
        return values[np.maximum(self.i - 1, 0)]


def over(a: np.ndarray, b: np.ndarray, at_zero: float = np.nan) -> np.ndarray:
    """a / b, and another value where b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, at_zero, a / np.where(b == 0, 1, b))


def when(condition: np.ndarray, value: np.ndarray, other: float = np.nan) -> np.ndarray:
    return np.where(condition, value, other)


def safe(d: np.ndarray) -> np.ndarray:
    return np.where(np.abs(d) <= TINY, TINY, d)


def _time_since_prev(h: History) -> np.ndarray:
    a, b = h._timed_past
    last = h._times[np.maximum(b - 1, 0)] if len(h._times) else np.zeros(len(a))
    return np.where((b > a) & h.timed, h.column("t") - last, -1.0)


def _days_since_mcc(h: History) -> np.ndarray:
    key = h.keyed("mcc", timed=True)
    (a, b), = key.of(h.past)
    t = h.column("t")
    last = t[key.places[np.maximum(b - 1, 0)]] if len(key.places) else np.nan
    return when(b > a, (t - last) / DAY)


def _session_start(h: History) -> np.ndarray:
    key = h.keyed("sess", timed=True)
    t = h.column("t")
    first = Moments(t[key.places]).over(key.of(h.past))["min"]
    return when(h.column("sess") >= 0, t - np.where(np.isnan(first), t, first))


def _mcc_streak(h: History) -> np.ndarray:
    codes = h.column("mcc")
    runs = h.i - run_starts(np.concatenate(([True], codes[1:] != codes[:-1]))[: len(codes)])
    return np.where(codes >= 0, np.minimum(runs, h.n), 0)


def _high_share(h: History) -> np.ndarray:
    n = h.all_amounts["n"]
    p95 = h.nth_amount(np.floor(0.95 * (n - 1)).astype(np.int64))
    kept = h.timed & h.paid
    sums = np.concatenate(([0], np.cumsum(kept)))
    ranges = [(sums[a], sums[b]) for a, b in h.since(DAY)]
    ranks = h._once(("timed ranks",), lambda: Ranks(h.column("amt")[kept]))
    size = sum(b - a for a, b in ranges)
    return over(size - ranks.below(ranges, p95, "right"), size, 0.0)


def _iqr(h: History) -> np.ndarray:
    k = h.all_amounts["n"].astype(np.int64) - 1
    low, high = h.nth_amount(k // 4), h.nth_amount(3 * k // 4)
    return when(k > 0, (h.column("amt") - low) / np.where(np.abs(high - low) < TINY, TINY, high - low))


def _percentile(h: History) -> np.ndarray:
    amt = h.column("amt")
    at_most = h._paid_ranks.below([h._paid_past], np.nan_to_num(amt), "right")
    return when(h.paid, over(at_most, h.all_amounts["n"]))


def _trend(h: History) -> np.ndarray:
    a, b = h._paid_past
    return h._paid_tree.over(h.tail(a, b, 3))["mean"] / safe(h._paid_tree.over(h.tail(a, b, 10))["mean"])


def _z(h: History, moments: dict[str, np.ndarray], least: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return when(moments["std"] > least, (h.column("amt") - moments["mean"]) / moments["std"])


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b where b is not next to zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return when(np.abs(b) > TINY, a / b)


def _frequency(name: str, hours: int) -> Callable[[History], np.ndarray]:
    return lambda h: h.keyed(name, timed=True).count(h.since(hours * 3600))


def _mcc_new_with(name: str, known: str | None = None) -> Callable[[History], np.ndarray]:
    return lambda h: h.new_key("mcc", name, known=known)


def _mcc_same_with(name: str, known: str) -> Callable[[History], np.ndarray]:
    return lambda h: np.where(h.column(known), h.keyed("mcc", name).count(h.past), 0)


def _weekend(h: History) -> np.ndarray:
    day = np.mod(np.floor(np.where(h.timed, h.column("t"), 0) / DAY) + 3, 7)
    return over(h.counted(h.timed & (day >= 5), h.since(7 * DAY)), h.counted(h.timed, h.since(7 * DAY)), 0.0)


def _gap_ratio(h: History) -> np.ndarray:
    return h.gap(1) / safe(h.gap(2))


def _std_5d(h: History) -> np.ndarray:
    key, ranges = h.same_mcc_5d()
    return Moments(h.column("amt")[key.places]).over(ranges)["std"]


def _median_5d(h: History) -> np.ndarray:
    key, ranges = h.same_mcc_5d()
    return over(h.column("amt"), h.median(Ranks(h.column("amt")[key.places]), ranges))


#: Features by name; missing values are NaN.
FEATURES: dict[str, Callable[[History], np.ndarray]] = {
    "log_1_plus_transactions_seen": lambda h: np.log1p(h.n),
    "amount_zscore": lambda h: _z(h, h.all_amounts, 0.0),
    "transactions_last_24h": lambda h: h.amounts(DAY)["n"],
    "sum_amount_last_1h": lambda h: h.amounts(3600)["sum"],
    "max_amount_last_24h": lambda h: np.nan_to_num(h.amounts(DAY)["max"]),
    "is_new_device": lambda h: h.new_key("dev", known="dev_known"),
    "is_new_mcc": lambda h: h.new_key("mcc"),
    "is_new_channel": lambda h: h.new_key("ch", known="ch_known"),
    "sum_amount_last_24h": lambda h: h.amounts(DAY)["sum"],
    "time_since_prev_transaction": _time_since_prev,
    "trend_mean_last_3_to_10": _trend,
    "amount_percentile_rank": _percentile,
    "std_time_deltas": lambda h: h.gaps()["std"],
    "is_device_switch": lambda h: (h.column("dev_known") & ((h.n == 0) | (h.previous("dev") != h.column("dev")))).astype(float),
    "is_mcc_switch": lambda h: ((h.n > 0) & (h.previous("mcc") >= 0) & (h.column("mcc") >= 0) & (h.previous("mcc") != h.column("mcc"))).astype(float),
    "session_mean_amount": lambda h: over(Moments(h.column("amt")[h.keyed("sess", paid=True).places]).over(h.keyed("sess", paid=True).of(h.past))["sum"], h.keyed("sess").count(h.past)),
    "device_freq": lambda h: h.share("dev", "dev_known"),
    "delta_1": lambda h: h.gap(1),
    "delta_2": lambda h: h.gap(2),
    "acceleration_delta_1_over_2": _gap_ratio,
    "std_delta_last_k": lambda h: h.gaps(10)["std"],
    "time_since_last_device_change": lambda h: h.since_change("dev", h.column("dev_known")),
    "time_since_last_mcc_change": lambda h: h.since_change("mcc", h.column("mcc") >= 0),
    **{f"event_descr_freq_last_{n}h": _frequency("descr", n) for n in (1, 6, 24)},
    **{f"event_type_nm_freq_last_{n}h": _frequency("et", n) for n in (1, 6, 24)},
    **{f"mcc_freq_last_{n}h": _frequency("mcc", n) for n in (6, 24)},
    "mcc_event_descr_pair_new": _mcc_new_with("descr"),
    "high_amount_ratio_last_24h": _high_share,
    "amount_relative_to_mcc_median_5_days": _median_5d,
    "amount_ratio_to_window_median": lambda h: over(h.column("amt"), h.median(h._paid_ranks, [h._paid_past])),
    "amount_iqr_normalized": _iqr,
    "amount_cv_in_window": lambda h: _ratio(h.all_amounts["std"], h.all_amounts["mean"]),
    "transactions_last_1h": lambda h: h.amounts(3600)["n"],
    "unique_mcc_count_suffix": lambda h: h.keyed("mcc").distinct(h.lo, h.i),
    "unique_device_key_count_suffix": lambda h: h.keyed("dev", flag="dev_known").distinct(h.lo, h.i),
    "unique_channel_key_count_suffix": lambda h: h.keyed("ch", flag="ch_known").distinct(h.lo, h.i),
    "unique_timezone_count_suffix": lambda h: h.keyed("tz").distinct(h.lo, h.i),
    "mcc_switch_count_last_20_tx": lambda h: h.switches("mcc"),
    "device_switch_count_last_20_tx": lambda h: h.switches("dev"),
    "channel_switch_count_last_20_tx": lambda h: h.switches("ch"),
    "distinct_hours_active_last_24h": lambda h: h.hours_active(),
    "mean_amount_last_3_transactions": lambda h: h._paid_tree.over(h.tail(*h._paid_past, 3))["mean"],
    "amount_ratio_to_min_amount_24h": lambda h: when(h.amounts(DAY)["min"] > TINY, over(h.column("amt"), h.amounts(DAY)["min"])),
    "web_rdp_count_last_24h": lambda h: h.counted(h.column("rdp") & h.timed, h.since(DAY)),
    "voip_flag_count_last_24h": lambda h: h.counted(h.column("voip") & h.timed, h.since(DAY)),
    "channel_relative_freq": lambda h: h.share("ch", "ch_known"),
    "timezone_relative_freq": lambda h: h.share("tz"),
    "browser_language_relative_freq": lambda h: h.share("bl"),
    "event_type_nm_share_in_suffix": lambda h: np.nan_to_num(h.share("et")),
    "mcc_consecutive_streak_length": _mcc_streak,
    "mean_gap_seconds_last_5_intervals": lambda h: h.gaps(5)["mean"],
    "suffix_time_span_hours_log1p": lambda h: np.log1p(np.maximum(0.0, h.span / 3600)),
    "transactions_per_span_hour": lambda h: h.n / np.maximum(h.span / 3600, TINY),
    "mcc_amount_std_same_5d": _std_5d,
    "weekend_transaction_share_last_7d": _weekend,
    "distinct_event_descr_count_last_24h_norm": lambda h: h.distinct_descriptions(),
    "amount_diff_prev": lambda h: when(h.n > 0, h.column("amt") - h.previous("amt")),
    "amount_ratio_prev": lambda h: when(h.n > 0, h.column("amt") / safe(h.previous("amt"))),
    "amount_increase_streak_suffix": lambda h: h.monotone(True),
    "amount_decrease_streak_suffix": lambda h: h.monotone(False),
    "is_new_session_id": lambda h: h.new_key("sess"),
    "session_switch_count_last_20_tx": lambda h: h.switches("sess"),
    "seconds_since_session_start_in_window": _session_start,
    "mcc_same_count_suffix": lambda h: h.keyed("mcc").count(h.past),
    "sum_amount_same_mcc_suffix": lambda h: h.same_mcc("amt")["sum"],
    "mean_amount_same_mcc_suffix": lambda h: h.same_mcc("amt")["mean"],
    "std_amount_same_mcc_suffix": lambda h: h.same_mcc("amt")["std"],
    "min_amount_same_mcc_suffix": lambda h: h.same_mcc("amt")["min"],
    "max_amount_same_mcc_suffix": lambda h: h.same_mcc("amt")["max"],
    "share_mcc_cnt_suffix": lambda h: when(h.column("mcc") >= 0, over(h.keyed("mcc").count(h.past), h.n)),
    "share_mcc_sum_suffix": lambda h: when((h.column("mcc") >= 0) & (h.all_amounts["sum"] > TINY), over(h.same_mcc("amt")["sum"], h.all_amounts["sum"])),
    "amount_ratio_mean_same_mcc": lambda h: _ratio(h.column("amt"), h.same_mcc("amt")["mean"]),
    "amount_minus_mean_same_mcc": lambda h: h.column("amt") - h.same_mcc("amt")["mean"],
    "zscore_amount_same_mcc": lambda h: _z(h, h.same_mcc("amt"), TINY),
    "days_since_last_same_mcc": _days_since_mcc,
    "mcc_channel_same_count_suffix": _mcc_same_with("ch", "ch_known"),
    "is_new_mcc_channel_pair": _mcc_new_with("ch", "ch_known"),
    "mcc_device_same_count_suffix": _mcc_same_with("dev", "dev_known"),
    "is_new_mcc_device_pair": _mcc_new_with("dev", "dev_known"),
    "mcc_rdp_count_suffix": lambda h: h.keyed("mcc", flag="rdp").count(h.past),
    "share_mcc_rdp_suffix": lambda h: over(h.keyed("mcc", flag="rdp").count(h.past), h.keyed("mcc").count(h.past)),
    "hour_mean_same_mcc_suffix": lambda h: h.same_mcc("hour")["mean"],
    "hour_std_same_mcc_suffix": lambda h: h.same_mcc("hour")["std"],
}
