"""Rolling functions over slices of a panel, as numpy arrays of series x dates, NaN being the missing value.

A window of n dates that ends on some date is the end of one block of n dates and the beginning of the next. So what runs
from each block's first date on and what runs back from its last one, taken together two by two, gives every window in
a time that doesn't depend on n: extremes, sums and moments alike. Nothing is ever subtracted from a running sum, so a
level far larger than the spread, or a jump within the history, doesn't cost digits. Moments are kept as counts, means
and sums of squares about the mean, and merged as such.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np

TINY = 1e-8


def _steps(x: np.ndarray, n: int) -> np.ndarray:
    """series x dates as n x series x blocks, the last block filled up with NaN: step i has the i-th date of every block."""
    blocks = -(-x.shape[1] // n)
    filled = np.full((x.shape[0], blocks * n), np.nan)
    filled[:, : x.shape[1]] = x
    return np.ascontiguousarray(filled.reshape(x.shape[0], blocks, n).transpose(2, 0, 1))


def _dates(steps: np.ndarray, width: int) -> np.ndarray:
    return steps.transpose(1, 2, 0).reshape(steps.shape[1], -1)[:, :width]


def _merged(x: np.ndarray, n: int, running: Callable, merge: Callable, nothing: tuple) -> tuple[np.ndarray, ...]:
    """Each window's value. running: a block's steps to the values from its first step to each; merge: of an earlier and a later part; nothing: the value of no dates."""
    steps, width = _steps(x, n), x.shape[1]
    ahead = [_dates(v, width) for v in running(steps, False)]
    back = [_dates(v[::-1], width) for v in running(steps[::-1], True)]
    # A window that is a block, or begins before the first date, has no earlier part.
    ends = np.arange(width)
    whole = (ends < n) | ((ends + 1) % n == 0)
    begin = np.where(whole, 0, ends - n + 1)
    earlier = [np.where(whole[None, :], none, v[:, begin]) for v, none in zip(back, nothing, strict=True)]
    return merge(earlier, ahead)


def counts(x: np.ndarray, n: int) -> np.ndarray:
    """How many values each window has."""
    total = np.cumsum(~np.isnan(x), axis=1)
    total[:, n:] = total[:, n:] - total[:, :-n].copy() if x.shape[1] > n else total[:, n:]
    return total


def sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the windows' values."""
    return _merged(np.nan_to_num(x), n, lambda s, _: (np.cumsum(np.nan_to_num(s), axis=0),), lambda a, b: (a[0] + b[0],), (0.0,))[0]


def _moments(steps: np.ndarray, _) -> tuple[np.ndarray, ...]:
    out = np.zeros((3, *steps.shape))
    count, mean, square = np.zeros((3, *steps.shape[1:]))
    for i, v in enumerate(steps):
        there = ~np.isnan(v)
        count = count + there
        off = np.where(there, v - mean, 0.0)
        mean = mean + off / np.maximum(count, 1)
        square = square + np.where(there, off * (v - mean), 0.0)
        out[:, i] = count, mean, square
    return tuple(out)


def _join_moments(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    count = a[0] + b[0]
    share = b[0] / np.maximum(count, 1)
    off = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    return count, np.where(a[0] > 0, a[1] + off * share, b[1]), a[2] + b[2] + off * off * a[0] * share


def moments(x: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Count, mean and sum of squares about the mean of each window."""
    return _merged(x, n, _moments, _join_moments, (0.0, 0.0, 0.0))


def co_moments(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Count, both sums of squares and the sum of products about the means, of each window's pairs; added up in extended precision where the machine has it, as products of large values round early."""
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = np.where(both, x, np.nan), np.where(both, y, np.nan)
    other = _steps(y, n)

    def running(steps: np.ndarray, reverse: bool) -> tuple[np.ndarray, ...]:
        out = np.zeros((6, *steps.shape), np.longdouble)
        count, mx, my, xx, yy, xy = np.zeros((6, *steps.shape[1:]), np.longdouble)
        for i, (v, w) in enumerate(zip(steps, other[::-1] if reverse else other, strict=True)):
            there = ~np.isnan(v)
            count = count + there
            dx, dy = np.where(there, v - mx, 0.0), np.where(there, w - my, 0.0)
            mx, my = mx + dx / np.maximum(count, 1), my + dy / np.maximum(count, 1)
            rest = np.where(there, w - my, 0.0)
            xx, yy, xy = xx + dx * np.where(there, v - mx, 0.0), yy + dy * rest, xy + dx * rest
            out[:, i] = count, mx, my, xx, yy, xy
        return tuple(out)

    def merge(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        count = a[0] + b[0]
        weight = a[0] * b[0] / np.maximum(count, 1)
        some = weight > 0
        dx, dy = np.where(some, b[1] - a[1], 0.0), np.where(some, b[2] - a[2], 0.0)
        return count, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight

    return tuple(v.astype(np.float64) for v in _merged(x, n, running, merge, (0.0,) * 6))


def highest(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's largest value (-inf without values) and on which date it stands, the oldest of equal ones."""
    low = np.where(np.isnan(x), -np.inf, x)
    size = -(-x.shape[1] // n) * n
    place = _steps(np.broadcast_to(np.arange(x.shape[1], dtype=float), x.shape), n)

    def running(steps: np.ndarray, reverse: bool) -> tuple[np.ndarray, ...]:
        steps = np.where(np.isnan(steps), -np.inf, steps)
        top = np.maximum.accumulate(steps, axis=0)
        before = np.concatenate([np.full((1, *steps.shape[1:]), -np.inf), top[:-1]])
        if reverse:  # later dates came first: an equal one is older
            at = np.where(steps >= before, place[::-1], float(size))
            return top, np.fmin.accumulate(at, axis=0)
        at = np.where(steps > before, place, -1.0)
        return top, np.fmax.accumulate(at, axis=0)

    def merge(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        first = (a[0] >= b[0]) & (a[0] > -np.inf)
        return np.maximum(a[0], b[0]), np.where(first, a[1], b[1])

    return _merged(low, n, running, merge, (-np.inf, -1.0))


def weighted(x: np.ndarray, n: int) -> np.ndarray:
    """Each window's sum with weights 1, 2, ... from its first date on; missing values count as 0."""

    def running(steps: np.ndarray, reverse: bool) -> tuple[np.ndarray, ...]:
        steps = np.nan_to_num(steps)
        total = np.cumsum(steps, axis=0)
        length = np.broadcast_to(np.arange(1.0, len(steps) + 1)[:, None, None], steps.shape)
        # Backwards each step raises the weights of all later dates by one.
        return total, np.cumsum(total, axis=0) if reverse else np.cumsum(steps * length, axis=0), length

    return _merged(np.nan_to_num(x), n, running, lambda a, b: (a[1] + b[1] + a[2] * b[0],), (0.0, 0.0, 0.0))[0]


def ranks(x: np.ndarray, n: int) -> np.ndarray:
    """Average rank of each window's last value among its values, from 1. The window is kept sorted; a value goes in and out by bisection."""
    out = np.full(x.shape, np.nan)
    for own, series in zip(out, x.tolist(), strict=True):
        held: list[float] = []
        for i, v in enumerate(series):
            if i >= n and (old := series[i - n]) == old:
                del held[bisect_left(held, old)]
            if v == v:
                below = bisect_left(held, v)
                own[i] = below + 1 + (bisect_right(held, v, below) - below) / 2
                insort(held, v, below)
    return out


def shifted(x: np.ndarray, n: int) -> np.ndarray:
    """x of n dates before, or after if n is negative."""
    out = np.full(x.shape, np.nan)
    if n >= 0:
        out[:, n:] = x[:, : max(0, x.shape[1] - n)]
    else:
        out[:, :n] = x[:, -n:]
    return out


def padded(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The last value so far; before: each series' last value before its first date here."""
    with_first = np.concatenate([before[:, None], x], axis=1)
    at = np.maximum.accumulate(np.where(np.isnan(with_first), 0, np.arange(with_first.shape[1])[None, :]), axis=1)
    return np.take_along_axis(with_first, at, axis=1)[:, 1:]


def _enough(x: np.ndarray, n: int, value: np.ndarray) -> np.ndarray:
    return np.where(counts(x, n) >= max(1, n // 2), value, np.nan)


def _divided(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(y == 0, np.nan, x / np.where(y == 0, 1.0, y))


class Slice:
    """The series of one or more slices, and what has been computed of them: functions that need the same moments share them.

    columns: by name, series x dates; first: the number of rows of a series before its first date here, for windows that
    reach back to the beginning of the history; before: by name, each series' last value before its first date here; last:
    the place of each series' last date, beyond which there is nothing to look ahead to.
    """

    def __init__(self, columns: dict[str, np.ndarray], first: np.ndarray, before: dict[str, np.ndarray], last: np.ndarray | None = None):
        self.columns, self.first, self.before, self.last = columns, first, before, last
        self._known: dict[tuple, object] = {}

    def of(self, make: Callable, names: list[str], n: int):
        key = (make, *names, n)
        if key not in self._known:
            self._known[key] = make(*(self.columns[c] for c in names), n)
        return self._known[key]

    def filled(self, name: str) -> np.ndarray:
        if ("padded", name) not in self._known:
            self._known["padded", name] = padded(self.columns[name], self.before[name])
        return self._known["padded", name]

    def compute(self, function: str, names: list[str], n: int) -> np.ndarray:
        x = self.columns[names[0]]
        with np.errstate(all="ignore"):
            if function in ("ts_mean", "ts_sum"):
                total = self.of(sums, names, n)
                return _enough(x, n, total if function == "ts_sum" else total / self.of(counts, names, n))
            if function in ("ts_std", "ts_zscore"):
                count, mean, square = self.of(moments, names, n)
                sd = _enough(x, n, np.where(count > 1, np.sqrt(square / (count - 1)), np.nan))
                return sd if function == "ts_std" else (x - mean) / np.where(sd == 0, TINY, sd)
            if function in ("ts_max", "ts_argmax"):
                top, at = self.of(highest, names, n)
                return _enough(x, n, top if function == "ts_max" else np.arange(x.shape[1])[None, :] - at)
            if function in ("ts_min", "ts_argmin"):
                top, at = self.of(_lowest, names, n)
                return _enough(x, n, -top if function == "ts_min" else np.arange(x.shape[1])[None, :] - at)
            if function == "ts_rank":
                return _enough(x, n, self.of(ranks, names, n) / self.of(counts, names, n))
            if function in ("correlation", "covariance"):
                count, xx, yy, xy = self.of(co_moments, names, n)
                pairs = np.where(np.isnan(self.columns[names[1]]), np.nan, x)
                less = np.where(count > 1, count - 1, np.nan)
                return _enough(pairs, n, xy / less if function == "covariance" else _divided(xy / less, np.sqrt(xx / less) * np.sqrt(yy / less)))
            if function == "decay_linear":
                length = np.minimum(n, self.first[:, None] + np.arange(1, x.shape[1] + 1)[None, :])
                whole = (self.of(counts, names, n) == length) & (length >= max(1, n // 2))
                return np.where(whole, self.of(weighted, names, n) / (length * (length + 1) / 2), np.nan)
            if function == "delay":
                return shifted(x, n)
            if function == "delta":
                return x - shifted(x, n)
            if function == "returns":
                return _divided(self.filled(names[0]), shifted(self.filled(names[0]), n)) - 1
            if function == "filled":
                return self.filled(names[0])
            if function == "base":
                return shifted(self.filled(names[0]), n)
            if function == "ahead":
                there = np.arange(x.shape[1])[None, :] + n <= (x.shape[1] - 1 if self.last is None else self.last[:, None])
                return np.where(there, _divided(shifted(self.filled(names[0]), -n), self.filled(names[0])) - 1, np.nan)
        raise ValueError(f"no rolling function {function!r}")


def _lowest(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return highest(-x, n)


#: Functions that read the last value so far, however old it is.
PADDED = ("returns", "ahead", "filled", "base")


def reach(function: str, n: int) -> tuple[int, int]:
    """How many dates before and after a date the function reads."""
    if function == "ahead":
        return 0, n
    return (n if function in ("delay", "delta", "returns", "base") else max(n - 1, 0)), 0
