"""Order-dependent series operators: one pass over each symbol's rows, in Arrow-fed groups.

A group is one key's series; its rows must fit a task, as any fold over them in order must see them all.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_series(df: DataFrame, fold: Callable[[pd.DataFrame], dict], added: str, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Run fold over each key's rows in order; it returns arrays for the columns in added ("name type, ...")."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(order), kind="stable", ignore_index=True)
        return rows.assign(**fold(rows))

    schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [added])
    return df.groupBy(*keys).applyInPandas(run, schema)


def ema_seeded(x: np.ndarray, period: int) -> np.ndarray:
    """Seeded by the mean of the first period values, from there on; empty places before, all empty under period + 1."""
    out = np.full(len(x), np.nan)
    if period > 0 and len(x) >= period + 1:
        k, e = 2 / (period + 1), float(np.mean(x[:period]))
        out[period - 1] = e
        for i in range(period, len(x)):
            e = (x[i] - e) * k + e
            out[i] = e
    return out


def ema_first(x: np.ndarray, period: int) -> np.ndarray:
    """Seeded by the first value."""
    out = np.empty(len(x))
    if len(x):
        k, e = 2 / (period + 1), float(x[0])
        for i, v in enumerate(x):
            e = v * k + e * (1 - k)
            out[i] = e
    return out


def wilder(x: np.ndarray, period: int) -> np.ndarray:
    """Mean of the first period values, then moved by 1 / period of each further one; place i has used x[: i + 1]."""
    out = np.full(len(x), np.nan)
    if len(x) >= period:
        a = float(np.mean(x[:period]))
        out[period - 1] = a
        for i in range(period, len(x)):
            a = (a * (period - 1) + x[i]) / period
            out[i] = a
    return out


def rsi(x: np.ndarray, period: int = 14, early: float = math.nan) -> np.ndarray:
    """Wilder's index; 100 without losses; early before the first."""
    out = np.full(len(x), early)
    if len(x) >= period + 1:
        change = np.diff(x)
        up, down = wilder(np.maximum(change, 0), period), wilder(np.maximum(-change, 0), period)
        for i in range(period - 1, len(change)):
            out[i + 1] = 100.0 if down[i] == 0 else 100 - 100 / (1 + up[i] / down[i])
    return out


def true_ranges(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    was = close[:-1]
    return np.maximum(high[1:] - low[1:], np.maximum(np.abs(high[1:] - was), np.abs(low[1:] - was)))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = 14) -> np.ndarray:
    out = np.full(len(close), np.nan)
    if len(close) >= period + 1:
        out[1:] = wilder(true_ranges(high, low, close), period)
    return out


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    line = ema_first(x, fast) - ema_first(x, slow)
    return line, ema_first(line, signal)


def log_returns(x: np.ndarray) -> np.ndarray:
    x = x[x > 0]
    return np.diff(np.log(x)) if len(x) >= 3 else np.zeros(0)


def ewma_volatility(x: np.ndarray, decay: float = 0.94) -> float | None:
    r = log_returns(x)
    if len(r) < 2:
        return None
    var = r[0] ** 2
    for v in r[1:]:
        var = decay * var + (1 - decay) * v * v
    return math.sqrt(var) if var > 0 else None


def garch_volatility(x: np.ndarray, alpha: float = 0.10, beta: float = 0.85) -> float | None:
    """GARCH(1,1) whose long-run variance is that of the sample."""
    r = log_returns(x)
    if len(r) < 5 or not np.var(r) > 0:
        return None
    whole = var = float(np.var(r))
    for v in r:
        var = max(1 - alpha - beta, 1e-6) * whole + alpha * v * v + beta * var
    return math.sqrt(max(var, 1e-12))


def indicators(df: DataFrame, fast: int = 9, slow: int = 21, period: int = 14) -> DataFrame:
    """ema_fast, ema_slow (mean-seeded), rsi, atr of each bar."""

    def fold(g: pd.DataFrame) -> dict:
        close, high, low = (g[c].to_numpy(float) for c in ("close", "high", "low"))
        return {"ema_fast": ema_seeded(close, fast), "ema_slow": ema_seeded(close, slow), "rsi": rsi(close, period), "atr": atr(high, low, close, period)}

    return per_series(df, fold, "ema_fast double, ema_slow double, rsi double, atr double")


def gap_cycles(t: np.ndarray, gap: float = 240) -> np.ndarray:
    """Numbers of cycles: a new one begins when a time is over gap after the first of the current one."""
    out, start, k = np.zeros(len(t), np.int64), None, -1
    for i, v in enumerate(t):
        if start is None or v - start > gap:
            start, k = v, k + 1
        out[i] = k
    return out


def drift_baseline(t: np.ndarray, equity: np.ndarray, cliff: float = 0.15) -> np.ndarray:
    """Loss base of each row's UTC day: the day's first equity, moved along with any jump of over cliff."""
    out, day, base, was = np.empty(len(t)), None, 0.0, 0.0
    for i, (s, e) in enumerate(zip(t, equity, strict=True)):
        if s // 86400 != day:
            day, base = s // 86400, e
        elif was > 0 and abs(e - was) / was > cliff:
            base += e - was
        out[i], was = base, e
    return out


def allocate(notional: np.ndarray, distance: np.ndarray, risk: float, open_count: int, most: int, most_notional: float, most_risk: float, least_distance: float) -> list[list[str]]:
    """Reasons against each order in turn; those without any use up the budget, refused ones don't."""
    out, count, total, risked = [], open_count, 0.0, 0.0
    for n, d in zip(notional, distance, strict=True):
        why = [name for name, hit in (
            ("stop_distance", d < least_distance), ("positions", count + 1 > most),
            ("notional", total + n > most_notional), ("risk", risked + risk > most_risk)) if hit]
        if not why:
            count, total, risked = count + 1, total + n, risked + risk
        out.append(why)
    return out


def match_nearest(buys: pd.DataFrame, fills: pd.DataFrame, seconds: float, ratio: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Pair each buy in order of time with the nearest free fill within seconds and within ratio of its amount.

    Returns pairs of row places, buys left, and fills left from the first buy (less seconds) on.
    """
    order = buys.sort_values("t", kind="stable").index.to_numpy()
    ft, fa = fills["t"].to_numpy(float), fills["amount"].to_numpy(float)
    by_time = np.argsort(ft, kind="stable")
    sorted_t = ft[by_time]
    free, pairs, left = np.ones(len(fills), bool), [], []
    for i in order:
        t, a = float(buys.at[i, "t"]), float(buys.at[i, "amount"])
        near = np.sort(by_time[np.searchsorted(sorted_t, t - seconds, "left") : np.searchsorted(sorted_t, t + seconds, "right")])
        near = near[free[near] & ((np.abs(fa[near] - a) <= ratio * a) | (a <= 0))]
        if len(near):
            j = int(near[np.argmin(np.abs(ft[near] - t))])
            free[j] = False
            pairs.append((int(i), j))
        else:
            left.append(int(i))
    first = buys["t"].min() - seconds if len(buys) else math.inf
    return pairs, left, [int(j) for j in np.flatnonzero(free & (ft >= first))]


class NearestMatch:
    """match_nearest over rows that come in order of time and id, in batches; what it holds is the rows of 2 * seconds.

    add() and finish() return what no later row can change: ids of buys, of their fills and whether they have one; ids and
    times of fills left. Of fills as near, the first is taken. Rows repeated with their id and time go together.
    """

    def __init__(self, seconds: int, ratio: float):
        self.seconds, self.ratio = seconds, ratio
        none = np.zeros(0, np.int64)
        self.buys, self.fills = [(none, none, np.zeros(0))], [(none, none, np.zeros(0))]
        self.first = None

    def held(self) -> int:
        return sum(len(x[0]) for x in self.buys + self.fills)

    def add(self, t: np.ndarray, ids: np.ndarray, amount: np.ndarray, buy: np.ndarray) -> tuple[np.ndarray, ...] | None:
        for rows, of in ((self.buys, buy), (self.fills, ~buy)):
            rows.append((t[of], ids[of], amount[of]))
        self.first = int(t[0]) if self.first is None else self.first
        last = int(t[-1])
        return self._settle(last - self.seconds) if self.first < last - 2 * self.seconds else None

    def finish(self) -> tuple[np.ndarray, ...]:
        return self._settle(math.inf)

    def _settle(self, until: float) -> tuple[np.ndarray, ...]:
        """All fills that buys before until can take have come."""
        (bt, bi, ba), (ft, fi, fa) = ([np.concatenate(c) for c in zip(*rows, strict=True)] for rows in (self.buys, self.fills))
        n, free = int(np.searchsorted(bt, until)), np.ones(len(ft), bool)
        taken = np.full(n, -1, np.int64)
        now = bt[:n]
        spans = (np.searchsorted(ft, now - self.seconds), np.searchsorted(ft, now), np.searchsorted(ft, now + self.seconds, "right"))
        for k, (t, a, low, mid, high) in enumerate(zip(now.tolist(), ba[:n].tolist(), *(x.tolist() for x in spans), strict=True)):
            wide = 32
            while True:  # from the buy's own time outwards
                x, y = max(low, mid - wide), min(high, mid + wide)
                near = np.flatnonzero(free[x:y] if a <= 0 else free[x:y] & (np.abs(fa[x:y] - a) <= self.ratio * a)) + x
                if len(near):
                    gaps = np.abs(ft[near] - t)
                    at = int(np.argmin(gaps))
                    if (x == low or t - ft[x - 1] > gaps[at]) and (y == high or ft[y] - t >= gaps[at]):
                        taken[k] = j = int(near[at])
                        while j < len(ft) and fi[j] == fi[near[at]] and ft[j] == ft[near[at]]:
                            free[j] = False
                            j += 1
                        break
                elif x == low and y == high:
                    break
                wide *= 4
        found = np.full(n, -1, np.int64)
        found[taken >= 0] = fi[taken[taken >= 0]]
        gone = ft < until - self.seconds
        keep, left = free & ~gone, free & gone
        self.buys, self.fills = [(bt[n:], bi[n:], ba[n:])], [(ft[keep], fi[keep], fa[keep])]
        firsts = [int(x[0][0]) for x in (self.buys[0], self.fills[0]) if len(x[0])]
        self.first = min(firsts) if firsts else None
        return bi[:n], found, taken >= 0, fi[left], ft[left]


def round_trips(events: pd.DataFrame) -> list[tuple[int, int]]:
    """Pairs of row places: each open with the first reduce of its symbol and side after it; a further open replaces."""
    live: dict[tuple, int] = {}
    out = []
    for i, r in enumerate(events.itertuples(index=False)):
        key = (r.symbol, r.side)
        if r.reduce:
            if key in live:
                out.append((live.pop(key), i))
        elif r.entry == r.entry and r.entry:
            live[key] = i
    return out
