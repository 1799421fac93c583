"""Liquidity sweeps, changes of character and session levels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .folds import true_ranges
from .strategies import columns, swing_places


def sweeps(bars: DataFrame) -> DataFrame:
    """symbol, t, side, level, swing_rn: bars that pierce an earlier swing and close back; of several, the oldest.

    Each swing meets the later bars of its symbol, so rows grow with swings times bars of a symbol; bound the span of
    bars handed in.
    """
    s = W.swings(bars)
    out = None
    for side, flag, name, beyond, back in (("sell", "swing_low", "low", "a.low < b.level", "a.close > b.level"), ("buy", "swing_high", "high", "a.high > b.level", "a.close < b.level")):
        b = s.where(flag).select("symbol", F.col("rn").alias("swing_rn"), F.col(name).alias("level")).alias("b")
        a = bars.alias("a")
        hit = a.join(b, F.expr(f"a.symbol = b.symbol and b.swing_rn < a.rn and {beyond} and {back}"))
        g = hit.groupBy(F.col("a.symbol").alias("symbol"), F.col("a.t").alias("t")).agg(F.min_by("b.level", "b.swing_rn").alias("level"), F.min("b.swing_rn").alias("swing_rn"))
        g = g.select("symbol", "t", F.lit(side).alias("side"), F.round("level", 6).alias("level"), "swing_rn")
        out = g if out is None else out.unionByName(g)
    return out


def gaps_of(c: dict, least: float = 0.5) -> list[dict]:
    """Gaps of at least this part of the closing mean range; whether a later bar filled them looks ahead."""
    h, l, n = c["high"], c["low"], len(c["close"])
    tr = true_ranges(h, l, c["close"])
    size = float(tr[-14:].mean()) * least if len(tr) else 0.0
    out = []
    for t in range(2, n):
        if l[t] > h[t - 2] and l[t] - h[t - 2] >= size:
            out.append({"way": 1, "at": t, "entry": h[t - 2], "filled": bool((l[t + 1 :] <= h[t - 2]).any())})
        elif h[t] < l[t - 2] and l[t - 2] - h[t] >= size:
            out.append({"way": -1, "at": t, "entry": l[t - 2], "filled": bool((h[t + 1 :] >= l[t - 2]).any())})
    return out


def sweeps_of(c: dict) -> list[tuple[int, int, int, float]]:
    """(bar, way, swing, level): way 1 for a swept low."""
    h, l, x = c["high"], c["low"], c["close"]
    lows, highs, out = swing_places(l, -1), swing_places(h, 1), []
    for i in range(len(x)):
        s = lows[(lows < i) & (l[lows] > l[i]) & (l[lows] < x[i])]
        if len(s):
            out.append((i, 1, int(s[0]), float(l[s[0]])))
        s = highs[(highs < i) & (h[highs] < h[i]) & (h[highs] > x[i])]
        if len(s):
            out.append((i, -1, int(s[0]), float(h[s[0]])))
    return out


def changes_of(c: dict, body: float = 0.6) -> list[dict]:
    """Sweep, then a full-bodied close beyond the swing behind it, with an unfilled gap between: a valid change."""
    o, h, l, x = (c[k] for k in ("open", "high", "low", "close"))
    span = h - l
    full = np.where(span > 0, np.abs(x - o) / np.where(span > 0, span, 1), 0) >= body
    lows, highs, gaps, out = swing_places(l, -1), swing_places(h, 1), gaps_of(c), []
    for i, way, swing, level in sweeps_of(c):
        behind = highs[highs < swing] if way > 0 else lows[lows < swing]
        if not len(behind):
            continue
        target = h[behind[-1]] if way > 0 else l[behind[-1]]
        hit = np.flatnonzero(full[i:] & ((x[i:] > target) if way > 0 else (x[i:] < target)))
        if len(hit):
            t = i + int(hit[0])
            gap = next((g for g in gaps if g["way"] == way and i <= g["at"] <= t + 1 and not g["filled"]), None)
            out.append({"at": t, "way": way, "level": float(target), "sweep": i, "gap": gap})
    return sorted(out, key=lambda r: r["at"])


def character_changes(bars: DataFrame) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", kind="stable", ignore_index=True)
        rows = [(g.symbol[0], int(g.t[r["at"]]), "bullish" if r["way"] > 0 else "bearish", round(r["level"], 6), int(g.t[r["sweep"]]), r["gap"] is not None) for r in changes_of(columns(g))]
        return pd.DataFrame(rows, columns=["symbol", "t", "kind", "level", "sweep_t", "valid"])

    return bars.groupBy("symbol").applyInPandas(run, "symbol string, t long, kind string, level double, sweep_t long, valid boolean")


def session_levels(bars: DataFrame) -> DataFrame:
    """High, low, midnight open, evening high and bars in the morning zones of each New York day."""
    df = bars
    df = df.withColumn("ny", new_york())
    h = F.hour("ny")
    return df.groupBy("symbol", F.to_date("ny").alias("day")).agg(
        F.round(F.max("high"), 6).alias("day_high"), F.round(F.min("low"), 6).alias("day_low"), F.round(F.min_by("open", "t"), 6).alias("midnight_open"),
        F.round(F.max(F.when(h >= 19, F.col("high"))), 6).alias("asian_high"), F.count_if(h.between(2, 4)).alias("london"), F.count_if(h.between(7, 9)).alias("newyork"))


def checklist(bars: DataFrame) -> DataFrame:
    """symbol, score, bias, entry, stop, risk_reward, coherent: from the last third of each series."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        c = columns(g)
        n = len(c["close"])
        late = n - max(1, n // 3)
        swept = [s for s in sweeps_of(c) if s[0] >= late]
        changed = [r for r in changes_of(c) if r["at"] >= late and r["gap"]]
        last = changed[-1] if changed else None
        hour = int((g["t"].max() // 3600 - 5) % 24)
        zone = 2 <= hour < 5 or 7 <= hour < 10
        score = int(zone) + bool(swept) + 2 * bool(last)
        bias = "NEUTRE"
        entry = stop = rr = None
        ok = False
        if last:
            bias, way, entry = ("LONG", 1, last["gap"]["entry"]) if last["way"] > 0 else ("SHORT", -1, last["gap"]["entry"])
            part = slice(max(0, last["sweep"] - 1), last["at"] + 1)
            stop = float(c["low"][part].min() if way > 0 else c["high"][part].max())
            goal = float(c["high"][late:].max() if way > 0 else c["low"][late:].min())
            ok = stop < entry < goal if way > 0 else goal < entry < stop
            rr = round(abs(goal - entry) / (abs(entry - stop) or 1e-9), 2)
        elif swept:
            bias = "LONG" if swept[-1][1] > 0 else "SHORT"
        return pd.DataFrame([(g.symbol.iloc[0], score, bias, entry, stop, rr, ok)], columns=["symbol", "score", "bias", "entry", "stop", "risk_reward", "coherent"])

    return bars.groupBy("symbol").applyInPandas(run, "symbol string, score int, bias string, entry double, stop double, risk_reward double, coherent boolean")


def new_york(seconds: str = "t"):
    """New York's clock, with its summer time, from epoch seconds and whatever the session's zone."""
    return F.expr(f"convert_timezone('UTC', 'America/New_York', TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}))")


def kill_zone(df: DataFrame, seconds: str = "t") -> DataFrame:
    """Adds ny_hour, zone (asian, london, newyork or null), silver_bullet, tradeable."""
    h = F.col("ny_hour")
    df = df.withColumn("ny_hour", F.hour(new_york(seconds)))
    zone = F.when(h >= 20, "asian").when((h >= 2) & (h < 5), "london").when((h >= 7) & (h < 10), "newyork")
    return df.withColumn("zone", zone).withColumn("silver_bullet", h.isin(3, 10, 14)).withColumn("tradeable", F.coalesce(zone.isin("london", "newyork"), F.lit(False)))
