"""Numbers, text and decisions as column expressions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_float(c: Column) -> Column:
    """A number from text: blanks around it, a decimal comma; null for anything else."""
    return F.nullif(F.trim(F.replace(c.cast("string"), F.lit(","), F.lit("."))), F.lit("")).try_cast("double")


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def side_of(c: Column) -> Column:
    """LONG for long or buy, SHORT for short or sell, anywhere in the text; long is looked for first."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike("long|buy"), "LONG").when(low.rlike("short|sell"), "SHORT").otherwise("UNKNOWN")


def split_symbol(c: Column) -> tuple[Column, Column]:
    """Base and quote; the quote is the first of USDT, USDC, USD that ends the symbol (so BUSD ends in USD)."""
    quote = F.when(F.upper(c).endswith("USDT"), "USDT").when(F.upper(c).endswith("USDC"), "USDC").when(F.upper(c).endswith("USD"), "USD").otherwise("")
    return F.substring(F.upper(c), F.lit(1), F.length(c) - F.length(quote)), quote


def granularity(c: Column) -> Column:
    """Hours, days and weeks in upper case; minutes as they are, so that 1M (a month) differs from 1m."""
    return F.when(c.rlike("^[0-9]+[hdw]$"), F.upper(c)).otherwise(c)


def clamp(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """c must not be null: greatest and least skip nulls."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def clamp_known(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """clamp that keeps a null."""
    return F.when(c.isNotNull(), clamp(c, low, high))


def normal_density(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


# Fixed coefficients of the rational approximation of the normal distribution to double precision.
NORMAL_UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _poly(ks: tuple[float, ...], x: Column) -> Column:
    out = F.lit(ks[0])
    for k in ks[1:]:
        out = out * x + k
    return out


def normal_cdf(x: Column) -> Column:
    """P(Z <= x). Spark has no erf; a rational function is right to some 14 places."""
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * _poly(NORMAL_UPPER, z) / _poly(NORMAL_LOWER, z)
    tail = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    upper = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(tail)
    return F.when(x > 0, 1 - upper).otherwise(upper)


def normal_cdf_sql(x: str) -> str:
    """The same in SQL text."""
    z, poly = f"abs({x})", lambda ks, v: __import__("functools").reduce(lambda a, k: f"({a} * {v} + {k!r}::DOUBLE)", ks[1:], f"{ks[0]!r}::DOUBLE")
    e = f"exp(-{z} * {z} / 2)"
    near = f"{e} * {poly(NORMAL_UPPER, z)} / {poly(NORMAL_LOWER, z)}"
    tail = f"{e} / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / 2.506628274631"
    upper = f"(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 THEN {near} ELSE {tail} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {upper} ELSE {upper} END)"


def inverse_erf(x: Column) -> Column:
    """Winitzki's approximation, a = 0.147."""
    ln = F.log(1 - x * x)
    part = 2 / (math.pi * 0.147) + ln / 2
    return F.signum(x) * F.sqrt(F.sqrt(part * part - ln / 0.147) - part)


def inverse_normal(p: Column) -> Column:
    return math.sqrt(2) * inverse_erf(2 * p - 1)


def d1_d2(s: Column, k: Column, sigma: Column, t: Column, r: float = 0.0) -> tuple[Column, Column]:
    v = sigma * F.sqrt(t)
    d1 = (F.log(s / k) + (r + 0.5 * sigma * sigma) * t) / v
    return d1, d1 - v


def options(df: DataFrame, s: str, k: str, sigma: str, t: str, r: float = 0.0) -> DataFrame:
    """Adds call, put, delta, gamma, vega, above, below, touch; null unless all four are positive.

    d1, d2 and their normal values are columns first, so that the long approximation stands in the plan twice only.
    """
    c = F.col
    ok = (c(s) > 0) & (c(k) > 0) & (c(sigma) > 0) & (c(t) > 0)
    d1, d2 = d1_d2(c(s), c(k), c(sigma), c(t), r)
    df = df.withColumns({"_d1": F.when(ok, d1), "_d2": F.when(ok, d2)})
    df = df.withColumns({"_n1": normal_cdf(c("_d1")), "_n2": normal_cdf(c("_d2")), "_disc": F.exp(-r * c(t)), "_root": F.sqrt(c(t))})
    df = df.withColumns({
        "call": c(s) * c("_n1") - c(k) * c("_disc") * c("_n2"), "put": c(k) * c("_disc") * (1 - c("_n2")) - c(s) * (1 - c("_n1")), "delta": c("_n1"),
        "gamma": normal_density(c("_d1")) / (c(s) * c(sigma) * c("_root")), "vega": c(s) * normal_density(c("_d1")) * c("_root"), "above": c("_n2"), "below": 1 - c("_n2"),
    })
    touch = 2 * F.when(c(k) >= c(s), c("above")).otherwise(c("below"))
    return df.withColumn("touch", F.when(touch > 1, 1.0).otherwise(touch)).drop("_d1", "_d2", "_n1", "_n2", "_disc", "_root")


def crowd(ratio: Column) -> Column:
    """Long-short ratio as -1 to 1, alike for the ratio and its inverse; 0 where there is none."""
    return F.when(ratio >= 1, F.least(F.lit(1.0), (ratio - 1) / 1.5)).when(ratio > 0, -F.least(F.lit(1.0), (1 / ratio - 1) / 1.5)).otherwise(0.0)


def kelly(win: Column, payoff: Column, cap: float = 0.25, share: float = 0.5) -> Column:
    """Part of capital by win rate and payoff, halved and capped; 0 without a positive edge."""
    full = win - (1 - win) / payoff
    return F.when(payoff > 0, F.greatest(F.lit(0.0), F.least(F.lit(cap), share * full))).otherwise(0.0)


def risk_size(capital: Column, percent: Column, entry: Column, stop: Column) -> Column:
    """Units whose loss at the stop is percent of capital; null without a distance."""
    gap = F.abs(entry - stop)
    return F.when((capital > 0) & (percent > 0) & (gap > 0), capital * percent / 100 / gap)


def human(c: Column) -> Column:
    """One decimal with K, M, B, T or P for thousands."""
    out, size = F.lit(None).cast("string"), F.abs(c)
    names = ["", "K", "M", "B", "T", "P"]
    for k in range(5, -1, -1):
        text = F.concat(F.format_string("%.1f", c / 1000.0**k), F.lit(names[k]))
        out = text if k == 5 else F.when(size < 1000.0 ** (k + 1), text).otherwise(out)
    return F.when(c.isNull(), "—").otherwise(out)


def json_mark(*cs: Column) -> Column:
    """First 12 hex digits of the md5 of the JSON of the columns: a version mark for deltas."""
    return F.substring(F.md5(F.to_json(F.struct(*cs))), 1, 12)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def reasons(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in pairs]))
