"""Series operators over bars (symbol, t, open, high, low, close, volume) as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by():
    """Rows of a symbol in order of time. A function, as a window needs a running session."""
    return Window.partitionBy("symbol").orderBy("t")


def last(n: int):
    """The frame of the current row and the n - 1 before."""
    return by().rowsBetween(-(n - 1), 0)


def before(n: int):
    """The frame of the n rows before the current one."""
    return by().rowsBetween(-n, -1)


def lag(name: str | Column, k: int = 1) -> Column:
    return F.lag(name, k).over(by())


def lead(name: str | Column, k: int = 1) -> Column:
    return F.lead(name, k).over(by())


def place() -> Column:
    """0 for a symbol's first row."""
    return F.row_number().over(by()) - 1


def full(n: int) -> Column:
    """Whether n rows end at the current one."""
    return F.row_number().over(by()) >= n


def sma(name: str, n: int) -> Column:
    return F.when(full(n), F.avg(name).over(last(n)))


def true_range() -> Column:
    """Range against the close before; null on the first row."""
    was = lag("close")
    return F.when(was.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - was), F.abs(F.col("low") - was)))


def atr_simple(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean of the last n true ranges."""
    return df.withColumn("tr", true_range()).withColumn("atr", F.when(full(n + 1), F.avg("tr").over(last(n)))).drop("tr")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """Bands of the n closes before the bar, and the reversion signal of the bar."""
    some = full(n + 1)
    df = df.withColumn("mid", F.when(some, F.avg("close").over(before(n)))).withColumn("sd", F.when(some, F.stddev_pop("close").over(before(n))))
    df = df.withColumn("sd", F.when(F.col("sd") == 0, 1e-9).otherwise(F.col("sd")))
    low, high = F.col("mid") - k * F.col("sd"), F.col("mid") + k * F.col("sd")
    return df.withColumn("signal", F.when(F.col("close") < low, 1).when(F.col("close") > high, -1).otherwise(0))


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    """Breakouts of the channel of the n bars before."""
    some = full(n + 1)
    df = df.withColumn("top", F.when(some, F.max("high").over(before(n)))).withColumn("bottom", F.when(some, F.min("low").over(before(n))))
    return df.withColumn("signal", F.when(F.col("close") > F.col("top"), 1).when(F.col("close") < F.col("bottom"), -1).otherwise(0))


def momentum(n: int = 14) -> Column:
    """Rate of change in percent; 0 from a base of 0, null before."""
    base = lag("close", n)
    return F.when(base == 0, 0.0).when(base.isNotNull(), (F.try_divide("close", base) - 1) * 100)


def savitzky_weights(window: int = 11, poly: int = 2) -> list[float]:
    """Weights of the middle point of a least-squares polynomial through an odd window."""
    import numpy as np

    m = window // 2
    x = np.vander(np.arange(-m, m + 1, dtype=float), poly + 1, increasing=True)
    return np.linalg.pinv(x)[0].tolist()


def savitzky_golay(df: DataFrame, name: str = "close", window: int = 11, poly: int = 2) -> DataFrame:
    """Smoothed values; beyond the ends the end values repeat. Shorter series use the widest odd window that fits."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    whole = by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, final = F.first(name).over(whole), F.last(name).over(whole)
    out = F.col(name)
    for w in range(3, window + 1, 2):
        m = w // 2
        if poly >= w:
            continue
        fits = (n >= w) if w == window else (n >= w) & (n < w + 2)
        terms = [weight * F.coalesce(F.lag(name, -k).over(by()), final if k > 0 else first) for k, weight in zip(range(-m, m + 1), savitzky_weights(w, poly), strict=True)]
        out = F.when(fits, sum(terms[1:], terms[0])).otherwise(out)
    return df.withColumn("smooth", out)


def anchored_level(n: int = 20) -> Column:
    """Close of the bar of most volume among the last n; of equals, the first."""
    return F.max_by("close", F.struct("volume", -F.col("t"))).over(last(n))


def volume_bias(df: DataFrame, n: int = 20) -> DataFrame:
    """Bars' directions, 3 where volume rose within the last n and else 1, added up."""
    way = F.signum(F.col("close") - F.col("open"))
    rose = F.col("volume") > lag("volume")
    df = df.withColumn("_w", way * F.when(rose, 3).otherwise(1)).withColumn("_d", way).withColumn("_k", place())
    first = F.col("_k") <= n - 1
    # the oldest bar of the frame has nothing before it to rise from
    oldest = F.when(first, F.first("_d").over(last(n))).otherwise(F.first("_d").over(last(n)))
    return df.withColumn("bias", (F.sum("_w").over(last(n)) - F.first("_w").over(last(n)) + oldest).cast("bigint")).drop("_w", "_d", "_k")


def close_location() -> Column:
    """Where in the bar it closed: 1 at the high, -1 at the low."""
    span = F.col("high") - F.col("low")
    return F.when(span <= 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (2 * F.col("close") - F.col("low") - F.col("high")) / span)))


def money_flow(df: DataFrame, n: int = 5) -> DataFrame:
    """Volume-weighted close location of the last n bars, the plain mean where there is no volume."""
    df = df.withColumn("clv", close_location())
    flow, volume = F.sum(F.col("clv") * F.col("volume")).over(last(n)), F.sum("volume").over(last(n))
    return df.withColumn("ned", F.when(full(n), F.when(volume > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), flow / volume))).otherwise(F.avg("clv").over(last(n)))))


def ribbons(df: DataFrame, name: str, short: int = 30, long: int = 60, recover: int = 14) -> DataFrame:
    """1 within recover rows of the short mean crossing up, -0.3 while it is below, 0 otherwise and too early."""
    df = df.withColumn("fast", sma(name, short)).withColumn("slow", sma(name, long))
    df = df.withColumn("cross", F.coalesce((lag("fast") < lag("slow")) & (F.col("fast") > F.col("slow")), F.lit(False)).cast("int"))
    recent = F.max("cross").over(last(recover)) == 1
    return df.withColumn("signal", F.when(~full(long + 5), 0.0).when(recent, 1.0).when(F.col("fast") < F.col("slow"), -0.3).otherwise(0.0))


def swings(df: DataFrame, k: int = 2) -> DataFrame:
    """swing_high, swing_low: whether a bar tops, bottoms its k neighbours on each side. Known only k bars later."""
    def beyond(name: str, way: int) -> Column:
        all_ = F.lit(True)
        for j in range(1, k + 1):
            for other in (lag(name, j), lead(name, j)):
                all_ = all_ & ((F.col(name) > other) if way > 0 else (F.col(name) < other))
        return F.coalesce(all_, F.lit(False))

    return df.withColumn("swing_high", beyond("high", 1)).withColumn("swing_low", beyond("low", -1))


def structure(df: DataFrame, k: int = 2) -> DataFrame:
    """Trend and event of each bar from swings confirmed by then: trend, event, event_dir, last_high, last_low."""
    df = swings(df, k)
    seen = by().rowsBetween(Window.unboundedPreceding, 0)
    for name, flag in (("high", "swing_high"), ("low", "swing_low")):
        was = F.when(lag(flag, k), lag(name, k))
        df = df.withColumn(f"_{name}", was)
        df = df.withColumn(f"last_{name}", F.last(f"_{name}", ignorenulls=True).over(seen))
        # the value the last swing replaced: what stood before the latest confirmation
        df = df.withColumn(f"_was_{name}", F.when(F.col(f"_{name}").isNotNull(), F.last(f"_{name}", ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, -1))))
        df = df.withColumn(f"prior_{name}", F.last(f"_was_{name}", ignorenulls=True).over(seen))
    up = (F.col("last_high") > F.col("prior_high")) & (F.col("last_low") > F.col("prior_low"))
    down = (F.col("last_high") < F.col("prior_high")) & (F.col("last_low") < F.col("prior_low"))
    df = df.withColumn("trend", F.when(up, "up").when(down, "down").otherwise("range"))
    over, under = F.col("close") > F.col("last_high"), F.col("close") < F.col("last_low")
    rising, falling = F.col("trend") == "up", F.col("trend") == "down"
    df = df.withColumn("event", F.when((rising & under) | (falling & over), "CHoCH").when((rising & over) | (falling & under), "BOS"))
    df = df.withColumn("event_dir", F.when(F.col("event").isNull(), 0).when(over, 1).otherwise(-1))
    return df.drop("_high", "_low", "_was_high", "_was_low", "swing_high", "swing_low", "prior_high", "prior_low")


def candle_patterns() -> Column:
    """Names of the patterns that the bar completes, in a fixed order."""
    o, c, h, l = (F.col(x) for x in ("open", "close", "high", "low"))
    body, span = F.abs(c - o), h - l
    up, low = h - F.greatest(c, o), F.least(c, o) - l
    po, pc = lag("open"), lag("close")
    found = [
        F.when(body <= 0.1 * span, "doji"),
        F.when((body > 0) & (low >= 2 * body) & (up <= body), "hammer"),
        F.when((body > 0) & (up >= 2 * body) & (low <= body), "shooting_star"),
        F.when((pc < po) & (c > o) & (c >= po) & (o <= pc), "bullish_engulfing"),
        F.when((pc > po) & (c < o) & (o >= pc) & (c <= po), "bearish_engulfing"),
    ]
    return F.array_join(F.array_compact(F.array(*found)), ",")


def trapped(level: Column, way: int, n: int = 3, tolerance: float = 0.001) -> Column:
    """Whether one of the last n bars went past the level and closed back."""
    if way > 0:
        one = (F.col("high") > level * (1 + tolerance)) & (F.col("close") < level)
    else:
        one = (F.col("low") < level * (1 - tolerance)) & (F.col("close") > level)
    return F.max(F.coalesce(one, F.lit(False)).cast("int")).over(last(n)) == 1


def gaps(df: DataFrame) -> DataFrame:
    """Three-bar gaps: symbol, t, way, gap_low, gap_high, filled (by any later bar)."""
    later = Window.partitionBy("symbol").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)  # latest first: the frame grows
    df = df.withColumn("_h", lag("high", 2)).withColumn("_l", lag("low", 2)).withColumn("_minlow", F.min("low").over(later)).withColumn("_maxhigh", F.max("high").over(later))
    up = df.where("_h < low").select("symbol", "t", F.lit(1).alias("way"), F.col("_h").alias("gap_low"), F.col("low").alias("gap_high"), F.coalesce(F.col("_minlow") <= F.col("_h"), F.lit(False)).alias("filled"))
    down = df.where("_l > high").select("symbol", "t", F.lit(-1).alias("way"), F.col("high").alias("gap_low"), F.col("_l").alias("gap_high"), F.coalesce(F.col("_maxhigh") >= F.col("_l"), F.lit(False)).alias("filled"))
    return up.unionByName(down)


def up_fraction(n: int = 63) -> Column:
    """Share of rises among the last n changes."""
    rise = (F.col("close") > lag("close")).cast("int")
    return rise


def slope_probability(df: DataFrame, n: int = 20, clip: float = 3.0) -> DataFrame:
    """Least-squares slope over the spread of changes, clipped, as a probability; 0.5 under three closes."""
    df = df.withColumn("_x", place().cast("double")).withColumn("_d", F.col("close") - lag("close"))
    slope = F.regr_slope("close", "_x").over(last(n))
    spread = F.stddev_pop("_d").over(last(n - 1))
    short = F.row_number().over(by())
    spread = F.when(short <= n, F.stddev_pop("_d").over(last(n))).otherwise(spread)
    z = F.greatest(F.lit(-clip), F.least(F.lit(clip), slope / F.when(spread == 0, 1e-9).otherwise(spread)))
    return df.withColumn("p", F.when(short < 3, 0.5).otherwise((z + clip) / (2 * clip))).drop("_x", "_d")


def log_return() -> Column:
    was = lag("close")
    return F.when((was > 0) & (F.col("close") > 0), F.log(F.try_divide("close", was)))


def zscore(name: str, n: int, sample: bool = False, least: int = 10) -> Column:
    """Of the current row among the last n; population or sample spread; null under least rows or without spread."""
    spread = (F.stddev_samp if sample else F.stddev_pop)(name).over(last(n))
    return F.when((F.count(name).over(last(n)) >= least) & (spread > 0), (F.col(name) - F.avg(name).over(last(n))) / spread)


def drawdown(name: str) -> Column:
    """Fall from the highest value so far, as a share of it (0 or more)."""
    peak = F.max(name).over(by().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(peak > 0, (peak - F.col(name)) / peak).otherwise(0.0)


def volatility_regime(df: DataFrame, short: int = 14, long: int = 100) -> DataFrame:
    """Spread of recent returns against that of many: ratio, regime, scale."""
    was = lag("close")
    df = df.withColumn("_r", F.when(was != 0, (F.col("close") - was) / was))
    tiny = lambda c: F.when(c == 0, 1e-12).otherwise(c)
    ratio = tiny(F.stddev_pop("_r").over(last(short))) / tiny(F.stddev_pop("_r").over(last(long)))
    df = df.withColumn("ratio", F.when(full(short + 2), ratio).otherwise(1.0)).withColumn("_n", full(short + 2))
    r = F.col("ratio")
    return df.withColumn("regime", F.when(~F.col("_n"), "n/a").when(r >= 2.5, "extreme").when(r >= 1.8, "stressed").when(r <= 0.5, "calm").otherwise("normal")).withColumn(
        "scale", F.when(~F.col("_n"), 1.0).when(r >= 2.5, 0.6).when(r >= 1.8, 0.85).otherwise(1.0)).drop("_r", "_n")


def future_return(h: int) -> Column:
    """Return to the close h bars on; null where there is none."""
    return F.when(F.col("close") != 0, (lead("close", h) - F.col("close")) / F.col("close")).otherwise(0.0)


def corwin_schultz(df: DataFrame) -> DataFrame:
    """Spread from the highs and lows of two bars; 0 where negative, or a low is not above 0, null for the first bar."""
    import math

    low, was = F.least(F.col("low"), lag("low")), lag("low")
    square = lambda c: F.pow(F.log(c), 2)
    beta = square(F.try_divide("high", "low")) + square(F.try_divide(lag("high"), lag("low")))
    gamma = square(F.try_divide(F.greatest(F.col("high"), lag("high")), low))
    k = 3 - 2 * math.sqrt(2)
    df = df.withColumn("_a", (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k))
    spread = F.greatest(F.lit(0.0), 2 * (F.exp("_a") - 1) / (1 + F.exp("_a")))
    return df.withColumn("spread", F.when(was.isNotNull(), F.when(low > 0, spread).otherwise(0.0))).drop("_a")


def bipower(df: DataFrame, n: int = 60) -> DataFrame:
    """Realised variance, bipower variation and the share that jumps make of it, over the last n returns."""
    import math

    df = df.withColumn("_r", log_return())
    df = df.withColumn("_c", F.abs("_r") * F.abs(lag("_r")))
    df = df.withColumn("rv", F.sum(F.col("_r") * F.col("_r")).over(last(n))).withColumn("bv", math.pi / 2 * F.sum("_c").over(last(n - 1)))
    return df.withColumn("jump", F.when(F.col("rv") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("rv") - F.col("bv")) / F.col("rv")))).otherwise(0.0)).drop("_r", "_c")
