"""Window operators over bars, and folds in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds as P
from ..operators import windows as W
from .registry import query
from .views import BARS, EV, SIGNALS, WALK, Views

KEY = ["symbol", "t"]
B = "WITH " + BARS
R = "WITH RECURSIVE " + BARS
BY = "(PARTITION BY symbol ORDER BY t)"


def frame(n: int, to: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {n} PRECEDING AND {to})"


def r6(name: str):
    return F.round(name, 6).alias(name)


def out(df, *names):
    return df.select(*KEY, *[r6(n) for n in names])


def ema_sql(k: int, value: str, source: str = "bars", seed: str = "mean") -> str:
    """A recursive table e(symbol, rn, ema) over source(symbol, rn, value)."""
    if seed == "mean":
        head = f"SELECT symbol, {k}::BIGINT AS rn, avg({value}) AS ema FROM {source} WHERE rn <= {k} GROUP BY symbol HAVING count(*) = {k}"
    else:
        head = f"SELECT symbol, rn, {value} AS ema FROM {source} WHERE rn = 1"
    return f"({head} UNION ALL SELECT s.symbol, s.rn, (s.{value} - e.ema) * (2.0::DOUBLE / {k + 1}) + e.ema FROM {{name}} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"


@query("bars_view", B + " SELECT symbol, t, rn, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def _(v: Views):
    return v.bars.select("symbol", "t", "rn", r6("open"), r6("high"), r6("low"), r6("close"), "volume")


@query("w1_ema_mean_seed", R + f", e AS {ema_sql(9, 'close').format(name='e')} SELECT symbol, t, round(ema, 6) AS ema FROM bars LEFT JOIN e USING (symbol, rn)")
def _(v):
    return out(P.per_series(v.bars, lambda g: {"ema": P.ema_seeded(g["close"].to_numpy(float), 9)}, "ema double"), "ema").replace(float("nan"), None)


@query("w2_ema_first_seed", R + f", e AS {ema_sql(12, 'close', seed='first').format(name='e')} SELECT symbol, t, round(ema, 6) AS ema FROM bars LEFT JOIN e USING (symbol, rn)")
def _(v):
    return out(P.per_series(v.bars, lambda g: {"ema": P.ema_first(g["close"].to_numpy(float), 12)}, "ema double"), "ema")


RSI = """ch AS (SELECT symbol, t, rn, close - lag(close) OVER (PARTITION BY symbol ORDER BY t) AS d FROM bars),
rw AS (SELECT symbol, 15::BIGINT AS rn, avg(greatest(d, 0)) AS up, avg(greatest(-d, 0)) AS down FROM ch WHERE rn BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT c.symbol, c.rn, (rw.up * 13 + greatest(c.d, 0)) / 14, (rw.down * 13 + greatest(-c.d, 0)) / 14 FROM rw JOIN ch c ON c.symbol = rw.symbol AND c.rn = rw.rn + 1),
rsi AS (SELECT symbol, rn, CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM rw)"""
TR = """tr AS (SELECT symbol, t, rn, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY t)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY t))) AS tr FROM bars),
aw AS (SELECT symbol, 15::BIGINT AS rn, avg(tr) AS atr FROM tr WHERE rn BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT x.symbol, x.rn, (aw.atr * 13 + x.tr) / 14 FROM aw JOIN tr x ON x.symbol = aw.symbol AND x.rn = aw.rn + 1)"""


@query("w3_rsi", R + ", " + RSI + " SELECT symbol, t, round(rsi, 6) AS rsi FROM bars LEFT JOIN rsi USING (symbol, rn)")
def _(v):
    return out(P.per_series(v.bars, lambda g: {"rsi": P.rsi(g["close"].to_numpy(float))}, "rsi double"), "rsi").replace(float("nan"), None)


@query("w3_rsi_padded", R + ", " + RSI + " SELECT symbol, t, round(coalesce(rsi, 50.0), 6) AS rsi, CASE WHEN coalesce(rsi, 50.0) < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END AS signal FROM bars LEFT JOIN rsi USING (symbol, rn)")
def _(v):
    df = P.per_series(v.bars, lambda g: {"rsi": P.rsi(g["close"].to_numpy(float), early=50.0)}, "rsi double")
    return df.select(*KEY, r6("rsi"), F.when(F.col("rsi") < 30, 1).when(F.col("rsi") > 70, -1).otherwise(0).alias("signal"))


@query("w4_atr_wilder", R + ", " + TR + " SELECT symbol, t, round(atr, 6) AS atr FROM bars LEFT JOIN aw USING (symbol, rn)")
def _(v):
    return out(P.per_series(v.bars, lambda g: {"atr": P.atr(*(g[c].to_numpy(float) for c in ("high", "low", "close")))}, "atr double"), "atr").replace(float("nan"), None)


@query("w4_atr_simple", B + f", x AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {BY}), abs(low - lag(close) OVER {BY})) AS tr FROM bars) SELECT symbol, t, CASE WHEN rn >= 15 THEN round(avg(tr) OVER {frame(13)}, 6) END AS atr FROM x")
def _(v):
    return out(W.atr_simple(v.bars), "atr")


@query("w5_macd", R + f", f AS {ema_sql(12, 'close', seed='first').format(name='f')}, s AS {ema_sql(26, 'close', seed='first').format(name='s')}, m AS (SELECT symbol, rn, f.ema - s.ema AS line FROM f JOIN s USING (symbol, rn)), g AS {ema_sql(9, 'line', 'm', 'first').format(name='g')} SELECT symbol, t, round(line, 6) AS line, round(g.ema, 6) AS signal_line, CASE WHEN rn <= 26 THEN 0 WHEN round(line, 9) > round(g.ema, 9) THEN 1 ELSE -1 END AS signal FROM bars JOIN m USING (symbol, rn) JOIN g USING (symbol, rn)")
def _(v):
    def fold(g):
        line, sig = P.macd(g["close"].to_numpy(float))
        return {"line": line, "signal_line": sig}

    df = P.per_series(v.bars, fold, "line double, signal_line double")
    return df.select(*KEY, r6("line"), r6("signal_line"), F.when(F.col("rn") <= 26, 0).when(F.round("line", 9) > F.round("signal_line", 9), 1).otherwise(-1).alias("signal"))


@query("w5_bollinger", B + f", x AS (SELECT *, avg(close) OVER {frame(20, '1 PRECEDING')} AS mid, coalesce(nullif(stddev_pop(close) OVER {frame(20, '1 PRECEDING')}, 0), 1e-9) AS sd FROM bars) SELECT symbol, t, CASE WHEN rn > 20 THEN round(mid, 6) END AS mid, CASE WHEN rn > 20 THEN round(sd, 6) END AS sd, CASE WHEN rn > 20 AND close < mid - 2 * sd THEN 1 WHEN rn > 20 AND close > mid + 2 * sd THEN -1 ELSE 0 END AS signal FROM x")
def _(v):
    return W.bollinger(v.bars).select(*KEY, r6("mid"), r6("sd"), "signal")


@query("w5_donchian", B + f", x AS (SELECT *, max(high) OVER {frame(20, '1 PRECEDING')} AS top, min(low) OVER {frame(20, '1 PRECEDING')} AS bottom FROM bars) SELECT symbol, t, CASE WHEN rn > 20 AND close > top THEN 1 WHEN rn > 20 AND close < bottom THEN -1 ELSE 0 END AS signal FROM x")
def _(v):
    return W.donchian(v.bars).select(*KEY, "signal")


@query("w6_momentum", B + f" SELECT symbol, t, round((close / nullif(lag(close, 14) OVER {BY}, 0) - 1) * 100, 6) AS momentum FROM bars")
def _(v):
    return v.bars.select(*KEY, F.round(W.momentum(14), 6).alias("momentum"))


_SG = W.savitzky_weights(11, 2)


@query("w7_savitzky_golay", B + ", w AS (SELECT unnest([" + ", ".join(f"{x!r}::DOUBLE" for x in _SG) + "]) AS w, unnest(range(-5, 6)) AS o), n AS (SELECT symbol, max(rn) AS n FROM bars GROUP BY 1) SELECT a.symbol, a.t, round(sum(w * b.close), 6) AS smooth FROM bars a JOIN n USING (symbol) CROSS JOIN w JOIN bars b ON b.symbol = a.symbol AND b.rn = least(greatest(a.rn + o, 1), n) GROUP BY ALL")
def _(v):
    return out(W.savitzky_golay(v.bars), "smooth")


@query("w8_anchored_level", B + f", x AS (SELECT *, max(volume) OVER {frame(19)} AS top FROM bars) SELECT a.symbol, a.t, round(arg_min(b.close, b.rn), 6) AS level FROM x a JOIN bars b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 19 AND a.rn AND b.volume = a.top GROUP BY ALL")
def _(v):
    return v.bars.select(*KEY, F.round(W.anchored_level(20), 6).alias("level"))


@query("w8_volume_bias", B + f", x AS (SELECT *, lag(volume) OVER {BY} AS was FROM bars) SELECT a.symbol, a.t, sum(CASE WHEN b.close > b.open THEN 1 WHEN b.close < b.open THEN -1 ELSE 0 END * CASE WHEN b.volume > b.was AND b.rn > greatest(1, a.rn - 19) THEN 3 ELSE 1 END)::BIGINT AS bias FROM bars a JOIN x b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY ALL")
def _(v):
    return W.volume_bias(v.bars).select(*KEY, "bias")


CLV = "CASE WHEN high <= low THEN 0.0 ELSE greatest(-1.0, least(1.0, (2 * close - low - high) / (high - low))) END"


@query("w9_money_flow", B + f", x AS (SELECT *, {CLV} AS clv FROM bars) SELECT symbol, t, round(clv, 6) AS clv, CASE WHEN rn >= 5 THEN round(CASE WHEN sum(volume) OVER {frame(4)} > 0 THEN sum(clv * volume) OVER {frame(4)} / sum(volume) OVER {frame(4)} ELSE avg(clv) OVER {frame(4)} END, 6) END AS ned FROM x")
def _(v):
    return out(W.money_flow(v.bars), "clv", "ned")


@query("w10_ribbons", B + f", x AS (SELECT *, CASE WHEN rn >= 30 THEN avg(close) OVER {frame(29)} END AS fast, CASE WHEN rn >= 60 THEN avg(close) OVER {frame(59)} END AS slow FROM bars), c AS (SELECT *, coalesce(round(lag(fast) OVER {BY}, 9) < round(lag(slow) OVER {BY}, 9) AND round(fast, 9) > round(slow, 9), false)::INT AS crossed FROM x) SELECT symbol, t, CASE WHEN rn < 65 THEN 0.0 WHEN max(crossed) OVER {frame(13)} = 1 THEN 1.0 WHEN fast < slow THEN -0.3 ELSE 0.0 END::DOUBLE AS signal FROM c")
def _(v):
    return W.ribbons(v.bars, "close").select(*KEY, "signal")


@query("w11_swings", B + f" SELECT symbol, t, coalesce(high > lag(high, 1) OVER {BY} AND high > lag(high, 2) OVER {BY} AND high > lead(high, 1) OVER {BY} AND high > lead(high, 2) OVER {BY}, false) AS swing_high, coalesce(low < lag(low, 1) OVER {BY} AND low < lag(low, 2) OVER {BY} AND low < lead(low, 1) OVER {BY} AND low < lead(low, 2) OVER {BY}, false) AS swing_low FROM bars")
def _(v):
    return W.swings(v.bars).select(*KEY, "swing_high", "swing_low")


SW = f"""sw AS (SELECT *, high > lag(high, 1) OVER {BY} AND high > lag(high, 2) OVER {BY} AND high > lead(high, 1) OVER {BY} AND high > lead(high, 2) OVER {BY} AS sh, low < lag(low, 1) OVER {BY} AND low < lag(low, 2) OVER {BY} AND low < lead(low, 1) OVER {BY} AND low < lead(low, 2) OVER {BY} AS sl FROM bars),
ms AS (SELECT a.symbol, a.t, a.rn, a.close, (SELECT list(high ORDER BY rn DESC) FROM sw b WHERE b.symbol = a.symbol AND b.rn <= a.rn - 2 AND b.sh) AS hs, (SELECT list(low ORDER BY rn DESC) FROM sw b WHERE b.symbol = a.symbol AND b.rn <= a.rn - 2 AND b.sl) AS ls FROM bars a),
tr AS (SELECT *, hs[1] AS last_high, ls[1] AS last_low, CASE WHEN hs[1] > hs[2] AND ls[1] > ls[2] THEN 'up' WHEN hs[1] < hs[2] AND ls[1] < ls[2] THEN 'down' ELSE 'range' END AS trend FROM ms),
st AS (SELECT *, CASE WHEN (trend = 'up' AND close < last_low) OR (trend = 'down' AND close > last_high) THEN 'CHoCH' WHEN (trend = 'up' AND close > last_high) OR (trend = 'down' AND close < last_low) THEN 'BOS' END AS event FROM tr)"""


@query("w12_structure", B + ", " + SW + " SELECT symbol, t, trend, event, CASE WHEN event IS NULL THEN 0 WHEN close > last_high THEN 1 ELSE -1 END AS event_dir, round(last_high, 6) AS last_high, round(last_low, 6) AS last_low FROM st")
def _(v):
    return W.structure(v.bars).select(*KEY, "trend", "event", "event_dir", r6("last_high"), r6("last_low"))


@query("w13_candle_patterns", B + f", x AS (SELECT *, abs(close - open) AS body, high - low AS span, high - greatest(open, close) AS up, least(open, close) - low AS lo, lag(open) OVER {BY} AS po, lag(close) OVER {BY} AS pc FROM bars) SELECT symbol, t, array_to_string(list_filter([CASE WHEN body <= 0.1 * span THEN 'doji' END, CASE WHEN body > 0 AND lo >= 2 * body AND up <= body THEN 'hammer' END, CASE WHEN body > 0 AND up >= 2 * body AND lo <= body THEN 'shooting_star' END, CASE WHEN pc < po AND close > open AND close >= po AND open <= pc THEN 'bullish_engulfing' END, CASE WHEN pc > po AND close < open AND open >= pc AND close <= po THEN 'bearish_engulfing' END], lambda y: y IS NOT NULL), ',') AS patterns FROM x")
def _(v):
    return v.bars.select(*KEY, W.candle_patterns().alias("patterns"))


@query("w14_trap", B + f", x AS (SELECT *, max(high) OVER {frame(10, '4 PRECEDING')} AS level FROM bars) SELECT a.symbol, a.t, coalesce(bool_or(b.high > a.level * 1.001 AND b.close < a.level), false) AS trap FROM x a JOIN bars b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 2 AND a.rn GROUP BY ALL")
def _(v):
    df = v.bars.withColumn("level", F.max("high").over(W.by().rowsBetween(-10, -4)))
    one = lambda k: F.coalesce((F.lag("high", k).over(W.by()) > F.col("level") * 1.001) & (F.lag("close", k).over(W.by()) < F.col("level")), F.lit(False))
    return df.select(*KEY, (F.coalesce((F.col("high") > F.col("level") * 1.001) & (F.col("close") < F.col("level")), F.lit(False)) | one(1) | one(2)).alias("trap"))


@query("w15_gaps", "WITH " + WALK + ", g AS (SELECT c.symbol, c.t, c.rn, 1 AS way, a.high AS gap_low, c.low AS gap_high FROM walk a JOIN walk c ON a.symbol = c.symbol AND c.rn = a.rn + 2 WHERE a.high < c.low UNION ALL SELECT c.symbol, c.t, c.rn, -1, c.high, a.low FROM walk a JOIN walk c ON a.symbol = c.symbol AND c.rn = a.rn + 2 WHERE a.low > c.high) SELECT symbol, t, way, round(gap_low, 6) AS gap_low, round(gap_high, 6) AS gap_high, EXISTS (SELECT 1 FROM walk b WHERE b.symbol = g.symbol AND b.rn > g.rn AND CASE WHEN way = 1 THEN b.low <= gap_low ELSE b.high >= gap_high END) AS filled FROM g")
def _(v):
    return W.gaps(v.walk).select(*KEY, "way", r6("gap_low"), r6("gap_high"), "filled")


@query("w19_up_fraction", B + f", x AS (SELECT *, (close > lag(close) OVER {BY})::INT AS up FROM bars) SELECT symbol, t, round(coalesce(avg(up) OVER {frame(62)}, 0.0), 6) AS up_fraction FROM x")
def _(v):
    return v.bars.withColumn("up", W.up_fraction()).select(*KEY, F.round(F.coalesce(F.avg("up").over(W.last(63)), F.lit(0.0)), 6).alias("up_fraction"))


@query("w19_slope_probability", B + f", x AS (SELECT *, close - lag(close) OVER {BY} AS d FROM bars), y AS (SELECT *, regr_slope(close, rn) OVER {frame(19)} AS slope, CASE WHEN rn <= 20 THEN stddev_pop(d) OVER {frame(19)} ELSE stddev_pop(d) OVER {frame(18)} END AS sd FROM x) SELECT symbol, t, CASE WHEN rn < 3 THEN 0.5 ELSE round((greatest(-3, least(3, slope / coalesce(nullif(sd, 0), 1e-9))) + 3) / 6, 6) END AS p FROM y")
def _(v):
    return out(W.slope_probability(v.bars), "p")


@query("w19_autocorrelation", B + f", x AS (SELECT *, ln(close / lag(close) OVER {BY}) AS r FROM bars), y AS (SELECT *, lag(r) OVER {BY} AS p FROM x) SELECT symbol, round(corr(r, p), 6) AS autocorrelation FROM y GROUP BY symbol")
def _(v):
    df = v.bars.withColumn("r", W.log_return())
    df = df.withColumn("p", W.lag("r")).where("p is not null")
    return df.groupBy("symbol").agg(F.round(F.try_divide(F.covar_pop("r", "p"), F.stddev_pop("r") * F.stddev_pop("p")), 6).alias("autocorrelation"))


@query("w20_transition_entropy", B + f", s AS (SELECT symbol, t, floor(close / 10)::BIGINT % 15 AS a, lead(floor(close / 10)::BIGINT % 15) OVER {BY} AS b FROM bars), c AS (SELECT symbol, a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY symbol, a) AS ra, sum(n) OVER (PARTITION BY symbol) AS total FROM c) SELECT symbol, round(sum(-(ra / total) * (n / ra) * ln(n / ra)) / ln(15), 6) AS entropy FROM r GROUP BY symbol")
def _(v):
    state = F.floor(F.col("close") / 10) % 15
    df = v.bars.select("symbol", "t", state.alias("a"), F.lead(state).over(W.by()).alias("b")).where("b is not null").groupBy("symbol", "a", "b").agg(F.count("*").alias("n"))
    df = df.withColumn("ra", F.sum("n").over(Window.partitionBy("symbol", "a"))).withColumn("total", F.sum("n").over(Window.partitionBy("symbol")))
    return df.groupBy("symbol").agg(F.round(F.sum(-(F.col("ra") / F.col("total")) * (F.col("n") / F.col("ra")) * F.log(F.col("n") / F.col("ra"))) / float(np.log(15)), 6).alias("entropy"))


MOTIF = "CASE WHEN x < y AND y < z THEN 0 WHEN x < z AND z <= y THEN 1 WHEN y <= x AND x < z THEN 2 WHEN z <= x AND x < y THEN 3 WHEN y < z AND z <= x THEN 4 ELSE 5 END"


@query("w21_permutation_entropy", B + f", p AS (SELECT symbol, t, close AS z, lag(close) OVER {BY} AS y, lag(close, 2) OVER {BY} AS x FROM bars), m AS (SELECT symbol, {MOTIF} AS motif, ((x - (x + y + z) / 3) ** 2 + (y - (x + y + z) / 3) ** 2 + (z - (x + y + z) / 3) ** 2) / 3 AS w FROM p WHERE x IS NOT NULL), g AS (SELECT symbol, motif, sum(w) AS w, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT *, sum(w) OVER (PARTITION BY symbol) AS total FROM g) SELECT symbol, round(-sum(w / total * ln(w / total)) / ln(6), 6) AS entropy, (6 - count(*))::BIGINT AS forbidden, sum(n)::BIGINT AS motifs FROM s WHERE w > 0 GROUP BY symbol")
def _(v):
    df = v.bars.select("symbol", F.col("close").alias("z"), W.lag("close").alias("y"), W.lag("close", 2).alias("x")).where("x is not null")
    mean = (F.col("x") + F.col("y") + F.col("z")) / 3
    weight = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in "yz"), (F.col("x") - mean) * (F.col("x") - mean)) / 3
    g = df.select("symbol", F.expr(MOTIF).alias("motif"), weight.alias("w")).groupBy("symbol", "motif").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    g = g.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("symbol"))).where("w > 0")
    return g.groupBy("symbol").agg(F.round(-F.sum(F.col("p") * F.log("p")) / float(np.log(6)), 6).alias("entropy"), (6 - F.count("*")).cast("bigint").alias("forbidden"), F.sum("n").cast("bigint").alias("motifs"))


@query("w22_forward_returns", B + f" SELECT symbol, t, round((lead(close, 4) OVER {BY} - close) / close, 6) AS fwd FROM bars QUALIFY lead(close, 4) OVER {BY} IS NOT NULL")
def _(v):
    return v.bars.select(*KEY, F.round(W.future_return(4), 6).alias("fwd")).where("fwd is not null")


@query("w22_purged_returns", B + f" SELECT symbol, t, round(lead(close, 4) OVER {BY} / close - 1, 6) AS fwd FROM bars QUALIFY lead(close, 4) OVER {BY} IS NOT NULL AND (rn - 1) % 4 = 0")
def _(v):
    return v.bars.withColumn("fwd", F.round(F.try_divide(W.lead("close", 4), "close") - 1, 6)).where("fwd is not null and (rn - 1) % 4 = 0").select(*KEY, "fwd")


@query("w23_cumulative_pnl", "WITH " + __import__("tidemark.plans.views", fromlist=["FILLS"]).FILLS + ", d AS (SELECT c_time // 1000 AS t, sum(profit - CASE WHEN fee_coin = 'USDT' THEN abs(fee) ELSE 0 END) AS net FROM fills GROUP BY 1) SELECT t, round(sum(net) OVER (ORDER BY t), 2) AS cum FROM d")
def _(v):
    day = v.fills.groupBy(F.expr("c_time div 1000").alias("t")).agg(F.sum(F.col("profit") - F.when(F.col("fee_coin") == "USDT", F.abs("fee")).otherwise(0.0)).alias("net"))
    return day.select("t", F.round(F.sum("net").over(Window.orderBy("t")), 2).alias("cum"))  # one row a day


@query("w24_drawdown", B + f", x AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM bars) SELECT symbol, t, round((peak - close) / peak, 6) AS drawdown, round(max((peak - close) / peak) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING), 6) AS worst FROM x")
def _(v):
    df = v.bars.withColumn("drawdown", W.drawdown("close"))
    return df.select(*KEY, r6("drawdown"), F.round(F.max("drawdown").over(W.by().rowsBetween(Window.unboundedPreceding, 0)), 6).alias("worst"))


@query("w26_ewma_volatility", R + f", r AS (SELECT symbol, rn - 1 AS rn, ln(close / lag(close) OVER {BY}) AS r FROM bars QUALIFY r IS NOT NULL), e AS (SELECT symbol, rn, r * r AS var FROM r WHERE rn = 1 UNION ALL SELECT r.symbol, r.rn, 0.94 * e.var + 0.06 * r.r * r.r FROM e JOIN r ON r.symbol = e.symbol AND r.rn = e.rn + 1) SELECT symbol, round(sqrt(arg_max(var, rn)), 6) AS vol FROM e GROUP BY symbol")
def _(v):
    run = lambda g: pd.DataFrame({"symbol": [g["symbol"].iloc[0]], "vol": [P.ewma_volatility(g.sort_values("t")["close"].to_numpy(float))]})
    return v.bars.select("symbol", "t", "close").groupBy("symbol").applyInPandas(run, "symbol string, vol double").select("symbol", r6("vol"))


@query("w26_garch_volatility", R + f", r AS (SELECT symbol, rn - 1 AS rn, ln(close / lag(close) OVER {BY}) AS r FROM bars QUALIFY r IS NOT NULL), w AS (SELECT symbol, var_pop(r) AS v FROM r GROUP BY 1), e AS (SELECT symbol, 0::BIGINT AS rn, v AS var, v FROM w UNION ALL SELECT r.symbol, r.rn, 0.05 * e.v + 0.10 * r.r * r.r + 0.85 * e.var, e.v FROM e JOIN r ON r.symbol = e.symbol AND r.rn = e.rn + 1) SELECT symbol, round(sqrt(arg_max(var, rn)), 6) AS vol FROM e GROUP BY symbol")
def _(v):
    run = lambda g: pd.DataFrame({"symbol": [g["symbol"].iloc[0]], "vol": [P.garch_volatility(g.sort_values("t")["close"].to_numpy(float))]})
    return v.bars.select("symbol", "t", "close").groupBy("symbol").applyInPandas(run, "symbol string, vol double").select("symbol", r6("vol"))


@query("w27_realised_vol", B + f", r AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER {BY} > 0 THEN ln(close / lag(close) OVER {BY}) END AS r FROM bars) SELECT symbol, round(stddev_pop(r), 6) AS realised, round(0.6005612 * avg(CASE WHEN low > 0 THEN ln(high / low) END), 6) AS parkinson, round(-quantile_cont(r, 0.05), 6) AS var95, round(stddev_pop(r) * arg_max(close, t) * sqrt(4), 6) AS expected_move FROM r GROUP BY symbol")
def _(v):
    df = v.bars.withColumn("r", W.log_return()).groupBy("symbol").agg(F.stddev_pop("r").alias("s"), F.avg(F.when(F.col("low") > 0, F.log(F.try_divide("high", "low")))).alias("hl"), F.percentile("r", 0.05).alias("q"), F.max_by("close", "t").alias("c"))
    return df.select("symbol", F.round("s", 6).alias("realised"), F.round(0.6005612 * F.col("hl"), 6).alias("parkinson"), F.round(-F.col("q"), 6).alias("var95"), F.round(F.col("s") * F.col("c") * 2, 6).alias("expected_move"))


@query("w28_spread_estimates", B + f", x AS (SELECT *, lag(high) OVER {BY} AS ph, lag(low) OVER {BY} AS pl, lag(close) OVER {BY} AS pc FROM bars), y AS (SELECT *, ln(high / low) ** 2 + ln(ph / pl) ** 2 AS beta, ln(greatest(high, ph) / least(low, pl)) ** 2 AS gamma FROM x WHERE low > 0 AND pl > 0), z AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM y) SELECT symbol, t, round(greatest(0, 2 * (exp(alpha) - 1) / (1 + exp(alpha))), 6) AS spread, round(abs(close / pc - 1) / (close * volume), 9) AS amihud FROM z")
def _(v):
    df = W.corwin_schultz(v.bars).withColumn("amihud", F.round(F.try_divide(F.abs(F.try_divide("close", W.lag("close")) - 1), F.col("close") * F.col("volume")), 9)).withColumn("pl", W.lag("low"))
    return df.where("low > 0 and pl > 0").select(*KEY, F.round("spread", 6).alias("spread"), "amihud")


@query("w29_bipower", B + f", r AS (SELECT *, ln(close / lag(close) OVER {BY}) AS r FROM bars), c AS (SELECT *, abs(r) * abs(lag(r) OVER {BY}) AS c FROM r), s AS (SELECT symbol, t, rn, sum(r * r) OVER {frame(59)} AS rv, pi() / 2 * sum(c) OVER {frame(58)} AS bv FROM c) SELECT symbol, t, round(rv, 6) AS rv, round(bv, 6) AS bv, round(CASE WHEN rv > 0 THEN CASE WHEN bv IS NULL THEN 0.0 ELSE greatest(0, least(1, (rv - bv) / rv)) END ELSE 0.0 END, 6) AS jump FROM s WHERE rn > 2")
def _(v):
    return out(W.bipower(v.bars).where("rn > 2"), "rv", "bv", "jump")


@query("w30_zscores", B + f" SELECT symbol, t, CASE WHEN count(close) OVER {frame(29)} >= 10 THEN round((close - avg(close) OVER {frame(29)}) / stddev_pop(close) OVER {frame(29)}, 6) END AS z_pop, CASE WHEN count(close) OVER {frame(29)} >= 10 THEN round((close - avg(close) OVER {frame(29)}) / stddev_samp(close) OVER {frame(29)}, 6) END AS z_sample FROM bars")
def _(v):
    return v.bars.select(*KEY, F.round(W.zscore("close", 30), 6).alias("z_pop"), F.round(W.zscore("close", 30, sample=True), 6).alias("z_sample"))


@query("w30_half_life", B + f", x AS (SELECT symbol, lag(close) OVER {BY} AS p, close - lag(close) OVER {BY} AS d FROM bars), s AS (SELECT symbol, regr_slope(d, p) AS b FROM x GROUP BY 1) SELECT symbol, round(b, 6) AS slope, CASE WHEN b < 0 THEN round(-ln(2) / b, 4) END AS half_life FROM s")
def _(v):
    df = v.bars.select("symbol", W.lag("close").alias("p"), (F.col("close") - W.lag("close")).alias("d")).groupBy("symbol").agg(F.regr_slope("d", "p").alias("b"))
    return df.select("symbol", F.round("b", 6).alias("slope"), F.when(F.col("b") < 0, F.round(-float(np.log(2)) / F.col("b"), 4)).alias("half_life"))


def clamp01(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


OPPORTUNITY = R + ", " + RSI + f""", f AS (SELECT *, max(close) OVER {frame(89)} AS hi, avg(close) OVER {frame(89)} AS ma, avg(close) OVER {frame(23)} AS ma24, ln(close / lag(close) OVER {BY}) AS r FROM bars),
g AS (SELECT f.*, rsi, stddev_pop(r) OVER {frame(22)} AS sd FROM f LEFT JOIN rsi USING (symbol, rn) WINDOW w AS {BY}),
h AS (SELECT *, greatest(0, least(1, (hi - close) / hi / 0.30)) AS s_dd, coalesce(greatest(0, least(1, (50 - rsi) / 40)), 0) AS s_rsi, greatest(0, least(1, (ma - close) / ma / 0.20)) AS s_ma, CASE WHEN rn < 25 OR sd <= 1e-9 THEN 0 ELSE greatest(0, least(1, (ma24 - close) / (close * sd) / 3)) END AS s_st FROM g),
o AS (SELECT *, CASE WHEN rn < 20 THEN 0 ELSE greatest(0, least(1, 0.7 * (0.35 * s_dd + 0.25 * s_rsi + 0.20 * s_ma) + 0.3 * s_st)) END AS score FROM h)
"""


def opportunity(v):
    """Bars with score: how cheap each close is against its past."""
    df = P.per_series(v.bars, lambda g: {"rsi": P.rsi(g["close"].to_numpy(float))}, "rsi double").replace(float("nan"), None, subset=["rsi"])
    c = F.col("close")
    hi, ma, ma24 = F.max("close").over(W.last(90)), F.avg("close").over(W.last(90)), F.avg("close").over(W.last(24))
    df = df.withColumn("r", W.log_return())
    sd = F.stddev_pop("r").over(W.last(23))
    df = df.withColumn("s_dd", clamp01((hi - c) / hi / 0.30)).withColumn("s_rsi", F.coalesce(clamp01((50 - F.col("rsi")) / 40), F.lit(0.0))).withColumn("s_ma", clamp01((ma - c) / ma / 0.20))
    df = df.withColumn("s_st", F.when((F.col("rn") < 25) | (sd <= 1e-9), 0.0).otherwise(clamp01((ma24 - c) / (c * sd) / 3)))
    score = F.when(F.col("rn") < 20, 0.0).otherwise(clamp01(0.7 * (0.35 * F.col("s_dd") + 0.25 * F.col("s_rsi") + 0.20 * F.col("s_ma")) + 0.3 * F.col("s_st")))
    return df.withColumn("score", score)


@query("w31_opportunity_score", OPPORTUNITY + "SELECT symbol, t, round(score, 6) AS score, round(10.0 * (1 + 4 * score), 4) AS amount FROM o")
def _(v):
    return opportunity(v).select(*KEY, F.round("score", 6).alias("score"), F.round(10.0 * (1 + 4 * F.col("score")), 4).alias("amount"))


@query("w32_nearest_variation", B + ", p AS (SELECT a.symbol, a.t, a.close, b.close AS was, abs(b.t - (a.t - 7 * 86400)) AS gap, b.t AS bt FROM bars a JOIN bars b ON a.symbol = b.symbol AND abs(b.t - (a.t - 7 * 86400)) <= 1.5 * 86400) SELECT symbol, t, round((close / arg_min(was, gap * 1000000000000 + bt) - 1) * 100, 6) AS change_pct FROM p GROUP BY symbol, t, close")
def _(v):
    from ..operators.joins import nearest_before

    df = nearest_before(v.bars.select("symbol", "t", "close"), 7 * 86400, int(1.5 * 86400))
    return df.where("was is not null").select(*KEY, F.round((F.try_divide("close", "was") - 1) * 100, 6).alias("change_pct"))


@query("w33_series_summary", B + f", x AS (SELECT *, lag(close, 13) OVER {BY} AS was, avg(close / 100000) OVER {frame(29)} AS rate FROM bars) SELECT symbol, round(arg_max(close, t), 6) AS last, round(arg_max(close - was, t), 6) AS change, round(arg_max(rate, t) * 3 * 365 * 100, 6) AS apr_gross, round(arg_max(rate, t) * 3 * 365 * 100 - 0.2 * 365 / 30, 6) AS apr_net FROM x GROUP BY symbol")
def _(v):
    df = v.bars.withColumn("was", W.lag("close", 13)).withColumn("rate", F.avg(F.col("close") / 100000).over(W.last(30)))
    g = df.groupBy("symbol").agg(F.max_by("close", "t").alias("c"), F.max_by(F.col("close") - F.col("was"), "t").alias("d"), F.max_by("rate", "t").alias("rate"))
    gross = F.col("rate") * 3 * 365 * 100
    return g.select("symbol", F.round("c", 6).alias("last"), F.round("d", 6).alias("change"), F.round(gross, 6).alias("apr_gross"), F.round(gross - 0.2 * 365 / 30, 6).alias("apr_net"))


@query("w35_markout", B + f", x AS (SELECT symbol, t, close, lead(close, 5) OVER {BY} AS later, CASE WHEN close >= open THEN 1 ELSE -1 END AS sgn FROM bars) SELECT symbol, round(avg(sgn * (later - close) / close * 10000), 4) AS markout_bps, count(later)::BIGINT AS n FROM x GROUP BY symbol")
def _(v):
    df = v.bars.select("symbol", "close", W.lead("close", 5).alias("later"), F.when(F.col("close") >= F.col("open"), 1).otherwise(-1).alias("sgn"))
    return df.groupBy("symbol").agg(F.round(F.avg(F.try_divide(F.col("sgn") * (F.col("later") - F.col("close")), "close") * 10000), 4).alias("markout_bps"), F.count("later").alias("n"))


@query("w36_hit_rate", R + f", x AS (SELECT symbol, rn, (lead(close) OVER {BY} > close)::INT::DOUBLE AS hit FROM bars QUALIFY lead(close) OVER {BY} IS NOT NULL), e AS (SELECT symbol, 0::BIGINT AS rn, 0.5::DOUBLE AS hr FROM x GROUP BY symbol UNION ALL SELECT x.symbol, x.rn, 0.9 * e.hr + 0.1 * x.hit FROM e JOIN x ON x.symbol = e.symbol AND x.rn = e.rn + 1) SELECT symbol, round(arg_max(hr, rn), 6) AS hit_rate FROM e GROUP BY symbol")
def _(v):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        c, hr = g.sort_values("t")["close"].to_numpy(float), 0.5
        for up in (c[1:] > c[:-1]):
            hr = 0.9 * hr + 0.1 * float(up)
        return pd.DataFrame({"symbol": [g["symbol"].iloc[0]], "hit_rate": [round(hr, 6)]})

    return v.bars.select("symbol", "t", "close").groupBy("symbol").applyInPandas(run, "symbol string, hit_rate double")


@query("w37_volatility_regime", B + f", x AS (SELECT *, (close - lag(close) OVER {BY}) / lag(close) OVER {BY} AS r FROM bars), y AS (SELECT *, CASE WHEN rn >= 16 THEN stddev_pop(r) OVER {frame(13)} / stddev_pop(r) OVER {frame(99)} ELSE 1.0 END AS ratio FROM x) SELECT symbol, t, round(ratio, 6) AS ratio, CASE WHEN rn < 16 THEN 'n/a' WHEN ratio >= 2.5 THEN 'extreme' WHEN ratio >= 1.8 THEN 'stressed' WHEN ratio <= 0.5 THEN 'calm' ELSE 'normal' END AS regime FROM y")
def _(v):
    return W.volatility_regime(v.bars).select(*KEY, r6("ratio"), "regime")


@query("w38_daily_baseline", R + ", e AS (SELECT symbol, t, rn, close, close AS baseline FROM bars WHERE rn = 1 UNION ALL SELECT b.symbol, b.t, b.rn, b.close, CASE WHEN b.t // 86400 <> e.t // 86400 THEN b.close WHEN abs(b.close - e.close) / e.close > 0.15 THEN e.baseline + b.close - e.close ELSE e.baseline END FROM e JOIN bars b ON b.symbol = e.symbol AND b.rn = e.rn + 1) SELECT symbol, t, round(close, 6) AS close, round(baseline, 6) AS baseline, round((baseline - close) / baseline, 6) AS loss FROM e")
def _(v):
    df = P.per_series(v.bars.select("symbol", "t", "close"), lambda g: {"baseline": P.drift_baseline(g["t"].to_numpy(), g["close"].to_numpy(float))}, "baseline double")
    return df.select(*KEY, r6("close"), r6("baseline"), F.round((F.col("baseline") - F.col("close")) / F.col("baseline"), 6).alias("loss"))


@query("w39_trend_cross", R + f", f AS {ema_sql(9, 'close').format(name='f')}, s AS {ema_sql(21, 'close').format(name='s')}, x AS (SELECT b.symbol, b.t, b.rn, round(f.ema, 9) AS f, round(s.ema, 9) AS s FROM bars b JOIN f USING (symbol, rn) JOIN s USING (symbol, rn)) SELECT symbol, t, CASE WHEN f > s AND lag(f) OVER {BY} <= lag(s) OVER {BY} THEN 'cross_up' WHEN f < s AND lag(f) OVER {BY} >= lag(s) OVER {BY} THEN 'cross_down' WHEN f > s THEN 'above' ELSE 'below' END AS state FROM x")
def _(v):
    df = P.indicators(v.bars).where("ema_slow is not null and not isnan(ema_slow)").select(*KEY, F.round("ema_fast", 9).alias("f"), F.round("ema_slow", 9).alias("s"))
    f, s, pf, ps = F.col("f"), F.col("s"), W.lag("f"), W.lag("s")
    return df.select(*KEY, F.when((f > s) & (pf <= ps), "cross_up").when((f < s) & (pf >= ps), "cross_down").when(f > s, "above").otherwise("below").alias("state"))


@query("x26_week_return", B + f" SELECT symbol, t, round(close / lag(close, 27) OVER {BY} - 1, 6) AS week_return FROM bars")
def _(v):
    return v.bars.select(*KEY, F.round(F.try_divide("close", W.lag("close", 27)) - 1, 6).alias("week_return"))


@query("x33_log_returns", B + f", x AS (SELECT symbol, t, ln(close / lag(close) OVER {BY}) AS r FROM bars) SELECT symbol, t, round(r, 6) AS r, round((r - avg(r) OVER (PARTITION BY symbol)) / stddev_pop(r) OVER (PARTITION BY symbol), 6) AS z FROM x")
def _(v):
    all_ = Window.partitionBy("symbol")
    df = v.bars.withColumn("r", W.log_return())
    return df.select(*KEY, r6("r"), F.round((F.col("r") - F.avg("r").over(all_)) / F.stddev_pop("r").over(all_), 6).alias("z"))
