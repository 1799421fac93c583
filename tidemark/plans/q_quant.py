"""Validation statistics, regimes, ensembles and simulations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, normal_cdf_sql
from ..operators import ensemble as EN
from ..operators import folds as P
from ..operators import joins as J
from ..operators import quant as Q
from ..operators import strategies as ST
from ..operators import structure as SM
from ..operators import windows as W
from .q_windows import OPPORTUNITY, B, BY, frame, opportunity
from .registry import query
from .views import BARS, EV, SIGNALS, VOTES, WALK

VO = "WITH " + VOTES
PAIRS = VOTES + ", days AS (SELECT DISTINCT symbol, t, price FROM votes), nx AS (SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY t) AS later FROM days), pr AS (SELECT v.agent, v.symbol, v.t, v.vote, v.confidence, round(later / v.price - 1, 9) AS fwd FROM votes v JOIN nx USING (symbol, t) WHERE later IS NOT NULL)"
RANKS = "rk AS (SELECT *, rank() OVER (PARTITION BY agent ORDER BY vote) + (count(*) OVER (PARTITION BY agent, vote) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY agent ORDER BY fwd) + (count(*) OVER (PARTITION BY agent, fwd) - 1) / 2.0 AS rb FROM pr), ic AS (SELECT agent, count(*) AS n, corr(ra, rb) AS ic FROM rk GROUP BY 1)"


def pairs(v):
    days = v.votes.select("symbol", "t", "price").distinct().withColumn("later", F.lead("price").over(Window.partitionBy("symbol").orderBy("t"))).where("later is not null")
    return v.votes.join(days.select("symbol", "t", "later"), ["symbol", "t"]).withColumn("fwd", F.round(F.col("later") / F.col("price") - 1, 9)).drop("later")


@query("q1_rank_ic", "WITH " + PAIRS + ", " + RANKS + " SELECT agent, n, round(ic, 6) AS ic, round(ic * sqrt((n - 2) / (1 - ic * ic)), 6) AS ic_t FROM ic")
def _(v):
    return Q.rank_ic(pairs(v), ["agent"]).select("agent", "n", F.round("ic", 6).alias("ic"), F.round("ic_t", 6).alias("ic_t"))


MOMENTS = ", st AS (SELECT agent, vote, fwd, sign(vote) * fwd AS s FROM pr), mo AS (SELECT agent, avg(s) AS m, stddev_pop(s) AS sp, stddev_samp(s) AS ss, avg(s * s) AS m2, avg(s ** 3) AS m3, avg(s ** 4) AS m4, avg(CASE WHEN vote <> 0 THEN (sign(vote) = sign(fwd))::INT END) AS hit FROM st GROUP BY 1), ev2 AS (SELECT agent, n, ic, hit, m / ss AS sr, (m3 - 3 * m * m2 + 2 * m ** 3) / sp ** 3 AS skew, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m ** 4) / sp ** 4 AS kurt FROM mo JOIN ic USING (agent))"


@query("q3_evaluate", "WITH " + PAIRS + ", " + RANKS + MOMENTS + " SELECT agent, n, round(ic, 6) AS ic, round(hit, 6) AS hit, round(sr, 6) AS sharpe, round(skew, 5) AS skew, round(kurt, 5) AS kurt FROM ev2")
def _(v):
    return Q.evaluate(pairs(v), ["agent"]).select("agent", "n", F.round("ic", 6).alias("ic"), F.round("hit", 6).alias("hit"), F.round("sharpe", 6).alias("sharpe"), F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"))


PSR = "({sr} - {star}) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * {sr} + (kurt - 1) / 4 * {sr} * {sr}))"
INV = "(sqrt(2) * sign(2 * ({p}) - 1) * sqrt(sqrt((2 / (pi() * 0.147) + ln(1 - (2 * ({p}) - 1) ** 2) / 2) ** 2 - ln(1 - (2 * ({p}) - 1) ** 2) / 0.147) - (2 / (pi() * 0.147) + ln(1 - (2 * ({p}) - 1) ** 2) / 2)))"
TOP = f"sqrt(var) * ((1 - {Q.GAMMA}::DOUBLE) * {INV.format(p='1 - 1.0::DOUBLE / k')} + {Q.GAMMA}::DOUBLE * {INV.format(p=f'1 - 1.0::DOUBLE / (k * {math.e!r}::DOUBLE)')})"


@query("q2_deflated_sharpe", "WITH " + PAIRS + ", " + RANKS + MOMENTS + f", al AS (SELECT count(*) AS k, var_samp(sr) AS var FROM ev2), sz AS (SELECT {TOP} AS sr0 FROM al), zz AS (SELECT agent, n, {PSR.format(sr='sr', star='0')} AS zp, {PSR.format(sr='sr', star='sr0')} AS zd FROM ev2, sz) SELECT agent, round({normal_cdf_sql('zp')}, 5) AS psr, round({normal_cdf_sql('zd')}, 5) AS dsr FROM zz")
def _(v):
    e = Q.evaluate(pairs(v), ["agent"])
    all_ = Window.partitionBy()  # a row for each agent
    e = e.withColumn("k", F.count("*").over(all_)).withColumn("var", F.var_samp("sharpe").over(all_))
    e = e.withColumn("sr0", Q.expected_top_sharpe(F.col("k").cast("double"), F.col("var")))
    z = lambda star: (F.col("sharpe") - star) * F.sqrt(F.col("n") - 1) / F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")))
    e = e.withColumn("zp", z(F.lit(0.0))).withColumn("zd", z(F.col("sr0")))
    return e.select("agent", F.round(normal_cdf(F.col("zp")), 5).alias("psr"), F.round(normal_cdf(F.col("zd")), 5).alias("dsr"))


@query("q4_cross_section", B + f", r AS (SELECT symbol, rn, ln(close / lag(close) OVER {BY}) AS r FROM bars QUALIFY r IS NOT NULL), c AS (SELECT a.symbol AS x, b.symbol AS y, corr(a.r, b.r) AS c FROM r a JOIN r b ON a.rn = b.rn AND a.symbol < b.symbol GROUP BY 1, 2), m AS (SELECT avg(c) AS rho FROM c), n AS (SELECT count(*) AS n, count(DISTINCT symbol) AS k FROM r) SELECT round(rho, 6) AS rho, n, round(n / k * (k / (1 + (k - 1) * greatest(0, least(1, rho)))), 4) AS n_eff FROM m, n")
def _(v):
    r = v.bars.select("symbol", "rn", W.log_return().alias("r")).where("r is not null")
    a, b = r.alias("a"), r.alias("b")
    c = a.join(b, (F.col("a.rn") == F.col("b.rn")) & (F.col("a.symbol") < F.col("b.symbol"))).groupBy(F.col("a.symbol").alias("x"), F.col("b.symbol").alias("y")).agg(F.try_divide(F.covar_pop("a.r", "b.r"), F.stddev_pop("a.r") * F.stddev_pop("b.r")).alias("c"))
    m = c.agg(F.avg("c").alias("rho"))
    n = r.agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("k"))
    rho, k = F.col("rho"), F.col("k")
    return m.crossJoin(F.broadcast(n)).select(F.round(rho, 6).alias("rho"), "n", F.round(F.col("n") / k * (k / (1 + (k - 1) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), rho)))), 4).alias("n_eff"))  # one row each


#: Bars whose votes one task casts; it gets those before them that agents see, and those after that returns need.
REPLAY_SLICE = 480


def replay_votes(bars, every: int | None = 8, most: int = 400, ahead: int = 8, least: int = 80):
    """symbol, agent, at, vote, fwd: what each agent says of what it sees of a series, and the return over ahead bars after.

    bars: with rn (from 1 on in each series) and maybe the leader's close. A vote each so many bars; every=None: so
    often that a series gets most votes. Series are dealt out in overlapping slices, so a long one is many tasks.
    """
    agents, last = ST.AGENTS, ST.LOOK_BACK

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn", kind="stable", ignore_index=True)
        cols, rows = ST.columns(g), []
        place, n, piece = g["rn"].to_numpy() - 1, int(g["n"].iloc[0]), int(g["slice"].iloc[0])
        step = every or max(1, (n - least - ahead) // most)
        for k in np.flatnonzero((place // REPLAY_SLICE == piece) & (place >= least) & (place < n - ahead) & ((place - least) % step == 0)):
            seen = {c: x[max(0, k + 1 - last) : k + 1] for c, x in cols.items()}
            after = float(cols["close"][k + ahead] / cols["close"][k] - 1)
            rows += [(g.symbol.iloc[0], name, int(place[k]), fn(seen), after) for name, fn in agents.items()]
        return pd.DataFrame(rows, columns=["symbol", "agent", "at", "vote", "fwd"])

    place = F.col("rn") - 1
    slices = F.sequence(F.greatest(F.floor((place - ahead) / REPLAY_SLICE), F.lit(0)), F.floor((place + last - 1) / REPLAY_SLICE))
    sizes = bars.groupBy("symbol").agg(F.max("rn").alias("n"))
    dealt = bars.join(sizes, "symbol").withColumn("slice", F.explode(slices))
    return dealt.groupBy("symbol", "slice").applyInPandas(run, "symbol string, agent string, at int, vote double, fwd double")


def replay(bars, every: int | None = 8):
    """Rank correlation, Sharpe ratio, fold quorum and replication of every agent's votes."""
    votes = replay_votes(bars, every)
    e = Q.evaluate(votes, ["agent"])

    def quorum(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["symbol", "at"])
        q = Q.fold_quorum(g.vote.to_numpy(float), g.fwd.to_numpy(float))
        s = np.sign(g.vote.to_numpy(float)) * g.fwd.to_numpy(float)
        sr = float(s.mean() / s.std(ddof=1)) if len(s) > 1 and s.std(ddof=1) > 0 else 0.0
        return pd.DataFrame([(g.agent.iloc[0], q["share"], q["passed"], Q.replication_ratio(len(s), abs(sr)))], columns=["agent", "fold_share", "passed", "replication"])

    return e.join(votes.groupBy("agent").applyInPandas(quorum, "agent string, fold_share double, passed boolean, replication double"), "agent").select("agent", "n", F.round("ic", 4).alias("ic"), F.round("sharpe", 4).alias("sharpe"), "fold_share", "passed", F.round("replication", 3).alias("replication"))


@query("q4_replay")
def _(v):
    """Every replayable agent on what it sees of each series, a vote each eight bars, evaluated with fold quorum and replication."""
    return replay(led(v))


@query("q6_backtest")
def _(v):
    """Each named strategy over each series: trades, walk-forward folds, edge over holding, score."""
    return ST.backtests(v.bars)


@query("q6_overfitting")
def _(v):
    """Chance that the best strategy in sample ranks low out of sample, over all halvings of eight blocks."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        c = ST.columns(g)
        rets = np.append(c["close"][1:] / c["close"][:-1] - 1, 0.0)
        table = np.stack([np.sign(ST.build(name, c)) * rets for name in ST.NAMES])
        p, n = Q.overfit_probability(table)
        return pd.DataFrame([(g.symbol.iloc[0], p, n, len(table))], columns=["symbol", "pbo", "combos", "configs"])

    return v.bars.groupBy("symbol").applyInPandas(run, "symbol string, pbo double, combos long, configs long")


@query("q7_strategy_signals")
def _(v):
    """Signals of every base strategy and of a regime-gated and an ensemble one, bar by bar."""
    names = [*ST.NAMES, "ema_cross_20_50+regime", "ensemble_trend_rev_struct", "wens_1_0.5_1_0.5_1_1_1"]

    def fold(g: pd.DataFrame) -> dict:
        c = ST.columns(g)
        return {f"s{k}": ST.build(n, c).astype(int) for k, n in enumerate(names)}

    df = P.per_series(v.bars, fold, ", ".join(f"s{k} int" for k in range(len(names))))
    return df.select("symbol", "t", *[F.col(f"s{k}").alias(n.replace("+", "_plus_").replace(".", "_")) for k, n in enumerate(names)])


@query("q8_evolved_crossing")
def _(v):
    """Crossing periods tuned by an evolution strategy on the first seven tenths of each series."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        c = ST.columns(g)
        n = int(len(c["close"]) * 0.7)
        part = {k: x[:n] for k, x in c.items()}
        valid = lambda x: (max(2, int(round(x[0]))), max(max(2, int(round(x[0]))) + 1, int(round(x[1]))))
        best, score = Q.evolve(lambda x: ST.score(ST.ema_cross(part, *valid(x)), part), np.array([10.0, 30.0]), 5.0, 12, seed=7)
        f, s = valid(best)
        return pd.DataFrame([(g.symbol.iloc[0], f, s, round(score, 4), round(ST.score(ST.ema_cross(c, f, s), c), 4))], columns=["symbol", "fast", "slow", "in_sample", "whole"])

    return v.bars.groupBy("symbol").applyInPandas(run, "symbol string, fast int, slow int, in_sample double, whole double")


def one_per_series(v, fn, schema: str, names: list[str]):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        c = ST.columns(g)
        return pd.DataFrame([(g.symbol.iloc[0], *fn(c))], columns=["symbol", *names])

    return v.bars.groupBy("symbol").applyInPandas(run, "symbol string, " + schema)


@query("q9_hidden_regimes")
def _(v):
    def fn(c):
        s = Q.reversion_signal(c["close"])
        return s["regime"], s["z"], s["half_life"], s["vote"], s["confidence"]

    return one_per_series(v, fn, "regime string, z double, half_life double, vote double, confidence double", ["regime", "z", "half_life", "vote", "confidence"])


@query("q10_dislocation")
def _(v):
    def fn(c):
        x = Q.bar_features(c["open"], c["high"], c["low"], c["close"], c["volume"])
        d = Q.turbulence(x)
        s = Q.dislocation_signal(*(c[k] for k in ("open", "high", "low", "close", "volume")))
        return round(Q.oddness(x)[0], 4), round(float(np.mean(d[:-1] <= d[-1])), 4), s["break"], s["vote"], s["confidence"]

    return one_per_series(v, fn, "distance double, percentile double, symmetry_break double, vote double, confidence double", ["distance", "percentile", "symmetry_break", "vote", "confidence"])


@query("q11_tails_and_paths")
def _(v):
    def fn(c):
        r = P.log_returns(c["close"])
        t = Q.tail_regime(r)
        n = lambda x: None if x is None else round(x, 4)
        return t["regime"], n(t["ratio"]), n(t["alpha"]), n(t["w1"]), n(t["hurst"]), n(Q.hurst_rescaled(r)), n(Q.levy_area(c["close"])), n(Q.roughness(r)), n(Q.jump_share(r))

    names = ["regime", "ratio", "alpha", "w1", "hurst", "hurst_rs", "levy", "roughness", "jump"]
    return one_per_series(v, fn, "regime string, " + ", ".join(f"{n} double" for n in names[1:]), names)


@query("q12_correlation_graph")
def _(v):
    """Covariances are summed in Spark; one task gets the matrix, a row for each two symbols."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g.x))
        m = Q.Panel(g.pivot(index="x", columns="y", values="cov").loc[names, names].to_numpy(float), int(g.n.iloc[0]))
        graph, (side, cond), apart, w = Q.connectivity(m, 0.05), Q.spectral_cut(m, 0.05), Q.signed_cut(m), Q.risk_parity(m)
        clean = Q.shrink_noise(m.corr, m.shape[1] / m.shape[0])
        rows = [(s, graph["lambda2"], graph["high"], cond, side[k], apart[k], round(float(w[k]), 6), round(float(clean[k].sum() - 1), 6)) for k, s in enumerate(names)]
        return pd.DataFrame(rows, columns=["symbol", "lambda2", "cheeger_high", "conductance", "cluster", "signed_cluster", "hrp_weight", "row_correlation"])

    returns = v.bars.select("symbol", "rn", W.log_return().alias("r")).where("r is not null")
    cov = Q.covariances(returns, "symbol", "rn", "r")
    schema = "symbol string, lambda2 double, cheeger_high double, conductance double, cluster int, signed_cluster int, hrp_weight double, row_correlation double"
    return cov.groupBy(F.lit(1).alias("panel")).applyInPandas(run, schema)


@query("q13_composite_signals")
def _(v):
    def fn(c):
        g = Q.geometric_signal(c["close"])
        s = ST.structure_vote(c)
        d = ST.divergent_vote(c["close"])
        return g["regime"], g["toxicity"], g["vote"], round(d, 4), round(s, 4), round(ST.technical_vote(c), 4)

    return one_per_series(v, fn, "regime string, toxicity double, geometric double, divergent double, structure double, technical double", ["regime", "toxicity", "geometric", "divergent", "structure", "technical"])


def led(v):
    """Bars, each with the leading series' close at its time; none beside the leader's own."""
    lead = v.bars.where("symbol = 'click'").select("t", F.col("close").alias("leader"))
    return v.bars.join(lead, "t", "left").withColumn("leader", F.when(F.col("symbol") != "click", F.col("leader")))


@query("q14_agents")
def _(v):
    """The registry: all fourteen agents' votes and confidences on each series, seven from its bars and seven from its last inputs."""
    from ..functions import decisions as D
    from .q_composites import agent_inputs

    def run(g: pd.DataFrame) -> pd.DataFrame:
        c = {k: x[-ST.LOOK_BACK :] for k, x in ST.columns(g).items()}
        said = {n: float(fn(c)) for n, fn in ST.AGENTS.items()}
        return pd.DataFrame([(g.symbol.iloc[0], n, round(x, 4), round(min(1.0, abs(x) * ST.SURENESS.get(n, 1.2)), 4)) for n, x in said.items()], columns=["symbol", "agent", "vote", "confidence"])

    own = led(v).groupBy("symbol").applyInPandas(run, "symbol string, agent string, vote double, confidence double")
    last = agent_inputs(v).groupBy("symbol").agg(F.max_by(F.struct("*"), "event_id").alias("x")).select("x.*")
    fed = D.input_votes(last, ["symbol"]).select("symbol", "agent", F.round("vote", 4).alias("vote"), F.round("confidence", 4).alias("confidence"))
    return own.unionByName(fed)


@query("q15_cognition", VO + ", w AS (SELECT *, CASE agent WHEN 'click' THEN 0.5 ELSE 1.0 END AS w FROM votes), c AS (SELECT symbol, t, sum(vote * confidence * w) / sum(confidence * w) AS con, sum(w) AS tw FROM w GROUP BY 1, 2), j AS (SELECT w.*, con, w / tw AS p FROM w JOIN c USING (symbol, t)) SELECT symbol, t, round(sum(-p * ln(p)) / CASE WHEN count(*) > 1 THEN ln(count(*)) ELSE 1 END, 6) AS weight_entropy, round(coalesce(avg(CASE WHEN confidence > 0.05 AND vote <> 0 THEN (sign(vote) = sign(con))::INT END), 0), 6) AS agreement, round(stddev_pop(vote), 9) AS dispersion, count(*) FILTER (WHERE confidence >= 0.4 AND abs(vote) >= 0.5 AND (vote > 0) <> (con > 0)) AS against FROM j GROUP BY symbol, t")
def _(v):
    c = EN.cognition(v.votes.withColumn("weight", F.when(F.col("agent") == "click", 0.5).otherwise(1.0)))
    return c.select("symbol", "t", F.round("weight_entropy", 6).alias("weight_entropy"), F.round("agreement", 6).alias("agreement"), F.round("dispersion", 9).alias("dispersion"), "against")


@query("q16_coherence", VO + ", k AS (SELECT *, count(*) OVER (PARTITION BY symbol, t) AS k, sum(vote) OVER (PARTITION BY symbol, t) - vote AS others FROM votes WHERE vote <> 0) SELECT agent, round(avg(((vote > 0) = (others > 0))::INT), 6) AS coherence, count(*) AS n FROM k WHERE k >= 2 AND abs(others) > 1e-9 GROUP BY 1")
def _(v):
    return EN.coherence(v.votes).select("agent", F.round("coherence", 6).alias("coherence"), "n")


@query("q16_learned_weights")
def _(v):
    p = pairs(v)
    hit = (F.signum("vote") == F.signum("fwd")) & (F.col("vote") != 0)
    batches = p.where("fwd <> 0 and vote <> 0").groupBy("t", "agent").agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))
    return EN.learn_weights(batches.join(EN.coherence(v.votes).select("agent", "coherence"), "agent"))


@query("q16_ic_alignment", "WITH " + PAIRS + ", " + RANKS + ", a AS (SELECT agent, greatest(0.25, least(2.5, 1 + ic / 0.05)) ** 0.85 AS w FROM ic WHERE n >= 50), m AS (SELECT avg(w) AS m FROM a) SELECT agent, round(greatest(0.2, least(3.0, w / m)), 4) AS weight FROM a, m")
def _(v):
    ic = Q.rank_ic(pairs(v), ["agent"]).where("n >= 50")
    target = F.greatest(F.lit(0.25), F.least(F.lit(2.5), 1 + F.col("ic") / 0.05))
    w = ic.withColumn("w", EN.align(F.lit(1.0), target, 0.85))
    return w.select("agent", F.round(F.greatest(F.lit(0.2), F.least(F.lit(3.0), F.col("w") / F.avg("w").over(Window.partitionBy()))), 4).alias("weight"))  # a row for each agent


RANKING = "rw AS (SELECT n_name AS agent, (n_nationkey * 7 % 100) / 100.0::DOUBLE AS dsr, n_nationkey * 13 % 200 AS n, (n_nationkey % 5 - 1) / 10.0::DOUBLE AS oos, CASE WHEN n_nationkey % 3 = 0 THEN (n_nationkey % 7 - 3) / 10.0::DOUBLE END AS annual FROM nation), lw AS (SELECT n_name AS agent, n_nationkey * 11 % 150 AS ln, (n_nationkey % 9 - 4)::DOUBLE AS lt FROM nation WHERE n_nationkey % 4 <> 0)"


@query("q17_edge_tiers", "WITH " + RANKING + ", x AS (SELECT agent, dsr, n, dsr >= 0.5 AND n >= 60 AND oos > 0 AS replay, coalesce(ln >= 60 AND lt >= 2, false) AND coalesce(annual > 0, true) AS sure, coalesce(ln >= 60 AND lt <= -2, false) AS against FROM rw LEFT JOIN lw USING (agent)), y AS (SELECT *, CASE WHEN replay AND sure THEN 'LIVE' WHEN replay THEN 'PROBATION' WHEN dsr >= 0.5 AND n >= 30 THEN 'PROBATION' WHEN dsr >= 0.1 THEN 'PAPER' ELSE 'NEGATIVE' END AS tier FROM x) SELECT agent, tier, replay AND NOT sure AS pending, CASE WHEN against THEN 0.3 ELSE CASE tier WHEN 'LIVE' THEN 1.5 WHEN 'PROBATION' THEN 1.0 WHEN 'PAPER' THEN 0.6 ELSE 0.3 END END::DOUBLE AS prior FROM y")
def _(v):
    k = F.col("n_nationkey")
    n = v.table("nation")
    ranking = n.select(F.col("n_name").alias("agent"), ((k * 7 % 100) / 100.0).alias("dsr"), (k * 13 % 200).alias("n"), ((k % 5 - 1) / 10.0).alias("oos_sharpe"), F.when(k % 3 == 0, (k % 7 - 3) / 10.0).alias("annual_ic"))
    live = n.where(k % 4 != 0).select(F.col("n_name").alias("agent"), (k * 11 % 150).alias("live_n"), (k % 9 - 4).cast("double").alias("live_t"))
    return EN.tiers(ranking, live, dsr_min=0.5, n_min=60)


@query("q18_counterfactual", "WITH " + PAIRS + ", c AS (SELECT symbol, t, max(fwd) AS fwd, avg(vote) AS whole, avg(vote) FILTER (WHERE agent NOT IN ('click', 'error')) AS pruned FROM pr GROUP BY 1, 2), u AS (SELECT 'full' AS scenario, round(whole, 9) AS con, fwd FROM c UNION ALL SELECT 'pruned', round(pruned, 9), fwd FROM c WHERE pruned IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY con) + (count(*) OVER (PARTITION BY scenario, con) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY scenario ORDER BY fwd) + (count(*) OVER (PARTITION BY scenario, fwd) - 1) / 2.0 AS rb FROM u) SELECT scenario, count(*) AS n, round(corr(ra, rb), 6) AS ic, round(avg(((con > 0) = (fwd > 0))::INT) FILTER (WHERE abs(con) >= 0.05 AND fwd <> 0), 6) AS right_share, round(avg(abs(fwd)) FILTER (WHERE abs(con) >= 0.05 AND fwd <> 0 AND (con > 0) = (fwd > 0)) / avg(abs(fwd)) FILTER (WHERE abs(con) >= 0.05 AND fwd <> 0 AND (con > 0) <> (fwd > 0)), 6) AS payoff FROM k GROUP BY scenario")
def _(v):
    keep = ~F.col("agent").isin("click", "error")
    c = pairs(v).groupBy("symbol", "t").agg(F.max("fwd").alias("fwd"), F.round(F.avg("vote"), 9).alias("full"), F.round(F.avg(F.when(keep, F.col("vote"))), 9).alias("pruned"))
    u = c.select(F.expr("stack(2, 'full', full, 'pruned', pruned) as (scenario, con)"), "fwd").where("con is not null")
    ic = Q.rank_ic(u, ["scenario"], "con", "fwd").select("scenario", "n", F.round("ic", 6).alias("ic"))
    strong = (F.abs("con") >= 0.05) & (F.col("fwd") != 0)
    ok = (F.col("con") > 0) == (F.col("fwd") > 0)
    size = F.abs("fwd")
    d = u.groupBy("scenario").agg(F.round(F.avg(F.when(strong, ok.cast("int"))), 6).alias("right_share"), F.round(F.avg(F.when(strong & ok, size)) / F.avg(F.when(strong & ~ok, size)), 6).alias("payoff"))
    return ic.join(d, "scenario")


GRID = "(VALUES (0.5), (0.75), (1.0), (1.5), (2.0)) g1(sl), (VALUES (1.0), (1.5), (2.0), (2.5), (3.0)) g2(rr)"


@query("q19_exit_grid", "WITH " + SIGNALS + f", g AS (SELECT sl::DOUBLE AS sl, rr::DOUBLE AS rr FROM {GRID}), m AS (SELECT s.signal_id, sl, rr, b.t, CASE WHEN side = 'LONG' THEN b.low <= entry - sl * risk ELSE b.high >= entry + sl * risk END AS lost, CASE WHEN side = 'LONG' THEN b.high >= entry + rr * sl * risk ELSE b.low <= entry - rr * sl * risk END AS won FROM signals s JOIN bars b ON b.symbol = s.symbol AND b.t BETWEEN s.t + 1 AND s.t + 172800, g), h AS (SELECT signal_id, sl, rr, arg_min(CASE WHEN lost THEN 'SL' ELSE 'TP' END, t) AS r FROM m WHERE lost OR won GROUP BY ALL) SELECT sl AS sl_atr, rr, count(*) AS n, round(avg((r = 'TP')::INT), 6) AS w, round(avg((r = 'TP')::INT) * rr - (1 - avg((r = 'TP')::INT)), 6) AS expectancy FROM h GROUP BY sl, rr HAVING count(*) >= 20")
def _(v):
    path = v.bars.select(F.col("symbol").alias("r_symbol"), F.col("t").alias("bar_t"), "high", "low")
    met = J.range_join(v.signals, path, ["symbol"], F.col("t") + 1, F.col("t") + 172_800, "bar_t", 172_800)
    grid = F.array(*[F.struct(F.lit(s).alias("sl"), F.lit(r).alias("rr")) for s in (0.5, 0.75, 1.0, 1.5, 2.0) for r in (1.0, 1.5, 2.0, 2.5, 3.0)])
    m = met.withColumn("g", F.explode(grid)).withColumn("sl", F.col("g.sl")).withColumn("rr", F.col("g.rr"))
    long, e, k = F.col("side") == "LONG", F.col("entry"), F.col("sl") * F.col("risk")
    lost = F.when(long, F.col("low") <= e - k).otherwise(F.col("high") >= e + k)
    won = F.when(long, F.col("high") >= e + F.col("rr") * k).otherwise(F.col("low") <= e - F.col("rr") * k)
    h = m.withColumn("r", F.when(lost, 0).when(won, 1)).where("r is not null").groupBy("signal_id", "sl", "rr").agg(F.min_by("r", "bar_t").alias("r"))
    w = F.avg("r")
    return h.groupBy(F.col("sl").alias("sl_atr"), "rr").agg(F.count("*").alias("n"), F.round(w, 6).alias("w"), F.round(w * F.col("rr") - (1 - w), 6).alias("expectancy")).where("n >= 20")


@query("q20_excursions", "WITH " + SIGNALS + ", m AS (SELECT signal_id, side, entry, risk, max(high) AS top, min(low) AS low FROM signals s JOIN bars b ON b.symbol = s.symbol AND b.t BETWEEN s.t AND s.t + 172800 GROUP BY signal_id, side, entry, risk) SELECT signal_id, round(CASE WHEN side = 'LONG' THEN top - entry ELSE entry - m.low END / entry, 6) AS mfe, round(CASE WHEN side = 'LONG' THEN entry - m.low ELSE top - entry END / entry, 6) AS mae, round(CASE WHEN side = 'LONG' THEN top - entry ELSE entry - m.low END / risk, 4) AS mfe_r FROM m")
def _(v):
    path = v.bars.select(F.col("symbol").alias("r_symbol"), F.col("t").alias("bar_t"), "high", "low")
    m = J.range_join(v.signals, path, ["symbol"], F.col("t"), F.col("t") + 172_800, "bar_t", 172_800).groupBy("signal_id", "side", "entry", "risk").agg(F.max("high").alias("top"), F.min("low").alias("bottom"))
    up, down = F.col("top") - F.col("entry"), F.col("entry") - F.col("bottom")
    long = F.col("side") == "LONG"
    return m.select("signal_id", F.round(F.when(long, up).otherwise(down) / F.col("entry"), 6).alias("mfe"), F.round(F.when(long, down).otherwise(up) / F.col("entry"), 6).alias("mae"), F.round(F.when(long, up).otherwise(down) / F.col("risk"), 4).alias("mfe_r"))


@query("q21_monte_carlo")
def _(v):
    def fn(c):
        r = P.log_returns(c["close"])
        s = float(c["close"][-1])
        x = Q.terminal_prices(s, float(r.mean()) * 365, float(r.std()) * math.sqrt(365), 0.25, 20_000, 0, 2.0, -0.05, 0.1)
        q = np.percentile(x, [5, 25, 50, 75, 95])
        mix = Q.replicate(np.array([0.25, 0.25, 0.25, 0.25]), np.array([0.1, 0.0, -0.1, 0.05]))
        return (round(s, 4), *[round(float(y), 4) for y in q], round(float((x > s).mean()), 4), round(float(mix[0]), 6), round(1 / (1 + math.exp(-0.5)), 6))

    names = ["last", "p5", "p25", "p50", "p75", "p95", "prob_up", "share", "adoption"]
    return one_per_series(v, fn, ", ".join(f"{n} double" for n in names), names)


@query("q21_markov_regimes", "WITH RECURSIVE m(step, a, b, c, d) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT step + 1, a * 0.85 + d * 0.30, a * 0.12 + b * 0.70 + d * 0.05, a * 0.02 + b * 0.20 + c * 0.70 + d * 0.05, a * 0.01 + b * 0.10 + c * 0.30 + d * 0.60 FROM m WHERE step < 24) SELECT step, round(a, 6) AS expansion, round(b, 6) AS slowdown, round(c, 6) AS recession, round(d, 6) AS recovery FROM m")
def _(v):
    """Chances of four regimes over 24 steps; the matrix is a parameter of four by four."""
    move = np.array([[0.85, 0.12, 0.02, 0.01], [0.0, 0.70, 0.20, 0.10], [0.0, 0.0, 0.70, 0.30], [0.30, 0.05, 0.05, 0.60]])
    rows, x = [], np.array([1.0, 0, 0, 0])
    for k in range(25):
        rows.append((k, *[round(float(y), 6) for y in x]))
        x = x @ move
    return v.spark.createDataFrame(rows, "step int, expansion double, slowdown double, recession double, recovery double")


@query("q22_fusion_dataset", VO + ", p AS (SELECT DISTINCT symbol, t, price FROM votes), f AS (SELECT *, lead(price) OVER (PARTITION BY symbol ORDER BY t) AS later FROM p) SELECT v.symbol, v.t, " + ", ".join(f"coalesce(max(vote) FILTER (WHERE agent = '{a}'), 0.0) AS {a}" for a in ("click", "error", "purchase", "signup", "view")) + ", max(later > f.price)::INT AS label FROM votes v JOIN f USING (symbol, t) WHERE later IS NOT NULL GROUP BY v.symbol, v.t")
def _(v):
    wide = v.votes.groupBy("symbol", "t", "price").pivot("agent", ["click", "error", "purchase", "signup", "view"]).agg(F.max("vote")).na.fill(0.0)
    later = F.lead("price").over(Window.partitionBy("symbol").orderBy("t"))
    return wide.withColumn("later", later).where("later is not null").select("symbol", "t", "click", "error", "purchase", "signup", "view", (F.col("later") > F.col("price")).cast("int").alias("label"))


ACCUMULATION = OPPORTUNITY + """, cnt AS (SELECT symbol, count(*) AS n FROM o GROUP BY 1),
pt AS (SELECT o.*, CASE WHEN o.rn <= floor(0.7 * n) THEN 'in' ELSE 'out' END AS sample FROM o JOIN cnt USING (symbol)),
gr AS (SELECT symbol, weight, sample, sum(1 + 4 * weight * score) / sum((1 + 4 * weight * score) / close) AS own, count(*) / sum(1 / close) AS flat FROM pt, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) w(weight) GROUP BY 1, 2, 3)
SELECT symbol, weight, sample, round((flat - own) / flat * 100, 4) AS advantage_pct FROM gr"""


@query("q23_accumulation_grid", ACCUMULATION)
def _(v):
    """Cost advantage of score-weighted buying over flat buying, in and out of sample, for a grid of weights."""
    bars = opportunity(v).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    bars = bars.withColumn("sample", F.when(F.col("rn") <= F.floor(0.7 * F.col("n")), "in").otherwise("out"))
    grid = bars.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in (0.0, 0.25, 0.5, 1.0)])))
    amount, close = 1 + 4 * F.col("weight") * F.col("score"), F.col("close")
    g = grid.groupBy("symbol", "weight", "sample").agg((F.sum(amount) / F.sum(amount / close)).alias("own"), (F.count("*") / F.sum(1 / close)).alias("flat"))
    return g.select("symbol", "weight", "sample", F.round((F.col("flat") - F.col("own")) / F.col("flat") * 100, 4).alias("advantage_pct"))


@query("q24_learning_health", VO + ", a AS (SELECT agent, avg(vote) AS x, avg(confidence) AS y FROM votes GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY x, agent) AS a, row_number() OVER (ORDER BY y, agent) AS b FROM a) SELECT round(corr(a, b), 6) AS rank_correlation, count(*) AS n FROM r")
def _(v):
    a = v.votes.groupBy("agent").agg(F.avg("vote").alias("x"), F.avg("confidence").alias("y"))
    r = a.select(F.row_number().over(Window.orderBy("x", "agent")).alias("a"), F.row_number().over(Window.orderBy("y", "agent")).alias("b"))  # a row for each agent
    return r.agg(F.round(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")), 6).alias("rank_correlation"), F.count("*").alias("n"))


@query("w16_liquidity_sweeps", "WITH " + WALK + f", s AS (SELECT *, coalesce(low < lag(low, 1) OVER {BY} AND low < lag(low, 2) OVER {BY} AND low < lead(low, 1) OVER {BY} AND low < lead(low, 2) OVER {BY}, false) AS sl, coalesce(high > lag(high, 1) OVER {BY} AND high > lag(high, 2) OVER {BY} AND high > lead(high, 1) OVER {BY} AND high > lead(high, 2) OVER {BY}, false) AS sh FROM walk) SELECT a.symbol, a.t, 'sell' AS side, round(arg_min(b.low, b.rn), 6) AS level, min(b.rn) AS swing_rn FROM walk a JOIN s b ON a.symbol = b.symbol AND b.rn < a.rn AND b.sl AND a.low < b.low AND a.close > b.low GROUP BY a.symbol, a.t UNION ALL SELECT a.symbol, a.t, 'buy', round(arg_min(b.high, b.rn), 6), min(b.rn) FROM walk a JOIN s b ON a.symbol = b.symbol AND b.rn < a.rn AND b.sh AND a.high > b.high AND a.close < b.high GROUP BY a.symbol, a.t")
def _(v):
    return SM.sweeps(v.walk)


@query("w17_character_changes")
def _(v):
    return SM.character_changes(v.walk)


@query("w18_sessions", B + ", n AS (SELECT *, timezone('America/New_York', to_timestamp(t)) AS ny FROM bars) SELECT symbol, ny::DATE AS day, round(max(high), 6) AS day_high, round(min(low), 6) AS day_low, round(arg_min(open, t), 6) AS midnight_open, round(max(high) FILTER (WHERE hour(ny) >= 19), 6) AS asian_high, count(*) FILTER (WHERE hour(ny) BETWEEN 2 AND 4) AS london, count(*) FILTER (WHERE hour(ny) BETWEEN 7 AND 9) AS newyork FROM n GROUP BY 1, 2")
def _(v):
    return SM.session_levels(v.bars)


@query("x18_structure_checklist")
def _(v):
    """Score, bias and plan of each series from sweeps, changes of character, gaps and sessions."""
    return SM.checklist(v.walk)
