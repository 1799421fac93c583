"""Votes of agents: consensus, its second thoughts, and weights learned from outcomes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def invalidate(votes: DataFrame) -> DataFrame:
    """Confidence 0 for votes whose price is below invalid_below or above invalid_above; note says so."""
    void = F.coalesce(F.col("price") < F.col("invalid_below"), F.lit(False)) | F.coalesce(F.col("price") > F.col("invalid_above"), F.lit(False))
    void = void & (F.col("price") > 0)
    return votes.withColumn("invalidated", void).withColumn("confidence", F.when(void, 0.0).otherwise(F.col("confidence")))


def consensus(votes: DataFrame) -> DataFrame:
    """symbol, t, consensus, bias, conviction from vote, confidence, weight; 0 where nothing weighs."""
    cw = F.col("confidence") * F.col("weight")
    den = F.sum(cw)
    df = votes.groupBy("symbol", "t").agg(F.when(den != 0, F.sum(F.col("vote") * cw) / den).otherwise(0.0).alias("consensus"))
    c = F.round("consensus", 9)
    return df.withColumn("bias", F.when(c > 0.2, "LONG").when(c < -0.2, "SHORT").otherwise("NEUTRE")).withColumn("conviction", F.abs("consensus"))


def cognition(votes: DataFrame, conf_min: float = 0.4, vote_min: float = 0.5, against_min: int = 2, veto: float = 0.15) -> DataFrame:
    """Adds to the consensus of each (symbol, t): weight_entropy, agreement, dispersion, groupthink, contradiction, prudence."""
    at = Window.partitionBy("symbol", "t")
    w = F.greatest(F.col("weight"), F.lit(1e-9))
    con = consensus(votes).select("symbol", "t", "consensus")
    df = votes.join(con, ["symbol", "t"]).withColumn("p", w / F.sum(w).over(at))
    same = F.signum("vote") == F.signum("consensus")
    voiced = (F.col("confidence") > 0.05) & (F.col("vote") != 0)
    strong = (F.col("confidence") >= conf_min) & (F.abs("vote") >= vote_min) & ((F.col("vote") > 0) != (F.col("consensus") > 0))
    g = df.groupBy("symbol", "t", "consensus").agg(
        F.sum(-F.col("p") * F.log("p")).alias("h"), F.count("*").alias("n"), F.avg(F.when(voiced, same.cast("int"))).alias("agree"),
        F.coalesce(F.stddev_pop("vote"), F.lit(0.0)).alias("dispersion"), F.count_if(strong).alias("against"),
    )
    zero = F.abs("consensus") < 1e-12
    g = g.withColumn("weight_entropy", F.when(F.col("n") > 1, F.col("h") / F.log(F.col("n").cast("double"))).otherwise(F.col("h")))
    g = g.withColumn("agreement", F.when(zero, 0.0).otherwise(F.coalesce("agree", F.lit(0.0))))
    g = g.withColumn("groupthink", (F.col("agreement") >= 0.85) & (F.abs("consensus") >= 0.4)).withColumn("contradiction", ~zero & (F.col("against") >= against_min))
    calm = F.when(F.col("groupthink"), 0.8).otherwise(1.0)
    return g.withColumn("prudence", F.when(F.col("contradiction"), F.least(calm, F.lit(veto))).otherwise(calm)).drop("h", "n", "agree")


def coherence(votes: DataFrame) -> DataFrame:
    """agent, coherence: how often an agent's vote has the sign of the sum of the others' in its cycle."""
    at = Window.partitionBy("symbol", "t")
    df = votes.where("vote <> 0").withColumn("k", F.count("*").over(at)).withColumn("others", F.sum("vote").over(at) - F.col("vote"))
    df = df.where((F.col("k") >= 2) & (F.abs("others") > 1e-9))
    return df.groupBy("agent").agg(F.avg(((F.col("vote") > 0) == (F.col("others") > 0)).cast("int")).alias("coherence"), F.count("*").alias("n"))


def blend_weights(perf: dict[str, float], coh: dict[str, float], beta: float = 0.7, eta: float = 5.0, floor: float = 0.05, bounds: tuple[float, float] = (0.2, 3.0)) -> dict[str, float]:
    """Softmax of performance and coherence with a floor for each; sums to 1. A handful of agents."""
    if not perf:
        return {}
    low, high = bounds
    part = lambda x, a, b: min(1.0, max(0.0, (x - a) / ((b - a) or 1.0)))
    score = {k: beta * part(p, low, high) + (1 - beta) * part(coh.get(k, 0.0), 0.0, 1.0) for k, p in perf.items()}
    floor = 0.5 / len(perf) if floor * len(perf) >= 1 else floor
    top = max(score.values())
    e = {k: math.exp(eta * (s - top)) for k, s in score.items()}
    return {k: round(floor + (1 - floor * len(perf)) * x / sum(e.values()), 4) for k, x in e.items()}


def multiply_weights(weights: dict[str, float], right: dict[str, bool | None], low: float = 0.2, high: float = 3.0) -> dict[str, float]:
    """5 % up for agents that were right, 4 % down for wrong ones, bounded, mean 1."""
    w = {**weights, **{k: max(low, min(high, weights.get(k, 1.0) * (1.05 if ok else 0.96))) for k, ok in right.items() if ok is not None}}
    mean = sum(w.values()) / len(w) if w else 1.0
    return {k: round(v / mean, 3) for k, v in w.items()} if mean > 0 else w


def learn_weights(matured: DataFrame, smoothing: float = 0.1, alpha: float = 0.1, beta: float = 0.9) -> DataFrame:
    """agent, hit_rate, weight after all batches in order of t.

    matured: t, agent, hits, total, coherence, a row for each batch and agent. Batches must follow one another, so one
    task folds them; a batch has a row for each agent, pre-aggregated, whatever the number of votes.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        rate: dict[str, float] = {}
        weight: dict[str, float] = {}
        coh = dict(zip(g.agent, g.coherence, strict=True))
        for _, batch in g.sort_values(["t", "agent"], kind="stable").groupby("t", sort=True):
            for a, h, n in zip(batch.agent, batch.hits, batch.total, strict=True):
                weight.setdefault(a, 1.0)
                rate[a] = (1 - alpha) * rate.get(a, 0.5) + alpha * h / n if n else rate.get(a, 0.5)
            target = blend_weights({a: rate[a] for a in weight}, {a: coh.get(a, 0.5) for a in weight}, beta=beta, bounds=(0.3, 0.7))
            mean = sum(target.values()) / len(target)
            weight = {a: max(0.2, min(3.0, round((1 - smoothing) * w + smoothing * target[a] / mean, 3))) for a, w in weight.items()}
        names = sorted(weight)
        return pd.DataFrame({"agent": names, "hit_rate": [round(rate[a], 6) for a in names], "weight": [weight[a] for a in names]})

    return matured.groupBy(F.lit(0).alias("all")).applyInPandas(fold, "agent string, hit_rate double, weight double")


def align(weight: Column, target: Column, alpha: float) -> Column:
    """Geometric blend of a weight and its target."""
    return F.pow(F.greatest(weight, F.lit(1e-9)), F.lit(1 - alpha)) * F.pow(F.greatest(target, F.lit(1e-9)), F.lit(alpha))


def tiers(ranking: DataFrame, live: DataFrame, dsr_min: float = 0.90, n_min: int = 120, live_n: int = 60, live_t: float = 2.0) -> DataFrame:
    """agent, tier, pending, prior: LIVE needs replay, live votes and a good year; evidence against caps the prior.

    ranking: agent, dsr, n, oos_sharpe, annual_ic (null: not measured); live: agent, live_n, live_t.
    """
    # Fixed priors of the tiers.
    prior = F.when(F.col("tier") == "LIVE", 1.5).when(F.col("tier") == "PROBATION", 1.0).when(F.col("tier") == "PAPER", 0.6).otherwise(0.3)
    df = ranking.join(live, "agent", "left")
    replay = (F.col("dsr") >= dsr_min) & (F.col("n") >= n_min) & (F.coalesce("oos_sharpe", F.lit(0.0)) > 0)
    sure = F.coalesce((F.col("live_n") >= live_n) & (F.col("live_t") >= live_t), F.lit(False)) & F.coalesce(F.col("annual_ic") > 0, F.lit(True))
    tier = F.when(replay & sure, "LIVE").when(replay, "PROBATION").when((F.col("dsr") >= 0.5) & (F.col("n") >= 30), "PROBATION").when(F.col("dsr") >= 0.1, "PAPER").otherwise("NEGATIVE")
    df = df.withColumn("tier", tier).withColumn("pending", replay & ~sure)
    against = F.coalesce((F.col("live_n") >= live_n) & (F.col("live_t") <= -live_t), F.lit(False))
    return df.withColumn("prior", F.when(against, F.least(prior, F.lit(0.3))).otherwise(prior)).select("agent", "tier", "pending", "prior")
