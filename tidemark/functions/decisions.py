"""Decisions and risk predicates: nothing here acts, each gives columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import clamp, clamp_known, reasons


def scan_score(fast: Column, slow: Column, rsi: Column) -> Column:
    """-3 to 3 from two averages and the strength index."""
    gap = (fast - slow) / slow * 100
    by_rsi = F.when((rsi >= 55) & (rsi < 70), 1).when((rsi > 30) & (rsi <= 45), -1).when(rsi >= 70, -1).when(rsi <= 30, 1).otherwise(0)
    return F.when(fast > slow, 1).when(fast < slow, -1).otherwise(0) + F.when(gap > 0.05, 1).when(gap < -0.05, -1).otherwise(0) + by_rsi


def scan_decision(score: Column) -> Column:
    return F.when(score >= 3, "LONG POSSIBLE").when(score <= -3, "SHORT POSSIBLE").when(score == 2, "BIAIS LONG").when(score == -2, "BIAIS SHORT").otherwise("NEUTRE")


def effective_regime(macro: Column, fear: Column, low: float = 20, high: float = 80) -> Column:
    """Extremes of fear and greed come before the macro regime."""
    known = F.upper(macro)
    return F.when(fear <= low, "RISK_OFF").when(fear >= high, "RISK_ON").when(known.isin("RISK_ON", "RISK_OFF"), known).otherwise("NEUTRE")


def gated(decision: Column, regime: Column) -> Column:
    """Longs give way to risk-off, shorts to risk-on."""
    against = ((regime == "RISK_OFF") & decision.isin("LONG POSSIBLE", "BIAIS LONG")) | ((regime == "RISK_ON") & decision.isin("SHORT POSSIBLE", "BIAIS SHORT"))
    return F.when(against, "NEUTRE").otherwise(decision)


def trade_plan(decision: Column, entry: Column, atr: Column, low: Column, high: Column, equity: float = 100.0, risk_percent: float = 1.0, atr_stop: float = 1.5, payoff: float = 2.0, max_leverage: float = 2.0) -> dict[str, Column]:
    """side, stop_loss, take_profit, risk_percent_price, implied_leverage, status; null for a neutral decision or no risk."""
    long = decision.isin("LONG POSSIBLE", "BIAIS LONG")
    short = decision.isin("SHORT POSSIBLE", "BIAIS SHORT")
    stop = F.when(long, F.least(low, entry - atr * atr_stop)).when(short, F.greatest(high, entry + atr * atr_stop))
    risk = F.when(long, entry - stop).when(short, stop - entry)
    risk = F.when(risk > 0, risk)
    target = F.when(long, entry + risk * payoff).when(short, entry - risk * payoff)
    leverage = equity * risk_percent / 100 / risk * entry / equity
    side = F.when(risk.isNotNull(), F.when(long, "LONG").otherwise("SHORT"))
    return {
        "side": side, "stop_loss": F.when(risk.isNotNull(), stop), "take_profit": target, "risk_percent_price": risk / entry * 100,
        "implied_leverage": leverage, "status": F.when(risk.isNotNull(), F.when(leverage <= max_leverage, "ACCEPTÉ").otherwise("REFUSÉ")),
    }


def plan_rank(score: Column, status: Column, rsi: Column, atr_percent: Column) -> Column:
    return F.when(status.isNull(), -999).otherwise(score + F.when(status == "ACCEPTÉ", 2).otherwise(-2) + F.when(rsi.between(55, 65), 1).otherwise(0) - F.when(atr_percent > 1.0, 1).otherwise(0))


def check_trade(notional: Column, leverage: Column, daily_loss: Column, open_positions: Column, kill: Column, limits: dict) -> Column:
    """The first reason against a trade, else OK."""
    return (
        F.when(kill, "kill").when(daily_loss >= limits["daily_loss"], "daily_loss").when(open_positions >= limits["positions"], "positions")
        .when(notional.isNull() | (notional <= 0), "notional").when(notional > limits["notional"], "size")
        .when(leverage.isNull() | (leverage <= 0), "leverage").when(leverage > limits["leverage"], "max_leverage").otherwise("OK")
    )


def guard_reasons(kill: Column, unlocked: Column, edge: Column, leverage: Column, notional: Column, gross: Column, drawdown_pct: Column, in_session: Column, blackout: Column, seen: Column, reduce: Column, limits: dict) -> Column:
    """All reasons against an order; a reduction is free of the kill switch and of the size caps."""
    return reasons(
        ("kill", kill & ~reduce), ("locked", ~unlocked), ("edge", ~edge), ("leverage", leverage.isNull() | (leverage <= 0)), ("max_leverage", leverage > limits["leverage"]),
        ("notional", notional.isNull() | (notional <= 0)), ("per_trade", ~reduce & (notional > limits["per_trade"])), ("gross", ~reduce & (gross + notional > limits["gross"])),
        ("drawdown", drawdown_pct >= limits["drawdown"]), ("session", ~in_session), ("blackout", blackout), ("seen", seen),
    )


def position_action(consensus: Column, side: Column, enter: float = 0.35, leave: float = 0.15) -> Column:
    """ouvrir, fermer or rien, from the consensus and the side held (null: none)."""
    want = F.when(consensus >= enter, "long").when(consensus <= -enter, "short")
    aligned = ((side == "long") & (consensus > 0)) | ((side == "short") & (consensus < 0))
    held = side.isin("long", "short")
    return F.when(consensus.isNull(), "rien").when(F.coalesce(held, F.lit(False)), F.when(aligned & (F.abs(consensus) >= leave), "rien").otherwise("fermer")).when(want.isNotNull(), "ouvrir").otherwise("rien")


def stop_and_target(side: Column, price: Column, atr: Column, stop_percent: float = 1.5, payoff: float = 1.5) -> tuple[Column, Column]:
    gap = F.when(atr > 0, 1.5 * atr).otherwise(price * stop_percent / 100)
    way = F.when(side == "long", 1).otherwise(-1)
    return F.when(price > 0, price - way * gap), F.when(price > 0, price + way * gap * payoff)


def carry_label(apr: Column, edge: float = 5.0) -> Column:
    return F.when(apr.isNull(), "INCONNU").when(apr >= edge, "ATTRACTIF").when(apr >= 0, "NEUTRE").otherwise("NEGATIF")


def carry_action(apr: Column, label: Column, held: Column, owner: Column, side: Column, cover: Column, leave: float = 2.0, cap: float = 15.0, least: float = 6.0, margin: float = 0.95, tranche: float = 10.0) -> Column:
    """ouvrir, renforcer, fermer or rien for a covered short; held is the notional in place (null: none)."""
    target = F.least(F.lit(cap), F.coalesce(cover, F.lit(0.0)) * margin)
    ours = F.when((owner != "carry") | (side != "short") | apr.isNull(), "rien").when(apr < leave, "fermer")
    ours = ours.when((label == "ATTRACTIF") & cover.isNotNull() & (F.least(target - held, F.lit(tranche)) >= least), "renforcer").otherwise("rien")
    fresh = F.when((label == "ATTRACTIF") & cover.isNotNull() & (F.least(target, F.lit(tranche)) >= least), "ouvrir").otherwise("rien")
    return F.when(held.isNotNull(), ours).otherwise(fresh)


def carry_vote(z: Column, funding: Column, crowd: Column, basis_pct: Column, extreme: float = 0.0005) -> dict[str, Column]:
    """Against crowded positioning; the weights of what is missing go to the rest."""
    f = -clamp_known(z / 2.5)
    f = F.when(F.abs(funding) >= extreme, clamp_known(f * 1.5)).otherwise(f)
    parts = [(0.5, f), (0.35, -crowd * 0.8), (0.15, -clamp_known(basis_pct / 0.5) * 0.4)]
    weight = sum((F.when(p.isNotNull(), w).otherwise(0.0) for w, p in parts[1:]), F.when(f.isNotNull(), 0.5).otherwise(0.0))
    total = sum((F.coalesce(w * p, F.lit(0.0)) for w, p in parts[1:]), F.coalesce(0.5 * f, F.lit(0.0)))
    vote = F.when(z.isNull() & crowd.isNull(), 0.0).when(weight > 0, clamp(total / weight)).otherwise(0.0)
    return {"vote": vote, "confidence": F.least(F.lit(0.6), F.abs(vote) * 1.2)}


def flow_vote(week: Column, month: Column) -> Column:
    """Growth of stablecoin supply as a vote; one of the two may be null."""
    a, b = F.tanh(week / 0.5), F.tanh(month / 2.0)
    return F.when(week.isNull() & month.isNull(), 0.0).when(week.isNull(), b).when(month.isNull(), a).otherwise(0.6 * a + 0.4 * b)


def risk_regime(vix: Column, curve: Column, dollar: Column) -> dict[str, Column]:
    zero = F.lit(0)
    score = (
        F.coalesce(F.when(vix >= 25, -2).when(vix >= 20, -1).when(vix < 20, 1), zero)
        + F.coalesce(F.when(curve < 0, -1).when(curve >= 0, 1), zero)
        + F.coalesce(F.when(dollar > 0.5, -1).when(dollar < -0.5, 1), zero)
    )
    return {"score": score, "regime": F.when(score > 0, "RISK_ON").when(score < 0, "RISK_OFF").otherwise("NEUTRE")}


def policy_stance(df: DataFrame) -> DataFrame:
    """Adds stance (above 0 is hawkish) and coverage: weighted pressures over the weights of those known.

    df: pce, unemployment, payrolls, real_rate, dollar, vix; any may be null.
    """
    c = F.col
    jobs = F.when(c("unemployment") < 4, 0.6).when(c("unemployment") > 5, -0.6).otherwise(clamp_known((4.5 - c("unemployment")) / 0.5 * 0.6))
    pay = F.when(c("payrolls") < 100, -0.6).when(c("payrolls") > 250, 0.6).otherwise(clamp_known((c("payrolls") - 175) / 75 * 0.6))
    parts = {  # fixed weights of the pressures
        "_pce": (0.30, F.when(c("pce") < 2, -1.0).when(c("pce") <= 2.5, 0.0).when(c("pce") <= 3, 0.6).when(c("pce") > 3, 1.0)),
        "_labor": (0.20, F.coalesce((c("_jobs") + c("_pay")) / 2, c("_jobs"), c("_pay"))),
        "_rate": (0.20, F.when(c("real_rate") >= 2, 1.0).when(c("real_rate") <= 1, -0.6).otherwise(clamp_known((c("real_rate") - 1.5) / 0.5 * 0.8))),
        "_dollar": (0.20, F.when(c("dollar") >= 2, 0.8).when(c("dollar") <= -2, -0.8).otherwise(c("dollar") / 2 * 0.8)),
        "_vix": (0.10, F.when(c("vix") >= 25, 0.6).when(c("vix") <= 15, -0.4).otherwise((c("vix") - 20) / 5 * 0.6)),
    }
    df = df.withColumns({"_jobs": jobs, "_pay": pay}).withColumns({n: p for n, (_, p) in parts.items()})
    total = F.lit(0.0)
    known = F.lit(0.0)
    for n, (w, _) in parts.items():
        total, known = total + F.coalesce(w * c(n), F.lit(0.0)), known + F.when(c(n).isNotNull(), w).otherwise(0.0)
    return df.withColumn("coverage", known).withColumn("stance", F.when(c("coverage") > 0, total / c("coverage")).otherwise(0.0)).drop("_jobs", "_pay", *parts)


def nowcast(df: DataFrame) -> DataFrame:
    """Adds regime (the greatest of four macro scores, the first of equals), confidence, stress, easing.

    df: nfci, nfci_chg, curve, curve_chg, vix, hy, hy_chg. The steps are columns, so that none is computed twice.
    """
    c, zero = F.col, F.lit(0.0)
    df = df.withColumns({"_fin": clamp(c("nfci") / 0.6), "_slope": clamp(c("curve")), "_fear": clamp((c("vix") - 18) / 17), "_credit": clamp((c("hy") - 3.5) / 4.5), "_tight": clamp(c("nfci_chg") / 0.3 + c("hy_chg") / 1.5), "_turn": clamp(c("curve_chg") / 0.4)})
    pos = lambda x: F.greatest(zero, x)
    df = df.withColumns({"easing": clamp(c("_turn") - c("_tight")), "stress": clamp((c("_fear") + c("_credit") + pos(c("_fin"))) / 3, 0, 1)})
    names = ("expansion", "slowdown", "recession", "recovery")
    df = df.withColumns({
        "expansion": c("_slope") - c("_fin") - c("_fear") - c("_credit") - pos(c("_tight")),
        "slowdown": 1.5 * pos(c("_tight")) - 0.5 * c("_slope") + 0.5 * c("_fear") + 0.5 * pos(c("_fin")),
        "recession": 1.5 * c("_credit") + c("_fear") + 1.2 * pos(-c("_slope")) + pos(c("_fin")),
        "recovery": 1.5 * pos(c("easing")) + pos(c("curve_chg")) / 0.4 - pos(c("_credit") - 0.3),
    })
    df = df.withColumns({n: F.round(n, 9) for n in names})  # scores that differ by rounding alone are equal
    df = df.withColumn("_ranked", F.sort_array(F.array(*names), asc=False))
    top = F.get("_ranked", F.lit(0))
    regime = F.when(c("expansion") == top, "expansion").when(c("slowdown") == top, "slowdown").when(c("recession") == top, "recession").otherwise("recovery")
    return df.withColumns({"regime": regime, "confidence": clamp((top - F.get("_ranked", F.lit(1))) / 2, 0, 1)}).drop("_fin", "_slope", "_fear", "_credit", "_tight", "_turn", "_ranked", *names)


def confluence(direction: Column, imbalance: Column, delta: Column, bias: Column, regime: Column) -> dict[str, Column]:
    """Signs that agree with a direction (1 or -1) less those that don't, and a label."""
    ways = [
        F.when(imbalance > 0.05, 1).when(imbalance < -0.05, -1).otherwise(0), F.coalesce(F.signum(delta).cast("int"), F.lit(0)),
        F.coalesce(F.signum(bias).cast("int"), F.lit(0)), F.when(regime == "RISK_ON", 1).when(regime == "RISK_OFF", -1).otherwise(0),
    ]
    score = sum((w * direction for w in ways[1:]), ways[0] * direction)
    label = F.when(score >= 3, "FORTE CONFLUENCE").when(score >= 1, "ALIGNÉ").when(score == 0, "MIXTE").when(score >= -2, "DIVERGENT").otherwise("CONTRE-SIGNAL")
    return {"score": score, "label": label}


def target_leverage(conviction: Column, volatility: Column, cap: float = 5.0, base: float = 0.02) -> Column:
    lev = 1 + (cap - 1) * clamp(conviction, 0, 1) * F.least(F.lit(1.0), base / F.greatest(volatility, F.lit(1e-6)))
    return F.round(clamp(lev, 1, cap), 2)


def quote_checks(bid: Column, ask: Column, age_ms: Column, most_ms: float = 2500) -> dict[str, Column]:
    return {"valid": F.coalesce((bid > 0) & (ask >= bid), F.lit(False)), "fresh": F.coalesce(age_ms.between(0, most_ms), F.lit(False))}


def sessions(minute: Column) -> Column:
    """Names of the trading windows (start, end in minutes of the local day) that hold the minute."""
    # Fixed windows.
    windows = [("EU_MORNING", 540, 660), ("US_OPEN", 930, 1020), ("US_OPEN_PEAK", 930, 990), ("ASIA_LATE", 60, 120)]
    return F.array_join(reasons(*[(n, (minute >= a) & (minute < b)) for n, a, b in windows]), ",")


def announcement_kind(title: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.when(t.rlike("delist|will remove|will no longer"), "delisting").when(t.rlike("suspen|halt|pause trading"), "suspension").when(t.rlike("maintenance|system upgrade"), "maintenance").when(t.contains("list"), "listing").otherwise("other")


def macro_vote(stance: Column, coverage: Column, event: Column | None = None) -> dict[str, Column]:
    """Hawkish policy, and a hawkish surprise, lean against the asset; confidence goes with the share of indicators known."""
    bias = clamp(-stance)
    if event is not None:
        bias = F.when(event.isNull(), bias).otherwise(clamp(0.7 * bias - 0.3 * event))
    return {"vote": F.when(coverage > 0, bias).otherwise(0.0), "confidence": F.when(coverage > 0, F.least(F.lit(1.0), coverage) * (0.4 + 0.6 * F.abs(bias))).otherwise(0.0)}


def surprise(actual: Column, forecast: Column, dovish: Column) -> Column:
    """Announcement above forecast is hawkish, below dovish, in tenths of the forecast; turned for unemployment and claims."""
    gap = (actual - forecast) / F.greatest(F.abs(forecast), F.lit(1e-9)) / 0.1
    return F.when(actual.isNotNull() & forecast.isNotNull(), clamp(gap) * F.when(dovish, -1.0).otherwise(1.0))


def buy_window(now: Column, last: Column, start: float = 16.0, end: float = 20.0, late_hours: float = 30.0) -> Column:
    """Within the daily hours, or too late to wait, or never bought."""
    hour = (now % 86400) / 3600
    return last.isNull() | (now - last > late_hours * 3600) | ((hour >= start) & (hour < end))


def due(now: Column, last: Column, hours: float) -> Column:
    return last.isNull() | (now - last >= hours * 3600)


def ribbon_state(signal: Column) -> Column:
    return F.when(signal > 0, "reprise").when(signal < 0, "capitulation").otherwise("neutre")


def congestion(fee: Column) -> Column:
    """0 to 1 from the fast fee: 0 up to 2, 1 from 200 on, by the root between; 0 where there is none."""
    share = (fee - 2.0) / 198.0
    return F.when(share >= 1, 1.0).when(share > 0, F.sqrt(share)).otherwise(0.0)


def implied_regime(level: Column, slope: Column) -> dict[str, Column]:
    """Calm under 40, stress from 70 on, and whether the level has grown by over 10 %."""
    return {"regime": F.when(level.isNull(), "inconnu").when(level < 40, "calme").when(level < 70, "normal").otherwise("stress"), "expansion": F.coalesce(slope > 10, F.lit(False))}


def net_positioning(long: Column, short: Column) -> dict[str, Column]:
    """Net open positions of a class of traders, their share of all in percent, and which way they lean; null if a side is negative."""
    valid, total, net = (long >= 0) & (short >= 0), long + short, long - short
    share = F.when(total > 0, net * 100.0 / total).otherwise(0.0)
    return {"net": F.when(valid, net), "net_pct": F.when(valid, share), "bias": F.when(valid, F.when(net > 0, "LONG").when(net < 0, "SHORT").otherwise("FLAT"))}


def sector_ratio(cyclical: Column, defensive: Column) -> Column:
    """Price of a cyclical sector in units of a defensive one; null unless the latter is above 0."""
    return F.when(defensive > 0, cyclical / defensive)


def input_votes(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, agent, vote, confidence of seven agents, a row each, from the columns imbalance, cvd, regime, stance,
    coverage, fear, funding, net, week, month, crowd. Whoever lacks its input votes 0 with confidence 0."""
    c = F.col
    policy = macro_vote(c("stance"), c("coverage"))
    carry = carry_vote(c("week"), F.coalesce(c("funding"), F.lit(0.0)), c("crowd"), c("month"))["vote"]
    step = df.select(
        *keys, "imbalance", "cvd", "regime", "fear", "funding", "net", policy["vote"].alias("policy"), policy["confidence"].cast("double").alias("weight"),
        F.when(c("regime") == "RISK_ON", 0.6).when(c("regime") == "RISK_OFF", -0.6).otherwise(0.0).alias("base"), F.when(c("regime").isin("RISK_ON", "RISK_OFF"), 0.5).otherwise(0.1).alias("sure"),
        flow_vote(c("week"), c("month")).alias("flows"), carry.alias("carry"),
    )
    blend = F.when(c("weight") > 0, clamp((c("base") * c("sure") + c("policy") * c("weight")) / (c("sure") + c("weight")))).otherwise(c("base"))
    step = step.select(
        *keys, "flows", "carry", clamp(2 * c("imbalance") + 0.3 * F.signum(c("cvd").cast("double"))).alias("orderflow"), F.least(F.lit(1.0), F.abs("imbalance") * 1.5).alias("orderflow_sure"),
        blend.alias("macro"), F.when(c("weight") > 0, F.least(F.lit(1.0), (c("sure") + c("weight")) / 1.5)).otherwise(c("sure")).alias("macro_sure"),
        F.when(c("fear").isNotNull(), clamp((50 - c("fear")) / 50)).otherwise(0.0).alias("sentiment"), F.when(c("funding").isNotNull(), clamp(-2000 * c("funding"))).otherwise(0.0).alias("derivs"),
        F.when(c("net").isNotNull(), clamp(c("net"))).otherwise(0.0).alias("liquidations"),
    )
    sure = {"orderflow": c("orderflow_sure"), "macro": c("macro_sure"), "flows": F.least(F.lit(0.5), F.abs("flows")), "carry": F.least(F.lit(0.6), F.abs("carry") * 1.2)}
    names = ("orderflow", "macro", "sentiment", "derivs", "liquidations", "flows", "carry")
    said = [F.struct(F.col(n).cast("double").alias("vote"), sure.get(n, F.abs(n)).cast("double").alias("confidence")).alias(n) for n in names]
    return step.select(*keys, *said).unpivot(keys, list(names), "agent", "said").select(*keys, "agent", (c("said.vote") + 0.0).alias("vote"), "said.confidence")
