"""Queries that SQL can't express, against plain loops over the rows they read."""

import itertools
import math
from statistics import NormalDist, fmean, median, pstdev

import pytest

from tidemark.operators import strategies as ST
from tidemark.plans import catalogue
from tidemark.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    out = {}
    for r in Views(spark, SF).bars.orderBy("symbol", "t").collect():
        out.setdefault(r["symbol"], []).append(r)
    return out


def rows(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


def test_overfitting(spark, series):
    """Every halving of eight blocks, strategy by strategy."""
    got = {r["symbol"]: r for r in rows(spark, "q6_overfitting")}
    signals = {}
    for r in rows(spark, "q7_strategy_signals"):
        signals.setdefault(r["symbol"], []).append(r)
    for symbol, bars in series.items():
        n, said = len(bars), sorted(signals[symbol], key=lambda r: r["t"])
        after = [bars[k + 1]["close"] / bars[k]["close"] - 1 for k in range(n - 1)] + [0.0]
        table = [[(s[name] > 0) - (s[name] < 0) for s in said] for name in ST.NAMES]
        table = [[s * x for s, x in zip(row, after, strict=True)] for row in table]
        edges = [round(k * n / 8) for k in range(9)]

        def quality(row, blocks, edges=edges):
            x = [row[i] for b in blocks for i in range(edges[b], edges[b + 1])]
            sd = pstdev(x)
            return fmean(x) / sd if sd > 1e-12 else fmean(x)

        low = total = 0
        for inside in itertools.combinations(range(8), 4):
            rest = [b for b in range(8) if b not in inside]
            first = [quality(row, inside) for row in table]
            best = first.index(max(first))
            later = [quality(row, rest) for row in table]
            place = 1 + sum(q < later[best] or (q == later[best] and k < best) for k, q in enumerate(later))
            low, total = low + (place / (len(table) + 1) <= 0.5), total + 1
        assert (got[symbol]["combos"], got[symbol]["configs"]) == (total, len(table))
        assert got[symbol]["pbo"] == pytest.approx(low / total, abs=2 / total)  # ties by rounding may move a rank


def test_tails(spark, series):
    """Tail exponent, distance from normal and share of jumps."""
    got = {r["symbol"]: r for r in rows(spark, "q11_tails_and_paths")}
    for symbol, bars in series.items():
        r = [math.log(b["close"] / a["close"]) for a, b in itertools.pairwise(bars)]
        mid = median(r)
        far = sorted((abs(x - mid) for x in r if abs(x - mid) > 1e-12), reverse=True)
        if len(far) >= 40:
            k = min(max(12, int(0.12 * len(far))), len(far) - 1)
            assert got[symbol]["alpha"] == pytest.approx(k / sum(math.log(x / far[k]) for x in far[:k]), abs=1e-3)
        mu, sd = fmean(r), pstdev(r)
        z = sorted((x - mu) / sd for x in r)
        w1 = fmean(abs(x - NormalDist().inv_cdf((i + 0.5) / len(z))) for i, x in enumerate(z))
        assert got[symbol]["w1"] == pytest.approx(w1, abs=1e-3)
        rv = sum(x * x for x in r)
        bv = math.pi / 2 * sum(abs(a) * abs(b) for a, b in itertools.pairwise(r))
        assert got[symbol]["jump"] == pytest.approx(max(0.0, min(0.999, (rv - bv) / rv)), abs=1e-3)


def test_learned_weights(spark):
    """Batch by batch, agent by agent."""
    from tidemark.operators import ensemble as EN
    from tidemark.plans.q_quant import pairs

    v = Views(spark, SF)
    coherence = {r["agent"]: r["coherence"] for r in EN.coherence(v.votes).collect()}
    batches = {}
    for r in pairs(v).where("fwd <> 0 and vote <> 0").collect():
        hits, total = batches.setdefault(r["t"], {}).get(r["agent"], (0, 0))
        batches[r["t"]][r["agent"]] = (hits + ((r["vote"] > 0) == (r["fwd"] > 0)), total + 1)
    rate, weight = {}, {}
    for t in sorted(batches):
        for a in sorted(batches[t]):
            if a in coherence:
                hits, total = batches[t][a]
                weight.setdefault(a, 1.0)
                rate[a] = 0.9 * rate.get(a, 0.5) + 0.1 * hits / total
        score = {a: 0.9 * min(1.0, max(0.0, (rate[a] - 0.3) / 0.4)) + 0.1 * min(1.0, max(0.0, coherence[a])) for a in weight}
        e = {a: math.exp(5 * s) for a, s in score.items()}
        floor = 0.05 if 0.05 * len(e) < 1 else 0.5 / len(e)
        target = {a: round(floor + (1 - floor * len(e)) * x / sum(e.values()), 4) for a, x in e.items()}
        mean = fmean(target.values())
        weight = {a: max(0.2, min(3.0, round(0.9 * w + 0.1 * target[a] / mean, 3))) for a, w in weight.items()}
    got = {r["agent"]: r for r in rows(spark, "q16_learned_weights")}
    assert set(got) == set(weight)
    for a, r in got.items():
        assert r["weight"] == pytest.approx(weight[a], abs=2e-3) and r["hit_rate"] == pytest.approx(rate[a], abs=1e-6)


def test_agents(spark, series):
    """Fourteen agents a series; those with a closed form, written out."""
    got = {}
    for r in rows(spark, "q14_agents"):
        got.setdefault(r["symbol"], {})[r["agent"]] = r["vote"]
    names = {"orderflow", "technicals", "macro", "sentiment", "derivs", "liquidations", "divergent", "structure", "simons", "savant", "geometric", "flows", "carry", "leadlag"}
    assert set(got) == set(series) and all(set(x) == names for x in got.values())
    assert all(-1 <= v <= 1 for x in got.values() for v in x.values())
    lead = {b["t"]: b["close"] for b in series["click"]}
    last = {}
    for r in Views(spark, SF).events.collect():
        if r["event_id"] >= last.get(r["event_type"], r)["event_id"]:
            last[r["event_type"]] = r
    for symbol, bars in series.items():
        close = [lead[b["t"]] for b in bars[-ST.LOOK_BACK :] if b["t"] in lead]
        want = 0.0
        if symbol != "click" and len(close) >= 73:
            r = [math.log(b / a) for a, b in itertools.pairwise(close)]
            want = -math.tanh(sum(r[-8:]) / (pstdev(r[-64:]) * math.sqrt(8) + 1e-9) / 2)
        assert got[symbol]["leadlag"] == pytest.approx(want, abs=1e-4)
        e = last[symbol]
        imbalance, side = (e["user_id"] % 21 - 10) / 10, e["event_id"] % 3 - 1
        assert got[symbol]["orderflow"] == pytest.approx(max(-1, min(1, 2 * imbalance + 0.3 * side)), abs=1e-4)
        assert got[symbol]["sentiment"] == pytest.approx(max(-1, min(1, (50 - e["value"]) / 50)) if e["event_id"] % 7 else 0, abs=1e-4)


def test_replay(spark, series):
    """Rank correlation of each agent's votes with what came after, by counting pairs of ranks."""
    got = {r["agent"]: r for r in rows(spark, "q4_replay")}
    lead = {b["t"]: b["close"] for b in series["click"]}
    import numpy as np

    said = {}
    for symbol, bars in series.items():
        columns = {c: np.array([b[c] for b in bars], float) for c in ("open", "high", "low", "close", "volume")}
        columns["leader"] = np.array([lead.get(b["t"], math.nan) if symbol != "click" else math.nan for b in bars])
        for at in range(80, len(bars) - 8, 8):
            seen = {c: x[max(0, at + 1 - ST.LOOK_BACK) : at + 1] for c, x in columns.items()}
            for name, fn in ST.AGENTS.items():
                said.setdefault(name, []).append((float(fn(seen)), bars[at + 8]["close"] / bars[at]["close"] - 1))
    assert set(got) <= set(said)

    def ranks(x):
        return [sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x]

    for name, r in got.items():
        pairs = [p for p in said[name] if p[0]]
        if r["n"] != len(pairs):
            pairs = said[name]
        assert r["n"] == len(pairs)
        a, b = ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs])
        ma, mb = fmean(a), fmean(b)
        den = math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
        want = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / den if den else 0.0
        assert r["ic"] == pytest.approx(want, abs=2e-3), name


def test_correlation_graph(spark, series):
    """Connectivity and weights from a correlation matrix that plain loops make."""
    import numpy as np

    names = sorted(series)
    r = {s: {k: math.log(b["close"] / a["close"]) for k, (a, b) in enumerate(itertools.pairwise(series[s]), 2)} for s in names}
    times = sorted(set.intersection(*[set(x) for x in r.values()]))
    x = {s: [r[s][t] for t in times] for s in names}
    mean = {s: fmean(x[s]) for s in names}
    cov = [[sum((a - mean[p]) * (b - mean[q]) for a, b in zip(x[p], x[q], strict=True)) / (len(times) - 1) for q in names] for p in names]
    corr = np.array([[cov[i][j] / math.sqrt(cov[i][i] * cov[j][j]) for j in range(len(names))] for i in range(len(names))])
    w, v = np.linalg.eigh(corr)
    edge = (1 + math.sqrt(len(names) / len(times))) ** 2
    noise = w < edge
    c = corr
    if noise.any() and not noise.all():
        c = v @ np.diag(np.where(noise, w[noise].mean(), w)) @ v.T
        c = c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
    a = np.abs(c) * (np.abs(c) > 0.05)
    np.fill_diagonal(a, 0)
    deg = a.sum(axis=1)
    half = np.diag([1 / math.sqrt(d) if d > 1e-12 else 0.0 for d in deg])
    lam = max(0.0, float(np.sort(np.linalg.eigvalsh(np.eye(len(names)) - half @ a @ half))[1])) if deg.sum() else 0.0
    got = {q["symbol"]: q for q in rows(spark, "q12_correlation_graph")}
    assert set(got) == set(names)
    isolated = any(d <= 1e-12 for d in deg)
    assert isolated or all(q["lambda2"] == pytest.approx(lam, abs=2e-4) for q in got.values())
    assert sum(q["hrp_weight"] for q in got.values()) == pytest.approx(1, abs=1e-5)


def solve(m, b):
    """Gaussian elimination with pivots."""
    n = len(m)
    rows_ = [[*row, y] for row, y in zip(m, b, strict=True)]
    for k in range(n):
        p = max(range(k, n), key=lambda i: abs(rows_[i][k]))
        rows_[k], rows_[p] = rows_[p], rows_[k]
        for i in range(n):
            if i != k:
                f = rows_[i][k] / rows_[k][k]
                rows_[i] = [x - f * y for x, y in zip(rows_[i], rows_[k], strict=True)]
    return [rows_[k][n] / rows_[k][k] for k in range(n)]


def test_dislocation(spark, series):
    """Distance of the last bar's features from those before it, by elimination; the vote follows from the last 72 bars."""
    got = {r["symbol"]: r for r in rows(spark, "q10_dislocation")}

    def features(bars):
        out = []
        for a, b in itertools.pairwise(bars):
            r, span = math.log(b["close"] / a["close"]), b["high"] - b["low"]
            where = (2 * b["close"] - b["low"] - b["high"]) / span if span > 0 else 0.0
            out.append([r, abs(r), where, span / a["close"], b["volume"]])
        return out

    def odd(x):
        d = len(x[0])
        mu, sd = [fmean(c) for c in zip(*x, strict=True)], [pstdev(c) for c in zip(*x, strict=True)]
        z = [[(v - mu[j]) / (sd[j] if sd[j] > 1e-12 else 1.0) for j, v in enumerate(row)] for row in x]
        base, last = z[:-1], z[-1]
        m = [fmean(c) for c in zip(*base, strict=True)]
        cov = [[sum((r[i] - m[i]) * (r[j] - m[j]) for r in base) / (len(base) - 1) + (0.01 if i == j else 0.0) for j in range(d)] for i in range(d)]
        gap = [v - w for v, w in zip(last, m, strict=True)]
        return sum(g * y for g, y in zip(gap, solve(cov, gap), strict=True))

    for symbol, bars in series.items():
        x = features(bars)
        assert got[symbol]["distance"] == pytest.approx(odd(x), rel=1e-3, abs=1e-3)
        late = features(bars[-73:])
        broken = 1 - math.exp(-odd(late) / len(late[0]) / 2)
        way = -1 if late[-1][0] > 0 else 1 if late[-1][0] < 0 else 0
        vote = way * min((broken - 0.55) / 0.45, 1.0) * 0.6 if broken >= 0.55 else 0.0
        assert got[symbol]["symmetry_break"] == pytest.approx(broken, abs=1e-3) and got[symbol]["vote"] == pytest.approx(vote, abs=2e-3)


def test_backtest(spark, series):
    """Trades, compound return and deepest fall of each strategy's signals, bar by bar."""
    signals = {}
    for r in rows(spark, "q7_strategy_signals"):
        signals.setdefault(r["symbol"], []).append(r)
    got = {(r["symbol"], r["strategy"]): r for r in rows(spark, "q6_backtest")}
    assert set(got) == {(s, n) for s in series for n in ST.NAMES}
    for (symbol, name), r in got.items():
        close, said = [b["close"] for b in series[symbol]], [s[name] for s in sorted(signals[symbol], key=lambda s: s["t"])]
        pnl = [(1 if said[k] > 0 else -1) * (close[k + ST.HORIZON] / close[k] - 1) - ST.FEE for k in range(len(close) - ST.HORIZON) if said[k]]
        assert r["trades"] == len(pnl)
        eq = top = 1.0
        fall = 0.0
        for p in pnl:
            eq *= 1 + p
            top = max(top, eq)
            fall = min(fall, eq / top - 1)
        assert r["total_return"] == pytest.approx(eq - 1, abs=2e-5, rel=1e-4) and r["max_drawdown"] == pytest.approx(fall, abs=2e-4)
