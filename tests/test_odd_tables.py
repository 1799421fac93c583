"""Queries on tables that the generator does not make, against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.operators.folds import NearestMatch, match_nearest
from tidemark.plans import catalogue

from .test_queries import plain


def both(spark, folder, name, events):
    """Sorted rows of a query and of its SQL; events: DuckDB SQL of an events table."""
    c = duckdb.connect()
    c.execute(f"COPY ({events}) TO '{folder}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    got = c.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    rows = lambda it: sorted((tuple(plain(x) for x in r) for r in it), key=repr)
    return rows(df.select(*names).collect()), rows(got.fetchall())


ROW = "SELECT k AS event_id, TIMESTAMP '2024-01-01' + to_seconds({at}) AS ts, k % 40 AS user_id, {kind} AS event_type, {value}::DOUBLE AS value, '{{}}' AS props FROM range({n}) t(k)"


@pytest.mark.parametrize("n", [0, 400])
def test_issue_stats_where_no_signal_is_decided(spark, tmp_path, n):
    """Each bar spans all prices, so it touches target and stop alike; or there are no bars."""
    have, want = both(spark, tmp_path, "a4_issue_stats", ROW.format(at="k // 4 * 21600", kind="'view'", value="CASE WHEN k % 4 = 1 THEN 0 WHEN k % 4 = 2 THEN 1000 ELSE 50 END", n=n))
    assert have == want == [(n // 4, 0, 0, None)]


DENSE = """SELECT CASE WHEN k % 211 = 5 THEN NULL ELSE k END AS event_id, CASE WHEN k % 101 = 7 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_seconds((hash(k) % 4000)::BIGINT) END AS ts, 1::BIGINT AS user_id,
  CASE WHEN k % 97 = 3 THEN NULL WHEN k % 7 = 0 THEN 'view' WHEN k % 9 = 1 THEN 'click' ELSE 'signup' END AS event_type,
  CASE WHEN k % 31 = 0 THEN NULL WHEN k % 37 = 0 THEN 0 ELSE hash(k + 7777) % 50 END::DOUBLE AS value, '{}' AS props FROM range(700) t(k)"""


def test_greedy_match_without_pauses(spark, tmp_path):
    """Many rows within each five minutes, equal times and amounts, rows without time, amount, series or id."""
    have, want = both(spark, tmp_path, "j8_greedy_nearest_match", DENSE)
    assert have == want and len({r for r in want if "pair" in r}) > 100


def test_greedy_match_holds_what_later_rows_can_change():
    """A series that never pauses, in batches: the pairs of the whole series at once, with the rows of ten minutes in hand."""
    rng = np.random.default_rng(3)
    n = 20_000
    t, amount, buy = np.sort(rng.integers(0, 40_000, n)), rng.integers(0, 400, n).astype(float), rng.random(n) < 0.4
    live, most, parts = NearestMatch(300, 0.05), 0, []
    for k in range(0, n, 500):
        parts.append(live.add(*(x[k : k + 500] for x in (t, np.arange(n), amount, buy))))
        most = max(most, live.held())
    parts.append(live.finish())
    got = [np.concatenate(c) for c in zip(*(p for p in parts if p is not None), strict=True)]
    frame = pd.DataFrame({"t": t, "amount": amount})
    pairs, left, _ = match_nearest(frame[buy], frame[~buy].reset_index(drop=True), 300, 0.05)
    fills = np.flatnonzero(~buy)
    assert dict(zip(got[0][got[2]].tolist(), got[1][got[2]].tolist(), strict=True)) == {i: int(fills[j]) for i, j in pairs}
    assert sorted(got[0][~got[2]].tolist()) == sorted(left) and len(left) > 100
    assert sorted(got[3].tolist()) == sorted(set(fills.tolist()) - {int(fills[j]) for _, j in pairs})
    assert most < 2_500 and live.held() == 0
