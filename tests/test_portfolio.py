"""Closed forms against plain loops."""

import datetime as dt

import numpy as np
import pytest

from quantloom.operators import backtest as B
from quantloom.operators import portfolio as P
from quantloom.operators import sweep as S
from quantloom.schemas import PREDICTION


def pour(raw, cap, exposure):
    """Pour the target over the names in proportion, fixing those that overflow, until none does."""
    goal, level, open_names = min(exposure, len(raw) * cap), dict.fromkeys(range(len(raw)), 0.0), set(range(len(raw)))
    while open_names:
        rest, total = goal - sum(level.values()), sum(raw[i] for i in open_names)
        if rest <= 1e-12:
            break
        if total <= 1e-12:
            level |= {i: min(cap, rest / len(open_names)) for i in open_names}
            break
        share = {i: rest * raw[i] / total for i in open_names}
        full = {i for i, w in share.items() if w >= cap}
        level |= {i: cap for i in full} if full else share
        if not full:
            break
        open_names -= full
    return [level[i] for i in range(len(raw))]


def groups(seed, count=60):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(count):
        n = int(rng.integers(1, 30))
        raw = rng.exponential(size=n) ** 2
        raw[rng.random(n) < 0.2] = 0.0
        if g % 5 == 0:
            raw[:] = 1.0
        raw = raw / raw.sum() if raw.sum() > 0 else np.full(n, 1.0 / n)
        cap, exposure = float(rng.choice([0.03, 0.05, 0.2, 0.5])), float(rng.choice([0.0, 0.7, 1.0]))
        rows += [(g, dt.date(2020, 1, 1), f"t{i:02d}", float(w), cap, exposure) for i, w in enumerate(raw)]
    return rows


def by_group(rows):
    found = {}
    for row in rows:
        found.setdefault(row[0], []).append(row)
    return found


def test_cap_weights_equals_pouring(spark):
    rows = groups(1)
    frame = spark.createDataFrame(rows, "g int, date date, ticker string, raw_weight double, cap double, exposure double")
    found = P.cap_weights(frame, ["g"], cap="cap", exposure="exposure", lowest_cap=0.03).collect()
    weights = {(r["g"], r["ticker"]): r["weight"] for r in found}
    for g, members in by_group(rows).items():
        expected = pour([m[3] for m in members], members[0][4], members[0][5])
        mine = [weights[g, m[2]] for m in members]
        assert np.allclose(mine, expected, atol=1e-9)
        assert max(mine) <= members[0][4] + 1e-12 and sum(mine) <= members[0][5] + 1e-9


def test_min_weight_refill_equals_pouring_twice(spark):
    rows = groups(2)
    frame = spark.createDataFrame(rows, "g int, date date, ticker string, raw_weight double, cap double, exposure double")
    found = P.min_weight_refill(frame, ["g"], cap="cap", min_weight=0.02, exposure="exposure", lowest_cap=0.03).collect()
    weights = {(r["g"], r["ticker"]): r["target_weight"] for r in found}
    for g, members in by_group(rows).items():
        raw, cap, exposure = [m[3] for m in members], members[0][4], members[0][5]
        first = pour(raw, cap, exposure)
        kept = {i for i, w in enumerate(first) if w >= 0.02} or {int(np.argmax(raw))}
        expected = pour([w if i in kept else 0.0 for i, w in enumerate(raw)], cap, exposure)
        assert np.allclose([weights[g, m[2]] for m in members], expected, atol=1e-9)


def test_dropped_names_are_refilled_when_the_kept_are_full(spark):
    rows = [(dt.date(2020, 1, 1), f"t{i}", w) for i, w in enumerate([0.6, 0.4, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "date date, ticker string, raw_weight double")
    weights = {r["ticker"]: r["weight"] for r in P.cap_weights(frame, cap=0.3).collect()}
    assert weights == pytest.approx({"t0": 0.3, "t1": 0.3, "t2": 0.2, "t3": 0.2})


def test_weights_computed_apart_from_their_facts_stay_under_the_cap(spark):
    """Raw weights are shares of a sum of doubles; computed again, that sum may differ in its last bit."""
    raw = [0.5, 0.4999995, 5e-7]
    kind = "date date, ticker string, raw_weight double"
    day = dt.date(2020, 1, 1)
    for turned in (0, 1, 2):
        facts_from = [(day, f"t{i}", w) for i, w in enumerate(raw)]
        rows_from = [(day, f"t{i}", float(np.nextafter(w, 0.0)) if turned == 1 else float(np.nextafter(w, 1.0)) if turned else w) for i, w in enumerate(raw)]
        facts = P._fill_facts(spark.createDataFrame(facts_from, kind), ["date"], "raw_weight", P.as_column(0.4), P.as_column(1.0), 0.4)
        rows = spark.createDataFrame(rows_from, kind).join(facts, "date")
        found = {r["ticker"]: r["w"] for r in rows.withColumn("w", P._filled(rows["raw_weight"], rows["ticker"])).collect()}
        assert found == pytest.approx({"t0": 0.4, "t1": 0.4, "t2": 0.2}, rel=1e-9)


@pytest.fixture(scope="module")
def market(spark):
    """Eight names and the market over 60 days; some bars are missing, volumes make one name illiquid."""
    rng = np.random.default_rng(3)
    days = [dt.date(2021, 1, 4) + dt.timedelta(days=i) for i in range(60)]
    names = [f"n{i}" for i in range(8)] + ["SPY"]
    prices, predictions = [], []
    for name in names:
        close = 50 * np.cumprod(1 + rng.normal(0, 0.02, len(days)))
        for day, value in zip(days, close):
            if name != "SPY" and rng.random() < 0.05:
                continue
            opened = float(value * 0.99) if rng.random() < 0.9 else None
            prices.append((day, name, opened, float(value), float(value), float(value), 10 if name == "n7" else 10_000, None))
            if name != "SPY":
                predictions.append((day, name, float(rng.normal())))
    p = spark.createDataFrame(prices, "date date, ticker string, open double, high double, low double, close double, volume long, vwap double")
    q = spark.createDataFrame(predictions, f"date date, ticker string, {PREDICTION} double")
    return days, prices, predictions, p.cache(), q.cache()


def walk(days, prices, positions, capital=1e6, rate=0.0015):
    """Day-by-day accounting of given rebalance targets."""
    close = {(r[0], r[1]): r[5] for r in prices}
    opened = {(r[0], r[1]): r[2] or r[5] for r in prices}
    last, held, pending, value, shares = {}, {}, None, capital, {}
    curve, trades = [], []
    wanted = {t for w in positions.values() for t in w} | {"SPY"}
    for i, day in enumerate(days):
        move = {}
        for t in wanted:
            if (day, t) in close:
                move[t] = close[day, t] / last[t] - 1 if t in last else 0.0
                last[t] = close[day, t]
        grown = value * (1 + (sum(w * move.get(t, 0.0) for t, w in held.items()) if i else 0.0))
        turned = 0.0
        if pending is not None:
            for t in sorted(set(held) | set(pending)):
                delta = pending.get(t, 0.0) - held.get(t, 0.0)
                turned += abs(delta)
                if abs(delta) > 1e-10:
                    price = opened.get((day, t), 0.0)
                    bought = grown * delta / price if price > 0 else 0.0
                    shares[t] = shares.get(t, 0.0) + bought
                    trades.append((day, t, grown * delta, bought))
            held, pending = pending, None
        if day in positions:
            pending = positions[day]
        value = grown - grown * turned * rate
        curve.append((day, value, turned, sum(held.values()), {t: shares.get(t, 0.0) for t in held}))
    return curve, trades


def test_simulation_equals_daily_walk(spark, market):
    days, prices, _, price_frame, prediction_frame = market
    run = B.simulate(prediction_frame, price_frame, "v", top_pct=0.5, max_weight=0.4, min_weight=0.05, rebalance_days=3)
    positions = {}
    for r in run.positions.collect():
        positions.setdefault(r["date"], {})[r["ticker"]] = r["target_weight"]
    assert sorted(positions) == days[::3]
    curve, traded = walk(days, prices, positions)
    results = run.results.orderBy("date").collect()
    assert [r["date"] for r in results] == days
    assert np.allclose([r["portfolio_value"] for r in results], [c[1] for c in curve], rtol=1e-10)
    assert np.allclose([r["turnover"] for r in results], [c[2] for c in curve])
    assert np.allclose([r["net_exposure"] for r in results], [c[3] for c in curve])
    fills = {(r["fill_date"], r["ticker"]): (r["fill_value"], r["fill_shares"]) for r in run.fills.collect()}
    assert set(fills) == {(d, t) for d, t, *_ in traded}
    assert all(np.allclose(fills[d, t], (v, s)) for d, t, v, s in traded)
    held = {(r["as_of_date"], r["ticker"]): r["shares"] for r in run.current_positions.collect()}
    expected = {(day, t): s for day, *_, shares in curve for t, s in shares.items()}
    assert held.keys() == expected.keys() and all(np.isclose(held[k], expected[k]) for k in held)


def test_sweep_equals_single_runs(spark, market):
    *_, price_frame, prediction_frame = market
    grid = (S.Candidate(0.2, 0.7, top_pct=0.5, rebalance_days=5), S.Candidate(0.4, 1.0, top_pct=0.5, rebalance_days=3))
    report = {r["candidate_id"]: r for r in S.candidate_sweep(prediction_frame, price_frame, grid).collect()}
    dates = S.tuning_dates(prediction_frame).where("is_tuning")
    assert dates.count() == 42
    tuned = prediction_frame.join(dates, "date", "left_semi")
    for i, c in enumerate(grid):
        alone = B.simulate(tuned, price_frame, "v", c.top_pct, c.max_weight, c.min_weight, c.rebalance_days, c.target_exposure).metrics.first()
        for name in S.REPORT_METRICS:
            assert report[i][name] == pytest.approx(alone[name], rel=1e-9)


def test_liquidity_filter_drops_illiquid_names(market):
    *_, price_frame, prediction_frame = market
    kept = {r["ticker"] for r in P.liquidity_filter(prediction_frame, price_frame, 10_000.0).select("ticker").distinct().collect()}
    assert "n7" not in kept and len(kept) == 7
