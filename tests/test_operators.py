"""Hand-made frames: positions, performance, linking, attribution, factors and risk."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import hmm
from tallyfield.operators import attribution as A
from tallyfield.operators import factors as X
from tallyfield.operators import fundamentals as C
from tallyfield.operators import linking as L
from tallyfield.operators import performance as D
from tallyfield.operators import positions as P
from tallyfield.operators import regime as G
from tallyfield.operators import risk as R
from tallyfield.operators import rollup as U

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


TRADES = [
    ("P", "AAA", day(0), "B", 10.0, 100.0), ("P", "AAA", day(2), "S", 4.0, 110.0), ("P", "AAA", day(2), "B", 1.0, 108.0),
    ("P", "BBB", day(1), "B", 5.0, 50.0), ("P", "BBB", day(3), "S", 7.0, 52.0), ("P", "CCC", day(1), "X", 5.0, 50.0), ("P", "AAA", day(5), "B", 1.0, 111.0),
]
TRADE_SCHEMA = "portfolio string, ticker string, date date, side string, quantity double, price double"


@pytest.fixture(scope="module")
def trades(spark):
    return spark.createDataFrame(TRADES, TRADE_SCHEMA)


def test_running_quantity_is_one_row_a_day_and_may_be_short(trades):
    got = {(r.ticker, r.date): r.quantity for r in P.running_quantity(P.daily_trades(trades)).collect()}
    assert got == {("AAA", day(0)): 10, ("AAA", day(2)): 7, ("BBB", day(1)): 5, ("BBB", day(3)): -2, ("CCC", day(1)): 0, ("AAA", day(5)): 8}


def test_unroll_fills_to_the_last_snapshot_and_not_empty_positions(trades):
    rows = P.unroll_daily(P.running_quantity(P.daily_trades(trades))).collect()
    days = lambda t: sorted(r.date for r in rows if r.ticker == t)
    assert days("AAA") == [day(i) for i in range(6)]
    assert days("BBB") == [day(i) for i in range(1, 6)]
    assert days("CCC") == [day(1)]


def test_extension_is_for_long_positions(spark, trades):
    daily = P.unroll_daily(P.running_quantity(P.daily_trades(trades)))
    prices = spark.createDataFrame([("AAA", day(8), 1.0), ("BBB", day(8), 1.0)], "ticker string, date date, close double")
    rows = P.extend_to_last_price(daily, prices).collect()
    assert max(r.date for r in rows if r.ticker == "AAA") == day(8)
    assert max(r.date for r in rows if r.ticker == "BBB") == day(5)


def test_incremental_equals_full(trades):
    old, new = trades.where("date < '2024-01-03'"), trades.where("date >= '2024-01-03'")
    full = sorted(map(tuple, P.running_quantity(P.daily_trades(trades)).collect()))
    assert sorted(map(tuple, P.running_quantity(P.daily_trades(P.append_transactions(old, new))).collect())) == full


def test_split_alignment_reaches_over_a_weekend(spark):
    friday = dt.date(2024, 1, 5)
    t = spark.createDataFrame([("P", "A", friday, "B", 1.0, 0.0), ("P", "A", friday, "B", 1.0, 5.0), ("P", "B", dt.date(2024, 1, 3), "B", 1.0, 0.0)], TRADE_SCHEMA)
    s = spark.createDataFrame([("A", dt.date(2024, 1, 8)), ("B", dt.date(2024, 1, 8))], "ticker string, split_date date")
    got = {(r.ticker, r.price): r.date for r in P.align_split_dates(t, s).collect()}
    assert got == {("A", 0.0): dt.date(2024, 1, 8), ("A", 5.0): friday, ("B", 0.0): dt.date(2024, 1, 3)}


def test_unadjusted_prices(spark):
    p = spark.createDataFrame([("A", day(0), 10.0, 0.0), ("A", day(1), 11.0, 2.0), ("A", day(2), 12.0, None)], "ticker string, date date, close double, split double")
    got = [(r.raw_close, r.split_factor) for r in P.unadjust_prices(p).orderBy("date").collect()]
    assert got == [(20.0, 2.0), (11.0, 2.0), (12.0, 1.0)]


def test_mapping_renames_and_refuses_clashes(spark):
    raw = spark.createDataFrame([("31/01/2024", "Buy", "3")], "When string, Way string, Qty string")
    out = P.map_transactions(raw, {"When": "transaction_date", "Way": "buy_sell", "Qty": "quantity", "No": "x"}, {"Buy": "B"}, "dd/MM/yyyy").first()
    assert (out.transaction_date, out.buy_sell) == (dt.date(2024, 1, 31), "B")
    with pytest.raises(P.MappingError):
        P.map_transactions(raw, {"When": "Way", "Way": "buy_sell"}, {}, "dd/MM/yyyy")


@pytest.fixture(scope="module")
def perf(spark, trades):
    daily = P.unroll_daily(P.running_quantity(P.daily_trades(trades)))
    rows = [(t, day(i), 100.0 + 3 * i + 7 * j, 1.0 if (t, i) == ("AAA", 3) else 0.0, 1.0) for j, t in enumerate(("AAA", "BBB", "CCC")) for i in range(6) if i != 4]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double, dividend double, split_factor double")
    fx = spark.createDataFrame([("USD", dt.date(2024, 1, 1), 2.0)], "ccy string, date date, fx_rate double")
    inst = spark.createDataFrame([("AAA", "USD", "S0", "x"), ("BBB", "USD", "S1", "y"), ("CCC", "USD", "S1", "y")], "ticker string, ccy string, c1 string, c2 string")
    return D.daily_performance(P.price_positions(daily, prices, fx, inst), P.daily_trades(trades)).cache()


def test_rates_move_from_day_to_day_and_gaps_are_carried(spark, trades):
    daily = P.unroll_daily(P.running_quantity(P.daily_trades(trades))).where("ticker = 'AAA'")
    prices = spark.createDataFrame([("AAA", day(i), 100.0, 0.0, 1.0) for i in range(6)], "ticker string, date date, close double, dividend double, split_factor double")
    fx = spark.createDataFrame([("EUR", day(0), 1.0), ("EUR", day(1), 1.25), ("EUR", day(3), 1.5)], "ccy string, date date, fx_rate double")
    inst = spark.createDataFrame([("AAA", "EUR")], "ticker string, ccy string")
    rows = {r.date: r for r in D.daily_performance(P.price_positions(daily, prices, fx, inst), P.daily_trades(trades)).collect()}
    assert [rows[day(i)].fx_rate for i in range(6)] == [1.0, 1.25, 1.25, 1.5, 1.5, 1.5]
    assert rows[day(1)].ret == pytest.approx(1.25) and rows[day(1)].ret_lcl == 1 and rows[day(1)].ccy_ret == pytest.approx(1.25)
    assert rows[day(3)].ccy_ret == pytest.approx(1.2) and rows[day(4)].ccy_ret == 1


def test_a_preferred_exchange_comes_first(spark):
    tx = spark.createDataFrame([("I1", "EUR"), ("I2", "EUR")], "isin string, currency string")
    inst = spark.createDataFrame([("I1", "EUR", "A", "FP", "Common Stock"), ("I1", "EUR", "B", "GY", "Common Stock"), ("I2", "EUR", "C", "FP", "Common Stock")], "isin string, currency string, ticker string, exchange string, security_type string")
    suffixes = spark.createDataFrame([("GY", ".DE"), ("FP", ".PA")], "exchange string, suffix string")
    none = spark.createDataFrame([], "isin string")
    tickers = lambda liked: sorted(r.ticker for r in P.resolve_identifiers(tx, inst, suffixes, none, liked)[0].collect())
    assert tickers(None) == ["A.PA", "C.PA"] and tickers("GY") == ["B.DE", "C.PA"]


def test_first_day_has_no_holding_profit(perf):
    first = perf.where("ticker = 'AAA' and date = '2024-01-01'").first()
    assert (first.bod if "bod" in first else first.position_basis, first.pnl_lcl, first.trb_lcl) == (0, 0.0, 1000.0)


def test_profit_of_holding_trading_and_income(perf):
    r = perf.where("ticker = 'AAA' and date = '2024-01-03'").first()  # 10 held from 103 to 106; sold 4 at 110, bought 1 at 108
    assert r.pnl_lcl == pytest.approx(10 * 3 + 4 * (110 - 106) + 1 * (106 - 108))
    assert r.tx_pnl_lcl == pytest.approx(16 - 2)
    assert r.ret_hlds_lcl == pytest.approx(1 + 30 / 1030)
    d = perf.where("ticker = 'AAA' and date = '2024-01-04'").first()
    assert d.income_pnl_lcl == pytest.approx(7.0)
    assert d.income_pnl == pytest.approx(14.0)


def test_gaps_in_prices_are_carried_forward(perf):
    r = perf.where("ticker = 'AAA' and date = '2024-01-05'").first()
    assert r.close == 109.0 and r.pnl_lcl == 0.0 and r.ccy_ret == pytest.approx(1.0)


def test_rollup_root_equals_sum_of_contributions(perf):
    w = U.weighted(perf)
    root = {r.date: r for r in U.rollup(w, ["c1"]).where("level = 0").collect()}
    parts = {r.date: r.s for r in w.groupBy("date").agg(F.sum(F.col("w_pos") * (F.col("ret_hlds") - 1) + F.col("w_trb") * (F.col("tx_ret") - 1)).alias("s")).collect()}
    for d, r in root.items():
        assert r.ret == pytest.approx(1 + (parts[d] or 0))


def test_linked_parts_add_up(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        a, b = rng.normal(0, 0.02, 2)
        rows.append(("P", day(i), float(1 + a + b), float(1 + a), float(1 + b)))
    out = L.link_split(spark.createDataFrame(rows, "k string, date date, r double, a double, b double"), ["k"], "r", ["a", "b"]).orderBy("date").collect()
    total = 1.0
    for i, r in enumerate(out):
        total *= 1 if i == 0 else r.r
        assert r.acc_r == pytest.approx(total) and r.acc_a + r.acc_b - 1 == pytest.approx(total, abs=1e-10)


def test_linked_active_effects_add_up(spark):
    rng = np.random.default_rng(4)
    rows = [("x", day(i), float(1 + p), float(1 + b), float(100 * (p - b) * u), float(100 * (p - b) * (1 - u))) for i, (p, b, u) in enumerate(zip(rng.normal(0, 0.02, 50), rng.normal(0, 0.02, 50), rng.random(50), strict=True))]
    out = L.link_active(spark.createDataFrame(rows, "k string, date date, p double, b double, e1 double, e2 double"), ["k"], "p", "b", ["e1", "e2"]).collect()
    for r in out:
        assert r.acc_e1 + r.acc_e2 == pytest.approx(r.acc_active, abs=1e-9)


def test_edge_returns_link_as_flat(spark):
    rows = [("k", day(i), r, r) for i, r in enumerate([1.0, 1.0, 0.0, -0.5, None, 1.1])]
    out = L.link_split(spark.createDataFrame(rows, "k string, date date, r double, s double"), ["k"], "r", ["s"]).orderBy("date").collect()
    assert out[-1].acc_r == pytest.approx(1.1) and np.isfinite(out[-1].acc_s)


def test_attribution_identity(spark, perf):
    bench = perf.withColumns({"portfolio": F.lit("B"), "quantity": F.col("quantity") * 2}).where("ticker <> 'CCC'")
    bench = bench.withColumns({c: F.col(c) * F.when(F.col("ticker") == "AAA", 3).otherwise(1) for c in ("m2m_bod", "position_basis", "trb", "mkt_value", "pnl")})
    w = U.weighted(perf).unionByName(U.weighted(bench))
    tree = A.merge_tree(A.tree_nodes(U.rollup(w, ["c1", "c2"]), w, ["c1", "c2"]), "P", "B", ["c1", "c2"])
    eff = A.daily_effects(tree, ["c1", "c2"])
    for r in eff.where("level = 0").collect():
        assert r.allocation + r.selection + r.leverage == pytest.approx((r.rp - r.rb) * 100, abs=1e-8)
    for r in A.linked_effects(eff, ["c1", "c2"]).where("level = 0").collect():
        assert r.acc_allocation + r.acc_selection + r.acc_leverage == pytest.approx(r.acc_active, abs=1e-8)


def test_factors_do_not_look_ahead(spark):
    rng = np.random.default_rng(5)
    base = [("A", day(i), float(100 + rng.normal()), 5) for i in range(40)]
    shock = [(t, d, c * (3 if i == 39 else 1), v) for i, (t, d, c, v) in enumerate(base)]
    s = X.FactorSettings(momentum=10, momentum_skip=2, low_vol=10, reversal=3, liquidity=5, min_history=11)
    make = lambda rows: [tuple(r) for r in X.price_factors(spark.createDataFrame(rows, "ticker string, date date, close double, volume int"), s).orderBy("date").collect()]
    assert make(base)[:-1] == make(shock)[:-1] and make(base)[-1] != make(shock)[-1]


def test_scores_are_clipped_and_missing_is_zero(spark):
    rows = [(DAY, f"T{i}", float(i)) for i in range(30)] + [(DAY, "out", 1e6), (DAY, "none", None)] + [(day(1), "x", 1.0)]
    out = {r.ticker: r.v for r in X.winsor_z(spark.createDataFrame(rows, "date date, ticker string, v double"), ["v"]).collect()}
    assert out["none"] == 0.0 and out["x"] == 0.0 and np.mean([v for k, v in out.items() if k not in ("none", "x")]) == pytest.approx(0, abs=1e-9)


def test_fundamentals_wait_for_the_report(spark):
    st = spark.createDataFrame([("A", dt.date(2023, 3, 31), 1.0), ("A", dt.date(2023, 6, 30), 2.0), ("A", dt.date(2023, 9, 30), -4.0)], "ticker string, period_end date, v double")
    dates = spark.createDataFrame([("A", dt.date(2023, 8, 1)), ("A", dt.date(2023, 8, 20)), ("A", dt.date(2024, 1, 1))], "ticker string, date date")
    got = {r.date: (r.v_ttm, r.v_yoy) for r in C.trailing_sums(C.asof_quarters(dates, st), ["v"]).collect()}
    assert got == {dt.date(2023, 8, 1): (None, 0.0), dt.date(2023, 8, 20): (6.0, 100.0), dt.date(2024, 1, 1): (pytest.approx(-4 / 3), -500.0)}


def risk_inputs(spark):
    rng = np.random.default_rng(6)
    tickers, factors = [f"T{i}" for i in range(6)], ["f1", "f2"]
    x = rng.normal(size=(6, 2))
    cov = np.array([[0.04, 0.01], [0.01, 0.09]]) / 252
    d = np.full(6, 0.02 / 252)
    w = np.array([0.3, 0.2, 0.2, 0.1, 0.1, 0.1])
    frame = spark.createDataFrame
    return (x, cov, d, w), (
        frame([("P", t, float(v)) for t, v in zip(tickers, w, strict=True)], "portfolio string, ticker string, weight double"),
        frame([(t, f, float(x[i, j])) for i, t in enumerate(tickers) for j, f in enumerate(factors)], "ticker string, factor string, x double"),
        frame([(a, b, float(cov[i, j])) for i, a in enumerate(factors) for j, b in enumerate(factors)], "i string, j string, covariance double"),
        frame([(t, float(v)) for t, v in zip(tickers, d, strict=True)], "ticker string, idio_var double"),
    )


def test_risk_against_matrices(spark):
    (x, cov, d, w), tables = risk_inputs(spark)
    total = w @ (x @ cov @ x.T + np.diag(d)) @ w
    r = R.portfolio_risk(*tables, horizon_days=4, value=1000.0).first()
    assert r.total_vol == pytest.approx(np.sqrt(total * 252) * 100) and r.var_95 == pytest.approx(np.sqrt(total) * 2 * 1.6449 * 1000)
    rows = R.euler(*tables).collect()
    top = next(r for r in rows if r.ticker is None)
    assert top.rc_pct == pytest.approx(100) and top.rc_vol == pytest.approx(np.sqrt(total * 252) * 100)
    with pytest.raises(ValueError):
        R.quantile(0.9)


def test_closed_form_covariance_equals_the_recursion(spark):
    rng = np.random.default_rng(7)
    f = rng.normal(size=(30, 2))
    rows = [(day(i), n, float(f[i, j])) for i in range(30) for j, n in enumerate("ab")]
    lam, state = R.decay(10), np.diag(f[0] ** 2)
    for v in f[1:]:
        state = lam * state + (1 - lam) * np.outer(v, v)
    got = {(r.i, r.j): r.covariance for r in R.ewma_covariance(spark.createDataFrame(rows, "date date, factor string, factor_return double"), 10).collect()}
    for i, a in enumerate("ab"):
        for j, b in enumerate("ab"):
            assert got[a, b] == pytest.approx(state[i, j])


def test_regression_recovers_factors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 2))
    y = x @ [0.01, -0.02]
    rows = [(DAY, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(60)]
    got = {r.factor: r for r in R.wls_multi(spark.createDataFrame(rows, "date date, ret double, a double, b double"), ["a", "b"]).collect()}
    assert got["a"].factor_return == pytest.approx(0.01) and got["b"].factor_return == pytest.approx(-0.02) and got["a"].r2 == pytest.approx(1)


def test_factor_attribution_identity(spark):
    rows = [("P", day(i), t, 0.5) for i in range(4) for t in "AB"]
    w = spark.createDataFrame(rows, "portfolio string, date date, ticker string, weight double")
    x = spark.createDataFrame([(day(i), t, "f", 1.0 + i) for i in range(4) for t in "AB"], "date date, ticker string, factor string, x double")
    f = spark.createDataFrame([(day(i), "f", 0.01 * i) for i in range(4)], "date date, factor string, factor_return double")
    ret = spark.createDataFrame([("P", day(i), 1 + 0.02 * i) for i in range(4)], "portfolio string, date date, ret_hlds double")
    a = R.factor_attribution(w, x, f, ret)
    by = {}
    for r in R.linked_factor_attribution(a, ret).collect():
        by.setdefault(r.date, {})[r.factor] = (r.component, r.acc_component)
    total = 1.0
    for i in range(4):
        c = by[day(i)]
        assert c["total"][0] + c["excess"][0] == pytest.approx(0.02 * i)
        total *= 1 + 0.02 * i
        assert c["f"][1] + c["excess"][1] == pytest.approx(total - 1)


def test_markov_model_finds_two_states():
    rng = np.random.default_rng(9)
    state = np.repeat([0, 1, 0, 1, 0, 1], 60)
    x = np.where(state[:, None] == 0, rng.normal(1, 0.3, (360, 2)), rng.normal(-1, 0.8, (360, 2)))
    _, m = hmm.fit_best(x, 2)
    p = m.filtered(x)
    agree = (p.argmax(axis=1) == state).mean()
    assert max(agree, 1 - agree) > 0.95 and p.sum(axis=1) == pytest.approx(np.ones(360))
    assert hmm.n_parameters(2, 2, "diag") == 4 + 4 + 2 + 1


def test_forward_probabilities_against_enumeration():
    import itertools

    rng = np.random.default_rng(10)
    m = hmm.GaussianHmm(2)
    m.start, m.trans = np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.3, 0.7]])
    m.means, m.covs = np.array([[0.0], [1.0]]), np.array([[[1.0]], [[0.5]]])
    x = rng.normal(size=(5, 1))
    dens = np.exp(m.emissions(x))
    want = np.zeros(2)
    for path in itertools.product(range(2), repeat=5):
        p = m.start[path[0]] * dens[0, path[0]]
        for t in range(1, 5):
            p *= m.trans[path[t - 1], path[t]] * dens[t, path[t]]
        want[path[-1]] += p
    assert m.filtered(x)[-1] == pytest.approx(want / want.sum())


def test_distance_of_normals_and_templates():
    a, b = np.diag([1.0, 4.0]), np.diag([9.0, 16.0])
    assert hmm.wasserstein2(np.zeros(2), a, np.ones(2), b) == pytest.approx(np.sqrt(2 + 4 + 4))
    book = hmm.TemplateBook(threshold=1.0)
    first = book.match(np.array([[0.0], [5.0]]), np.array([[[1.0]], [[1.0]]]))
    assert book.match(np.array([[5.1], [0.1]]), np.array([[[1.0]], [[1.0]]])) == first[::-1]
    assert book.match(np.array([[20.0]]), np.array([[[1.0]]])) == [2]


def test_construction_respects_its_limits():
    rng = np.random.default_rng(11)
    cov = np.cov(rng.normal(size=(8, 40)))
    mu = rng.normal(0, 0.01, 8)
    w = hmm.construct_weights(mu, cov, np.zeros(8), 0.3, 0.001, 5.0, 20.0)
    assert w.sum() == pytest.approx(1) and w.min() >= -1e-9 and w.max() <= 0.3 + 1e-9
    with pytest.raises(ValueError):
        hmm.construct_weights(mu, cov, np.zeros(8), 0.1, 0.0, 1.0, 1.0)


def test_construction_is_an_optimum():
    """No shift of weight between two names helps: the conditions of an optimum of a concave objective."""
    rng = np.random.default_rng(12)
    for n, cap, cost, aversion in ((12, 0.2, 0.001, 5.0), (30, 0.1, 0.0, 20.0), (30, 0.08, 0.01, 5.0), (5, 1.0, 0.0005, 0.0), (40, 0.05, 0.002, 1.0)):
        x = rng.normal(size=(n, 3))
        cov = x @ x.T * 1e-4 + np.diag(rng.uniform(1e-5, 1e-3, n))
        mu, before, h = rng.normal(0, 1e-3, n), hmm.nearest_traded(rng.uniform(0, 2 / n, n), np.zeros(n), cap, 0.0), 20.0
        value = lambda w: w @ mu * h - aversion / 2 * h * w @ cov @ w - cost * np.abs(w - before).sum()  # noqa: B023, E731
        w = hmm.construct_weights(mu, cov, before, cap, cost, aversion, h)
        assert w.sum() == pytest.approx(1, abs=1e-9) and w.min() >= 0 and w.max() <= cap + 1e-12
        best = value(w)
        for i in range(n):
            for j in range(n):
                for step in (1e-5, 1e-3):
                    s = min(step, w[i], cap - w[j])
                    if i != j and s > 0:
                        moved = w.copy()
                        moved[i] -= s
                        moved[j] += s
                        assert value(moved) <= best + 1e-10


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(13)
    for _ in range(200):
        n = int(rng.integers(1, 5))
        cost = rng.integers(0, 9, (n, rng.integers(n, 7))).astype(float)
        got = hmm.assign(cost)
        least = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(cost.shape[1]), n))
        assert len(set(got)) == n and sum(cost[i, j] for i, j in enumerate(got)) == least


def test_templates_have_no_bound():
    book = hmm.TemplateBook(threshold=1.0)
    for i in range(30):
        assert book.match(np.array([[10.0 * i]]), np.array([[[1.0]]])) == [i]


def test_standardising_is_causal(spark):
    rng = np.random.default_rng(12)
    rows = [(day(i), "f", float(v)) for i, v in enumerate(rng.normal(size=60))]
    z = lambda r: [x.z for x in G.causal_standardised(spark.createDataFrame(r, "date date, factor string, factor_return double")).orderBy("date").collect()]
    a, b = z(rows), z(rows[:-1] + [(day(59), "f", 100.0)])
    assert a[20:59] == b[20:59] and a[59] != b[59]
