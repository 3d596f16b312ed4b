"""Sources, envelopes, streams and the calls of the engine on a small store."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.api import Engine
from tallyfield.errors import enveloped, records
from tallyfield.operators.factors import FactorSettings
from tallyfield.operators.risk import decay
from tallyfield.sources import config as S
from tallyfield.sources import tables as T
from tallyfield.streaming.online import append_stream, ewma_variance_stream

DAY = dt.date(2023, 1, 2)


def test_sources_say_what_they_miss():
    assert S.SourceConfig(folder="a|b").uri("x") == "a/b/x"
    assert S.SourceConfig("s3", bucket="b", folder="p", access_key_id="k", secret_access_key="s").uri("t") == "s3a://b/p/t"
    with pytest.raises(S.SourceError, match="bucket"):
        S.SourceConfig("s3").validate()
    assert S.split_list("a| b||c") == ["a", "b", "c"]


def test_csv_window_lock_listing_and_models(spark, tmp_path):
    d = str(tmp_path)
    df = spark.createDataFrame([(dt.date(2024, 1, i), i) for i in range(1, 6)], "date date, v int")
    assert T.write_table(df.coalesce(1), d, "t", "csv")
    assert T.read_csv(spark, f"{d}/t", "date date, v int", "date", "2024-01-02", "2024-01-04").count() == 3
    for n in ("p.csv", "p_a.csv", "p_b.csv", "q.csv"):
        (tmp_path / n).write_text("x")
    assert S.list_files(spark, d, "p") == ["p_a.csv", "p_b.csv"]
    (tmp_path / "c.json").write_text('{"a": [1]}')
    assert S.read_json_config(spark, f"{d}/c.json") == {"a": [1]}
    (tmp_path / "write.lock").write_text("")
    assert not T.write_table(df, d, "t2")
    T.save_model(d, "m", {"x": df})
    assert T.load_model(spark, d, "m", ["x"])["x"].count() == 5
    one = spark.createDataFrame([("a/daily_ABC.csv",)], "f string").select(T.ticker_of_file(F.col("f")).alias("t")).first()
    assert one.t == "ABC" and T.missing_columns(df, ["v", "w"]) == ["w"]
    assert T.promoted(spark, [["junk", None], ["A", "B"], ["1", None]], 1).first().asDict() == {"A": "1", "B": None}


def test_failures_come_in_an_envelope(spark):
    r = enveloped("divide", lambda: 1 / 0)
    assert r.status == "FAILED" and "ZeroDivisionError" in r.text()
    assert enveloped("one", lambda: 1).value == 1
    assert records(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")) == [{"a": None, "b": 1.0}]


def test_streamed_variance_equals_the_recursion(spark, tmp_path):
    rows = [("A", DAY + dt.timedelta(days=i), 0.1 * (i + 1)) for i in range(4)]
    src = str(tmp_path / "in")
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "ticker string, date date, residual double").coalesce(1).write.parquet(f"{src}/b={i}")
    stream = spark.readStream.schema("ticker string, date date, residual double").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = ewma_variance_stream(stream).writeStream.format("memory").queryName("ewma_rows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    lam, want = decay(21.0), None
    for r in rows:
        want = r[2] ** 2 if want is None else lam * want + (1 - lam) * r[2] ** 2
    got = spark.sql("select idio_var from ewma_rows order by date desc limit 1").first()[0]
    assert got == pytest.approx(want)
    a = append_stream(spark.readStream.schema("ticker string, date date, residual double").parquet(f"{src}/*"), str(tmp_path / "out"), str(tmp_path / "ck"))
    a.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("store"))
    rng = np.random.default_rng(1)
    days = [DAY + dt.timedelta(days=i) for i in range(120)]
    tickers = [f"T{i:02d}" for i in range(12)]
    prices = []
    for j, t in enumerate(tickers):
        p = 50.0 + j
        for i, x in enumerate(days):
            p *= 1 + float(rng.normal(0, 0.01))
            prices.append((t, x, p, 100 + j, 0.5 if i == 40 else 0.0, 0.0))
    trades = [(b, t, days[i % 5], "B", float(10 + (j + k) % 4), 50.0 + j) for k, b in enumerate(("P", "B")) for j, t in enumerate(tickers) for i in (0, 3)]
    trades += [("P", t, days[-1], "B", 1.0, 60.0) for t in tickers] + [("B", t, days[-1], "B", 1.0, 60.0) for t in tickers]
    frame = spark.createDataFrame
    e = Engine(spark, S.SourceConfig(folder=d))
    T.write_table(frame(prices, "ticker string, date date, close double, volume int, dividend double, split double"), d, "prices")
    T.write_table(frame(trades, "portfolio string, ticker string, date date, side string, quantity double, price double"), d, "transactions")
    T.write_table(frame([(t, "USD" if j % 2 else "EUR", f"S{j % 3}", f"C{j % 2}") for j, t in enumerate(tickers)], "ticker string, ccy string, c1 string, c2 string"), d, "instruments")
    T.write_table(frame([(c, dt.date(2023, m, 1), 1.0 if c == "USD" else 1.0 + m / 64) for c in ("USD", "EUR") for m in range(1, 7)], "ccy string, date date, fx_rate double"), d, "fx")
    T.write_table(frame([(t, DAY, 1e6 * (j + 1)) for j, t in enumerate(tickers)], "ticker string, report_date date, shares double"), d, "shares")
    for p in ("P", "B"):
        e.impute_positions(p)
    return e, days, tickers


def test_positions_and_totals(engine):
    e, days, tickers = engine
    assert e.table("positions").where("portfolio = 'P'").count() == sum(120 - (0) for _ in tickers)
    h = e.holdings("P", str(days[0]), str(days[-1]), ["c1"], indicators=True, benchmark="B").where("ret_1w is not null")
    assert h.count() == 12 * 113 and h.first().beta is not None
    last = e.portfolio_totals("P", str(days[0]), str(days[-1]), ["c1"], "B").where("level = 0").orderBy("portfolio", F.desc("date")).first()
    assert last.acc_ret_lcl + last.acc_ccy_ret - 1 == pytest.approx(last.acc_ret, abs=1e-9)


def test_totals_link_every_field(engine):
    e, days, _ = engine
    rows = e.portfolio_totals("P", str(days[0]), str(days[-1]), ["c1"], indicators=True).where(F.col("date") == F.lit(str(days[-1])).cast("date")).collect()
    root = next(r for r in rows if r.level == 0)
    tops = [r for r in rows if r.level == 1]
    # a level's holdings contributions add up to the compounded holdings return of days after the first
    assert sum(r.acc_contribution for r in tops) == pytest.approx(root.acc_contribution) and root.acc_contribution == pytest.approx(root.acc_ret - 1, abs=1e-3)
    assert sum(r.acc_pnl for r in tops) == pytest.approx(root.acc_pnl) and root.acc_ret_hlds > 0 and root.acc_tx_ret is not None
    assert all(r.std_dev > 0 and r.ret_1w is not None and r.ret_1w_lcl is not None for r in rows)


def test_raw_files_become_positions(spark, engine, tmp_path):
    e, days, _ = engine
    d = str(tmp_path)
    own = Engine(spark, S.SourceConfig(folder=d))
    for t in ("prices", "fx", "instruments"):
        T.write_table(e.table(t), d, t)
    T.write_table(spark.createDataFrame([("I1", "EUR", "T00", "US", "Common Stock"), ("I1", "EUR", "T00", "FP", "Common Stock"), ("I2", "USD", "T01", "US", "Common Stock")], "isin string, currency string, ticker string, exchange string, security_type string"), d, "listings")
    columns = {"Id": "isin", "Ccy": "currency", "Day": "transaction_date", "Way": "buy_sell", "Pieces": "quantity", "Paid": "price"}
    raw = lambda rows: spark.createDataFrame(rows, "Id string, Ccy string, Day string, Way string, Pieces string, Paid string")
    first = raw([("I1", "EUR", "02/01/2023", "Buy", "10", "50"), ("I9", "EUR", "02/01/2023", "Buy", "1", "1")])
    unknown = own.import_transactions("P", first, columns, {"Buy": "B", "Sell": "S"}, "dd/MM/yyyy", preferred_exchange="US")
    assert [r.isin for r in unknown.collect()] == ["I9"]
    own.import_transactions("P", raw([("I2", "USD", "05/01/2023", "Buy", "4", "51")]), columns, {"Buy": "B", "Sell": "S"}, "dd/MM/yyyy", append=True)
    own.import_transactions("Q", raw([("I2", "USD", "05/01/2023", "Sell", "4", "51")]), columns, {"Buy": "B", "Sell": "S"}, "dd/MM/yyyy")
    got = {(r.portfolio, r.ticker): (r.side, r.quantity) for r in own.table("transactions").collect()}
    assert got == {("P", "T00"): ("B", 10.0), ("P", "T01"): ("B", 4.0), ("Q", "T01"): ("S", 4.0)}
    p = {(r.ticker, r.date): r for r in own.impute_positions("P").collect()}
    assert p["T00", days[3]].quantity == 10 and p["T01", days[3]].quantity == 4 and p["T00", days[3]].close is not None
    fx = spark.createDataFrame([("EUR", DAY, 1.5), ("USD", DAY, 1.0)], "ccy string, date date, fx_rate double")
    T.write_table(fx, d, "fx")
    based = {(r.ticker, r.date): r.fx_rate for r in own.impute_positions("P", base_currency="EUR").collect()}
    assert based["T00", DAY] == 1.0


def test_calibration_takes_all_factors_and_the_day_before(spark, engine, tmp_path):
    e, days, tickers = engine
    d = str(tmp_path)
    own = Engine(spark, S.SourceConfig(folder=d))
    for t in ("prices", "fx", "instruments", "transactions", "positions"):
        T.write_table(e.table(t), d, t)
    ends = [dt.date(2021, 12, 31), dt.date(2022, 3, 31), dt.date(2022, 6, 30), dt.date(2022, 9, 30)]
    rows = [(t, x, 10.0 + j, 100.0 + 3 * j, 40.0 + j, 200.0 + (j * 7) % 5, 1e6 * (1 + j)) for j, t in enumerate(tickers) for x in ends]
    T.write_table(spark.createDataFrame(rows, "ticker string, period_end date, net_income double, revenue double, gross_profit double, equity double, shares double"), d, "statements")
    s = FactorSettings(momentum=10, momentum_skip=2, low_vol=10, reversal=3, liquidity=5, min_history=11, min_stocks=8)
    got = {r.factor for r in own.risk_calibration(settings=s, sector="c2", start=str(days[20]), end=str(days[100])).collect()}
    assert got == {"momentum", "low_vol", "reversal", "liquidity", "size", "value_ep", "value_bp", "quality_roe", "quality_gm", "sector_C1"}
    f = own.get_factor_returns()
    assert f.agg(F.min("date"), F.max("date")).first() == (days[20], days[100])
    used, cov = own._risk("used_exposures", "factor_cov")
    all_x = own._risk("exposures")[0]
    # what a date's regression used is what was known the day before
    shifted = all_x.select(F.date_add("date", 1).alias("date"), "ticker", "factor", F.col("x").alias("before"))
    both = used.join(shifted, ["date", "ticker", "factor"])
    assert both.count() == used.count() and both.where("x <> before").count() == 0
    # attribution's components are weights times fitted values
    att = own.get_factor_attribution("P", str(days[30]), str(days[60]), linked=False).where("factor = 'total'").collect()
    fitted = used.join(f.select("date", "factor", "factor_return"), ["date", "factor"]).groupBy("date", "ticker").agg(F.sum(F.col("x") * F.col("factor_return")).alias("fit"))
    assert len(att) == 31 and fitted.count() > 0 and att[0].component is not None


def test_attribution_call(engine):
    e, days, _ = engine
    top = e.performance_attribution("P", "B", str(days[0]), str(days[-1]), ["c1", "c2"]).where("level = 0").first()
    assert top.acc_allocation + top.acc_selection + top.acc_leverage == pytest.approx(top.acc_active, abs=1e-8)
    assert e.performance_attribution("P", "B", str(days[0]), str(days[-1]), ["c1", "c2"], trend=True).where("level = 0").count() == 17


def test_index_call(engine):
    e, days, tickers = engine
    idx = e.create_index(tickers[:4], "IDX")
    s = idx.groupBy("date").agg(F.sum("weight").alias("w")).collect()
    assert len(s) == 120 and all(r.w == pytest.approx(100) for r in s)


def test_risk_regime_and_construction_calls(engine):
    e, days, _ = engine
    s = FactorSettings(momentum=10, momentum_skip=2, low_vol=10, reversal=3, liquidity=5, min_history=11, min_stocks=8)
    assert e.risk_calibration(settings=s).count() == 4
    assert e.get_factor_covariance(correlation=True).where("i = j").count() == 4
    r = e.get_portfolio_risk("P", str(days[-1]), 0.95, 5, 1e6).first()
    assert r.total_vol > 0 and r.var_99 > r.var_95
    tree = e.get_portfolio_tree_risk("P", str(days[-1])).collect()
    assert next(x for x in tree if x.ticker is None).rc_vol == pytest.approx(r.total_vol)
    att = e.get_factor_attribution("P", str(days[30]), str(days[-1]))
    assert att.where("factor = 'excess'").count() > 50
    with pytest.raises(ValueError):
        e.get_portfolio_risk("P", str(days[-1]), 0.9)
    b = e.regime_calibration(window=60, refit=10, k_range=(1, 2), holdout=10)
    assert b.groupBy("date").agg(F.sum("probability").alias("p")).where("abs(p - 1) > 1e-6").count() == 0
    assert e.get_regime_summary().agg(F.sum("share_pct")).first()[0] == pytest.approx(100)
    w = e.construct_portfolio("P", str(days[-1]), target_n=10, max_weight=0.2)
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1) and w.agg(F.max("weight")).first()[0] <= 0.2 + 1e-9
    assert e.get_factor_returns(5).select("date").distinct().count() == 5
    assert e.get_cumulative_factor_returns().count() == e.get_factor_returns().count()
    assert e.get_calibration_summary().first().factors == 4 and e.get_factor_significance().count() == 4
    assert e.get_stock_risk("T01").count() == 1 and e.get_stock_risk().count() == 12
    assert e.get_portfolio_factor_contributions("P", str(days[-1])).agg(F.sum("variance")).first()[0] == pytest.approx(r.factor_var)
    now = e.get_current_regime().first()
    assert now.date == b.agg(F.max("date")).first()[0] and 0.3 < now.probability <= 1
    n = e.get_transition_matrix().agg(F.max("i")).first()[0] + 1
    assert e.get_expected_dwell_times().count() == n
    means, cov = e.get_regime_moments(now.regime)
    assert means.count() == 4 and cov.count() == 16
