"""The engine's calls. Each reads tables of a store and gives DataFrames.

A store is a folder with the Parquet tables transactions (portfolio, ticker, date, side, quantity, price),
instruments (ticker, ccy, classes), prices (ticker, date, close, volume, dividend, split), fx (ccy, date, fx_rate), and, where
a call needs them, shares, statements and estimates. Fitted models are tables of the store too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.errors import AnalyticsError
from tallyfield.functions.hmm import TemplateBook
from tallyfield.operators import attribution as A
from tallyfield.operators import factors as X
from tallyfield.operators import fundamentals as C
from tallyfield.operators import indicators as I
from tallyfield.operators import linking as L
from tallyfield.operators import positions as P
from tallyfield.operators import regime as G
from tallyfield.operators import risk as R
from tallyfield.operators import rollup as U
from tallyfield.operators.performance import daily_performance
from tallyfield.sources.config import SourceConfig
from tallyfield.sources.tables import CURRENCIES, EXCHANGE_SUFFIXES, load_model, read_table, save_model, write_table


@dataclass
class Engine:
    """All calls on one store."""

    spark: SparkSession
    source: SourceConfig

    @property
    def root(self) -> str:
        return self.source.apply(self.spark).uri()

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, name)

    def _of(self, name: str, portfolio: str) -> DataFrame:
        return self.table(name).where(F.col("portfolio") == portfolio)

    def _perf(self, portfolio: str, start: str | None, end: str | None) -> DataFrame:
        return daily_performance(self._of("positions", portfolio), P.daily_trades(self._of("transactions", portfolio)), start, end)

    # positions

    def import_transactions(self, portfolio: str, raw: DataFrame, columns: dict[str, str], codes: dict[str, str], date_format: str = "yyyy-MM-dd", append: bool = False, preferred_exchange: str | None = None) -> DataFrame:
        """Take raw rows into the store's transactions of ``portfolio``; the rows that no instrument resolves.

        ``columns`` names raw columns as isin, currency, transaction_date, buy_sell, quantity and price, ``codes`` turns the raw
        codes into B and S. Identifiers resolve by the store's listings (isin, currency, ticker, exchange, security_type),
        suffixes (exchange, suffix) and currencies known as cash. ``append`` keeps what is there, repeated rows too.
        """
        mapped = P.map_transactions(raw, columns, codes, date_format)
        suffixes = self._there("suffixes")
        suffixes = self.spark.createDataFrame(list(EXCHANGE_SUFFIXES), "exchange string, suffix string") if suffixes is None else suffixes
        cash = self.spark.createDataFrame([(c,) for c in CURRENCIES], "isin string")
        known, unknown = P.resolve_identifiers(mapped, self.table("listings"), suffixes, cash, preferred_exchange)
        new = known.select("ticker", F.col("transaction_date").alias("date"), F.col("buy_sell").alias("side"), F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"))
        there = self._there("transactions")
        if append and there is not None:
            new = P.append_transactions(there.where(F.col("portfolio") == portfolio).drop("portfolio"), new)
        # a table that is read can't be written over: the new one is complete before it takes the place
        ready = f"transactions_new_{portfolio}"
        write_table(new, self.root, ready)
        others = there.where(F.col("portfolio") != portfolio) if there is not None else None
        own = self.table(ready).withColumn("portfolio", F.lit(portfolio))
        write_table(own if others is None else others.unionByName(own, allowMissingColumns=True), self.root, "transactions_new")
        write_table(self.table("transactions_new"), self.root, "transactions")
        return unknown

    def impute_positions(self, portfolio: str, base_currency: str | None = None) -> DataFrame:
        """Dense, priced daily positions of a portfolio's transactions; written to the store. Rates are those of the store,
        against ``base_currency`` if it names one of its currencies."""
        trades = self._of("transactions", portfolio)
        splits = self.table("prices").where(F.coalesce("split", F.lit(0.0)) != 0).select("ticker", F.col("date").alias("split_date"))
        trades = P.align_split_dates(trades, splits)
        daily = P.extend_to_last_price(P.unroll_daily(P.running_quantity(P.daily_trades(trades))), self.table("prices"))
        prices = P.unadjust_prices(self.table("prices")).select("ticker", "date", F.col("raw_close").alias("close"), "dividend", "split_factor")
        fx = P.rebased(self.table("fx"), base_currency) if base_currency else self.table("fx")
        out = P.price_positions(daily, prices, fx, self.table("instruments"))
        write_table(out.drop("portfolio"), self.root, f"positions/portfolio={portfolio}")
        return self._of("positions", portfolio)

    def create_index(self, members: list[str], name: str) -> DataFrame:
        """A capitalisation-weighted index of the members as positions of ``name``."""
        idx = P.build_index(self.table("prices").where(F.col("ticker").isin(members)), self.table("shares").where(F.col("ticker").isin(members)))
        out = idx.join(self.table("instruments"), "ticker").withColumns({"dividend": F.lit(0.0), "split_factor": F.lit(1.0)})
        write_table(out, self.root, f"positions/portfolio={name}")
        return out

    # holdings, totals, attribution

    def holdings(self, portfolio: str, start: str, end: str, classes: list[str] = (), characteristics: list[str] = (), indicators: bool = False, benchmark: str | None = None) -> DataFrame:
        """Daily performance of positions with weights; characteristics and ex-post indicators if asked for."""
        rows = U.weighted(U.classified(self._perf(portfolio, start, end), list(classes)))
        if characteristics:
            q = C.asof_quarters(rows.select("ticker", "date").distinct(), self.table("statements"))
            rows = C.attach(rows, C.valuation_ratios(q), list(characteristics))
        if indicators:
            rows = I.spread(I.trailing_local(I.trailing_returns(rows, P.POSITION), P.POSITION), P.POSITION)
            if benchmark:
                bench = U.rollup(U.weighted(self._perf(benchmark, start, end)), []).select("date", F.col("ret").alias("bench_ret"))
                rows = rows.join(I.tracking(rows.select(*P.POSITION, "date", "ret"), bench, P.POSITION), P.POSITION, "left")
        return rows

    def portfolio_totals(self, portfolio: str, start: str, end: str, classes: list[str] = (), benchmark: str | None = None, indicators: bool = False) -> DataFrame:
        """Series of the root and all buckets, of the benchmark too.

        acc_ columns: total, holdings and trading returns linked with their local parts, the currency's part, profits as running
        sums, and contributions linked by the portfolio's own return, so that a level's add up to it. ``indicators``: trailing
        returns and ex-post risk of every node's series.
        """
        names = [portfolio] + ([benchmark] if benchmark else [])
        rows = None
        for n in names:
            part = U.weighted(U.classified(self._perf(n, start, end), list(classes)))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        nodes = U.rollup(rows, list(classes))
        keys = ["portfolio", "level", *classes]
        out = L.link_split(nodes, keys, "ret", ["ret_lcl", "ccy_ret"])
        out = L.link_split(out, keys, "ret_hlds", ["ret_hlds_lcl"])
        out = L.link_split(out, keys, "tx_ret", ["tx_ret_lcl"])
        out = L.accumulate(out, keys, [], ["pnl", "pnl_lcl", "income_pnl", "tx_pnl"])
        out = L.link_contributions(out, keys, ["contribution", "contribution_lcl"])
        return I.spread(I.trailing_local(I.trailing_returns(out, keys), keys), keys) if indicators else out

    def performance_attribution(self, portfolio: str, benchmark: str, start: str, end: str, classes: list[str], trend: bool = False) -> DataFrame:
        """Linked attribution effects on the last date, or weekly over the window."""
        span = [self._perf(n, start, end).agg(F.min("date").alias("a"), F.max("date").alias("b")).first() for n in (portfolio, benchmark)]
        if any(s.a is None for s in span):
            raise AnalyticsError("a side has no positions in the window")
        start, end = (str(max(s.a for s in span)), str(min(s.b for s in span)))
        w = U.weighted(U.classified(self._perf(portfolio, start, end), classes)).unionByName(U.weighted(U.classified(self._perf(benchmark, start, end), classes)), allowMissingColumns=True)
        tree = A.merge_tree(A.tree_nodes(U.rollup(w, classes), w, classes), portfolio, benchmark, classes)
        out = A.linked_effects(A.daily_effects(tree, classes), classes)
        return A.trend(out, start, end) if trend else A.last_date(out, end)

    # risk model

    def _there(self, name: str) -> DataFrame | None:
        """A table of the store that may be missing."""
        try:
            return self.table(name)
        except AnalysisException:
            return None

    def risk_calibration(self, tickers: list[str] | None = None, settings: X.FactorSettings = X.FactorSettings(), sector: str | None = None, scheme: str = "sqrt_mktcap", start: str | None = None, end: str | None = None) -> DataFrame:
        """Fit the cross-sectional model and keep it in the store; its summary.

        Price factors always take part; size, value and quality where the store has statements; dummies of the
        instruments' class ``sector``. Weights follow capitalisation by ``scheme`` where shares are known. Returns from
        ``start`` to ``end`` are fitted; exposures look back before ``start``.
        """
        panel = self.table("prices")
        panel = panel.where(F.col("ticker").isin(tickers)) if tickers else panel
        panel = panel.where(F.col("date") <= F.lit(end).cast("date")) if end else panel
        kinds, names = None, []
        if sector:
            kinds = self.table("instruments").select("ticker", F.col(sector).alias("sector"))
            names = [r[0] for r in kinds.where("sector is not null").select("sector").distinct().orderBy("sector").collect()]  # a classification's few labels
        z, factors = X.exposure_panel(panel, settings, self._there("statements"), kinds, names)
        rows = X.previous_exposures(z, X.daily_returns(panel))
        rows = rows.where(F.col("date") >= F.lit(start).cast("date")) if start else rows
        save_model(self.root, "risk", {"cross_section": rows})
        rows = load_model(self.spark, self.root, "risk", ["cross_section"])["cross_section"]
        fitted = R.wls_multi(rows, factors, "cap", scheme, settings.min_stocks)
        save_model(self.root, "risk", {"factor_returns": fitted})
        fitted = load_model(self.spark, self.root, "risk", ["factor_returns"])["factor_returns"]
        long = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in factors)))
        x = z.select("date", "ticker", long.alias("e")).select("date", "ticker", "e.factor", "e.x")
        own = rows.select("date", "ticker", "ret", long.alias("e")).select("date", "ticker", "ret", "e.factor", "e.x").join(fitted.select("date", "factor", "factor_return"), ["date", "factor"])
        residuals = own.groupBy("date", "ticker").agg((F.max("ret") - F.sum(F.col("x") * F.col("factor_return"))).alias("residual"))
        last = x.groupBy("ticker").agg(F.max("date").alias("date"))
        # what the regression of a date used, known the day before: factor attribution takes these
        used = rows.select("date", "ticker", long.alias("e")).select("date", "ticker", "e.factor", "e.x")
        save_model(self.root, "risk", {
            "exposures": x, "used_exposures": used, "latest_exposures": x.join(last, ["ticker", "date"]).select("ticker", "factor", "x"),
            "factor_cov": R.ewma_covariance(fitted, settings.covariance_halflife), "idio_var": R.ewma_idio(residuals, settings.idio_halflife),
        })
        return R.factor_summary(fitted)

    def _risk(self, *names: str) -> list[DataFrame]:
        return list(load_model(self.spark, self.root, "risk", list(names)).values())

    def get_factor_covariance(self, annualised: bool = False, correlation: bool = False) -> DataFrame:
        (cov,) = self._risk("factor_cov")
        return R.correlation(cov) if correlation else cov.withColumn("covariance", F.col("covariance") * (252 if annualised else 1))

    # model readers

    def get_factor_returns(self, last_n: int | None = None) -> DataFrame:
        """(date, factor, factor_return, t_stat, r2), the newest ``last_n`` dates if asked for."""
        (f,) = self._risk("factor_returns")
        if last_n is None:
            return f
        days = f.select("date").distinct().orderBy(F.desc("date")).limit(last_n)
        return f.join(days, "date", "left_semi")

    def get_cumulative_factor_returns(self) -> DataFrame:
        (f,) = self._risk("factor_returns")
        w = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        return f.select("date", "factor", F.product(1 + F.col("factor_return")).over(w).alias("cumulative"))

    def get_factor_significance(self) -> DataFrame:
        """Mean t statistic and share of days above 2, by factor."""
        return R.factor_summary(self.get_factor_returns()).select("factor", "avg_t", "avg_abs_t", "significant_pct")

    def get_calibration_summary(self) -> DataFrame:
        """One row: days, factors, first and last date, mean R squared."""
        return self.get_factor_returns().agg(F.countDistinct("date").alias("days"), F.countDistinct("factor").alias("factors"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("r2").alias("mean_r2"))

    def get_stock_risk(self, ticker: str | None = None) -> DataFrame:
        """Risk of one ticker or of all, the riskiest first."""
        x, cov, idio = self._risk("latest_exposures", "factor_cov", "idio_var")
        x = x.where(F.col("ticker") == ticker) if ticker else x
        return R.stock_risk(x, cov, idio).orderBy(F.desc("total_vol"), "ticker")

    def get_portfolio_factor_contributions(self, portfolio: str, date: str) -> DataFrame:
        x, cov = self._risk("latest_exposures", "factor_cov")
        return R.factor_contributions(self.weights_on(portfolio, date), x, cov)

    def update_risk_model(self, settings: X.FactorSettings = X.FactorSettings(), **kwargs) -> DataFrame:
        """Take in the dates that the price table has gained. States are closed forms over the dates, so a
        calibration anew and an update are the same."""
        return self.risk_calibration(settings=settings, **kwargs)

    def _regime(self, *names: str) -> list[DataFrame]:
        return list(load_model(self.spark, self.root, "regime", list(names)).values())

    def get_regime_probabilities(self, last_n: int | None = None) -> DataFrame:
        (b,) = self._regime("beliefs")
        return b if last_n is None else b.join(b.select("date").distinct().orderBy(F.desc("date")).limit(last_n), "date", "left_semi")

    def get_current_regime(self) -> DataFrame:
        """The likeliest regime of the last date."""
        last = self.get_regime_probabilities(1)
        return last.groupBy("date").agg(F.max_by("regime", "probability").alias("regime"), F.max("probability").alias("probability"))

    def get_transition_matrix(self) -> DataFrame:
        return self._regime("transitions")[0]

    def get_expected_dwell_times(self) -> DataFrame:
        return self.get_transition_matrix().where("i = j").select(F.col("i").alias("regime"), (1 / F.nullif(1 - F.col("p"), F.lit(0.0))).alias("dwell_days"))

    def get_regime_moments(self, regime: int) -> tuple[DataFrame, DataFrame]:
        """(factor, mean) and (i, j, covariance) of the next day's returns in a regime."""
        means, cov = self._regime("means", "covariances")
        return means.where(F.col("regime") == regime).drop("regime"), cov.where(F.col("regime") == regime).drop("regime")

    def update_regime_model(self, **kwargs) -> DataFrame:
        """Walk all windows anew from empty templates, which gives the same identities every time."""
        return self.regime_calibration(**kwargs)

    def weights_on(self, portfolio: str, date: str, lookback: int = 10) -> DataFrame:
        """(portfolio, ticker, weight) of the latest date with weights within ``lookback`` days."""
        rows = U.weighted(self._perf(portfolio, None, date)).where((F.col("date") >= F.date_sub(F.lit(date).cast("date"), lookback)) & F.col("w_mv").isNotNull())
        last = rows.agg(F.max("date")).first()[0]
        if last is None:
            raise AnalyticsError(f"{portfolio} has no weights within {lookback} days of {date}")
        return R.resolved_weights(rows.where(F.col("date") == F.lit(last))).select("portfolio", "ticker", "weight")

    def get_portfolio_risk(self, portfolio: str, date: str, confidence: float = 0.95, horizon_days: int = 1, portfolio_mv: float = 1.0) -> DataFrame:
        R.quantile(confidence)
        x, cov, idio = self._risk("latest_exposures", "factor_cov", "idio_var")
        return R.portfolio_risk(self.weights_on(portfolio, date), x, cov, idio, horizon_days, portfolio_mv)

    def get_portfolio_tree_risk(self, portfolio: str, date: str) -> DataFrame:
        x, cov, idio = self._risk("latest_exposures", "factor_cov", "idio_var")
        return R.euler(self.weights_on(portfolio, date), x, cov, idio)

    def get_factor_attribution(self, portfolio: str, start: str, end: str, linked: bool = True) -> DataFrame:
        """Components of the holdings return by factor, with the exposures that were known the day before; the
        window is read with a lead of 15 days."""
        lead = str(self.spark.range(1).select(F.date_sub(F.lit(start).cast("date"), 15)).first()[0])
        rows = U.weighted(self._perf(portfolio, lead, end)).where(F.col("date") >= F.lit(start).cast("date"))
        returns = U.rollup(rows, []).select("portfolio", "date", "ret_hlds")
        x, f = self._risk("used_exposures", "factor_returns")
        out = R.factor_attribution(R.resolved_weights(rows), x, f, returns)
        return R.linked_factor_attribution(out, returns) if linked else out

    # regimes

    def regime_calibration(self, window: int | None = None, refit: int = 21, k_range: tuple[int, int] = (2, 3), holdout: int = 40) -> DataFrame:
        """Fit rolling regime models on the factor returns, track their identities, keep beliefs, transitions and
        moments in the store; the beliefs."""
        (f,) = self._risk("factor_returns")
        f = G.regime_factors(f)
        z = G.causal_standardised(f).where("z is not null")
        names = sorted(r[0] for r in f.select("factor").distinct().collect())  # a model's few factors
        wide = z.groupBy("date").pivot("factor", names).agg(F.first("z")).dropna()
        series = wide.select("date", F.array(*(F.col(n) for n in names)).alias("x"))
        window = window or G.default_window(len(names), k_range[1], holdout=holdout)
        fits = G.best_order(G.fit_windows(series, window, refit, k_range, holdout=holdout)).collect()  # one row a window
        rows, trans, _ = G.track([r.asDict() for r in fits], series.orderBy("date").toPandas(), window, TemplateBook())
        beliefs = self.spark.createDataFrame(rows, "date date, regime int, probability double")
        pairs = [(i, j, float(trans[i, j])) for i in range(len(trans)) for j in range(len(trans))]
        means, cov = G.weighted_moments(beliefs, f)
        save_model(self.root, "regime", {"beliefs": beliefs, "transitions": self.spark.createDataFrame(pairs, "i int, j int, p double"), "means": means, "covariances": cov})
        return beliefs

    def get_regime_summary(self) -> DataFrame:
        """Days in which a regime is the likeliest, their share, its persistence and expected dwell."""
        m = load_model(self.spark, self.root, "regime", ["beliefs", "transitions"])
        top = m["beliefs"].groupBy("date").agg(F.max_by("regime", "probability").alias("regime"))
        days = top.groupBy("regime").agg(F.count(F.lit(1)).alias("days"))
        share = days.withColumn("share_pct", F.col("days") / F.sum("days").over(Window.partitionBy(F.lit(1))) * 100)  # one row a regime
        stay = m["transitions"].where("i = j").select(F.col("i").alias("regime"), F.col("p").alias("persistence"), (1 / F.nullif(1 - F.col("p"), F.lit(0.0))).alias("dwell_days"))
        return share.join(stay, "regime", "left")

    def construct_portfolio(self, universe: str | None, date: str, target_n: int = 50, max_weight: float = 0.05, cost_bps: float = 10.0, aversion: float = 5.0, alpha: float = 0.5) -> DataFrame:
        """Weights for the likeliest next regime: shrunk means, model covariance, costs against the current weights."""
        x, cov, idio, f = self._risk("latest_exposures", "factor_cov", "idio_var", "factor_returns")
        m = load_model(self.spark, self.root, "regime", ["beliefs", "transitions", "means"])
        last = m["beliefs"].agg(F.max("date")).first()[0]
        now = m["beliefs"].where(F.col("date") == F.lit(last)).select("regime", "probability")
        nxt = G.next_belief(now, m["transitions"]).orderBy(F.desc("probability"), "regime").first()
        prior = f.groupBy("factor").agg(F.avg("factor_return").alias("mean"))
        tilt = G.shrunk_tilt(prior, m["means"].where(F.col("regime") == nxt.regime).select("factor", "mean"), alpha)
        before = self.weights_on(universe, date, 400).select("ticker", "weight") if universe else x.select("ticker", F.lit(0.0).alias("weight")).limit(0)
        return G.construct_portfolio(x, cov, idio, tilt, before, target_n=target_n, max_weight=max_weight, cost_bps=cost_bps, aversion=aversion, hold_days=max(1.0, nxt.dwell_days or 1.0))
