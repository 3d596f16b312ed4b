"""Cross-sectional regression, covariances, decomposition and factor attribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import ratio
from tallyfield.operators.linking import link_split

#: One-sided normal quantiles of the ex-ante measure.
Z_EX_ANTE = {0.95: 1.6449, 0.99: 2.3263}


def decay(halflife: float) -> float:
    return 0.5 ** (1 / halflife)


def wls_single(rows: DataFrame, x: str, weight: str | None = None, least: int = 20) -> DataFrame:
    """Closed form of one factor's return per date, weighted by ``weight`` (none: equal)."""
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.groupBy("date").agg(ratio(F.sum(w * F.col(x) * F.col("ret")), F.sum(w * F.col(x) * F.col(x))).alias("factor_return"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")


def wls_kernel(y: np.ndarray, x: np.ndarray, w: np.ndarray):
    """Factor returns, residuals, weighted R squared and t statistics of one date."""
    root = np.sqrt(w)
    f, *_ = np.linalg.lstsq(x * root[:, None], y * root, rcond=None)
    e = y - x @ f
    mean = (w * y).sum() / w.sum()
    total = (w * (y - mean) ** 2).sum()
    r2 = 1 - (w * e**2).sum() / total if total > 0 else 0.0
    var = np.diag(np.linalg.pinv(x.T @ x)) * (e**2).mean()
    t = np.divide(f, np.sqrt(var), out=np.zeros_like(f), where=var > 0)
    return f, e, float(r2), t


def wls_multi(rows: DataFrame, factors: list[str], cap: str | None = None, scheme: str = "sqrt_mktcap", least: int = 20, ieee: bool = False) -> DataFrame:
    """(date, factor, factor_return, t_stat, r2) from one regression per date, in Arrow batches.

    A date is one cross section, bounded by the number of instruments. Rows with a missing value and
    dates with fewer than ``least`` rows are left out. ``scheme``: sqrt_mktcap, mktcap or equal; a missing
    or non-positive ``cap`` counts as the date's median, and all are equal where none is usable. With ``ieee``
    rows whose values are NaN or infinite stay, and the results of their date are NaN.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        finite = np.isfinite(pdf[["ret", *factors]].to_numpy(float)).all(axis=1)
        if ieee and not finite.all() and len(pdf) >= least:
            return pd.DataFrame({"date": pdf["date"].iloc[0], "factor": factors, "factor_return": np.nan, "t_stat": np.nan, "r2": np.nan})
        pdf = pdf[finite]
        if len(pdf) < max(least, len(factors)):
            return pd.DataFrame({"date": pd.Series(dtype=object), "factor": pd.Series(dtype=str), "factor_return": [], "t_stat": [], "r2": []})
        size = pdf[cap].to_numpy(float) if cap else np.ones(len(pdf))
        good = np.isfinite(size) & (size > 0)
        size = np.where(good, size, np.median(size[good]) if good.any() else 1.0)
        w = {"sqrt_mktcap": np.sqrt(size), "mktcap": size}.get(scheme, np.ones(len(pdf)))
        f, _, r2, t = wls_kernel(pdf["ret"].to_numpy(float), pdf[factors].to_numpy(float), w)
        return pd.DataFrame({"date": pdf["date"].iloc[0], "factor": factors, "factor_return": f, "t_stat": t, "r2": r2})

    columns = list(dict.fromkeys(["date", "ret", *factors, *([cap] if cap else [])]))
    if ieee:
        # pandas can't tell a null from NaN
        rows = rows.where(" and ".join(f"`{c}` is not null" for c in ["ret", *factors]))
    out = rows.select(*columns).groupBy("date").applyInPandas(one, "date date, factor string, factor_return double, t_stat double, r2 double")
    return out.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("factor_return", "t_stat", "r2")}) if ieee else out


def ewma_covariance(factor_returns: DataFrame, halflife: float = 63.0) -> DataFrame:
    """(i, j, covariance) of the last state of F1 = diag(f1^2), Ft = l F + (1 - l) f f'.

    The recursion's last state is a weighted sum, so it needs no ordered pass: the age of a date is
    all a term depends on. ``factor_returns`` has (date, factor, factor_return).
    """
    lam = decay(halflife)
    days = factor_returns.select("date").distinct()
    order = Window.orderBy("date")  # one row a date
    aged = days.withColumns({"_i": F.row_number().over(order)})
    n = aged.agg(F.max("_i").alias("_n"))
    f = factor_returns.join(aged.crossJoin(F.broadcast(n)), "date")  # n is one row
    a = f.select("date", "_i", "_n", F.col("factor").alias("i"), F.col("factor_return").alias("_a"))
    b = f.select("date", F.col("factor").alias("j"), F.col("factor_return").alias("_b"))
    age = F.col("_n") - F.col("_i")
    first = F.when(F.col("i") == F.col("j"), F.pow(F.lit(lam), age) * F.col("_a") * F.col("_b")).otherwise(0.0)
    term = F.when(F.col("_i") == 1, first).otherwise((1 - lam) * F.pow(F.lit(lam), age) * F.col("_a") * F.col("_b"))
    return a.join(b, "date").groupBy("i", "j").agg(F.sum(term).alias("covariance"))


def ewma_idio(residuals: DataFrame, halflife: float = 21.0) -> DataFrame:
    """(ticker, idio_var) of the last state, the ticker's first squared residual being the start."""
    lam = decay(halflife)
    w = Window.partitionBy("ticker").orderBy("date")
    rows = residuals.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    weight = F.when(F.col("_i") == 1, F.pow(F.lit(lam), F.col("_n") - 1)).otherwise((1 - lam) * F.pow(F.lit(lam), F.col("_n") - F.col("_i")))
    return rows.groupBy("ticker").agg(F.sum(weight * F.col("residual") * F.col("residual")).alias("idio_var"))


def correlation(cov: DataFrame) -> DataFrame:
    d = cov.where("i = j").select("i", F.col("covariance").alias("_v"))
    out = cov.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("_v").alias("_u")), "j")
    return out.select("i", "j", ratio(F.col("covariance"), F.sqrt(F.col("_v") * F.col("_u"))).alias("correlation"))


def _annual(v, periods=252):
    return F.sqrt(F.greatest(v, F.lit(0.0)) * periods) * 100


def stock_risk(exposures: DataFrame, cov: DataFrame, idio: DataFrame) -> DataFrame:
    """Factor, specific and total annual volatility in percent of each ticker, and the factors' share.

    ``exposures`` is long: (ticker, factor, x). The covariance, one row a pair of factors, joins by
    factor; sums are partial before the shuffle.
    """
    half = exposures.join(cov, exposures.factor == cov.i).select("ticker", "x", F.col("j").alias("factor2"), "covariance")
    other = exposures.select("ticker", F.col("factor").alias("factor2"), F.col("x").alias("x2"))
    var = half.join(other, ["ticker", "factor2"]).groupBy("ticker").agg(F.sum(F.col("x") * F.col("covariance") * F.col("x2")).alias("_f"))
    out = var.join(idio, "ticker", "left").withColumn("_d", F.coalesce("idio_var", F.lit(0.0)))
    return out.select("ticker", _annual(F.col("_f")).alias("factor_vol"), _annual(F.col("_d")).alias("idio_vol"), _annual(F.col("_f") + F.col("_d")).alias("total_vol"), (ratio(F.col("_f"), F.col("_f") + F.col("_d")) * 100).alias("factor_share"))


def portfolio_betas(weights: DataFrame, exposures: DataFrame) -> DataFrame:
    return weights.join(exposures, "ticker").groupBy("portfolio", "factor").agg(F.sum(F.col("weight") * F.col("x")).alias("beta"))


def factor_contributions(weights: DataFrame, exposures: DataFrame, cov: DataFrame) -> DataFrame:
    """(portfolio, factor, beta, variance): beta_k (F beta)_k."""
    b = portfolio_betas(weights, exposures)
    left = b.select("portfolio", F.col("factor").alias("i"), "beta")
    right = b.select("portfolio", F.col("factor").alias("j"), F.col("beta").alias("_b2"))
    both = left.join(cov, "i").join(right, ["portfolio", "j"])
    return both.groupBy("portfolio", F.col("i").alias("factor")).agg(F.max("beta").alias("beta"), F.sum(F.col("beta") * F.col("covariance") * F.col("_b2")).alias("variance"))


def portfolio_risk(weights: DataFrame, exposures: DataFrame, cov: DataFrame, idio: DataFrame, horizon_days: int = 1, value: float = 1e6) -> DataFrame:
    """One row per portfolio: daily variances, annual volatilities and value at risk.

    ``weights`` is (portfolio, ticker, weight). Idiosyncratic variances that are missing count as 0.
    """
    parts = factor_contributions(weights, exposures, cov).groupBy("portfolio").agg(F.sum("variance").alias("factor_var"))
    own = weights.join(exposures.select("ticker").distinct(), "ticker", "left_semi").join(idio, "ticker", "left")
    own = own.groupBy("portfolio").agg(F.sum(F.col("weight") * F.col("weight") * F.coalesce("idio_var", F.lit(0.0))).alias("idio_var"))
    out = parts.join(own, "portfolio").withColumn("total_var", F.col("factor_var") + F.col("idio_var"))
    sigma = F.sqrt(F.greatest("total_var", F.lit(0.0))) * (horizon_days**0.5)
    vols = {"factor_vol": _annual(F.col("factor_var")), "idio_vol": _annual(F.col("idio_var")), "total_vol": _annual(F.col("total_var"))}
    return out.withColumns(vols | {f"var_{round(c * 100)}": sigma * z * value for c, z in Z_EX_ANTE.items()})


def quantile(confidence: float) -> float:
    if confidence not in Z_EX_ANTE:
        raise ValueError(f"confidence must be one of {sorted(Z_EX_ANTE)}")
    return Z_EX_ANTE[confidence]


def euler(weights: DataFrame, exposures: DataFrame, cov: DataFrame, idio: DataFrame) -> DataFrame:
    """Risk contributions of securities, in percent of variance and of annual volatility, and a
    summary row (ticker null) of the sums."""
    b = portfolio_betas(weights, exposures)
    fb = b.join(cov, b.factor == cov.j).groupBy("portfolio", F.col("i").alias("factor")).agg(F.sum(F.col("covariance") * F.col("beta")).alias("_fb"))
    marginal = weights.join(exposures, "ticker").join(fb, ["portfolio", "factor"]).groupBy("portfolio", "ticker").agg(F.max("weight").alias("weight"), F.sum(F.col("x") * F.col("_fb")).alias("_m"))
    rows = marginal.join(idio, "ticker", "left")
    rows = rows.withColumn("_c", F.col("weight") * (F.col("_m") + F.coalesce("idio_var", F.lit(0.0)) * F.col("weight")))
    total = rows.groupBy("portfolio").agg(F.sum("_c").alias("_v"))
    rows = rows.join(total, "portfolio")
    rows = rows.select("portfolio", "ticker", "weight", (ratio(F.col("_c"), F.col("_v")) * 100).alias("rc_pct"), (ratio(F.col("_c"), F.sqrt("_v")) * (252**0.5) * 100).alias("rc_vol"))
    summary = rows.groupBy("portfolio").agg(F.sum("weight").alias("weight"), F.sum("rc_pct").alias("rc_pct"), F.sum("rc_vol").alias("rc_vol"))
    return rows.unionByName(summary, allowMissingColumns=True)


def factor_summary(factor_returns: DataFrame, periods: int = 252) -> DataFrame:
    """Annual mean and deviation in percent, ratio, extremes, t statistics and flags by factor."""
    f, t = F.col("factor_return"), F.col("t_stat")
    out = factor_returns.groupBy("factor").agg(
        (F.avg(f) * periods * 100).alias("mean"), (F.stddev_samp(f) * (periods**0.5) * 100).alias("std"), F.min(f).alias("min"), F.max(f).alias("max"),
        F.avg(t).alias("avg_t"), F.avg(F.abs(t)).alias("avg_abs_t"), (F.avg((F.abs(t) > 2).cast("double")) * 100).alias("significant_pct"), F.product(1 + f).alias("cumulative"),
    )
    out = out.withColumn("sharpe", ratio(F.col("mean"), F.col("std")))
    return out.withColumns({"implausible_sharpe": F.abs("sharpe") > 4, "implausible_t": F.abs("avg_t") > 1.5})


def factor_attribution(weights: DataFrame, exposures: DataFrame, factor_returns: DataFrame, portfolio_returns: DataFrame) -> DataFrame:
    """(portfolio, date, factor, component): factors' parts of the holdings return, their total and the
    excess over it, in long form.

    ``weights`` is (portfolio, date, ticker, weight), ``exposures`` (date, ticker, factor, x),
    ``portfolio_returns`` (portfolio, date, ret_hlds, 1-based). Where a return is missing it counts as flat. A
    portfolio's first date has no component.
    """
    beta = weights.join(exposures, ["date", "ticker"]).groupBy("portfolio", "date", "factor").agg(F.sum(F.col("weight") * F.col("x")).alias("_b"))
    parts = beta.join(factor_returns.select("date", "factor", "factor_return"), ["date", "factor"])
    parts = parts.select("portfolio", "date", "factor", (F.col("_b") * F.col("factor_return")).alias("component"))
    start = parts.groupBy("portfolio").agg(F.min("date").alias("_start"))
    parts = parts.join(start, "portfolio").withColumn("component", F.when(F.col("date") == F.col("_start"), 0.0).otherwise(F.col("component")))
    total = parts.groupBy("portfolio", "date").agg(F.sum("component").alias("component"), F.max("_start").alias("_start"))
    excess = total.join(portfolio_returns.select("portfolio", "date", "ret_hlds"), ["portfolio", "date"], "left")
    excess = excess.select("portfolio", "date", F.lit("excess").alias("factor"), F.when(F.col("date") == F.col("_start"), 0.0).otherwise(F.coalesce("ret_hlds", F.lit(1.0)) - 1 - F.col("component")).alias("component"))
    return parts.drop("_start").unionByName(total.select("portfolio", "date", F.lit("total").alias("factor"), "component")).unionByName(excess)


def linked_factor_attribution(attribution: DataFrame, portfolio_returns: DataFrame) -> DataFrame:
    """acc_component: components linked over time so that factors and excess add up to the compounded return."""
    rows = attribution.join(portfolio_returns.select("portfolio", "date", "ret_hlds"), ["portfolio", "date"], "left")
    rows = rows.withColumns({"_part": F.col("component") + 1, "_total": F.coalesce("ret_hlds", F.lit(1.0))})
    out = link_split(rows, ["portfolio", "factor"], "_total", ["_part"])
    return out.select("portfolio", "date", "factor", "component", (F.col("acc__part") - 1).alias("acc_component"))


def resolved_weights(holdings: DataFrame) -> DataFrame:
    """(portfolio, date, ticker, weight): basis weights where they sum to something on the date, else
    market weights, else equal ones."""
    day = Window.partitionBy("portfolio", "date")
    rows = holdings.withColumns({"_b": F.sum("w_pos").over(day), "_m": F.sum("w_mv").over(day), "_n": F.count(F.lit(1)).over(day)})
    w = F.when(F.abs("_b") > 1e-12, F.col("w_pos")).when(F.abs("_m") > 1e-12, F.col("w_mv") / 100).otherwise(1 / F.col("_n"))
    return rows.withColumn("_w", F.coalesce(w, F.lit(0.0))).groupBy("portfolio", "date", "ticker").agg(F.sum("_w").alias("weight"))
