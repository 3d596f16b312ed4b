"""Regimes of factor returns, and portfolio construction on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.hmm import GaussianHmm, TemplateBook, construct_weights, fit_best, n_parameters


def regime_factors(factor_returns: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The factors that regimes are made of: the named ones, or all but sectors."""
    return factor_returns.where(F.col("factor").isin(names) if names else ~F.col("factor").startswith("sector_"))


def default_window(d: int, k_max: int, kind: str = "diag", holdout: int = 40, multiple: float = 3.0) -> int:
    return holdout + math.ceil(multiple * n_parameters(d, k_max, kind)) + 20


def causal_standardised(factor_returns: DataFrame, halflife: float = 63.0, least: int = 20) -> DataFrame:
    """Returns over their exponentially weighted deviation up to the same day, by factor.

    One factor's series is one group, bounded by the number of dates.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        sd = pdf["factor_return"].ewm(halflife=halflife, min_periods=least).std()
        return pdf.assign(z=(pdf["factor_return"] / sd).where(sd > 0))[["date", "factor", "z"]]

    return factor_returns.select("date", "factor", "factor_return").groupBy("factor").applyInPandas(one, "date date, factor string, z double")


def fit_windows(series: DataFrame, window: int, refit: int, k_range: tuple[int, int] = (2, 3), kind: str = "diag", holdout: int = 40) -> DataFrame:
    """(window_id, k, score, model): a model for each rolling window and order, fitted in parallel.

    ``series`` has (date, x array<double>), one row a date. A window's rows are copied to each
    order; a fit is one task, independent of all others.
    """
    ordered = series.select(F.row_number().over(Window.orderBy("date")).alias("i"), "date", "x")
    n = ordered.count()
    if n < window:
        raise ValueError(f"{n} dates are fewer than the window of {window}")
    ends = list(range(window, n + 1, refit))
    spans = series.sparkSession.createDataFrame([(w, e - window + 1, e, k) for w, e in enumerate(ends) for k in range(k_range[0], k_range[1] + 1)], "window_id int, lo int, hi int, k int")
    rows = ordered.join(F.broadcast(spans), (F.col("i") >= F.col("lo")) & (F.col("i") <= F.col("hi")))  # a few rows a refit

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x, k = np.stack(pdf["x"].to_numpy()), int(pdf["k"].iloc[0])
        _, head = fit_best(x[:-holdout], k, kind)
        score = head.one_step_ahead(x[:-holdout], x[-holdout:])
        _, m = fit_best(x, k, kind)
        flat = np.concatenate([m.start, m.trans.ravel(), m.means.ravel(), m.covs.ravel()])
        return pd.DataFrame({"window_id": [pdf["window_id"].iloc[0]], "k": [k], "score": [score], "last_date": [pdf["date"].iloc[-1]], "model": [flat.tolist()]})

    return rows.groupBy("window_id", "k").applyInPandas(fit, "window_id int, k int, score double, last_date date, model array<double>")


def best_order(fits: DataFrame) -> DataFrame:
    """The order of each window with the best score on its holdout."""
    return fits.groupBy("window_id").agg(F.max_by(F.struct("k", "score", "last_date", "model"), F.struct("score", -F.col("k"))).alias("b")).select("window_id", "b.*")


def unpack_model(flat: list[float], k: int) -> GaussianHmm:
    a = np.asarray(flat)
    d = int(round((-1 + math.sqrt(1 + 4 * (len(a) - k - k * k) / k)) / 2))
    m = GaussianHmm(k)
    m.start, a = a[:k], a[k:]
    m.trans, a = a[: k * k].reshape(k, k), a[k * k :]
    m.means, a = a[: k * d].reshape(k, d), a[k * d :]
    m.covs = a.reshape(k, d, d)
    return m


def track(fits: list, series: pd.DataFrame, window: int, book: TemplateBook | None = None):
    """Walk the windows in order: persistent ids, filtered probabilities of new days, last transitions.

    The first window commits its last day, later ones the days after the window before. ``series`` is the
    bounded driver copy (date, x) of factor returns. Returns (rows of (date, regime, probability), transition
    matrix in persistent ids, ids of the last window's states).
    """
    book = book or TemplateBook()
    rows, done, trans, ids = [], None, None, []
    for f in sorted(fits, key=lambda r: r["window_id"]):
        m = unpack_model(f["model"], f["k"])
        ids = book.match(m.means, m.covs)
        part = series[series["date"] <= f["last_date"]].tail(window)
        p = m.filtered(np.stack(part["x"].to_numpy()))
        for date, row in zip(part["date"], p, strict=True):
            if (done is None and date == part["date"].iloc[-1]) or (done is not None and date > done):
                by: dict[int, float] = {}
                for i, v in zip(ids, row, strict=True):
                    by[i] = by.get(i, 0.0) + float(v)
                rows += [(date, i, v) for i, v in by.items()]
        done = f["last_date"]
        n = len(book.means)
        trans = np.zeros((n, n))
        for a, i in enumerate(ids):
            for b, j in enumerate(ids):
                trans[i, j] += m.trans[a, b]
        total = trans.sum(axis=1, keepdims=True)
        trans = np.divide(trans, total, out=np.zeros_like(trans), where=total > 0)
    return rows, trans, ids


def weighted_moments(beliefs: DataFrame, factor_returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((regime, factor, mean), (regime, i, j, covariance)) of the next day's returns, weighted by belief.

    ``beliefs`` is (date, regime, probability).
    """
    w = Window.partitionBy("factor").orderBy("date")
    nxt = factor_returns.select("date", "factor", F.lead("factor_return").over(w).alias("r")).where("r is not null")
    both = beliefs.join(nxt, "date")
    means = both.groupBy("regime", "factor").agg((F.sum(F.col("probability") * F.col("r")) / F.nullif(F.sum("probability"), F.lit(0.0))).alias("mean"))
    dev = both.join(means, ["regime", "factor"]).select("date", "regime", "probability", "factor", (F.col("r") - F.col("mean")).alias("d"))
    a = dev.select("date", "regime", "probability", F.col("factor").alias("i"), F.col("d").alias("_a"))
    b = dev.select("date", "regime", F.col("factor").alias("j"), F.col("d").alias("_b"))
    cov = a.join(b, ["date", "regime"]).groupBy("regime", "i", "j").agg((F.sum(F.col("probability") * F.col("_a") * F.col("_b")) / F.nullif(F.sum("probability"), F.lit(0.0))).alias("covariance"))
    return means, cov


def next_belief(belief: DataFrame, transitions: DataFrame) -> DataFrame:
    """(regime, probability, dwell_days) of the next day: belief times transitions (i, j, p)."""
    out = belief.join(transitions, belief.regime == transitions.i).groupBy(F.col("j").alias("regime")).agg(F.sum(F.col("probability") * F.col("p")).alias("probability"))
    stay = transitions.where("i = j").select(F.col("i").alias("regime"), (1 / F.nullif(1 - F.col("p"), F.lit(0.0))).alias("dwell_days"))
    return out.join(stay, "regime", "left")


def wasserstein_diagonal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_id, right_id, distance) between diagonal normals in long form (id, factor, mean, sd);
    sides are regimes, a few rows each."""
    left = a.select(F.col("id").alias("left_id"), "factor", F.col("mean").alias("m1"), F.col("sd").alias("s1"))
    right = b.select(F.col("id").alias("right_id"), "factor", F.col("mean").alias("m2"), F.col("sd").alias("s2"))
    d = F.pow(F.col("m1") - F.col("m2"), 2) + F.pow(F.col("s1") - F.col("s2"), 2)
    return left.join(right, "factor").groupBy("left_id", "right_id").agg(F.sqrt(F.sum(d)).alias("distance"))


def shrunk_tilt(prior: DataFrame, regime: DataFrame, alpha: float) -> DataFrame:
    """(factor, mean): prior + alpha (regime - prior); sector factors have a prior of 0."""
    p = prior.select("factor", F.when(F.col("factor").startswith("sector_"), 0.0).otherwise(F.col("mean")).alias("_p"))
    return regime.join(p, "factor", "left").select("factor", (F.coalesce("_p", F.lit(0.0)) + alpha * (F.col("mean") - F.coalesce("_p", F.lit(0.0)))).alias("mean"))


def top_names(scores: DataFrame, n: int) -> DataFrame:
    """The n best by information ratio, ties by ticker."""
    return scores.orderBy(F.desc("information_ratio"), "ticker").limit(n)


def construct_portfolio(exposures: DataFrame, cov: DataFrame, idio: DataFrame, means: DataFrame, before: DataFrame, *, target_n: int = 100, max_weight: float = 0.05, cost_bps: float = 10.0, aversion: float = 5.0, hold_days: float = 20.0) -> DataFrame:
    """(ticker, weight) of the chosen names.

    The best ``target_n`` names by expected return over volatility come to the driver, where a dense matrix of them
    is solved; everything before that is joins and sums.
    """
    spark = exposures.sparkSession
    mu = exposures.join(means, "factor").groupBy("ticker").agg(F.sum(F.col("x") * F.col("mean")).alias("mu"))
    half = exposures.join(cov, exposures.factor == cov.i).select("ticker", "x", F.col("j").alias("factor2"), "covariance")
    var = half.join(exposures.select("ticker", F.col("factor").alias("factor2"), F.col("x").alias("x2")), ["ticker", "factor2"]).groupBy("ticker").agg(F.sum(F.col("x") * F.col("covariance") * F.col("x2")).alias("fv"))
    scores = mu.join(var, "ticker").join(idio, "ticker", "left").join(before, "ticker", "left").select("ticker", "mu", F.coalesce("idio_var", F.lit(0.0)).alias("idio_var"), F.coalesce("weight", F.lit(0.0)).alias("before"), (F.col("mu") / F.sqrt(F.greatest(F.col("fv") + F.coalesce("idio_var", F.lit(0.0)), F.lit(1e-12)))).alias("information_ratio"))
    names = top_names(scores, target_n).toPandas()
    x = exposures.join(F.broadcast(spark.createDataFrame([(t,) for t in names["ticker"]], exposures.select("ticker").schema)), "ticker").toPandas().pivot(index="ticker", columns="factor", values="x").reindex(names["ticker"]).fillna(0.0)
    f = cov.toPandas().pivot(index="i", columns="j", values="covariance").reindex(index=x.columns, columns=x.columns).fillna(0.0)
    full = x.to_numpy() @ f.to_numpy() @ x.to_numpy().T + np.diag(names["idio_var"].to_numpy())
    w = construct_weights(names["mu"].to_numpy(), full, names["before"].to_numpy(), max_weight, cost_bps / 1e4, aversion, hold_days)
    return spark.createDataFrame(pd.DataFrame({"ticker": names["ticker"], "weight": w}))
