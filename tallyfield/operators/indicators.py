"""Ex-post indicators of return series; rows are counted by series, as-of each date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import carino_k, ratio, so_far

#: Rows before the current one that a horizon reaches back.
HORIZONS = {"1d": 0, "1w": 7, "1m": 30, "1q": 90, "1y": 365}
#: Normal quantiles of the ex-post measure.
Z_EX_POST = {"95": 1.64485, "99": 2.33}


def trailing_returns(rows: DataFrame, keys: list[str], ret: str = "ret") -> DataFrame:
    """Compounded return of each horizon in percent; null until the series is long enough."""
    w = Window.partitionBy(*keys).orderBy("date")
    rows = rows.withColumn("_n", F.row_number().over(w))
    return rows.withColumns({f"ret_{h}": F.when(F.col("_n") > n, (F.product(ret).over(w.rowsBetween(-n, 0)) - 1) * 100) for h, n in HORIZONS.items()}).drop("_n")


def trailing_local(rows: DataFrame, keys: list[str], ret: str = "ret", local: str = "ret_lcl") -> DataFrame:
    """The local part of each horizon's return in percent, linked within the horizon."""
    w = Window.partitionBy(*keys).orderBy("date")
    rows = rows.withColumns({"_n": F.row_number().over(w), "_k": carino_k(F.col(ret))})
    rows = rows.withColumn("_ks", F.col("_k") * (F.col(local) - 1))
    out = {}
    for h, n in HORIZONS.items():
        frame = w.rowsBetween(-n, 0)
        out[f"ret_{h}_lcl"] = F.when(F.col("_n") > n, F.sum("_ks").over(frame) / carino_k(F.product(ret).over(frame)) * 100)
    return rows.withColumns(out).drop("_n", "_k", "_ks")


def spread(rows: DataFrame, keys: list[str], ret: str = "ret", local: str = "ret_lcl", rf: float = 0.01, periods: int = 252, compat: bool = False) -> DataFrame:
    """Expanding deviation, mean, skewness, value at risk, Sharpe ratio and downside risk.

    The corrected forms are the default: deviations of local returns use local returns, downside risk
    takes days below zero, and the Sharpe ratio is on excess daily returns, annualised. ``compat``
    gives the uncorrected Sharpe and downside forms.
    """
    e = so_far(Window.partitionBy(*keys).orderBy("date"))
    x = F.col(ret) - 1
    log = F.ln(F.when(F.col(ret) > 0, F.col(ret)).otherwise(1.0))
    below = F.when((F.col(ret) < 0) if compat else (x < 0), F.col(ret) if compat else x)
    excess = (F.avg(ret).over(e) - 0.01) * (periods**0.5) if compat else (F.avg(x).over(e) - rf / periods) * (periods**0.5)
    out = {
        "std_dev": F.stddev_pop(x).over(e) * 100, "std_dev_lcl": F.stddev_pop(F.col(local) - 1).over(e) * 100,
        "mean_ret": F.avg(x).over(e) * 100, "skew": F.skewness(x).over(e),
        "sharpe": ratio(excess, F.stddev_pop(x).over(e)), "downside": F.stddev_pop(below).over(e) * (periods**0.5),
    }
    for name, z in Z_EX_POST.items():
        out[f"var_{name}"] = (1 - F.exp(F.avg(log).over(e) - z * F.stddev_pop(log).over(e))) * 100
    return rows.withColumns(out)


def tracking(rows: DataFrame, benchmark: DataFrame, keys: list[str], ret: str = "ret", periods: int = 252) -> DataFrame:
    """Tracking error and beta of each series against the benchmark on common dates, whole sample.

    ``benchmark`` has (date, bench_ret), one row a date.
    """
    both = rows.join(benchmark, "date")
    p, b = F.col(ret) - 1, F.col("bench_ret") - 1
    return both.groupBy(*keys).agg(
        (F.stddev_pop(p - b) * (periods**0.5)).alias("tracking_error"), ratio(F.covar_samp(p, b), F.var_samp(b)).alias("beta"), F.count(F.lit(1)).alias("n_days")
    )
