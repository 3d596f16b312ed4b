"""Factor exposures of a price and volume panel (date, ticker, close, volume)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import ieee_ratio, ratio
from tallyfield.operators.fundamentals import asof_quarters, latest_values, trailing_sums


@dataclass(frozen=True)
class FactorSettings:
    """Windows in rows of a ticker's series, limits and half-lives of the risk model."""

    momentum: int = 252
    momentum_skip: int = 21
    low_vol: int = 252
    reversal: int = 21
    liquidity: int = 20
    winsor: float = 3.0
    min_history: int = 252
    min_stocks: int = 50
    report_lag_days: int = 45
    covariance_halflife: float = 63.0
    idio_halflife: float = 21.0
    periods: int = 252


def daily_returns(panel: DataFrame, bound: float = 0.5) -> DataFrame:
    """Simple returns against the ticker's row before, those within the bound only: none against a price of 0."""
    w = Window.partitionBy("ticker").orderBy("date")
    out = panel.withColumn("ret", ratio(F.col("close"), F.lag("close").over(w)) - 1)
    return out.where(F.col("ret").between(-bound, bound)).select("date", "ticker", "ret")


PRICE_FACTORS = ("momentum", "low_vol", "reversal", "liquidity")
VALUE_FACTORS = ("size", "value_ep", "value_bp", "quality_roe", "quality_gm")


def price_factors(panel: DataFrame, s: FactorSettings = FactorSettings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """momentum, low_vol, reversal and liquidity as of each date, where history suffices, and the panel's
    columns ``keep``. What divides by a price of 0, or is the log of one, is infinite or NaN."""
    w = Window.partitionBy("ticker").orderBy("date")
    rows = panel.withColumns({"_r": ieee_ratio(F.col("close"), F.lag("close").over(w)) - 1, "_n": F.row_number().over(w)})
    past = lambda n: F.lag("close", n).over(w)
    traded = F.avg(F.col("close") * F.col("volume")).over(w.rowsBetween(-(s.liquidity - 1), 0))
    return rows.select(
        "date", "ticker", "_n", *keep,
        (ieee_ratio(past(s.momentum_skip), past(s.momentum - 1)) - 1).alias("momentum"),
        F.when(F.col("_n") > s.low_vol, -F.stddev_samp("_r").over(w.rowsBetween(-(s.low_vol - 1), 0)) * (s.periods**0.5)).alias("low_vol"),
        (-(ieee_ratio(F.col("close"), past(s.reversal)) - 1)).alias("reversal"),
        F.when(F.col("_n") >= s.liquidity, F.when(traded == 0, float("-inf")).otherwise(F.ln(traded))).alias("liquidity"),
    ).where(F.col("_n") >= s.min_history).drop("_n")


def value_factors(rows: DataFrame) -> DataFrame:
    """size, earnings and book yield, return on equity and gross margin; null on unusable inputs."""
    cap = F.col("price") * F.col("shares")
    good = F.when(F.col("equity") > 0, F.col("equity"))
    return rows.withColumns({
        "size": F.ln(F.when(cap > 0, cap)), "value_ep": ratio(F.col("net_income"), cap), "value_bp": ratio(F.col("equity"), cap),
        "quality_roe": ratio(F.col("net_income"), good), "quality_gm": ratio(F.col("gross_profit"), F.col("revenue")),
    })


def winsor_z(rows: DataFrame, columns: list[str], limit: float = 3.0, least: int = 5, by: str = "date") -> DataFrame:
    """Cross-sectional z-scores after clipping at ``limit`` deviations; dates with fewer than ``least``
    values or no deviation, and missing values, give 0."""
    day = Window.partitionBy(by)
    clip = {}
    for c in columns:
        m, sd = F.avg(c).over(day), F.stddev_samp(c).over(day)
        clip[f"_{c}"] = F.when(sd.isNotNull(), F.greatest(F.least(F.col(c), m + limit * sd), m - limit * sd)).otherwise(F.col(c))
    rows = rows.withColumns({**{f"_n_{c}": F.count(c).over(day) for c in columns}, **clip})
    rows = rows.withColumns({f"_{c}": F.when(F.col(c).isNotNull(), F.col(f"_{c}")) for c in columns})
    z = {}
    for c in columns:
        m, sd = F.avg(f"_{c}").over(day), F.stddev_samp(f"_{c}").over(day)
        z[c] = F.when((F.col(f"_n_{c}") >= least) & (sd > 0) & F.col(c).isNotNull(), (F.col(f"_{c}") - m) / sd).otherwise(0.0)
    return rows.withColumns(z).drop(*(f"_{c}" for c in columns), *(f"_n_{c}" for c in columns))


def sector_dummies(rows: DataFrame, sectors: list[str], column: str = "sector") -> DataFrame:
    """A 0 / 1 column for each sector but the first in order."""
    return rows.withColumns({f"sector_{s}": F.when(F.col(column) == s, 1.0).otherwise(0.0) for s in sorted(sectors)[1:]})


def exposure_panel(panel: DataFrame, s: FactorSettings = FactorSettings(), statements: DataFrame | None = None, sectors: DataFrame | None = None, names: list[str] = (), ieee: bool = False) -> tuple[DataFrame, list[str]]:
    """(date, ticker, cap, factors...) and the factors' names: price factors, with ``statements`` size, value
    and quality too, all as clipped z-scores, and a dummy for each sector of ``names`` but the first.

    ``statements`` (ticker, period_end, net_income, revenue, gross_profit, equity, shares) count from
    ``report_lag_days`` after a period's end; flows are trailing sums of four quarters. ``sectors`` is
    (ticker, sector). The set of factors is the same on every date. cap is null without shares. A price factor
    that isn't finite, because of a price of 0, is missing; with ``ieee`` it stays, and so makes the
    scores of its date NaN.
    """
    rows = price_factors(panel, s, ("close",)).withColumnRenamed("close", "price")
    if not ieee:
        rows = rows.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in PRICE_FACTORS})
    styles = list(PRICE_FACTORS)
    if statements is not None:
        quarters = asof_quarters(rows.select("ticker", "date"), statements, s.report_lag_days)
        flows = trailing_sums(quarters, ["net_income", "revenue", "gross_profit"]).select("ticker", "date", *(F.col(f"{c}_ttm").alias(c) for c in ("net_income", "revenue", "gross_profit")))
        stocks = latest_values(quarters, {"equity": ["equity"], "shares": ["shares"]})
        rows = value_factors(rows.join(flows, ["ticker", "date"], "left").join(stocks, ["ticker", "date"], "left"))
        rows = rows.withColumn("cap", F.col("price") * F.col("shares"))
        styles += VALUE_FACTORS
    else:
        rows = rows.withColumn("cap", F.lit(None).cast("double"))
    z = winsor_z(rows.select("date", "ticker", "cap", *styles), styles, s.winsor)
    if sectors is None:
        return z, styles
    z = sector_dummies(z.join(sectors.select("ticker", "sector"), "ticker", "left"), names).drop("sector")
    return z, [*styles, *(f"sector_{n}" for n in sorted(names)[1:])]


def previous_exposures(exposures: DataFrame, returns: DataFrame) -> DataFrame:
    """Returns of a date with exposures as of the panel's date before: no look ahead."""
    days = returns.select("date").distinct()
    # one row a trading day: as many rows as dates, so one task may order them
    chain = days.withColumn("_before", F.lag("date").over(Window.orderBy("date")))
    x = exposures.withColumnRenamed("date", "_before")
    return returns.join(chain, "date").join(x, ["_before", "ticker"]).drop("_before")
