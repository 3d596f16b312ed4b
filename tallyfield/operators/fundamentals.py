"""Point-in-time fundamentals and the characteristics made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import ratio

#: Statement names as ``<name>_TTM`` and ``<name>_YOY``; the catalogue of characteristics is made of these.
BASE_FIELDS = ("pe", "pcf", "eps", "avg_shares", "market_cap", "net_income", "dividend_yield")
ESTIMATE_PERIODS = ("0q", "+1q", "0y", "+1y", "LTG")


def asof_quarters(dates: DataFrame, statements: DataFrame, lag_days: int = 45, newest: int = 8) -> DataFrame:
    """For each (ticker, date) the newest reports whose period ended ``lag_days`` before the date.

    ``statements`` is wide: (ticker, period_end, fields). Reports are numbered by ticker; one window over
    dates and reports together says how many were out by a date, and the newest of them join by number, so a
    date meets ``newest`` reports at most, however long the history is.
    """
    ranked = statements.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy("period_end")))
    moments = dates.select("ticker", "date", F.date_sub("date", lag_days).alias("_at"), F.lit(None).cast("int").alias("_n")).unionByName(
        ranked.select("ticker", F.lit(None).cast("date").alias("date"), F.col("period_end").alias("_at"), "_n")
    )
    # a report of the same day is out
    out = Window.partitionBy("ticker").orderBy("_at", F.col("_n").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = moments.withColumn("_out", F.max("_n").over(out)).where("date is not null and _out is not null")
    wanted = known.select("ticker", "date", "_out", F.explode(F.sequence(F.greatest(F.col("_out") - newest + 1, F.lit(1)), "_out")).alias("_n"))
    return wanted.join(ranked, ["ticker", "_n"]).withColumn("quarter_no", F.col("_out") - F.col("_n") + 1).drop("_n", "_out")


def nearest_price(dates: DataFrame, prices: DataFrame, tolerance: int = 1) -> DataFrame:
    """The price nearest to each (ticker, date) within ``tolerance`` days, the earlier on a tie,
    carried forward over the ticker's dates. Days around a date are equi-joined."""
    around = dates.select("ticker", "date", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))).alias("_d")).withColumn("_at", F.expr("date_add(date, _d)"))
    found = around.join(prices.select("ticker", F.col("date").alias("_at"), "close"), ["ticker", "_at"])
    best = found.groupBy("ticker", "date").agg(F.min_by("close", F.struct(F.abs("_d").alias("a"), F.col("_d").alias("d"))).alias("_c"))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return dates.join(best, ["ticker", "date"], "left").withColumn("close", F.last("_c", ignorenulls=True).over(w)).drop("_c")


def trailing_sums(quarters: DataFrame, fields: list[str], compat: bool = False) -> DataFrame:
    """<field>_ttm and <field>_yoy for each (ticker, date).

    TTM is the sum of the newest four quarters, scaled by 4 / n where there are two or three; ``compat``
    sums all quarters kept. YOY is the change from the oldest to the newest kept, in percent.
    """
    aggs = []
    for f in fields:
        usable = F.when((F.lit(compat)) | (F.col("quarter_no") <= 4), F.col(f))
        n = F.count(usable)
        total = F.sum(usable) if compat else F.when(n >= 2, F.sum(usable) * 4 / n)
        newest, oldest = F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("period_end"))), F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("period_end")))
        aggs += [total.alias(f"{f}_ttm"), ratio((newest - oldest) * 100, F.abs(oldest)).alias(f"{f}_yoy")]
    return quarters.groupBy("ticker", "date").agg(*aggs)


def latest_values(quarters: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Newest value of each field, the first alias that has one."""
    values = {name: [F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col("period_end"))) for a in names] for name, names in aliases.items()}
    return quarters.groupBy("ticker", "date").agg(*(F.coalesce(*v).alias(n) for n, v in values.items()))


def valuation_ratios(quarters: DataFrame) -> DataFrame:
    """pe, pcf, eps, avg_shares, market_cap, net_income and dividend_yield of four quarters or more.

    ``quarters`` has eps, cash_flow, shares, net_income, dividends and price (at the quarter's end).
    """
    q = quarters.where("quarter_no <= 4")
    out = q.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("_n"), ratio(F.avg("price"), F.sum("eps")).alias("pe"), ratio(F.avg("price"), F.sum(ratio(F.col("cash_flow"), F.col("shares")))).alias("pcf"),
        F.sum("eps").alias("eps"), F.avg("shares").alias("avg_shares"), (F.sum(F.col("shares") * F.col("price")) / 4).alias("market_cap"),
        F.sum("net_income").alias("net_income"), (ratio(F.sum("dividends"), F.avg("price")) * 100).alias("dividend_yield"),
    )
    return out.where("_n >= 4").drop("_n")


def estimates_wide(estimates: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per ticker with a column for each kind and period, e.g. ``earnings_0q``."""
    name = F.concat("kind", F.lit("_"), F.regexp_replace("period", r"^\+", ""))
    names = [f"{k}_{p.lstrip('+')}" for k in kinds for p in ESTIMATE_PERIODS]
    return estimates.withColumn("_name", name).groupBy("ticker").pivot("_name", names).agg(F.max("value"))


def quarter_label(date):
    """``YYYY-Qn``."""
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def attach(holdings: DataFrame, characteristics: DataFrame, wanted: list[str]) -> DataFrame:
    """Characteristics by (ticker, date); fields that aren't there are left out."""
    there = [c for c in wanted if c in characteristics.columns]
    return holdings.join(characteristics.select("ticker", "date", *there), ["ticker", "date"], "left")


def catalogue(statement_fields: list[str], estimate_kinds: list[str]) -> list[str]:
    """Names of all characteristics."""
    return [*BASE_FIELDS, *(f"{f}_TTM" for f in statement_fields), *(f"{f}_YOY" for f in statement_fields), *(f"{k}_{p.lstrip('+')}" for k in estimate_kinds for p in ESTIMATE_PERIODS)]
