"""Daily profit and returns of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import carried
from tallyfield.operators.positions import POSITION

#: Security types whose market values count as 0.
FUTURES = (
    "Currency future.",
    "Financial commodity future.",
    "Financial index future.",
    "Generic currency future.",
    "Generic index future.",
    "Physical index future.",
)


def daily_performance(priced: DataFrame, by_day: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every position and date of ``priced`` with market values, profits and 1-based returns.

    The window is filtered first, so its first row is a position's inception with no return.
    ``priced`` has portfolio, ticker, date, quantity, close, fx_rate, dividend, split_factor and any
    further columns, which stay; ``by_day`` is ``daily_trades``. One sort by position and date serves
    all lags; trades join as one row a day.
    """
    w = Window.partitionBy(*POSITION).orderBy("date")
    rows = priced
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    trades = by_day.select(*POSITION, "date", "traded_quantity", "signed_cash", "gross_cash", "n_trades")
    rows = rows.join(trades, [*POSITION, "date"], "left")
    rows = rows.withColumns({
        "quantity": carried("quantity", w), "close": carried("close", w), "fx_rate": F.coalesce(carried("fx_rate", w), F.lit(1.0)),
        "split_factor": carried("split_factor", w), "dividend": F.coalesce("dividend", F.lit(0.0)),
    })
    rows = rows.withColumns({
        "_q": F.lag("quantity").over(w), "_c": F.lag("close").over(w), "_x": F.lag("fx_rate").over(w),
        "_adj": F.coalesce(F.try_divide("split_factor", F.lead("split_factor").over(w)), F.lit(1.0)),
    })
    zero, n = F.lit(0.0), F.coalesce(F.col("n_trades"), F.lit(0))
    future = F.col("security_type").isin(*FUTURES) if "security_type" in priced.columns else F.lit(False)
    rows = rows.withColumns({
        "mkt_value_lcl": F.when(future, 0.0).otherwise(F.col("quantity") * F.col("close")),
        "bod_lcl": F.coalesce(F.col("_q") * F.col("_c"), zero),
        "bod": F.coalesce(F.col("_q") * F.col("_c") * F.col("_x"), zero),
        "eod_lcl": F.coalesce(F.col("_q") * F.col("_adj") * (F.col("close") + F.col("dividend")), zero),
        "income_pnl_lcl": F.coalesce(F.col("_q") * F.col("_adj") * F.col("dividend"), zero),
        "tx_pnl_lcl": F.coalesce(F.col("traded_quantity") * F.col("close") - F.col("signed_cash"), zero),
        "_gross": F.coalesce("gross_cash", zero),
    })
    rows = rows.withColumns({
        "mkt_value": F.col("mkt_value_lcl") * F.col("fx_rate"), "eod": F.col("eod_lcl") * F.col("fx_rate"),
        "income_pnl": F.col("income_pnl_lcl") * F.col("fx_rate"), "tx_pnl": F.col("tx_pnl_lcl") * F.col("fx_rate"),
        "position_basis": F.col("bod"), "position_basis_lcl": F.col("bod_lcl"), "m2m_bod": F.when(future, 0.0).otherwise(F.col("bod")),
        "pnl_lcl": F.col("eod_lcl") - F.col("bod_lcl") + F.col("tx_pnl_lcl"),
        "trb_lcl": F.when((F.col("bod_lcl") == 0) & (n > 0), F.col("_gross")).otherwise(F.col("bod_lcl")),
        "trb": F.when((F.col("bod") == 0) & (n > 0), F.col("_gross") * F.col("fx_rate")).otherwise(F.col("bod")),
    })
    rows = rows.withColumn("pnl", F.col("eod") - F.col("bod") + F.col("tx_pnl"))

    def one_based(part, basis):
        return F.when(F.col(basis) != 0, part / F.col(basis) + 1).otherwise(1.0)

    rows = rows.withColumns({
        "ret": one_based(F.col("pnl"), "trb"), "ret_lcl": one_based(F.col("pnl_lcl"), "trb_lcl"),
        "tx_ret": one_based(F.col("tx_pnl"), "trb"), "tx_ret_lcl": one_based(F.col("tx_pnl_lcl"), "trb_lcl"),
        "ret_hlds": one_based(F.col("pnl") - F.col("tx_pnl"), "position_basis"),
        "ret_hlds_lcl": one_based(F.col("pnl_lcl") - F.col("tx_pnl_lcl"), "position_basis_lcl"),
    })
    return rows.withColumn("ccy_ret", F.col("ret") - F.col("ret_lcl") + 1).drop("_q", "_c", "_x", "_adj", "_gross", "traded_quantity", "signed_cash", "gross_cash", "eod", "eod_lcl", "bod", "bod_lcl")
