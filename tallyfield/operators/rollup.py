"""Weights, contributions and the classification hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import carried, percent_return, ratio

UNCLASSIFIED = "Not Classified"


def classified(rows: DataFrame, classes: list[str]) -> DataFrame:
    """Classification columns carried forward by position; missing ones are not classified."""
    w = Window.partitionBy("portfolio", "ticker").orderBy("date")
    there = {c: F.coalesce(carried(c, w), F.lit(UNCLASSIFIED)) if c in rows.columns else F.lit(UNCLASSIFIED) for c in classes}
    return rows.withColumns(there)


def weighted(perf: DataFrame) -> DataFrame:
    """Daily denominators of the portfolio, weights on them, and contributions."""
    day = Window.partitionBy("portfolio", "date")
    rows = perf.withColumns({"denom_trb": F.sum("m2m_bod").over(day), "denom_mv": F.sum("mkt_value").over(day)})
    rows = rows.withColumns({
        "w_trb": ratio(F.col("trb"), F.col("denom_trb")), "w_pos": ratio(F.col("position_basis"), F.col("denom_trb")),
        "w_mv": ratio(F.col("mkt_value"), F.col("denom_mv")) * 100,
    })
    return rows.withColumns({"contribution": F.col("w_trb") * (F.col("ret") - 1), "contribution_lcl": F.col("w_trb") * (F.col("ret_lcl") - 1)})


def rollup(rows: DataFrame, classes: list[str], characteristics: tuple[str, ...] = ()) -> DataFrame:
    """One row per portfolio, date and node: level 0 is the portfolio, level i the first i classes.

    All levels come from one aggregation over grouping sets with partial sums before the shuffle.
    Returns are 1-based; a bucket whose weights sum to 0 has a null holdings return, and its part of
    the total counts as flat.
    """
    sets = [["portfolio", "date", *classes[:i]] for i in range(len(classes) + 1)]
    s = lambda c: F.sum(c)
    part = lambda r, w: F.sum((F.col(r) - 1) * F.col(w))
    sums = {
        "_wp": s("w_pos"), "_wt": s("w_trb"), "_wm": s("w_mv"),
        "_h": part("ret_hlds", "w_pos"), "_hl": part("ret_hlds_lcl", "w_pos"), "_t": part("tx_ret", "w_trb"), "_tl": part("tx_ret_lcl", "w_trb"),
        "pnl": s("pnl"), "pnl_lcl": s("pnl_lcl"), "income_pnl": s("income_pnl"), "tx_pnl": s("tx_pnl"), "mkt_value": s("mkt_value"), "m2m_bod": s("m2m_bod"),
        "contribution": s("contribution"), "contribution_lcl": s("contribution_lcl"),
        **{c: F.sum(F.col(c) * F.col("w_mv") / 100) for c in characteristics},
    }
    keys = [F.col(c) for c in ("portfolio", "date", *classes)]
    out = rows.groupingSets([[F.col(c) for c in one] for one in sets], *keys).agg(
        F.grouping_id(*keys).alias("_gid"), *(c.alias(n) for n, c in sums.items())
    )
    depth = len(classes)
    level = F.lit(depth) - F.bit_count("_gid")
    root = level == 0

    def over(num, den):
        return F.when(root, F.coalesce(F.col(num), F.lit(0.0)) + 1).otherwise(ratio(F.col(num), F.col(den)) + 1)

    out = out.withColumns({"level": level.cast("int"), "ret_hlds": over("_h", "_wp"), "ret_hlds_lcl": over("_hl", "_wp"), "tx_ret": over("_t", "_wt"), "tx_ret_lcl": over("_tl", "_wt")})
    one = F.lit(1.0)
    out = out.withColumns({
        "ret": F.coalesce("ret_hlds", one) + F.coalesce("tx_ret", one) - 1,
        "ret_lcl": F.coalesce("ret_hlds_lcl", one) + F.coalesce("tx_ret_lcl", one) - 1,
    })
    out = out.withColumns({"ccy_ret": F.col("ret") - F.col("ret_lcl") + 1, "w_pos": F.col("_wp"), "w_trb": F.col("_wt"), "w_mv": F.col("_wm")})
    for c in ("pnl", "pnl_lcl", "income_pnl", "tx_pnl", "contribution", "contribution_lcl"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return out.drop("_gid", "_wp", "_wt", "_wm", "_h", "_hl", "_t", "_tl")


def totals_wide(nodes: DataFrame, metric: str, names: list[str]) -> DataFrame:
    """One row per date with a column for each portfolio's root series."""
    return nodes.where("level = 0").groupBy("date").pivot("portfolio", names).agg(F.first(metric))


def percent_form(rows: DataFrame, returns: tuple[str, ...], contributions: tuple[str, ...]) -> DataFrame:
    """Output form: 1-based returns in percent, contributions times 100."""
    return rows.withColumns({c: percent_return(F.col(c)) for c in returns} | {c: F.col(c) * 100 for c in contributions})
