"""Multi-period linking as running sums: a day's coefficient depends on that day alone and the
period's on the prefix, so a series links in one pass instead of once more for every day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import active_k, carino_k, so_far


def link_split(rows: DataFrame, keys: list[str], total: str, parts: list[str], order: str = "date") -> DataFrame:
    """acc_<part> for 1-based parts of a 1-based total return, additive and adding up to the
    compounded total; acc_<total> is that. The first row of a series counts as flat."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(w) == 1
    flat = F.when(first, 1.0)
    rows = rows.withColumn("_r", F.coalesce(flat, F.when(F.col(total) > 0, F.col(total)), F.lit(1.0)))
    rows = rows.withColumns({f"_s{i}": F.coalesce(flat, F.col(p), F.lit(1.0)) for i, p in enumerate(parts)})
    rows = rows.withColumns({"_day_k": carino_k(F.col("_r")), "_all": F.product("_r").over(so_far(w))})
    rows = rows.withColumn("_all_k", carino_k(F.col("_all")))
    linked = {f"acc_{p}": F.sum(F.col("_day_k") * (F.col(f"_s{i}") - 1)).over(so_far(w)) / F.col("_all_k") + 1 for i, p in enumerate(parts)}
    return rows.withColumns(linked | {f"acc_{total}": F.col("_all")}).drop("_r", "_day_k", "_all", "_all_k", *(f"_s{i}" for i in range(len(parts))))


def link_active(rows: DataFrame, keys: list[str], portfolio: str, benchmark: str, effects: list[str], order: str = "date") -> DataFrame:
    """acc_<effect> for additive effects of portfolio minus benchmark (1-based returns), adding up to
    the difference of the compounded returns. The first row of a series counts as nothing."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(w) == 1
    clean = lambda c: F.when(first, 1.0).otherwise(F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.lit(1.0)))
    rows = rows.withColumns({"_p": clean(portfolio), "_b": clean(benchmark)})
    rows = rows.withColumns({"_day_k": active_k(F.col("_p"), F.col("_b"), 1 / F.col("_p")), "_all_p": F.product("_p").over(so_far(w)), "_all_b": F.product("_b").over(so_far(w))})
    rows = rows.withColumns({"_all_k": active_k(F.col("_all_p"), F.col("_all_b"), F.lit(1.0)), "_first": first})
    out = {f"acc_{e}": F.sum(F.col("_day_k") * F.when(F.col("_first"), 0.0).otherwise(F.coalesce(e, F.lit(0.0)))).over(so_far(w)) / F.col("_all_k") for e in effects}
    return rows.withColumns(out | {"acc_active": (F.col("_all_p") - F.col("_all_b")) * 100}).drop("_p", "_b", "_day_k", "_all_p", "_all_b", "_all_k", "_first")


def link_contributions(nodes: DataFrame, keys: list[str], contributions: list[str], order: str = "date") -> DataFrame:
    """acc_<contribution>: contributions to the portfolio's return, linked by the return of its root (level 0) of the
    same date, so that those of a level add up to the compounded return. A series' rows before its first count as nothing.

    ``nodes`` has portfolio, level, ret and the contributions; the root's coefficients come from its own whole series.
    """
    w = Window.partitionBy("portfolio").orderBy(order)
    root = nodes.where("level = 0").select("portfolio", order, "ret")
    root = root.withColumn("_r", F.when(F.row_number().over(w) == 1, 1.0).otherwise(F.coalesce(F.when(F.col("ret") > 0, F.col("ret")), F.lit(1.0))))
    root = root.withColumn("_all_k", carino_k(F.product("_r").over(so_far(w)))).select("portfolio", order, carino_k(F.col("_r")).alias("_day_k"), "_all_k", (F.row_number().over(w) == 1).alias("_start"))
    rows = nodes.join(root, ["portfolio", order], "left")
    own = so_far(Window.partitionBy(*keys).orderBy(order))
    part = lambda c: F.when(F.col("_start"), 0.0).otherwise(F.col("_day_k") * F.coalesce(c, F.lit(0.0)))
    return rows.withColumns({f"acc_{c}": F.sum(part(c)).over(own) / F.col("_all_k") for c in contributions}).drop("_day_k", "_all_k", "_start")


def accumulate(rows: DataFrame, keys: list[str], returns: list[str], amounts: list[str], order: str = "date") -> DataFrame:
    """acc_ columns: compounded 1-based returns (first row flat) and running sums."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(w) == 1
    rows = rows.withColumns({f"_{c}": F.when(first, 1.0).otherwise(F.coalesce(c, F.lit(1.0))) for c in returns})
    out = {f"acc_{c}": F.product(f"_{c}").over(so_far(w)) for c in returns} | {f"acc_{c}": F.sum(F.coalesce(c, F.lit(0.0))).over(so_far(w)) for c in amounts}
    return rows.withColumns(out).drop(*(f"_{c}" for c in returns))
