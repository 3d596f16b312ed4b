"""Portfolio against benchmark: the merged tree and return attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.columns import active_difference, ratio
from tallyfield.operators.linking import link_active

METRICS = ("w_pos", "w_trb", "w_mv", "ret", "ret_lcl", "ret_hlds", "ret_hlds_lcl", "tx_ret_lcl", "ccy_ret", "contribution", "pnl")


def tree_nodes(rolled: DataFrame, leaves: DataFrame, classes: list[str]) -> DataFrame:
    """Buckets of ``rollup`` and positions as one table (date, level, classes, ticker, metrics)."""
    depth = len(classes)
    top = rolled.select("portfolio", "date", "level", *classes, F.lit(None).cast("string").alias("ticker"), *METRICS)
    return top.unionByName(leaves.select("portfolio", "date", F.lit(depth + 1).alias("level"), *classes, "ticker", *METRICS))


def merge_tree(nodes: DataFrame, portfolio: str, benchmark: str, classes: list[str]) -> DataFrame:
    """Both sides of every node and date, missing sides null.

    A node has one row per side and date, so the full outer join is one aggregation over real key
    columns, in which null classes mark the upper levels: one shuffle, and the nodes are read once.
    """
    side = lambda name, m: F.max(F.when(F.col("portfolio") == name, F.col(m)))
    keys = ["date", "level", *classes, "ticker"]
    both = nodes.where(F.col("portfolio").isin(portfolio, benchmark)).groupBy(*keys).agg(
        *(side(portfolio, m).alias(m) for m in METRICS), *(side(benchmark, m).alias(f"{m}_bench") for m in METRICS)
    )
    ones = ("ret", "ret_lcl", "ret_hlds", "ret_hlds_lcl", "tx_ret_lcl", "ccy_ret")
    return both.withColumns({f"{m}_active": active_difference(F.col(m), F.col(f"{m}_bench"), 1.0 if m in ones else 0.0) * 100 for m in METRICS if m not in ("w_mv", "pnl")})


def daily_effects(tree: DataFrame, classes: list[str]) -> DataFrame:
    """allocation, selection and leverage in percent for every node and date.

    Dates on which either side's root has no weight are left out. Root and parent values come from
    windows over a date's nodes, all served by one shuffle by date.
    """
    depth = len(classes)
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = tree.select(
        "date", "level", *classes, "ticker", F.coalesce("w_pos", zero).alias("p"), F.coalesce("w_pos_bench", zero).alias("b"),
        F.coalesce("ret_hlds_lcl", one).alias("rp"), F.coalesce("ret_hlds_lcl_bench", one).alias("rb"),
    )
    level = F.col("level")
    day = Window.partitionBy("date")
    root = lambda c: F.max(F.when(level == 0, F.col(c))).over(day)
    rows = rows.withColumns({"h": root("rb"), "root_rp": root("rp"), "_p0": root("p"), "_b0": root("b")}).where("_p0 <> 0 and _b0 <> 0")
    pp, bp = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i in range(1, depth + 1):
        bucket = Window.partitionBy("date", *classes[:i])
        at = lambda c, i=i, bucket=bucket: F.max(F.when(level == i, F.col(c))).over(bucket)
        pp, bp = F.when(level == i + 1, at("p")).otherwise(pp), F.when(level == i + 1, at("b")).otherwise(bp)
    rows = rows.withColumns({"_pp": pp, "_bp": bp})
    scaled = F.when(F.col("_bp") != 0, F.col("p") - F.col("_pp") * F.col("b") / F.col("_bp"))
    allocation = F.when(level == 1, (F.col("p") - F.col("b")) * (F.col("rb") - F.col("h"))).when(
        (level > 1) & (level <= depth), F.coalesce(scaled, F.col("p")) * (F.col("rp") - F.col("h"))
    )
    selection = F.when((level >= 1) & (level <= depth), F.col("p") * (F.col("rp") - F.col("rb"))).when(
        level == depth + 1, F.coalesce(scaled * (F.col("rb") - F.col("h")), F.col("p") * (F.col("rp") - F.col("h")))
    )
    rows = rows.withColumns({"allocation": allocation * 100, "selection": selection * 100})
    tops = lambda c: F.sum(F.when(level == 1, F.col(c))).over(day)
    rows = rows.withColumns({"_a": tops("allocation"), "_s": tops("selection")})
    return rows.withColumns({
        "allocation": F.when(level == 0, F.col("_a")).otherwise(F.col("allocation")), "selection": F.when(level == 0, F.col("_s")).otherwise(F.col("selection")),
        "leverage": F.when(level == 0, (F.col("p") - F.col("b")) * (F.col("rb") - 1) * 100),
    }).drop("_a", "_s", "_pp", "_bp", "_p0", "_b0")


def linked_effects(effects: DataFrame, classes: list[str]) -> DataFrame:
    """Effects linked over time: buckets with the root's returns of the same date, positions with
    their own."""
    leaf = F.col("level") == len(classes) + 1
    rows = effects.withColumns({"_rp": F.when(leaf, F.col("rp")).otherwise(F.col("root_rp")), "_rb": F.when(leaf, F.col("rb")).otherwise(F.col("h"))})
    return link_active(rows, ["level", *classes, "ticker"], "_rp", "_rb", ["allocation", "selection", "leverage"]).drop("_rp", "_rb")


def trend(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Weekly rows, on Sundays, where the span is over 30 days; all of them otherwise."""
    span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & ((span <= 30) | (F.dayofweek("date") == 1)))


def last_date(rows: DataFrame, end: str) -> DataFrame:
    return rows.where(F.col("date") == F.lit(end).cast("date"))


def active_weight(p, b):
    """Active share of a node, as a ratio of its benchmark weight."""
    return ratio(p - b, b)
