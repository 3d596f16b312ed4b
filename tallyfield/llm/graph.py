"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import written

#: Parts in which the rows of a common value meet its one row on the other side.
SALTS = 8


def salted_join(rows: DataFrame, one: DataFrame, by: list[str], spread: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``one``, which has one row for each value of ``by``.

    A value may have a third of the rows, so they meet the other side in ``SALTS`` parts, by a hash of
    the column ``spread``. The sides are merged: an explode isn't part of Spark's size estimate, and a
    broadcast could be many times its limit.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.join(right.hint("merge"), [*by, "_salt"], how).drop("_salt")


def _with_minimum(edges: DataFrame, minimum: DataFrame) -> DataFrame:
    """edges (u, v) joined with (u, m)."""
    return salted_join(edges, minimum, ["u"], "v", "inner")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a centre, which has none itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("centre")))
    per_node = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("centre").alias("centre"))
    return per_node.where("out > 1 or out = 1 and centre = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge between two nodes; component is the smallest node.

    Each round is written to the shared folder; rounds end when all edges are stars around a
    component's smallest node.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_minimum(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_minimum(large, least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = written(small.where("u <> v").distinct(), "stars")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
