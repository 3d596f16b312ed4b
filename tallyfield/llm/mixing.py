"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's documents, in a hashed order, form quanta of half a block. Sources are the leaves of a
binary tree; at a node with weights u and v, whose halves have shares p and q = 1 - p of the node's
turns, quantum j of the first half is due at ceil((j + 1/2) / p), so it is half a quantum early, and
earliest deadline first serves it in the turn before. Every other turn is the second half's, whose
quantum j is then served at floor((j + 1/2) / q). So a quantum's slot is a product of whole-number
divisions along the path from its leaf to the root: nothing is rounded to a cycle, no slot depends on
the slots before it, and the schedule may be as long as the table.

A half is at any turn at most half a quantum off its share of the node's turns, and a node passes on
its own error in proportion: a leaf of weight w is off by at most (1 + the sum of w / W over its
ancestors below the root) / 2 quanta. The tree keeps that sum under 2.4: sources lie in classes of
weights within a factor of 2, a class is a balanced tree, and classes join from the lightest to the
heaviest. That makes 1.7 quanta, less than one block of two quanta, against the weights themselves.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import named

#: Weights that are computed are whole multiples of 1 / UNIT: the root of a size n is under 1 / UNIT off, which over all
#: of the source's quanta makes less than root(n) / 2**23 quanta.
UNIT = 1 << 20
#: Bits of the largest given weight.
GIVEN_BITS = 58


@dataclass(frozen=True)
class MixSettings:
    """block: documents of a block, an even number; temperature: where no weights are given, they are the
    sources' sizes to this power."""

    block: int = 16
    temperature: float = 0.5

    def __post_init__(self):
        if self.block < 2 or self.block % 2:
            raise ValueError("a block has two quanta of the same size")

    @property
    def quantum(self) -> int:
        return self.block // 2


def whole_weights(weights: dict) -> dict:
    """Weights as whole numbers: exactly as they are written where that takes no more than ``GIVEN_BITS``
    bits, else to so many bits of the largest one."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    unit = math.lcm(*(p.denominator for p in parts.values()))
    whole = {s: int(p * unit) for s, p in parts.items()}
    most = max(whole.values())
    if most < 1 << GIVEN_BITS:
        return whole
    return {s: max(1, round(Fraction(k << GIVEN_BITS, most))) for s, k in whole.items()}


#: Columns of a place; an input column of such a name gives way to it.
PLACE = ("mix_index", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")
_WIDE = "decimal(38,0)"


def _divided(a: Column, b: Column) -> Column:
    """Whole part of a / b, for whole numbers of up to 38 digits."""
    return F.call_function("div", a, b)


def turn(path: Column, j: Column) -> Column:
    """Slot of a leaf's quantum ``j``. ``path`` has a step (own weight, parent's weight, side) for each
    node from the leaf up to the root's half; side 0 is the half that is half a quantum early."""

    def step(m, s):
        wide = _divided((2 * m.cast("decimal(20,0)") + 1) * s["parent"] - 1 + s["side"], 2 * s["own"])
        # the same where all fits in 64 bits
        parent, own = (s[c].cast("bigint") for c in ("parent", "own"))
        short = _divided((2 * m + 1) * parent - 1 + s["side"], 2 * own)
        return F.when((s["parent"] < 1 << 61) & (m < _divided(F.lit(1 << 61), parent)), short).otherwise(wide)

    return F.aggregate(path, j.cast("bigint"), step)


def source_paths(sources: DataFrame) -> DataFrame:
    """``sources`` (source, k: whole weight) with path and total weight.

    Windows over a class of weights order at most all sources; those over classes, of which there are
    at most 63, have one row a class.
    """
    ranked = sources.withColumn("class", F.length(F.bin("k")))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy("source")) - 1)
    per_class = ranked.groupBy("class").agg(F.sum(F.col("k").cast(_WIDE)).cast(_WIDE).alias("w"), F.length(F.bin(F.count(F.lit(1)) - 1)).alias("levels"))
    lighter = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    heavier = Window.orderBy("class").rowsBetween(1, Window.unboundedFollowing)
    per_class = per_class.withColumn("u", F.sum("w").over(lighter).cast(_WIDE))
    per_class = per_class.withColumns({"above": F.collect_list("u").over(heavier), "total": F.max("u").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    step = lambda own, parent, side: F.struct(own.cast(_WIDE).alias("own"), parent.cast(_WIDE).alias("parent"), side.cast("int").alias("side"))
    chain = F.concat(F.array(F.col("u")), F.col("above"))
    up = F.concat(F.array(step(F.col("w"), F.col("u"), F.lit(0))), F.transform("above", lambda u, i: step(F.element_at(chain, i + 1), u, F.lit(1))))
    per_class = per_class.select("class", "levels", "total", up.alias("up"))
    # nodes of a class: sources whose ranks agree above the lowest ``level`` bits
    at = ranked.join(per_class.select("class", "levels"), "class").select("source", "k", "class", "rank", F.explode(F.sequence(F.lit(0), "levels")).alias("level"))
    at = at.withColumn("node", F.expr("shiftright(rank, level)"))
    at = at.withColumn("w", F.sum(F.col("k").cast(_WIDE)).over(Window.partitionBy("class", "level", "node")).cast(_WIDE))
    nodes = at.groupBy("source", "class").agg(F.max("k").alias("k"), F.sort_array(F.collect_list(F.struct("level", "w", (F.col("node") % 2).alias("side")))).alias("n"))
    inside = F.transform(F.slice("n", F.lit(2), F.size("n") - 1), lambda p, i: step(F.element_at("n", i + 1)["w"], p["w"], F.element_at("n", i + 1)["side"]))
    out = nodes.join(per_class, "class").select("source", "k", "total", F.concat(inside, F.col("up")).alias("path"))
    # where a node has one half only there is nothing to share
    return out.withColumn("path", F.filter("path", lambda s: s["own"] < s["parent"]))


def _given(docs: DataFrame, weights: dict) -> DataFrame:
    rows = json.dumps([[s, k] for s, k in whole_weights(weights).items()])
    return docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(rows), "array<array<string>>")).alias("a")).select(F.col("a")[0].alias("source"), F.col("a")[1].cast("bigint").alias("k"))


def with_schedule(docs: DataFrame, weights: dict | DataFrame | None = None, settings: MixSettings = MixSettings()) -> DataFrame:
    """``docs`` with mix_index, mix_block, mix_release, mix_deadline, mix_slot and mix_position.

    mix_index counts a source's documents; mix_slot is the turn of the document's quantum, between
    mix_release = floor((j - 1) / w) and before mix_deadline = ceil((j + 2) / w) for quantum j of a source
    of share w, as the deviation is under two quanta; mix_position orders all documents. ``weights`` is a
    dictionary, or a table (source, weight) where sources are many. Every row stays and has one place; a
    source that has run out leaves its slots empty. Null sources are a source of their own; null ids and
    repeated rows have places of their own; an empty table stays empty; texts aren't read but to order rows
    that repeat an id or have none. Sources that ``weights`` doesn't name raise an error. Numbering takes a hash
    bucket at a time, so that a source with a third of all rows is spread over many tasks; nothing comes to the driver.
    """
    own = named([c for c in docs.columns if c not in PLACE], "_row")
    return _placed(docs, weights, settings).select(*own, *PLACE)


def _placed(docs: DataFrame, weights, settings: MixSettings) -> DataFrame:
    """Whole rows as ``_row``, with their places."""
    again = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("bigint")
    # rows without an id go by their text
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), again.cast("string"))))
    keyed = docs.select(F.struct(*named(docs.columns)).alias("_row"), "source", "doc_id", again.alias("_again"), h.alias("_h"))
    keyed = keyed.withColumn("_bucket", F.substring("_h", 1, 3))
    per_bucket = keyed.groupBy("source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sources = per_bucket.groupBy("source").agg(F.sum("_n").alias("n"))
    if weights is None:
        root = F.sqrt("n") if settings.temperature == 0.5 else F.pow(F.col("n").cast("double"), F.lit(settings.temperature))
        sources = sources.select("source", F.greatest(F.floor(root * UNIT), F.lit(1)).cast("bigint").alias("k"))
    else:
        if isinstance(weights, dict):
            given = _given(docs, weights)
        else:
            most = F.max("weight").over(Window.partitionBy(F.lit(1)))
            unit = F.pow(F.lit(2.0), GIVEN_BITS - F.ceil(F.log2(most)))
            given = weights.select("source", F.col("weight").cast("double").alias("weight")).withColumn("k", F.greatest(F.round(F.col("weight") * unit), F.lit(1)).cast("bigint")).select("source", "k")
        # shares are of all given weights, also of sources that have no rows
        there = sources.select(F.col("source").alias("_there"))
        sources = given.join(there, F.col("source").eqNullSafe(F.col("_there")), "full_outer")
        known = F.when(F.col("k").isNotNull(), F.col("k")).otherwise(F.raise_error(F.concat(F.lit("no weight for source "), F.coalesce("_there", F.lit("null")))).cast("bigint"))
        sources = sources.select(F.coalesce("source", "_there").alias("source"), known.alias("k"))
    paths = source_paths(sources).select(F.col("source").alias("_s"), F.col("k").cast(_WIDE).alias("_k"), F.col("total").alias("_total"), F.col("path").alias("_path"))
    up_to = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", F.col("_bucket").alias("_b2"), F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"))
    # a source has at most 4,096 buckets, so its path meets few rows here and each bucket's rows get it with their offset
    offsets = offsets.join(paths, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s2"), "_b2", "_before", "_k", "_total", "_path")
    numbered = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "_again")))
    placed = numbered.join(offsets, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_bucket") == F.col("_b2")))
    size = settings.quantum
    placed = placed.withColumn("mix_index", (F.col("_before") + F.col("_rn") - 1).cast("bigint"))
    placed = placed.withColumns({"mix_block": F.floor(F.col("mix_index") / settings.block), "_j": F.floor(F.col("mix_index") / size)})
    j = F.col("_j").cast("decimal(20,0)")
    placed = placed.withColumns({
        "mix_release": F.when(F.col("_j") == 0, F.lit(0).cast("bigint")).otherwise(_divided((j - 1) * F.col("_total"), F.col("_k"))),
        "mix_deadline": _divided((j + 2) * F.col("_total") + F.col("_k") - 1, F.col("_k")),
        "mix_slot": turn(F.col("_path"), F.col("_j")),
    })
    return placed.withColumn("mix_position", F.col("mix_slot") * size + F.col("mix_index") % size)


def mixed_order(docs: DataFrame, weights: dict | DataFrame | None = None, settings: MixSettings = MixSettings()) -> DataFrame:
    """``docs`` with the same columns and rows, ordered by place: reading the files in order gives the mix."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = _placed(docs, weights, settings).select("_row", "mix_position")
    return placed.repartitionByRange(parts, "mix_position").sortWithinPartitions("mix_position").select("_row.*")
