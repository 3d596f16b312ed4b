"""Exact top-k search by inner product. Segment means and deviations, from one segment to many,
bound the score of every candidate; only candidates that can still enter a query's top k are
scored exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query blocks that a task keeps at a time.
OPEN_BLOCKS = 32
#: Vector blocks whose statistics it remembers.
OPEN_VECTORS = 4
SCHEMA = "query_id bigint, vec_id bigint, score bigint"


@dataclass(frozen=True)
class SearchSettings:
    """query_block, vector_block: rows of a block; levels: numbers of segments, coarse to fine."""

    k: int = 10
    query_block: int = 512
    vector_block: int = 2048
    levels: tuple = (1, 4, 16)


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row and segment: mean times the root of the segment's length, and the root of the sum
    of squared differences from the mean. Trailing components go to the last segment."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    mean, dev = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        m = part.mean(axis=1) if b > a else np.zeros(len(x))
        mean.append(m * np.sqrt(b - a))
        dev.append(np.sqrt(((part - m[:, None]) ** 2).sum(axis=1)))
    return np.stack(mean, axis=1), np.stack(dev, axis=1)


#: Share of the pairs alive from which a level's bounds come from one matrix product over all of them.
DENSE = 0.05
PAIRS = 1 << 17


class Block:
    """A block of whole-number vectors with what the bounds need of them, made once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: tuple):
        self.ids, self.x = ids, x
        self.real = x.astype(np.float64)
        self.norm = np.sqrt((self.real**2).sum(axis=1))
        self.most = int(np.abs(self.real).max()) + 1 if x.size else 0
        self.stats = [segment_statistics(self.real, lv) for lv in levels if lv <= max(1, x.shape[1])]


def exact_scores(v: Block, at: np.ndarray, q: Block, i: int) -> np.ndarray:
    """Inner products of rows ``at`` with a query, exact whole numbers: doubles, 64-bit or unbounded integers by
    a bound of the sum of the products' sizes."""
    most = q.most * v.most * max(1, q.x.shape[1])
    if most < 1 << 53:
        return (v.real[at] @ q.real[i]).astype(np.int64)
    if most < 1 << 62:
        return v.x[at] @ q.x[i]
    return v.x[at].astype(object) @ q.x[i].astype(object)


class TopK:
    """Running best k of each query of a block. ``removed`` counts the pairs that each level rules out."""

    def __init__(self, queries: Block, settings: SearchSettings):
        self.q, self.s = queries, settings
        self.found: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        self.least = np.full(len(queries.ids), -np.inf)
        self.removed = [0] * len(queries.stats)
        self.scored = 0

    def offer(self, v: Block) -> None:
        """Score the candidates that no level of bounds rules out."""
        if v.x.shape[1] != self.q.x.shape[1]:
            raise ValueError("vectors of different lengths")
        first = np.zeros(len(v.ids), bool)
        first[np.argsort(-v.norm, kind="stable")[: 4 * self.s.k]] = True
        for part in (np.flatnonzero(first), np.flatnonzero(~first)):  # large vectors first: they set the bar
            self._offer(v, part)

    def _bounds(self, level: int, v: Block, part: np.ndarray, alive: np.ndarray) -> None:
        """Take out of ``alive`` the pairs that this level rules out; only pairs alive are looked at."""
        (qm, qd), (vm, vd) = self.q.stats[level], v.stats[level]
        vm, vd = vm[part], vd[part]
        # rounding: a relative error of the sums, against the product of the norms
        slack = (self.q.x.shape[1] + 64) * 2e-15
        before = int(alive.sum())
        if before > DENSE * alive.size:
            # <q,v> = sum of means' products + at most the product of deviations, by Cauchy-Schwarz
            bound = qm @ vm.T + qd @ vd.T + slack * np.outer(self.q.norm, v.norm[part]) + 1e-6
            alive &= bound >= self.least[:, None]
        else:
            at_q, at_v = np.nonzero(alive)
            for lo in range(0, len(at_q), PAIRS):
                i, j = at_q[lo : lo + PAIRS], at_v[lo : lo + PAIRS]
                bound = np.einsum("ps,ps->p", qm[i], vm[j]) + np.einsum("ps,ps->p", qd[i], vd[j]) + slack * self.q.norm[i] * v.norm[part[j]] + 1e-6
                gone = bound < self.least[i]
                alive[i[gone], j[gone]] = False
        self.removed[level] += before - int(alive.sum())

    def _offer(self, v: Block, part: np.ndarray) -> None:
        alive = self.q.ids[:, None] != v.ids[part][None, :]
        for level in range(len(self.q.stats)):
            if alive.any():
                self._bounds(level, v, part, alive)
        for i in np.flatnonzero(alive.any(axis=1)):
            at = part[alive[i]]
            score = exact_scores(v, at, self.q, i)
            self.scored += len(at)
            if len(at) > self.s.k:  # ties at the k-th score all stay
                cut = np.sort(score)[len(at) - self.s.k]
                keep = (score >= cut).astype(bool)
                at, score = at[keep], score[keep]
            best = self.found[i] + list(zip((-score).tolist(), v.ids[at].tolist(), strict=True))
            best.sort()
            self.found[i] = best[: self.s.k]
            if len(self.found[i]) == self.s.k:
                self.least[i] = float(-self.found[i][-1][0])

    def rows(self):
        for q, best in zip(self.q.ids.tolist(), self.found, strict=True):
            for score, v in best:
                yield q, v, -score


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and whole-number components floor(scale * x); vectors that are null, or hold null
    or non-finite components, go."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("bigint"))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col("vec_id").cast("bigint"), whole.alias("v"))


def _blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Rows gathered into blocks of at most ``size`` vectors as bytes, by partition."""

    def kernel(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                rows = part.column(1).to_pylist()
                widths = {len(r) for r in rows}
                for width in sorted(widths):  # a block holds vectors of one length
                    at = [i for i, r in enumerate(rows) if len(r) == width]
                    x = np.array([rows[i] for i in at], np.int64).reshape(len(at), width)
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([np.ascontiguousarray(ids[at]).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["width", f"{name}_ids", f"{name}_x"])

    return vectors.mapInArrow(kernel, f"width int, {name}_ids binary, {name}_x binary")


def top_k_search(embeddings: DataFrame, queries, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query.

    ``queries`` is a condition on the rows; every other row is a candidate of a query. Ties go to
    the smaller vec_id, fewer than k candidates give fewer rows, vectors of another length than
    the query's take no part. Rows that repeat a vec_id stay separate candidates of other queries;
    none is a candidate of its own id. Query rows that repeat a vec_id are ranked together, each with its
    own copy of a neighbour, and leave k rows for the id, as in the SQL. Queries meet candidates in blocks (a stated query set
    against all rows), and each task keeps k rows per query of its block.
    """
    vectors = quantised(embeddings)
    spark = embeddings.sparkSession
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chosen = quantised(embeddings.where(queries))
    # query rows are gathered by id so that small partitions don't give small blocks
    q = _blocks(chosen.repartition(max(1, tasks // 8), "vec_id"), settings.query_block, "q")
    v = _blocks(vectors, settings.vector_block, "v")
    # every query block meets the vector blocks of each slice; a slice is one task's stream. A given number of partitions
    # isn't merged for its few bytes: the work is in the pairs
    slices = tasks
    q = q.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(tasks, "slice", "width")
    v = v.withColumn("slice", F.pmod(F.xxhash64("v_ids"), F.lit(slices)).cast("int")).repartition(tasks, "slice", "width")
    met = q.join(v.hint("merge"), ["slice", "width"])

    def kernel(batches):
        states: dict = {}
        known: dict = {}

        def block(ids, x):
            """Vector blocks come once for each query block: the last ones are kept."""
            key = (ids, x)
            if key not in known:
                if len(known) >= OPEN_VECTORS:
                    known.pop(next(iter(known)))
                known[key] = made(ids, x)
            return known[key]

        def made(ids, x):
            i = np.frombuffer(ids, np.int64)
            return Block(i, np.frombuffer(x, np.int64).reshape(len(i), -1), settings.levels)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("q_ids", "q_x", "v_ids", "v_x")]
            for row in range(batch.num_rows):
                qi, qx, vi, vx = (c[row].as_py() for c in cols)
                state = states.pop((qi, qx), None)
                if state is None:
                    state = TopK(made(qi, qx), settings)
                    if len(states) >= OPEN_BLOCKS:  # the one unused for longest leaves its rows
                        yield from _batch(states.pop(next(iter(states))))
                states[qi, qx] = state
                state.offer(block(vi, vx))
        for state in states.values():
            yield from _batch(state)

    def _batch(state):
        rows = list(state.rows())
        if rows:
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["query_id", "vec_id", "score"])

    near = met.mapInArrow(kernel, SCHEMA)
    # each task has left k rows per query: the k best of them all, without a sort of a whole query
    best = near.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, settings.k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
