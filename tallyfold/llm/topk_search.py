"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.scratch import Pile, drop, settle

BLOCK = 2048  # queries that are sent to all tasks at once; with their length this bounds the broadcast
BINS = 128
ROWS = 512  # candidates that are scored at once


def _matrix(column: pa.Array) -> np.ndarray:
    return np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), -1)


def _usable(table: DataFrame) -> DataFrame:
    """Rows with an id and a whole, finite, non-empty vector."""
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(F.col("vec_id").isNotNull() & whole).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _scored(queries: tuple[np.ndarray, np.ndarray], use):
    """Runs use(state, ids of candidates, integer scores by query and candidate, same) over blocks of candidates; same marks the query's own row.

    Products stay exact while they fit 53 bits, else Python's integers take over.
    """
    own, q = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                lengths = np.asarray(some.column("embedding").value_lengths())
                some = some.filter(pa.array(lengths == q.shape[1]))
                if not some.num_rows:
                    continue
                v = _matrix(some.column("embedding"))
                ids = some.column("vec_id").to_numpy()
                exact = np.abs(q).max() * np.abs(v).max() * q.shape[1] < 2**53
                scores = (q @ v.T).astype(np.int64) if exact else np.array([[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in v] for x in q], np.int64)
                state = use(state, ids, scores, ids[None, :] == own[:, None])
        yield from use.done(state)

    return run


class _Histogram:
    """Counts of scores of each query in BINS bins of its own range [low, low + span)."""

    def __init__(self, own: np.ndarray, low: np.ndarray, span: np.ndarray) -> None:
        self.own, self.low, self.span, self.width = own, low, span, -(-span // BINS)

    def __call__(self, state, ids, scores, same):
        if state is None:
            state = np.zeros((len(self.own), BINS), np.int64)
        gap = scores.astype(object) - self.low[:, None] if np.abs(self.low).max() > 2**61 else scores - self.low[:, None]
        bins = (gap // self.width[:, None]).astype(np.int64)
        inside = (gap >= 0) & (gap < self.span[:, None]) & ~same
        flat = (np.arange(len(self.own))[:, None] * BINS + bins)[inside]
        state += np.bincount(flat, minlength=state.size).reshape(state.shape)
        return state

    def done(self, state):
        if state is not None:
            q, b = np.nonzero(state)
            yield pa.RecordBatch.from_arrays([pa.array(self.own[q]), pa.array(b.astype(np.int32)), pa.array(state[q, b])], names=["query_id", "bin", "n"])


class _Best:
    """Candidates at or above each query's bound; of those with a tie at the k-th place a task needs to pass on k at the most."""

    def __init__(self, own: np.ndarray, bound: np.ndarray, k: int) -> None:
        self.own, self.bound, self.k = own, bound, k

    def __call__(self, state, ids, scores, same):
        q, c = np.nonzero((scores >= self.bound[:, None]) & ~same)
        new = np.stack([q, -scores[q, c], ids[c]])
        state = new if state is None else np.concatenate([state, new], axis=1)
        order = np.lexsort(state[::-1])
        state = state[:, order]
        start = np.flatnonzero(np.r_[True, state[0, 1:] != state[0, :-1]]) if state.shape[1] else np.zeros(0, np.int64)
        place = np.arange(state.shape[1]) - np.repeat(start, np.diff(np.r_[start, state.shape[1]]))
        return state[:, place < self.k]

    def done(self, state):
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array(self.own[state[0]]), pa.array(state[2]), pa.array(-state[1])], names=["query_id", "vec_id", "score"])


def _bounds(table: DataFrame, own: np.ndarray, q: np.ndarray, reach: float, k: int) -> np.ndarray:
    """Each query's k-th highest score, from counts in ever finer bins; its least possible score where there are fewer."""
    most = np.ceil(np.sqrt((q * q).sum(axis=1)) * reach) + 1
    low = -np.minimum(most, 2.0**62).astype(np.int64)
    span = -2 * low + 1
    above, live = np.zeros(len(own), np.int64), np.ones(len(own), bool)
    while live.any():
        use = _Histogram(own[live], low[live], span[live])
        counts = table.mapInArrow(_scored((own[live], q[live]), use), "query_id bigint, bin int, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        counts = counts.withColumn("upto", F.sum("n").over(down))
        got = counts.groupBy("query_id").agg(F.collect_list(F.struct("bin", "n", "upto")).alias("bins")).collect()
        found = {r.query_id: sorted(((b.bin, b.n, b.upto) for b in r.bins), reverse=True) for r in got}  # BINS counts a query of the block at the most
        for i in np.flatnonzero(live):
            hit = next(((b, n, upto) for b, n, upto in found.get(int(own[i]), []) if above[i] + upto >= k), None)
            if hit is None:  # fewer than k candidates: all of them
                live[i] = False
                continue
            b, n, upto = hit
            above[i] += upto - n
            width = -(-int(span[i]) // BINS)
            low[i] += b * width
            span[i] = min(width, span[i] - b * width)
            live[i] = width > 1
    return low


def top_k(table: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k best rows of table by integer inner product, ties to the smaller vec_id.

    Both have vec_id bigint and embedding array<float>; a component x counts as floor(256 * x). Every candidate is scored for
    every query, in blocks of BLOCK queries that are sent to all tasks; global histograms of the scores are refined until
    each query's k-th value is known, then the candidates at or above it are kept and ranked. A row is no candidate for
    itself. Vectors that are null, empty, or hold null or non-finite components take no part, nor do candidates of another
    length than the query. Repeated rows are candidates each; of queries with one vec_id the least vector counts. Scores beyond 64 bits are held at their bounds. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    table, wanted = settle(_usable(table)), settle(_usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    reach = table.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * 256), F.lit(2)))))).first()[0] or 0.0
    out = Pile(spark, "query_id bigint, rank int, vec_id bigint, score bigint")
    lengths = [r[0] for r in wanted.select(F.size("embedding")).distinct().collect()]
    for n in sorted(lengths):
        last = None
        while True:  # the next block of queries in order of vec_id
            more = wanted.where(F.size("embedding") == n)
            block = (more if last is None else more.where(F.col("vec_id") > last)).orderBy("vec_id").limit(BLOCK).collect()
            if not block:
                break
            last = block[-1].vec_id
            own, q = np.array([r.vec_id for r in block], np.int64), np.floor(256.0 * np.array([r.embedding for r in block], np.float64))
            bound = _bounds(table, own, q, reach, k)
            best = table.mapInArrow(_scored((own, q), _Best(own, bound, k)), "query_id bigint, vec_id bigint, score bigint")
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            out.add(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    drop(table, wanted)
    return out.read()
