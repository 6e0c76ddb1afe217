"""Exact top-k by inner product with a pivot table.

Distances of every vector to a set of pivots are computed once and kept in a table. For a query, the greatest
|d(q, p) - d(c, p)| over the pivots is a lower bound of the distance d(q, c), and so gives an upper bound of
the inner product. The first block of vectors gives each query a score that its k-th best reaches at least;
elsewhere candidates whose bound is below it are left out, and the others are evaluated in the order of their
bounds until the next bound is below the k-th best score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Vectors of a block are held by one task, and so are the queries; a vector is copied once for each block of queries.
PIVOTS, QUERY_BLOCK, VECTOR_BLOCK = 24, 4096, 8192
#: First batch of candidates that a query evaluates; each further one is twice as large.
FIRST = 128
_EPS = float(np.finfo(np.float64).eps)
_MOST = (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, in which such numbers are exact."""
    return np.floor(vectors.astype(np.float64) * scale)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, _squares(x)[:, None] - 2 * x @ pivots.T + _squares(pivots)))


def _spare(norms: np.ndarray | float, pivot_norms: np.ndarray, size: int) -> np.ndarray:
    """The most by which a distance that was computed from squares can be wrong."""
    return np.sqrt(8 * (size + 4) * _EPS * (norms + pivot_norms))


def _exact(c: np.ndarray, q: np.ndarray) -> type:
    """The narrowest kind of number in which every product of components and each sum of them is exact."""
    greatest = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    return np.float32 if greatest < 2**24 else np.float64 if greatest < 2**53 else np.int64 if greatest < 2**62 else object


def _as(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if kind is object else x.astype(kind)


def search(q_ids: np.ndarray, q: np.ndarray, q_table: np.ndarray, known: np.ndarray, c_ids: np.ndarray, c: np.ndarray, c_table: np.ndarray, pivots: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, candidates, scores, how many were evaluated) with the k best of each query, its own row left out.

    ``known`` holds for each query a score that its k-th best reaches at least, or -inf.
    """
    kind = _exact(c, q)
    own, asked = _as(c, kind), _as(q, kind)
    size, c_norm, q_norm, p_norm = c.shape[1], _squares(c), _squares(q), _squares(pivots)
    columns, farthest, greatest = np.ascontiguousarray(c_table.T.astype(np.float32)), c_table.max(0, initial=0), c_norm.max(initial=0)
    far = not max(float(farthest.max(initial=0)), float(q_table.max(initial=0))) < 1e30  # beyond what these bounds are made for
    room = np.empty_like(own)
    for i in range(len(q)):
        low, gap = np.zeros(len(c), np.float32), np.empty(len(c), np.float32)
        wrong = _spare(q_norm[i], p_norm, size) + _spare(greatest, p_norm, size) + 4e-7 * np.maximum(farthest, q_table[i])
        for p in range(len(pivots)):
            np.subtract(columns[p], np.float32(q_table[i, p]), out=gap)
            np.abs(gap, out=gap)
            np.subtract(gap, np.float32(wrong[p] * (1 + 1e-6)), out=gap)
            np.maximum(low, gap, out=low)
        upper = (q_norm[i] + c_norm - low.astype(np.float64) ** 2) / 2 + 8 * (size + 4) * _EPS * (q_norm[i] + c_norm)
        if far:
            upper = np.full(len(c), np.inf)
        left = np.flatnonzero((upper >= known[i]) & (c_ids != q_ids[i]))
        # bounds in 16-bit steps, rounded up, are ordered by radix
        top = float(upper[left].max(initial=-np.inf))
        step = max(float(np.ptp(upper[left])) / 65000, 1e-300) if len(left) and not far else 1.0
        below = np.zeros(len(left), np.uint16) if far else np.floor((top - upper[left]) / step * (1 - 1e-9)).astype(np.uint16)
        by = np.argsort(below, kind="stable")
        order, bound = left[by], top - below[by] * step
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, batch = 0, max(FIRST, 2 * k)
        while at < len(order) and (len(best) < k or bound[at] >= best[-1]):
            part = order[at : at + batch]
            scores = np.take(own, part, axis=0, out=room[: len(part)], mode="clip") @ asked[i]
            best_ids = np.concatenate([best_ids, c_ids[part]])
            best = np.concatenate([best, (np.clip(scores, -_MOST, _MOST) if kind is object else scores).astype(np.int64)])
            if len(best) > k:
                good = np.flatnonzero(best >= np.partition(best, len(best) - k)[len(best) - k])
                best_ids, best = best_ids[good], best[good]
            first = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[first], best[first]
            at, batch = at + len(part), 2 * batch
        yield int(q_ids[i]), best_ids, best, at


def _stacked(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column).astype(np.float64) if len(column) else np.zeros((0, width))


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the greatest inner product for each query row.

    Components become floor(scale * x). ``is_query`` marks the queries; a query's own id is no
    candidate. Ties go to the smaller id; with fewer than k candidates all are returned. Vectors
    that are null, empty or hold null, NaN or infinite components take no part, nor do null ids;
    only vectors of one length are compared. Rows that repeat an id are further candidates of that
    id, but no query's own. Empty table: no rows. Other columns are not read. Products are exact at
    any size; a score beyond a long is the nearest long to either side of 0, and ranks with it.

    Of rows that repeat a query's id, the one with the least vector speaks.

    The queries are a stated set: each block of them meets each block of candidates in a task of its
    own, which yields at most k rows a query, and these are merged. Both kinds of block have a
    bounded size. Pivots are the vectors with the smallest hashes of their ids, a bounded number.
    """
    spark, x = vectors.sparkSession, F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    # exists() is null where a component is, and such rows are left out too
    unsound = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size(x) > 0) & F.coalesce(~unsound, F.lit(False)))
    by_size: dict[int, list] = {}
    for r in rows.select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "vector").limit(pivots).collect():
        by_size.setdefault(len(r.vector), []).append(r.vector)
    shared = spark.sparkContext.broadcast({size: whole(np.array(v), scale) for size, v in by_size.items()})

    def pivots_of(size: int) -> np.ndarray:
        return shared.value.get(size, np.zeros((0, size)))

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                own = whole(part.column(1).flatten().to_numpy().reshape(-1, size), scale)
                made = []
                for numbers in (own, to_pivots(own, pivots_of(size))):
                    ends = np.arange(len(own) + 1, dtype=np.int32) * numbers.shape[1]
                    made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers.ravel())))
                yield pa.RecordBatch.from_arrays([part.column(0), made[0], part.column(2), pa.array(np.full(len(own), size, np.int32)), made[1]], ["id", "vector", "is_query", "size", "distances"])

    rows = rows.mapInArrow(table, "id long, vector array<double>, is_query boolean, size int, distances array<double>")
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "pivot-table")
    n = rows.agg(F.count("*").alias("all"), F.count_if("is_query").alias("queries")).first()
    parts, groups = max(1, -(-n["all"] // VECTOR_BLOCK)), max(1, -(-n.queries // QUERY_BLOCK))
    keys = ["part", "group", "size"]
    held = ["id", "vector", "distances"]
    candidates = rows.select((F.col("place") % parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "size", *held)
    asked = rows.where("is_query").groupBy("id", "size").agg(F.min(F.struct("vector", "distances")).alias("v")).select("id", "size", "v.*")
    asked = materialise(asked.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), "size", *held), "queries")

    def met(key: tuple, own: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(theirs):
            size, pivot = key[2], pivots_of(key[2])
            known = theirs.known.fillna(-np.inf).to_numpy(np.float64)
            found = list(search(theirs.id.to_numpy(), _stacked(theirs.vector, size), _stacked(theirs.distances, len(pivot)), known, own.id.to_numpy(), _stacked(own.vector, size), _stacked(own.distances, len(pivot)), pivot, k))
        columns = {"query_id": [np.full(len(f[1]), f[0]) for f in found], "vec_id": [f[1] for f in found], "score": [f[2] for f in found]}
        return pd.DataFrame({name: np.concatenate([np.zeros(0, np.int64), *values]) for name, values in columns.items()})

    def block(which: Column, queries: DataFrame) -> DataFrame:
        return candidates.where(which).groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(met, "query_id long, vec_id long, score long")

    first = materialise(block(F.col("part") == 0, asked.select(F.lit(0).alias("part"), "group", "size", *held, F.lit(None).cast("double").alias("known"))), "first-block")
    # a score as a double may be rounded up, so one less in its last place is known
    reached = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("c")).where(F.col("c") >= k)
    reached = reached.select(F.col("query_id").alias("id"), (F.col("s").cast("double") - F.abs(F.col("s").cast("double")) * 2e-16 - 1).alias("known"))
    best = first
    if parts > 1:
        others = asked.join(reached, "id", "left").select(F.explode(F.sequence(F.lit(1), F.lit(parts - 1))).alias("part"), "group", "size", *held, "known")
        best = first.unionByName(block(F.col("part") > 0, others))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
