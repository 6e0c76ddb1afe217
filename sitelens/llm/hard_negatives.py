"""Exact hard negatives by shared candidate lists of anchor clusters.

Anchors are clustered by direction. For a cluster with centroid m and greatest angle b between m and a member,
a candidate c at angle a to m has an inner product of at most |q| |c| cos(max(0, a - b)) with every member q. So one
list of candidates in the order of |c| cos(max(0, a - b)) serves the whole cluster: each member walks it until the
bound of what follows is below all that it could still take. A first walk finds each anchor's positives, a second one,
which knows their scores, the negatives between two shares of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise
from .top_k import _as, _exact, _squares, whole

#: Clusters at most, and anchors at most (those with the smallest hashes of their ids) that these are fitted on.
CLUSTERS, SAMPLE = 32, 1024
#: Components of candidates and of anchors that one task holds at most, save for a hash's unevenness.
HELD, ASKED = 1 << 22, 1 << 20
#: Candidates of a step of the walk, first and at most, and members that take it together.
FIRST, MOST, MEMBERS = 256, 8192, 512
_EPS = float(np.finfo(np.float64).eps)
_LEAST, _GREATEST = 1 - (1 << 63), (1 << 63) - 1


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; null vectors stay, and so do those too long for their squares."""
    norms = np.sqrt(_squares(x))[:, None]
    return np.divide(x, norms, out=np.zeros_like(x), where=(norms > 0) & np.isfinite(norms))


def fit(sample: np.ndarray, clusters: int = CLUSTERS, rounds: int = 8) -> np.ndarray:
    """Directions of about as many clusters as the root of the sample's size, by rounds of spherical k-means."""
    x = _unit(sample)
    centres = x[: min(clusters, max(1, int(len(x) ** 0.5)))]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(_squares(sums)[:, None] > 0, _unit(sums), centres)
    return centres


def _angles(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(x) @ centre, -1, 1))


def shared_list(c: np.ndarray, members: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates in the order of their bounds for any member of length 1, and the bounds."""
    norms, lengths = np.sqrt(_squares(c)), np.sqrt(_squares(members))
    spare = 8 * np.sqrt(2 * (c.shape[1] + 8) * _EPS)  # of two angles that were computed from cosines
    widest = _angles(members[lengths > 0], centre).max(initial=0) + spare
    bound = norms * np.cos(np.maximum(0, _angles(c, centre) - widest))
    if not (np.isfinite(norms).all() and np.isfinite(lengths).all()):
        bound = np.full(len(c), np.inf)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def walk(a_ids: np.ndarray, a: np.ndarray, a_label: np.ndarray, windows: list, c_ids: np.ndarray, c: np.ndarray, c_label: np.ndarray, other: bool, centre: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(anchor, window, candidates, scores, how many were evaluated): in each window (least, greatest score) of each anchor the k best.

    ``a`` holds the members of one cluster. Candidates are those of the anchor's label or, with ``other``, those of
    all other labels; rows with the anchor's own id are left out.
    """
    kind = _exact(c, a)
    order, bound = shared_list(c, a, centre)
    own, ids, labels = _as(c[order], kind), c_ids[order], c_label[order]
    greatest = float(np.sqrt(_squares(c).max(initial=0)))
    for start in range(0, len(a), MEMBERS):
        lengths = np.sqrt(_squares(a[start : start + MEMBERS]))
        asked = _as(a[start : start + MEMBERS], kind)
        found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows[start + i]] for i in range(len(asked))]
        floors = [[low if low <= high else np.inf for low, high in windows[start + i]] for i in range(len(asked))]
        reach = [max((high for _, high in windows[start + i]), default=_LEAST) for i in range(len(asked))]
        active, at, batch, evaluated = np.arange(len(asked)), 0, FIRST, np.zeros(len(asked), np.int64)
        while at < len(own):
            # one part in 10**9 more than the bound: rounding of products and lengths
            best = lengths[active] * bound[at] + 1e-9 * lengths[active] * greatest
            lowest = np.array([min(floors[i], default=np.inf) for i in active])
            active = active[~(best < lowest)]
            if not len(active):
                break
            with np.errstate(over="ignore", invalid="ignore"):
                scores = asked[active] @ own[at : at + batch].T
            if kind is object:
                scores = np.clip(scores, _LEAST, _GREATEST).astype(np.int64)
            for i, row in zip(active, scores):
                near = np.flatnonzero((row >= min(floors[i])) & (row <= reach[i]))
                if len(near):
                    near = near[((labels[at + near] != a_label[start + i]) if other else (labels[at + near] == a_label[start + i])) & (ids[at + near] != a_ids[start + i])]
                for w, (_, high) in enumerate(windows[start + i] if len(near) else ()):
                    take = near[(row[near] >= floors[i][w]) & (row[near] <= high)]
                    if not len(take):
                        continue
                    all_ids = np.concatenate([found[i][w][0], ids[at + take]])
                    all_scores = np.concatenate([found[i][w][1], row[take].astype(np.int64)])
                    top = np.lexsort((all_ids, -all_scores))[:k]
                    found[i][w] = all_ids[top], all_scores[top]
                    if len(top) == k:
                        floors[i][w] = int(all_scores[top[-1]])
            evaluated[active] += scores.shape[1]
            at, batch = at + scores.shape[1], min(2 * batch, MOST)
        for i, of in enumerate(found):
            for w, (best_ids, best_scores) in enumerate(of):
                yield int(a_ids[start + i]), w, best_ids, best_scores, int(evaluated[i])


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, share: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, place, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer inner product with the anchor, the higher the better,
    ties go to the smaller id. An anchor's positives are its first ``positives`` other rows of the same label, ``place``
    numbers them from 1; for each, the first ``negatives`` rows of other labels with low * positive_score <=
    share * negative_score <= high * positive_score. With fewer rows all are returned, with none no row.

    A null id, label or vector, or a null, NaN or infinite component: the row takes no part. Vectors of different lengths
    are not compared; empty ones score 0 with each other. Rows that repeat an id are further positives or negatives of that
    id, but none of its own; of rows that repeat an anchor's id the one with the shortest, then least vector speaks. Empty
    table: no rows. Other columns are not read. Products are exact at any size; a score beyond a long is 2**63 - 1 or 1 - 2**63.

    Blocks of candidates meet blocks of anchors, both of bounded size, each pair in a task of its own that yields at most
    ``negatives`` rows a positive. Clusters are laid out one after another and cut to blocks of anchors, so
    that a block holds few clusters; one that holds most anchors is cut.
    """
    spark, x = vectors.sparkSession, F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    unsound = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(~unsound, F.lit(False)))
    by_size: dict[int, list] = {}
    for r in rows.where("is_anchor").select("vector", F.xxhash64("id").alias("h"), "id").orderBy("h", "id", "vector").limit(SAMPLE).collect():
        by_size.setdefault(len(r.vector), []).append(r.vector)
    shared = spark.sparkContext.broadcast({size: fit(whole(np.array(v).reshape(len(v), size), scale)) for size, v in by_size.items()})

    def centres_of(size: int) -> np.ndarray:
        return shared.value.get(size, np.zeros((1, size)))

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                own = whole(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(part), size), scale)
                cluster = (_unit(own) @ centres_of(size).T).argmax(1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * size), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, part.column(3), pa.array(np.full(len(own), size, np.int32)), pa.array(cluster)], ["id", "label", "vector", "is_anchor", "size", "cluster"])

    rows = rows.mapInArrow(table, "id long, label string, vector array<double>, is_anchor boolean, size int, cluster int")
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where("is_anchor").groupBy("id").agg(F.min(F.struct("size", "vector", "label", "cluster")).alias("v")).select("id", "v.*")
    anchors = materialise(anchors, "anchors")

    # blocks: a bounded row for each length of vectors, and for each cluster of it
    held, wide = F.lit(HELD), F.greatest("size", F.lit(1))
    cores = 3 * spark.sparkContext.defaultParallelism
    parts = F.greatest(F.ceil(F.col("n") * wide / held), F.least(F.lit(cores), F.ceil(F.col("n") / 4096))).cast("int")
    line = anchors.groupBy("size", "cluster").agg(F.count("*").alias("members"))
    before = Window.partitionBy("size").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("begins", F.coalesce(F.sum("members").over(before), F.lit(0)))
    ends = line.groupBy("size").agg(F.sum("members").alias("asked"))
    per_block = F.greatest(F.lit(1), F.floor(F.lit(ASKED) / wide))
    cut = rows.groupBy("size").agg(F.count("*").alias("n")).join(ends, "size")
    cut = materialise(cut.select("size", parts.alias("parts"), F.ceil(F.col("asked") / per_block).cast("int").alias("groups"), per_block.alias("per_block")), "blocks")

    placed = rows.join(cut, "size").select("size", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "label", "id", "vector")
    at = F.floor((F.col("begins") + F.pmod(F.xxhash64("id"), F.col("members"))) / F.col("per_block")).cast("int")
    asking = anchors.join(line, ["size", "cluster"]).join(cut, "size").select("size", "parts", at.alias("group"), "label", "id", "cluster", "vector")
    asking = materialise(asking, "asking")

    def pairs(other: bool, k: int):
        def met(key: tuple, own: pa.Table, theirs: pa.Table) -> pa.Table:
            columns: list[list] = [[], [], [], []]
            if len(own) and len(theirs):
                size = key[0].as_py()
                c_ids, c = own["id"].to_numpy(), _matrix(own["vector"], size)
                a_ids, a, cluster = theirs["id"].to_numpy(), _matrix(theirs["vector"], size), theirs["cluster"].to_numpy()
                labels = pa.chunked_array([*own["label"].chunks, *theirs["label"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy()
                c_label, a_label = labels[: len(c)], labels[len(c) :]
                windows = [list(zip(lo, hi)) for lo, hi in zip(theirs["low"].to_pylist(), theirs["high"].to_pylist())]
                for m in np.unique(cluster):
                    of = np.flatnonzero(cluster == m)
                    for anchor, w, ids, scores, _ in walk(a_ids[of], a[of], a_label[of], [windows[i] for i in of], c_ids, c, c_label, other, centres_of(size)[m], k):
                        for column, values in zip(columns, (np.full(len(ids), anchor), np.full(len(ids), w + 1), ids, scores)):
                            column.append(values)
            return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *v]), pa.int64()) for n, v in zip(("anchor_id", "place", "id", "score"), columns)})

        return met

    def meet(asking: DataFrame, keys: list[str], other: bool, k: int) -> DataFrame:
        theirs = asking.select("size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "group", "label", "id", "cluster", "vector", "low", "high")
        found = placed.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(pairs(other, k), "anchor_id long, place long, id long, score long")
        by = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    anything = asking.withColumns({"low": F.array(F.lit(_LEAST)), "high": F.array(F.lit(_GREATEST))})
    same = meet(anything, ["size", "part", "group", "label"], False, positives)
    same = materialise(same.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # the least and greatest score that a negative may have, in numbers that a long's multiple doesn't leave
    p = F.col("positive_score").cast("decimal(38,0)")
    least, most = F.ceil(p * low / share).cast("long"), F.floor(p * high / share).cast("long")
    limits = same.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", least.alias("low"), most.alias("high")))).alias("w"))
    limits = limits.select(F.col("anchor_id").alias("id"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = meet(asking.join(limits, "id"), ["size", "part", "group"], True, negatives)
    found = found.select("anchor_id", F.col("place").cast("int").alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(same, ["anchor_id", "place"]).select("anchor_id", "positive_id", "place", "rank", "negative_id", "positive_score", "negative_score")
