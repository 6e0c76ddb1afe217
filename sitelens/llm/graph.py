"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _mapped(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the labels of their ends (an id without a label stands for itself), loops left out."""
    left = labels.select(F.col("id").alias("u"), F.col("component").alias("cu"))
    right = labels.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    both = edges.join(left, "u", "left").join(right, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    return both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (u, v longs); the component is its smallest vertex.

    ``known`` holds the components of earlier edges, which the new ones join. Each round hooks every
    vertex onto its smallest neighbour, and keeps only the edges between different hooks: a star
    ends in one round; from the second round on pointers are jumped, so that chains shrink fast.
    Nothing is collected; each round's tables are written to the shared folder. No edges: no rows.
    """
    edges = edges.select("u", "v").where("u <> v")
    if known is not None:
        edges = materialise(_mapped(edges, known), "edges")
    labels, rounds = known, 0
    while rounds == 0 or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.min("v").alias("h")).select(F.col("u").alias("id"), F.least("u", "h").alias("component"))
        hooks = materialise(hooks, "hooks")
        for _ in range(2 if rounds else 0):
            onward = hooks.select(F.col("id").alias("component"), F.col("component").alias("further"))
            hooks = hooks.join(onward, "component", "left").select("id", F.coalesce("further", "component").alias("component"))
        hooks = materialise(hooks, "jumped") if rounds else hooks
        if labels is None:
            labels = hooks
        else:
            moved = hooks.select(F.col("id").alias("component"), F.col("component").alias("h"))
            old = labels.join(moved, "component", "left").select("id", F.coalesce("h", "component").alias("component"))
            fresh = hooks.join(labels.select("id"), "id", "left_anti") if known is not None and not rounds else hooks.limit(0)
            labels = materialise(old.unionByName(fresh), "labels")
        edges = materialise(_mapped(edges, hooks).distinct(), "edges")
        rounds += 1
    return labels
