"""Mixing sources to target weights by hierarchical budgeting.

Documents hang below a tree of levels (domain, language, source). The token budget goes down the
tree by the weights of siblings; what a node can't fill (its tokens times the most epochs) is shared
among its siblings by their weights, and only what all of them can't fill goes to the parent's
siblings. Each leaf then takes whole epochs and a prefix of one more, in a seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

NONE = "(none)"
#: A leaf's cut is looked for in ranges of the seeded order, each round parting the range that holds it by RANGE_BITS more.
RANGE_BITS, ROUNDS, ORDER_BITS = 8, 3, 60


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(column: Column, weights: Mapping[str, int]) -> Column:
    return reduce(lambda out, kv: F.when(column == kv[0], kv[1]).otherwise(out), weights.items(), F.lit(1)).cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: float, epochs: int) -> DataFrame:
    """``leaves`` (levels..., tokens) with the tokens each may take: budget double.

    Siblings with capacities c and weights w get min(c, w * x), with the x that spends the parent's
    budget: sorted by c / w, x is the greatest (budget - capacities before) / (weights from here).
    """
    leaves = leaves.withColumn("__c", F.col("tokens") * epochs)
    whole = leaves.agg(F.least(F.sum("tokens") * share, F.sum("__c").cast("double")).alias("__b"))
    nodes = None
    for depth in range(1, len(levels) + 1):
        path, above = list(levels[:depth]), list(levels[: depth - 1])
        here = leaves.groupBy(*path).agg(F.sum("__c").alias("__c"))
        here = here.withColumn("__w", _weight(F.col(path[-1]), weights.get(path[-1], {}))).where("__w > 0")
        parents = whole if nodes is None else nodes.select(*above, "__b")
        here = here.join(F.broadcast(parents)) if nodes is None else here.join(parents, above)
        order = Window.partitionBy(*above).orderBy(F.col("__c") / F.col("__w"), path[-1])
        before = F.coalesce(F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        after = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
        here = here.withColumn("__x", (F.col("__b") - before) / after)
        level = F.max("__x").over(Window.partitionBy(*above))
        nodes = here.withColumn("__b", F.least(F.col("__c").cast("double"), F.greatest(F.lit(0.0), F.col("__w") * level)))
    return leaves.drop("__c").join(nodes.select(*levels, F.col("__b").alias("budget")), list(levels))


def _order(seed: str, epoch: Column, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), epoch.cast("string"), key)), 1, ORDER_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], share: float = 0.8, epochs: int = 1, seed: str = "0", id_col: str = "doc_id", text_col: str = "text", into: str = "mixed") -> DataFrame:
    """A row of ``docs`` for each epoch in which it is chosen, with a struct column ``into``: epoch, n_tokens.

    ``levels`` names the tree's levels from the root, each with its column; null is a value of its
    own, "(none)". ``weights`` gives whole numbers by level and value; others count 1, and 0 leaves
    a value out. The budget is ``share`` of all tokens (words parted by white space). A leaf takes
    every document in each whole epoch, and in the last one the longest prefix of the seeded order
    that fits what is left; ties of that order go by id. Null or empty texts have no tokens. Rows that
    repeat an id are taken together. An empty table stays empty. A column named ``into`` is replaced.
    """
    names = [f"__{k}" for k in levels]
    keyed = {f"__{k}": F.coalesce(c.cast("string"), F.lit(NONE)) for k, c in levels.items()}
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = materialise(docs.select(*(c.alias(k) for k, c in keyed.items()), key.alias("__key"), n_tokens(F.col(text_col).cast("string")).alias("__n")), "tokens")
    leaves = slim.groupBy(*names).agg(F.sum("__n").alias("tokens"))
    plan = budgets(leaves, names, {f"__{k}": v for k, v in weights.items()}, share, epochs)
    full = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(epochs))).otherwise(0).cast("long")
    plan = plan.withColumn("__full", full).withColumn("__rest", F.greatest(F.lit(0), F.floor(F.col("budget") - F.col("__full") * F.col("tokens"))))
    plan = materialise(plan.select(*names, "__full", F.when(F.col("__full") < epochs, F.col("__rest")).otherwise(0).alias("__rest")), "plan")

    inner = slim.join(plan.where("__rest > 0"), names).withColumn("__h", _order(seed, F.col("__full"), F.col("__key")))
    inner = materialise(inner.select(*names, "__rest", "__key", "__n", "__h", F.lit(0).cast("long").alias("__before")), "ordered")
    for bits in range(RANGE_BITS, RANGE_BITS * ROUNDS + 1, RANGE_BITS):
        inner = inner.withColumn("__range", F.shiftright("__h", ORDER_BITS - bits))
        ranges = inner.groupBy(*names, "__rest", "__before", "__range").agg(F.sum("__n").alias("__n"))
        upto = F.sum("__n").over(Window.partitionBy(*names).orderBy("__range"))
        ranges = ranges.withColumn("__before", F.col("__before") + upto - F.col("__n"))
        # the last range that starts within the rest holds the cut
        last = ranges.where("__before <= __rest").groupBy(*names).agg(F.max(F.struct("__range", "__before")).alias("__r")).select(*names, "__r.__range", "__r.__before")
        last = materialise(last, "last")
        inner = materialise(inner.drop("__before").join(last, [*names, "__range"]).select(*names, "__rest", "__key", "__n", "__h", "__before"), "inner")
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(*names).orderBy("__h", "__key"))
    cut = inner.withColumn("__upto", upto).where("__upto <= __rest").groupBy(*names).agg(F.max(F.struct("__h", "__key")).alias("__cut"))
    start = F.struct((F.shiftleft(F.col("__range"), ORDER_BITS - bits) - 1).alias("__h"), F.lit("\U0010ffff").alias("__key"))
    cuts = last.join(cut, names, "left").select(*names, F.coalesce("__cut", start).alias("__cut"))
    plan = materialise(plan.join(cuts, names, "left"), "cuts")

    marked = docs.withColumns({**keyed, "__key": key, "__n": n_tokens(F.col(text_col).cast("string"))}).join(plan, names)
    taken = F.struct(_order(seed, F.col("__full"), F.col("__key")).alias("__h"), F.col("__key")) <= F.col("__cut")
    times = F.col("__full") + F.when(taken, 1).otherwise(0)
    marked = marked.withColumn("__times", times).where("__times > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    out = F.struct(F.col("__epoch").cast("int").alias("epoch"), F.col("__n").alias("n_tokens"))
    return marked.withColumn(into, out).select(*[c for c in docs.columns if c != into], into)
