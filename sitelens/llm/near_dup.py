"""MinHash near-duplicates with tensored banding and exact confirmation.

Each document gets two collections of ``keys`` keys, each key made of ``rows`` minhashes; a table
of the banding is a pair (key of the first collection, key of the second). So 2*keys*rows minhashes
serve keys**2 tables of 2*rows minhashes each. Documents that share a table are candidates, and a
candidate pair is a link only if the full shingle sets confirm it. With the defaults a pair at
similarity 0.8 becomes a candidate with probability 0.9996.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, wide
from .graph import components
from .words import U64, mix, shingle_sets

KEYS, ROWS = 12, 3

_FEATURES = "doc_id long, n_shingles long, digest binary, a array<long>, b array<long>"


def _minhash_keys(sets: list[np.ndarray], keys: int, rows: int) -> np.ndarray:
    """For each non-empty set, 2*keys keys; a key also depends on its place."""
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 1 << 63, 2 * keys * rows, dtype=U64) * U64(2) + U64(1)
    added = rng.integers(0, 1 << 63, 2 * keys * rows, dtype=U64)
    all_shingles = np.concatenate(sets)
    firsts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), 2 * keys), U64)
    for k in range(2 * keys):
        key = np.full(len(sets), k + 1, U64)
        for r in range(k * rows, (k + 1) * rows):
            key = mix(key ^ np.minimum.reduceat(all_shingles * factors[r] + added[r], firsts))
        out[:, k] = key
    return out


def _features(size: int, keys: int, rows: int):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = list(shingle_sets(part.column(1), size))
                full = [i for i, s in enumerate(sets) if len(s)]
                table = np.zeros((len(sets), 2 * keys), U64)
                if full:
                    table[full] = _minhash_keys([sets[i] for i in full], keys, rows)
                sides = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys), pa.array(np.ascontiguousarray(side).view(np.int64).ravel())) for side in (table[:, :keys], table[:, keys:])]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), *sides], ["doc_id", "n_shingles", "digest", "a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), size)], pa.binary())], ["id", "shingles"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
            sizes = [len(x) for x in sets]
            ids, parts = (np.repeat(part.column(k).to_numpy(), sizes) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(parts), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets))], ["id", "component", "n", "e"])


def _across(sets: DataFrame, share: int, whole: int) -> DataFrame:
    """(p, id): all pairs of ``sets`` (id, component, shingles) that could be links across components.

    An exact prefix filter. Only shingles found in several components can be shared across them; with
    m of these in a set of n, a link needs m >= share * n / whole. If so, the two sets of a link
    have one of their rarest m - share * n / whole + 1 such shingles in common.
    """
    needed = F.ceil(F.col("n") * share / whole)
    every = materialise(sets.select("id", "component", "shingles").mapInArrow(_elements, "id long, component long, n long, e long"), "elements")
    spread = every.groupBy("e").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("e", "f")
    own = every.join(spread, "e").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("es"))
    own = own.withColumn("m", F.size("es")).where(F.col("m") >= needed)
    # rest: shingles from this one on, so at the first one in common the most that two sets can share
    prefix = own.select("id", "component", "n", "m", F.posexplode(F.slice("es", 1, (F.col("m") - needed + 1).cast("int"))).alias("at", "x"))
    prefix = materialise(prefix.select("id", "component", "n", (F.col("m") - F.col("at")).alias("rest"), "x.e"), "prefix")
    # by shingle: the most common component, and whether any partner could be near enough
    of = prefix.groupBy("e", "component").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.max("rest").alias("rest"))
    of = of.groupBy("e").agg(F.max(F.struct("c", "component")).alias("top"), F.min("n").alias("least"), F.max("rest").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    near = (whole + share) * F.least("rest", "most") >= share * (F.col("n") + F.greatest("least", needed))
    open_ = materialise(prefix.join(of.select("e", F.col("top.component").alias("usual"), "least", "most"), "e").where(near), "open")
    strange = open_.where("component <> usual").select("e", F.col("id").alias("p"), F.col("component").alias("pc"), F.col("n").alias("pn"), F.col("rest").alias("pr"))
    could = (F.col("component") != F.col("pc")) & ((whole + share) * F.least("rest", "pr") >= share * (F.col("n") + F.col("pn")))
    return strange.join(open_, "e").where(could).select(F.least("p", "id").alias("p"), F.greatest("p", "id").alias("id")).distinct()


def _confirm(share: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(whole * both >= share * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80, whole: int = 100, keys: int = KEYS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are what white space parts, with A-Z lower-cased; a document's set holds its distinct
    shingles of ``size`` words (with fewer words, the whole sequence). Two documents are linked if
    whole * intersection >= share * union, and component_id is the smallest doc_id reachable.
    Empty or null text: an empty set, linked with nothing. A null id: component_id null, kept.
    Rows that repeat an id count as that document. Other columns of ``docs`` are not read. Empty
    table: no rows.

    Equal sets are first reduced to one representative, so large groups of copies cost one row in
    all that follows. A bucket's members are compared with one of them, the one that shares most
    keys with others, so a group of near copies costs one comparison a member. What buckets still
    join although it is not linked yet goes through an exact filter, which leaves no link out.
    """
    docs = wide(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = materialise(docs.mapInArrow(_features(size, keys, rows), _FEATURES), "features")
    first = features.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "a", "b")).alias("r"))
    reps = materialise(first.select("digest", F.col("r.doc_id").alias("id"), F.col("r.n_shingles").alias("n"), "r.a", "r.b"), "reps")

    # a table can only be shared by two if both its keys are
    single = reps.select("id", "n", F.posexplode(F.concat("a", "b")).alias("place", "key"))
    shared = single.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    hits = single.join(shared, "key").groupBy("id", "n").agg(F.sum("c").alias("shares"), *(F.collect_list(F.when(on, F.col("key"))).alias(c) for c, on in (("a", F.col("place") < keys), ("b", F.col("place") >= keys))))
    tables = hits.select("id", "n", "shares", "b", F.explode("a").alias("x")).select("id", "n", "shares", "x", F.explode("b").alias("y"))
    members = materialise(tables.select(F.xxhash64("x", "y").alias("bucket"), "id", "n", "shares"), "tables")

    pivots = members.groupBy("bucket").agg(F.max(F.struct("shares", (-F.col("id")).alias("i"), "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
    members = materialise(members.join(pivots.select("bucket", (-F.col("p.i")).alias("p"), F.col("p.n").alias("pn")), "bucket").select("bucket", "id", "n", "p", "pn"), "members")
    near = whole * F.least("n", "pn") >= share * F.greatest("n", "pn")
    pairs = materialise(members.where((F.col("id") != F.col("p")) & near).select("p", "id").distinct(), "pairs")
    wanted = materialise(members.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(size), "id long, shingles binary")
    sets = materialise(sets, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("p"), F.col("shingles").alias("others")), "p")
        return both.select("p", "id", "shingles", "others").mapInArrow(_confirm(share, whole), "p long, id long").select(F.col("p").alias("u"), F.col("id").alias("v"))

    labels = components(materialise(confirmed(pairs), "links"))
    tagged = members.select("bucket", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = tagged.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    left = materialise(tagged.join(split, "bucket", "left_semi").select("id", "component").distinct(), "left")
    if not left.isEmpty():
        pairs = materialise(_across(sets.join(left, "id"), share, whole), "pairs")
        labels = components(materialise(confirmed(pairs), "links"), labels)
    of_rep = reps.select("digest", "id").join(labels, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = features.select("doc_id", "n_shingles", "digest").join(of_rep, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for documents that a smaller id of their component stands for."""
    id_col = params.get("id_col", "doc_id")
    out = near_duplicates(docs, **params).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(materialise(out, "copies"), id_col, "left_anti").select(*docs.columns)
