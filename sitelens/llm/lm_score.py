"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Texts are exploded to n-grams, a row for each different one of a document. These rows are dealt by the
n-gram's hash; the count table is their sum by hash, and a join gives each row the count of its n-gram,
from which the logarithms are summed per document. The most frequent n-grams, a bounded number, are
counted apart and sent to all tasks, so that neither a word pair in all documents nor a function word
is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, wide
from .words import LOWER, SPACES, U64, bounds, hashes, mix, pieces

ORDER, BACKOFF, MIN_COUNT = 2, 0.4, 1
#: n-grams that are counted apart, at most, and the bytes of text they are looked for in. What is looked for
#: decides only which way an n-gram's exact count takes.
FREQUENT, LOOKED_AT = 250_000, 16 << 20
#: n-grams of a partition, at most on average, so that its part of the count table fits into a task.
PART_GRAMS = 6_000_000


def count_table(grams: DataFrame) -> DataFrame:
    """(gram, count) from rows (gram, n)."""
    return grams.groupBy("gram").agg(F.sum("n").alias("count"))


def _row_keys(ids: pa.Array, texts: pa.Array) -> np.ndarray:
    """A number for each document; only rows that repeat both id and text share one."""
    out = [xxhash.xxh3_64_intdigest(f"{i}\n{t.as_py() or ''}".encode()) for i, t in zip(ids.to_pylist(), texts)]
    return np.array(out, U64)


def _grams(batch: pa.RecordBatch, order: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """(first row, end row, words before each row, hashes of the n-grams of each order by their first word)."""
    for first, end, data, offsets in pieces(batch.column(1)):
        data = LOWER[data]
        starts, ends, at = bounds(data, offsets, SPACES)
        words = hashes(data, starts, ends)
        grams = [words]
        for n in range(2, order + 1):
            grams.append(mix(grams[-1][: max(0, len(words) - n + 1)] * U64(0xD6E8FEB86659FD93) + words[n - 1 :] + U64(n)))
        yield first, end, at, grams


def _distinct(at: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, gram, occurrences, coefficient of the count's logarithm) of each row's different n-grams.

    Where all n-grams are in the model, a text's score is the sum over the n-grams of the highest order, less the
    sum over their contexts; what its first words add cancels but for the first context, which counts in full.
    """
    order, lengths = len(grams), np.diff(at)
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    left = at[1:][row_of] - np.arange(len(row_of))  # words to the row's end
    rows, kinds, times, factors = [], [], [], []
    for n, own in enumerate(grams, 1):
        whole = np.flatnonzero(left[: len(own)] >= n)
        row, gram = row_of[whole], own[whole]
        if n == order:
            factor = np.ones(len(whole), np.int64)
        elif n == order - 1:
            factor = (whole == at[row]).astype(np.int64) - (left[whole] > n)
        else:  # all of a text that is shorter than a context
            factor = (lengths[row] == n).astype(np.int64)
        both = gram + mix(row.astype(U64))  # one number for a row and an n-gram
        by = np.argsort(both)
        both, factor = both[by], factor[by]
        firsts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(row) else np.zeros(0, np.int64)
        rows.append(row[by[firsts]])
        kinds.append(gram[by[firsts]])
        times.append(np.diff(np.append(firsts, len(row))))
        factors.append(np.add.reduceat(factor, firsts) if len(firsts) else factor)
    return tuple(map(np.concatenate, (rows, kinds, times, factors)))


_begun: list = [None, None]


def _beginnings(frequent: np.ndarray) -> np.ndarray:
    """Which leading 22 bits occur among the frequent n-grams."""
    if _begun[0] is not frequent:
        table = np.zeros(1 << 22, bool)
        table[frequent >> U64(42)] = True
        _begun[:] = frequent, table
    return _begun[1]


def _found(frequent: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each kind in the sorted ``frequent``, and whether it is there."""
    at = np.zeros(len(kinds), np.int64)
    maybe = np.flatnonzero(_beginnings(frequent)[kinds >> U64(42)])
    at[maybe] = np.minimum(np.searchsorted(frequent, kinds[maybe]), max(0, len(frequent) - 1))
    maybe = maybe[frequent[at[maybe]] == kinds[maybe]] if len(frequent) else maybe
    there = np.zeros(len(kinds), bool)
    there[maybe] = True
    return at, there


def _counted_apart(order: int, frequent):
    """Counts of the frequent n-grams, one row for each and task; without ``frequent``, of all n-grams by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None if frequent is None else np.zeros(len(frequent.value), np.int64)
        for batch in batches:
            for _, _, at, grams in _grams(batch, order):
                _, kinds, times, _ = _distinct(at, grams)
                if sums is None:
                    yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(times)], ["gram", "n"])
                else:
                    place, there = _found(frequent.value, kinds)
                    sums += np.bincount(place[there], weights=times[there], minlength=len(sums)).astype(np.int64)
        if sums is not None:
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(frequent.value[used].view(np.int64)), pa.array(sums[used])], ["gram", "n"])

    return run


def _exploded(order: int, counts):
    """A row for each document and n-gram that isn't counted apart; v holds occurrences and coefficient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, _ = counts.value
        for batch in batches:
            keys = _row_keys(batch.column(0), batch.column(1))
            for first, end, at, grams in _grams(batch, order):
                row, kinds, times, factors = _distinct(at, grams)
                rest = ~_found(frequent, kinds)[1]
                packed = times[rest] << 32 | factors[rest] & 0xFFFFFFFF
                by = np.argsort(row[rest], kind="stable")  # a document's rows together, which packs well
                columns = kinds[rest].view(np.int64), keys[first:end].view(np.int64)[row[rest]], packed
                yield pa.RecordBatch.from_arrays([pa.array(c[by]) for c in columns], ["gram", "key", "v"])

    return run


def _roster(order: int, counts):
    """A row for each document: words, and what the n-grams that are counted apart add to its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, logs = counts.value
        for batch in batches:
            keys = _row_keys(batch.column(0), batch.column(1)).view(np.int64)
            for first, end, at, grams in _grams(batch, order):
                row, kinds, _, factors = _distinct(at, grams)
                place, there = _found(frequent, kinds)
                part = np.zeros(end - first)
                np.add.at(part, row[there], factors[there] * logs[place[there]] if len(frequent) else 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(keys[first:end]), pa.array(np.diff(at)), pa.array(part)], ["doc_id", "key", "n_words", "part"])

    return run


def _frequent(rows: DataFrame, order: int, most: int, looked_at: int):
    """The broadcast (sorted n-grams, exact counts in the whole corpus) of at most ``most`` frequent n-grams."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = int(min(1.0, looked_at / max(1, size)) * (1 << 30))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) <= share)
    seen = count_table(some.mapInArrow(_counted_apart(order, None), "gram long, n long")).where("count > 2")
    kinds = np.array([r.gram for r in seen.orderBy(F.desc("count"), "gram").limit(most).collect()], np.int64).view(U64)
    shared = spark.sparkContext.broadcast(np.sort(kinds))
    exact = {r.gram: r["count"] for r in count_table(rows.mapInArrow(_counted_apart(order, shared), "gram long, n long")).collect()}
    counts = np.array([exact.get(g, 1) for g in shared.value.view(np.int64).tolist()], np.int64)
    return spark.sparkContext.broadcast((shared.value, np.log10(counts)))


def _own_model(rows: DataFrame, order: int, frequent: int, looked_at: int) -> DataFrame:
    """Scores where every n-gram of the texts is in the model, so that no word backs off."""
    apart = _frequent(rows, order, frequent, looked_at)
    roster = materialise(rows.mapInArrow(_roster(order, apart), "doc_id long, key long, n_words long, part double"), "roster")
    words = float(roster.agg(F.sum("n_words")).first()[0] or 0)
    # one exchange by hash serves the count table and the join; both read all its columns and rows, else it would be made twice
    grams = rows.mapInArrow(_exploded(order, apart), "gram long, key long, v long").where("gram is not null and key is not null")
    grams = grams.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(order * words) // PART_GRAMS), "gram")
    counts = grams.groupBy("gram").agg(F.sum(F.shiftright("v", 32)).alias("count"), F.count("key").alias("documents")).where("documents > 0")
    factor = F.shiftright(F.shiftleft("v", 32), 32)
    sums = grams.join(counts.hint("shuffle_hash"), "gram").groupBy("key").agg(F.sum(factor * F.log10("count")).alias("rest"))
    # rows that repeat id and text share a key, and each gets its part
    same = roster.groupBy("key").agg(F.count("*").alias("same"))
    score = F.col("part") + F.coalesce(F.col("rest") / F.col("same"), F.lit(0.0)) - F.log10(F.lit(words))
    out = roster.join(sums.join(same, "key"), "key", "left")
    return out.select("doc_id", "n_words", F.when(F.col("n_words") > 0, score).otherwise(0.0).alias("log10_score"))


def _windows(order: int):
    """A row for each place of a text and each n-gram that ends there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _row_keys(batch.column(0), batch.column(1)).view(np.int64)
            for first, end, at, grams in _grams(batch, order):
                lengths = np.diff(at)
                row_of = np.repeat(np.arange(first, end), lengths)
                before = np.arange(len(row_of)) - np.repeat(at[:-1], lengths)
                for n in range(1, order + 1):
                    here = np.flatnonzero(before >= n - 1)
                    columns = keys[row_of[here]], before[here].astype(np.int32), np.full(len(here), n, np.int32), grams[n - 1][here - n + 1].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "place", "n", "gram"])

    return run


def _any_model(rows: DataFrame, model: DataFrame, order: int, backoff: float, min_count: int) -> DataFrame:
    """Scores by a join of all n-grams that end at each word with the count table."""
    none = rows.sparkSession.sparkContext.broadcast((np.zeros(0, U64), np.zeros(0)))
    roster = materialise(rows.mapInArrow(_roster(order, none), "doc_id long, key long, n_words long, part double"), "roster")
    texts = roster if model is rows else model.mapInArrow(_roster(order, none), "doc_id long, key long, n_words long, part double")
    words = float(texts.agg(F.sum("n_words")).first()[0] or 0)
    table = count_table(model.mapInArrow(_exploded(order, none), "gram long, key long, v long").select("gram", F.shiftright("v", 32).alias("n")))
    table = materialise(table, "counts")
    asked = rows.mapInArrow(_windows(order), "key long, place int, n int, gram long")
    seen = asked.join(table, "gram", "left").select("key", "place", "n", "count").repartition("key")
    by_place = seen.groupBy("key", "place").agg(*(F.max(F.when(F.col("n") == n, F.col("count"))).alias(f"c{n}") for n in range(1, order + 1)))
    # an n-gram's context is the shorter n-gram that ends one word before
    earlier = Window.partitionBy("key").orderBy("place")
    most = F.least("place", F.lit(order - 1))
    found = [F.when(F.col("c1") >= 1, F.log10(F.col("c1") / F.lit(words)) + most * F.log10(F.lit(backoff)))]
    for n in range(2, order + 1):
        share = F.col(f"c{n}") / F.lag(f"c{n - 1}").over(earlier)
        found.insert(0, F.when(F.col(f"c{n}") >= min_count, F.log10(share) + (most - (n - 1)) * F.log10(F.lit(backoff))))
    sums = by_place.select("key", F.coalesce(*found).alias("s")).groupBy("key").agg(F.sum("s").alias("log10_score"), F.count_if(F.col("s").isNull()).alias("n_unknown"))
    out = roster.join(sums, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("log10_score", F.lit(0.0)).alias("log10_score"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"))


def stupid_backoff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT, model: DataFrame | None = None, frequent: int = FREQUENT, looked_at: int = LOOKED_AT) -> DataFrame:
    """(doc_id, n_words, log10_score) for every row: the sum of log10 S over the words of the text.

    Words are what white space parts, with A-Z lower-cased. Counts are over all rows of ``model`` (its column
    ``text_col``), which is ``docs`` itself if not given. S(w | context) is count(context w) / count(context) for
    the longest context of at most order - 1 words whose n-gram occurs ``min_count`` times or more (single words:
    once), times ``backoff`` for every word the context was cut by; the words at a text's start have shorter
    contexts, without penalty. In a model of its own text every n-gram occurs, so with ``min_count`` 1 nothing
    is cut and the sum needs the counts of the two highest orders only. With another model a column n_unknown
    counts the words that it doesn't hold, which add nothing to the score.

    Null or empty text: no words, score 0. Null ids keep a row; repeated rows are counted and scored each. Empty
    table: no rows. n-grams are known by 64-bit hashes. ``frequent`` bounds the n-grams that are broadcast.
    """
    slim = lambda frame, key: wide(frame).select(key.cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = slim(docs, F.col(id_col))
    if model is None and min_count <= 1 and order > 1:
        return _own_model(rows, order, frequent, looked_at)
    out = _any_model(rows, rows if model is None else slim(model, F.lit(0)), order, backoff, min_count)
    return out.drop("n_unknown") if model is None else out
