"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so that equal texts are neighbours. Splitters are
found by rounds: each counts the exact bytes below many candidate keys, in all partitions, and the
next one probes only the brackets that hold a target, until every splitter meets the tolerance.
Shards are parted first, then each of them into pieces. One exchange moves each row to its piece,
and a sort within pieces numbers the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Bytes of a piece, the unit of the final sort; more pieces a shard than MOST_PIECES are not made.
PIECE_BYTES, MOST_PIECES = 16 << 20, 4096
PROBES = 1 << 14
#: Share of a shard that keeping equal texts in one shard may cost.
TOLERANCE = 0.01

#: Keys are pairs of longs, as one whole number on the driver and as 16 ordered bytes in tasks.
_HALF, _SIGN = 1 << 64, 1 << 63


def _key(pair) -> int:
    return (pair[0] + _SIGN) * _HALF + pair[1] + _SIGN


def _halves(key: int) -> tuple[int, int]:
    return key // _HALF - _SIGN, key % _HALF - _SIGN


def _ordered(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    both = np.stack([high, low], 1).astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _probed(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], "S16")


def _histogram(probes: list[int]):
    """For each number of probes at or below a row's key: rows, bytes, least and greatest key."""
    cuts = _probed(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ls, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((ls, hs))
            hs, ls, sizes = hs[order], ls[order], sizes[order]
            at = np.searchsorted(cuts, _ordered(hs, ls), "right")
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(at)) - 1
            columns = [at[first], last - first + 1, np.add.reduceat(sizes, first) if len(first) else first, hs[first], ls[first], hs[last], ls[last]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["at", "n", "bytes", "h0", "l0", "h1", "l1"])

    return run


def _counted(keys: DataFrame, probes: list[int]) -> list:
    """Exact bytes of the cells between the probes, with their least and greatest keys, in order."""
    cells = keys.select("h", "doc_id", "size").mapInArrow(_histogram(probes), "at long, n long, bytes long, h0 long, l0 long, h1 long, l1 long")
    cells = cells.groupBy("at").agg(F.sum("bytes").alias("bytes"), F.min(F.struct("h0", "l0")).alias("lo"), F.max(F.struct("h1", "l1")).alias("hi")).collect()
    return sorted(cells, key=lambda r: r["at"])


def splitters(keys: DataFrame, targets: list[int], tolerance: int = 0, probes: int = PROBES) -> list[int]:
    """For each of the rising ``targets``, in bytes from 1 to the total, the key that parts the rows (h, doc_id, size) there.

    A splitter stands after the row with which the bytes reach its target, or at the nearer border of
    the rows with that row's h, if that costs ``tolerance`` bytes at most. Rows with one key are not parted.
    """
    ends = keys.agg(F.min(F.struct("h", "doc_id")).alias("lo"), F.max(F.struct("h", "doc_id")).alias("hi")).first()
    if not ends.lo:
        return []
    found: dict[int, int] = {}
    # the range of rows' keys that holds each target not yet met
    brackets = {(_key(ends.lo), _key(ends.hi)): list(range(len(targets)))}
    while brackets := {k: v for k, v in brackets.items() if v}:
        per = max(2, probes // len(brackets))
        asked = sorted({lo - (lo - hi) * k // per for lo, hi in brackets for k in range(1, per + 1)} | {lo for lo, _ in brackets})
        cells = _counted(keys, asked)
        upto = np.cumsum([r.bytes for r in cells])
        nearer: dict[tuple[int, int], list[int]] = {}
        for t in (t for own in brackets.values() for t in own):
            cell = cells[int(np.searchsorted(upto, targets[t], "left"))]
            lo, hi = _key(cell.lo), _key(cell.hi)
            if lo == hi:
                found[t] = hi + 1
            else:
                nearer.setdefault((lo, hi), []).append(t)
        brackets = nearer
    out = [found[t] for t in range(len(targets))]
    if tolerance and targets:
        high = [_halves(cut - 1)[0] for cut in out]
        borders = sorted({_key((h + k, -_SIGN)) for h in high for k in (0, 1)})
        below = bytes_below(keys, borders)
        for t, target in enumerate(targets):
            first, last = (_key((high[t] + k, -_SIGN)) for k in (0, 1))
            before = target - below[first] <= below[last] - target
            if (target - below[first] if before else below[last] - target) <= tolerance:
                out[t] = first if before else last
    return sorted(out)


def bytes_below(keys: DataFrame, cuts: list[int]) -> dict[int, int]:
    """The bytes of the rows with keys below each of ``cuts``."""
    cuts = sorted(set(cuts))
    sums = {r["at"]: r.bytes for r in _counted(keys, cuts)}
    return dict(zip(cuts, np.cumsum([sums.get(i, 0) for i in range(len(cuts))]).tolist()))


def pieces_of(keys: DataFrame, bounds: list[int], total: int, per: int) -> list[int]:
    """The splitters of ``per`` pieces of nearly equal bytes in each shard; every ``per``-th is one of ``bounds``."""
    if per == 1 or not bounds:
        return bounds
    below = bytes_below(keys, bounds)
    ends = [0, *(below[cut] for cut in bounds), total]
    targets = [a + -(-k * (b - a) // per) for a, b in zip(ends, ends[1:]) if b > a for k in range(1, per)]
    inner = iter(splitters(keys, targets))
    out: list[int] = []
    for shard, (a, b) in enumerate(zip(ends, ends[1:])):
        edge = bounds[min(shard, len(bounds) - 1)]  # a shard without rows has no targets
        own = [next(inner) if b > a else edge for _ in range(per - 1)]
        out += [min(cut, edge) for cut in own] + [edge] if shard < len(bounds) else own
    return out


def _place(cuts: list[int], base: list[int]):
    """struct(piece, first) of a row's key: its piece, and the slot of that piece's first row."""
    probed, firsts = _probed(cuts), np.array(base, np.int64)

    def run(hs: pa.Array, ls: pa.Array) -> pa.Array:
        at = np.searchsorted(probed, _ordered(hs.to_numpy(zero_copy_only=False), ls.to_numpy(zero_copy_only=False)), "right")
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int64)), pa.array(firsts[at])], ["piece", "first"])

    return F.arrow_udf(run, "struct<piece: bigint, first: bigint>")


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES, into: str = "placed") -> DataFrame:
    """``docs`` with a struct column ``into``: size, shard (from 0), slot (gapless from 0 in each shard).

    size is the text's UTF-8 bytes (null: none) plus 1. Shards have nearly equal bytes: a boundary
    stands after the row that reaches its target, or, where this costs ``tolerance`` of a shard at
    most, at the nearer border of that row's group of equal texts. So equal texts stand together and
    only a group larger than that can be parted. Null ids sort first. Rows that repeat both id and text are not parted. An
    empty table stays empty. A column of ``docs`` named as ``into`` is replaced.
    """
    text = F.col(text_col).cast("string")
    high = F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long")
    low = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keys = materialise(docs.select(high.alias("h"), low.alias("doc_id"), text_size(text).alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = min(MOST_PIECES, max(1, -(-total // (shards * piece_bytes))))
    # the shards' boundaries come first, so that they don't depend on the pieces
    bounds = splitters(keys, [-(-i * total // shards) for i in range(1, shards)], int(total * tolerance / shards))
    cuts = pieces_of(keys, bounds, total, per)
    pieces = len(cuts) + 1
    held = keys.groupBy(_place(cuts, [0] * pieces)("h", "doc_id")["piece"].alias("piece")).agg(F.count("*").alias("n")).collect()
    counts = {r.piece: r.n for r in held}
    base, slot = [], 0
    for piece in range(pieces):
        slot = 0 if piece % per == 0 else slot
        base.append(slot)
        slot += counts.get(piece, 0)
    placed = docs.withColumns({"__h": high, "__low": low, "__size": text_size(text)}).withColumn("__at", _place(cuts, base)("__h", "__low"))
    placed = placed.withColumns({"__piece": F.col("__at.piece"), "__first": F.col("__at.first")})
    order = Window.partitionBy("__piece").orderBy("__h", "__low")
    placed = placed.withColumn("__slot", (F.row_number().over(order) - 1 + F.col("__first")).cast("long"))
    at = F.struct(F.col("__size").alias("size"), F.floor(F.col("__piece") / per).cast("int").alias("shard"), F.col("__slot").alias("slot"))
    return placed.withColumn(into, at).drop("__h", "__low", "__size", "__at", "__piece", "__first", "__slot")


def write_shards(placed: DataFrame, path: str, into: str = "placed") -> None:
    """Write each shard's rows, in slot order within files, below ``shard=N``."""
    placed.withColumn("shard", F.col(into)["shard"]).sortWithinPartitions("shard", F.col(into)["slot"]).write.partitionBy("shard").parquet(path)
