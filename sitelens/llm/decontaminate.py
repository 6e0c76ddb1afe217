"""Benchmark decontamination by one Aho-Corasick automaton over normalised benchmark windows.

Texts and windows are normalised to words, and the automaton's symbols are numbers of the benchmark's
words, so one scan of a text finds every window, each at word borders, and a window takes as many
nodes as it has words. A node's branches are searched one by one and the root has one for each first
word, so the automaton reads only stretches all of whose neighbouring words are (by a table of hashed
pairs) neighbours in some window; no window can occur elsewhere. Word numbers of the hits lead back to
offsets in the original text. The automaton is built from at most ``block_bytes`` of windows; a larger benchmark is dealt into blocks of
that bound, and the hits of one block are written before the next one is read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, wide
from .words import LOWER, NON_WORD, bounds, hashes, pieces

WINDOW = 13
BLOCK_BYTES = 32 << 20
#: Bits of a slot in the table of pairs: 4 MB, of which a block of windows fills a tenth at most.
PAIR_BITS = 22

_TABLE = bytes(0x20 if NON_WORD[LOWER[c]] else int(LOWER[c]) for c in range(256))
#: A run of bytes that _TABLE keeps, as a pattern of characters.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_LISTS = {"spans": "array<struct<first: bigint, last: bigint, start: bigint, stop: bigint>>", "items": "array<string>"}
_HITS = "struct<n_words: bigint, " + ", ".join(f"{k}: {t}" for k, t in _LISTS.items()) + ">"
_SPAN = pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "stop")])
_ARROW_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_automata: dict = {}


def _words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words((text or "").encode())
                for k in range(max(1, len(words) - size + 1) if words else 0):
                    items.append(item or "")
                    windows.append(b" ".join(words[k : k + size]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary())], ["item", "win"])

    return run


def _pairs(words: np.ndarray) -> np.ndarray:
    """The slot of each two neighbouring words, given as hashes."""
    return (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - PAIR_BITS)


def _automaton(shared):
    """The worker's (automaton, numbers of words, table of pairs, words of the shortest window) of a broadcast block;
    an automaton of None without windows."""
    block = shared.value
    if block["key"] not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        symbols, at = block["symbols"].tolist(), block["at"]
        for number, (a, b) in enumerate(pairwise(at.tolist())):
            made.add_word(tuple(symbols[a:b]), number)
        near = np.zeros(1 << PAIR_BITS, bool)
        if symbols:
            made.make_automaton()
            inside = np.ones(len(symbols) - 1, bool)
            inside[at[1:-1] - 1] = False
            data = np.frombuffer(b" ".join(block["words"]), np.uint8)
            starts, ends, _ = bounds(data, np.array([0, len(data)]), NON_WORD)
            near[_pairs(hashes(data, starts, ends)[block["symbols"] - 1])[inside]] = True
        numbers = {w: k for k, w in enumerate(block["words"], 1)}
        _automata[block["key"]] = made if symbols else None, numbers, near, int(np.diff(at).min(initial=1 << 30))
    return _automata[block["key"]]


def _stretches(words: np.ndarray, at: np.ndarray, near: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, end) of runs of at least ``least`` words of one row that are neighbours in windows."""
    if not len(words):
        return []
    apart = ~near[_pairs(words)] if least > 1 else np.zeros(len(words) - 1, bool)
    borders = at[(at > 0) & (at < len(words))]
    apart[borders - 1] = True
    gaps = np.concatenate([[-1], np.flatnonzero(apart), [len(words) - 1]])
    return [(int(gaps[k]) + 1, int(gaps[k + 1]) + 1) for k in np.flatnonzero(np.diff(gaps) >= least)]


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: list[tuple[int, int]]) -> list[dict]:
    """Merged runs of hit words, with their code point offsets in the text ``data``."""
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    runs: list[list[int]] = []
    for first, last in sorted(found):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [{"first": a, "last": b, "start": int(points[starts[a]]), "stop": int(points[ends[b]])} for a, b in runs]


def _scan(shared):
    def hits(texts: pa.Array) -> pa.Array:
        (machine, numbers, near, least), block = _automaton(shared), shared.value
        size, names = np.diff(block["at"]), block["items"]
        out = []
        for begin, end, data, offsets in pieces(texts):
            data = LOWER[data]
            starts, ends, at = bounds(data, offsets, NON_WORD)
            found, owners = defaultdict(list), defaultdict(set)
            for a, b in _stretches(hashes(data, starts, ends), at, near, least) if machine is not None else ():
                row = int(np.searchsorted(at, a, "right")) - 1
                line = tuple(numbers.get(w, 0) for w in _words(data[starts[a] : ends[b - 1]].tobytes()))
                for last, number in machine.iter(line):
                    last += a - int(at[row])
                    found[row].append((last - int(size[number]) + 1, last))
                    owners[row].update(block["owners"][block["owners_at"][number] : block["owners_at"][number + 1]].tolist())
            for row in range(end - begin):
                own, text = slice(at[row], at[row + 1]), slice(offsets[row], offsets[row + 1])
                spans = _spans(data[text], starts[own] - offsets[row], ends[own] - offsets[row], found[row]) if row in found else []
                out.append({"n_words": int(at[row + 1] - at[row]), "spans": spans, "items": sorted(names[k] for k in owners[row]) if spans else []})
        return pa.array(out, _ARROW_HITS)

    return F.arrow_udf(hits, _HITS)


def _all_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int, block_bytes: int) -> tuple[DataFrame, int]:
    """The written table (win, items), and the number of blocks that it takes."""
    texts = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    windows = texts.mapInArrow(_windows(size), "item string, win binary").groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = materialise(windows, "windows")
    total = windows.agg(F.sum(F.octet_length("win") + 16 * F.size("items"))).first()[0] or 0
    return windows, 1 + total // block_bytes


def _block(windows: DataFrame, block: int, blocks: int):
    """The broadcast of a block, of a checked size: words and items once each, windows as numbers of these."""
    words: dict[bytes, int] = {}
    items: dict[str, int] = {}
    symbols, at, owners, owners_at = [], [0], [], [0]
    for row in windows.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == block).collect():
        symbols += [words.setdefault(w, len(words) + 1) for w in bytes(row.win).split()]
        owners += [items.setdefault(i, len(items)) for i in row["items"]]
        at.append(len(symbols))
        owners_at.append(len(owners))
    numbers = {k: np.array(v, np.int32) for k, v in (("symbols", symbols), ("at", at), ("owners", owners), ("owners_at", owners_at))}
    return windows.sparkSession.sparkContext.broadcast({"key": uuid.uuid4().hex, "words": list(words), "items": list(items), **numbers})


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap or touch as one."""
    last = lambda runs: F.element_at(runs, -1)

    def add(runs: Column, x: Column) -> Column:
        grown = F.struct(last(runs)["first"].alias("first"), F.greatest(last(runs)["last"], x["last"]).alias("last"), last(runs)["start"].alias("start"), F.greatest(last(runs)["stop"], x["stop"]).alias("stop"))
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown))
        return F.when(F.size(runs) == 0, F.array(x)).when(x["first"] <= last(runs)["last"] + 1, joined).otherwise(F.concat(runs, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.slice(spans, 1, 0), add)


def _n_hit(spans: Column) -> Column:
    words = F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"])))
    return F.size(F.array_distinct(words)).cast("long")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "hits") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, spans, items, n_hit, contaminated.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A window is ``size``
    consecutive words of a benchmark item; an item with fewer words is one window. A document word
    inside any occurrence of a window is hit; spans are merged runs of hit words (numbers of the
    first and last word, and code point offsets in the original text). contaminated: some word is
    hit, and at least one in twenty. Null or empty text: no words, not contaminated. Null item
    text: no window; null item id: listed as ''. Repeated items count once by id. An empty
    benchmark hits nothing. A column of ``docs`` named as ``into`` is replaced.
    """
    docs = wide(docs)
    windows, blocks = _all_windows(benchmark, item_col, item_text_col, size, block_bytes)
    text = F.col(text_col).cast("string")
    if blocks == 1:
        found = docs.withColumn(into, _scan(_block(windows, 0, 1))(text))
    else:
        parts = []
        for number in range(blocks):
            shared = _block(windows, number, blocks)
            parts.append(materialise(docs.select(F.md5(text).alias("k"), _scan(shared)(text).alias("h")).where(F.size("h.spans") > 0), "hits"))
            shared.destroy()
        merged = reduce(DataFrame.unionByName, parts).groupBy("k").agg(
            _merged(F.array_distinct(F.flatten(F.collect_set("h.spans")))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("h.items")))).alias("items"),
        )
        merged = merged.select(F.col("k").alias("__k"), F.struct("spans", "items").alias("__h"))
        found = docs.withColumn("__k", F.md5(text)).join(merged, "__k", "left")
        n_words = F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words")
        listed = [F.coalesce(F.col(f"__h.{k}"), F.array().cast(t)).alias(k) for k, t in _LISTS.items()]
        found = found.withColumn(into, F.struct(n_words, *listed)).drop("__k", "__h")
    h = F.col(into)
    found = found.withColumn(into, h.withField("n_hit", _n_hit(h["spans"])))
    rule = (h["n_hit"] > 0) & (20 * h["n_hit"] >= h["n_words"])
    return found.withColumn(into, h.withField("contaminated", rule))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    found = benchmark_hits(docs, benchmark, into="__hits", **params)
    return found.where(~F.col("__hits.contaminated")).select(*docs.columns)
