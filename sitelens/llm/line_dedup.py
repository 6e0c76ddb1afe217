"""Substring dedup by hashed lines and sentences.

Units are lines with a word and, within a line of several, sentences. A unit is normalised (case
folded, letters and digits only, single spaces) and hashed to 128 bits; of all units with a digest,
the earliest by (doc_id, offset) stays and the others are cut out of their texts, with their original
offsets. A short sentence counts together with the longer ones around it in its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, wide

#: A sentence of fewer words inside a longer line repeats by chance; it is a repeat only between repeated neighbours.
MIN_WORDS = 5

_LINE = re.compile(r"[^\n]+")
#: A run of marks is looked at once, from its first mark.
_SENTENCE = re.compile(r"[.!?]{2,}+(?=\s)|\S(?:.*?(?:(?<![.!?])[.!?]++(?=\s)|[。！？]++)|.*)", re.S)
_WORD = re.compile(r"\w+")
#: Letters of scripts that put no space between words; each counts as a word.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _digest(words: str) -> bytes:
    return xxhash.xxh3_128_digest(words.encode("utf-8", "surrogatepass"))


def _long(words: list[str], joined: str, min_words: int) -> bool:
    return len(words) >= min_words or not joined.isascii() and len(words) + len(_UNSPACED.findall(joined)) >= min_words


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of each unit; a line of one sentence is one unit.

    The digest of a sentence of fewer than ``min_words`` words covers all from the longer sentence
    before it to the longer one after it; where a side has none, it is no unit of its own.
    """
    for line in _LINE.finditer(text):
        spans = [(m.start(), m.end()) for m in _SENTENCE.finditer(text, line.start(), line.end())]
        found = [_WORD.findall(text[start:end].casefold()) for start, end in spans]
        if len(spans) > 1:
            short: list[tuple[int, int, str]] = []
            before = None  # the longer sentence before
            for (start, end), words in zip(spans, found):
                joined = " ".join(words)
                if not _long(words, joined, min_words):
                    if words and before is not None:
                        short.append((start, end, joined))
                    continue
                if short:
                    around = _digest("\n".join([before, *(s[2] for s in short), joined]))
                    for k, (a, b, _) in enumerate(short):
                        yield a, b, xxhash.xxh3_128_digest(around + k.to_bytes(4, "little"))
                    short = []
                before = joined
                yield start, end, _digest(joined)
        whole = " ".join(w for words in found for w in words)
        if whole:
            yield spans[0][0], spans[-1][1], _digest(whole)


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                ids, starts, ends, his, los = [], [], [], [], []
                part = batch.slice(at, 1024)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    for start, end, digest in units(text.as_py() or "", min_words):
                        ids.append(doc)
                        starts.append(start)
                        ends.append(end)
                        his.append(digest)
                halves = np.frombuffer(b"".join(his), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1))], ["doc_id", "start", "stop", "h", "l"])

    return run


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, stop, keeper_id, keeper_start): every unit that an earlier one repeats.

    Offsets are code points of the original text, stop exclusive. Earliest is by (doc_id, start).
    Null ids take no part; null or empty texts and an empty table have no units. Rows that repeat
    an id count as one document with their texts laid over each other: a unit is never a repeat of
    one at its own id and offset. Other columns are not read.
    """
    rows = wide(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    found = materialise(rows.mapInArrow(_units(min_words), "doc_id long, start int, stop int, h long, l long"), "units")
    first = found.groupBy("h", "l").agg(F.min(F.struct("doc_id", "start")).alias("k"), F.count("*").alias("c")).where("c > 1")
    first = first.select("h", "l", F.col("k.doc_id").alias("keeper_id"), F.col("k.start").alias("keeper_start"))
    again = found.join(first, ["h", "l"]).where("doc_id <> keeper_id or start <> keeper_start")
    return again.select("doc_id", "start", "stop", "keeper_id", "keeper_start")


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts.to_pylist(), spans.to_pylist()):
        if text is not None and cuts:
            at, kept = 0, []
            for cut in cuts:
                kept.append(text[at : max(at, cut["start"])])
                at = max(at, cut["stop"])
            text = "".join([*kept, text[at:]])
        out.append(text)
    return pa.array(out, pa.string())


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, into: str = "removed") -> DataFrame:
    """``docs`` with the repeats cut from the text, and in ``into`` the spans removed from the original text.

    A unit goes if an equal one is earlier by (doc_id, start), be that one a unit of its own or part of a line that
    goes itself. Null ids and null or empty texts stay as they are, with null in ``into``; rows that repeat an id lose
    the same spans. A column of ``docs`` named as ``into`` is replaced. An empty table stays empty.
    """
    spans = repeated_units(docs, id_col, text_col, min_words).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__cuts"))
    joined = docs.withColumn("__id", F.col(id_col).cast("long")).join(spans.withColumnRenamed("doc_id", "__id"), "__id", "left")
    cut = F.arrow_udf(_cut, "string")(F.col(text_col), F.col("__cuts"))
    return joined.withColumn(text_col, cut).select(*[c for c in docs.columns if c != into], F.col("__cuts").alias(into))
