"""Packing of tokenised documents into windows by non-negative least squares.

Whole windows of a long document stand for themselves; what is left of each document is rounded up to a step of the
window. Shallow combinations of such lengths that fill a window are enumerated, and how often each one is used is solved
by non-negative least squares against the histogram of lengths, then rounded down. Documents are dealt to the
combinations' places by their number within their length. The residual, documents that no combination took, is cut and
poured into what rounding left free, then into windows of its own, the last of which is cut at powers of two, at which no
padding is needed. Only the histogram, of at most a row a length, comes to the driver.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import materialise, wide
from .token_count import _open

WINDOW, STEPS, END = 4096, 128, 2
#: Words, and parts of words, whose ids a worker remembers; they are forgotten together when there are more.
WORDS, PARTS = 400_000, 1_000_000
#: Bytes of texts that are encoded together; a longer single text makes a longer piece.
TOGETHER = 4 << 20
#: Sequences of one block of the prefix scan over what is free.
BLOCK = 4096

_worker: dict = {}
#: An id that no vocabulary has, between the ids of two words.
_NONE = (1 << 32) - 1
_MARK = np.array([_NONE], "<u4").tobytes()


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, each distinct part of a word encoded once.

    For vocabularies that never join text across white space: what stands between white space is encoded on its own. Where
    the file names a pattern of parts and a mark of their ends, words are taken apart by it, and many parts are encoded at once.
    """

    def __init__(self, lines: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known, self.parts = Tokenizer.from_str(lines), {}, {" ": _MARK}
        told = json.loads(lines)
        self.added = [t["content"] for t in told["added_tokens"]]
        suffix = told["model"].get("end_of_word_suffix")
        found = re.findall(r'"type": ?"Split", ?"pattern": ?\{"Regex": ?("(?:[^"\\]|\\.)*")\}, ?"behavior": ?"Removed", ?"invert": ?true', json.dumps(told["pre_tokenizer"]))
        self.pattern = regex.compile(json.loads(found[0]) + "| ") if suffix and len(found) == 1 else None
        if self.pattern:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 1000):
            some = parts[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            whole = len(stops) == len(some) and stops[-1] == len(ids)
            self.parts.update(zip(some, map(np.ndarray.tobytes, np.split(ids, stops[:-1])) if whole else self._one_by_one(some)))

    def learn(self, words: list[str]) -> None:
        """Make the ids of distinct words known. All is done for many words at once; those that are odd are set apart only where there are any."""
        fresh = list(set(words).difference(self.known))
        if len(self.known) + len(fresh) > WORDS:
            self.known.clear()
            fresh = words
        if len(self.parts) > PARTS:
            self.parts = {" ": _MARK}
        text = " ".join(fresh)
        if self.pattern is None or not text.isprintable() or any([t in text for t in self.added]):
            alone = [w for w in fresh if self.pattern is None or not w.isprintable() or any([t in w for t in self.added])]
            self.known.update(zip(alone, self._one_by_one(alone)))
            fresh = [w for w in fresh if w not in self.known]
        # a word of letters is one part, which Python lower-cases as the tokenizer does but for a last sigma and what isn't composed
        alike = "Σ" not in text and unicodedata.is_normalized("NFC", text)
        plain = list(filter(str.isalpha, fresh)) if alike else [w for w in fresh if w.isalpha() and w.isascii()]
        if plain:
            lower = " ".join(plain).lower().split(" ")
            self._learn_parts(list(set(lower).difference(self.parts)))
            self.known.update(zip(plain, map(self.parts.__getitem__, lower)))
        mixed = list(set(fresh).difference(plain))
        if mixed:
            # all of them as one text, a space between two words, which is a part of its own
            parts = self.pattern.findall(self.tokenizer.normalizer.normalize_str(" ".join(mixed)))
            self._learn_parts(list(set(parts).difference(self.parts)))
            ids = b"".join(map(self.parts.__getitem__, parts)) + _MARK
            stops = (4 * np.flatnonzero(np.frombuffer(ids, "<u4") == _NONE)).tolist()
            self.known.update(zip(mixed, [ids[a:b] for a, b in zip([0, *(x + 4 for x in stops)], stops)]))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, null as empty: words are numbered, each number's ids looked up once, and gathered."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = lists.flatten().dictionary_encode()
        names, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        self.learn(names)
        made = [self.known[w] for w in names]
        flat = np.frombuffer(b"".join(made), "<u4")
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts = np.cumsum(sizes) - sizes
        own = sizes[at]
        ends = np.cumsum(own)
        kind = np.int32 if len(ends) and ends[-1] < 1 << 31 else np.int64
        places = np.repeat((starts[at] - (ends - own)).astype(kind), own)
        places += np.arange(len(places), dtype=kind)
        ids = flat[places]
        borders = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            yield ids[a:b]


def _encoded(encoder: Encoder, texts: pa.Array) -> Iterator[np.ndarray]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // TOGETHER
    borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(borders[:-1], borders[1:]):
        yield from encoder.encode(texts.slice(a, b - a))


_TOKENS = "part int, at long, doc_id long, n_tokens long, ids binary, whole array<long>, whole_before long, rest int, rest_crc long, bin int, ordinal long"


def tokenise(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, window: int = WINDOW, steps: int = STEPS) -> DataFrame:
    """A written row for every row of ``docs``: its ids, with the end id last (ids, little-endian: 16-bit if all ids fit,
    else 32-bit), and what packing needs of them: where it was written (part, at), checksums of its whole windows
    and of the rest, and its number among those of its part with as long a rest (bin, ordinal).

    ``vocabulary`` is a tokenizer file, needed on the driver only, whose words don't reach across white space. Null text is
    empty and has the end id only. Null ids and repeated rows keep a row each; other columns are not read.
    """
    where, name = _open(vocabulary)
    with where.open_input_stream(name) as source:
        lines = source.read().decode()
    shared = docs.sparkSession.sparkContext.broadcast(lines)
    key = zlib.crc32(lines.encode())
    unit = window // steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _worker.get("key") != key:
            _worker.update(key=key, encoder=Encoder(shared.value))
        encoder = _worker["encoder"]
        narrow = encoder.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16
        part, at, before, numbers = TaskContext.get().partitionId(), 0, 0, [0] * (steps + 1)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), _encoded(encoder, batch.column(1))):
                ids = np.append(ids, np.uint32(end))
                count, rest = divmod(len(ids), window)
                whole = [zlib.crc32(ids[window * k : window * (k + 1)]) for k in range(count)]
                b = -(-rest // unit)
                kept = (ids.astype("<u2") if narrow else ids).tobytes()
                rows.append((part, at, doc_id, len(ids), kept, whole, before, rest, zlib.crc32(ids[window * count :]), b, numbers[b]))
                at, before, numbers[b] = at + 1, before + count, numbers[b] + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = [c.split()[0] for c in _TOKENS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    rows = wide(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, _TOKENS), "tokens")


def combinations(steps: int = STEPS) -> np.ndarray:
    """Rows of counts of each length 1..steps that fill ``steps``: of one, two or three parts, and as many of one length as fit with one of what is left."""
    found = {(steps,)}
    found |= {tuple(sorted((a, b, steps - a - b))) for a in range(1, steps // 3 + 1) for b in range(a, (steps - a) // 2 + 1)}
    found |= {tuple(sorted([a] * k + [steps - a * k] * (a * k < steps))) for a in range(1, steps) for k in range(1, steps // a + 1)}
    out = np.zeros((len(found), steps + 1))
    for row, parts in zip(out, sorted(found)):
        np.add.at(row, list(parts), 1)
    return out[:, 1:]


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The x >= 0 that makes |a x - b| least, by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(free, -np.inf, a.T @ (b - a @ x))
        best = int(slope.argmax())
        if slope[best] <= small:
            break
        free[best] = True
        while free.any():
            y = np.zeros_like(x)
            y[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if y[free].min() > 0:
                x = y
                break
            down = free & (y <= 0)
            x = x + (y - x) * np.min(x[down] / np.maximum(x[down] - y[down], 1e-300))
            free &= x > 1e-12
            x[~free] = 0
    return x


def repeats(histogram: np.ndarray, tokens: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, times): how often each is used, so that no length is used more often than it occurs, and the tokens
    of the rest are enough for what rounding leaves free. ``histogram`` and ``tokens`` count documents and tokens of each length."""
    rows = combinations(len(histogram))
    solved = least_squares(rows.T, histogram.astype(float)) if histogram.any() else np.zeros(len(rows))
    mean = tokens / np.maximum(histogram, 1)
    share = 1.0
    while True:
        left, times = histogram.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        for j in np.argsort(-solved, kind="stable")[: np.count_nonzero(solved)]:
            needs = rows[j] > 0
            times[j] = min(int(solved[j] * share + 1e-6), int((left[needs] // rows[j][needs]).min()))
            left -= (times[j] * rows[j]).astype(np.int64)
        free = window * times.sum() - (times @ rows) @ mean
        if free <= left @ mean or not times.any():
            return rows[times > 0], times[times > 0]
        share *= 0.95


def _before(sums: DataFrame, by: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``sums`` with the sum of ``value`` over the rows before, in the order of ``by``; a row a part or block, not a document."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, by, F.coalesce(F.sum(value).over(w), F.lit(0)).alias("before"))


def _numbers(ids: pa.BinaryScalar, n: int) -> np.ndarray:
    """The n ids that were written in 16 or in 32 bits."""
    raw = ids.as_buffer()
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for ids, n, starts, lengths in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))):
            own = _numbers(ids, n)
            made.append([zlib.crc32(own[s : s + length].tobytes()) for s, length in zip(starts, lengths)])
        kept = list(range(4, batch.num_columns)) + [2, 3]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(made, pa.list_(pa.int64()))], [*(batch.schema.names[k] for k in kept), "crcs"])


def pack(tokens: DataFrame, window: int = WINDOW, steps: int = STEPS) -> DataFrame:
    """(part, at, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every piece of every row of ``tokens`` (see ``tokenise``).

    Each id lies in one piece; offsets within a sequence have no gaps and sequence_ids count from 0. Every sequence holds
    ``window`` ids but for at most log2(window) ones, each of which holds another power of two. Pieces are whole windows of a
    long document; rests of documents, uncut; and pieces of the documents that no combination took. Empty table: no rows.
    """
    spark, unit = tokens.sparkSession, window // steps
    by_rest = {r.rest: r["count"] for r in tokens.where("rest > 0").groupBy("rest").count().collect()}
    histogram, sums = np.zeros(steps, np.int64), np.zeros(steps, np.int64)
    for rest, count in by_rest.items():
        histogram[-(-rest // unit) - 1] += count
        sums[-(-rest // unit) - 1] += count * rest
    offsets = _before(tokens.where("rest > 0").groupBy("part", "bin").count(), "part", "count", ("bin",))
    offsets = materialise(offsets, "offsets")
    placed = tokens.join(offsets, ["part", "bin"]).withColumn("index", F.col("before") + F.col("ordinal")).drop("before")

    rows, times = repeats(histogram, sums, window)
    while True:
        plan, used, base = [], np.zeros(steps, np.int64), 0
        for row, n in zip(rows.astype(int).tolist(), times.tolist()):
            for b in np.flatnonzero(row).tolist():
                plan.append((b + 1, int(used[b]), int(used[b] + n * row[b]), row[b], base))
                used[b] += n * row[b]
            base += n
        # a few hundred rows at most: a bounded number of combinations of a bounded number of lengths
        taken = spark.createDataFrame([(b + 1, int(u)) for b, u in enumerate(used)], "bin int, used long")
        known = placed.join(F.broadcast(taken), "bin")
        in_rests = known.where("index < used").agg(F.sum("rest")).first()[0] or 0
        free, left = window * base - in_rests, int(sums.sum()) - in_rests
        if free <= left:
            break
        times = times * 9 // 10  # the documents that were taken are shorter than the mean of their lengths
        rows, times = rows[times > 0], times[times > 0]

    held = ["part", "at", "doc_id", "n_tokens", "rest"]
    begins = F.col("n_tokens") - F.col("rest")
    parts = spark.createDataFrame(plan, "bin int, first long, stop long, need int, base long")
    fits = (F.col("bin") == F.col("of")) & (F.col("index") >= F.col("first")) & (F.col("index") < F.col("stop"))
    whole = placed.select(*held, "rest_crc", "bin", "index").join(F.broadcast(parts.withColumnRenamed("bin", "of")), fits)
    whole = whole.withColumn("sequence_id", F.col("base") + F.expr("(index - first) div need"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "index").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("offset", F.coalesce(F.sum("rest").over(inside), F.lit(0)))
    whole = materialise(whole.select(*held, "rest_crc", "sequence_id", "offset"), "whole")

    # free places one after another, and the tokens of the residual one after another
    ends = whole.groupBy("sequence_id").agg(F.sum("rest").alias("offset")).where(F.col("offset") < window)
    ends = ends.select("sequence_id", "offset", (F.lit(window) - F.col("offset")).alias("n"), F.expr(f"sequence_id div {BLOCK}").alias("block"))
    ends = materialise(ends, "free")
    blocks = _before(ends.groupBy("block").agg(F.sum("n").alias("s")), "block", "s")
    line = Window.partitionBy("block").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    places = ends.join(blocks, "block").withColumn("begin", F.col("before") + F.coalesce(F.sum("n").over(line), F.lit(0)))
    places = places.select("sequence_id", "offset", "begin", (F.col("begin") + F.col("n")).alias("stop"))
    residual = materialise(known.where("index >= used").select(*held), "residual")
    before = _before(residual.groupBy("part").agg(F.sum("rest").alias("s")), "part", "s")
    line = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    poured = residual.join(before, "part").withColumn("t0", F.col("before") + F.coalesce(F.sum("rest").over(line), F.lit(0)))
    poured = materialise(poured.select(*held, "t0", (F.col("t0") + F.col("rest")).alias("t1")), "poured")

    def cells(first: Column, stop: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / window), F.floor((stop - 1) / window)))

    low, high = F.greatest("t0", "begin"), F.least("t1", "stop")
    met = poured.where(F.col("t0") < free).withColumn("cell", cells(F.col("t0"), F.col("t1")))
    met = met.join(places.withColumn("cell", cells(F.col("begin"), F.col("stop"))), "cell").where((low < high) & (F.floor(low / window) == F.col("cell")))
    piece = ["part", "at", "doc_id", "n_tokens", "start", "length", "sequence_id", "offset"]
    met = met.select(*held[:4], (begins + low - F.col("t0")).alias("start"), (high - low).alias("length"), "sequence_id", (F.col("offset") + low - F.col("begin")).alias("offset"))
    # windows of the residual's own; the last one, if it isn't full, as powers of two
    own, tail = divmod(left - free, window)
    bits = [1 << k for k in range(window.bit_length()) if tail >> k & 1][::-1]
    stops = np.cumsum(bits).tolist()
    last = spark.createDataFrame([(own, base + own + k, s - b, s) for k, (b, s) in enumerate(zip(bits, stops))], "cell long, of long, begin long, stop long")
    rest = poured.where(F.col("t1") > free).withColumns({"u0": F.greatest(F.col("t0") - free, F.lit(0)), "u1": F.col("t1") - free})
    rest = rest.withColumn("cell", cells(F.col("u0"), F.col("u1"))).withColumn("x", F.greatest("u0", F.col("cell") * window)).withColumn("y", F.least("u1", (F.col("cell") + 1) * window))
    rest = rest.join(F.broadcast(last), "cell", "left")
    x, y = F.greatest("x", F.coalesce(F.col("cell") * window + F.col("begin"), "x")), F.least("y", F.coalesce(F.col("cell") * window + F.col("stop"), "y"))
    rest = rest.withColumns({"from": x, "to": y}).where("`from` < `to`")
    rest = rest.select(*held[:4], (begins + F.col("from") + free - F.col("t0")).alias("start"), (F.col("to") - F.col("from")).alias("length"), F.coalesce("of", F.lit(base) + F.col("cell")).alias("sequence_id"), (F.col("from") - F.col("cell") * window - F.coalesce("begin", F.lit(0))).alias("offset"))

    cut = met.select(*piece).unionByName(rest.select(*piece)).groupBy("part", "at").agg(F.array_sort(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("p"))
    cut = cut.join(known.where("index >= used").select("part", "at", "doc_id", "n_tokens", "ids"), ["part", "at"])
    cut = cut.select("ids", "n_tokens", "p.start", "p.length", "part", "at", "doc_id", F.col("n_tokens").alias("doc_tokens"), F.col("p.sequence_id").alias("sequences"), F.col("p.offset").alias("offsets"))
    cut = cut.mapInArrow(_crcs, "part int, at long, doc_id long, doc_tokens long, sequences array<long>, offsets array<long>, starts array<long>, lengths array<long>, crcs array<long>")
    cut = cut.select("part", "at", "doc_id", "doc_tokens", F.explode(F.arrays_zip("starts", "lengths", "crcs", "sequences", "offsets")).alias("p"))
    out = ["part", "at", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = cut.select("part", "at", "doc_id", F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), F.col("p.crcs").alias("ids_crc32"), "doc_tokens", F.col("p.sequences").alias("sequence_id"), F.col("p.offsets").alias("offset"))

    uncut = whole.select("part", "at", "doc_id", begins.alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")
    long = tokens.where(F.size("whole") > 0)
    first = _before(long.groupBy("part").agg(F.sum(F.size("whole")).alias("s")), "part", "s")
    long = long.join(first, "part").select("part", "at", "doc_id", "n_tokens", (F.lit(base + own + len(bits)) + F.col("before") + F.col("whole_before")).alias("base"), F.posexplode("whole").alias("k", "ids_crc32"))
    long = long.select("part", "at", "doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", F.col("n_tokens").alias("doc_tokens"), (F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return long.select(*out).unionByName(uncut.select(*out)).unionByName(cut.select(*out))


def sequences(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the packed ids of each sequence and the lengths of its pieces, in order; at most a window a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for ids, n, start, length in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))):
                made.append(_numbers(ids, n)[start : start + length].view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(4), batch.column(5), pa.array(made, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    each = pieces.join(tokens.select("part", "at", "ids"), ["part", "at"]).select("ids", "doc_tokens", "start", "length", "sequence_id", "offset")
    each = each.mapInArrow(run, "sequence_id long, offset long, ids array<int>")
    each = each.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return each.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda p: F.size(p["ids"])).alias("lengths"))
