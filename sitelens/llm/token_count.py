"""Token counts by a separator scan of flat token files.

A token file is a run of little-endian 16-bit ids, documents parted by an end-of-document id, with
no index. Blocks of the files are searched for that id; a prefix scan over the blocks' summaries
numbers the documents and stitches those that cross block borders.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, scratch, wide

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
#: Fixed value: the public pre-tokenisation pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_BYTES = 4 << 20

_encodings: dict = {}


def _encoding(vocabulary):
    """The worker's encoding of a broadcast (key, lines of a vocabulary file)."""
    key, lines = vocabulary.value
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _encodings.clear()
        _encodings[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri)


def _write(folder: str, vocabulary, end_of_document: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{uuid.uuid4().hex}.bin"  # of this attempt alone; files that no finished task names are not read
        store, path = _open(folder)
        out, count = None, 0
        encoding = _encoding(vocabulary)
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{path}/{name}")
            for text in batch.column(1):
                ids = encoding.encode_to_numpy(text.as_py() or "", disallowed_special=())
                out.write(np.append(ids, end_of_document).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch)), pa.array(np.arange(count, count + len(batch))), batch.column(0)], ["file", "ordinal", "doc_id"])
            count += len(batch)
        if out is not None:
            out.close()

    return run


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_of_document: int = END_OF_DOCUMENT) -> DataFrame:
    """Tokenise into one flat file a task in ``folder``; (file, ordinal, doc_id) says in which order documents were written."""
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    rows = wide(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the file is needed where the driver runs only; its size is that of a vocabulary
    where, name = _open(vocabulary)
    with where.open_input_stream(name) as source:
        lines = source.read()
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.md5(lines).hexdigest(), lines))
    return materialise(rows.mapInArrow(_write(folder, shared, end_of_document), "file string, ordinal long, doc_id long"), "roster")


def _search(folder: str, end_of_document: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _open(folder)
        for batch in batches:
            for name, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{path}/{name}") as source:
                    tokens = np.frombuffer(source.read_at(length, start), "<u2")
                found = np.flatnonzero(tokens == end_of_document) + start // 2
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]),
                        pa.array([start // 2]),
                        pa.array([len(tokens)]),
                        pa.array([len(found)]),
                        pa.array([int(found[0]) if len(found) else None], pa.int64()),
                        pa.array([int(found[-1]) + 1 if len(found) else None], pa.int64()),
                        pa.array([found[:-1] + 1], pa.list_(pa.int64())),
                        pa.array([np.diff(found) - 1], pa.list_(pa.int64())),
                    ],
                    ["file", "start", "tokens", "ends", "first_end", "after_last", "begins", "inner"],
                )

    return run


def scan_token_files(spark: SparkSession, folder: str, files: DataFrame | None = None, end_of_document: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in the flat token files of ``folder``.

    ``files`` (file) restricts the scan to files named there. start counts tokens from the file's
    start; an end-of-document id belongs to no document; two in a row part an empty document. What
    follows the last one, if anything, is a last document. Empty files have no documents.
    """
    listed = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    if files is not None:
        listed = listed.join(files.select("file").distinct(), "file", "left_semi")
    steps = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))
    blocks = listed.where("length > 1").select("file", F.explode(steps).alias("start"), "length")
    blocks = blocks.select("file", "start", F.least(F.lit(block_bytes), F.col("length") - F.col("start")).alias("bytes")).repartition("file", "start")
    kind = "file string, start long, tokens long, ends long, first_end long, after_last long, begins array<long>, inner array<long>"
    found = materialise(blocks.mapInArrow(_search(folder, end_of_document), kind), "blocks")
    # prefix scan of the summaries: documents ended, and where the open one began
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("file", "start", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.max("after_last").over(earlier), F.lit(0)).alias("open"))
    met = found.where("ends > 0").join(scan, ["file", "start"])
    lengths = F.concat(F.array(F.col("first_end") - F.col("open")), "inner")
    whole = F.arrays_zip(F.concat(F.array("open"), "begins").alias("start"), lengths.alias("n_tokens"))
    docs = met.select("file", "base", F.posexplode(whole).alias("pos", "d"))
    docs = docs.select("file", (F.col("base") + F.col("pos")).alias("ordinal"), F.col("d.start").alias("start"), F.col("d.n_tokens").alias("n_tokens"))
    ends = found.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("ends").alias("ordinal"), F.coalesce(F.max("after_last"), F.lit(0)).alias("start"))
    rest = ends.where("tokens > start").select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"))
    return docs.unionByName(rest)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row, counted in flat token files that are written for it.

    Null or empty text: 0 tokens. Null ids and repeated rows keep a row each. Empty table: no rows.
    """
    folder = scratch(docs.sparkSession, "tokens")
    roster = write_token_files(docs, folder, id_col, text_col, vocabulary)
    counts = scan_token_files(docs.sparkSession, folder, roster)
    return roster.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
