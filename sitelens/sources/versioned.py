"""Tables of plain Parquet whose rows are replaced by key, several at once, by writes that count as a whole or not at all.

A write puts the rows of its tables, and the keys it replaces, into folders of its own, and then a single row into ``commits``.
Readers take the folders of committed writes since the newest base, and of each key the rows of its newest write, so no
file is changed once it is written. ``compact`` writes what is current as a new base; ``vacuum`` removes what no reader
takes any more. One writer at a time; readers may run beside it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of a row's write, read from its folder.
WRITE = "__write"
_COMMIT = "version long, write string, base boolean, tables array<string>, keys array<string>"


def commits(spark: SparkSession, path: str) -> list:
    """Committed writes by version, since the newest base; as many as there were writes since it was made."""
    try:
        rows = sorted(spark.read.schema(_COMMIT).json(f"{path}/commits/*").where("version is not null").collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    bases = [k for k, r in enumerate(rows) if r.base]
    return rows[bases[-1] :] if bases else rows


def stage(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], keys: DataFrame, write: str) -> None:
    """Write the rows and keys of a write; nothing of them is read before ``commit``."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/tables/{name}/{WRITE}={write}")
    keys.distinct().write.mode("overwrite").parquet(f"{path}/keys/{WRITE}={write}")


def commit(spark: SparkSession, path: str, tables: Sequence[str], keys: Sequence[str], write: str, base: bool = False) -> int:
    """Make a staged write count, as the newest version. One row in one file, which appears at once."""
    known = commits(spark, path)
    version = known[-1].version + 1 if known else 0
    while True:
        row = spark.createDataFrame([(version, write, base, list(tables), list(keys))], _COMMIT)
        try:
            row.coalesce(1).write.mode("error").json(f"{path}/commits/{version:012d}")
            return version
        except AnalysisException as e:  # an attempt that broke off holds the number
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            version += 1


def replace(path: str, tables: Mapping[str, DataFrame], keys: DataFrame, write: str | None = None) -> int:
    """All rows of ``keys`` go from all tables, and the rows of ``tables`` come; returns the version.

    Every table has the columns of ``keys``. Rows of ``tables`` that ``keys`` lacks are added. A null in a key equals nothing:
    such rows are added and never replaced. ``write`` names the write; one of a name that was committed already is left out.
    """
    spark = keys.sparkSession
    if write is not None:
        done = [r.version for r in commits(spark, path) if r.write == write]
        if done:
            return done[0]
    write = write or uuid.uuid4().hex
    stage(spark, path, tables, keys, write)
    return commit(spark, path, list(tables), keys.columns, write)


def read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The current rows of a table; None if no write of it is committed."""
    return _current(spark, path, name, commits(spark, path))


def _current(spark: SparkSession, path: str, name: str, live: list) -> DataFrame | None:
    of = [r.write for r in live if name in r.tables]
    if not of:
        return None
    rows = spark.read.option("basePath", f"{path}/tables/{name}").parquet(*(f"{path}/tables/{name}/{WRITE}={w}" for w in of))
    if len(live) == 1:
        return rows.drop(WRITE)
    # a write whose rows of a key are not the key's newest is past, also where the newest one brought no rows of this table
    versions = spark.createDataFrame([(r.write, r.version) for r in live], f"{WRITE} string, __version long")
    keys = spark.read.option("basePath", f"{path}/keys").parquet(*(f"{path}/keys/{WRITE}={r.write}" for r in live))
    on = [c for c in keys.columns if c != WRITE]
    newest = keys.join(F.broadcast(versions), WRITE).groupBy(*on).agg(F.max("__version").alias("__newest"))
    rows = rows.join(F.broadcast(versions), WRITE).join(newest, on, "left").where("__newest is null or __version >= __newest")
    return rows.select([c for c in rows.columns if c not in (WRITE, "__version", "__newest", *on)] + on)


def compact(spark: SparkSession, path: str) -> int | None:
    """Write the current rows of all tables as a new base, so that readers join nothing."""
    live = commits(spark, path)
    if not live:
        return None
    names = sorted({n for r in live for n in r.tables})
    write = f"base-{uuid.uuid4().hex}"
    keys = spark.read.parquet(*(f"{path}/keys/{WRITE}={r.write}" for r in live))
    stage(spark, path, {n: _current(spark, path, n, live) for n in names}, keys, write)
    return commit(spark, path, names, keys.columns, write, base=True)


def vacuum(spark: SparkSession, path: str, older_than_s: float = 7 * 24 * 3600) -> int:
    """Remove folders of writes that no reader takes, and that are old enough for none to be reading or staging; how many."""
    live = {r.write for r in commits(spark, path)}
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for pattern in ("keys/*", "tables/*/*"):
        for status in files.globStatus(hadoop.Path(f"{path}/{pattern}")) or []:
            old = status.getModificationTime() < (time.time() - older_than_s) * 1000
            if old and status.getPath().getName().removeprefix(f"{WRITE}=") not in live:
                gone += bool(files.delete(status.getPath(), True))
    return gone
