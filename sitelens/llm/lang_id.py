"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent 1- to 3-grams in order. A document's own most frequent
n-grams are ranked likewise, and the language with the smallest out-of-place distance wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, wide

#: n-grams in a profile and of a document.
PROFILE = 400
#: Labelled rows of each language that a profile is fitted on, at most.
MAX_LABELLED = 2000
#: Texts whose n-grams are held and counted at once; a worker keeps the memory that it once had.
TOGETHER = 64
#: Share of the median score of a language's labelled rows that a text of it reaches at least.
LEAST = 0.5

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of the lower-cased letters; 0 stands for what parts words. No letter: empty."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_is_letter()[points], points, 0)
    line = np.concatenate([[0], points, [0]]).astype(np.uint64)
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != 0) | (line[:-1] != 0)
    line = line[keep]
    if len(line) < 3:
        return np.zeros(0, np.uint64)
    shift = np.uint64(21)
    pairs = line[:-1] << shift | line[1:]
    triples = pairs[:-1] << shift | line[2:]
    return np.concatenate([line[line != 0], pairs | np.uint64(1 << 62), triples[line[1:-1] != 0] | np.uint64(1 << 63)])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    firsts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[firsts], np.diff(np.append(firsts, len(codes)))


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent grams in order, ties to the smaller code."""
    kinds, counts = counted(codes)
    return kinds[np.argsort(-counts, kind="stable")[:most]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            part = batch.slice(at, TOGETHER)
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
                by.setdefault(lang, []).append(grams(text.as_py()))
            for lang, own in by.items():
                kinds, counts = counted(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kinds), pa.string()), pa.array(kinds.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def _sampled(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, max_labelled: int) -> tuple[DataFrame | None, list[str]]:
    """(lang, text) of about ``max_labelled`` rows of each language at most, and the languages."""
    rows = wide(labelled).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("place"))
    rows = rows.where("lang is not null and text is not null")
    shares = {r.lang: min(1.0, max_labelled / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None, []
    limit = F.create_map(*(F.lit(x) for lang, share in shares.items() for x in (lang, int(share * (1 << 30)))))
    return rows.where(F.col("place") <= limit[F.col("lang")]).select("lang", "text"), sorted(shares)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_labelled: int = MAX_LABELLED, most: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language, from about ``max_labelled`` rows of each at most (those with the smallest
    hashes of their ids). Rows with null text or label take no part. The result holds ``most`` grams a language."""
    sample, langs = _sampled(labelled, id_col, text_col, lang_col, max_labelled)
    return {} if sample is None else _profiles(sample, langs, most)


def _profiles(sample: DataFrame, langs: list[str], most: int) -> dict[str, list[int]]:
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).collect()
    out: dict[str, list[int]] = {lang: [] for lang in langs}
    for r in sorted(top, key=lambda r: (r.lang, r["rank"])):
        out[r.lang].append(r.gram)
    return out


def predict(text: Column, profiles: dict[str, list[int]], most: int = PROFILE) -> Column:
    """struct(lang, score) of a text; ``und`` and 0 if it is null, has no letter, or there are no profiles.

    score is 1 less the winner's distance as a share of the greatest one; ties go to the first name.
    """
    langs = sorted(profiles)
    pool = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
    ranks = np.full((len(langs), len(pool)), -1, np.int64)
    for k, lang in enumerate(langs):
        ranks[k, np.searchsorted(pool, np.array(profiles[lang], np.int64).view(np.uint64))] = np.arange(len(profiles[lang]))

    def run(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for item in texts:
            own = ranked(grams(item.as_py() or ""), most)
            if not len(own) or not langs:
                names.append("und")
                scores.append(0.0)
                continue
            at = np.minimum(np.searchsorted(pool, own), len(pool) - 1)
            theirs = ranks[:, at]
            away = np.abs(theirs - np.arange(len(own)))
            away[(theirs < 0) | (pool[at] != own)] = most
            distance = away.sum(1)
            best = int(np.argmin(distance))
            names.append(langs[best])
            scores.append(1.0 - float(distance[best]) / (most * len(own)))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.arrow_udf(run, "struct<lang: string, score: double>")(text)


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang, score. A column of that name is replaced; an empty table stays empty."""
    return wide(docs).withColumn(into, predict(F.col(text_col).cast("string"), profiles))


def fit_known(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_labelled: int = MAX_LABELLED, most: int = PROFILE, least: float = LEAST) -> tuple[dict[str, list[int]], dict[str, float]]:
    """The profiles that ``fit`` makes, and for each language the score at which a text counts as written in it.

    That is ``least`` times the median score of the labelled rows of the sample that are predicted as labelled; 0 where none is. The
    sample is written once and read by both. Null ids count as one id, repeated rows once each; rows with null text or label
    take no part, and other columns are not read. No labelled rows: no profiles and no bounds.
    """
    sample, langs = _sampled(labelled, id_col, text_col, lang_col, max_labelled)
    if sample is None:
        return {}, {}
    sample = materialise(sample, "labelled")
    profiles = _profiles(sample, langs, most)
    right = identify(sample, profiles).where("language.lang = lang").groupBy("lang").agg(F.percentile_approx("language.score", 0.5, 100000).alias("median"))
    medians = {r.lang: r["median"] for r in right.collect()}
    return profiles, {lang: least * medians.get(lang, 0.0) for lang in langs}


def known(language: Column, least: dict[str, float]) -> Column:
    """Whether a predicted struct(lang, score) names a language and reaches its bound."""
    reached = F.lit(False)
    for lang, score in least.items():
        reached = reached | ((language["lang"] == lang) & (language["score"] >= score))
    return reached & (language["lang"] != "und")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
