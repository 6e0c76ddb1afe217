"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_text, lang_id, line_dedup, lm_score, mix, near_dup, packing, periodic, shard, sql, token_count, top_k
from .common import table


def levels() -> dict[str, Column]:
    """A tree of domain, language and source; the domain is read from the source's number."""
    domain = F.concat(F.lit("d"), F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 3, F.lit(0)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_units(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    at = shard.shard(docs, shards=16).select("doc_id", "placed.size", "text_crc32", F.lit("bytes").alias("law"), "placed.shard", "placed.slot")
    return at.withColumn("grown_shard", F.lit(None).cast("int"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", lang_id.held_out())
    profiles = lang_id.fit(docs.where(~F.col("held_out")))
    out = lang_id.identify(docs, profiles)
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix.mix(docs, levels(), WEIGHTS, share=0.8, epochs=3)
    return out.select("doc_id", "lang", "source", "mixed.epoch", "mixed.n_tokens")


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.stupid_backoff(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"))


def op8_stupid_backoff_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of up to two words in a model of the n-grams that occur twice: backs off from trigrams through bigrams to words."""
    out = lm_score.stupid_backoff(table(spark, sf_dir, "documents"), order=3, min_count=2)
    return out.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    h = F.col("hits")
    items = F.size(h["items"]).cast("long").alias("n_items")
    sha = F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256")
    return found.select("doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), items, sha, h["contaminated"].alias("contaminated"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = packing.tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(tokens).drop("part", "at")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumns({"w": F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"), "h": F.crc32(F.col("doc_id").cast("string"))})
    docs = docs.withColumns({"n": F.size("w").cast("long"), "g": F.expr("h div 10")})
    docs = docs.withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    # the words before a, then as often as it takes the p words from a on
    words = F.expr("concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a) + 1, int(p)), int((n - a) div p) + 1)), 1, int(n - a)))")
    docs = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs).select("doc_id", "periodic.*")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    start, length, period = -best["start"], best["length"], -best["period"]
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.select(
        *("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period")),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        *(F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, label).drop("place")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_minhash_near_dup, op4_histogram_shards, op5_main_text, op6_language, op7_source_mix, op8_stupid_backoff, op8_stupid_backoff_3, op9_exact_top_k, op10_decontaminate, op11_packing, op12_periodic_runs, op13_hard_negatives)}
#: Not in SQL: units of sentences (1), tokens (2), main text (5), language profiles (6) and trigrams (8); tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dup": sql.near_dup(),
    "op4_histogram_shards": sql.shards(),
    "op7_source_mix": sql.mix(),
    "op8_stupid_backoff": sql.BACKOFF,
    "op9_exact_top_k": sql.TOP_K,
    "op10_decontaminate": sql.decontaminate(),
    "op13_hard_negatives": sql.HARD_NEGATIVES,
}
