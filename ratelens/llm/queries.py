"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ratelens.llm import fingerprints, langid, line_dedup, lm, near_dedup, packing, periods, pieces, resampling, sharding, substring_dedup, topk, url_filter
from ratelens.llm.common import remainder_of_id, table, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

SHARDS = 24


@query("op1_sharding")
def op1_sharding(spark, d):
    docs = table(spark, d, "documents")
    sized = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty("text")) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.shard_rows(sized, "doc_id", SHARDS, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op2_language_id")
def op2_language_id(spark, d):
    docs = table(spark, d, "documents")
    held_out = remainder_of_id("doc_id", 3) == 1
    # The id only tells rows apart when the sample is drawn.
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.language_column(docs, model).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, d):
    packed = packing.pack(table(spark, d, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op5_syncmer_fingerprints")
def op5_syncmer_fingerprints(spark, d):
    edits = fingerprints.half_edits(table(spark, d, "documents"))
    own = fingerprints.hashes(F.col("marks"))
    return edits.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("marks")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        fingerprints.likeness(own, fingerprints.hashes(F.col("edited_marks"))).alias("near_edited"),
        fingerprints.likeness(own, F.col("next_hashes")).alias("near_next"),
        "next_id",
    )


@query("op6_line_dedup")
def op6_line_dedup(spark, d):
    cleaned = line_dedup.remove_repeated_lines(table(spark, d, "documents"))
    return cleaned.select("doc_id", "text", "n_chars", "removed_lines")


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return near_dedup.near_duplicate_classes(docs).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query("op8_maxent_lm")
def op8_maxent_lm(spark, d):
    docs = table(spark, d, "documents")
    held_out = remainder_of_id("doc_id", 7) == 2
    given = docs.select("doc_id", held_out.alias("held_out"), "text")
    return lm.lm_scores(given, docs.where(~held_out).select("doc_id", "text"))


@query("op9_impact_topk")
def op9_impact_topk(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query("op10_url_trust", url_filter.oracle_sql())
def op10_url_trust(spark, d):
    judged = url_filter.judge_urls(table(spark, d, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op7_sentencepiece")
def op7_sentencepiece(spark, d):
    coded = pieces.with_pieces(table(spark, d, "documents").select("doc_id", "text"))
    same = F.col("decoded") == text_or_empty("text")
    return coded.select("doc_id", "ids", "n_ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), same.alias("round_trip"))


@query("op11_substring_dedup")
def op11_substring_dedup(spark, d):
    cleaned = substring_dedup.remove_repeated_windows(table(spark, d, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(text_or_empty("kept"), 256).alias("kept_sha256"))


@query("op12_importance_resampling")
def op12_importance_resampling(spark, d):
    drawn = resampling.resample(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_periodic_runs")
def op13_periodic_runs(spark, d):
    docs = periods.with_tail_repeated(table(spark, d, "documents").select("doc_id", "text"))
    found = periods.with_runs(docs)
    best = periods.by_exponent(F.col("runs"))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    told = found.select("doc_id", "runs", F.sha2(lines, 256).alias("runs_sha256"), F.sha2(text_or_empty("collapsed"), 256).alias("collapsed_sha256"), best.alias("best"))
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
