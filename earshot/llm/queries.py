"""Queries of this subpackage: name -> function of (spark, data directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.llm import bpe, canonical, langid, mixing, overlap, quantiles, sentences, splits, truncation
from earshot.runtime import table


def _truncation(spark: SparkSession, d: str) -> DataFrame:
    predictions = table(spark, d, "predictions")
    limits = truncation.known_limits(predictions)
    return truncation.scores(predictions, truncation.fit(predictions, limits), limits)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncation(spark, d).filter("cut").select("pred_id", "field").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_truncation(spark, d))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    filters = langid.fit(table(spark, d, "lang_samples"))
    return langid.languages_of(table(spark, d, "predictions"), filters, langid.notations(table(spark, d, "languages")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.misfits(_languages(spark, d))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    parts = _languages(spark, d).select("pred_id", "label", "verdict", F.posexplode("parts").alias("segment", "part"))
    return parts.select("pred_id", "label", "verdict", "segment", "part.language", "part.confidence", F.col("part.start").alias("seg_start"), F.col("part.end").alias("seg_end"))


def p2_covered(spark: SparkSession, d: str) -> DataFrame:
    """Of every hypothesis with letters: its length, and whether its segments cover it once, in known languages."""
    found = _languages(spark, d).filter("verdict <> 'none'").join(table(spark, d, "predictions").select("pred_id", F.length("hypothesis").alias("n_chars")), "pred_id")
    joined = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")), lambda a, p: F.struct(p["end"].alias("at"), (a["ok"] & (p["start"] == a["at"]) & (p["end"] > p["start"]) & (p["confidence"] > 0)).alias("ok")))
    return found.select("pred_id", "n_chars", (joined["ok"] & (joined["at"] == F.col("n_chars"))).alias("covered"))


def p3_day_percentiles(spark: SparkSession, d: str) -> DataFrame:
    days = quantiles.by_day(table(spark, d, "predictions"), "language", "scored_at", ["wer", "cer"])
    return quantiles.percentiles(days, ["metric", "grp", "day"]).withColumnRenamed("grp", "language").withColumn("day", F.col("day").cast("string"))


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    days = quantiles.by_day(table(spark, d, "predictions"), "language", "scored_at", ["wer", "cer"])
    return quantiles.percentiles(quantiles.over_days(days), ["metric", "grp"]).withColumnRenamed("grp", "language")


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from small buffers, which collapse even here, and whether each is within its bound of the exact rank."""
    predictions = table(spark, d, "predictions")
    days = quantiles.by_day(predictions, "language", "scored_at", ["wer", "cer"], size=32)
    found = quantiles.percentiles(quantiles.over_days(days, size=32), ["metric", "grp"], size=32)
    placed = quantiles.ranks(predictions, found, "language", ["wer", "cer"])
    rank, off = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("n"))), F.round(F.col("rank_error") * F.col("n"))
    within = (F.col("smaller") < rank + off) & (F.col("not_larger") >= rank - off)
    return placed.select("metric", F.col("grp").alias("language"), "percentile", "n", within.alias("within"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "asr_index_v6_16k")).select("audio_id_a", "audio_id_b")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, d, "asr_index_v6_16k"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return overlap.classes(table(spark, d, "asr_index_v6_16k"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    return overlap.members(table(spark, d, "asr_index_v6_16k")).withColumnRenamed("key", "audio_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "asr_index_v6_16k")
    tables = {"predictions": (table(spark, d, "predictions"), "pred_id", ["reference", "hypothesis"]), "asr_index_v6_16k": (index, "audio_id", ["transcript"])}
    return canonical.changed_values(tables, canonical.vocabulary_words(index, "transcript")).select("table_name", "row_key", "field").distinct()


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "asr_index_v6_16k")
    words = canonical.vocabulary_words(index, "transcript")
    predictions = table(spark, d, "predictions").select(F.lit("predictions").alias("table_name"), F.col("pred_id").cast("string").alias("row_key"), F.explode(F.create_map(F.lit("reference"), "reference", F.lit("hypothesis"), "hypothesis")).alias("field", "value"))
    transcripts = index.select(F.lit("asr_index_v6_16k").alias("table_name"), F.col("audio_id").alias("row_key"), F.lit("transcript").alias("field"), F.col("transcript").alias("value"))
    values = predictions.unionByName(transcripts)
    return values.select("table_name", "row_key", "field", canonical.canonical_column(F.col("value"), words).alias("consistent"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.spread(splits.components(table(spark, d, "asr_index_v6_16k"))).withColumnRenamed("owner", "speaker_id")


def p6_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.resplit(table(spark, d, "asr_index_v6_16k"), table(spark, d, "split_targets"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return splits.report(table(spark, d, "asr_index_v6_16k"), table(spark, d, "split_targets"))


def p6_linked(spark: SparkSession, d: str) -> DataFrame:
    """Rows that share a speaker or an id (rows delivered again, some without their speaker) stay together."""
    index = table(spark, d, "asr_index_v6_16k")
    return splits.resplit(index, table(spark, d, "split_targets"), owner=[splits.speaker(F.col("speaker_id")), F.col("audio_id")])


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Rows and splits of every speaker after the new split: one split each."""
    new = splits.resplit(table(spark, d, "asr_index_v6_16k"), table(spark, d, "split_targets")).filter("owner is not null")
    return new.groupBy(F.col("owner").alias("speaker_id")).agg(F.count("*").alias("n_rows"), F.count_distinct("new_split").alias("n_splits"))


def p6_met(spark: SparkSession, d: str) -> DataFrame:
    """Whether the shares of the new splits are within half a hundredth of the wanted ones."""
    got = splits.report(table(spark, d, "asr_index_v6_16k"), table(spark, d, "split_targets"))
    return got.select(F.col("new_split").alias("split"), "target_share", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.005).alias("met"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_met(spark: SparkSession, d: str) -> DataFrame:
    """Of every target: whether its tokens are those wanted, up to its longest record, and whether its cap is kept."""
    got = mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return got.select("source", "records", (F.abs(F.col("used_tokens") - F.col("wanted_tokens")) <= F.col("longest")).alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("kept"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return sentences.sentences(documents, sentences.fit(documents, table(spark, d, "lang_samples")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_segments, p2_covered, p3_day_percentiles, p3_percentiles, p3_bounds, p4_found, p4_counts, p4_classes, p4_members, p5_found, p5_consistent, p6_found, p6_split, p6_shares, p6_linked, p6_kept, p6_met, p7_ids, p8_mix, p8_shares, p8_met, p9_found)}
