"""Corpus quality: audits, leakage, duplicates, exclusions, manifests and their reconciliation.

``index`` tables have audio_id, path, transcript, language, split, source, speaker_id, sample_rate,
duration. Null transcripts count as empty texts, null durations as unknown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.functions import text as X
from earshot.functions import unicode as U
from earshot.operators.analysis import percentiles_of
from earshot.operators.groups import join_groups

GROUP = ("source", "language", "split")
# Limits of durations (s) and of characters a second, for flags and for exclusions.
LONG, BRIEF, CPS_LOW, CPS_HIGH, CPS_MIN, CPS_MIN_FROM, CPS_MAX, SMALL = 30.0, 0.5, 3.0, 35.0, 1.0, 5.0, 45.0, 300
#: Order of the reasons for which a row is excluded; the first that holds counts.
REASONS = ("duplicate_audio", "gt30s", "tag", "empty_ref", "chars_per_sec", "sentence_overlap")


def split_name(c: Column) -> Column:
    """The split in lower case without blanks; spellings of train, dev and test as these."""
    name = F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.when(name == "training", "train").when(name.isin("validation", "valid", "val"), "dev").when(name == "eval", "test").otherwise(name)


def records(index: DataFrame) -> DataFrame:
    """The index with what every check needs: split by one name, cleaned text with its status, sentence keys, speed."""
    rows = index.select("audio_id", "path", F.coalesce("transcript", F.lit("")).alias("transcript"), "language", split_name(F.col("split")).alias("split"), "source", F.nullif(F.trim("speaker_id"), F.lit("")).alias("speaker_id"), "sample_rate", F.col("duration").cast("double").alias("duration"))
    rows = rows.withColumn("nfc", U.unicode_form(F.col("transcript"), "NFC"))
    rows = rows.withColumn("clean", X.clean_reference(F.col("nfc"), composed=True))
    rows = rows.withColumns({"text": F.col("clean.text"), "status": F.col("clean.status"), "raw_key": X.overlap_key(F.col("nfc"), composed=True), "text_key": X.overlap_key(F.col("clean.text"), composed=True)})
    return rows.drop("clean")


def issues(rows: DataFrame) -> DataFrame:
    """Adds one flag for each check that needs only the row (H: hard, F: to look at)."""
    raw = F.trim(F.regexp_replace("transcript", f"^[{X.WS}]+|[{X.WS}]+$", ""))
    cps = F.when((raw != "") & (F.col("duration") > 0), F.length(raw) / F.col("duration"))
    rows = rows.withColumn("cps", cps)
    return rows.withColumns({
        "H2_sample_rate": F.coalesce(F.col("sample_rate") != 16000, F.lit(True)), "H3_no_duration": F.coalesce(F.col("duration") <= 0, F.lit(True)), "H5_empty_text": raw == "",
        "F1_gt_30s": F.coalesce(F.col("duration") > LONG, F.lit(False)), "F2_lt_0_5s": F.coalesce(F.col("duration") < BRIEF, F.lit(False)),
        "F5_chars_per_sec": F.coalesce(~F.col("cps").between(CPS_LOW, CPS_HIGH), F.lit(False)),
        "F6_text_form": (F.col("nfc") != F.col("transcript")) | F.col("transcript").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]") | F.col("transcript").rlike(X.TAG),
    })


CHECKS = ("H2_sample_rate", "H3_no_duration", "H5_empty_text", "F1_gt_30s", "F2_lt_0_5s", "F5_chars_per_sec", "F6_text_form")


def audit(rows: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Per group: rows, hours, counts of every check, ids that repeat, duration and speed percentiles, verdict."""
    rows = issues(rows)
    repeated = rows.groupBy(*by, "audio_id").agg(F.count("*").alias("c")).groupBy(*by).agg(F.count_if(F.col("c") > 1).alias("H6_duplicate_ids"))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.sum("duration") / 3600).alias("hours"), *(F.count_if(c).alias(c) for c in CHECKS))
    out = join_groups(out, repeated, by).withColumn("F8_small_n", (F.col("n") < SMALL).cast("int"))
    hard = reduce(lambda a, b: a | b, (F.col(c) > 0 for c in (*[c for c in CHECKS if c[0] == "H"], "H6_duplicate_ids")))
    soft = reduce(lambda a, b: a | b, (F.col(c) > 0 for c in (*[c for c in CHECKS if c[0] == "F"], "F8_small_n")))
    return out.withColumn("verdict", F.when(hard, "FAIL").when(soft, "FLAG").otherwise("PASS"))


def percentiles(rows: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Linear percentiles of durations and of characters a second per group."""
    rows = issues(rows)
    out = rows.select(*by).distinct()
    for column, shares in (("duration", {"dur_min": 0.0, "dur_p5": 0.05, "dur_median": 0.5, "dur_p95": 0.95, "dur_max": 1.0}), ("cps", {"cps_p1": 0.01, "cps_median": 0.5, "cps_p99": 0.99})):
        out = join_groups(out, percentiles_of(rows, by, column, shares), by, "left")
    return out


def examples(rows: DataFrame, limit: int = 3) -> DataFrame:
    """For every check the first ids, by id, at most ``limit`` of each group."""
    rows = issues(rows)
    long = rows.select(*GROUP, "audio_id", F.explode(F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in CHECKS)), lambda x: x.isNotNull())).alias("issue"))
    ranked = long.withColumn("r", F.row_number().over(W.partitionBy(*GROUP, "issue").orderBy("audio_id")))
    return ranked.filter(F.col("r") <= limit).select(*GROUP, "issue", "audio_id")


def duplicates(rows: DataFrame, key: str = "path", order: str = "audio_id") -> DataFrame:
    """Rows after the first, by ``order``, of every group with the same non-null ``key``."""
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    return rows.join(first, key).filter(F.col(order) > F.col("first"))


def duplicate_ids(rows: DataFrame, key: str = "audio_id") -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def sentence_leakage(rows: DataFrame) -> DataFrame:
    """Test rows and whether their cleaned or raw sentence is in train or dev of the same source and language."""
    other = rows.filter("split in ('train', 'dev') and raw_key <> ''").select("source", "language", "raw_key").distinct()
    test = rows.filter("split = 'test'")
    raw = other.withColumn("leaks_raw", F.lit(True))
    text = other.withColumnRenamed("raw_key", "text_key").withColumn("leaks_text", F.lit(True))
    out = join_groups(join_groups(test, raw, ["source", "language", "raw_key"], "left"), text, ["source", "language", "text_key"], "left")
    return out.withColumn("leaks", F.coalesce("leaks_raw", F.lit(False)) | F.coalesce("leaks_text", F.lit(False))).drop("leaks_raw", "leaks_text")


def overlap_sizes(rows: DataFrame, column: str) -> DataFrame:
    """Per source and language: distinct values of a column in test, and how many of them are in train or dev."""
    values = rows.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy("source", "language", column).agg(F.max(F.expr("split = 'test'")).alias("test"), F.max(F.expr("split in ('train', 'dev')")).alias("other"))
    return values.filter("test").groupBy("source", "language").agg(F.count("*").alias("n_test"), F.count_if("other").alias("n_shared"))


def cross_source(rows: DataFrame) -> DataFrame:
    """Distinct test sentences of a source that occur in train of another source, by both sources and language."""
    keys = rows.filter("raw_key <> ''")
    test = keys.filter("split = 'test'").select("language", "raw_key", "source").distinct()
    train = keys.filter("split = 'train'").select("language", "raw_key", F.col("source").alias("train_source")).distinct()
    return test.join(train, ["language", "raw_key"]).filter("source <> train_source").groupBy("source", "language", "train_source").agg(F.count("*").alias("n_sentences"))


def excluded(rows: DataFrame) -> DataFrame:
    """Test rows with the first reason to exclude them; null keeps the row.

    A row repeats an audio if an earlier one, by id, has its path. A row without a duration has no
    speed, and stays.
    """
    test = sentence_leakage(rows)
    first = test.filter("path is not null").groupBy("path").agg(F.min("audio_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    test = test.join(first, "path", "left")
    cps = F.when(F.col("duration") > 0, F.length("text") / F.col("duration")).otherwise(0.0)
    odd = ((cps < CPS_MIN) & (F.col("duration") >= CPS_MIN_FROM)) | (cps > CPS_MAX)
    reason = F.when(F.col("audio_id") > F.col("first_id"), REASONS[0]).when(F.col("duration") > LONG, REASONS[1]).when(F.col("status").isNotNull(), F.col("status")).when(odd, REASONS[4]).when(F.col("leaks"), REASONS[5])
    return test.withColumn("reason", reason).drop("first_id")


def exclusions(judged: DataFrame, head: int = 120) -> DataFrame:
    """The excluded rows, with the first characters of their raw transcript on one line."""
    return judged.filter("reason is not null").select("source", "language", "audio_id", "reason", F.translate(F.substring("transcript", 1, head), "\t\n", "  ").alias("reference_head"))


def manifest(judged: DataFrame) -> DataFrame:
    """The kept rows as a clean manifest."""
    return judged.filter("reason is null").select("audio_id", "path", F.col("text").alias("transcript"), X.one_line(F.col("transcript")).alias("transcript_raw"), "speaker_id", "duration", "source", "language")


def clean_summary(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """Per source and language: raw and kept rows, rows by reason, hours, speakers, and whether speakers recur in train or dev."""
    kept = F.col("reason").isNull()
    out = judged.groupBy("source", "language").agg(F.count("*").alias("n_raw"), F.count_if(kept).alias("n_clean"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS), (F.sum(F.when(kept, F.col("duration"))) / 3600).alias("hours_clean"))
    speakers = judged.filter(kept & F.col("speaker_id").isNotNull()).select("source", "language", "speaker_id").distinct()
    elsewhere = rows.filter("split in ('train', 'dev') and speaker_id is not null").select("source", "language", "speaker_id").distinct().withColumn("recurs", F.lit(True))
    counted = join_groups(speakers, elsewhere, ["source", "language", "speaker_id"], "left").groupBy("source", "language").agg(F.count("*").alias("n_speakers"), F.count_if("recurs").alias("n_speakers_also_in_train_dev"))
    out = join_groups(out, counted, ["source", "language"], "left")
    out = out.na.fill(0, ["n_speakers", "n_speakers_also_in_train_dev"])
    return out.withColumns({"speaker_dependent": F.col("n_speakers_also_in_train_dev") > 0, "small_n_lt_300": F.col("n_clean") < SMALL})


def reconcile(kept: DataFrame, dropped: DataFrame, raw: DataFrame, key: str = "audio_id") -> DataFrame:
    """One row of identities: kept + dropped = raw, none of them unknown, none of them both."""
    ids = kept.select(key, F.lit("kept").alias("side")).unionByName(dropped.select(key, F.lit("dropped").alias("side"))).unionByName(raw.select(key, F.lit("raw").alias("side")))
    per = ids.groupBy(key).agg(*(F.count_if(F.col("side") == s).alias(s) for s in ("kept", "dropped", "raw")))
    return per.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("n_raw"), F.coalesce(F.sum("kept"), F.lit(0)).alias("n_kept"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("n_dropped"), F.count_if((F.col("kept") + F.col("dropped") > 0) & (F.col("raw") == 0)).alias("n_unknown"), F.count_if(F.col("kept") + F.col("dropped") != F.col("raw")).alias("n_uneven"))


def assemble(manifests: DataFrame, groups: DataFrame) -> DataFrame:
    """Manifest rows of the approved groups, where each group's rows are as many as declared.

    ``manifests``: group_key, sample_id, transcript; ``groups``: group_key, n_clean. Groups that
    disagree, repeat an id or hold an empty text come out with ``ok`` false and no rows of their own.
    """
    per = manifests.groupBy("group_key").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("n_ids"), F.count_if(F.trim(F.coalesce("transcript", F.lit(""))) == "").alias("n_empty"))
    return groups.join(per, "group_key", "left").select("group_key", "n_clean", F.coalesce("n", F.lit(0)).alias("n"), ((F.coalesce("n", F.lit(0)) == F.col("n_clean")) & (F.coalesce("n_ids", F.lit(0)) == F.coalesce("n", F.lit(0))) & (F.coalesce("n_empty", F.lit(0)) == 0)).alias("ok"))
