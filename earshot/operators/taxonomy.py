"""Judged samples: requests, answers, taxonomy per cell and by typology."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.runtime import materialize

# Provenance labels and categories of errors.
PROVENANCE = ("CLEAN", "A1_script", "A2_loop", "A3_truncation")
CATEGORIES = ("boundary", "tone_diacritic", "morphology", "sub_phonetic", "sub_lm_plausible", "function_word")
CELL = ("benchmark", "model", "lang")
#: Items of a request that one task puts in order.
PART = 50_000
#: Typology of languages that the analysis groups by; others are unknown.
TYPOLOGY = {"indo_european": "en_us fr_fr pt_br", "own_script": "am_et ti_et ar_eg", "tonal": "yo_ng ig_ng", "bantu_agglutinative": "bem lg_ug ln_cd sn_zw sw_ke rw_rw xh_za zu_za st_za tn_za", "other": "ha_ng mg_mg"}


def typology(lang: Column) -> Column:
    out = F.lit("unknown")
    for name, codes in TYPOLOGY.items():
        out = F.when(lang.isin(*codes.split()), name).otherwise(out)
    return out


def _categories(errors: str) -> list[Column]:
    def is_category(name: str) -> Callable[[Column], Column]:
        return lambda e: e["category"] == name

    return [F.sum(F.size(F.filter(errors, is_category(c)))).alias(f"n_{c}") for c in CATEGORIES]


def _shares(df: DataFrame) -> DataFrame:
    """Shares of the categories among the errors; share of plausible ones among substitutions; 0 where undefined."""
    n = sum(F.col(f"n_{c}") for c in CATEGORIES)
    df = df.withColumn("n_errors", n)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    df = df.withColumns({f"pct_{c}": zero(F.try_divide(100 * F.col(f"n_{c}"), F.col("n_errors"))) for c in CATEGORIES})
    df = df.withColumn("b5_share_of_subs", zero(F.try_divide(100 * F.col("n_sub_lm_plausible"), F.col("n_sub_phonetic") + F.col("n_sub_lm_plausible"))))
    return df.drop(*(f"n_{c}" for c in CATEGORIES))


def per_cell(judgments: DataFrame) -> DataFrame:
    """Shares of provenance labels among all rows, failed ones too, and of categories among errors of clean rows."""
    clean = F.when(F.col("provenance") == "CLEAN", F.col("errors")).otherwise(F.array().cast(judgments.schema["errors"].dataType))
    rows = judgments.withColumn("counted", F.coalesce(clean, F.array().cast(judgments.schema["errors"].dataType)))
    out = rows.groupBy(*CELL).agg(F.count("*").alias("n_sampled"), F.count_if(F.col("provenance") == "CLEAN").alias("n_clean"), *(F.count_if(F.col("provenance") == p).alias(f"k_{p}") for p in PROVENANCE), *_categories("counted"))
    out = out.withColumns({f"pct_{p}": 100 * F.col(f"k_{p}") / F.col("n_sampled") for p in PROVENANCE}).drop(*(f"k_{p}" for p in PROVENANCE))
    return _shares(out)


def by_typology(judgments: DataFrame, with_empty: bool = False) -> DataFrame:
    """The same by typology and model over clean rows; groups without any error are left out unless asked for."""
    clean = judgments.filter(F.col("provenance") == "CLEAN").withColumns({"typology": typology(F.col("lang")), "errors": F.coalesce("errors", F.array().cast(judgments.schema["errors"].dataType))})
    out = _shares(clean.groupBy("typology", "model").agg(F.count("*").alias("n_clean"), *_categories("errors")))
    return out if with_empty else out.filter("n_errors > 0")


def requests(sample: DataFrame, batch: int = 10) -> DataFrame:
    """Batches of exactly ``batch`` items as JSON, the last one of the rest; each item has an id that the answer repeats.

    Items are numbered in the order of a hash: within buckets, which are as many as there are PART
    items, and from the sums of the buckets before.
    """
    rows = materialize(sample.withColumn("item_id", F.concat_ws("|", *CELL, "sample_id")).select("item_id", "reference", "hypothesis"), "items")
    parts = rows.count() // PART + 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    before = rows.groupBy("part").count().select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    number = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64("item_id", F.lit(1)), "item_id", "hypothesis", "reference")) - 1
    numbered = rows.join(before, "part").withColumn("batch_id", F.floor(number / batch))
    return numbered.groupBy("batch_id").agg(F.count("*").alias("n_items"), F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "reference", "hypothesis")))).alias("payload"))


def answers(sample: DataFrame, replies: DataFrame) -> DataFrame:
    """Items with their answer by the repeated id; an item without one gets a null provenance and a note.

    Of several answers to one item the first by all its columns counts.
    """
    rows = sample.withColumn("item_id", F.concat_ws("|", *CELL, "sample_id"))
    chosen = replies.groupBy("item_id").agg(F.min(F.struct("provenance", "errors", "notes")).alias("a")).select("item_id", "a.*")
    out = rows.join(chosen, "item_id", "left")
    valid = F.col("provenance").isin(*PROVENANCE)
    return out.select(*CELL, "sample_id", F.when(valid, F.col("provenance")).alias("provenance"), F.when(valid, F.col("errors")).alias("errors"), F.when(valid, F.col("notes")).otherwise("no valid answer").alias("notes"))
