"""Error rates of predictions: per utterance, per cell, with gates and intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.functions import editdist as E
from earshot.functions import text as X
from earshot.functions import unicode as U
from earshot.operators.groups import join_groups
from earshot.runtime import materialize, spread

#: A cell is one run of one model on one language of one dataset.
CELL = ("experiment", "dataset", "model", "language")
#: Largest share of failed utterances, resamples and seed of the bootstrap, groups that are flagged as small.
MAX_FAILED, RESAMPLES, SEED, SMALL = 0.002, 1000, 0, 300
#: Languages whose rates are also given without marks, and those with a normaliser of their own.
MARKED, ENGLISH = ("yo_ng", "ig_ng", "ar_eg", "ha_ng"), ("en_us",)
#: Utterances of a cell, at most, that are resampled by position.
EXACT_ROWS = 50_000


def utterances(predictions: DataFrame, reference: Column | None = None, hypothesis: Column | None = None, keep: tuple[str, ...] = (*CELL, "pred_id", "sample_id")) -> DataFrame:
    """Normalised texts, words, errors and units of every utterance with a reference.

    A null hypothesis counts as empty: all words are dropped. Rows whose normalised reference is empty
    have no rate and are left out. Extra columns of the input are not kept.
    """
    ref = X.normalize(F.col("reference")) if reference is None else reference
    hyp = X.normalize(F.col("hypothesis")) if hypothesis is None else hypothesis
    rows = spread(predictions).select(*keep, ref.alias("nref"), hyp.alias("nhyp")).filter(F.trim("nref") != "")
    rows = rows.withColumns({"ref_words": X.words(F.col("nref")), "hyp_words": X.words(F.col("nhyp"))})
    return rows.withColumns({
        "n_ref": F.size("ref_words"), "n_hyp": F.size("hyp_words"), "n_chars": F.length("nref"),
        "word_errors": E.word_distance(F.col("ref_words"), F.col("hyp_words")), "char_errors": E.char_distance(F.col("nref"), F.col("nhyp")),
    })


def rate(errors: Column | str, units: Column | str) -> Column:
    """Ratio of sums in percent; it may exceed 100."""
    return 100 * F.sum(errors) / F.sum(units)


def corpus_rates(rows: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """WER and CER of every cell."""
    return rows.groupBy(*by).agg(rate("word_errors", "n_ref").alias("wer"), rate("char_errors", "n_chars").alias("cer"), F.count("*").alias("num_samples"))


def per_utterance(rows: DataFrame) -> DataFrame:
    """WER and CER in percent of every utterance."""
    return rows.withColumns({"wer": 100 * F.col("word_errors") / F.col("n_ref"), "cer": 100 * F.col("char_errors") / F.col("n_chars")})


def rescore(predictions: DataFrame, metrics: tuple[str, ...] = ("wer", "cer"), by: tuple[str, ...] = CELL, **normalizer) -> DataFrame:
    """Requested metrics again, with the number of utterances and the normaliser's settings; others aren't computed."""
    unknown = set(metrics) - {"wer", "cer"}
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    rows = utterances(predictions, X.normalize(F.col("reference"), **normalizer), X.normalize(F.col("hypothesis"), **normalizer))
    every = {"wer": rate("word_errors", "n_ref").alias("wer"), "cer": rate("char_errors", "n_chars").alias("cer")}
    return rows.groupBy(*by).agg(*(every[m] for m in metrics), F.count("*").alias("num_samples")).withColumn("metric_config", X.normalizer_config(**normalizer))


def strict_utterances(predictions: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """Rows of the strict path: policy normaliser, nothing left out, null hypotheses kept as failures."""
    ref, hyp = X.policy_normalize(F.col("reference")), X.policy_normalize(F.col("hypothesis"))
    rows = spread(predictions).select(*by, "pred_id", "sample_id", F.col("hypothesis").isNull().alias("failed"), (F.col("hypothesis") == "").alias("empty"), ref.alias("nref"), hyp.alias("nhyp"))
    rows = rows.withColumns({"ref_words": X.words(F.col("nref")), "hyp_words": X.words(F.col("nhyp"))})
    return rows.withColumns({"n_ref": F.size("ref_words"), "n_chars": F.length("nref"), "word_errors": E.word_distance(F.col("ref_words"), F.col("hyp_words")), "char_errors": E.char_distance(F.col("nref"), F.col("nhyp"))})


def gate(n: Column, n_failed: Column, n_blank: Column) -> Column:
    """Struct of status and reason: no rows, too many failures, or a reference without words abort a cell."""
    reason = F.when(n == 0, "no utterances").when(n_failed / n > MAX_FAILED, "failed utterances").when(n_blank > 0, "blank reference")
    return F.struct(F.when(reason.isNull(), "ok").otherwise("aborted").alias("status"), reason.alias("reason"))


def strict_results(rows: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """One record for each cell: counts, status with its reason, and rates where the status is ok."""
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("failed").alias("n_failed"), F.count_if(F.coalesce("empty", F.lit(False))).alias("n_empty_hyp"), F.count_if(F.col("nref") == "").alias("n_blank_ref"),
        rate("word_errors", "n_ref").alias("wer"), rate("char_errors", "n_chars").alias("cer"), F.sum("n_ref").alias("wer_ref_units"), F.sum("n_chars").alias("cer_ref_units"),
    )
    out = out.withColumn("gate", gate(F.col("n"), F.col("n_failed"), F.col("n_blank_ref")))
    ok = F.col("gate.status") == "ok"
    return out.select(*by, F.col("gate.status").alias("status"), F.col("gate.reason").alias("reason"), "n", "n_failed", "n_empty_hyp", *(F.when(ok, F.col(c)).alias(c) for c in ("wer", "cer", "wer_ref_units", "cer_ref_units")))


def without_marks(rows: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """WER of every cell after all nonspacing marks are dropped from both sides; a diagnostic."""
    bare = rows.select(*by, X.words(U.strip_marks(F.col("nref"))).alias("r"), X.words(U.strip_marks(F.col("nhyp"))).alias("h"))
    return bare.groupBy(*by).agg(rate(E.word_distance(F.col("r"), F.col("h")), F.size("r")).alias("wer_nomarks"))


def resample(errors: np.ndarray, units: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """Ratios of sums, in percent, of resamples by position; drawn a block of resamples at a time."""
    rng = np.random.default_rng(seed)
    n = len(errors)
    block = max(1, 4_000_000 // max(1, n))
    out = []
    for at in range(0, resamples, block):
        index = rng.integers(0, n, size=(min(block, resamples - at), n))
        out.append(100.0 * errors[index].sum(axis=1) / units[index].sum(axis=1))
    return np.concatenate(out)


def resample_counts(errors: np.ndarray, units: np.ndarray, counts: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> np.ndarray:
    """The same in distribution, from how often each pair of errors and units occurs."""
    rng = np.random.default_rng(seed)
    draws = rng.multinomial(int(counts.sum()), counts / counts.sum(), size=resamples)
    return 100.0 * (draws @ errors) / (draws @ units)


def intervals(rows: DataFrame, metrics: dict[str, tuple[str, str]], by: tuple[str, ...] = CELL, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Rates of every cell with 95 % percentile intervals. ``metrics``: name -> columns of errors and units.

    A ratio of sums depends only on how often each pair of errors and units occurs, so of any cell only
    these counts, which are few, come together in one task, and resampling its rows is drawing these
    counts anew. Rows in which a metric is null are left out of it.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    schema = f"{kinds}, " + ", ".join(f"{m} double, {m}_ci_low double, {m}_ci_high double" for m in metrics)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(e).cast("bigint").alias("errors"), F.col(u).cast("bigint").alias("units")) for m, (e, u) in metrics.items()))).alias("x")
    counted = rows.select(*by, each).select(*by, "x.*").filter("errors is not null").groupBy(*by, "metric", "errors", "units").agg(F.count("*").alias("times"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = dict(zip(by, key, strict=True))
        for m in metrics:
            p = part[part["metric"] == m].sort_values(["errors", "units"])
            rate = low = high = None
            errors, units, times = (p[c].to_numpy(dtype=np.int64) for c in ("errors", "units", "times"))
            if len(p) and units @ times:
                rate = 100.0 * int(errors @ times) / int(units @ times)
                low, high = np.percentile(resample_counts(errors, units, times, resamples, seed), [2.5, 97.5])
            out |= {m: rate, f"{m}_ci_low": low, f"{m}_ci_high": high}
        return pd.DataFrame([out])

    return counted.groupBy(*by).applyInPandas(run, schema)


def bootstrap(rows: DataFrame, by: tuple[str, ...] = CELL, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Utterances, WER and CER of every cell with 95 % percentile intervals."""
    found = intervals(rows, {"wer": ("word_errors", "n_ref"), "cer": ("char_errors", "n_chars")}, by, resamples, seed)
    return join_groups(found, rows.groupBy(*by).agg(F.count("*").alias("n")), by)


def bootstrap_positions(rows: DataFrame, by: tuple[str, ...] = CELL, order: str = "pred_id", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """The same by resampling positions in the order of ``order``: the very numbers of a scorer that draws indices.

    A cell comes into one task for this, so more than EXACT_ROWS utterances in one are an error.
    """
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest > EXACT_ROWS:
        raise ValueError(f"a cell has {largest} utterances; positions are drawn for up to {EXACT_ROWS}, counts for any number")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        out = dict(zip(by, key, strict=True)) | {"n": len(part)}
        for name, e, u in (("wer", "word_errors", "n_ref"), ("cer", "char_errors", "n_chars")):
            errors, units = part[e].to_numpy(dtype=np.int64), part[u].to_numpy(dtype=np.int64)
            low, high = np.percentile(resample(errors, units, resamples, seed), [2.5, 97.5])
            out |= {name: 100.0 * errors.sum() / units.sum(), f"{name}_ci_low": low, f"{name}_ci_high": high}
        return pd.DataFrame([out])

    return rows.select(*by, order, "word_errors", "n_ref", "char_errors", "n_chars").groupBy(*by).applyInPandas(run, f"{kinds}, n bigint, wer double, wer_ci_low double, wer_ci_high double, cer double, cer_ci_low double, cer_ci_high double")


def strict_record(predictions: DataFrame, by: tuple[str, ...] = CELL, language: str = "language", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """One whole record for each cell: counts, status, reason, units, and rates with intervals where the status is ok.

    ``wer_plain`` and ``cer_plain`` are given for English, whose headline normaliser isn't published, so
    that both are by the policy; ``wer_nomarks`` and ``cer_nomarks``, of texts without nonspacing marks,
    for languages that write tones or vowels with them. A cell in which a reference is empty without
    its marks is aborted, too.
    """
    rows = strict_utterances(predictions, by)
    marked, english = F.col(language).isin(*MARKED), F.col(language).isin(*ENGLISH)
    bare_r, bare_h = U.strip_marks(F.col("nref")), U.strip_marks(F.col("nhyp"))
    rows = rows.withColumns({"bare_r": F.when(marked, bare_r), "bare_h": F.when(marked, bare_h)}).withColumns({"r": X.words(F.col("bare_r")), "h": X.words(F.col("bare_h"))})
    rows = rows.withColumns({
        "nomarks_errors": F.when(marked, E.word_distance(F.col("r"), F.col("h"))), "nomarks_units": F.when(marked, F.size("r")), "nomarks_cerrors": F.when(marked, E.char_distance(F.col("bare_r"), F.col("bare_h"))), "nomarks_cunits": F.when(marked, F.length("bare_r")),
        "plain_errors": F.when(english, F.col("word_errors")), "plain_cerrors": F.when(english, F.col("char_errors")),
    })
    numbers = ("word_errors", "n_ref", "char_errors", "n_chars", "nomarks_errors", "nomarks_units", "nomarks_cerrors", "nomarks_cunits", "plain_errors", "plain_cerrors")
    rows = materialize(rows.select(*by, "failed", "empty", "nref", (marked & (F.trim("bare_r") == "")).alias("bare"), *numbers), "strict")
    base = join_groups(strict_results(rows, by).drop("wer", "cer"), rows.groupBy(*by).agg(F.count_if("bare").alias("n_bare")), by)
    reason = F.coalesce("reason", F.when(F.col("n_bare") > 0, "blank reference without marks"))
    base = base.withColumns({"reason": reason, "status": F.when(reason.isNull(), "ok").otherwise("aborted")}).drop("n_bare")
    metrics = {"wer": ("word_errors", "n_ref"), "cer": ("char_errors", "n_chars"), "wer_plain": ("plain_errors", "n_ref"), "cer_plain": ("plain_cerrors", "n_chars"), "wer_nomarks": ("nomarks_errors", "nomarks_units"), "cer_nomarks": ("nomarks_cerrors", "nomarks_cunits")}
    found = intervals(rows, metrics, by, resamples, seed)
    rated = [f"{m}{x}" for m in metrics for x in ("", "_ci_low", "_ci_high")]
    out = join_groups(base, found, by, "left")
    return out.select(*base.columns, *(F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in rated), F.lit(f"{resamples} resamples, seed {seed}").alias("bootstrap"))


def paired_delta(rows: DataFrame, a: str, b: str, by: tuple[str, ...] = ("dataset", "language"), resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """WER of model ``a`` minus that of ``b`` on utterances both have, with a 95 % interval.

    Of a sample that a model has several times (re-deliveries, experiments) its first row counts.
    Both sides must have equally many reference words, or the sample is left out and counted in
    ``n_unequal``. Pairs of counts are resampled, so large groups cost no more than small ones.
    """
    first = rows.filter(F.col("model").isin(a, b)).groupBy(*by, "sample_id", "model").agg(F.min(F.struct("pred_id", "word_errors", "n_ref")).alias("x"))
    sides = first.groupBy(*by, "sample_id").agg(F.max(F.when(F.col("model") == a, F.col("x"))).alias("a"), F.max(F.when(F.col("model") == b, F.col("x"))).alias("b")).filter("a is not null and b is not null")
    counts = sides.groupBy(*by, (F.col("a.word_errors") - F.col("b.word_errors")).alias("errors"), F.when(F.col("a.n_ref") == F.col("b.n_ref"), F.col("a.n_ref")).alias("units")).agg(F.count("*").alias("times"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        same = part[part["units"].notna()].sort_values(["errors", "units"])
        out = dict(zip(by, key, strict=True)) | {"n": int(same["times"].sum()), "n_unequal": int(part["times"].sum() - same["times"].sum()), "delta": None, "delta_ci_low": None, "delta_ci_high": None}
        if len(same):
            errors, units, times = (same[c].to_numpy(dtype=np.int64) for c in ("errors", "units", "times"))
            low, high = np.percentile(resample_counts(errors, units, times, resamples, seed), [2.5, 97.5])
            out |= {"delta": 100.0 * (errors @ times) / (units @ times), "delta_ci_low": low, "delta_ci_high": high}
        return pd.DataFrame([out])

    return counts.groupBy(*by).applyInPandas(run, f"{kinds}, n bigint, n_unequal bigint, delta double, delta_ci_low double, delta_ci_high double")


def timing(rows: DataFrame, by: tuple[str, ...], seconds: str) -> DataFrame:
    """Total, average and longest time of every group."""
    return rows.groupBy(*by).agg(F.sum(seconds).alias("total_time"), F.avg(seconds).alias("avg_time_per_sample"), F.max(seconds).alias("max_time"), F.count(seconds).alias("n"))


def accounting(predictions: DataFrame, by: tuple[str, ...] = CELL, error: str | None = None, examples: int = 3) -> DataFrame:
    """Per cell: rows, failed and empty hypotheses, and the first error messages by text, each once."""
    out = [F.count("*").alias("n"), F.count_if(F.col("hypothesis").isNull()).alias("n_failed"), F.count_if(F.col("hypothesis") == "").alias("n_empty_hyp")]
    if error is None:
        return predictions.groupBy(*by).agg(*out)
    distinct = predictions.filter(F.col(error).isNotNull()).groupBy(*by, error).agg(F.count("*").alias("times"))
    top = distinct.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(error))).filter(F.col("r") <= examples).groupBy(*by).agg(F.array_sort(F.collect_list(error)).alias("errors_sample"))
    return join_groups(predictions.groupBy(*by).agg(*out), top, by, "left")
