"""Error analysis: distributions, outliers, normalisation sweeps, pathology labels, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.functions import editdist as E
from earshot.functions import text as X
from earshot.functions import unicode as U
from earshot.operators.groups import join_groups
from earshot.operators.scoring import CELL, per_utterance, rate, utterances
from earshot.operators.taxonomy import typology
from earshot.runtime import materialize, small, spread

# Thresholds of the pathology labels and of the proxies.
LOOP_RATIO, LOOP_REPEATS, LOOP_N, SHORT_RATIO = 3.0, 0.5, 5, 0.5
SEG_CER, SEG_WER, COLLAPSE_WER, FORMAT_RATIO, FORMAT_CER, TRIM = 10.0, 30.0, 100.0, 3.0, 15.0, 0.01


def flags(wer: Column, cer: Column) -> tuple[Column, Column]:
    """Collapsed output, and errors that look like a matter of format."""
    return wer >= COLLAPSE_WER, (wer >= FORMAT_RATIO * cer) & (cer <= FORMAT_CER) & (wer > 0)


def upstream_or_own(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per-utterance rates, the upstream ones where they are numbers, else computed ones."""
    given = predictions.select("pred_id", F.col("wer").alias("given_wer"), F.col("cer").alias("given_cer"))
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return per_utterance(rows).join(given, "pred_id").withColumns({"wer": F.when(number("given_wer"), F.col("given_wer")).otherwise(F.col("wer")), "cer": F.when(number("given_cer"), F.col("given_cer")).otherwise(F.col("cer"))}).drop("given_wer", "given_cer")


def distribution(rows: DataFrame, by: tuple[str, ...] = CELL, trim: float = TRIM, order: str = "pred_id") -> DataFrame:
    """Per cell: corpus rates, corpus WER without the worst share, mean, median and nearest-rank percentiles.

    Ranks are counted on values and their frequencies: per-utterance rates are ratios of small
    numbers, so a cell has few of them, however many rows. Of rows with the same rate at the limit of
    the trim the first by ``order`` are kept.
    """
    rows = per_utterance(rows).withColumn("len_ratio", X.length_ratio(F.col("ref_words"), F.col("hyp_words")))
    # Read four times below, so the distances are kept.
    rows = materialize(rows.select(*by, order, "wer", "cer", "word_errors", "n_ref", "char_errors", "n_chars", "len_ratio"), "rates")
    collapse, fmt = flags(F.col("wer"), F.col("cer"))
    base = rows.groupBy(*by).agg(
        F.count("*").alias("n"), rate("word_errors", "n_ref").alias("corpus_wer"), rate("char_errors", "n_chars").alias("corpus_cer"), F.avg("wer").alias("mean_wer"),
        F.count_if(F.col("wer") == 0).alias("n_exact"), F.count_if(collapse).alias("n_collapse"), F.count_if(fmt).alias("n_fmt_artifact"), F.avg("len_ratio").alias("mean_len_ratio"),
    )
    values = rows.groupBy(*by, "wer").agg(F.count("*").alias("times"))
    up = W.partitionBy(*by).orderBy("wer")
    ranked = values.withColumns({"until": F.sum("times").over(up), "n": F.sum("times").over(W.partitionBy(*by))})
    at = lambda r: F.min(F.when(F.col("until") > r, F.col("wer")))
    place = lambda q: F.bround(F.lit(q) * (F.col("n") - 1)).cast("bigint")
    ranks = ranked.groupBy(*by).agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median_wer"), at(place(0.9)).alias("p90_wer"), at(place(0.99)).alias("p99_wer"))
    return join_groups(join_groups(base, ranks, by), trimmed(rows, by, trim, order), by)


def trimmed(rows: DataFrame, by: tuple[str, ...] = CELL, trim: float = TRIM, order: str = "pred_id") -> DataFrame:
    """Corpus WER of every cell without its worst ``trim`` of the utterances, by WER.

    All rows under the limit's rate are kept as sums; only rows at the limit itself are put in order.
    """
    if "wer" not in rows.columns or "ref_words" in rows.columns:
        rows = materialize(per_utterance(rows).select(*by, order, "wer", "word_errors", "n_ref"), "rates")
    values = rows.groupBy(*by, "wer").agg(F.count("*").alias("times"), F.sum("word_errors").alias("e"), F.sum("n_ref").alias("u"))
    up = W.partitionBy(*by).orderBy("wer")
    ranked = values.withColumns({"until": F.sum("times").over(up), "n": F.sum("times").over(W.partitionBy(*by))}).withColumn("keep", F.col("n") - F.floor(F.col("n") * trim))
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col("until") <= F.col("keep"), F.col("e"))).alias("e"), F.sum(F.when(F.col("until") <= F.col("keep"), F.col("u"))).alias("u"), F.min(F.when(F.col("until") > F.col("keep"), F.col("wer"))).alias("limit"), F.max("keep").alias("keep"), F.sum(F.when(F.col("until") <= F.col("keep"), F.col("times"))).alias("whole"))
    edge = join_groups(rows.select(*by, "wer", order, "word_errors", "n_ref"), sums.select(*by, F.col("limit").alias("wer"), (F.col("keep") - F.coalesce("whole", F.lit(0))).alias("more")).filter("more > 0"), [*by, "wer"])
    edge = edge.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(order))).filter("r <= more").groupBy(*by).agg(F.sum("word_errors").alias("e2"), F.sum("n_ref").alias("u2"))
    zero = F.lit(0)
    return join_groups(sums, edge, by, "left").select(*by, (100 * (F.coalesce("e", zero) + F.coalesce("e2", zero)) / (F.coalesce("u", zero) + F.coalesce("u2", zero))).alias("corpus_wer_trim"))


def outliers(rows: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """Utterances with a flag, and which; the caller orders them by cell, WER descending, and key."""
    rows = per_utterance(rows).withColumn("len_ratio", X.length_ratio(F.col("ref_words"), F.col("hyp_words")))
    collapse, fmt = flags(F.col("wer"), F.col("cer"))
    named = F.concat_ws("|", F.when(collapse, "collapse"), F.when(fmt, "fmt"))
    return rows.withColumn("flags", named).filter(F.col("flags") != "").select(*by, "pred_id", "sample_id", "flags", "wer", "cer", "len_ratio", F.col("n_ref").alias("ref_words"), F.col("n_hyp").alias("hyp_words"))


def sweep(predictions: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """WER and CER of every cell under each normalisation scheme, with the step from the scheme before.

    One scan: each row becomes one row for each different form of its texts before it is reduced, and
    says under which schemes it has that form, for most rows have few. A cell without any reference
    under a scheme has rate 0 there, as a defined value.
    """
    forms = F.array(*(F.struct(X.normalize(F.col("reference"), **kw).alias("nref"), X.normalize(F.col("hypothesis"), **kw).alias("nhyp")) for _, kw in X.SCHEMES))
    kept = spread(predictions.select(*by, "reference", "hypothesis")).select(*by, forms.alias("forms"))
    long = kept.select(*by, "forms", F.explode(F.array_distinct("forms")).alias("x")).withColumn("schemes", F.transform("forms", lambda f: f.eqNullSafe(F.col("x")))).select(*by, "schemes", "x.*")
    long = long.filter(F.trim("nref") != "").withColumns({"r": X.words(F.col("nref")), "h": X.words(F.col("nhyp"))})
    long = long.select(*by, "schemes", E.word_distance(F.col("r"), F.col("h")).alias("we"), F.size("r").alias("wu"), E.char_distance(F.col("nref"), F.col("nhyp")).alias("ce"), F.length("nref").alias("cu"))
    # What the schemes share is counted for each of them, in one aggregation.
    part = [F.sum(F.when(F.get("schemes", F.lit(i)), F.col(c))).alias(f"{c}{i}") for i in range(len(X.SCHEMES)) for c in ("we", "wu", "ce", "cu")]
    wide = join_groups(kept.select(*by).distinct(), long.groupBy(*by).agg(*part), by, "left")
    one = [F.struct(F.lit(i).alias("scheme_idx"), F.lit(name).alias("scheme"), *(F.col(f"{c}{i}").alias(c) for c in ("we", "wu", "ce", "cu"))) for i, (name, _) in enumerate(X.SCHEMES)]
    sums = wide.select(*by, F.explode(F.array(*one)).alias("x")).select(*by, "x.*")
    zero = F.lit(0.0)
    rates = sums.select(*by, "scheme_idx", "scheme", F.coalesce(100 * F.col("we") / F.col("wu"), zero).alias("wer"), F.coalesce(100 * F.col("ce") / F.col("cu"), zero).alias("cer"))
    before = F.lag("wer").over(W.partitionBy(*by).orderBy("scheme_idx"))
    return rates.withColumn("step_wer_delta", F.coalesce(before - F.col("wer"), zero)).drop("scheme_idx")


def sweep_wide(long: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """One row for each cell: WER by scheme, and what all schemes together remove."""
    names = [name for name, _ in X.SCHEMES]
    wide = long.groupBy(*by).pivot("scheme", names).agg(F.first("wer"))
    renamed = dict(zip(names, ("raw", "plus_case", "plus_punct", "plus_nfc"), strict=True))
    return wide.withColumnsRenamed(renamed).withColumn("wer_removed", F.col("raw") - F.col("plus_nfc"))


def numeric_tax(predictions: DataFrame, by: tuple[str, ...] = CELL) -> DataFrame:
    """WER over all references, those without and those with digits, and the difference of the first two."""
    form = {"unicode_form": "NFC"}
    rows = utterances(predictions.withColumn("digits", X.has_digit(F.col("reference"))), X.normalize(F.col("reference"), **form), X.normalize(F.col("hypothesis"), **form), (*by, "digits"))
    part = lambda cond: 100 * F.sum(F.when(cond, F.col("word_errors"))) / F.sum(F.when(cond, F.col("n_ref")))
    digits = F.col("digits")
    out = rows.groupBy(*by).agg(rate("word_errors", "n_ref").alias("wer_full"), part(~digits).alias("wer_digit_free"), part(digits).alias("wer_digit_only"), F.count_if(digits).alias("n_digit"), F.count("*").alias("n_total"))
    return out.withColumn("numeric_tax", F.coalesce(F.col("wer_full") - F.col("wer_digit_free"), F.lit(0.0)))


def tier_a(rows: DataFrame, script: bool = True) -> DataFrame:
    """Adds ``len_ratio``, ``repeat_rate`` and ``tier_a``: wrong script, loop, truncation or clean, the first that fits."""
    rows = rows.withColumns({"len_ratio": X.length_ratio(F.col("ref_words"), F.col("hyp_words")), "repeat_rate": X.repeat_rate(F.col("hyp_words"), LOOP_N)})
    wrong = F.coalesce(U.dominant_script(F.col("nref")) != U.dominant_script(F.col("nhyp")), F.lit(False)) if script else F.lit(False)
    loop = (F.col("len_ratio") >= LOOP_RATIO) & (F.col("repeat_rate") >= LOOP_REPEATS)
    return rows.withColumn("tier_a", F.when(wrong, "A1_script").when(loop, "A2_loop").when(F.col("len_ratio") <= SHORT_RATIO, "A3_truncation").otherwise("CLEAN"))


def proxies(rows: DataFrame) -> DataFrame:
    """Adds errors without spaces, and flags of errors by segmentation."""
    rows = per_utterance(rows).withColumns({"ref_ns": X.without_spaces(F.col("nref")), "hyp_ns": X.without_spaces(F.col("nhyp"))})
    return rows.withColumns({"ns_errors": E.char_distance(F.col("ref_ns"), F.col("hyp_ns")), "ns_chars": F.length("ref_ns"), "seg_dominated": (F.col("cer") < SEG_CER) & (F.col("wer") > SEG_WER), "boundary_exact": (F.col("ref_ns") == F.col("hyp_ns")) & (F.col("nref") != F.col("nhyp"))})


def diagnostics(rows: DataFrame, models: DataFrame | None = None, by: tuple[str, ...] = CELL, languages: DataFrame | None = None) -> DataFrame:
    """The whole diagnostic record of every cell; with ``languages`` name, typology and script of its language, too."""
    rows = proxies(tier_a(rows))
    bare_ref, bare_hyp = X.words(U.strip_diacritics(F.col("nref"))), X.words(U.strip_diacritics(F.col("nhyp")))
    rows = rows.withColumns({"aligned": E.operation_counts(F.col("ref_words"), F.col("hyp_words")), "bare_ref": bare_ref, "bare_hyp": bare_hyp})
    rows = rows.withColumn("bare_errors", E.word_distance(F.col("bare_ref"), F.col("bare_hyp")))
    rows = materialize(rows.select(*by, "word_errors", "n_ref", "char_errors", "n_chars", "ns_errors", "ns_chars", "len_ratio", "aligned", "tier_a", "seg_dominated", "boundary_exact", "bare_errors", F.size("bare_ref").alias("n_bare")), "diagnosed")
    share = lambda cond: 100 * F.count_if(cond) / F.count("*")
    part = lambda kind: 100 * F.sum(f"aligned.{kind}") / F.sum("n_ref")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), rate("word_errors", "n_ref").alias("wer"), rate("char_errors", "n_chars").alias("cer"), rate("ns_errors", "ns_chars").alias("scer"),
        F.avg("len_ratio").alias("len_ratio_mean"), part("substitutions").alias("sub_pct"), part("deletions").alias("del_pct"), part("insertions").alias("ins_pct"),
        *(share(F.col("tier_a") == label).alias(f"pct_{label}") for label in ("A1_script", "A2_loop", "A3_truncation")), share(F.col("tier_a") == "CLEAN").alias("pct_clean"),
        share(F.col("seg_dominated")).alias("pct_seg_dominated"), share(F.col("boundary_exact")).alias("pct_boundary_exact"), rate("bare_errors", "n_bare").alias("wer_nodiacritic"),
    )
    out = join_groups(out, percentiles_of(rows, by, "len_ratio", {"len_ratio_median": 0.5}), by)
    out = out.withColumns({"wer_cer_ratio": F.when(F.col("cer") > 0, F.col("wer") / F.col("cer")), "wer_diacritic_recovered": F.col("wer") - F.col("wer_nodiacritic")})
    if models is not None:
        out = with_models(out, models)
    return out if languages is None else with_language(out, languages)


def percentiles_of(rows: DataFrame, by: tuple[str, ...], column: str, shares: dict[str, float]) -> DataFrame:
    """Linear percentiles of every group, counted on its values and their frequencies; nulls are left out.

    Values are summed up before they meet, and no group is held in memory.
    """
    values = rows.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("times"))
    ranked = values.withColumns({"until": F.sum("times").over(W.partitionBy(*by).orderBy(column)), "n": F.sum("times").over(W.partitionBy(*by))})
    at = lambda r: F.min(F.when(F.col("until") > r, F.col(column)))
    low = {name: F.floor(F.lit(q) * (F.col("n") - 1)) for name, q in shares.items()}
    found = ranked.groupBy(*by).agg(F.first("n").alias("n"), *(x for name, q in shares.items() for x in (at(low[name]).alias(f"{name}_low"), at(F.ceil(F.lit(q) * (F.col("n") - 1))).alias(f"{name}_high"))))
    part = lambda name, q: F.lit(q) * (F.col("n") - 1) - low[name]
    return found.select(*by, *((F.col(f"{name}_low") + part(name, q) * (F.col(f"{name}_high") - F.col(f"{name}_low"))).alias(name) for name, q in shares.items()))


def with_language(rows: DataFrame, languages: DataFrame, column: str = "language") -> DataFrame:
    """Adds each language's name (its code where unknown), typology and script."""
    info = small(languages.select(F.col("code").alias(column), F.col("name").alias("lang_name"), F.col("script").alias("ortho")))
    out = rows.join(info, column, "left")
    return out.withColumns({"lang_name": F.coalesce("lang_name", column), "typology": typology(F.col(column))})


def with_models(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Adds each model's display name (its id where unknown) and whether it has a language model."""
    return rows.join(models.select(F.col("model_id").alias("model"), "display", "has_lm"), "model", "left").withColumn("display", F.coalesce("display", "model"))


def macro_averages(rates: DataFrame, by: tuple[str, ...] = ("model", "dataset")) -> DataFrame:
    """Unweighted means over cells, which leave nulls out, and the number of cells."""
    return rates.groupBy(*by).agg(F.avg("wer").alias("macro_wer"), F.avg("cer").alias("macro_cer"), F.count("*").alias("cells"), F.sum("num_samples").alias("num_samples"))


def sample_per_cell(rows: DataFrame, k: int, seed: int, by: tuple[str, ...] = CELL, key: str = "pred_id") -> DataFrame:
    """``k`` rows of every cell without replacement, all of smaller ones, by a hash of seed and key.

    A partial top-k in every task comes before the shuffle, so a hot cell sends at most k rows a task.
    """
    order = F.xxhash64(F.lit(seed), F.col(key))
    spread = rows.withColumns({"_h": order, "_s": F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(64))})
    near = spread.withColumn("_r", F.row_number().over(W.partitionBy(*by, "_s").orderBy("_h", key))).filter(F.col("_r") <= k)
    return near.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("_h", key))).filter(F.col("_r") <= k).drop("_h", "_s", "_r")


def priority(rows: DataFrame, cells: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of the chosen cells (dataset, language) and models; lists are broadcast if they are small."""
    return rows.join(small(cells.select("dataset", "language").distinct()), ["dataset", "language"], "left_semi").join(small(models.select("model").distinct()), "model", "left_semi")


def judge_rows(rows: DataFrame) -> DataFrame:
    """Utterances as a judge sees them: label, features and runs of unequal words."""
    rows = proxies(tier_a(rows)).withColumns({"aligned_ops": E.alignment(F.col("ref_words"), F.col("hyp_words"))["ops"], "bare_ref": U.strip_diacritics(F.col("nref")), "bare_hyp": U.strip_diacritics(F.col("nhyp"))})
    rows = rows.withColumns({"bare_ref": X.words(F.col("bare_ref")), "bare_hyp": X.words(F.col("bare_hyp"))})
    delta = F.col("wer") - 100 * E.word_distance(F.col("bare_ref"), F.col("bare_hyp")) / F.col("n_ref")
    features = F.struct("cer", "wer", (100 * F.col("ns_errors") / F.col("ns_chars")).alias("scer"), "len_ratio", delta.alias("diacritic_wer_delta"))
    return rows.select(F.col("dataset").alias("benchmark"), "model", F.col("language").alias("lang"), "pred_id", "sample_id", F.col("nref").alias("reference"), F.col("nhyp").alias("hypothesis"), F.col("tier_a").alias("auto_provenance"), features.alias("features"), "aligned_ops")
