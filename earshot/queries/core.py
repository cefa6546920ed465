"""The registered queries over the test tables; each has its SQL in ``sql``, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import editdist as E
from earshot.functions import languages as L
from earshot.functions import text as X
from earshot.functions import unicode as U
from earshot.operators import analysis as A
from earshot.operators import joins as J
from earshot.operators import quality as Q
from earshot.operators import scoring as S
from earshot.operators import taxonomy as T
from earshot.operators import translation as M
from earshot.plans import plan as P
from earshot.plans import runner as R
from earshot.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _rows(s: SparkSession, d: str) -> DataFrame:
    return S.utterances(table(s, d, "predictions"))


@query
def corpus_error_rates(s, d):
    return S.corpus_rates(_rows(s, d))


@query
def per_utterance_scores(s, d):
    return S.per_utterance(_rows(s, d)).select("pred_id", "n_ref", "n_hyp", "n_chars", "word_errors", "char_errors", "wer", "cer", X.length_ratio(F.col("ref_words"), F.col("hyp_words")).alias("len_ratio"))


@query
def rescored_wer_only(s, d):
    return S.rescore(table(s, d, "predictions"), ("wer",), ("dataset", "model")).select("dataset", "model", "wer", "num_samples", F.col("metric_config")["lowercase"].alias("lowercase"))


@query
def error_distribution(s, d):
    out = A.distribution(_rows(s, d), ("dataset", "language"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_wer", "mean_len_ratio")})


@query
def trimmed_corpus_wer(s, d):
    return A.trimmed(_rows(s, d), ("dataset", "model"))


@query
def outlier_triage(s, d):
    return A.outliers(_rows(s, d))


@query
def upstream_scores(s, d):
    p = table(s, d, "predictions")
    return A.upstream_or_own(S.utterances(p), p).select("pred_id", "wer", "cer")


@query
def normalization_sweep_long(s, d):
    return A.sweep(table(s, d, "predictions"), ("dataset", "language"))


@query
def normalization_sweep_wide(s, d):
    return A.sweep_wide(A.sweep(table(s, d, "predictions"), ("dataset", "language")), ("dataset", "language"))


@query
def numeric_tax(s, d):
    return A.numeric_tax(table(s, d, "predictions"), ("dataset", "language"))


@query
def strict_gate_status(s, d):
    return S.strict_results(S.strict_utterances(table(s, d, "predictions")))


@query
def strict_normalize(s, d):
    return table(s, d, "predictions").select("pred_id", X.policy_normalize(F.col("reference")).alias("ref"), X.policy_normalize(F.col("hypothesis")).alias("hyp"))


@query
def wer_without_marks(s, d):
    return S.without_marks(S.strict_utterances(table(s, d, "predictions"), ("dataset", "language")).filter("nref <> ''"), ("dataset", "language"))


@query
def bootstrap_ci(s, d):
    return S.bootstrap(_rows(s, d), ("dataset", "model"))


@query
def bootstrap_points(s, d):
    """The rates themselves, and whether their intervals hold them."""
    b = S.bootstrap(_rows(s, d), ("dataset", "model"))
    return b.select("dataset", "model", "n", "wer", "cer", ((F.col("wer_ci_low") <= F.col("wer")) & (F.col("wer") <= F.col("wer_ci_high"))).alias("held"))


@query
def strict_records(s, d):
    """Strict records with the rates of all policies, and whether the intervals hold them."""
    r = S.strict_record(table(s, d, "predictions"))
    held = F.when(F.col("status") == "ok", (F.col("wer_ci_low") <= F.col("wer")) & (F.col("wer") <= F.col("wer_ci_high")) & (F.col("cer_ci_low") <= F.col("cer")) & (F.col("cer") <= F.col("cer_ci_high")))
    return r.select(*S.CELL, "status", "reason", "n", "n_failed", "n_empty_hyp", "wer_ref_units", "cer_ref_units", *(F.round(c, 6).alias(c) for c in ("wer", "cer", "wer_plain", "cer_plain", "wer_nomarks", "cer_nomarks")), held.alias("held"))


@query
def paired_points(s, d):
    """Differences of two models on what both have, without intervals."""
    return S.paired_delta(_rows(s, d), "brook_ctc_large", "cinder_llm_7b").select("dataset", "language", "n", "n_unequal", F.round("delta", 6).alias("delta"))


@query
def paired_delta(s, d):
    return S.paired_delta(_rows(s, d), "brook_ctc_large", "cinder_llm_7b")


@query
def length_and_loop_rates(s, d):
    rows = A.tier_a(_rows(s, d), script=False)
    return rows.groupBy("dataset", "model", "tier_a").agg(F.count("*").alias("n"))


@query
def tier_a_rates(s, d):
    return A.tier_a(_rows(s, d)).groupBy("dataset", "model", "tier_a").agg(F.count("*").alias("n"))


@query
def repeat_rates(s, d):
    return _rows(s, d).select("pred_id", X.repeat_rate(F.col("hyp_words")).alias("repeat_rate"))


@query
def dominant_scripts(s, d):
    p = table(s, d, "predictions")
    return p.groupBy(U.dominant_script(F.col("reference")).alias("ref_script"), U.dominant_script(F.col("hypothesis")).alias("hyp_script")).agg(F.count("*").alias("n"))


@query
def seg_and_boundary_proxies(s, d):
    rows = A.proxies(_rows(s, d))
    return rows.groupBy("dataset", "model").agg(S.rate("ns_errors", "ns_chars").alias("scer"), F.count_if("seg_dominated").alias("n_seg_dominated"), F.count_if("boundary_exact").alias("n_boundary_exact"))


@query
def diagnostics(s, d):
    return A.diagnostics(_rows(s, d), table(s, d, "models"), ("dataset", "model"))


@query
def alignment_breakdown(s, d):
    rows = _rows(s, d).withColumn("a", E.alignment(F.col("ref_words"), F.col("hyp_words")))
    return rows.groupBy("dataset", "model").agg(*(F.sum(f"a.{c}").alias(c) for c in ("hits", "substitutions", "deletions", "insertions")), F.sum("word_errors").alias("word_errors"), F.sum("n_ref").alias("n_ref"))


@query
def alignment_totals(s, d):
    """What any best alignment adds up to: errors, words of the reference, words of the hypothesis."""
    a = F.col("a")
    rows = _rows(s, d).withColumn("a", E.operation_counts(F.col("ref_words"), F.col("hyp_words")))
    return rows.groupBy("dataset", "model").agg(F.sum(a["substitutions"] + a["deletions"] + a["insertions"]).alias("errors"), F.sum(a["hits"] + a["substitutions"] + a["deletions"]).alias("ref_words"), F.sum(a["hits"] + a["substitutions"] + a["insertions"]).alias("hyp_words"))


@query
def aligned_ops(s, d):
    return _rows(s, d).select("pred_id", F.explode(E.alignment(F.col("ref_words"), F.col("hyp_words"))["ops"]).alias("op")).select("pred_id", "op.type", "op.ref_span", "op.hyp_span")


@query
def judge_sample(s, d):
    return A.sample_per_cell(_rows(s, d).select(*S.CELL, "pred_id", "sample_id", "nref", "nhyp"), 5, 42)


@query
def judge_sample_sizes(s, d):
    sample = A.sample_per_cell(_rows(s, d).select(*S.CELL, "pred_id"), 5, 42)
    return sample.groupBy(*S.CELL).agg(F.count("*").alias("n"), F.count_distinct("pred_id").alias("n_ids"))


@query
def judge_batches(s, d):
    sample = A.sample_per_cell(table(s, d, "predictions").filter("hypothesis is not null").select(F.col("dataset").alias("benchmark"), "model", F.col("language").alias("lang"), "sample_id", "pred_id", "reference", "hypothesis"), 5, 42, ("benchmark", "model", "lang"))
    return T.requests(sample).select("batch_id", "n_items")


@query
def judge_requests(s, d):
    sample = A.sample_per_cell(table(s, d, "predictions").filter("hypothesis is not null").select(F.col("dataset").alias("benchmark"), "model", F.col("language").alias("lang"), "sample_id", "pred_id", "reference", "hypothesis"), 5, 42, ("benchmark", "model", "lang"))
    return T.requests(sample)


def judgments(p: DataFrame) -> DataFrame:
    """Judgments made up from predictions: provenance by output, errors by number."""
    provenance = F.when(F.col("hypothesis").isNull(), None).when(F.col("hypothesis") == "", "A3_truncation").when(F.col("pred_id") % 11 == 0, "A2_loop").otherwise("CLEAN")
    kinds = F.array(*map(F.lit, T.CATEGORIES))
    errors = F.transform(F.sequence(F.lit(1), (F.col("pred_id") % 4).cast("int") + 1), lambda i: F.struct(F.lit("").alias("ref_span"), F.lit("").alias("hyp_span"), F.element_at(kinds, ((F.col("pred_id") + i * i) % 6 + 1).cast("int")).alias("category"), F.lit(1.0).alias("confidence")))
    return p.select(F.col("dataset").alias("benchmark"), "model", F.col("language").alias("lang"), "sample_id", provenance.alias("provenance"), F.slice(errors, 1, (F.col("pred_id") % 4).cast("int")).alias("errors"))


@query
def taxonomy_summary(s, d):
    return T.per_cell(judgments(table(s, d, "predictions")))


@query
def taxonomy_rollup(s, d):
    return T.by_typology(judgments(table(s, d, "predictions")))


@query
def judge_answers(s, d):
    p = table(s, d, "predictions")
    sample = p.select(F.col("dataset").alias("benchmark"), "model", F.col("language").alias("lang"), F.col("pred_id").cast("string").alias("sample_id"))
    replies = judgments(p.withColumn("sample_id", F.col("pred_id").cast("string"))).filter("sample_id % 3 = 0").select(F.concat_ws("|", *T.CELL, "sample_id").alias("item_id"), "provenance", "errors", F.lit("ok").alias("notes"))
    return T.answers(sample, replies).groupBy("provenance", "notes").agg(F.count("*").alias("n"))


def _index(s: SparkSession, d: str) -> DataFrame:
    return Q.records(table(s, d, "asr_index_v6_16k"))


@query
def overlap_keys(s, d):
    return _index(s, d).select("audio_id", "raw_key")


@query
def cleaned_references(s, d):
    return _index(s, d).select("audio_id", "text", "status")


@query
def sentence_leakage(s, d):
    return Q.sentence_leakage(_index(s, d)).groupBy("source", "language").agg(F.count("*").alias("n_test"), F.count_if("leaks").alias("n_leaks"))


@query
def sentence_overlap(s, d):
    return Q.overlap_sizes(_index(s, d), "raw_key")


@query
def speaker_overlap(s, d):
    return Q.overlap_sizes(_index(s, d), "speaker_id")


@query
def cross_source_overlap(s, d):
    return Q.cross_source(_index(s, d))


@query
def exclusion_reasons(s, d):
    return Q.exclusions(Q.excluded(_index(s, d)))


@query
def clean_manifest(s, d):
    return Q.manifest(Q.excluded(_index(s, d)))


@query
def clean_summary(s, d):
    rows = _index(s, d)
    return Q.clean_summary(Q.excluded(rows), rows).withColumn("hours_clean", F.round("hours_clean", 6))


@query
def audit_report(s, d):
    return Q.audit(_index(s, d)).withColumn("hours", F.round("hours", 6))


@query
def audit_percentiles(s, d):
    out = Q.percentiles(_index(s, d))
    return out.select(*Q.GROUP, *(F.round(c, 6).alias(c) for c in out.columns if c not in Q.GROUP))


@query
def audit_examples(s, d):
    return Q.examples(_index(s, d))


@query
def duplicate_audio(s, d):
    return Q.duplicates(table(s, d, "asr_index_v6_16k").select("audio_id", "path")).select("audio_id", "path")


@query
def duplicate_ids(s, d):
    return Q.duplicate_ids(table(s, d, "asr_index_v6_16k"))


@query
def manifest_reconciliation(s, d):
    judged = Q.excluded(_index(s, d))
    return Q.reconcile(judged.filter("reason is null"), judged.filter("reason is not null"), _index(s, d).filter("split = 'test'"))


@query
def published_exclusions(s, d):
    index = table(s, d, "asr_index_v6_16k")
    known = index.select("audio_id").distinct()
    e = table(s, d, "exclusions")
    return e.join(known.withColumn("there", F.lit(True)), "audio_id", "left").groupBy("reason").agg(F.count("*").alias("n"), F.count_if("there").alias("n_in_index"))


@query
def manifest_assembly(s, d):
    rows = table(s, d, "asr_index_v6_16k")
    manifests = rows.select(F.concat(F.lit("cleaned__"), "source", F.lit("__"), F.coalesce("language", F.lit("none"))).alias("group_key"), F.col("audio_id").alias("sample_id"), "transcript")
    declared = manifests.groupBy("group_key").agg(F.count_distinct("sample_id").cast("int").alias("n_clean"))
    return Q.assemble(manifests, declared)


@query
def parallel_pairs(s, d):
    p = table(s, d, "predictions").select(F.col("sample_id").alias("audio_id"), F.col("pred_id"), F.col("reference").alias("text"))
    i = table(s, d, "asr_index_v6_16k").select("audio_id", F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("pred_id"), F.coalesce("transcript", F.lit("")).alias("text"))
    return J.parallel_pairs(p, i, "audio_id", "pred_id", "text").select("pred_id", "target_text")


@query
def id_overlap_rate(s, d):
    return J.id_overlap(table(s, d, "predictions").select(F.col("sample_id").alias("audio_id")), table(s, d, "asr_index_v6_16k"), "audio_id")


@query
def unmatched_samples(s, d):
    return J.unmatched(table(s, d, "predictions").select(F.col("sample_id").alias("audio_id"), "pred_id"), table(s, d, "asr_index_v6_16k"), "audio_id").select("pred_id", "audio_id")


@query
def payload_problems(s, d):
    p = table(s, d, "predictions").groupBy(F.col("sample_id").alias("audio_id")).agg(F.min("reference").alias("transcript"))
    i = table(s, d, "asr_index_v6_16k").groupBy("audio_id").agg(F.min("transcript").alias("transcript"))
    return J.payload_check(p, i, "audio_id", "transcript").groupBy("problem").agg(F.count("*").alias("n"))


@query
def shard_merge(s, d):
    p = table(s, d, "predictions")
    return J.merge_shards(p.select("pred_id", "shard"), p.select("pred_id"), "pred_id", "shard", 8)


@query
def merged_rows(s, d):
    p = table(s, d, "predictions")
    return J.merged_shards(p.select("pred_id", "shard", "hypothesis"), p.select("pred_id", F.col("pred_id").alias("ordinal")), "pred_id", "ordinal", "shard", 8).select("pred_id", "ordinal", "hypothesis")


@query
def merged_times(s, d):
    """Seconds of shards, made up from their numbers of rows and characters."""
    parts = table(s, d, "predictions").groupBy("experiment", "shard").agg(F.count("*").cast("double").alias("seconds"), F.sum(F.length("reference")).cast("double").alias("audio_seconds"))
    return J.merged_times(parts, ("experiment",))


@query
def strided_shards(s, d):
    p = table(s, d, "predictions").select("pred_id")
    out = J.shard(p, 0, 4, "pred_id").withColumn("i", F.lit(0))
    for i in range(1, 4):
        out = out.unionByName(J.shard(p, i, 4, "pred_id").withColumn("i", F.lit(i)))
    return out.groupBy("i").agg(F.count("*").alias("n"), F.min("pred_id").alias("first"))


@query
def first_rows(s, d):
    return J.first_per_key(table(s, d, "predictions").select("sample_id", "pred_id"), "sample_id", "pred_id")


@query
def pair_expansion(s, d):
    sources = table(s, d, "languages").select("code", F.ascii("code").alias("ordinal"), "script")
    return P.expand_pairs_table(sources.withColumn("ordinal", F.length("code") * 1000 + F.ascii("code")), sources.filter("code in ('en_us', 'fr_fr')").withColumn("ordinal", F.ascii("code"))).select("source_lang", "target_lang")


@query
def language_codes(s, d):
    return L.codes(table(s, d, "languages"))


@query
def recognition_capabilities(s, d):
    return L.recognition(table(s, d, "languages"))


@query
def translation_capabilities(s, d):
    return L.translation(table(s, d, "languages"))


@query
def plan_reasons(s, d):
    languages = table(s, d, "languages")
    datasets = table(s, d, "predictions").select("dataset").distinct()
    plan = datasets.crossJoin(F.broadcast(languages.select(F.col("code").alias("language")))).withColumns({"task": F.lit("asr"), "ordinal": F.lit(0)})
    available = table(s, d, "asr_index_v6_16k").filter("language is not null").select(F.col("source").alias("dataset"), "language")
    supported = L.recognition(languages).filter("backbone = 'tuned_ctc'").select(F.col("code").alias("language"))
    return P.validate(plan, available, supported).select("dataset", "language", "reason")


@query
def todo_cells(s, d):
    p = table(s, d, "predictions")
    plan = p.select("dataset", "model").distinct().crossJoin(F.broadcast(table(s, d, "languages").select(F.col("code").alias("language"))))
    return P.todo(plan, p.filter("language is not null"), ["dataset", "model", "language"])


@query
def todo_rows(s, d):
    p = table(s, d, "predictions")
    done = p.filter("failed = 0").select("sample_id", "model")
    return J.remaining(p.select("pred_id", "sample_id", "model"), done, ["sample_id", "model"])


@query
def todo_orders(s, d):
    return J.remaining(table(s, d, "orders").select("o_orderkey"), table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query
def macro_averages(s, d):
    out = A.macro_averages(S.corpus_rates(_rows(s, d)))
    return out.withColumns({"macro_wer": F.round("macro_wer", 6), "macro_cer": F.round("macro_cer", 6)})


@query
def rates_by_model(s, d):
    return A.with_models(S.corpus_rates(_rows(s, d), ("model",)), table(s, d, "models"))


@query
def error_accounting(s, d):
    p = table(s, d, "predictions")
    out = S.accounting(p.withColumn("error", F.when(F.col("hypothesis").isNull(), F.concat(F.lit("no output in "), "shard"))), ("experiment", "model"), "error")
    return out.select("experiment", "model", "n", "n_failed", "n_empty_hyp", F.array_join("errors_sample", "|").alias("errors_sample"))


@query
def plan_totals(s, d):
    groups = table(s, d, "asr_index_v6_16k").groupBy("source", "language").agg(F.count("*").alias("n"), (F.sum(F.coalesce("duration", F.lit(0.0))) / 3600).alias("hours"))
    return P.totals(groups).withColumn("hours", F.round("hours", 6))


@query
def timing_summary(s, d):
    out = S.timing(table(s, d, "events"), ("event_type",), "value")
    return out.withColumns({c: F.round(c, 4) for c in ("total_time", "avg_time_per_sample")})


@query
def corpus_bleu_chrf(s, d):
    return M.corpus_scores(table(s, d, "predictions"), ("dataset", "model"))


@query
def sentence_bleu_chrf(s, d):
    return M.sentence_scores(table(s, d, "predictions"), ("pred_id",))


@query
def stub_oracle(s, d):
    out = R.transcribe(table(s, d, "predictions").select(*S.CELL, "pred_id", "sample_id", "reference"), "oracle")
    return S.corpus_rates(S.utterances(out), ("dataset",))


@query
def stub_silent(s, d):
    out = R.transcribe(table(s, d, "predictions").select(*S.CELL, "pred_id", "sample_id", "reference"), "silent")
    return S.corpus_rates(S.utterances(out), ("dataset",))


@query
def stub_crash(s, d):
    out = R.transcribe(table(s, d, "predictions").select(*S.CELL, "pred_id", "sample_id", "reference"), "crash")
    return S.strict_results(S.strict_utterances(out, ("dataset",)), ("dataset",)).select("dataset", "status", "n", "n_failed")


@query
def stub_cascade(s, d):
    out = R.cascade(table(s, d, "predictions").select("pred_id", "language", "reference"), "oracle", R.Marked, "sw_ke", "en_us")
    return out.select("pred_id", "intermediate", "hypothesis")


@query
def ctc_collapsed(s, d):
    ids = F.transform(F.split(F.col("sample_id"), ""), lambda c: F.ascii(c) % 5)
    return table(s, d, "predictions").select("pred_id", F.array_join(X.ctc_collapse(ids).cast("array<string>"), ",").alias("labels"))


@query
def language_tags(s, d):
    tagged = F.concat(F.lit("[SWA] "), F.coalesce("hypothesis", F.lit("")))
    p = table(s, d, "predictions").select("pred_id", F.when(F.col("pred_id") % 2 == 0, tagged).otherwise(F.col("hypothesis")).alias("t"))
    return p.select("pred_id", X.language_tag(F.col("t"))["tag"].alias("tag"), X.language_tag(F.col("t"))["text"].alias("text"))


@query
def detokenized(s, d):
    return table(s, d, "predictions").select("pred_id", X.detokenize(F.col("reference")).alias("text"))


@query
def file_names(s, d):
    p = table(s, d, "predictions").select("dataset", "model", "language").distinct()
    path = F.concat(F.lit("/x/"), "dataset", F.lit("/predictions/"), "model", F.lit("_asr_"), F.coalesce("language", F.lit("none")), F.lit(".csv"))
    cell = X.cell_of_path(path)
    return p.select(path.alias("path"), cell["dataset"].alias("dataset"), cell["model"].alias("model"), cell["language"].alias("language"), X.is_recognition_file(path).alias("included"))


@query
def translation_file_names(s, d):
    p = table(s, d, "predictions").select("dataset", "model").distinct().withColumn("k", F.lit(1))
    codes = [r["code"] for r in table(s, d, "languages").select("code").collect()]  # a fixed table of 18 rows
    pairs = p.join(table(s, d, "languages").select(F.col("code").alias("a")), F.lit(True)).join(table(s, d, "languages").select(F.col("code").alias("b")), F.lit(True)).filter("a <> b")
    path = F.concat(F.lit("/x/"), "dataset", F.lit("/predictions/"), "model", F.lit("_ast_"), "a", F.lit("_"), "b", F.lit(".csv"))
    cell = X.translation_cell_of_path(path, codes)
    return pairs.select(path.alias("path"), *(cell[c].alias(c) for c in ("dataset", "model", "source_lang", "target_lang")))


@query
def corpus_guard(s, d):
    from earshot.sources import readers

    return readers.usable(table(s, d, "asr_index_v6_16k"), "transcript", "audio_id")[1]


@query
def language_info(s, d):
    p = table(s, d, "predictions").groupBy("language").agg(F.count("*").alias("n"))
    return A.with_language(p, table(s, d, "languages"))


@query
def pair_reasons(s, d):
    codes = table(s, d, "languages").select("code")
    pairs = J.all_pairs(codes).withColumns({"dataset": F.lit("lakevoice"), "task": F.lit("ast"), "ordinal": F.lit(0)})
    available = table(s, d, "asr_index_v6_16k").select(F.col("source").alias("dataset"), "language")
    return P.validate_pairs(pairs, available, L.translation(table(s, d, "languages")).filter("backbone = 'nllb'")).select("source_lang", "target_lang", "reason")


@query
def fixed_subset(s, d):
    return table(s, d, "predictions").groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(X.in_subset(F.col("sample_id"), 0.1)).alias("n_in_subset"))


@query
def judge_enrichment(s, d):
    out = A.judge_rows(_rows(s, d))
    return out.select("pred_id", "auto_provenance", "features.*", F.size("aligned_ops").alias("n_ops"))


@query
def priority_rows(s, d):
    p = table(s, d, "predictions")
    cells = s.createDataFrame([("lakevoice", "sw_ke"), ("openstudio", "en_us")], "dataset string, language string")
    return A.priority(p, cells, table(s, d, "models").filter("has_lm").select(F.col("model_id").alias("model"))).groupBy("dataset", "language", "model").agg(F.count("*").alias("n"))


@query
def translation_cells(s, d):
    p = table(s, d, "predictions").withColumn("intermediate", F.when(F.col("model").contains("llm"), F.col("hypothesis")))
    return M.cell_records(p, ("dataset", "model")).select("dataset", "model", "model_type", "num_samples", F.round("bleu", 4).alias("bleu"), F.round("chrf", 4).alias("chrf"), "spbleu", "ssa_comet")


@query
def source_languages(s, d):
    from earshot.sources import readers

    return readers.languages(table(s, d, "asr_index_v6_16k"))


@query
def model_language_pairs(s, d):
    from earshot.sources import readers

    return readers.language_pairs(table(s, d, "predictions").filter("language is not null"), "model")

