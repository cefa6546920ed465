"""The same queries in SQL for DuckDB."""

from __future__ import annotations

from earshot.functions import languages as L
from earshot.functions.text import APOSTROPHES, TAG, WORD, WS

_ws = WS
# Fixed values, written out once more so that a slip in the code they check is seen.
PROVENANCE = ("CLEAN", "A1_script", "A2_loop", "A3_truncation")
CATEGORIES = ("boundary", "tone_diacritic", "morphology", "sub_phonetic", "sub_lm_plausible", "function_word")
TYPOLOGY = {
    "indo_european": "en_us fr_fr pt_br",
    "own_script": "am_et ti_et ar_eg",
    "tonal": "yo_ng ig_ng",
    "bantu_agglutinative": "bem lg_ug ln_cd sn_zw sw_ke rw_rw xh_za zu_za st_za tn_za",
    "other": "ha_ng mg_mg",
}


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_ws}]+', ' ', 'g'))"


def normal(x: str, lower: bool = True, punct: bool = True, nfc: bool = False) -> str:
    e = f"coalesce({x}, '')"
    e = f"nfc_normalize({e})" if nfc else e
    e = f"lower({e})" if lower else e
    if punct:
        e = f"regexp_replace({e}, '[^{WORD}{_ws}\\-'']', '', 'g')"
        e = f"regexp_replace({e}, '[{_ws}][''\\-][{_ws}]', ' ', 'g')"
    return collapse(e)


def policy(x: str) -> str:
    inside = r"[\p{L}\p{M}\p{N}]"
    e = f"translate(lower(nfc_normalize(coalesce({x}, ''))), '{APOSTROPHES}', '{chr(39) * 2 * len(APOSTROPHES)}')"
    for _ in range(2):
        e = f"regexp_replace({e}, '({inside})''({inside})', '\\1ꙮ\\2', 'g')"
    e = f"regexp_replace({e}, '[\\p{{P}}\\p{{S}}]', ' ', 'g')"
    e = f"regexp_replace({e}, '\\p{{Cf}}', '', 'g')"
    e = f"regexp_replace({e}, '[\\p{{C}}\\p{{Z}}]', ' ', 'g')"
    return f"replace(trim(regexp_replace({e}, ' +', ' ', 'g')), 'ꙮ', '''')"


def key(x: str) -> str:
    return collapse(f"regexp_replace(lower(nfc_normalize({x})), '[^{WORD}{_ws}]', ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def _letters(items: str, v: str) -> str:
    return f"coalesce(array_to_string(list_transform({items}, lambda w: chr(CAST(list_position({v}, w) AS INTEGER))), ''), '')"


def distance(a: str, b: str) -> str:
    """Edit distance of two lists; their distinct items, at most 127, become single bytes."""
    v = f"list_distinct(list_concat({a}, {b}))"
    return f"CASE WHEN {a} = {b} THEN 0 WHEN len({b}) = 0 THEN len({a}) WHEN len({a}) = 0 THEN len({b}) ELSE levenshtein({_letters(a, v)}, {_letters(b, v)}) END"


def chars(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({x}, '') END"


def scored(ref: str, hyp: str, keep: str = "experiment, dataset, model, language, pred_id, sample_id, reference, hypothesis") -> str:
    return f"""n AS (SELECT {keep}, {ref} AS nref, {hyp} AS nhyp FROM predictions),
u AS (SELECT *, {words("nref")} AS r, {words("nhyp")} AS h, {chars("nref")} AS rc, {chars("nhyp")} AS hc FROM n WHERE trim(nref) <> ''),
s AS (SELECT *, len(r) AS n_ref, len(h) AS n_hyp, length(nref) AS n_chars, {distance("r", "h")} AS we, {distance("rc", "hc")} AS ce FROM u)"""


_S = scored(normal("reference"), normal("hypothesis"))
_E = f"WITH {_S}, e AS (SELECT *, 100 * we / n_ref AS wer, 100 * ce / n_chars AS cer, n_hyp / n_ref AS len_ratio FROM s)"
_RATES = "100 * sum(we) / sum(n_ref) AS wer, 100 * sum(ce) / sum(n_chars) AS cer, count(*) AS num_samples"
_STRICT = f"""n AS (SELECT experiment, dataset, model, language, hypothesis, {policy("reference")} AS nref, {policy("hypothesis")} AS nhyp FROM predictions),
u AS (SELECT *, {words("nref")} AS r, {words("nhyp")} AS h, {chars("nref")} AS rc, {chars("nhyp")} AS hc FROM n),
s AS (SELECT *, {distance("r", "h")} AS we, {distance("rc", "hc")} AS ce FROM u)"""
_SPLIT = "CASE regexp_replace(lower(split), '\\s+', '', 'g') WHEN 'training' THEN 'train' WHEN 'validation' THEN 'dev' WHEN 'valid' THEN 'dev' WHEN 'val' THEN 'dev' WHEN 'eval' THEN 'test' ELSE regexp_replace(lower(split), '\\s+', '', 'g') END"
_INDEX = f"""a AS (SELECT audio_id, path, coalesce(transcript, '') AS transcript, language, {_SPLIT} AS split, source, nullif(trim(speaker_id), '') AS speaker_id, sample_rate, duration FROM asr_index_v6_16k),
b AS (SELECT *, nfc_normalize(transcript) AS nfc, regexp_replace(nfc_normalize(transcript), '(?i)\\[(?:um|uhm|cs|pause)\\]', ' ', 'g') AS w FROM a),
c AS (SELECT *, CASE WHEN regexp_matches(w, '{TAG}') THEN w ELSE {collapse("w")} END AS text FROM b),
i AS (SELECT *, CASE WHEN regexp_matches(w, '{TAG}') THEN 'tag' WHEN NOT regexp_matches(text, '[{WORD}]') THEN 'empty_ref' END AS status, {key("transcript")} AS raw_key, {key("text")} AS text_key, regexp_replace(transcript, '^[{_ws}]+|[{_ws}]+$', '', 'g') AS raw FROM c)"""
_ISSUES = f"""{_INDEX}, k AS (SELECT *, CASE WHEN raw <> '' AND duration > 0 THEN length(raw) / duration END AS cps FROM i),
f AS (SELECT *, coalesce(sample_rate <> 16000, true) AS H2_sample_rate, coalesce(duration <= 0, true) AS H3_no_duration, raw = '' AS H5_empty_text, coalesce(duration > 30, false) AS F1_gt_30s, coalesce(duration < 0.5, false) AS F2_lt_0_5s,
 coalesce(NOT (cps BETWEEN 3 AND 35), false) AS F5_chars_per_sec, nfc <> transcript OR regexp_matches(transcript, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]') OR regexp_matches(transcript, '{TAG}') AS F6_text_form FROM k)"""
_CHECKS = ("H2_sample_rate", "H3_no_duration", "H5_empty_text", "F1_gt_30s", "F2_lt_0_5s", "F5_chars_per_sec", "F6_text_form")
_JUDGED = f"""{_INDEX}, other AS (SELECT DISTINCT source, language, raw_key FROM i WHERE split IN ('train', 'dev') AND raw_key <> ''),
firsts AS (SELECT path, min(audio_id) AS first_id FROM i WHERE split = 'test' AND path IS NOT NULL GROUP BY path HAVING count(*) > 1),
t AS (SELECT i.*, x.raw_key IS NOT NULL OR y.raw_key IS NOT NULL AS leaks, first_id, CASE WHEN duration > 0 THEN length(text) / duration ELSE 0.0 END AS cps FROM i
 LEFT JOIN other x ON i.source IS NOT DISTINCT FROM x.source AND i.language IS NOT DISTINCT FROM x.language AND i.raw_key = x.raw_key
 LEFT JOIN other y ON i.source IS NOT DISTINCT FROM y.source AND i.language IS NOT DISTINCT FROM y.language AND i.text_key = y.raw_key
 LEFT JOIN firsts ON firsts.path = i.path WHERE split = 'test'),
j AS (SELECT *, CASE WHEN audio_id > first_id THEN 'duplicate_audio' WHEN duration > 30 THEN 'gt30s' WHEN status IS NOT NULL THEN status WHEN (cps < 1 AND duration >= 5) OR cps > 45 THEN 'chars_per_sec' WHEN leaks THEN 'sentence_overlap' END AS reason FROM t)"""
_KINDS = "[" + ", ".join(f"'{c}'" for c in CATEGORIES) + "]"
_JUDGMENTS = f"""g AS (SELECT dataset AS benchmark, model, language AS lang, pred_id, CASE WHEN hypothesis IS NULL THEN NULL WHEN hypothesis = '' THEN 'A3_truncation' WHEN pred_id % 11 = 0 THEN 'A2_loop' ELSE 'CLEAN' END AS provenance,
 list_transform(range(1, pred_id % 4 + 1), lambda i: {_KINDS}[(pred_id + i * i) % 6 + 1]) AS errors FROM predictions)"""
_COUNTS = ", ".join(f"CAST(coalesce(sum(len(list_filter(used, lambda x: x = '{c}'))), 0) AS BIGINT) AS n_{c}" for c in CATEGORIES)
_ALL = " + ".join(f"n_{c}" for c in CATEGORIES)
_SHARES = f"{_ALL} AS n_errors, " + ", ".join(f"coalesce(100 * n_{c} / nullif({_ALL}, 0), 0.0) AS pct_{c}" for c in CATEGORIES) + ", coalesce(100 * n_sub_lm_plausible / nullif(n_sub_phonetic + n_sub_lm_plausible, 0), 0.0) AS b5_share_of_subs"
_TYPE = "CASE " + " ".join(f"WHEN lang IN ({', '.join(repr(x) for x in codes.split())}) THEN '{name}'" for name, codes in TYPOLOGY.items()) + " ELSE 'unknown' END"
_whisper = ", ".join(f"'{x}'" for x in L.WHISPER.split())
_both = ", ".join(f"'{x}'" for x in L.SEAMLESS_BOTH.split())
_speech = _both + "".join(f", '{x}'" for x in L.SEAMLESS_SPEECH_ONLY.split())
_heard = _both + "".join(f", '{x}'" for x in L.SEAMLESS_TEXT_ONLY.split())
_tuned = "CASE code " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in L.TUNED.items()) + " END"
_CODES = f"""codes AS (SELECT code, name, iso639_3, iso639_1, script, CASE WHEN iso639_1 IN ({_whisper}) THEN iso639_1 END AS whisper, CASE iso639_3 WHEN 'plt' THEN 'mlg' ELSE nullif(iso639_3, '') END AS mms,
 CASE WHEN code IN ('ast_es', 'kea_cv', 'oc_fr', 'yue_hant_hk') THEN NULL WHEN code = 'cmn_hans_cn' THEN 'zho_Hans' ELSE nullif(iso639_3, '') || '_' || nullif(script, '') END AS nllb,
 nullif(iso639_3, '') || '_' || nullif(script, '') AS omni, nullif(iso639_3, '') AS seamless, {_tuned} AS tuned FROM languages)"""
_RECOGNITION = f"""rec AS (SELECT 'whisper' AS backbone, code FROM codes WHERE whisper IS NOT NULL UNION ALL SELECT 'mms', code FROM codes WHERE mms IS NOT NULL UNION ALL SELECT 'omni', code FROM codes WHERE omni IS NOT NULL
 UNION ALL SELECT 'seamless', code FROM codes WHERE seamless IN ({_both}) UNION ALL SELECT 'tuned_ctc', code FROM codes WHERE tuned IS NOT NULL)"""


def _sweep(lower: bool, punct: bool, nfc: bool, idx: int, name: str) -> str:
    form = {"lower": lower, "punct": punct, "nfc": nfc}
    return f"SELECT {idx} AS idx, '{name}' AS scheme, dataset, language, {normal('reference', **form)} AS nref, {normal('hypothesis', **form)} AS nhyp FROM predictions"


_SWEEP = f"""x AS ({" UNION ALL ".join((_sweep(False, False, False, 0, "raw"), _sweep(True, False, False, 1, "+case"), _sweep(True, True, False, 2, "+punct"), _sweep(True, True, True, 3, "+nfc")))}),
u AS (SELECT *, {words("nref")} AS r, {words("nhyp")} AS h, {chars("nref")} AS rc, {chars("nhyp")} AS hc FROM x),
s AS (SELECT idx, scheme, dataset, language, CASE WHEN nref <> '' THEN {distance("r", "h")} END AS we, CASE WHEN nref <> '' THEN len(r) END AS wu, CASE WHEN nref <> '' THEN {distance("rc", "hc")} END AS ce, CASE WHEN nref <> '' THEN length(nref) END AS cu FROM u),
g AS (SELECT idx, scheme, dataset, language, coalesce(100 * sum(we) / sum(wu), 0.0) AS wer, coalesce(100 * sum(ce) / sum(cu), 0.0) AS cer FROM s GROUP BY ALL)"""
_DIST = """r AS (SELECT dataset, language, wer, row_number() OVER w AS rn, count(*) OVER (PARTITION BY dataset, language) AS n, we, n_ref FROM e WINDOW w AS (PARTITION BY dataset, language ORDER BY wer, pred_id)),
half AS (SELECT *, floor(0.9 * (n - 1)) AS a9, 0.9::DOUBLE * (n - 1) AS x9, 0.99::DOUBLE * (n - 1) AS x99 FROM r),
even AS (SELECT *, CASE WHEN x9 - floor(x9) = 0.5 THEN 2 * round(x9 / 2) ELSE round(x9) END AS p9, CASE WHEN x99 - floor(x99) = 0.5 THEN 2 * round(x99 / 2) ELSE round(x99) END AS p99 FROM half)"""

def _13a(x: str) -> str:
    e = f"coalesce({x}, '')"
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        e = f"replace({e}, '{a}', '{b}')"
    e = f"regexp_replace(' ' || {e} || ' ', '([{{-~\\[-` -&(-+:-@/])', ' \\1 ', 'g')"
    e = f"regexp_replace({e}, '([^0-9])([.,])', '\\1 \\2 ', 'g')"
    e = f"regexp_replace({e}, '([.,])([^0-9])', ' \\1 \\2', 'g')"
    e = f"regexp_replace({e}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return _split(f"lower({e})")


def _split(x: str) -> str:
    return f"list_filter(string_split({collapse(x)}, ' '), lambda w: w <> '')"


def _grams(name: str, source: str, orders: int) -> str:
    """n-grams of both sides of every row, and how many of each both have."""
    side = lambda c: f"SELECT pred_id, k, list_slice({c}, i, i + k - 1) AS g, count(*) AS c FROM (SELECT pred_id, {c}, k, unnest(range(1, len({c}) - k + 2)) AS i FROM {source}, range(1, {orders + 1}) o(k) WHERE len({c}) >= k) GROUP BY ALL"
    return f"""{name}_r AS ({side("r")}), {name}_h AS ({side("h")}), {name}_m AS (SELECT pred_id, k, sum(least(x.c, y.c)) AS m FROM {name}_r x JOIN {name}_h y USING (pred_id, k, g) GROUP BY ALL),
{name}_s AS (SELECT dataset, model, k, sum(greatest(len(h) - k + 1, 0)) AS hyp, sum(greatest(len(r) - k + 1, 0)) AS ref, sum(coalesce(m, 0)) AS met FROM (SELECT *, unnest(range(1, {orders + 1})) AS k FROM {source}) LEFT JOIN {name}_m USING (pred_id, k) GROUP BY ALL)"""


_BLEU = f"""btok AS (SELECT pred_id, dataset, model, {_13a("reference")} AS r, {_13a("hypothesis")} AS h FROM predictions), {_grams("b", "btok", 4)},
blen AS (SELECT dataset, model, sum(len(r)) AS rl, sum(len(h)) AS hl FROM btok GROUP BY ALL),
bz AS (SELECT *, sum(CASE WHEN met = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, model ORDER BY k) AS zeros FROM b_s),
bp AS (SELECT dataset, model, avg(ln(CASE WHEN met > 0 THEN 100 * met / hyp ELSE 100 / (pow(2, zeros) * nullif(hyp, 0)) END)) AS l, sum(met) AS met, min(hyp) AS least FROM bz GROUP BY ALL),
bleu AS (SELECT dataset, model, CASE WHEN met = 0 OR least = 0 THEN 0.0 ELSE exp(l) * CASE WHEN hl >= rl THEN 1.0 ELSE exp(1 - rl / hl) END END AS bleu FROM bp JOIN blen USING (dataset, model))"""
_edge = "'.,!?;:\"''()[]{}'"
_pieces = lambda x: f"flatten(list_transform({_split(f'coalesce({x}, {chr(39) * 2})')}, lambda w: CASE WHEN length(w) > 1 AND contains({_edge}, right(w, 1)) THEN [left(w, length(w) - 1), right(w, 1)] WHEN length(w) > 1 AND contains({_edge}, left(w, 1)) THEN [left(w, 1), substr(w, 2)] ELSE [w] END))"
_letters_of = lambda x: chars(f"regexp_replace(coalesce({x}, ''), '[{_ws}]+', '', 'g')")
_CHRF = f"""ctok AS (SELECT pred_id, dataset, model, {_letters_of("reference")} AS r, {_letters_of("hypothesis")} AS h FROM predictions), {_grams("c", "ctok", 6)},
wtok AS (SELECT pred_id, dataset, model, {_pieces("reference")} AS r, {_pieces("hypothesis")} AS h FROM predictions), {_grams("w", "wtok", 2)},
cw AS (SELECT dataset, model, avg(met / hyp) AS p, avg(met / ref) AS q FROM (SELECT * FROM c_s UNION ALL SELECT * FROM w_s) WHERE hyp > 0 AND ref > 0 GROUP BY ALL),
chrf AS (SELECT dataset, model, coalesce(100 * 5 * p * q / nullif(4 * p + q, 0), 0.0) AS chrf FROM cw)"""

SQL = {
    "corpus_error_rates": f"WITH {_S} SELECT experiment, dataset, model, language, {_RATES} FROM s GROUP BY ALL",
    "per_utterance_scores": f"{_E} SELECT pred_id, CAST(n_ref AS INTEGER) AS n_ref, CAST(n_hyp AS INTEGER) AS n_hyp, CAST(n_chars AS INTEGER) AS n_chars, CAST(we AS INTEGER) AS word_errors, CAST(ce AS INTEGER) AS char_errors, wer, cer, len_ratio FROM e",
    "rescored_wer_only": f"WITH {_S} SELECT dataset, model, 100 * sum(we) / sum(n_ref) AS wer, count(*) AS num_samples, 'true' AS lowercase FROM s GROUP BY ALL",
    "error_distribution": f"""{_E}, {_DIST},
base AS (SELECT dataset, language, count(*) AS n, 100 * sum(we) / sum(n_ref) AS corpus_wer, 100 * sum(ce) / sum(n_chars) AS corpus_cer, round(avg(wer), 6) AS mean_wer, count(CASE WHEN wer = 0 THEN 1 END) AS n_exact, count(CASE WHEN wer >= 100 THEN 1 END) AS n_collapse,
 count(CASE WHEN wer >= 3 * cer AND cer <= 15 AND wer > 0 THEN 1 END) AS n_fmt_artifact, round(avg(len_ratio), 6) AS mean_len_ratio FROM e GROUP BY ALL),
q AS (SELECT dataset, language, (min(CASE WHEN rn = floor((n - 1) / 2) + 1 THEN wer END) + min(CASE WHEN rn = floor(n / 2) + 1 THEN wer END)) / 2 AS median_wer, min(CASE WHEN rn = p9 + 1 THEN wer END) AS p90_wer, min(CASE WHEN rn = p99 + 1 THEN wer END) AS p99_wer,
 100 * sum(CASE WHEN rn <= n - floor(n * 0.01::DOUBLE) THEN we END) / sum(CASE WHEN rn <= n - floor(n * 0.01::DOUBLE) THEN n_ref END) AS corpus_wer_trim FROM even GROUP BY ALL)
SELECT base.*, median_wer, p90_wer, p99_wer, corpus_wer_trim FROM base JOIN q ON base.dataset = q.dataset AND base.language IS NOT DISTINCT FROM q.language""",
    "trimmed_corpus_wer": f"""{_E}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, model ORDER BY wer, pred_id) AS rn, count(*) OVER (PARTITION BY dataset, model) AS n FROM e)
SELECT dataset, model, 100 * sum(we) / sum(n_ref) AS corpus_wer_trim FROM r WHERE rn <= n - floor(n * 0.01::DOUBLE) GROUP BY ALL""",
    "outlier_triage": f"""{_E}, f AS (SELECT *, concat_ws('|', CASE WHEN wer >= 100 THEN 'collapse' END, CASE WHEN wer >= 3 * cer AND cer <= 15 AND wer > 0 THEN 'fmt' END) AS flags FROM e)
SELECT experiment, dataset, model, language, pred_id, sample_id, flags, wer, cer, len_ratio, CAST(n_ref AS INTEGER) AS ref_words, CAST(n_hyp AS INTEGER) AS hyp_words FROM f WHERE flags <> ''""",
    "upstream_scores": f"""{_E} SELECT e.pred_id, CASE WHEN p.wer IS NOT NULL AND NOT isnan(p.wer) THEN p.wer ELSE e.wer END AS wer, CASE WHEN p.cer IS NOT NULL AND NOT isnan(p.cer) THEN p.cer ELSE e.cer END AS cer FROM e JOIN predictions p USING (pred_id)""",
    "normalization_sweep_long": f"WITH {_SWEEP} SELECT dataset, language, scheme, wer, cer, coalesce(lag(wer) OVER (PARTITION BY dataset, language ORDER BY idx) - wer, 0.0) AS step_wer_delta FROM g",
    "normalization_sweep_wide": f"""WITH {_SWEEP}, w AS (SELECT dataset, language, max(CASE WHEN idx = 0 THEN wer END) AS raw, max(CASE WHEN idx = 1 THEN wer END) AS plus_case, max(CASE WHEN idx = 2 THEN wer END) AS plus_punct, max(CASE WHEN idx = 3 THEN wer END) AS plus_nfc FROM g GROUP BY ALL)
SELECT *, raw - plus_nfc AS wer_removed FROM w""",
    "numeric_tax": f"""WITH {scored(normal("reference", nfc=True), normal("hypothesis", nfc=True))}, t AS (SELECT *, regexp_matches(reference, '\\p{{Nd}}') AS digits FROM s),
g AS (SELECT dataset, language, 100 * sum(we) / sum(n_ref) AS wer_full, 100 * sum(CASE WHEN NOT digits THEN we END) / sum(CASE WHEN NOT digits THEN n_ref END) AS wer_digit_free, 100 * sum(CASE WHEN digits THEN we END) / sum(CASE WHEN digits THEN n_ref END) AS wer_digit_only, count(CASE WHEN digits THEN 1 END) AS n_digit, count(*) AS n_total FROM t GROUP BY ALL)
SELECT *, coalesce(wer_full - wer_digit_free, 0.0) AS numeric_tax FROM g""",
    "strict_gate_status": f"""WITH {_STRICT}, g AS (SELECT experiment, dataset, model, language, count(*) AS n, count(CASE WHEN hypothesis IS NULL THEN 1 END) AS n_failed, count(CASE WHEN hypothesis = '' THEN 1 END) AS n_empty_hyp, count(CASE WHEN nref = '' THEN 1 END) AS n_blank, 100 * sum(we) / nullif(sum(len(r)), 0) AS wer, 100 * sum(ce) / nullif(sum(length(nref)), 0) AS cer, CAST(sum(len(r)) AS BIGINT) AS wu, CAST(sum(length(nref)) AS BIGINT) AS cu FROM s GROUP BY ALL),
j AS (SELECT *, CASE WHEN n = 0 THEN 'no utterances' WHEN n_failed / n > 0.002 THEN 'failed utterances' WHEN n_blank > 0 THEN 'blank reference' END AS reason FROM g)
SELECT experiment, dataset, model, language, CASE WHEN reason IS NULL THEN 'ok' ELSE 'aborted' END AS status, reason, n, n_failed, n_empty_hyp, CASE WHEN reason IS NULL THEN wer END AS wer, CASE WHEN reason IS NULL THEN cer END AS cer, CASE WHEN reason IS NULL THEN wu END AS wer_ref_units, CASE WHEN reason IS NULL THEN cu END AS cer_ref_units FROM j""",
    "strict_normalize": f"SELECT pred_id, {policy('reference')} AS ref, {policy('hypothesis')} AS hyp FROM predictions",
    "length_and_loop_rates": f"""{_E}, g AS (SELECT *, list_transform(range(1, len(h) - 3), lambda i: array_to_string(h[i:i+4], chr(1))) AS grams FROM e),
t AS (SELECT *, CASE WHEN len(h) >= 5 THEN 1 - len(list_distinct(grams)) / len(grams) ELSE 0 END AS rep FROM g)
SELECT dataset, model, CASE WHEN len_ratio >= 3 AND rep >= 0.5 THEN 'A2_loop' WHEN len_ratio <= 0.5 THEN 'A3_truncation' ELSE 'CLEAN' END AS tier_a, count(*) AS n FROM t GROUP BY ALL""",
    "repeat_rates": f"""{_E}, g AS (SELECT pred_id, h, list_transform(range(1, len(h) - 3), lambda i: array_to_string(h[i:i+4], chr(1))) AS grams FROM e)
SELECT pred_id, CASE WHEN len(h) >= 5 THEN 1 - len(list_distinct(grams)) / len(grams) ELSE 0.0 END AS repeat_rate FROM g""",
    "seg_and_boundary_proxies": f"""{_E}, b AS (SELECT *, replace(nref, ' ', '') AS rn, replace(nhyp, ' ', '') AS hn FROM e), c AS (SELECT *, {chars("rn")} AS rl, {chars("hn")} AS hl FROM b), z AS (SELECT *, {distance("rl", "hl")} AS ne FROM c)
SELECT dataset, model, 100 * sum(ne) / sum(length(rn)) AS scer, count(CASE WHEN cer < 10 AND wer > 30 THEN 1 END) AS n_seg_dominated, count(CASE WHEN rn = hn AND nref <> nhyp THEN 1 END) AS n_boundary_exact FROM z GROUP BY ALL""",
    "taxonomy_summary": f"""WITH {_JUDGMENTS}, h AS (SELECT *, CASE WHEN provenance = 'CLEAN' THEN errors ELSE [] END AS used FROM g),
k AS (SELECT benchmark, model, lang, count(*) AS n_sampled, count(CASE WHEN provenance = 'CLEAN' THEN 1 END) AS n_clean, {", ".join(f"100 * count(CASE WHEN provenance = '{p}' THEN 1 END) / count(*) AS pct_{p}" for p in PROVENANCE)}, {_COUNTS} FROM h GROUP BY ALL)
SELECT benchmark, model, lang, n_sampled, n_clean, {", ".join(f"pct_{p}" for p in PROVENANCE)}, {_SHARES} FROM k""",
    "taxonomy_rollup": f"""WITH {_JUDGMENTS}, h AS (SELECT *, errors AS used, {_TYPE} AS typology FROM g WHERE provenance = 'CLEAN'), k AS (SELECT typology, model, count(*) AS n_clean, {_COUNTS} FROM h GROUP BY ALL)
SELECT typology, model, n_clean, {_SHARES} FROM k WHERE {_ALL} > 0""",
    "judge_answers": f"""WITH {_JUDGMENTS} SELECT CASE WHEN pred_id % 3 = 0 THEN provenance END AS provenance, CASE WHEN pred_id % 3 = 0 AND provenance IS NOT NULL THEN 'ok' ELSE 'no valid answer' END AS notes, count(*) AS n FROM g GROUP BY ALL""",
    "overlap_keys": f"WITH {_INDEX} SELECT audio_id, raw_key FROM i",
    "cleaned_references": f"WITH {_INDEX} SELECT audio_id, text, status FROM i",
    "sentence_leakage": f"WITH {_JUDGED} SELECT source, language, count(*) AS n_test, count(CASE WHEN leaks THEN 1 END) AS n_leaks FROM j GROUP BY ALL",
    "sentence_overlap": f"""WITH {_INDEX}, v AS (SELECT source, language, raw_key, bool_or(split = 'test') AS test, bool_or(split IN ('train', 'dev')) AS other FROM i WHERE raw_key <> '' GROUP BY ALL)
SELECT source, language, count(*) AS n_test, count(CASE WHEN other THEN 1 END) AS n_shared FROM v WHERE test GROUP BY ALL""",
    "speaker_overlap": f"""WITH {_INDEX}, v AS (SELECT source, language, speaker_id, bool_or(split = 'test') AS test, bool_or(split IN ('train', 'dev')) AS other FROM i WHERE speaker_id <> '' GROUP BY ALL)
SELECT source, language, count(*) AS n_test, count(CASE WHEN other THEN 1 END) AS n_shared FROM v WHERE test GROUP BY ALL""",
    "cross_source_overlap": f"""WITH {_INDEX}, x AS (SELECT DISTINCT language, raw_key, source FROM i WHERE split = 'test' AND raw_key <> ''), y AS (SELECT DISTINCT language, raw_key, source AS train_source FROM i WHERE split = 'train' AND raw_key <> '')
SELECT source, language, train_source, count(*) AS n_sentences FROM x JOIN y USING (language, raw_key) WHERE source <> train_source GROUP BY ALL""",
    "exclusion_reasons": f"WITH {_JUDGED} SELECT source, language, audio_id, reason, translate(substring(transcript, 1, 120), chr(9) || chr(10), '  ') AS reference_head FROM j WHERE reason IS NOT NULL",
    "clean_manifest": f"WITH {_JUDGED} SELECT audio_id, path, text AS transcript, replace(replace(transcript, chr(9), ' '), chr(10), '\\n') AS transcript_raw, speaker_id, duration, source, language FROM j WHERE reason IS NULL",
    "clean_summary": f"""WITH {_JUDGED}, g AS (SELECT source, language, count(*) AS n_raw, count(CASE WHEN reason IS NULL THEN 1 END) AS n_clean, {", ".join(f"count(CASE WHEN reason IS NOT DISTINCT FROM '{r}' THEN 1 END) AS n_{r}" for r in ("duplicate_audio", "gt30s", "tag", "empty_ref", "chars_per_sec", "sentence_overlap"))}, round(sum(CASE WHEN reason IS NULL THEN duration END) / 3600, 6) AS hours_clean FROM j GROUP BY ALL),
sp AS (SELECT DISTINCT source, language, speaker_id FROM j WHERE reason IS NULL AND speaker_id IS NOT NULL), el AS (SELECT DISTINCT source, language, speaker_id FROM i WHERE split IN ('train', 'dev') AND speaker_id IS NOT NULL),
cn AS (SELECT sp.source, sp.language, count(*) AS a, count(el.speaker_id) AS b FROM sp LEFT JOIN el ON sp.source = el.source AND sp.language IS NOT DISTINCT FROM el.language AND sp.speaker_id = el.speaker_id GROUP BY ALL)
SELECT g.*, coalesce(a, 0) AS n_speakers, coalesce(b, 0) AS n_speakers_also_in_train_dev, coalesce(b, 0) > 0 AS speaker_dependent, n_clean < 300 AS small_n_lt_300 FROM g LEFT JOIN cn ON g.source = cn.source AND g.language IS NOT DISTINCT FROM cn.language""",
    "audit_report": f"""WITH {_ISSUES}, d AS (SELECT source, language, split, audio_id, count(*) AS c FROM f GROUP BY ALL), dd AS (SELECT source, language, split, count(CASE WHEN c > 1 THEN 1 END) AS H6_duplicate_ids FROM d GROUP BY ALL),
g AS (SELECT source, language, split, count(*) AS n, round(sum(duration) / 3600, 6) AS hours, {", ".join(f"count(CASE WHEN {c} THEN 1 END) AS {c}" for c in _CHECKS)} FROM f GROUP BY ALL),
a2 AS (SELECT g.*, H6_duplicate_ids, CAST(n < 300 AS INTEGER) AS F8_small_n FROM g JOIN dd ON g.source = dd.source AND g.split = dd.split AND g.language IS NOT DISTINCT FROM dd.language)
SELECT *, CASE WHEN {" OR ".join(f"{c} > 0" for c in (*_CHECKS[:3], "H6_duplicate_ids"))} THEN 'FAIL' WHEN {" OR ".join(f"{c} > 0" for c in (*_CHECKS[3:], "F8_small_n"))} THEN 'FLAG' ELSE 'PASS' END AS verdict FROM a2""",
    "audit_percentiles": f"""WITH {_ISSUES} SELECT source, language, split, {", ".join(f"round(quantile_cont(duration, {q}), 6) AS dur_{n}" for n, q in (("min", 0.0), ("p5", 0.05), ("median", 0.5), ("p95", 0.95), ("max", 1.0)))}, {", ".join(f"round(quantile_cont(cps, {q}), 6) AS cps_{n}" for n, q in (("p1", 0.01), ("median", 0.5), ("p99", 0.99)))} FROM f GROUP BY ALL""",
    "audit_examples": f"""WITH {_ISSUES}, l AS ({" UNION ALL ".join(f"SELECT source, language, split, '{c}' AS issue, audio_id FROM f WHERE {c}" for c in _CHECKS)}), r AS (SELECT *, row_number() OVER (PARTITION BY source, language, split, issue ORDER BY audio_id) AS rn FROM l)
SELECT source, language, split, issue, audio_id FROM r WHERE rn <= 3""",
    "duplicate_audio": "WITH g AS (SELECT path, min(audio_id) AS f FROM asr_index_v6_16k WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1) SELECT audio_id, path FROM asr_index_v6_16k JOIN g USING (path) WHERE audio_id > f",
    "duplicate_ids": "SELECT audio_id, count(*) AS copies FROM asr_index_v6_16k GROUP BY audio_id HAVING count(*) > 1",
    "manifest_reconciliation": f"WITH {_JUDGED} SELECT count(*) AS n_raw, count(CASE WHEN reason IS NULL THEN 1 END) AS n_kept, count(CASE WHEN reason IS NOT NULL THEN 1 END) AS n_dropped, CAST(0 AS BIGINT) AS n_unknown, CAST(0 AS BIGINT) AS n_uneven FROM j",
    "published_exclusions": "SELECT reason, count(*) AS n, count(k.audio_id) AS n_in_index FROM exclusions e LEFT JOIN (SELECT DISTINCT audio_id FROM asr_index_v6_16k) k ON e.audio_id = k.audio_id GROUP BY reason",
    "manifest_assembly": """WITH m AS (SELECT 'cleaned__' || source || '__' || coalesce(language, 'none') AS group_key, audio_id, transcript FROM asr_index_v6_16k)
SELECT group_key, CAST(count(DISTINCT audio_id) AS INTEGER) AS n_clean, count(*) AS n, count(*) = count(DISTINCT audio_id) AND count(CASE WHEN trim(coalesce(transcript, '')) = '' THEN 1 END) = 0 AS ok FROM m GROUP BY group_key""",
    "parallel_pairs": """WITH f AS (SELECT audio_id, coalesce(transcript, '') AS t, row_number() OVER (PARTITION BY audio_id ORDER BY indexed_at NULLS FIRST, coalesce(transcript, '')) AS rn FROM asr_index_v6_16k)
SELECT pred_id, t AS target_text FROM predictions JOIN f ON sample_id = audio_id WHERE rn = 1""",
    "id_overlap_rate": """WITH l AS (SELECT DISTINCT sample_id AS k FROM predictions WHERE sample_id IS NOT NULL), r AS (SELECT DISTINCT audio_id AS k FROM asr_index_v6_16k WHERE audio_id IS NOT NULL), c AS (SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right, (SELECT count(*) FROM l JOIN r USING (k)) AS n_shared)
SELECT *, n_shared / n_left AS left_share, n_shared / n_right AS right_share, least(n_shared / n_left, n_shared / n_right) < 0.5 AS low_overlap FROM c""",
    "unmatched_samples": "SELECT pred_id, sample_id AS audio_id FROM predictions WHERE sample_id NOT IN (SELECT audio_id FROM asr_index_v6_16k)",
    "payload_problems": """WITH p AS (SELECT sample_id, min(reference) AS a FROM predictions GROUP BY ALL), i AS (SELECT audio_id, min(transcript) AS b, true AS there FROM asr_index_v6_16k GROUP BY ALL), j AS (SELECT CASE WHEN there IS NULL THEN 'missing' WHEN a IS DISTINCT FROM b THEN 'text differs' END AS problem FROM p LEFT JOIN i ON sample_id = audio_id)
SELECT problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY problem""",
    "shard_merge": "SELECT CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_unknown, count(DISTINCT pred_id) AS n_ids, count(DISTINCT shard) AS n_shards, count(DISTINCT shard) = 8 AND count(*) = count(DISTINCT pred_id) AS ok FROM predictions",
    "strided_shards": "SELECT CAST(pred_id % 4 AS INTEGER) AS i, count(*) AS n, min(pred_id) AS first FROM predictions GROUP BY ALL",
    "first_rows": "SELECT sample_id, min(pred_id) AS pred_id FROM predictions GROUP BY sample_id",
    "pair_expansion": "WITH p AS (SELECT l.code AS s, a.code AS t FROM languages l, languages a WHERE a.code IN ('en_us', 'fr_fr') AND l.code <> a.code) SELECT s AS source_lang, t AS target_lang FROM p UNION SELECT t, s FROM p",
    "language_codes": f"WITH {_CODES} SELECT * FROM codes",
    "recognition_capabilities": f"WITH {_CODES}, {_RECOGNITION} SELECT * FROM rec",
    "translation_capabilities": f"""WITH {_CODES}, p AS (SELECT a.code AS source_lang, b.code AS target_lang, a.whisper AS sw, a.nllb AS sn, b.nllb AS tn, a.seamless AS ss, b.seamless AS ts, a.tuned AS su, b.tuned AS tu FROM codes a, codes b WHERE a.code <> b.code)
SELECT 'whisper' AS backbone, source_lang, target_lang FROM p WHERE sw IS NOT NULL AND target_lang = 'en_us' UNION ALL SELECT 'nllb', source_lang, target_lang FROM p WHERE sn IS NOT NULL AND tn IS NOT NULL
UNION ALL SELECT 'seamless', source_lang, target_lang FROM p WHERE ss IN ({_speech}) AND ts IN ({_heard}) UNION ALL SELECT 'causal_lm', source_lang, target_lang FROM p WHERE su IS NOT NULL AND tu IS NOT NULL""",
    "plan_reasons": f"""WITH {_CODES}, {_RECOGNITION}, p AS (SELECT d.dataset, l.code AS language FROM (SELECT DISTINCT dataset FROM predictions) d, languages l), av AS (SELECT DISTINCT source, language FROM asr_index_v6_16k)
SELECT dataset, p.language, CASE WHEN av.source IS NULL THEN 'not in dataset' WHEN rec.code IS NULL THEN 'not supported by model' END AS reason FROM p LEFT JOIN av ON av.source = dataset AND av.language = p.language LEFT JOIN rec ON rec.code = p.language AND backbone = 'tuned_ctc'""",
    "pair_reasons": f"""WITH {_CODES}, av AS (SELECT DISTINCT language FROM asr_index_v6_16k WHERE source = 'lakevoice'), nl AS (SELECT code FROM codes WHERE nllb IS NOT NULL)
SELECT a.code AS source_lang, b.code AS target_lang, CASE WHEN a.code NOT IN (SELECT language FROM av WHERE language IS NOT NULL) THEN 'source not in dataset' WHEN b.code NOT IN (SELECT language FROM av WHERE language IS NOT NULL) THEN 'target not in dataset' WHEN a.code NOT IN (SELECT code FROM nl) OR b.code NOT IN (SELECT code FROM nl) THEN 'pair not supported by model' END AS reason FROM languages a, languages b WHERE a.code <> b.code""",
    "todo_cells": "SELECT c.dataset, c.model, l.code AS language FROM (SELECT DISTINCT dataset, model FROM predictions) c, languages l WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.dataset = c.dataset AND p.model = c.model AND p.language = l.code)",
    "todo_rows": "SELECT pred_id, sample_id, model FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM predictions q WHERE q.failed = 0 AND q.sample_id = p.sample_id AND q.model = p.model)",
    "todo_orders": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "macro_averages": f"WITH {_S}, g AS (SELECT experiment, dataset, model, language, {_RATES} FROM s GROUP BY ALL) SELECT model, dataset, round(avg(wer), 6) AS macro_wer, round(avg(cer), 6) AS macro_cer, count(*) AS cells, CAST(sum(num_samples) AS BIGINT) AS num_samples FROM g GROUP BY ALL",
    "rates_by_model": f"WITH {_S}, g AS (SELECT model, {_RATES} FROM s GROUP BY ALL) SELECT g.*, coalesce(display, model) AS display, has_lm FROM g LEFT JOIN models ON model_id = model",
    "error_accounting": """WITH e AS (SELECT DISTINCT experiment, model, 'no output in ' || shard AS error FROM predictions WHERE hypothesis IS NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY experiment, model ORDER BY error) AS r FROM e), l AS (SELECT experiment, model, string_agg(error, '|' ORDER BY error) AS errors_sample FROM t WHERE r <= 3 GROUP BY ALL),
g AS (SELECT experiment, model, count(*) AS n, count(CASE WHEN hypothesis IS NULL THEN 1 END) AS n_failed, count(CASE WHEN hypothesis = '' THEN 1 END) AS n_empty_hyp FROM predictions GROUP BY ALL)
SELECT g.*, errors_sample FROM g LEFT JOIN l USING (experiment, model)""",
    "bootstrap_points": f"WITH {_S} SELECT dataset, model, count(*) AS n, 100 * sum(we) / sum(n_ref) AS wer, 100 * sum(ce) / sum(n_chars) AS cer, true AS held FROM s GROUP BY ALL",
    "strict_records": f"""WITH n AS (SELECT experiment, dataset, model, language, hypothesis, {policy("reference")} AS nref, {policy("hypothesis")} AS nhyp, language IN ('yo_ng', 'ig_ng', 'ar_eg', 'ha_ng') AS marked FROM predictions),
m AS (SELECT *, CASE WHEN marked THEN strip_accents(nref) END AS bref, CASE WHEN marked THEN strip_accents(nhyp) END AS bhyp FROM n),
u AS (SELECT *, {words("nref")} AS r, {words("nhyp")} AS h, {chars("nref")} AS rc, {chars("nhyp")} AS hc, {words("bref")} AS br, {words("bhyp")} AS bh, {chars("bref")} AS brc, {chars("bhyp")} AS bhc FROM m),
s AS (SELECT *, {distance("r", "h")} AS we, {distance("rc", "hc")} AS ce, CASE WHEN marked THEN {distance("br", "bh")} END AS bwe, CASE WHEN marked THEN {distance("brc", "bhc")} END AS bce FROM u),
g AS (SELECT experiment, dataset, model, language, count(*) AS n, count(CASE WHEN hypothesis IS NULL THEN 1 END) AS n_failed, count(CASE WHEN hypothesis = '' THEN 1 END) AS n_empty_hyp, count(CASE WHEN nref = '' THEN 1 END) AS n_blank, count(CASE WHEN marked AND trim(bref) = '' THEN 1 END) AS n_bare,
100 * sum(we) / nullif(sum(len(r)), 0) AS wer, 100 * sum(ce) / nullif(sum(length(nref)), 0) AS cer, 100 * sum(bwe) / nullif(sum(len(br)), 0) AS bwer, 100 * sum(bce) / nullif(sum(length(bref)), 0) AS bcer, CAST(sum(len(r)) AS BIGINT) AS wu, CAST(sum(length(nref)) AS BIGINT) AS cu FROM s GROUP BY ALL),
j AS (SELECT *, CASE WHEN n_failed / n > 0.002 THEN 'failed utterances' WHEN n_blank > 0 THEN 'blank reference' WHEN n_bare > 0 THEN 'blank reference without marks' END AS reason FROM g)
SELECT experiment, dataset, model, language, CASE WHEN reason IS NULL THEN 'ok' ELSE 'aborted' END AS status, reason, n, n_failed, n_empty_hyp, CASE WHEN reason IS NULL THEN wu END AS wer_ref_units, CASE WHEN reason IS NULL THEN cu END AS cer_ref_units,
CASE WHEN reason IS NULL THEN round(wer, 6) END AS wer, CASE WHEN reason IS NULL THEN round(cer, 6) END AS cer, CASE WHEN reason IS NULL AND language = 'en_us' THEN round(wer, 6) END AS wer_plain, CASE WHEN reason IS NULL AND language = 'en_us' THEN round(cer, 6) END AS cer_plain,
CASE WHEN reason IS NULL THEN round(bwer, 6) END AS wer_nomarks, CASE WHEN reason IS NULL THEN round(bcer, 6) END AS cer_nomarks, CASE WHEN reason IS NULL THEN true END AS held FROM j""",
    "paired_points": f"""WITH {_S}, f AS (SELECT *, row_number() OVER (PARTITION BY dataset, language, sample_id, model ORDER BY pred_id) AS k FROM s WHERE model IN ('brook_ctc_large', 'cinder_llm_7b')),
p AS (SELECT a.dataset, a.language, a.we AS ae, b.we AS be, a.n_ref AS an, b.n_ref AS bn FROM f a JOIN f b ON a.sample_id = b.sample_id AND a.dataset = b.dataset AND a.language IS NOT DISTINCT FROM b.language WHERE a.model = 'brook_ctc_large' AND b.model = 'cinder_llm_7b' AND a.k = 1 AND b.k = 1)
SELECT dataset, language, count(CASE WHEN an = bn THEN 1 END) AS n, count(CASE WHEN an <> bn THEN 1 END) AS n_unequal, round(100 * sum(CASE WHEN an = bn THEN ae - be END) / sum(CASE WHEN an = bn THEN an END), 6) AS delta FROM p GROUP BY ALL""",
    "alignment_totals": f"WITH {_S} SELECT dataset, model, CAST(sum(we) AS BIGINT) AS errors, CAST(sum(n_ref) AS BIGINT) AS ref_words, CAST(sum(n_hyp) AS BIGINT) AS hyp_words FROM s GROUP BY ALL",
    "judge_sample_sizes": f"WITH {_S} SELECT experiment, dataset, model, language, least(5, count(*)) AS n, least(5, count(*)) AS n_ids FROM s GROUP BY ALL",
    "judge_batches": """WITH c AS (SELECT least(5, count(*)) AS n FROM predictions WHERE hypothesis IS NOT NULL GROUP BY dataset, model, language), t AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM c)
SELECT i AS batch_id, least(10, n - 10 * i) AS n_items FROM t, range(0, 1000000) r(i) WHERE 10 * i < n""",
    "merged_rows": "SELECT pred_id, pred_id AS ordinal, hypothesis FROM predictions",
    "merged_times": "WITH g AS (SELECT experiment, shard, count(*) AS n, sum(length(reference)) AS c FROM predictions GROUP BY ALL) SELECT experiment, CAST(sum(n) AS DOUBLE) AS seconds, CAST(max(n) AS DOUBLE) AS wall_seconds_max_shard, CAST(sum(c) AS DOUBLE) AS audio_seconds, count(*) AS n_shards FROM g GROUP BY experiment",
    "translation_file_names": "WITH p AS (SELECT DISTINCT dataset, model FROM predictions) SELECT '/x/' || dataset || '/predictions/' || model || '_ast_' || a.code || '_' || b.code || '.csv' AS path, dataset, model, a.code AS source_lang, b.code AS target_lang FROM p, languages a, languages b WHERE a.code <> b.code",
    "corpus_guard": """WITH m AS (SELECT audio_id, trim(coalesce(transcript, '')) = '' AS blank FROM asr_index_v6_16k), r AS (SELECT count(*) AS n FROM (SELECT audio_id FROM m WHERE NOT blank GROUP BY audio_id HAVING count(*) > 1)),
g AS (SELECT count(*) AS n_rows, count(CASE WHEN blank THEN 1 END) AS n_empty, CAST(0 AS BIGINT) AS n_unreadable FROM m)
SELECT n_rows, n_empty, n_unreadable, r.n AS n_repeated, n_rows - n_empty AS n_used, n_rows - n_empty < 300 AS small, CASE WHEN n_rows = 0 THEN 'no rows' WHEN n_empty > 0.002 * n_rows THEN 'unusable rows' WHEN r.n > 0 THEN 'repeated ids' END AS problem FROM g, r""",
    "language_info": f"WITH g AS (SELECT language, count(*) AS n FROM predictions GROUP BY language) SELECT language, n, coalesce(name, language) AS lang_name, script AS ortho, {_TYPE.replace('lang IN', 'language IN')} AS typology FROM g LEFT JOIN languages ON code = language",
    "plan_totals": "WITH g AS (SELECT source, language, count(*) AS n, sum(coalesce(duration, 0.0)) / 3600 AS hours FROM asr_index_v6_16k GROUP BY ALL) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS utterances, round(sum(hours), 6) AS hours FROM g",
    "timing_summary": "SELECT event_type, round(sum(value), 4) AS total_time, round(avg(value), 4) AS avg_time_per_sample, max(value) AS max_time, count(value) AS n FROM events GROUP BY event_type",
    "stub_oracle": f"WITH n AS (SELECT dataset, {normal('reference')} AS nref FROM predictions) SELECT dataset, CAST(0 AS DOUBLE) AS wer, CAST(0 AS DOUBLE) AS cer, count(*) AS num_samples FROM n WHERE nref <> '' GROUP BY dataset",
    "stub_silent": f"WITH n AS (SELECT dataset, {normal('reference')} AS nref FROM predictions) SELECT dataset, CAST(100 AS DOUBLE) AS wer, CAST(100 AS DOUBLE) AS cer, count(*) AS num_samples FROM n WHERE nref <> '' GROUP BY dataset",
    "stub_crash": "SELECT dataset, 'aborted' AS status, count(*) AS n, count(*) AS n_failed FROM predictions GROUP BY dataset",
    "stub_cascade": "SELECT pred_id, reference AS intermediate, '<en_us> ' || reference AS hypothesis FROM predictions",
    "ctc_collapsed": """WITH x AS (SELECT pred_id, list_transform(string_split(sample_id, ''), lambda c: ascii(c) % 5) AS v FROM predictions)
SELECT pred_id, coalesce(array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: v[i] <> 0 AND (i = 1 OR v[i] <> v[i - 1])), lambda i: v[i]), ','), '') AS labels FROM x""",
    "language_tags": f"""WITH x AS (SELECT pred_id, CASE WHEN pred_id % 2 = 0 THEN '[SWA] ' || coalesce(hypothesis, '') ELSE coalesce(hypothesis, '') END AS t FROM predictions)
SELECT pred_id, nullif(regexp_extract(t, '^[{_ws}]*(\\[[A-Z]{{3}}\\])[{_ws}]*', 1), '') AS tag, regexp_replace(t, '^[{_ws}]*(\\[[A-Z]{{3}}\\])[{_ws}]*', '') AS text FROM x""",
    "detokenized": f"SELECT pred_id, regexp_replace(regexp_replace(coalesce(reference, ''), '[{_ws}]+([.,!?;:])', '\\1', 'g'), '^[{_ws}]+|[{_ws}]+$', '', 'g') AS text FROM predictions",
    "file_names": "WITH p AS (SELECT DISTINCT dataset, model, language FROM predictions) SELECT '/x/' || dataset || '/predictions/' || model || '_asr_' || coalesce(language, 'none') || '.csv' AS path, dataset, model, nullif(coalesce(language, 'none'), '') AS language, NOT regexp_matches(model || '_asr_' || coalesce(language, 'none'), 'ast|translate|cascaded') AS included FROM p",
    "priority_rows": "SELECT dataset, language, model, count(*) AS n FROM predictions WHERE (dataset, language) IN (('lakevoice', 'sw_ke'), ('openstudio', 'en_us')) AND model IN (SELECT model_id FROM models WHERE has_lm) GROUP BY ALL",
    "translation_cells": f"""WITH {_BLEU}, {_CHRF}, k AS (SELECT dataset, model, CASE WHEN bool_or(model LIKE '%llm%' AND hypothesis IS NOT NULL) THEN 'cascaded' ELSE 'end_to_end' END AS model_type, count(*) AS num_samples FROM predictions GROUP BY ALL)
SELECT k.*, round(bleu, 4) AS bleu, round(chrf, 4) AS chrf, CAST(NULL AS DOUBLE) AS spbleu, CAST(NULL AS DOUBLE) AS ssa_comet FROM k JOIN bleu USING (dataset, model) JOIN chrf USING (dataset, model)""",
    "source_languages": "SELECT language, count(*) AS n FROM asr_index_v6_16k WHERE language IS NOT NULL GROUP BY language",
    "model_language_pairs": "WITH x AS (SELECT DISTINCT model, language FROM predictions WHERE language IS NOT NULL) SELECT a.language AS source_lang, b.language AS target_lang, count(*) AS n FROM x a JOIN x b ON a.model = b.model WHERE a.language <> b.language GROUP BY ALL",
}
