"""Language codes of model families, and what each family can do.

Everything is derived from the ``languages`` dimension (code, iso639_3, iso639_1, script); where a
family's code follows no rule, the exception is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ISO 639-1 codes of one family, and ISO 639-3 codes that another takes as speech and gives as text.
WHISPER = """ar pl ml fo mn haw nn uz cy th mr sw su de lt bn gl sl hi am fa jw la af nl ht ta lb uk az ba ha ps br is ja
kk so sv hr id mg vi tg bs ms tl da ro hy zh sd fr bo ko lo si es tt mi et km my no hu ur mk fi el tk sa ne yi bg he ca sr
lv kn be tr ln as en pa yo sk oc eu yue it sn gu ru pt sq ka mt cs te"""
SEAMLESS_BOTH = """afr amh arb ary arz asm azj bel ben bos bul cat ceb ces ckb cmn cmn_Hant cym dan deu ell eng est eus fin
fra fuv gaz gle glg guj hau heb hin hrv hun hye ibo ind isl ita jav jpn kan kat kaz khk khm kir kor lao lin lit lug luo lvs
mai mal mar mkd mlt mni mya nld nno nob npi nya ory pan pbt pes pol por ron rus slk slv sna snd som spa srp swe swh tam tel
tgk tgl tha tur ukr urd uzn vie yor yue zul"""
SEAMLESS_SPEECH_ONLY, SEAMLESS_TEXT_ONLY = "ast kam kea ltz oci xho zlm", "zsm"
# Codes that follow no rule, languages a family leaves out, and languages of the fine-tuned models.
MMS_OVERRIDES, NLLB_OVERRIDES, NLLB_WITHOUT = {"plt": "mlg"}, {"cmn_hans_cn": "zho_Hans"}, ("ast_es", "kea_cv", "oc_fr", "yue_hant_hk")
TUNED = {
    "af_za": "afrikaans", "am_et": "amharic", "ar_eg": "arabic", "bem": "bemba", "en_us": "english", "fr_fr": "french", "ha_ng": "hausa", "ig_ng": "igbo", "rw_rw": "kinyarwanda", "ln_cd": "lingala", "lg_ug": "luganda",
    "mg_mg": "malagasy", "pt_br": "portuguese", "sn_zw": "shona", "st_za": "sotho", "sw_ke": "swahili", "ti_et": "tigrinya", "tn_za": "tswana", "xh_za": "xhosa", "yo_ng": "yoruba", "zu_za": "zulu",
}
#: Fixed value: the only target of the first family's translation.
ENGLISH = "en_us"


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def codes(languages: DataFrame) -> DataFrame:
    """Every language with its code in each family; null where the family doesn't have it."""
    iso3, script = F.nullif("iso639_3", F.lit("")), F.nullif("script", F.lit(""))
    tagged = F.concat_ws("_", iso3, script)
    both = iso3.isNotNull() & script.isNotNull()
    nllb = F.when(F.col("code").isin(*NLLB_WITHOUT), None).otherwise(F.coalesce(_lookup(F.col("code"), NLLB_OVERRIDES), F.when(both, tagged)))
    return languages.select(
        "code", "name", "iso639_3", "iso639_1", "script", F.when(F.col("iso639_1").isin(*WHISPER.split()), F.col("iso639_1")).alias("whisper"), F.coalesce(_lookup(iso3, MMS_OVERRIDES), iso3).alias("mms"),
        nllb.alias("nllb"), F.when(both, tagged).alias("omni"), iso3.alias("seamless"), _lookup(F.col("code"), TUNED).alias("tuned"),
    )


def code_of(languages: DataFrame, column: str, value: str) -> str | None:
    """The first code, by code, with ``value`` in an ISO column; null if there is none."""
    row = languages.filter(F.col(column) == value).agg(F.min("code")).first()
    return row[0]


def recognition(languages: DataFrame) -> DataFrame:
    """``backbone``, ``code`` of every language that a family can recognise."""
    c = codes(languages)
    both = SEAMLESS_BOTH.split()
    able = {"whisper": F.col("whisper").isNotNull(), "mms": F.col("mms").isNotNull(), "omni": F.col("omni").isNotNull(), "seamless": F.col("seamless").isin(*both), "tuned_ctc": F.col("tuned").isNotNull()}
    return c.select("code", F.explode(F.filter(F.array(*(F.when(ok, F.lit(n)) for n, ok in able.items())), lambda x: x.isNotNull())).alias("backbone")).select("backbone", "code")


def translation(languages: DataFrame) -> DataFrame:
    """``backbone``, ``source_lang``, ``target_lang`` of every pair that a family can translate."""
    from earshot.operators.joins import all_pairs
    from earshot.runtime import small

    c = small(codes(languages))
    pairs = all_pairs(languages)
    side = lambda name: c.select(F.col("code").alias(f"{name}_lang"), F.col("whisper").alias(f"{name}_whisper"), F.col("nllb").alias(f"{name}_nllb"), F.col("seamless").alias(f"{name}_seamless"), F.col("tuned").alias(f"{name}_tuned"))
    joined = pairs.join(side("source"), "source_lang").join(side("target"), "target_lang")
    speech, text = [*SEAMLESS_BOTH.split(), *SEAMLESS_SPEECH_ONLY.split()], [*SEAMLESS_BOTH.split(), *SEAMLESS_TEXT_ONLY.split()]
    able = {
        "whisper": F.col("source_whisper").isNotNull() & (F.col("target_lang") == ENGLISH), "nllb": F.col("source_nllb").isNotNull() & F.col("target_nllb").isNotNull(),
        "seamless": F.col("source_seamless").isin(*speech) & F.col("target_seamless").isin(*text), "causal_lm": F.col("source_tuned").isNotNull() & F.col("target_tuned").isNotNull(),
    }
    return joined.select("source_lang", "target_lang", F.explode(F.filter(F.array(*(F.when(ok, F.lit(n)) for n, ok in able.items())), lambda x: x.isNotNull())).alias("backbone")).select("backbone", "source_lang", "target_lang")
