import unicodedata

import pytest
from pyspark.sql import functions as F

from earshot.functions import text as X
from earshot.functions import unicode as U


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("ọ́ọ̀ nǹkan lówà", unicodedata.normalize("NFC", "ọ́ọ̀ nǹkan lówà")),
        (unicodedata.normalize("NFD", "ọ́ọ̀ nǹkan lówà"), unicodedata.normalize("NFC", "ọ́ọ̀ nǹkan lówà")),
        ("سَيسمح ذلك", unicodedata.normalize("NFC", "سَيسمح ذلك")),
        ("الاجتماعية، التي", "الاجتماعية التي"),
        ("ሰላም። እንዴት ነህ፧", "ሰላም እንዴት ነህ"),
        ("ሰላም፡እንዴት", "ሰላም እንዴት"),
        ("n’ime", "n'ime"),
        ("'hello' world", "hello world"),
        ("don't", "don't"),
        ("kade-kade", "kade kade"),
        ("2023 na 5%", "2023 na 5"),
        ("a‍b", "ab"),
        ("  Habari   YA Asubuhi ", "habari ya asubuhi"),
        (None, ""),
        ("", ""),
    ],
)
def test_policy_normalize(spark, given, expected):
    assert one(spark, X.policy_normalize, given) == expected


def test_policy_is_idempotent(spark, data):
    rows = spark.read.parquet(f"{data}/predictions.parquet").select(X.policy_normalize(F.col("reference")).alias("a"))
    assert rows.filter(F.col("a") != X.policy_normalize(F.col("a"))).count() == 0


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Hello,  World!", "hello world"), ("well-known don't - no", "well-known don't no"), (" a b\n", "a b"), ("ọ́", "ọ"), (None, ""), ("?!", "")],
)
def test_default_normalize(spark, given, expected):
    assert one(spark, X.normalize, given) == expected


def test_normalize_matches_python(spark, data):
    import re

    def plain(t):
        t = re.sub(r"[^\w\s\-']", "", (t or "").lower())
        return re.sub(r"\s+", " ", re.sub(r"\s['\-]\s", " ", t)).strip()

    rows = spark.read.parquet(f"{data}/predictions.parquet").select("hypothesis", X.normalize(F.col("hypothesis")).alias("n")).collect()
    assert all(r["n"] == plain(r["hypothesis"]) for r in rows)


def test_clean_reference(spark):
    cases = [("hello [UM] there", "hello there", None), ("a <noise> b", "a <noise> b", "tag"), ("[pause]", "", "empty_ref"), (None, "", "empty_ref"), ("{x} y", "{x} y", "tag"), ("?!", "?!", "empty_ref")]
    for given, text, status in cases:
        got = one(spark, X.clean_reference, given)
        assert (got["text"], got["status"]) == (text, status)


def test_small_projections(spark):
    assert one(spark, X.drop_silence, "a [s] b") == "a b"
    assert one(spark, X.detokenize, "a , b .") == "a, b."
    assert tuple(one(spark, X.language_tag, " [SWA] habari")) == ("[SWA]", "habari")
    assert tuple(one(spark, X.language_tag, "habari")) == (None, "habari")
    assert one(spark, X.decoder_language, "<|sw|><|transcribe|>") == "sw"
    assert one(spark, X.group_key, "a/b") == "cleaned__a__b"
    assert one(spark, X.to_double, "x") is None and one(spark, X.to_double, "1.5") == 1.5
    assert one(spark, X.words, " a b ") == ["a", "b"] and one(spark, X.words, "") == []
    cell = one(spark, X.cell_of_path, "/r/exp/ds/predictions/m_asr_x_asr_sw_ke.csv")
    assert tuple(cell) == ("ds", "m_asr_x", "sw_ke")
    assert one(spark, X.is_recognition_file, "/a/m_asr_sw_ke.csv") and not one(spark, X.is_recognition_file, "/a/m_asr_ast_es.csv")
    assert one(spark, X.one_line, "a\tb\nc") == "a b\\nc"


def test_ctc_collapse(spark):
    df = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2, 0],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in df.select(X.ctc_collapse(F.col("ids"))).collect()] == [[1, 1, 2], [], None]


def test_repeat_rate(spark):
    df = spark.createDataFrame([(["a"] * 10,), (list("abcde"),), (list("ab"),)], "t array<string>")
    assert [r[0] for r in df.select(X.repeat_rate(F.col("t"))).collect()] == [1 - 1 / 6, 0.0, 0.0]


def test_unicode_functions(spark):
    assert one(spark, U.strip_marks, "ọ́ọ̀ nǹkan lówà") == "oo nnkan lowa"
    assert one(spark, U.strip_diacritics, "é̂") == "e"
    assert one(spark, U.dominant_script, "ab ሰላም ሰላ") == "ETHIOPIC"
    assert one(spark, U.dominant_script, "12") is None and one(spark, U.dominant_script, None) is None
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert one(spark, lambda c, form=form: U.unicode_form(c, form), "ﬁ é é ọ́") == unicodedata.normalize(form, "ﬁ é é ọ́")
    with pytest.raises(ValueError):
        U.unicode_form(F.lit("a"), "X")


def test_subset_is_fixed(spark):
    import zlib

    df = spark.range(500).select(F.col("id").cast("string").alias("k"), X.in_subset(F.col("id").cast("string"), 0.3).alias("x"))
    assert all(r["x"] == (zlib.crc32(r["k"].encode()) % 1000 < 300) for r in df.collect())
