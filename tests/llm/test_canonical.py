import unicodedata

import pytest
from pyspark.sql import functions as F

from earshot.llm import canonical as C


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("because іt was too clіern", "because it was too cliern"),
        ("parce ｑｕｅ le ８８５", "parce que le 885"),
        ("Maqomiz﻿u ‎ngoba so­ft", "Maqomizu ngoba soft"),
        ("Leo asubuhi wa kituo cha pili", "Leo asubuhi wa kituo cha pili"),
        ("gan‑an ko‐ko", "gan-an ko-ko"),
        ("ﬁne ﬂow", "fine flow"),
        (unicodedata.normalize("NFD", "être à"), "être à"),
        ("ﺍﻟﻨ", unicodedata.normalize("NFKC", "ﺍﻟﻨ")),
        ("пока лиовый", "пока лиовый"),
        ("пoка пaтриник", "пока патриник"),
        ("Κikú sì", "Kikú sì"),
    ],
)
def test_changed(given, expected):
    assert C.canonical(given) == expected
    assert C.canonical(expected) == expected


@pytest.mark.parametrize("text", ["", "क्‌षो में", "你好，世界。「是」", "wait… – “so” it’s", "ọ́ọ̀ nǹkan", "ሰላም። ነህ፧", "он и я — а online", "می‌خواهم", "a\tb\n", "①²ª", "👩‍👩‍👧"])
def test_not_cases(text):
    assert C.canonical(text) == text


def test_none_and_long():
    assert C.canonical(None) is None
    assert C.canonical("а" * 20_000 + " hello") is not None


def test_foreign_words_stay():
    text = "Hakuna mtu – а он ушёл а потом"
    assert C.canonical(text) == text
    assert C.canonical("he saw а dog near the house") == "he saw a dog near the house"


def test_vocabulary_against_brute_force():
    words = {"paper": 5, "caper": 9, "рарег": 1, "соор": 3, "coop": 4, "cooр": 1}
    v = C.Vocabulary(words)

    def cost_zero(token, word):
        token = [c for c in token if not C.ignorable(c)]
        return len(token) == len(word) and all(a == b or b in {x for o in C.ALIKE.get(a, {}).values() for x in o} for a, b in zip(token, word, strict=True))

    for token in ("pаper", "сооp", "ρaper", "co​op", "zebra", "caper"):
        fits = sorted((-n, w) for w, n in words.items() if cost_zero(token, w))
        found = v.lookup(token)
        assert (found[0] if found else None) == (fits[0][1] if fits else None)
    assert v.lookup("papr", 1)[0] == "paper" and v.lookup("papr") is None


def test_vocabulary_decides_ambiguous_letters():
    v = C.Vocabulary({"he": 5, "be": 3})
    assert C.canonical("and нe went", v) == "and he went"


def test_spark(spark):
    rows = [("1", "plain", None), ("2", "dоg", "ａ"), ("2", "dоg", "ａ"), (None, "dоg", "x")]
    df = spark.createDataFrame(rows, "k string, a string, b string").withColumns({"field": F.lit(1), "value": F.lit(2), "table_name": F.lit("z")})
    got = sorted((r["row_key"] or "", r["field"], r["consistent"]) for r in C.changed_values({"t": (df, "k", ["a", "b"])}).collect())
    assert got == [("", "a", "dog"), ("2", "a", "dog"), ("2", "b", "a")]
    assert C.changed_values({"t": (df.limit(0), "k", ["a", "b"])}, []).count() == 0
    assert [r[0] for r in df.select(C.canonical_column(F.col("a"), [("dog", 3)])).collect()] == ["plain", "dog", "dog", "dog"]


def test_safe_values_never_change(spark, data):
    p = spark.read.parquet(f"{data}/predictions.parquet").select("hypothesis").dropna()
    rows = p.select("hypothesis", C.is_safe(F.col("hypothesis")).alias("s")).collect()
    assert all(C.canonical(r["hypothesis"]) == r["hypothesis"] for r in rows if r["s"])
    assert all(bool(C._safe(r["hypothesis"])) == r["s"] for r in rows)


def test_words_are_bounded(spark):
    df = spark.createDataFrame([("a b a",), ("b c",), (None,)], "t string")
    assert dict(C.vocabulary_words(df, "t", 0.3)) == {"a": 2, "b": 2}
