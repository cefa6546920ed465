import random

import pytest
from pyspark.sql import functions as F

from earshot.llm import langid as L


@pytest.fixture(scope="module")
def samples(spark, data):
    return [(r["language"], r["text"]) for r in spark.read.parquet(f"{data}/lang_samples.parquet").orderBy("sample_no").collect()]


@pytest.fixture(scope="module")
def filters(samples):
    return L.train(samples)


@pytest.fixture(scope="module")
def known(spark, data):
    return L.notations(spark.read.parquet(f"{data}/languages.parquet"))


def test_filters_have_no_false_negatives(samples, filters):
    rng = random.Random(1)
    for language, text in rng.sample(samples, 60):
        bit = filters.languages.index(language)
        for _, _, word in L.units(L.canonical(text)):
            for parts in L.grams(word):
                assert all(filters.languages_of(g) >> bit & 1 for g in parts)


def test_scores_together_are_those_alone(filters):
    words = ["katika", "because", "ሰላም", "日本", "x"]
    together = filters.score_many(words)
    for i, w in enumerate(words):
        hits, sizes = filters.counts(w)
        assert together[i] == pytest.approx((hits * filters.hit + (sizes[:, None] - hits) * filters.miss).sum(axis=0))


def test_held_out_accuracy(samples):
    part = L.train([s for i, s in enumerate(samples) if i % 4])
    reader = L.Reader(part)
    held = [s for i, s in enumerate(samples) if i % 4 == 0]
    got = reader.read([t for _, t in held])
    right = sum(len(p) == 1 and part.languages[p[0][2]] == lang for (lang, _), (p, _) in zip(held, got, strict=True))
    assert right / len(held) >= 0.97


def test_mixed_texts(samples, filters):
    rng = random.Random(4)
    reader = L.Reader(filters)
    right = total = 0
    for _ in range(150):
        (a, x), (b, y) = rng.sample(samples, 2)
        if a == b:
            continue
        parts, _ = reader.read([f"{x} {y}"])[0]
        total += 1
        right += [filters.languages[p[2]] for p in parts] == [a, b]
        assert parts[0][0] == 0 and parts[-1][1] == len(x) + len(y) + 1
        assert all(p[1] == q[0] for p, q in zip(parts, parts[1:], strict=False)) and all(0 < p[3] <= 1 for p in parts)
    assert right / total >= 0.93


def test_loans_and_loops_are_not_mixed(samples, filters):
    reader = L.Reader(filters)
    for language in ("sw_ke", "am_et", "zu_za"):
        text = next(t for lang, t in samples if lang == language)
        words = text.split()
        for odd in (" ".join([*words[:3], "online", *words[3:]]), text + " " + " ".join(words[:3] * 12)):
            parts, _ = reader.read([odd])[0]
            assert [filters.languages[p[2]] for p in parts] == [language]


def test_verdicts(spark, filters, known, samples):
    sw = [t for lang, t in samples if lang == "sw_ke"]
    en = [t for lang, t in samples if lang == "en_us"]
    rows = [(1, sw[0], "SW-KE"), (2, sw[0], "Swahili"), (3, sw[0], "swh"), (4, sw[0], None), (5, sw[0], "xx"), (6, sw[0], "en_us"), (7, f"{sw[0]} {en[0]}", "sw"), (8, None, "sw"), (9, "", None), (10, "12 !?", "en"), (11, sw[1] * 300, "sw"), (12, sw[0], " ")]
    df = spark.createDataFrame(rows, "pred_id bigint, hypothesis string, language string").withColumns({"key": F.lit(0), "label": F.lit("q"), "parts": F.lit(1)})
    got = L.languages_of(df, filters, known)
    assert {r["pred_id"]: r["verdict"] for r in got.collect()} == {1: "right", 2: "right", 3: "right", 4: "missing", 5: "missing", 6: "wrong", 7: "mixed", 8: "none", 9: "none", 10: "none", 11: "right", 12: "missing"}
    assert sorted(map(tuple, L.misfits(got).collect())) == [(4, "sw_ke"), (5, "sw_ke"), (6, "sw_ke"), (7, "en_us"), (7, "sw_ke"), (12, "sw_ke")]
    assert L.languages_of(df.limit(0), filters, known).count() == 0
    assert L.share_by(got, F.lit("x"), "g").first()["n_wrong"] == 1


def test_limits(spark):
    with pytest.raises(ValueError):
        L.Filters([str(i) for i in range(70)])
    df = spark.createDataFrame([("a", f"text {i}") for i in range(30)] + [("b", None), (None, "x")], "language string, text string")
    assert L.fit(df).languages == ["a"]


def test_places_in_texts_that_change():
    text = "ab​c déf ﬁn ｗord end"
    form = L.canonical(text)
    for word in form.split():
        at = form.index(word)
        assert L.canonical(text[: L._place(text, at)]) == form[:at]
