import random

import pytest
from pyspark.sql import functions as F

from earshot.llm import truncation as X


@pytest.fixture(scope="module")
def rows(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    return [(r["hypothesis"], r["reference"]) for r in spark.read.parquet(f"{sf}/predictions.parquet").select("pred_id", "hypothesis", "reference").orderBy("pred_id").collect()]


@pytest.fixture(scope="module")
def model(rows):
    return X.train([r for i, r in enumerate(rows) if i % 2])


def test_held_out_cuts(rows, model):
    rng = random.Random(8)
    cut = whole = cut_found = whole_found = 0
    for h, r in [x for i, x in enumerate(rows) if i % 2 == 0]:
        other = X.parse(r)
        own = X.parse(h)
        if own is None or other is None or len(set(own[2]) & set(other[2])) < 0.7 * len(set(other[2])):
            continue
        if own[2][-1] != other[2][-1]:
            continue
        whole += 1
        whole_found += model.score(X.features(own, other)) > 0
        short = X.cut(h, rng)
        if short and X.parse(short) and X.parse(short)[2] and X.parse(short)[2][-1] != own[2][-1]:
            cut += 1
            cut_found += model.score(X.features(X.parse(short), other)) > 0
    assert cut > 500 and cut_found / cut >= 0.9 and whole_found / whole <= 0.01


def test_finishes_alone_are_no_cuts(model):
    text = "sisi tuliona miwiji 295 katika misui ya Njomava na kisha vitedoji wamembumika mnohoji karibu na Hohuzanja"
    for end in ("", ".", "…", "...", " -", "\xa0", "?"):
        assert model.score(X.features(X.parse(text + end), X.parse(text))) < 0
    for short in (text[:60], text[:60] + "…", text[:47] + " [...]", text[:46] + " "):
        assert model.score(X.features(X.parse(short), X.parse(text))) > 0


def test_noise_is_no_cut(model):
    ref = "kila mamuji wa Hosase alinandika vikaji yake lakini mjuu na miganoji wameshewa kabla ya mniu kufika Roga"
    for hyp in ("kila mamujji wa alinandika vikaji yake lakini mjuu na na miganoji kabla ya mniu kufika roga", ref.lower(), ref.replace("na ", "")):
        assert model.score(X.features(X.parse(hyp), X.parse(ref))) < 0
        assert model.score(X.features(X.parse(ref), X.parse(hyp))) < 0


def test_spark(spark, rows, model):
    text = "sisi tuliona miwiji 295 katika misui ya Njomava na kisha vitedoji wamembumika mnohoji karibu na Hohuzanja"
    data = [(1, text, text, "a"), (2, text[:50], text, "a"), (3, None, text, "b"), (4, "", text, "b"), (5, "  ", None, None), (2, text[:50], text, "a"), (6, text * 200, text, "a")]
    df = spark.createDataFrame(data, "pred_id bigint, hypothesis string, reference string, dataset string").withColumns({"key": F.lit(1), "score": F.lit(2), "grp": F.lit(3), "field": F.lit("x")})
    got = X.scores(df, model)
    assert {(r["pred_id"], r["field"]) for r in got.filter("cut").collect()} == {(2, "hypothesis")}
    assert got.count() == 10
    assert {(r["dataset"], r["field"]): r["n_cut"] for r in X.rates(got).collect()}[("a", "hypothesis")] == 2
    assert X.scores(df.limit(0), model).count() == 0
    empty = X.fit(df.limit(0))
    assert X.scores(df, empty).filter("cut").count() == 0


def test_sample_is_bounded(spark, rows):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows[:600])], "pred_id bigint, hypothesis string, reference string")
    assert X.fit(df, sample=100).weights.any()


def test_cuts_at_the_limit_of_a_field(spark, rows):
    """Values of one source are cut at exactly 60 characters; without another text only their length tells."""
    data = [(i, h, r, "b") for i, (h, r) in enumerate(rows[:1500])]
    n = 0
    for i, (h, r) in enumerate(rows[1500:5000]):
        short = h and r and len(h) > 70 and i % 4 == 0 and h[:60].strip() == h[:60] and h[59].isalpha() and h[60].isalpha()
        data.append((10_000 + i, h[:60] if short else h, None if short else r, "a"))
        n += bool(short)
    df = spark.createDataFrame(data, "pred_id bigint, hypothesis string, reference string, dataset string")
    found = X.known_limits(df)
    assert ("a", 0, 60) in {(r["grp"], r["field"], r["size"]) for r in found.collect()}
    got = {r["pred_id"] for r in X.scores(df, X.fit(df, found), found).filter("cut and field = 'hypothesis'").collect()}
    planted = {x[0] for x in data if x[3] == "a" and x[2] is None and x[1] and len(x[1]) == 60 and x[0] >= 10_000}
    assert n > 50 and len(got & planted) / len(planted) > 0.95


def test_no_limits(spark):
    df = spark.createDataFrame([(i, "x" * (10 + i % 40) + str(i), None, None) for i in range(400)], "pred_id bigint, hypothesis string, reference string, dataset string")
    assert X.limits(df).count() == 0 and X.limits(df.limit(0)).count() == 0


def test_parse():
    assert X.parse(None) is None and X.parse(" ") is None
    assert X.parse("Abc def…")[0] == "…" and X.parse("Abc def -")[0] == "-s" and X.parse("Abc &quo")[0] == "entity" and X.parse("Abc ")[0] == "blank" and X.parse("Abc\xa0")[0] == "other blank"
    assert X.parse("ไม่มีใคร")[3] and X.parse("[um] ab")[2] == ["ab"]
