import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import editdist as E
from earshot.operators import analysis as A
from earshot.operators import scoring as S
from earshot.operators import translation as M
from earshot.plans import runner as R

CELL = ("e", "d", "m", "sw_ke")


def table(spark, pairs, cell=CELL):
    rows = [(*cell, i, f"s{i}", r, h) for i, (h, r) in enumerate(pairs)]
    return spark.createDataFrame(rows, "experiment string, dataset string, model string, language string, pred_id bigint, sample_id string, reference string, hypothesis string")


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(
    ("hyp", "ref", "wer"),
    [("a b c d", "a b c d", 0), ("a b x d", "a b c d", 25), ("", "a b c d", 100), ("a b c d e", "a b c d", 25), (None, "a b c d", 100)],
)
def test_hand_computed_wer(spark, hyp, ref, wer):
    assert S.corpus_rates(S.utterances(table(spark, [(hyp, ref)]))).first()["wer"] == wer


def test_hand_computed_cer(spark):
    assert S.corpus_rates(S.utterances(table(spark, [("cut", "cat")]))).first()["cer"] == pytest.approx(100 / 3)


def test_ratio_of_sums(spark):
    got = S.corpus_rates(S.utterances(table(spark, [("a b c x", "a b c d"), ("a", "b"), ("", "?!")]))).first()
    assert got["wer"] == pytest.approx(100 * 2 / 5) and got["num_samples"] == 2


def test_empty_table(spark):
    assert S.corpus_rates(S.utterances(table(spark, [("a", "a")]).limit(0))).count() == 0


def test_word_distance_against_plain(spark):
    rng = random.Random(3)
    vocab = ["a", "bb", "ሰላም", "ọ́", "日本", "x", "y", "z"]
    pairs = [([rng.choice(vocab) for _ in range(rng.randrange(9))], [rng.choice(vocab) for _ in range(rng.randrange(9))]) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "r array<string>, h array<string>").select("r", "h", E.word_distance(F.col("r"), F.col("h")).alias("d"), E.alignment(F.col("r"), F.col("h")).alias("a")).collect()
    for x in rows:
        assert x["d"] == plain(x["r"], x["h"])
        a = x["a"]
        assert a["substitutions"] + a["deletions"] + a["insertions"] == x["d"]
        assert a["deletions"] - a["insertions"] == len(x["r"]) - len(x["h"])
        assert a["hits"] + a["substitutions"] + a["deletions"] == len(x["r"])


def test_alignment_runs(spark):
    df = spark.createDataFrame([("a b c d".split(), "a x y d e".split())], "r array<string>, h array<string>")
    ops = df.select(E.alignment(F.col("r"), F.col("h"))["ops"]).first()[0]
    assert [tuple(o) for o in ops] == [("substitute", "b c", "x y"), ("insert", "", "e")]


@pytest.mark.parametrize(
    ("n", "failed", "refs", "status"),
    [(1000, 1, "a", "ok"), (1000, 3, "a", "aborted"), (1005, 1, "a", "ok"), (1005, 5, "a", "aborted"), (10, 0, "?!", "aborted")],
)
def test_gates(spark, n, failed, refs, status):
    got = S.strict_results(S.strict_utterances(table(spark, [(None if i < failed else "a", refs) for i in range(n)]))).first()
    assert got["status"] == status and got["n_failed"] == failed
    assert (got["wer"] is None) == (status != "ok")


def test_bootstrap_is_that_of_positions(spark):
    rng = np.random.default_rng(5)
    pairs = [(" ".join("ab"[int(rng.integers(2))] for _ in range(4)), "a a a a") for _ in range(40)]
    rows = S.utterances(table(spark, pairs))
    got = S.bootstrap_positions(rows, ("dataset",)).first()
    local = sorted(rows.select("pred_id", "word_errors", "n_ref").collect())
    e, u = (np.array([r[k] for r in local]) for k in ("word_errors", "n_ref"))
    index = np.random.default_rng(0).integers(0, 40, size=(1000, 40))
    low, high = np.percentile(100.0 * e[index].sum(1) / u[index].sum(1), [2.5, 97.5])
    assert (got["wer_ci_low"], got["wer_ci_high"]) == (low, high) and low <= got["wer"] <= high


def test_blocks_of_resamples_are_one_stream():
    e, u = np.arange(1000), np.full(1000, 1000)
    n = len(e)
    whole = 100.0 * e[np.random.default_rng(0).integers(0, n, size=(9000, n))].sum(1) / (u.sum())
    assert (S.resample(e, u, 9000) == whole).all()


def test_counts_are_resampled_at_every_size(spark, monkeypatch):
    rows = S.utterances(table(spark, [("a b" if i % 3 else "a c", "a b") for i in range(300)]))
    monkeypatch.setattr(S, "EXACT_ROWS", 300)
    exact = S.bootstrap_positions(rows, ("dataset",)).first()
    counted = S.bootstrap(rows, ("dataset",)).first()
    assert counted["wer"] == exact["wer"] and counted["n"] == 300 and abs(counted["wer_ci_low"] - exact["wer_ci_low"]) < 1.5
    monkeypatch.setattr(S, "EXACT_ROWS", 299)
    assert S.bootstrap(rows, ("dataset",)).first() == counted
    with pytest.raises(ValueError):
        S.bootstrap_positions(rows, ("dataset",))


def test_strict_record(spark):
    yo = table(spark, [("oo nnkan", "ọ́ọ̀ nǹkan"), ("lowa", "lówà")], ("e", "d", "m", "yo_ng"))
    en = table(spark, [("a b", "a c"), ("a c", "a c")], ("e", "d", "m", "en_us"))
    failed = table(spark, [(None, "a c"), ("a c", "a c")], ("e", "d", "m", "fr_fr"))
    got = {r["language"]: r for r in S.strict_record(yo.unionByName(en).unionByName(failed)).collect()}
    assert got["yo_ng"]["wer"] > 50 and got["yo_ng"]["wer_nomarks"] == 0 == got["yo_ng"]["cer_nomarks"] and got["yo_ng"]["wer_plain"] is None
    assert got["en_us"]["wer"] == got["en_us"]["wer_plain"] == 25 and got["en_us"]["wer_ci_low"] == 0 < got["en_us"]["wer_ci_high"] and got["en_us"]["wer_nomarks"] is None
    assert got["fr_fr"]["status"] == "aborted" and got["fr_fr"]["wer"] is None and got["fr_fr"]["reason"] == "failed utterances" and got["fr_fr"]["n_failed"] == 1


def test_alignments_of_any_size():
    rng = np.random.default_rng(6)
    for n, m in ((0, 3), (3, 0), (5, 7), (80, 90), (60, 55)):
        for words in (2, 5, 50):
            r, h = [str(x) for x in rng.integers(words, size=n)], [str(x) for x in rng.integers(words, size=m)]
            cost = np.array([[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)])
            for i in range(1, n + 1):
                for j in range(1, m + 1):
                    cost[i, j] = min(cost[i - 1, j - 1] + (r[i - 1] != h[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
            steps = E.align(r, h)
            assert sum(s[0] != "equal" for s in steps) == cost[n, m]
            assert [s[1] for s in steps if s[0] != "insert"] == list(range(n)) and [s[2] for s in steps if s[0] != "delete"] == list(range(m))


def test_distances_of_many_different_words(spark):
    words = [f"w{i}" for i in range(1200)]
    df = spark.createDataFrame([(words, words[1:] + ["x"])], "a array<string>, b array<string>")
    assert df.select(E.word_distance(F.col("a"), F.col("b"))).first()[0] == 2


def test_paired_delta(spark):
    a = table(spark, [("a b", "a b"), ("a c", "a b")] * 20, ("e", "d", "one", "l"))
    b = table(spark, [("a c", "a b"), ("a c", "a b")] * 20, ("e", "d", "two", "l"))
    rows = S.utterances(a.unionByName(b))
    got = S.paired_delta(rows, "one", "two").first()
    assert got["delta"] == -25 and got["delta_ci_low"] < -25 < got["delta_ci_high"] and got["n"] == 40
    same = S.paired_delta(S.utterances(a.unionByName(a.withColumn("model", F.lit("two")))), "one", "two").first()
    assert (same["delta"], same["delta_ci_low"], same["delta_ci_high"]) == (0, 0, 0)


def test_marks(spark):
    rows = S.strict_utterances(table(spark, [("oo nnkan", "ọ́ọ̀ nǹkan"), ("lowa", "lówà")]))
    assert S.strict_results(rows).first()["wer"] > 50 and S.without_marks(rows).first()["wer_nomarks"] == 0


def test_stub_models(spark):
    base = table(spark, [("", "a b c"), ("", "d e f g")]).drop("hypothesis")
    rates = lambda name: S.corpus_rates(S.utterances(R.transcribe(base, name))).first()
    assert rates("oracle")["wer"] == 0 and rates("silent")["wer"] == 100
    assert rates("corrupt")["cer"] > 0
    assert S.strict_results(S.strict_utterances(R.transcribe(base, "crash"))).first()["status"] == "aborted"
    with pytest.raises(Exception, match="outputs for"):
        R.transcribe(base.coalesce(1), "wronglength").collect()
    one = R.transcribe(base.repartition(1), lambda: R.FailOne("s1"))
    assert {r["sample_id"]: r["failed"] for r in one.collect()} == {"s0": False, "s1": True}
    lenient = R.transcribe(base, "crash", strict=False).collect()
    assert all(r["hypothesis"] == "" and not r["failed"] for r in lenient)
    assert R.model_factory("my-oracle-v2") is R.Oracle
    with pytest.raises(KeyError):
        R.model_factory("nothing")


def test_cascade_skips_blank(spark):
    base = spark.createDataFrame([("l", "ab"), ("l", " "), ("l", None)], "language string, reference string")
    got = R.cascade(base, "oracle", R.Marked, "x", "y").collect()
    assert sorted((r["intermediate"] or "", r["hypothesis"]) for r in got)[-1] == ("ab", "<y> ab")


def test_shards_equal_whole(spark, data):
    p = spark.read.parquet(f"{data}/predictions.parquet")
    whole = S.corpus_rates(S.utterances(p), ("dataset",)).collect()
    parts = [S.utterances(p.filter(F.col("pred_id") % 3 == i)) for i in range(3)]
    merged = S.corpus_rates(parts[0].unionByName(parts[1]).unionByName(parts[2]), ("dataset",)).collect()
    assert sorted(whole) == sorted(merged)


def test_distribution_against_plain(spark, data):
    rows = S.per_utterance(S.utterances(spark.read.parquet(f"{data}/predictions.parquet"))).toPandas()
    got = {r["dataset"]: r for r in A.distribution(S.utterances(spark.read.parquet(f"{data}/predictions.parquet")), ("dataset",)).collect()}
    for name, part in rows.groupby("dataset"):
        wers = sorted(part["wer"])
        n = len(wers)
        assert got[name]["median_wer"] == pytest.approx(np.median(wers))
        assert got[name]["p90_wer"] == wers[round(0.9 * (n - 1))] and got[name]["p99_wer"] == wers[round(0.99 * (n - 1))]
        keep = part.sort_values(["wer", "pred_id"]).head(n - int(n * 0.01))
        assert got[name]["corpus_wer_trim"] == pytest.approx(100 * keep["word_errors"].sum() / keep["n_ref"].sum())


def test_tiers(spark):
    loop = "a b c d e f g h " * 5
    rows = A.tier_a(S.utterances(table(spark, [("ሰላም ነህ", "a b"), (loop, "a b c d e f g h"), ("a", "a b c d"), ("a b", "a b")]))).orderBy("pred_id").collect()
    assert [r["tier_a"] for r in rows] == ["A1_script", "A2_loop", "A3_truncation", "CLEAN"]


def test_sample_is_fixed_and_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("c"), F.col("id").alias("pred_id"))
    a = A.sample_per_cell(df, 7, 42, ("c",)).collect()
    assert len(a) == 21 and sorted(a) == sorted(A.sample_per_cell(df.repartition(5), 7, 42, ("c",)).collect())


def test_bleu_and_chrf():
    bleu = lambda r, h: M.bleu(M.bleu_counts([r], [h])[0])
    chrf = lambda r, h: M.chrf(M.chrf_counts([r], [h])[0])
    assert bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(100) and chrf("abc def", "abc def") == pytest.approx(100)
    assert bleu("a b c d", "x y z w") == 0
    assert bleu("a b c d e", "") == 0 and chrf("abc", "") == 0
    # 3 of 4 words, 2 of 3 pairs, 1 of 2 triples, 0 of 1: smoothed to 1/2
    assert bleu("a b c d", "a b c x") == pytest.approx(100 * (3 / 4 * 2 / 3 * 1 / 2 * 1 / 2) ** 0.25)
    assert M.tokenize("Hello, world! 3.14 (x)") == ["hello", ",", "world", "!", "3.14", "(", "x", ")"]


def test_extra_columns_do_not_clash(spark):
    df = table(spark, [("a b", "a b")]).withColumns({"nref": F.lit("x"), "wer": F.lit(7.0), "n_ref": F.lit(1), "r": F.lit(0)})
    assert S.corpus_rates(S.utterances(df)).first()["wer"] == 0
    assert A.distribution(S.utterances(df)).count() == 1
