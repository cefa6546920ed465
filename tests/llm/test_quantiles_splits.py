import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import quantiles as Q
from earshot.llm import splits as S


def rank_errors(sketch, values, shares):
    ordered = np.sort(values)
    for q, v in zip(shares, sketch.quantiles(shares), strict=True):
        target = max(1, math.ceil(q * len(values)))
        low, high = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
        yield max(0, low - target, target - high)


@pytest.mark.parametrize("order", ["random", "sorted", "reverse", "ties"])
def test_bound_holds(order):
    values = np.random.default_rng(1).lognormal(size=50_000)
    values = {"random": values, "sorted": np.sort(values), "reverse": np.sort(values)[::-1], "ties": np.round(values)}[order]
    s = Q.Sketch(64)
    for part in np.array_split(values, 77):
        s.add(part)
    assert s.n == len(values) and s.error <= s.n * math.log2(s.n / 64) / (2 * 64) + 1
    assert max(rank_errors(s, values, Q.PERCENTILES)) <= s.error


def test_merged_parts_keep_the_bound():
    values = np.random.default_rng(2).normal(size=30_000)
    total = Q.Sketch(64)
    for part in np.array_split(values, 13):
        s = Q.Sketch(64)
        s.add(part)
        r = s.row()
        total.merge(Q.Sketch.of(r["n"], r["error"], r["levels"], r["values"], 64))
    assert total.n == len(values)
    assert max(rank_errors(total, values, (0.01, 0.1, 0.5, 0.9, 0.99))) <= total.error


def test_small_groups_are_exact(spark):
    rows = [("a", "2025-01-01", float(i)) for i in range(100)] + [("a", None, math.nan), ("a", "2025-01-01", None), ("a", "2025-01-01", -1.0), ("a", "2025-01-01", math.inf), (None, "2025-01-02", 5.0)]
    df = spark.createDataFrame(rows, "language string, d string, wer double").withColumns({"n": F.lit(1), "grp": F.lit(2), "error": F.lit(3)})
    days = Q.by_day(df, "language", "d", ["wer"])
    got = {(r["grp"], str(r["day"]), r["percentile"]): (r["value"], r["n"], r["rank_error"]) for r in Q.percentiles(days, ["metric", "grp", "day"], (0.5, 0.99)).collect()}
    assert got == {("a", "2025-01-01", 0.5): (49.0, 100, 0.0), ("a", "2025-01-01", 0.99): (98.0, 100, 0.0), (None, "2025-01-02", 0.5): (5.0, 1, 0.0), (None, "2025-01-02", 0.99): (5.0, 1, 0.0)}
    assert Q.percentiles(Q.over_days(days), ["metric", "grp"], (0.5,)).count() == 2
    assert Q.by_day(df.limit(0), "language", "d", ["wer"]).count() == 0


def test_spark_sketches_keep_the_bound(spark):
    df = spark.range(20_000).select(F.lit("a").alias("language"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("d"), (F.hash("id") % 1000).cast("double").alias("wer")).repartition(7)
    all_values = np.sort([r["wer"] for r in df.filter("wer >= 0").collect()])
    total = Q.over_days(Q.by_day(df, "language", "d", ["wer"], 32), 32)
    for r in Q.percentiles(total, ["metric", "grp"], size=32).collect():
        target = max(1, math.ceil(r["percentile"] * len(all_values)))
        low, high = np.searchsorted(all_values, r["value"], "left") + 1, np.searchsorted(all_values, r["value"], "right")
        assert r["n"] == len(all_values) and max(0, low - target, target - high) <= r["rank_error"] * r["n"]


INDEX = "audio_id string, speaker_id string, split string, n int, component string"
TARGETS = "split string, share double"


def targets(spark, a=0.8, b=0.1, c=0.1):
    return spark.createDataFrame([("train", a), ("dev", b), ("test", c)], TARGETS)


def test_speakers_stay_together(spark):
    rows = [(f"a{i}", f" Spk-{i % 40}" if i % 3 else None, ["train", "Training", "dev", "eval", "train"][i % 5], 1, "x") for i in range(2000)]
    df = spark.createDataFrame(rows, INDEX)
    got = S.resplit(df, targets(spark)).collect()
    assert len(got) == 2000
    by = {}
    for r in got:
        if r["owner"]:
            by.setdefault(r["owner"], set()).add(r["new_split"])
    assert all(len(x) == 1 for x in by.values()) and "spk_1" in by
    n = {s: sum(r["new_split"] == s for r in got) for s in S.SPLITS}
    assert abs(n["train"] - 1600) <= 1 and abs(n["dev"] - 200) <= 1 and abs(n["test"] - 200) <= 1


def test_hot_speaker_and_duplicates(spark):
    rows = [(f"a{i}", "hot" if i < 700 else f"s{i}", "train", 1, "x") for i in range(1000)] + [("dup", None, "train", 1, "x"), ("dup", None, "test", 1, "x"), (None, None, "dev", 1, "x"), ("p", "unknown", "dev", 1, "x"), ("q", "N/A ", None, 1, "x")]
    got = S.resplit(spark.createDataFrame(rows, INDEX), targets(spark)).collect()
    assert len(got) == 1005
    assert {r["new_split"] for r in got if r["owner"] == "hot"} == {"train"}
    assert len({r["new_split"] for r in got if r["audio_id"] == "dup"}) == 1


def test_spread_and_edges(spark):
    rows = [("1", "A-1", "train", 1, "x"), ("2", "a_1 ", "valid", 1, "x"), ("3", "b", "train", 1, "x"), ("4", "b", "TRAIN", 1, "x"), ("5", "-", "train", 1, "x"), ("6", "-", "test", 1, "x"), ("7", None, "test", 1, "x"), ("8", "c", "other", 1, "x"), ("9", "c", "train", 1, "x")]
    df = spark.createDataFrame(rows, INDEX)
    assert [r["owner"] for r in S.spread(S.components(df)).collect()] == ["a_1"]
    assert S.resplit(df.limit(0), targets(spark)).count() == 0
    assert S.resplit(df, targets(spark, 0.0, 0.0, 0.0)).count() == 9


def test_flow_is_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        bundles = []
        for b in range(3):
            size, count = 1, int(rng.integers(1, 5))
            labels = rng.multinomial(size * count, [1 / 3] * 3)
            bundles.append({"name": str(b), "count": count, "n": size * count} | dict(zip(S.SPLITS, map(int, labels), strict=True)))
        total = sum(b["n"] for b in bundles)
        quota = rng.multinomial(total, [0.5, 0.25, 0.25])
        got = S.allocate(bundles, {s: q / total for s, q in zip(S.SPLITS, quota, strict=True)})
        cost = lambda alloc, bundles=bundles: sum(alloc[b["name"]][s] * (1 - b[x] / b["n"]) for b in bundles for s, x in enumerate(S.SPLITS))
        assert [sum(got[b["name"]][s] for b in bundles) for s in range(3)] == list(quota)

        best = math.inf
        options = [[(i, j, b["count"] - i - j) for i in range(b["count"] + 1) for j in range(b["count"] + 1 - i)] for b in bundles]
        for a in options[0]:
            for b in options[1]:
                for c in options[2]:
                    if all(a[s] + b[s] + c[s] == quota[s] for s in range(3)):
                        best = min(best, cost({"0": a, "1": b, "2": c}))
        assert cost(got) == pytest.approx(best, abs=1e-6)


def test_report(spark, data):
    df, t = spark.read.parquet(f"{data}/asr_index_v6_16k.parquet"), spark.read.parquet(f"{data}/split_targets.parquet")
    rows = {r["new_split"]: r for r in S.report(df, t).collect()}
    assert sum(r["rows"] for r in rows.values()) == df.count()


def test_merges_have_an_order(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 3}", float(x)) for i, x in enumerate(rng.lognormal(size=6000))]
    df = spark.createDataFrame(rows, "grp string, x double").withColumn("day", F.lit("2024-01-01").cast("date")).repartition(7)
    states = Q.sketches(df, "grp", "day", ["x"], size=32).persist()
    got = []
    for seed in (1, 2):  # blocks arrive in another order
        shuffled = states.orderBy(F.rand(seed))
        got.append(sorted(map(tuple, Q.percentiles(Q.merged(shuffled, ["metric", "grp"], "part", 32), ["metric", "grp"], size=32).collect())))
    assert got[0] == got[1] and all(r[-1] > 0 for r in got[0])


def test_linked_keys(spark):
    rows = [("a", "s1", "e1"), ("b", "s1", "e2"), ("c", "s2", "e2"), ("d", "s3", None), ("e", None, "e3"), ("f", None, None), ("g", None, None), ("h", "s9", "e1")]
    rows += [(f"r{i}", f"c{i}", f"d{i}") for i in range(40)] + [(f"q{i}", f"c{i + 1}", f"d{i}") for i in range(39)]  # a chain
    df = spark.createDataFrame([(*r, "train") for r in rows], "audio_id string, s string, e string, split string")
    owners = [F.col("s"), F.col("e")]
    got = {}
    for r in S._keyed(df, "audio_id", owners, "split").collect():
        got.setdefault(r["component"], set()).add(r["key"])
    assert sorted(map(len, got.values())) == [1, 1, 1, 1, 4, 79]
    assert {"a", "b", "c", "h"} in got.values()
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, share double")
    new = {r["audio_id"]: r["new_split"] for r in S.resplit(df, targets, owner=owners).collect()}
    assert len(new) == len(rows) and all(len({new[k] for k in keys}) == 1 for keys in got.values())
    assert S._keyed(df.limit(0), "audio_id", owners, "split").count() == 0


@pytest.mark.parametrize("most", [10_000, 12, 4])
def test_bundles_are_bounded(spark, monkeypatch, most):
    monkeypatch.setattr(S, "BUNDLES", most)
    monkeypatch.setattr(S, "LARGE", 1 / 3)
    rng = np.random.default_rng(3)
    rows = [(f"a{i}-{j}", f"s{i}", str(rng.choice(["train", "dev", "test"]))) for i in range(60) for j in range(int(rng.integers(1, 70)))]
    df = spark.createDataFrame(rows, "audio_id string, speaker_id string, split string")
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, share double")
    got = S.resplit(df, targets).collect()
    assert len(got) == len(rows) and len({(r["owner"], r["new_split"]) for r in got}) == 60
    share = sum(r["new_split"] == "train" for r in got) / len(got)
    assert abs(share - 0.8) < (0.02 if most > 60 else 0.1)


def test_splits_are_the_cheapest_for_any_number_of_bundles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    labels = [rng.multinomial(int(rng.integers(2, 70)), rng.dirichlet([0.4] * 3)) for _ in range(60)] + [np.array(x) for x in ([1, 0, 0], [0, 1, 0], [0, 0, 1])] * 40
    rows = [(f"a{i}-{s}-{j}", f"s{i}", s) for i, x in enumerate(labels) for s, n in zip(S.SPLITS, x, strict=True) for j in range(n)]
    df = spark.createDataFrame(rows, "audio_id string, speaker_id string, split string")
    results = []
    for most in (100, 60, 5):  # about 60 bundles: fewer, as many, more
        monkeypatch.setattr(S, "BUNDLES", most)
        results.append({r["audio_id"]: (r["old_split"], r["new_split"]) for r in S.resplit(df, targets(spark)).collect()})
    assert results[0] == results[1] == results[2]
    got = list(results[0].values())
    assert all(abs(sum(b == s for _, b in got) - x * len(rows)) < 1 for s, x in zip(S.SPLITS, (0.8, 0.1, 0.1), strict=True))
    bundles = [{"name": str(i), "count": 1, "n": int(x.sum())} | dict(zip(S.SPLITS, map(int, x), strict=True)) for i, x in enumerate(labels)]
    whole = S.allocate(bundles, {"train": 0.8, "dev": 0.1, "test": 0.1})
    cost = sum(b["n"] - b[s] for b in bundles for s, k in zip(S.SPLITS, whole[b["name"]], strict=True) if k)
    assert sum(a != b for a, b in got) <= cost + 10  # both are rounded to whole components


def test_order_of_a_size_does_not_depend_on_how_many_tasks_sort_it(spark, monkeypatch):
    df = spark.range(3000).select(F.concat(F.lit("a"), "id").alias("audio_id"), F.lit(None).cast("string").alias("speaker_id"), F.lit("train").alias("split"))
    got = []
    for ordered in (20_000, 100):
        monkeypatch.setattr(S, "ORDERED", ordered)
        got.append({r["audio_id"]: r["new_split"] for r in S.resplit(df, targets(spark)).collect()})
    assert got[0] == got[1] and sorted(map(list(got[0].values()).count, S.SPLITS)) == [300, 300, 2400]
