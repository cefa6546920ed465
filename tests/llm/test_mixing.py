import pytest
from pyspark.sql import functions as F

from earshot.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def test_shares_on_data(spark, data):
    docs, targets = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet")
    sizes = mixing.sized(docs)
    planned = mixing.plan(sizes, targets)
    picked = mixing.choose(sizes, planned).collect()
    assert len({r["key"] for r in picked}) == len(picked)
    longest = {r["source"]: r["m"] for r in sizes.groupBy("source").agg(F.max("tokens").alias("m")).collect()}
    for p in planned:
        mine = [r for r in picked if r["source"] == p["source"]]
        used = sum(r["tokens"] * r["copies"] for r in mine)
        assert all(1 <= r["copies"] <= p["cap"] for r in mine)
        assert abs(used - p["need"]) <= longest.get(p["source"], 0)


def test_ranked_sample_against_brute_force(spark):
    sizes = spark.range(400).select(F.col("id").alias("key"), F.lit("a").alias("source"), (F.col("id") % 37 + 1).cast("int").alias("tokens"))
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    planned = mixing.plan(sizes, targets, total=9000.0)
    p = planned[0]
    got = {r["key"]: r["copies"] for r in mixing.choose(sizes, planned).collect()}
    rows = sizes.withColumn("u", mixing._uniform(F.col("key"), 42)).collect()
    import math

    whole, ranked, left = {}, [], p["need"]
    for r in rows:
        expected = min(p["cap"], p["rate"] * r["tokens"] ** 0.5)
        whole[r["key"]] = int(expected)
        left -= int(expected) * r["tokens"]
        share = expected - int(expected)
        if share > 0:
            ranked.append((math.log(r["u"] / (1 - r["u"])) - math.log(share / (1 - share)), r["key"], r["tokens"]))
    before = 0
    for _, key, tokens in sorted(ranked):
        whole[key] += before + tokens / 2 <= left
        before += tokens
    assert got == {k: v for k, v in whole.items() if v}


def test_inclusion_follows_probability(spark):
    sizes = spark.range(3000).select(F.col("id").alias("key"), F.lit("a").alias("source"), F.when(F.col("id") % 2 == 0, 10).otherwise(40).alias("tokens"))
    planned = mixing.plan(sizes, spark.createDataFrame([("a", 1.0, 1)], TARGETS), total=20_000.0)
    n = {r["tokens"]: r["n"] for r in mixing.choose(sizes, planned).groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    assert n[40] / n[10] == pytest.approx(2, rel=0.15)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", 9), (2, "", "a", 9), (3, "hello there", None, 9), (4, "hello", "zz", 9)], "doc_id bigint, text string, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS)
    assert mixing.mix(docs, targets).count() == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    s = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert set(s) == {"a", "b"} and s["a"]["actual_share"] == 0
    one = docs.unionByName(spark.createDataFrame([(5, "a b c d", "a", 1)], docs.schema))
    got = mixing.mix(one, targets).collect()
    assert [(r["doc_id"], r["copies"]) for r in got] == [(5, 2)]
    with pytest.raises(ValueError):
        mixing.mix(docs, targets.unionByName(targets))


def test_short_sources_say_so(spark):
    docs = spark.createDataFrame([(i, "word " * 20, "a" if i < 3 else "b") for i in range(40)], "doc_id bigint, text string, source string")
    s = {r["source"]: r for r in mixing.shares(docs, spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS), total=1000.0).collect()}
    assert s["a"]["copies"] == 6 and s["a"]["actual_share"] < 0.25


@pytest.mark.parametrize("buckets, fine", [(1, 1), (2, 3), (4096, 1), (7, 64), (4096, 4096)])
def test_buckets_of_any_width_take_the_same(spark, monkeypatch, buckets, fine):
    sizes = spark.range(900).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 37 + 1).cast("int").alias("tokens"))
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.6, 1)], TARGETS)
    planned = mixing.plan(sizes, targets, total=5000.0)
    want = {(r["key"], r["copies"]) for r in mixing.choose(sizes, planned).collect()}
    monkeypatch.setattr(mixing, "RANK_BUCKETS", buckets)
    monkeypatch.setattr(mixing, "FINE", fine)
    assert {(r["key"], r["copies"]) for r in mixing.choose(sizes, planned).collect()} == want
