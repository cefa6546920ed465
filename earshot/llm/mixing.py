"""Combining sources to target shares of size by Pareto order sampling.

Every record of a source gets an expected number of copies, in proportion to a power of its size and
at most the source's cap. The whole part of it is certain: that many copies are always taken. The
rest is an inclusion probability. Records are ranked by the odds of a random number over the odds of
that probability (Pareto order sampling), and taken in this order until the source's share of the
budget is reached, which gives a sample of fixed size, in tokens, with unequal probabilities.

The order is never sorted as a whole: ranks fall into buckets, sums of buckets find the one where the
budget ends, its buckets are summed in turn, and only the records of the last one are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.llm import bpe
from earshot.runtime import materialize, spread

#: Buckets of ln(rank) for each source, buckets of each of these, and steps for each doubling of the size.
RANK_BUCKETS, FINE, SIZE_STEPS = 4096, 4096, 16
#: Most sources a mix may name, or an error is raised; at most SIZE_STEPS * 63 sums a source are collected.
MAX_SOURCES = 2000


def _uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def sized(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", path: str | None = None) -> DataFrame:
    """``key``, ``source``, ``tokens`` of every record, counted once and kept in the shared folder."""
    rows = spread(df).select(F.col(key).alias("key"), F.col(source).alias("source"), bpe.token_count(F.col(text).cast("string"), path).alias("tokens"))
    return materialize(rows, "sizes")


def _rate(bins: list, need: float, cap: float, power: float) -> float:
    """The factor c for which the expected copies min(cap, c * size ** power) take ``need`` tokens."""
    low, high = 0.0, 1.0
    spent = lambda c: sum(min(cap, c * (b["total"] / b["n"]) ** power) * b["total"] for b in bins)
    while spent(high) < need * (1 - 1e-12) and high < 1e18:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if spent(mid) < need else (low, mid)
    return high


def plan(sizes: DataFrame, targets: DataFrame, total: float | None = None, power: float = 0.5) -> list[dict]:
    """One row for each target: its share, the tokens there are and are wanted, and the factor c.

    ``total`` is the size of the mix in tokens. Its default is the largest one at which every source
    that has any tokens still gets its share under its cap; shares of sources without tokens are
    spread over the others in proportion. With a larger ``total``, sources fall short and say so.
    """
    wanted = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap")).dropna().filter("share > 0 and cap > 0")
    rows = wanted.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mix of more than {MAX_SOURCES} sources is not meant for this operator")
    if len({r["source"] for r in rows}) < len(rows):
        raise ValueError("a source has more than one target")
    step = F.floor(F.log2("tokens") * SIZE_STEPS).cast("int")
    bins: dict[str, list] = {}
    names = [r["source"] for r in rows]
    for b in sizes.filter(F.col("source").isin(names) & (F.col("tokens") > 0)).groupBy("source", step.alias("step")).agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.max("tokens").cast("bigint").alias("longest")).collect() if names else []:
        bins.setdefault(b["source"], []).append(b)
    out = [{"source": r["source"], "share": r["share"], "cap": r["cap"], "have": sum(b["total"] for b in bins.get(r["source"], [])), "n": sum(b["n"] for b in bins.get(r["source"], [])), "longest": max((b["longest"] for b in bins.get(r["source"], [])), default=0)} for r in rows]
    spread = sum(r["share"] for r in out if r["have"])
    if total is None:
        total = min((r["have"] * r["cap"] * spread / r["share"] for r in out if r["have"]), default=0.0)
    for r in out:
        need = total * r["share"] / spread if r["have"] else 0.0
        r["need"] = min(need, float(r["have"] * r["cap"]))
        r["rate"] = _rate(bins[r["source"]], r["need"], r["cap"], power) if r["have"] else 0.0
    return out


_PLAN = "source string, share double, cap int, have bigint, n bigint, longest bigint, need double, rate double"


def _end(sums: DataFrame, bucket: str, budget: Column) -> DataFrame:
    """``source``, ``last`` and ``rest``: the bucket where the budget ends, and what is left of it there. One row a source."""
    return sums.filter(F.col("until") > budget).groupBy("source").agg(F.min(F.struct(F.col(bucket).alias("last"), (budget - (F.col("until") - F.col("size"))).alias("rest"))).alias("end")).select("source", "end.last", "end.rest")


def choose(sizes: DataFrame, planned: list[dict], power: float = 0.5, seed: int = 42) -> DataFrame:
    """``key``, ``source``, ``tokens``, ``copies`` (1 or more) of every record that is used."""
    spark = sizes.sparkSession
    per_source = F.broadcast(spark.createDataFrame([tuple(r.values()) for r in planned], _PLAN).select("source", "cap", "need", "rate"))
    expected = F.least(F.col("cap").cast("double"), F.col("rate") * F.pow(F.col("tokens").cast("double"), F.lit(power)))
    rows = (
        sizes.filter("tokens > 0").join(per_source, "source").withColumn("expected", expected).withColumn("whole", F.floor("expected").cast("int")).withColumn("p", F.col("expected") - F.col("whole")).withColumn("u", _uniform(F.col("key"), seed))
        .withColumn("rank", F.when(F.col("p") > 0, F.log(F.col("u") / (1 - F.col("u"))) - F.log(F.col("p") / (1 - F.col("p")))))
        .withColumn("fine", F.when(F.col("rank").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(RANK_BUCKETS * FINE - 1), F.floor((F.col("rank") + 40) * F.lit(RANK_BUCKETS * FINE / 80.0)).cast("int")))))
        .withColumn("bucket", F.floor(F.col("fine") / FINE).cast("int"))
        .drop("expected", "p", "u", "rate")
    )
    sums = rows.groupBy("source", "bucket").agg(F.sum(F.col("whole") * F.col("tokens")).alias("certain"), F.sum("tokens").alias("size"), F.first("need").alias("need"))
    by_source = W.partitionBy("source")
    sums = sums.withColumn("left", F.col("need") - F.sum("certain").over(by_source)).filter("bucket is not null").withColumn("until", F.sum("size").over(by_source.orderBy("bucket")))
    ends = _end(sums, "bucket", F.col("left"))
    edge = rows.join(F.broadcast(ends), "source").filter("bucket = last")
    within = edge.groupBy("source", "fine").agg(F.sum("tokens").alias("size"), F.first("rest").alias("rest")).withColumn("until", F.sum("size").over(by_source.orderBy("fine")))
    last = ends.select("source", F.col("last").alias("last_bucket")).join(_end(within, "fine", F.col("rest")), "source", "left")
    # The sums may end in the last of the smaller buckets; then all of the bucket is taken.
    rows = rows.join(F.broadcast(last), "source", "left")
    before = F.col("bucket").isNotNull() & (F.col("last_bucket").isNull() | (F.col("bucket") < F.col("last_bucket")) | ((F.col("bucket") == F.col("last_bucket")) & (F.col("last").isNull() | (F.col("fine") < F.col("last")))))
    clear = rows.withColumn("extra", F.when(before, 1).otherwise(0)).filter("fine is null or last is null or fine <> last")
    in_order = W.partitionBy("source").orderBy("rank", "key")
    edge = rows.filter("fine = last").withColumn("before", F.sum("tokens").over(in_order) - F.col("tokens")).withColumn("extra", F.expr("case when before + tokens / 2 <= rest then 1 else 0 end"))
    columns = ["key", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies")]
    return clear.select(*columns).unionByName(edge.select(*columns)).filter("copies > 0")


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", total: float | None = None, power: float = 0.5, seed: int = 42, path: str | None = None) -> DataFrame:
    """The records of a mix: ``key``, ``source``, ``tokens``, ``copies``.

    Records without a source, of a source without a target, or without tokens (null and empty texts)
    are never used. Rows that repeat count as records of their own. With ``power`` 0 all records of a
    source are equally likely; 0.5 prefers long ones by the root of their size. An empty table, or no
    target that can be met, gives no rows.
    """
    sizes = sized(df, key, source, text, path)
    return choose(sizes, plan(sizes, targets, total, power), power, seed).withColumnRenamed("key", key)


def shares(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", total: float | None = None, power: float = 0.5, seed: int = 42, path: str | None = None) -> DataFrame:
    """Per target: wanted and actual share, tokens there are, wanted and used, records, the longest one, records and copies used."""
    sizes = sized(df, key, source, text, path)
    planned = plan(sizes, targets, total, power)
    used = choose(sizes, planned, power, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_records"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    rows = df.sparkSession.createDataFrame([tuple(r.values()) for r in planned], _PLAN).join(used, "source", "left").na.fill(0, ["used_tokens", "used_records", "copies", "most_copies"])
    everything = W.partitionBy()  # at most MAX_SOURCES rows
    actual = F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(everything), F.lit(0))
    return rows.select("source", F.col("share").alias("target_share"), F.coalesce(actual, F.lit(0.0)).alias("actual_share"), F.col("have").alias("tokens"), F.col("need").alias("wanted_tokens"), "used_tokens", F.col("n").alias("records"), "longest", "used_records", "copies", F.col("cap").alias("max_repeats"), "most_copies")
