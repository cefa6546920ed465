"""Joins on ids: parallel pairs, payload checks, merges of shards, sets of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of every key by ``order``; null keys are keys too."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_r = 1").drop("_r")


def parallel_pairs(source: DataFrame, target: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Every source row with the first target row of its key: ``key``, ``order``, source and target text."""
    chosen = target.groupBy(key).agg(F.min(F.struct(order, text)).alias("t")).select(key, F.col(f"t.{text}").alias("target_text"))
    return source.select(key, order, F.col(text).alias("source_text")).join(chosen, key)


def unmatched(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source rows whose key has no target row (null keys never have)."""
    return source.join(target.select(key).distinct(), key, "left_anti")


def id_overlap(left: DataFrame, right: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Distinct ids of both sides, shared ones, their shares, and whether a share is below ``least``."""
    ids = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer").filter(F.col(key).isNotNull())
    out = ids.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_shared"))
    out = out.withColumns({"left_share": F.try_divide("n_shared", "n_left"), "right_share": F.try_divide("n_shared", "n_right")})
    return out.withColumn("low_overlap", F.coalesce(F.least("left_share", "right_share") < least, F.lit(True)))


def payload_check(manifest: DataFrame, payload: DataFrame, key: str, text: str) -> DataFrame:
    """Manifest rows that have no payload row, or one with another text: ``key``, ``problem``."""
    first = payload.groupBy(key).agg(F.min(text).alias("found"), F.lit(True).alias("there"))  # of several the first by text
    joined = manifest.select(key, F.col(text).alias("expected")).join(first, key, "left")
    problem = F.when(F.col("there").isNull(), "missing").when(~F.col("expected").eqNullSafe(F.col("found")), "text differs")
    return joined.withColumn("problem", problem).filter("problem is not null").select(key, "problem")


def shard(df: DataFrame, i: int, n: int, ordinal: str) -> DataFrame:
    """Shard ``i`` of ``n`` by strides of the ordinal."""
    return df.filter(F.pmod(F.col(ordinal), F.lit(n)) == i)


def merge_shards(shards: DataFrame, manifest: DataFrame, key: str, shard_column: str, n_shards: int) -> DataFrame:
    """One row that tells whether shards merge: shards found, ids that repeat, are missing or are unknown."""
    found = shards.groupBy(key).agg(F.count("*").alias("n"))
    sides = found.join(manifest.select(key).distinct().withColumn("m", F.lit(1)), key, "full_outer")
    out = sides.agg(F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("m").isNull()).alias("n_unknown"), F.count("n").alias("n_ids"))
    return out.crossJoin(shards.agg(F.count_distinct(shard_column).alias("n_shards"))).withColumn("ok", (F.col("n_shards") == n_shards) & (F.col("n_repeated") + F.col("n_missing") + F.col("n_unknown") == 0))


def merged_shards(shards: DataFrame, manifest: DataFrame, key: str, order: str, shard_column: str, n_shards: int, run_info: DataFrame | None = None, same: tuple[str, ...] = ()) -> DataFrame:
    """The rows of all shards as an unsharded run would have written them, in the order of the manifest.

    It is an error if a shard, an id of the manifest or its only row is missing, if ids repeat or are
    unknown, or if the shards' ``run_info`` (one row each) differ in a column of ``same``.
    """
    if run_info is not None:
        differ = [c for c in same if run_info.select(c).distinct().limit(2).count() > 1]
        if differ:
            raise ValueError(f"shards disagree on {differ}")
    state = merge_shards(shards, manifest, key, shard_column, n_shards).first()
    if not state["ok"]:
        raise ValueError(f"shards don't merge: {state.asDict()}")
    return shards.drop(shard_column).join(manifest.select(key, order), key).orderBy(order)


def merged_times(shards: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per group of shards' records: seconds in all and of the slowest shard, seconds of audio, shards."""
    return shards.groupBy(*by).agg(F.sum("seconds").alias("seconds"), F.max("seconds").alias("wall_seconds_max_shard"), F.sum("audio_seconds").alias("audio_seconds"), F.count("*").alias("n_shards"))


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` whose keys aren't in ``done``; the way to resume."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def all_pairs(languages: DataFrame, code: str = "code", limit: int = 10_000) -> DataFrame:
    """Ordered pairs of different languages. The table is a small dimension; its size is checked."""
    few = languages.select(code).distinct()
    if few.limit(limit + 1).count() > limit:
        raise ValueError(f"pairs are meant for dimensions of up to {limit} rows")
    return F.broadcast(few.withColumnRenamed(code, "source_lang")).crossJoin(few.withColumnRenamed(code, "target_lang")).filter("source_lang <> target_lang")
