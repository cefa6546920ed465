"""Splits that keep related records together, by min-cost flow over bundles of components.

A component is everything one speaker said, or everything that is linked by any of several keys; a
record without any key is one of its own. Rows flow from bundles of components with the same shares
of present labels to the splits: a row that changes its split costs one, and quotas are met.

The flow is found by its dual: each split has a price, every bundle takes the split where its share
of rows that may stay, less the price, is largest, and the prices are right when demand meets the
quotas. Only what is torn between splits at these prices can go either way. It is dealt out in whole
components by size, and components of a size in the order of a hash. All this is the same for any
number of bundles, which never leave the executors: what reaches the driver are sums for the prices that
are tried, and counts by size, of which N rows have at most sqrt(14 N), as different sizes add up.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.llm.overlap import split_name
from earshot.runtime import materialize

SPLITS = ("train", "dev", "test")
#: Ids that name nobody.
NOBODY = ("", "unknown", "n/a", "-")
#: Components of at least this share of all rows (at most 1 / LARGE of them) are joined by broadcast.
LARGE = 1 / 1000
#: Shares and prices are whole multiples of 2 ** -BITS; each round of the search for prices adds STEP bits.
BITS, STEP = 32, 4
#: Bundles for which a task tries all prices of a round at once.
BUNDLES = 256
_WORTH = [f"worth_{s}" for s in SPLITS]
_SURE = (1, 2, 4)
#: Rounds, at most, in which the names of linked components settle, or an error is raised.
ROUNDS = 60
#: Components of a size that are put in order by one task.
ORDERED = 20_000


def speaker(of: Column) -> Column:
    """The speaker's id in lower case, trimmed, with '_' for '-'; null for placeholders."""
    name = F.lower(F.regexp_replace(of, r"^\s+|\s+$", ""))
    return F.when(~name.isin(*NOBODY), F.translate(name, "-", "_"))


def components(df: DataFrame, key: str = "audio_id", owner: Column | list[Column] | None = None, split: str = "split") -> DataFrame:
    """One row for each component: ``component``, ``owner`` (null: a record of its own), rows, rows by label.

    Several owners (speaker, source, entity ...) link all records that share any of them; the
    component, and its owner, are then named by the first of its entities.
    """
    return _summed(_keyed(df, key, owner, split))


def _summed(rows: DataFrame) -> DataFrame:
    labels = [F.count_if(F.col("label") == s).alias(s) for s in SPLITS]
    sums = rows.groupBy("component").agg(F.count("*").alias("n"), *labels)
    return sums.withColumn("owner", F.when(F.startswith("component", F.lit("o:")), F.substr("component", F.lit(3))))


def _keyed(df: DataFrame, key: str, owner: Column | list[Column] | None, split: str) -> DataFrame:
    """``key``, ``owner``, ``label``, ``component`` of every row."""
    owners = owner if isinstance(owner, list) else [speaker(F.col("speaker_id")) if owner is None else owner]
    label = F.regexp_replace(split_name(F.col(split)), r"\s+", "")
    alone = F.coalesce(F.col(key).cast("string"), F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t]).cast("string"))
    if len(owners) == 1:
        rows = df.select(F.col(key).alias("key"), owners[0].alias("owner"), label.alias("label"), alone.alias("alone"))
    else:
        named = F.array_compact(F.array(*(F.concat(F.lit(f"{i}:"), o.cast("string")) for i, o in enumerate(owners))))
        rows = df.select(F.col(key).alias("key"), named.alias("entities"), label.alias("label"), alone.alias("alone"))
        of = linked(rows.select("entities"))
        rows = rows.withColumn("entity", F.get("entities", F.lit(0))).join(of, "entity", "left").select("key", F.coalesce("first", "entity").alias("owner"), "label", "alone")
    return rows.withColumn("component", F.coalesce(F.concat(F.lit("o:"), "owner"), F.concat(F.lit("r:"), "alone"))).drop("alone")


def linked(rows: DataFrame) -> DataFrame:
    """``entity``, ``first``: for every entity that shares a record with another one the least entity of its component.

    ``rows`` have ``entities``, arrays of the entities of a record. Records only say which entities are
    linked, so links are brought down to different pairs before anything is shuffled by entity, and a
    hot entity has as many links as it has partners. Each round every entity takes the least name
    among its neighbours', and then the name of that name, until no name changes: the rounds grow with the
    logarithm of the longest chain. Every round is a table in the shared folder.
    """
    pairs = F.explode(F.transform(F.sequence(F.lit(1), F.size("entities") - 1), lambda i: F.struct(F.get("entities", F.lit(0)).alias("a"), F.get("entities", i).alias("b")))).alias("x")
    links = rows.filter(F.size("entities") > 1).select(pairs).select("x.*").filter("a <> b").distinct()
    links = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    names = materialize(links.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("entity"), F.least("a", "least").alias("first")), "names")
    for _ in range(ROUNDS):
        around = links.join(names.select(F.col("entity").alias("b"), "first"), "b").groupBy("a").agg(F.min("first").alias("least"))
        near = names.join(around, F.col("entity") == F.col("a")).select("entity", F.least("first", "least").alias("new"), "first")
        jumped = near.join(names.select(F.col("entity").alias("new"), F.col("first").alias("far")), "new", "left")
        new = materialize(jumped.select("entity", F.least("new", F.coalesce("far", "new")).alias("new"), F.col("first").alias("old")), "names")
        names = new.select("entity", F.col("new").alias("first"))
        if not new.filter("new <> old").limit(1).count():
            return names
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def spread(parts: DataFrame) -> DataFrame:
    """Owners with records in more than one of train, dev and test."""
    several = sum((F.col(s) > 0).cast("int") for s in SPLITS) > 1
    return parts.filter(F.col("owner").isNotNull() & several).select("owner")


def _quotas(total: int, shares: list[float]) -> list[int]:
    """Whole rows in proportion to ``shares`` that add up to ``total``; none if all shares are 0."""
    whole = sum(shares)
    if not whole:
        return [0 for _ in shares]
    exact = [total * x / whole for x in shares]
    out = [int(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: out[i] - exact[i])[: total - sum(out)]:
        out[i] += 1
    return out


def _demand(bundles: DataFrame, dev: np.ndarray, test: np.ndarray) -> list[int]:
    """For every pair of prices the sum over all rows of the largest share less the price (train costs nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = (np.zeros((len(dev), len(test)), dtype=np.int64) for _ in range(2))
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            for k in range(0, batch.num_rows, BUNDLES):
                x, y, z, n = (c[k : k + BUNDLES] for c in columns)
                best = np.maximum(np.maximum(x[:, None], y[:, None] - dev)[:, :, None], (z[:, None] - test)[:, None, :])
                # In two parts, so that sums stay whole numbers of 64 bits.
                high += np.tensordot(n, best >> 17, 1)
                low += np.tensordot(n, best & ((1 << 17) - 1), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(high.size)), pa.array(high.ravel()), pa.array(low.ravel())], ["i", "high", "low"])

    sums = bundles.select(*_WORTH, "n").mapInArrow(run, "i bigint, high bigint, low bigint").groupBy("i").agg(F.sum("high"), F.sum("low"))
    out = [0] * (len(dev) * len(test))
    for i, high, low in sums.collect():
        out[i] = (high << 17) + low
    return out


def prices(bundles: DataFrame, quota: list[int]) -> list[int]:
    """Prices of the splits at which the best splits of all bundles can meet the quotas.

    They are the least of a convex function of two whole numbers, which each round looks for on a grid 16
    times finer. As it is L-natural convex (the dual of a flow), the least of a grid is at most two steps of the
    coarser one away, so no round can miss it.
    """
    at, reach = [0, 0], 1 << STEP
    for bits in range(BITS - STEP, -1, -STEP):
        steps = np.arange(-reach, reach + 1, dtype=np.int64) << bits
        dev, test = at[0] + steps, at[1] + steps
        sums = _demand(bundles, dev, test)
        k = min(range(len(sums)), key=lambda i: sums[i] + quota[1] * int(dev[i // len(test)]) + quota[2] * int(test[i % len(test)]))
        at, reach = [int(dev[k // len(test)]), int(test[k % len(test)])], 2 << STEP
    return [0, *at]


def deal(groups: list[tuple[int, int, int]], quota: list[int]) -> dict[tuple[int, int], list[int]]:
    """(splits, size) -> components for each split. ``groups``: splits that are equally good (bits), size, count."""
    out = {(best, n): [count if best == 1 << i else 0 for i in range(3)] for best, n, count in groups if best in _SURE}
    rest = [q - sum(n * got[i] for (_, n), got in out.items()) for i, q in enumerate(quota)]
    torn = [(f"{best}/{n}", best, n, count) for best, n, count in groups if best not in _SURE]
    bundles = [{"name": name, "count": count, "n": n * count} | {s: n * count if best >> i & 1 else -math.inf for i, s in enumerate(SPLITS)} for name, best, n, count in torn]
    got = allocate(bundles, {s: float(max(0, x)) for s, x in zip(SPLITS, rest, strict=True)})
    return out | {(best, n): got[name] for name, best, n, _ in torn}


def allocate(bundles: list[dict], targets: dict[str, float]) -> dict[str, list[int]]:
    """Bundle -> components for each split. ``bundles``: name, count, n (rows), rows by label (-inf: never there).

    Each bundle starts with its cheapest split, then rows leave splits that are over their quota along
    the cheapest path, which may lead through a third split (successive shortest paths). Every step
    empties a bundle's part of a split or settles a split, so the number of steps is bounded.
    """
    total = sum(b["n"] for b in bundles)
    whole = sum(targets.get(s, 0.0) for s in SPLITS) or 1.0
    quota = [total * targets.get(s, 0.0) / whole for s in SPLITS]
    k = len(SPLITS)
    cost = [[1 - b[s] / b["n"] for s in SPLITS] for b in bundles]
    flow = [[0.0] * k for _ in bundles]
    heaps: list[list[list]] = [[[] for _ in range(k)] for _ in range(k)]

    def arrive(b: int, s: int, rows: float) -> None:
        if flow[b][s] <= 1e-9:
            for t in range(k):
                if t != s:
                    heapq.heappush(heaps[s][t], (cost[b][t] - cost[b][s], b))
        flow[b][s] += rows

    load = [0.0] * k
    for b, bundle in enumerate(bundles):
        s = min(range(k), key=lambda t: (cost[b][t], -quota[t]))
        arrive(b, s, float(bundle["n"]))
        load[s] += bundle["n"]

    def best(s: int, t: int) -> tuple[float, int] | None:
        heap = heaps[s][t]
        while heap and flow[heap[0][1]][s] <= 1e-9:
            heapq.heappop(heap)
        return heap[0] if heap else None

    for _ in range(20 * k * (len(bundles) + 10)):
        over = [s for s in range(k) if load[s] - quota[s] > 1e-6]
        under = [s for s in range(k) if quota[s] - load[s] > 1e-6]
        if not over or not under:
            break
        paths = []
        for s in over:
            for t in under:
                for route in [(s, t)] + [(s, u, t) for u in range(k) if u not in (s, t)]:
                    steps = [best(x, y) for x, y in zip(route, route[1:], strict=False)]
                    if all(steps) and sum(x[0] for x in steps) < math.inf:
                        paths.append((sum(x[0] for x in steps), len(route), route, [x[1] for x in steps]))
        if not paths:
            break
        _, _, route, who = min(paths)
        rows = min([load[route[0]] - quota[route[0]], quota[route[-1]] - load[route[-1]], *(flow[b][s] for b, s in zip(who, route, strict=False))])
        for b, s, t in zip(who, route, route[1:], strict=False):
            flow[b][s] -= rows
            arrive(b, t, rows)
        load[route[0]] -= rows
        load[route[-1]] += rows

    out: dict[str, list[int]] = {}
    off = [0.0] * k  # rows by which the rounding so far exceeds the flow
    for b in sorted(range(len(bundles)), key=lambda i: (-bundles[i]["n"] / bundles[i]["count"], bundles[i]["name"])):
        size = bundles[b]["n"] / bundles[b]["count"]
        want = [flow[b][s] / size for s in range(k)]
        got = [int(w + 1e-9) for w in want]
        while sum(got) < bundles[b]["count"]:
            s = max(range(k), key=lambda t: (want[t] - got[t] - off[t] / size if want[t] > 1e-9 else -1e18, quota[t]))
            got[s] += 1
        for s in range(k):
            off[s] += (got[s] - want[s]) * size
        out[bundles[b]["name"]] = got

    # What rounding left over is made up by the cheapest moves of small components.
    moves = sorted((cost[b][t] - cost[b][s], -bundles[b]["n"] / bundles[b]["count"], bundles[b]["name"], s, t) for b in range(len(bundles)) for s in range(k) for t in range(k) if s != t and cost[b][t] < math.inf)
    load = [sum(out[x["name"]][s] * x["n"] / x["count"] for x in bundles) for s in range(k)]
    for _, negative, name, s, t in moves:
        size = -negative
        m = min(out[name][s], int((min(load[s] - quota[s], quota[t] - load[t]) + 1e-6) / size))
        if m > 0:
            out[name][s] -= m
            out[name][t] += m
            load[s] -= m * size
            load[t] += m * size
    return out


def _keep(dealt: dict, quota: list[int], off: int, most: int) -> tuple[int, dict]:
    """What is kept where whole components miss the quotas by ``off``: a size, and those that are larger.

    The smaller ones, which can make up for it, are placed once more with what these leave of the quotas. Only
    components larger than ``off`` are kept, and only as many as fit the quotas, as long as that places any.
    """
    size, rest = off, list(quota)
    by: dict[int, list[int]] = {}
    for (_, n), got in dealt.items():
        by[n] = [a + b for a, b in zip(by.get(n, (0, 0, 0)), got, strict=True)]
    for n in sorted((n for n in by if n > off), reverse=True):
        rest = [r - n * k for r, k in zip(rest, by[n], strict=True)]
        if min(rest) < 0:
            size = n if n < most else off
            break
    return size, {k: got for k, got in dealt.items() if k[1] > size}


def assign(parts: DataFrame, targets: Iterable) -> DataFrame:
    """``component``, ``n``, ``new_split`` of every component. ``parts`` is read several times: materialize it.

    ``targets``: rows of split and share; shares of other splits than train, dev and test are ignored,
    missing ones are 0, and if all are 0 nothing meets them and every component keeps its labels' majority.
    """
    spark = parts.sparkSession
    total, most = (x or 0 for x in parts.agg(F.sum("n"), F.max("n")).first())  # most: rows of a component that is not yet placed
    share = {r["split"]: float(r["share"]) for r in targets}
    quota = _quotas(total, [share.get(s, 0.0) for s in SPLITS])
    worth = parts.select("component", "n", *(F.floor(F.col(s) / F.col("n") * (1 << BITS)).cast("bigint").alias(c) for s, c in zip(SPLITS, _WORTH, strict=True)))
    levels: list[DataFrame] = []
    rows: list[tuple] = []
    while True:
        free = worth.filter(F.col("n") <= most)
        found = prices(materialize(free.groupBy(*_WORTH).agg(F.sum("n").alias("n")), "bundles"), quota) if any(quota) else [0, 0, 0]
        left = [F.col(c) - F.lit(p) for c, p in zip(_WORTH, found, strict=True)]
        marked = free.select("component", "n", F.lit(len(levels)).alias("level"), sum(F.when(x == F.greatest(*left), 1 << i).otherwise(0) for i, x in enumerate(left)).alias("best"))
        dealt = deal([tuple(r) for r in marked.groupBy("best", "n").count().orderBy("best", "n").collect()], quota)
        off = max((abs(sum(n * got[i] for (_, n), got in dealt.items()) - q) for i, q in enumerate(quota)), default=0)
        again = any(quota) and 0 < off < most and any(n <= off for _, n in dealt)
        keep, kept = _keep(dealt, quota, off, most) if again else (0, dealt)
        levels.append(marked.filter(F.col("n") > keep))
        rows += [(len(levels) - 1, best, n, max(1, sum(got) // ORDERED), *got) for (best, n), got in kept.items()]
        if not again:
            break
        most = keep
        rest = [max(0, q - sum(n * got[i] for (_, n), got in kept.items())) for i, q in enumerate(quota)]
        quota = _quotas(sum(n * sum(got) for (_, n), got in dealt.items() if n <= keep), [float(x) for x in rest])
    marked = levels[0]
    for level in levels[1:]:
        marked = marked.unionByName(level)
    shares = F.broadcast(spark.createDataFrame(rows, "level int, best int, n bigint, buckets bigint, train bigint, dev bigint, test bigint"))
    group = ["level", "best", "n"]
    placed = marked.join(shares, group)
    only = F.when(F.col("dev") + F.col("test") == 0, "train").when(F.col("train") + F.col("test") == 0, "dev").when(F.col("train") + F.col("dev") == 0, "test")
    one = placed.withColumn("new_split", only).filter("new_split is not null").select("component", "n", "new_split")
    # Buckets are ranges of the hash, so the order is the same for any number of them.
    bucket = F.shiftright((F.shiftright("h", 32) + F.lit(1 << 31)) * F.col("buckets"), 32)
    hashed = placed.filter(only.isNull()).withColumn("h", F.xxhash64("component")).withColumn("bucket", bucket)
    before = hashed.groupBy(*group, "bucket").count().withColumn("before", F.sum("count").over(W.partitionBy(*group).orderBy("bucket")) - F.col("count")).drop("count")
    ranked = hashed.join(before, [*group, "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy(*group, "bucket").orderBy("h", "component")))
    mixed = ranked.withColumn("new_split", F.when(F.col("rank") <= F.col("train"), "train").when(F.col("rank") <= F.col("train") + F.col("dev"), "dev").otherwise("test"))
    return one.unionByName(mixed.select("component", "n", "new_split"))


def resplit(df: DataFrame, targets: DataFrame, key: str = "audio_id", owner: Column | list[Column] | None = None, split: str = "split") -> DataFrame:
    """``key``, ``owner``, ``old_split``, ``new_split`` of every row; all rows of a speaker get the same split.

    A row without a speaker (null, placeholder) is alone, but rows delivered twice under one key stay
    together. The few components that hold a large share of all rows are joined by broadcast, so no
    shuffle partition grows with a hot speaker. An empty table gives no rows.
    """
    keyed = _keyed(df, key, owner, split)
    parts = materialize(_summed(keyed), "components")
    placed = materialize(assign(parts, targets.collect()), "placed")
    total = placed.agg(F.sum("n")).first()[0] or 0
    rows = keyed.select(F.col("key").alias(key), F.col("owner"), F.col("label").alias("old_split"), "component")
    large = F.broadcast(placed.filter(F.col("n") >= max(2, total * LARGE)).select("component", F.col("new_split").alias("hot")))
    marked = rows.join(large, "component", "left")
    hot = marked.filter("hot is not null").withColumnRenamed("hot", "new_split")
    rest = marked.filter("hot is null").drop("hot").join(placed.filter(F.col("n") < max(2, total * LARGE)).select("component", "new_split"), "component")
    return hot.unionByName(rest).drop("component")


def report(df: DataFrame, targets: DataFrame, key: str = "audio_id", owner: Column | list[Column] | None = None, split: str = "split") -> DataFrame:
    """Per split: wanted share, rows, share and components before and after, rows that moved there."""
    parts = materialize(components(df, key, owner, split), "components")
    placed = assign(parts, targets.collect()).join(parts.drop("n"), "component")
    sums = placed.groupBy("new_split").agg(F.sum("n").alias("rows"), F.count("*").alias("components"), *(F.sum(s).alias(f"from_{s}") for s in SPLITS))
    everything = W.partitionBy()  # three rows
    return sums.join(F.broadcast(targets.select(F.col("split").alias("new_split"), F.col("share").alias("target_share"))), "new_split", "left").withColumn("actual_share", F.col("rows") / F.sum("rows").over(everything))
