"""Percentiles with a bounded rank error by deterministic buffer collapsing.

A sketch holds sorted buffers of SIZE values. A buffer of level l stands for SIZE * 2**l values. Two
buffers of one level are merged, and every second value, starting at the first and the second place
in turn, makes a buffer of the next level: a binary tree of collapses. Each collapse of two buffers
of weight w moves no rank by more than w; the sketch adds these up, so its error bound is a fact about
its own history. Nothing is random. Sketches of partitions or days merge in the same way, and in a fixed
order, so that the same partitions of a table give the same percentiles whichever task ends first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values in a buffer. With N values the rank error is at most N * log2(N / SIZE) / (2 * SIZE).
SIZE = 4096
#: Values that a task holds before it hands on its sketches; partitions of the first merge for each group.
HELD, SALTS = 2_000_000, 32
#: Percentiles, at most, that are broadcast; their number is counted first.
FEW = 100_000
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


class Sketch:
    """Quantile sketch; ``add`` and ``merge`` change it in place."""

    __slots__ = ("size", "n", "error", "loose", "held", "full", "turn")

    def __init__(self, size: int = SIZE):
        self.size, self.n, self.error = size, 0, 0
        self.loose: list[np.ndarray] = []
        self.held = 0
        self.full: dict[int, np.ndarray] = {}
        self.turn = 0

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._loose(values)

    def _loose(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.held += len(values)
        if self.held >= self.size:
            values = np.concatenate(self.loose)
            whole = len(values) // self.size * self.size
            self.loose, self.held = [values[whole:]], len(values) - whole
            for at in range(0, whole, self.size):
                self._place(0, np.sort(values[at : at + self.size]))

    def _place(self, level: int, buffer: np.ndarray) -> None:
        while level in self.full:
            both = np.sort(np.concatenate([self.full.pop(level), buffer]), kind="stable")
            buffer = both[self.turn :: 2]
            self.turn = 1 - self.turn
            self.error += 1 << level
            level += 1
        self.full[level] = buffer

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.error += other.error
        for level in sorted(other.full):
            self._place(level, other.full[level])
        for values in other.loose:
            self._loose(values)

    def stored(self) -> int:
        return self.held + self.size * len(self.full)

    def quantiles(self, shares: tuple[float, ...]) -> list[float]:
        """For each share q the value of rank ceil(q * n), at least 1, up to ``error`` ranks off."""
        values = np.concatenate([*self.loose, *(self.full[i] for i in sorted(self.full))])
        weights = np.concatenate([np.ones(self.held, dtype=np.int64), *(np.full(self.size, 1 << i, dtype=np.int64) for i in sorted(self.full))])
        order = np.argsort(values, kind="stable")
        until = np.cumsum(weights[order])
        ranks = [max(1, math.ceil(q * self.n)) for q in shares]
        return [float(values[order[min(int(np.searchsorted(until, r)), len(order) - 1)]]) for r in ranks]

    def row(self) -> dict:
        levels = sorted(self.full)
        return {"n": self.n, "error": self.error, "levels": levels, "values": np.concatenate([*self.loose, *(self.full[i] for i in levels)])}

    @classmethod
    def of(cls, n: int, error: int, levels: list[int], values: np.ndarray, size: int) -> Sketch:
        new = cls(size)
        new.n, new.error = n, error
        loose = len(values) - size * len(levels)
        new.loose, new.held = [values[:loose]], loose
        for i, level in enumerate(levels):
            new.full[level] = values[loose + i * size : loose + (i + 1) * size]
        return new


_STATE = "n bigint, error bigint, levels array<int>, values array<double>"


def _out(items: list[tuple], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(items), 500):
        rows = [dict(zip(keys, key, strict=True)) | sketch.row() for key, sketch in items[at : at + 500]]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def sketches(df: DataFrame, group: str, day: str, metrics: list[str], size: int = SIZE) -> DataFrame:
    """Partial sketches: ``metric``, ``grp``, ``day``, ``salt``, ``part`` and the state, several for each key.

    ``part`` numbers what one partition hands on, and gives merges their order.

    Values that are null, NaN, infinite or negative (sentinels) are no scores and are left out. A
    null group and a null day are groups of their own.
    """
    schema = f"metric string, grp string, day date, salt int, part bigint, {_STATE}"
    keys = ["metric", "grp", "day", "salt", "part"]
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        salt, part_no = number % SALTS, number << 32
        held: dict = {}
        stored = 0
        for batch in batches:
            groups, days = (batch.column(i).dictionary_encode() for i in (0, 1))
            names, dates = groups.dictionary.to_pylist(), days.dictionary.to_pylist()
            code = groups.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64) * (len(dates) + 1) + days.indices.fill_null(len(dates)).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.diff(code[order])) + 1
            for part in np.split(order, edges) if len(order) else ():
                g, d = divmod(int(code[part[0]]), len(dates) + 1)
                key = (names[g] if g < len(names) else None, dates[d] if d < len(dates) else None)
                for i, metric in enumerate(metrics):
                    values = batch.column(2 + i).to_numpy(zero_copy_only=False)[part]
                    values = values[np.isfinite(values) & (values >= 0)]
                    if len(values):
                        sketch = held.setdefault((metric, *key, salt, part_no), Sketch(size))
                        stored -= sketch.stored()
                        sketch.add(values)
                        stored += sketch.stored()
            if stored > HELD:
                yield from _out(list(held.items()), keys, out)
                held, stored, part_no = {}, 0, part_no + 1
        yield from _out(list(held.items()), keys, out)

    values = df.select(F.col(group).cast("string"), F.col(day).cast("date"), *(F.col(m).cast("double") for m in metrics))
    return values.mapInArrow(run, schema)


def merged(states: DataFrame, keys: list[str], order: str, size: int = SIZE) -> DataFrame:
    """One sketch for each combination of ``keys``, merged in the order of ``order``.

    Rows come sorted, so a task holds the sketch of one combination, and what it has not yet handed on.
    """
    kinds = {f.name: f.dataType.simpleString() for f in states.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {_STATE}"
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        last, sketch = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            n, error, levels, values = (batch.column(len(keys) + i) for i in range(4))
            for i, key in enumerate(zip(*columns, strict=True)):
                other = Sketch.of(n[i].as_py(), error[i].as_py(), levels[i].as_py(), values[i].values.to_numpy(zero_copy_only=False).copy(), size)
                if sketch is not None and key == last:
                    sketch.merge(other)
                    continue
                if sketch is not None:
                    done.append((last, sketch))
                    if len(done) >= 200:
                        yield from _out(done, keys, out)
                        done = []
                last, sketch = key, other
        if sketch is not None:
            done.append((last, sketch))
        yield from _out(done, keys, out)

    rows = states.repartition(*keys).sortWithinPartitions(*keys, order)
    return rows.select(*keys, "n", "error", "levels", "values").mapInArrow(run, schema)


def percentiles(states: DataFrame, keys: list[str], shares: tuple[float, ...] = PERCENTILES, size: int = SIZE) -> DataFrame:
    """``keys``, ``percentile``, ``value``, ``n``, ``rank_error`` (bound, as a share of n) of each sketch."""
    kinds = {f.name: f.dataType.simpleString() for f in states.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", percentile double, value double, n bigint, rank_error double"
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                sketch = Sketch.of(row["n"], row["error"], row["levels"], np.array(row["values"], dtype=float), size)
                key = {k: row[k] for k in keys}
                rows += [key | {"percentile": q, "value": v, "n": row["n"], "rank_error": row["error"] / row["n"]} for q, v in zip(shares, sketch.quantiles(shares), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return states.select(*keys, "n", "error", "levels", "values").mapInArrow(run, schema)


def by_day(df: DataFrame, group: str, day: str, metrics: list[str], size: int = SIZE) -> DataFrame:
    """One sketch for each metric, group and day: the partial results that later days are combined with."""
    salted = merged(sketches(df, group, day, metrics, size), ["metric", "grp", "day", "salt"], "part", size)
    return merged(salted, ["metric", "grp", "day"], "salt", size)


def over_days(states: DataFrame, size: int = SIZE) -> DataFrame:
    """The sketches of all days of a metric and group as one."""
    salted = states.withColumn("salt", F.pmod(F.xxhash64("day"), F.lit(SALTS)).cast("int"))
    return merged(merged(salted, ["metric", "grp", "salt"], "day", size), ["metric", "grp"], "salt", size)


def ranks(df: DataFrame, found: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """The percentiles ``found`` for metric and group with their place among all values: how many are smaller, and not larger.

    A value of rank r with bound e must have ``smaller`` < r + e n and ``not_larger`` >= r - e n. The
    percentiles are few and are broadcast if they are; every value is compared with those of its group.
    """
    values = df.select(F.col(group).cast("string").alias("of_grp"), F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("v")).select("of_grp", "v.*")
    values = values.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")) & (F.col("x") >= 0)).groupBy("of_grp", "m", "x").count()
    hint = F.broadcast if found.count() <= FEW else lambda x: x
    met = values.join(hint(found), (F.col("m") == F.col("metric")) & F.col("of_grp").eqNullSafe(F.col("grp")))
    return met.groupBy("metric", "grp", "percentile", "value", "n", "rank_error").agg(F.sum(F.when(F.col("x") < F.col("value"), F.col("count")).otherwise(0)).alias("smaller"), F.sum(F.when(F.col("x") <= F.col("value"), F.col("count")).otherwise(0)).alias("not_larger"))
