"""Writers: predictions and metrics by cell, manifests, JSON lines, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions import text as X
from earshot.operators.groups import join_groups
from earshot.runtime import materialize

CELL = ("experiment", "dataset", "model", "task", "language")


def predictions(df: DataFrame, path: str, by: tuple[str, ...] = CELL) -> None:
    """Predictions as parquet, partitioned by cell; a cell that is written again replaces the old one."""
    df.repartition(*by, F.pmod(F.xxhash64("sample_id"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def predictions_csv(df: DataFrame, path: str, by: tuple[str, ...] = CELL) -> None:
    """Recognition predictions as CSV of four columns in a folder for each cell, which replaces the old one."""
    _cells_csv(df.select(*by, "sample_id", "reference", F.coalesce("hypothesis", F.lit("")).alias("hypothesis"), "audio_path"), path, by)


def translations_csv(df: DataFrame, path: str, by: tuple[str, ...] = ("experiment", "dataset", "model", "source_lang", "target_lang")) -> None:
    """Translation predictions as CSV of four columns in a folder for each cell, which replaces the old one."""
    _cells_csv(df.select(*by, "sample_id", F.coalesce("source_transcription", F.lit("")).alias("source_transcription"), "reference", F.coalesce("hypothesis", F.lit("")).alias("hypothesis")), path, by)


def _cells_csv(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    quoted = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    quoted.partitionBy(*by).csv(path)


def strict_csv(df: DataFrame, path: str) -> None:
    """Strict predictions: failed rows are marked, their text is empty."""
    out = df.select("sample_id", "reference", F.coalesce("hypothesis", F.lit("")).alias("hypothesis"), F.col("hypothesis").isNull().cast("int").alias("failed"))
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Result records as JSON lines, appended; the newest record of a group is the one that counts."""
    df.write.mode("append").json(path)


def metrics(df: DataFrame, path: str, by: tuple[str, ...] = ("experiment", "dataset", "model", "task", "language")) -> None:
    """Metric records in a folder for each cell; those of other cells stay."""
    by = tuple(c for c in by if c in df.columns)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def update_metrics(old: DataFrame, new: DataFrame, path: str, by: tuple[str, ...] = ("experiment", "dataset", "model", "task", "language")) -> None:
    """Writes the cells of ``new`` again: its values where it has any, else those of ``old``; other columns and cells stay."""
    by = tuple(c for c in by if c in old.columns and c in new.columns)
    fresh = new.withColumnsRenamed({c: f"new_{c}" for c in new.columns if c not in by})
    both = join_groups(fresh, old, by, "left")
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    value = lambda c: F.col(c) if c in by else F.coalesce(f"new_{c}", c) if c in new.columns and c in old.columns else F.col(f"new_{c}" if c in new.columns else c)
    metrics(materialize(both.select(*(value(c).alias(c) for c in columns)), "metrics"), path, by)


def manifest(df: DataFrame, path: str) -> None:
    """A manifest in TSV with one line for each row."""
    out = df.withColumn("transcript_raw", X.one_line(F.col("transcript_raw"))) if "transcript_raw" in df.columns else df
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def groups(df: DataFrame, path: str) -> None:
    """The table of cleaned groups as one CSV file, in the order of their keys."""
    summary(df.select("group_key", "config_name", "language_code", "iso", "n_clean", "hours_clean", "audio_kind", "manifest_file").orderBy("group_key"), path)


def summary(df: DataFrame, path: str) -> None:
    """A small table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(df: DataFrame, limit: int = 10_000, average: bool = False) -> str:
    """A summary of cells as text, in their order, columns without any value left out; more than ``limit`` rows are an error.

    With ``average`` a last row has the unweighted means of the numbers.
    """
    rows = [r.asDict() for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows is no summary")
    if average and rows:
        mean = {c: [r[c] for r in rows if isinstance(r[c], float)] for c in df.columns}
        rows.append({c: sum(v) / len(v) if v else None for c, v in mean.items()} | {df.columns[0]: "Average"})
    names = [c for c in df.columns if any(r[c] is not None for r in rows)]
    show = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)
    table = [names, *([show(r[c]) for c in names] for r in rows)]
    widths = [max(len(x[i]) for x in table) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in table)
