"""Scoring of predictions as they arrive: every file once, sums by cell, rates from sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from earshot.operators.scoring import CELL, utterances


def stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1000) -> DataFrame:
    """A stream over the parquet files of a folder, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_arrivals(arriving: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes the sums of every micro-batch under its number; a batch that is done again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        sums = utterances(batch).groupBy(*CELL).agg(F.sum("word_errors").alias("we"), F.sum("n_ref").alias("wu"), F.sum("char_errors").alias("ce"), F.sum("n_chars").alias("cu"), F.count("*").alias("n"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rates_so_far(spark: SparkSession, out: str) -> DataFrame:
    """WER and CER of every cell over all batches so far."""
    return spark.read.parquet(out).groupBy(*CELL).agg((100 * F.sum("we") / F.sum("wu")).alias("wer"), (100 * F.sum("ce") / F.sum("cu")).alias("cer"), F.sum("n").alias("num_samples"))
