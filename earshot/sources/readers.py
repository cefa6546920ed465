"""Readers of corpora, manifests, predictions, metrics and judgments. Schemas are explicit throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.functions import text as X
from earshot.runtime import small

AUDIO = "audio struct<bytes: binary, path: string>"
FLEURS_TSV = "id int, file_name string, raw_transcription string, transcription string, phonemes string, num_samples bigint, gender string"
BIGC = "pair_id string, image string, sentence_id string, image_id string, audio_id string, sentence string, translation string, speaker_id string, gender string, duration string, sample_rate string, audio_format string, recording_lang string, native_lang string"
MBAZA = ("id", "audio_filename", "raw", "normalised", "char_tokens", "speaker", "gender")
INDEX = "audio_id string, path string, transcript string, language string, split string, source string, speaker_id string, sample_rate int, duration double"
MANIFEST = "sample_id string, audio_kind string, audio_path string, parquet_id string, transcript string, transcript_raw string, duration double"
GROUPS = "group_key string, config_name string, language_code string, iso string, n_clean int, hours_clean double, audio_kind string, manifest_file string"
METRICS = "task string, model_name string, dataset string, language string, source_lang string, target_lang string, wer double, cer double, bleu double, chrf double, spbleu double, ssa_comet double, num_samples int, total_time double, avg_time_per_sample double, model_type string, metric_config struct<lowercase: boolean, remove_punctuation: boolean, unicode_form: string, collapse_whitespace: boolean>"
JUDGMENTS = "benchmark string, model string, lang string, sample_id string, provenance string, errors array<struct<ref_span: string, hyp_span: string, category: string, confidence: double>>, notes string"
#: Largest share of unusable rows of a corpus, and rows under which it is flagged as small.
MAX_BAD, SMALL = 0.002, 300
#: Other names of splits in the corpora's file names.
SPLIT_FILES = {"validation": "valid", "dev": "valid", "valid": "valid", "train": "train", "test": "test"}


def _plain(spark: SparkSession, path: str | list[str], schema: str | None, sep: str = "\t", header: bool = True, quote: str = "") -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header).option("encoding", "UTF-8")
    reader = reader.option("quote", quote) if quote else reader.option("quote", "").option("escape", "\u0000")
    return (reader.schema(schema) if schema else reader).csv(path)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``ordinal``, the row's number from 0 in the order given; where readers gave no line numbers."""
    return df.withColumn("ordinal", F.row_number().over(W.orderBy(*order)) - 1)


def index_csv(spark: SparkSession, path: str) -> DataFrame:
    """The corpus index from CSV."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(INDEX).csv(path)


def manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _plain(spark, path, MANIFEST).withColumn("group_key", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.tsv$", 1))


def groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(GROUPS).csv(path)


def fleurs(spark: SparkSession, root: str, language: str, split: str) -> DataFrame:
    """One language and split of the parquet corpus: only its folder is listed and read."""
    return spark.read.parquet(f"{root}/{language}/{split}").withColumns({"language": F.lit(language), "split": F.lit(split)}).withColumn("sample_id", F.concat_ws("_", "id", "num_samples"))


def fleurs_index(spark: SparkSession, path: str, language: str, split: str) -> DataFrame:
    """Index rows of a raw TSV without a header: durations from samples at 16 kHz."""
    rows = _plain(spark, path, FLEURS_TSV, header=False)
    return rows.select(F.concat_ws("_", "id", "num_samples").alias("audio_id"), F.col("file_name").alias("path"), F.col("transcription").alias("transcript"), F.lit(language).alias("language"), F.lit(split).alias("split"), F.lit("fleurs").alias("source"), F.lit(None).cast("string").alias("speaker_id"), F.lit(16000).alias("sample_rate"), F.round(F.col("num_samples") / 16000, 3).alias("duration"))


def waxal(spark: SparkSession, root: str, iso3: str, split: str, code: str) -> DataFrame:
    """Only the files of one language and split; rows without a transcription are left out.

    A row without an id is named by its number among all rows of the split, from 0, in the order of
    the files: the rows of the files before are counted, and each file numbers its own.
    """
    rows = spark.read.option("pathGlobFilter", f"{iso3}-{split}-*.parquet").parquet(f"{root}/data/ASR/{iso3}")
    rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    files = rows.groupBy("_file").agg(F.count("*").alias("n"))
    before = small(files.select("_file", (F.sum("n").over(W.orderBy("_file")) - F.col("n")).alias("_before")))
    name = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit(f"{code}_"), (F.col("_before") + F.col("_row")).cast("string")))
    kept = rows.filter(F.trim(F.coalesce("transcription", F.lit(""))) != "").join(before, "_file")
    return kept.withColumns({"sample_id": name, "language": F.lit(code)}).drop("_file", "_row", "_before")


def simba(spark: SparkSession, root: str, iso3: list[str], code: str) -> DataFrame:
    """All test files of one or several ISO prefixes as one language; `usable` says whether they may be scored."""
    return spark.read.parquet(*(f"{root}/HF_test-{i}*.parquet" for i in iso3)).withColumn("language", F.lit(code)).withColumnRenamed("benchmark_id", "sample_id")


def usable(rows: DataFrame, text: str = "text", key: str = "sample_id", readable: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with a text (and readable audio), trimmed, and a report of one row.

    The report has rows in all, used, empty and unreadable ones, ids that repeat among those used,
    whether the corpus is small, and ``problem``: why it must not be scored (no rows, more than MAX_BAD
    of them unusable, an id twice), null if nothing is wrong.
    """
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    broken = ~empty & ~(F.lit(True) if readable is None else F.coalesce(readable, F.lit(False)))
    marked = rows.withColumns({"_empty": empty, "_broken": broken})
    good = marked.filter("not _empty and not _broken").drop("_empty", "_broken").withColumn(text, F.trim(text))
    repeated = good.groupBy(key).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n_repeated"))
    report = marked.agg(F.count("*").alias("n_rows"), F.count_if("_empty").alias("n_empty"), F.count_if("_broken").alias("n_unreadable")).crossJoin(repeated)
    report = report.withColumn("n_used", F.col("n_rows") - F.col("n_empty") - F.col("n_unreadable")).withColumn("small", F.col("n_used") < SMALL)
    bad = F.col("n_empty") + F.col("n_unreadable")
    problem = F.when(F.col("n_rows") == 0, "no rows").when(bad > MAX_BAD * F.col("n_rows"), "unusable rows").when(F.col("n_repeated") > 0, "repeated ids")
    return good, report.withColumn("problem", problem)


def checked(rows: DataFrame, **kw) -> DataFrame:
    """The usable rows of a corpus; a problem is an error."""
    good, report = usable(rows, **kw)
    found = report.first()
    if found["problem"]:
        raise ValueError(f"corpus can't be scored: {found.asDict()}")
    return good


def bigc(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an audio and a sentence, trimmed."""
    rows = _plain(spark, path, BIGC)
    rows = rows.withColumns({c: F.trim(c) for c in ("audio_id", "sentence", "translation")})
    return rows.filter((F.coalesce("audio_id", F.lit("")) != "") & (F.coalesce("sentence", F.lit("")) != ""))


def bigc_pairs(rows: DataFrame) -> DataFrame:
    """Rows that hold a translation, as pairs."""
    return rows.filter(F.coalesce("translation", F.lit("")) != "").select("audio_id", F.col("sentence").alias("source_text"), F.col("translation").alias("target_text"))


def bembaspeech(spark: SparkSession, path: str) -> DataFrame:
    rows = _plain(spark, path, "audio string, sentence string")
    return rows.filter((F.trim(F.coalesce("audio", F.lit(""))) != "") & (F.trim(F.coalesce("sentence", F.lit(""))) != ""))


def mbaza(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows, and the lines that have fewer than four fields or no number as id."""
    parts = spark.read.text(path).select("value", F.split("value", "\t").alias("p"))
    good = (F.size("p") >= 4) & F.col("p")[0].try_cast("int").isNotNull()
    rows = parts.filter(good).select(F.col("p")[0].cast("int").alias("id"), *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(MBAZA) if i))
    return rows.withColumn("transcript", F.col("normalised")), parts.filter(~good).select("value")


def nchlt(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of an XML corpus, silence markers out, empty ones left out."""
    rows = spark.read.format("xml").option("rowTag", "recording").option("attributePrefix", "_").schema("_audio string, _duration double, orth string").load(path)
    rows = rows.select(F.col("_audio").alias("audio"), F.col("_duration").alias("duration"), X.drop_silence(F.col("orth")).alias("transcript"))
    return rows.filter("transcript <> ''")


def predictions(spark: SparkSession, root: str) -> DataFrame:
    """All ``predictions/*.csv`` under a folder, all columns as text; missing texts are empty; cell from the path."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_asr_*.csv").schema("sample_id string, reference string, hypothesis string, audio_path string").csv(root)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).filter(F.contains("file", F.lit("/predictions/")) & X.is_recognition_file(F.col("file")))
    cell = X.cell_of_path(F.col("file"))
    return rows.select("sample_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("reference", "hypothesis")), "audio_path", cell["dataset"].alias("dataset"), cell["model"].alias("model"), cell["language"].alias("language"))


def translations(spark: SparkSession, root: str, languages: list[str]) -> DataFrame:
    """All translation predictions under a folder: source, reference and hypothesis texts, cell from the path."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_ast_*.csv").option("enforceSchema", False).schema("sample_id string, source_transcription string, reference string, hypothesis string").csv(root)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).filter(F.contains("file", F.lit("/predictions/")))
    cell = X.translation_cell_of_path(F.col("file"), languages)
    return rows.select("sample_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source_transcription", "reference", "hypothesis")), cell["dataset"].alias("dataset"), cell["model"].alias("model"), cell["source_lang"].alias("source_lang"), cell["target_lang"].alias("target_lang"), F.regexp_replace("file", r"/predictions/([^/]+)\.csv$", "/metrics/$1_metrics.json").alias("metrics_file"))


def cells_like(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns have the wanted values; None wants nothing. A column that is not there is an error."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def with_metrics(predictions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Cells of predictions with the metric record of their stem; ``metrics_file`` joins both, metrics' names prevail."""
    found = metrics.withColumnRenamed("file", "metrics_file").withColumnsRenamed({c: f"known_{c}" for c in metrics.columns if c in predictions.columns})
    out = predictions.join(found, "metrics_file", "left")
    return out.withColumns({c: F.coalesce(f"known_{c}", c) for c in predictions.columns if f"known_{c}" in out.columns}).drop(*(c for c in out.columns if c.startswith("known_")))


def strict_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions in which ``failed`` tells a failed row from an empty one; a failed hypothesis is null."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema("sample_id string, reference string, hypothesis string, failed int").csv(path)
    return rows.withColumn("hypothesis", F.when(F.col("failed") == 1, None).otherwise(F.coalesce("hypothesis", F.lit(""))))


def metrics(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Metric records of all ``*_metrics.json`` under a folder, and the files that can't be read."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_metrics.json").option("wholetext", True).text(root).withColumn("file", F.col("_metadata.file_path"))
    broken = F.get_json_object("value", "$").isNull()
    return files.filter(~broken).select(F.from_json("value", METRICS).alias("m"), "file").select("m.*", "file"), files.filter(broken).select("file")


def judgments(spark: SparkSession, path: str, done_only: bool = False) -> DataFrame:
    """Judgments from JSON lines, bad lines left out; with ``done_only`` failed calls too."""
    rows = spark.read.option("mode", "DROPMALFORMED").schema(JUDGMENTS).json(path).filter("sample_id is not null")
    return rows.filter("provenance is not null") if done_only else rows


def local_samples(rows: DataFrame, audio: DataFrame, prefix: str, path: str = "audio", ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """Rows whose audio file is there, with ids of prefix, row number and file stem, and the rows whose file is missing.

    ``audio``: a listing with ``path``; files are matched by name.
    """
    name = F.regexp_extract(F.col(path), r"([^/]+)$", 1)
    named = rows.withColumns({"file_name": name, "sample_id": F.concat_ws("_", F.lit(prefix), F.col(ordinal), F.regexp_replace(name, r"\.[^.]*$", ""))})
    there = audio.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")).distinct()
    return named.join(there, "file_name", "left_semi"), named.join(there, "file_name", "left_anti")


def languages(df: DataFrame, column: str = "language") -> DataFrame:
    """The languages of a source and their numbers of rows."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def language_pairs(df: DataFrame, key: str, column: str = "language") -> DataFrame:
    """Ordered pairs of languages that share a key, and how many; a key may have each language once."""
    sides = df.select(key, column).dropDuplicates()
    found = sides.groupBy(key).agg(F.array_sort(F.collect_set(column)).alias("all"))
    pairs = found.select(F.explode("all").alias("source_lang"), "all").select("source_lang", F.explode("all").alias("target_lang"))
    return pairs.filter("source_lang <> target_lang").groupBy("source_lang", "target_lang").agg(F.count("*").alias("n"))


_SOURCES: dict[str, Callable[..., DataFrame]] = {"fleurs": fleurs, "waxal": waxal, "simba": simba, "bigc": bigc, "bembaspeech": bembaspeech, "mbaza": lambda *a, **k: mbaza(*a, **k)[0], "nchlt": nchlt}


def source(name: str) -> Callable[..., DataFrame]:
    """The reader of a corpus by name; names of cleaned groups give the manifest reader."""
    if name.startswith("cleaned__"):
        return manifest
    if name not in _SOURCES:
        raise KeyError(f"no source {name!r}; there are {sorted(_SOURCES)}")
    return _SOURCES[name]


def samples(df: DataFrame, language: str, column: str = "language") -> DataFrame:
    """Rows of one language; a language that the source doesn't have is an error."""
    part = df.filter(F.col(column) == language)
    if part.isEmpty():
        raise ValueError(f"the source has no language {language!r}")
    return part
