"""Evaluation plans: from a configuration to the cells that remain to be run."""

from __future__ import annotations

import fnmatch
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from earshot.runtime import small

#: Languages, at most, whose pairs are made.
DIMENSION = 2000
_PLAN = "ordinal int, dataset string, task string, language string, source_lang string, target_lang string"


def read_config(path: str) -> dict:
    """A configuration from YAML (if a reader is installed) or JSON; it must name its datasets."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    try:
        config = json.loads(content)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is no JSON, and no YAML reader is installed") from e
        config = yaml.safe_load(content)
    if not isinstance(config, dict) or not isinstance(config.get("datasets"), dict):
        raise ValueError("a configuration needs a mapping of datasets")
    return config


def expand_pairs(sources: list[str], anchors: list[str], direction: str = "both", pairs: list | None = None) -> list[tuple[str, str]]:
    """Pairs of sources with anchors, then explicit ones; no pair with itself, each once, in the order met."""
    if direction not in ("forward", "reverse", "both"):
        raise ValueError(f"direction must be forward, reverse or both, not {direction!r}")
    met: dict[tuple[str, str], None] = {}
    for source in sources:
        for anchor in anchors:
            met |= dict.fromkeys([(source, anchor)] if direction != "reverse" else [])
            met |= dict.fromkeys([(anchor, source)] if direction != "forward" else [])
    for pair in pairs or []:
        if isinstance(pair, dict) and {"source", "target"} <= pair.keys():
            met[(pair["source"], pair["target"])] = None
        elif isinstance(pair, list | tuple) and len(pair) == 2:
            met[tuple(pair)] = None
        else:
            raise ValueError(f"a pair is [source, target] or has a source and a target, not {pair!r}")
    return [p for p in met if p[0] != p[1]]


def expand_pairs_table(sources: DataFrame, anchors: DataFrame, direction: str = "both") -> DataFrame:
    """The same over tables with ``code`` and ``ordinal``: ``source_lang``, ``target_lang``, ``ordinal``.

    Both are dimensions of languages; more than DIMENSION rows in one of them is an error.
    """
    for table in (sources, anchors):
        if table.limit(DIMENSION + 1).count() > DIMENSION:
            raise ValueError(f"pairs are meant for dimensions of up to {DIMENSION} rows")
    s = sources.select(F.col("code").alias("s"), F.col("ordinal").alias("so"))
    a = F.broadcast(anchors.select(F.col("code").alias("a"), F.col("ordinal").alias("ao")))
    both = s.crossJoin(a).filter("s <> a")
    forward = both.select(F.col("s").alias("source_lang"), F.col("a").alias("target_lang"), "so", "ao", F.lit(0).alias("way"))
    reverse = both.select(F.col("a").alias("source_lang"), F.col("s").alias("target_lang"), "so", "ao", F.lit(1).alias("way"))
    out = {"forward": forward, "reverse": reverse}.get(direction, forward.unionByName(reverse))
    first = out.groupBy("source_lang", "target_lang").agg(F.min(F.struct("so", "ao", "way")).alias("at"))
    return first.select("source_lang", "target_lang", F.row_number().over(W.orderBy("at")).alias("ordinal"))


def plan_of(spark: SparkSession, config: dict) -> DataFrame:
    """One row for each cell that a configuration asks for, in its order."""
    rows: list[tuple] = []
    for name, block in config["datasets"].items():
        block = block or {}
        languages = (block.get("asr") or {}).get("languages", [])
        ast = block.get("ast") or {}
        rows += [(len(rows), name, "asr", x, None, None) for x in languages]
        for s, t in expand_pairs(ast.get("sources", languages), ast.get("anchors", []), ast.get("direction", "both"), ast.get("pairs")):
            rows.append((len(rows), name, "ast", None, s, t))
    return spark.createDataFrame(rows, _PLAN)


def validate(plan: DataFrame, available: DataFrame, supported: DataFrame) -> DataFrame:
    """The plan's recognition cells with the reason why one can't run; null where it can.

    ``available``: dataset, language; ``supported``: language.
    """
    there = small(available.select("dataset", "language").distinct().withColumn("in_dataset", F.lit(True)))
    able = small(supported.select("language").distinct().withColumn("in_model", F.lit(True)))
    out = plan.filter("task = 'asr'").join(there, ["dataset", "language"], "left").join(able, "language", "left")
    reason = F.when(F.col("in_dataset").isNull(), "not in dataset").when(F.col("in_model").isNull(), "not supported by model")
    return out.select("ordinal", "dataset", "language", reason.alias("reason"))


def validate_pairs(plan: DataFrame, available: DataFrame, supported: DataFrame) -> DataFrame:
    """The plan's translation cells with the reason why one can't run; null where it can.

    ``available``: dataset, language; ``supported``: source_lang, target_lang. Both languages must be in the dataset.
    """
    there = available.select("dataset", "language").distinct()
    side = lambda name: small(there.select("dataset", F.col("language").alias(f"{name}_lang"), F.lit(True).alias(f"has_{name}")))
    able = small(supported.select("source_lang", "target_lang").distinct().withColumn("in_model", F.lit(True)))
    out = plan.filter("task = 'ast'").join(side("source"), ["dataset", "source_lang"], "left").join(side("target"), ["dataset", "target_lang"], "left").join(able, ["source_lang", "target_lang"], "left")
    reason = F.when(F.col("has_source").isNull(), "source not in dataset").when(F.col("has_target").isNull(), "target not in dataset").when(F.col("in_model").isNull(), "pair not supported by model")
    return out.select("ordinal", "dataset", "source_lang", "target_lang", reason.alias("reason"))


def todo(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that have no result yet; the scan of finished ones is never built."""
    return plan.join(small(done.select(*keys).distinct()), keys, "left_anti")


def matching(groups: DataFrame, pattern: str, column: str = "group_key") -> DataFrame:
    """Groups whose key fits a shell pattern."""
    return groups.filter(F.col(column).rlike("^" + fnmatch.translate(pattern).replace("(?s:", "(?s:").replace(r"\Z", "$").replace(r"\z", "$")))


def totals(groups: DataFrame) -> DataFrame:
    """Groups, utterances and hours of a plan."""
    return groups.agg(F.count("*").alias("groups"), F.sum("n").alias("utterances"), F.sum("hours").alias("hours"))


def output_path(root: str, experiment: str, dataset: str, model: str, task: str, language: str) -> str:
    """The fixed place of a cell's metrics."""
    return f"{root}/{experiment}/{dataset}/metrics/{model.replace('/', '_')}_{task}_{language}_metrics.json"
