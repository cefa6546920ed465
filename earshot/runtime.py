"""Session defaults, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(app: str = "earshot", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory (a parquet file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``, and must: without it executors would write to their
    own disks, so this is an error. Only in local mode (tests, one machine) a temporary folder of this
    machine is made where it is unset, and removed when the driver ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(spark, "_earshot_scratch", None):
        spark._earshot_scratch = tempfile.mkdtemp(prefix="earshot-")
        atexit.register(shutil.rmtree, spark._earshot_scratch, True)
    return f"file://{spark._earshot_scratch}"


_written: list[str] = []


def _remove(spark: SparkSession, since: int = 0) -> None:
    """Deletes what ``materialize`` wrote, as far as the session is still there to do it."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _written[since:]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
    except Exception:  # the driver is ending; the folder's owner cleans up
        pass


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that operators wrote within; results must have been read or saved by then."""
    since = len(_written)
    try:
        yield
    finally:
        _remove(spark, since)
        del _written[since:]


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and lets several consumers share one
    evaluation. The files are removed at the end of a `scratch` block, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/earshot-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove, spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its source gives fewer partitions than there are cores.

    One small file is one partition, however much work each row is. A large input has more
    partitions than cores and stays as it is, without a shuffle. Only scans are looked at, as only
    they can be asked without running a job; what was shuffled is spread already.
    """
    if not _only_scans(df._jdf.queryExecution().optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def _only_scans(plan) -> bool:
    """Whether a plan reads tables, picks columns and rows, and does nothing else."""
    children = plan.children()
    known = plan.nodeName().split(" ")[0] in ("Project", "Filter", "Union", "LogicalRelation", "Relation", "LocalRelation", "LogicalRDD", "Range", "RelationV2", "DataSourceV2ScanRelation")
    return known and all(_only_scans(children.apply(i)) for i in range(children.size()))


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``limit`` rows, which are counted; else as it is, so joins shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
