"""Session defaults and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Python stages cost far more per byte than the planner assumes: keep small inputs spread
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}

_staged: list[str] = []
_tables: list[str] = []


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (unit tests on one machine) a folder is made once
    and stored in the session; a cluster must name its own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = _made.get(spark.sparkContext.applicationId)
    if made is None:
        made = f"file://{tempfile.mkdtemp(prefix='tidemark-shared-')}"
        _made[spark.sparkContext.applicationId] = made
        _staged.append(made)
    return made


_made: dict[str, str] = {}


def _register(spark: SparkSession, path: str) -> None:
    if not _staged:
        atexit.register(release_staged, spark)
    _staged.append(path)


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with everything staged."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _register(spark, path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts the lineage with files that outlive executors; column pruning still
    applies to what is read later.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are counted before they are broadcast; more are joined by key.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``BROADCAST_ROWS`` rows, else as it is."""
    n = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def staged_buckets(df: DataFrame, label: str, key: str | list[str], buckets: int | None = None) -> DataFrame:
    """Like :func:`staged`, hash-bucketed by ``key``: joins on it read without a shuffle."""
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else key
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    _register(spark, path)
    _tables.append(name)
    (
        df.repartition(n, *keys)
        .write.format("parquet")
        .option("compression", "zstd")
        .option("path", path)
        .bucketBy(n, *keys)
        .saveAsTable(name)
    )
    return spark.table(name)


def release_staged(spark: SparkSession) -> None:
    """Drop and delete every table staged so far; called at exit as well.

    A long session calls it when the results it needs are written: data frames made before
    read files that are gone then.
    """
    try:
        for name in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _staged:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may be gone already
        pass
    _tables.clear()
    _staged.clear()
    _made.clear()
