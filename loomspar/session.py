"""Session settings and the shared folder that lineage is cut into."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}  # the folder of a local session, removed at exit
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CUTS: list[tuple[SparkSession, str, DataFrame | None]] = []  # tables that cut lineage, removed by ``drop_cuts`` (at exit, if the session still lives)
atexit.register(lambda: [shutil.rmtree(d, ignore_errors=True) for d in _LOCAL.values()])


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE and UTC; extra settings as keyword arguments with ``__`` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName("loomspar")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    Read from ``spark.checkpoint.dir``. Only a local session without that setting (tests)
    gets a folder of its own; on a cluster the setting is required.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        where = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="loomspar-"))
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither repeat its plan
    nor depend on executors that may be lost. The files are parquet, so columns are still pruned.
    The shuffle files of the plan go as soon as it is written, not only when the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    _CUTS.append((spark, path, None))
    usual = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, usual)
    table = spark.read.schema(df.schema).parquet(path)
    _CUTS[-1] = (spark, path, table)
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_cut(table: DataFrame) -> None:
    """Delete one table that ``cut_lineage`` gave, when no result that is still to be read needs it."""
    for i, (spark, path, cut) in enumerate(_CUTS):
        if cut is table:
            del _CUTS[i]
            _delete(spark, path)
            return


def drop_cuts() -> None:
    """Delete the tables that cut lineage so far; results that were not read yet need them until then."""
    while _CUTS:
        spark, path, _ = _CUTS.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its folder is removed with it, or stays
            return


atexit.register(drop_cuts)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it (if the folder exists there)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    ensure_importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
