"""Session helpers."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "seriesloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; anything in ``conf`` wins.

    AQE stays on so that skewed shuffle partitions are split and small ones
    merged at run time. Shuffle partitions are left to the cluster's own setting.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.legacy.javaCharsets": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir`` where it is set,
    else one of this application's own below the warehouse folder, removed when the JVM ends.

    Raises on a cluster whose only candidate is a machine's own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    warehouse = sc._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
    fs = warehouse.getFileSystem(sc._jsc.hadoopConfiguration())
    warehouse = fs.makeQualified(warehouse)
    if warehouse.toUri().getScheme() == "file" and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = sc._jvm.org.apache.hadoop.fs.Path(warehouse, f".scratch-{sc.applicationId}")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString().rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Points ``checkpoint()`` at the shared folder, once per application."""
    folder = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared checkpoint folder, so that a
    lost executor costs a re-read and not a recomputation. Partitioning is kept."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared folder."""
    return f"{shared_folder(spark)}/seriesloom-{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a ``scratch_folder`` that is not read any more, so that stages do not add up on disk."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None when nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
