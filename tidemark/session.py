"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}
_CLEARED_AT_EXIT: set[str] = set()


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE (with skew-join splitting) and Arrow on.

    Nothing here fixes the number of shuffle partitions for a cluster: AQE
    coalesces from ``spark.sql.shuffle.partitions``, which the deployment sets.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """This application's folder for staged tables, inside ``spark.checkpoint.dir`` of the session.

    Only a local session that has none gets a temporary folder; on a cluster a
    missing setting is an error, since executors could not share a local path.
    The folder goes when the driver ends, or with ``clear_staged``.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tidemark-stage-")
        root = _LOCAL_ROOTS[app]
    if app not in _CLEARED_AT_EXIT:
        _CLEARED_AT_EXIT.add(app)
        atexit.register(_clear_at_exit, spark, app)
    return f"{root.rstrip('/')}/tidemark-{app}"


def clear_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables. Frames that still read them are unusable afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _clear_at_exit(spark: SparkSession, app: str) -> None:
    running = spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app
    if running:
        clear_staged(spark)


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a derived table is read by more than one branch (bars feeding the
    numbering and the windows, search state between rounds), so an upstream tick
    scan happens once and a lost executor re-reads files instead of recomputing.
    """
    path = f"{staging_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
