"""Session defaults and the shared folder that iterative jobs cut their lineage through."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "tremor", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster a
    machine-local path would be lost with its executor, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-tremor-")
    return _OWN[app]


#: Bytes in memory for a byte of Parquet: tables of ids, paths and kinds repeat their texts, which the files hold once.
_IN_MEMORY = "16"


def sized(spark: SparkSession) -> SparkSession:
    """The session, which from now on takes a stored table for what it needs in memory and not for its files' size.

    Otherwise a table of a million rows whose texts repeat passes for one to broadcast, and the driver builds it. A value
    that the session was given stays. The shuffle files of an execution go when it ends: what is read again is stored, and
    otherwise they would stay until the driver happens to collect its garbage.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1:
        spark.conf.set(key, _IN_MEMORY)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark
