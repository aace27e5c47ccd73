"""Session helpers: defaults for local runs, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "faultline", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    defaults.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Times without a zone are read in the session's; only UTC gives the same everywhere."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "ETC/UTC", "GMT", "Z", "+00:00"):
        raise RuntimeError(f"set spark.sql.session.timeZone to UTC, it is {zone}")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it.

    Only a local session that names none gets a temporary one: on a cluster a
    machine-local folder would lose rows together with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="faultline-")
    context.setCheckpointDir(made)
    return made


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
