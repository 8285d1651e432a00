"""Session settings that the operators rely on."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "tallywheel", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic, adaptive execution and Arrow transfer."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder where ``spark.checkpoint.dir`` says; where that isn't set and all runs on one machine (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallywheel-")
    return f"{root.rstrip('/')}/tallywheel-{label}-{uuid.uuid4().hex[:12]}"
