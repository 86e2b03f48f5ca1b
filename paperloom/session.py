"""Session settings and scratch locations."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

RECOMMENDED = {
    # Shuffles are sized at run time: AQE merges small ones and splits skewed ones.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Distributions read their totals from the shuffle of their counts.
    "spark.sql.exchange.reuse": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Remote model calls are paid for: never run a second copy of a slow scoring task.
    "spark.speculation": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the recommended settings to a session builder."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared folder of the cluster.

    The shared folder is ``spark.checkpoint.dir``. Where that is unset, a session on one machine
    takes a local folder; on a cluster it is an error, as executors do not share local disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a folder named by ``scratch_dir`` once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of the session, once.

    Jobs submitted with ``--py-files`` do not need it.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='paperloom-')}/paperloom", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)
