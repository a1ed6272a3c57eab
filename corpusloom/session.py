"""Session defaults of this engine."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "corpusloom", **conf: str) -> SparkSession:
    """The running session or a new one; adaptive execution on, times in UTC. Master and sizes are the cluster's."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(where))
    context._corpusloom_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one run, in spark.checkpoint.dir; where that is unset, on this machine if all runs here.

    It goes when the session's driver ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    path = f"{top.rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).mkdirs(where)
    context = spark.sparkContext

    def gone() -> None:
        if context._jsc is not None and not context._jsc.sc().isStopped():
            where.getFileSystem(conf).delete(where, True)

    atexit.register(gone)
    return path
