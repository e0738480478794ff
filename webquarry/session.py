"""Sessions: settings for local work, and the package for the workers of any session."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "webquarry") -> SparkSession:
    """A session on this machine, as tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WEBQUARRY_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever they run: once for a session, as a zip archive."""
    context = spark.sparkContext
    if not getattr(context, "_webquarry_shipped", False):
        here = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="webquarry-"), "webquarry.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent).as_posix())
        context.addPyFile(archive)
        context._webquarry_shipped = True
    return spark


_tables: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where unset, a new one of our own, in local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            folder = have.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="webquarry-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: computed once, cuts the lineage, survives lost executors.

    The tables go when the driver's Python ends, as a result that is not yet read may need them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/webquarry/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_remove, spark)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession) -> None:
    try:
        jvm = spark._jvm
        for path in _tables:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before: its folder is the cluster's to clean
        pass
