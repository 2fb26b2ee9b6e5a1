"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, Arrow); its workers find this package."""
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(PACKAGE.parent), os.environ.get("PYTHONPATH")]))
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("RANKLOOM_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="rankloom-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared folder, so that its lineage survives the loss of executors.

    With spark.cleaner.referenceTracking.cleanCheckpoints, which local_session sets, the files go when df does.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on every executor, once per application, through a zip in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_rankloom_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    at = f"{shared_dir(spark)}/code-{uuid.uuid4().hex}/rankloom.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(buffer.getvalue()))
    finally:
        stream.close()
    sc.addPyFile(at)
    sc._rankloom_shipped = True


def stored(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Like cut, by a table written to the shared folder and read back.

    The plan starts afresh, without the constraints a checkpoint inherits; those of long loops grow with every
    round. The table of an earlier round that it replaces is deleted, so that a loop holds one or two.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.parquet(at)
    out._stored_at = at
    if replaces is not None:
        drop_stored(replaces)
    return out


def drop_stored(df: DataFrame) -> None:
    """Deletes the table behind what stored() gave; nothing that is still to be computed may depend on it."""
    at = getattr(df, "_stored_at", None)
    if at:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
