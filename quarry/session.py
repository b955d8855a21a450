"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: dict[int, str] = {}


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, so that Python workers can import it.

    The archive is made in the driver's own temporary folder and handed over by Spark's file
    server; executors never look at that folder.
    """
    sc = spark.sparkContext
    if _shipped.get(id(sc)) == sc.applicationId:
        return
    target = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    _shipped[id(sc)] = sc.applicationId


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a temporary folder; a cluster without it is
    an error, since a machine-local folder would be invisible to the other machines.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="quarry-shared-")
    sc.setCheckpointDir(folder)
    return "file://" + os.path.abspath(folder)


def stored(df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a cut lineage whose rows survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the driver's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
