"""Session construction and durable intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "loomline") -> SparkSession:
    """A session for tests and single-machine runs; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folder of each local application that names none, by application id.
_LOCAL_FOLDERS: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of a session that do not have it installed.

    Functions run in tasks are named by module, so a worker must be able to import them.
    """
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="loomline-ship-"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / root.name), "zip", root.parent, root.name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that survives executor loss, as named by ``spark.checkpoint.dir``.

    Only a local master without the setting falls back to a temporary folder;
    a cluster without it is an error, because executors share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="loomline-")
    return _LOCAL_FOLDERS[context.applicationId]


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, keeps file statistics for the planner and survives the
    loss of executors (unlike cached blocks or local checkpoints).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/loomline/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_list(df: DataFrame, column: str, limit: int = 100_000) -> list:
    """Distinct values of a dimension column on the driver, refused beyond ``limit``."""
    rows = df.select(column).where(df[column].isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values; it is not a dimension")
    return sorted(r[0] for r in rows)
