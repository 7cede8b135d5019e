"""Session set-up and shared-folder materialisation."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Locations that the jobs now running have made, innermost job last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def local_session(name: str, cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Small test data should still use every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .config("spark.sql.files.openCostInBytes", "256KB")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext.getCheckpointDir()
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="beaconlake-")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh table location below the shared folder; a job scope removes it at its end."""
    path = f"{shared_dir(spark).rstrip('/')}/beaconlake/{label}-{uuid.uuid4().hex}"
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    return path


@contextmanager
def job_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside when the block ends.

    Results must be written or collected inside: a plan that reads a removed table cannot run.
    """
    made: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in made:
            remove_folder(spark, path)


def _located(spark: SparkSession, path: str):
    """A path and its file system, whatever file system the path names."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it."""
    found, system = _located(spark, path)
    system.delete(found, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists."""
    found, system = _located(spark, path)
    return system.exists(found)


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the completely written folders ``name=<number>`` in ``path``."""
    found, system = _located(spark, path)
    if not system.exists(found):
        return []
    numbers = []
    for status in system.listStatus(found):
        label, _, number = status.getPath().getName().partition("=")
        if label == name and number.isdigit() and path_exists(spark, f"{path}/{name}={number}/_SUCCESS"):
            numbers.append(int(number))
    return sorted(numbers)


def materialise(df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later plans then start from files: lost executors re-read instead of recomputing, and
    Catalyst picks join strategies from the real table size. ``parts`` deals the rows to so many files,
    for tables whose readers do much work on few bytes.
    """
    path = new_path(df.sparkSession, label)
    (df if parts is None else df.repartition(parts)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
