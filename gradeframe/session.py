"""Session helpers: the shared scratch folder, written tables, code for workers."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_scratch: dict[str, tempfile.TemporaryDirectory] = {}
_scratch_lock = threading.Lock()


def local_session(cores: int | str = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and single-machine benchmarks."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradeframe")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    share_code(session)
    return session


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder; on a cluster an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app_id = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/gradeframe/{app_id}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    with _scratch_lock:
        if app_id not in _local_scratch:
            _local_scratch[app_id] = tempfile.TemporaryDirectory(prefix="gradeframe-")
    return f"file://{_local_scratch[app_id].name}"


def share_code(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package where it is not installed.

    On a cluster the package is sent with ``--py-files`` or installed.
    """
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


_scopes = threading.local()


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables stored inside on leaving, also after a failure.

    Tables stored with ``keep`` go to the enclosing scope, if there is one. What is read from the
    others must have been computed before the end.
    """
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = []
    kept_before = getattr(_scopes, "kept", None)
    _scopes.kept = []
    try:
        yield
    finally:
        done, kept = _scopes.paths, _scopes.kept
        _scopes.paths, _scopes.kept = outer, kept_before
        if outer is not None:
            outer.extend(kept)
        for path in done:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(table: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    _delete(table.sparkSession, table.stored_at)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more.

    It does so once their plans are garbage, which on a large heap can be long after the job.
    """
    gc.collect()
    spark._jvm.System.gc()


def shared_subfolder(spark: SparkSession, keep: bool = False) -> str:
    """A new folder for stored tables, deleted as they are (see ``stored_tables``)."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    paths = getattr(_scopes, "kept" if keep else "paths", None)
    if paths is not None:
        paths.append(path)
    return path


def materialize(
    df: DataFrame, schema: StructType | None = None, keep: bool = False, by: Sequence[str] = (), compression: str | None = None
) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the stored table.

    This cuts lineage in a way that survives executor loss, and gives the planner
    the stored size, so that it broadcasts the table only below
    ``spark.sql.autoBroadcastJoinThreshold``. Inside ``stored_tables`` the table is
    deleted at the end, unless it is to be kept. ``by`` lays it out in folders by these columns.
    """
    spark = df.sparkSession
    path = shared_subfolder(spark, keep)
    (df.write.partitionBy(*by) if by else df.write).parquet(path, compression=compression)
    table = spark.read.schema(schema or df.schema).parquet(path)
    table.stored_at = path
    return table
