"""Intermediate tables shared by several reports of one application.

A table that many reports read is written once to the folder the cluster names
in `spark.checkpoint.dir`. Written files survive the loss of executors, cut the
lineage and let every report read just its columns.
"""

import hashlib
import tempfile
import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Reports may be started from several threads; building a table may ask for another.
build_lock = threading.RLock()

_written: dict[tuple, tuple] = {}
_local_folder: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str | None:
    """The folder for intermediate tables, None when there is no shared one.

    Only a local session without a configured folder gets a temporary one; on a
    cluster a machine-local folder would be invisible to the other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        return None
    if not _local_folder:
        _local_folder.append(
            tempfile.TemporaryDirectory(prefix="wardlight-", ignore_cleanup_errors=True)
        )
    return _local_folder[0].name


def source_state(spark: SparkSession, source: str) -> str:
    """The folder's name with size and time of its files, which change when it is rewritten.

    Tables that are folders show the time of the folder.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    parts = sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files)
    return f"{source}#{hashlib.sha256('|'.join(parts).encode()).hexdigest()[:16]}"


def release(spark: SparkSession) -> None:
    """Deletes the tables this application has stored in the shared folder."""
    application = spark.conf.get("spark.app.id", "application")
    with build_lock:
        for key in [key for key in _written if key[1] == application]:
            path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop(key)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _path(spark: SparkSession, folder: str, name: str, source: str) -> str:
    application = spark.conf.get("spark.app.id", "application")
    digest = hashlib.sha256(source.encode()).hexdigest()[:16]
    return f"{folder}/wardlight/{application}/{name}-{digest}"


def shared_files(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """The path of the files `name` derived from `source`; `write` puts them there on first use."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    source = source_state(spark, source)
    key = (folder, spark.conf.get("spark.app.id", "application"), name, source)
    with build_lock:
        if key not in _written:
            path = _path(spark, folder, name, source)
            write(path)
            _written[key] = (path, None)
        return _written[key][0]


def shared_table(
    spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The table `name` derived from `source`, written on first use.

    Without a shared folder the plan itself is returned and nothing is stored.
    """
    folder = shared_folder(spark)
    if folder is None:
        return build()
    application = spark.conf.get("spark.app.id", "application")
    source = source_state(spark, source)
    key = (folder, application, name, source)
    with build_lock:
        if key in _written:
            path, schema = _written[key]
            try:
                return spark.read.schema(schema).parquet(path)
            except AnalysisException:
                # Someone cleaned the folder up; write the table again.
                del _written[key]
        path = _path(spark, folder, name, source)
        table = build()
        table.write.mode("overwrite").parquet(path)
        _written[key] = (path, table.schema)
        return spark.read.schema(table.schema).parquet(path)
