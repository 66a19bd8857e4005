"""Folders that driver and executors share.

What an operator keeps between jobs lies under the folder that the cluster names in ``spark.checkpoint.dir``, in one folder for each
application, which is removed when the driver's interpreter ends. It may be on any file system that Spark and Arrow can open by URI.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_used: set[str] = set()
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder. Without the setting a new local one, in local mode alone: on a cluster nobody else could read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _own:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _own[app] = "file://" + tempfile.mkdtemp(prefix="remarq-")
        root = _own[app]
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder under the shared one that no other call uses."""
    home = f"{shared_root(spark)}/remarq/{spark.sparkContext.applicationId}"
    _used.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``instead_of`` is a result of this function that nothing reads any more once the new one is written; its files are removed.
    """
    spark = df.sparkSession
    uri = fresh_folder(spark, name)
    df.write.parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    _folders[out] = uri
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(df: DataFrame) -> None:
    """Remove the files of a result of :func:`stored` that nothing reads any more."""
    if df in _folders:
        drop(_folders.pop(df))


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def drop(uri: str) -> None:
    """Remove a folder; missing ones are no error."""
    files, path = open_fs(uri)
    if files.get_file_info(path).type != pafs.FileType.NotFound:
        files.delete_dir(path)


@atexit.register
def _clear() -> None:
    for uri in _used:
        try:
            drop(uri)
        except OSError:
            pass  # a file system that is gone takes its files with it


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt out to all of them; larger tables as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
