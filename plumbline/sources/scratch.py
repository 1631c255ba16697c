"""Intermediate tables in the cluster's shared folder: they cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that were handed out and aren't removed yet, with the session that reads them.
_MADE: dict[str, SparkSession] = {}
#: Our own folder by application, for local sessions without a shared one.
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of ours; a cluster has none that its machines share,
    so there the setting is asked for.  The session's settings are never changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        root = _OWN[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str = "table") -> str:
    """A path in the shared folder that is removed when Python ends, if not before by :func:`remove`."""
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def remove(path: str) -> None:
    """Delete what was written at a path of :func:`new_path`."""
    spark = _MADE.pop(path, None)
    if spark is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the table of :func:`materialise` that ``df`` is and that nothing reads any more."""
    plain = lambda p: p.split(":", 1)[-1].lstrip("/")
    read = {plain(f).rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in [p for p in _MADE if plain(p) in read]:
        remove(path)


def materialise(df: DataFrame, files: int | None = None, tag: str = "table") -> DataFrame:
    """``df`` written as Parquet and read again, as at most ``files`` files where given."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_all() -> None:
    for path in list(_MADE):
        try:
            remove(path)
        except Exception:  # the session is gone: its cluster clears the folder
            return
