"""Session helpers: the shared checkpoint folder, and lineage cuts by tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_STORED: dict[str, weakref.ref] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local master may do without: then it is a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="deltaloop-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a Parquet table in the shared folder: ends the lineage, and survives the loss of executors.

    The plan that reads it knows its size, so small ones are broadcast. It goes by drop(), or at the end of the process.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/deltaloop-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if not _STORED:
        atexit.register(drop_all)
    _STORED[path] = weakref.ref(out)
    return out


def is_stored(df: DataFrame) -> bool:
    return any(ref() is df for ref in _STORED.values())


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more."""
    for df in frames:
        for path in [p for p, ref in _STORED.items() if ref() is df]:
            if not _delete(path):
                df.limit(0).write.mode("overwrite").parquet(path)  # where this process can't reach the folder
            del _STORED[path]


def _delete(path: str) -> bool:
    try:
        system, place = fs.FileSystem.from_uri(path)
        system.delete_dir(place)
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


def drop_all() -> None:
    for path in _STORED:
        _delete(path)
    _STORED.clear()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
