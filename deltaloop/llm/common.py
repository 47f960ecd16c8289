"""Shared helpers: table access, written intermediate results, code on the executors, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloop.functions.session import drop as drop_written
from deltaloop.functions.session import stored as written

#: Bytes of rows that go to a Python worker at once, where the session leaves Spark's own setting.
BATCH = 2 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, whether or not they have it on their path, and bounds the batches they read."""
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH))
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    _SHIPPED.add(context)
    root = Path(__file__).resolve().parents[2]
    name = Path(tempfile.mkdtemp(prefix="deltaloop-")) / f"deltaloop_{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted((root / "deltaloop").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished plans only when the driver's garbage is collected: this asks for it, where it can be."""
    gc.collect()
    if jvm := getattr(spark, "_jvm", None):
        jvm.System.gc()


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes; strings in arrays are none of these tables."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = 8 * len(kind.elementType.fields) + 16 if isinstance(kind.elementType, T.StructType) else 8
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * each + 16
    return F.lit(8)


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A hint to broadcast df if its values take at most so many bytes, which is measured; else df as it is, for a join by shuffle."""
    widths = [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    size = df.agg(F.sum(reduce(lambda a, b: a + b, widths, F.lit(16)).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def utf8(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                yield function(batch.slice(k, 2000))

    return df.mapInArrow(run, schema)


def map_same(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """map_batches for a function that keeps the columns; it finds them by position, as their names may hold anything."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return map_batches(plain, function, plain.schema).toDF(*df.columns)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df lacks."""
    name, k = base, 0
    while name.lower() in {c.lower() for c in df.columns}:
        k += 1
        name = f"{base}_{k}"
    return name


def only(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])


__all__ = ["drop_written", "fresh", "map_batches", "map_same", "only", "release", "ship", "small", "table", "utf8", "written"]
