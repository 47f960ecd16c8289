"""Closure kept up to date while edges arrive.

Insertions only: a batch of new edges is the first delta, and rounds go on from there; nothing
that is known is derived again. With a directory the state is durable: edges and pairs are appended
as numbered batches, a batch counts from its line in the log on, and a new object (after a restart)
goes on from there. A batch that is given again adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from deltaloop.functions.columns import col
from deltaloop.functions.session import drop, stored
from deltaloop.operators.relational import difference, union

_SCHEMA = "s bigint, d bigint"
#: Parts of the state that are held apart before they are written together.
COMPACT_EVERY = 16


class IncrementalClosure:
    def __init__(self, spark: SparkSession, directory: str | None = None) -> None:
        self.spark, self.directory = spark, directory and directory.rstrip("/")
        self.edges: list[DataFrame] = []
        self.paths: list[DataFrame] = []
        self.batches = 0
        if self.directory:
            try:
                self.batches = spark.read.schema("batch bigint").parquet(f"{self.directory}/log").count()
            except AnalysisException:  # nothing is there yet
                return
            for k in range(self.batches):
                self.edges.append(spark.read.schema(_SCHEMA).parquet(f"{self.directory}/edge-{k}"))
                self.paths.append(spark.read.schema(_SCHEMA).parquet(f"{self.directory}/path-{k}"))

    def _all(self, parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], _SCHEMA)

    @property
    def edge(self) -> DataFrame:
        return self._all(self.edges)

    @property
    def path(self) -> DataFrame:
        return self._all(self.paths)

    def insert(self, batch: DataFrame) -> int:
        """Adds edges and returns the number of new pairs."""
        given = batch.toDF("s", "d").select(col("s").cast("bigint"), col("d").cast("bigint")).dropna(how="any").distinct()
        fresh = stored(difference(given, self.edge))
        known, found = self.path, []
        delta = stored(difference(fresh, known))
        total = 0
        while (n := delta.count()) > 0:
            total += n
            found.append(delta)
            known = known.union(delta)
            d, p = delta.toDF("a", "b"), known.toDF("a", "b")
            ahead = d.join(p.toDF("b", "c"), "b").select("a", "c")
            behind = p.join(d.toDF("b", "c"), "b").select("a", "c")
            delta = stored(difference(union(ahead, behind).toDF("s", "d"), known))
        self._keep(fresh, found)
        return total

    def _keep(self, fresh: DataFrame, found: list[DataFrame]) -> None:
        new = self._all(found)
        if not self.directory:
            self.edges.append(fresh)
            self.paths.append(stored(new))
            if len(self.paths) > COMPACT_EVERY:
                old = [*self.edges, *self.paths]
                self.edges, self.paths = [stored(self.edge)], [stored(self.path)]
                drop(*old)
        else:
            k = self.batches
            for name, df, parts in (("edge", fresh, self.edges), ("path", new, self.paths)):
                df.write.mode("overwrite").parquet(f"{self.directory}/{name}-{k}")  # what an attempt before left behind goes
                parts.append(self.spark.read.schema(_SCHEMA).parquet(f"{self.directory}/{name}-{k}"))
            self.spark.createDataFrame([(k,)], "batch bigint").write.mode("append").parquet(f"{self.directory}/log")
            self.batches += 1
        drop(*found)

    def attach(self, stream: DataFrame, checkpoint: str):  # noqa: ANN201
        """Starts a streaming query that feeds every micro-batch of (s, d) rows to insert(); give the object a directory to survive restarts."""
        return stream.writeStream.foreachBatch(lambda df, _: self.insert(df)).option("checkpointLocation", checkpoint).start()
