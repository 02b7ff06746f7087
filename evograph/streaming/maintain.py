"""Structured Streaming: each micro-batch of updates is one version of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.graph import snapshot


class StreamingMaintainer:
    """Feeds micro-batches to maintained analytics and writes each answer under its batch number.

    A batch that is delivered again is recognised by its number and not applied twice; if it is the last one, its answer is written
    again.  Order within a batch is (version, seq); no watermark is used, because arrival, not time, orders updates.

    With ``log`` each batch is logged before it is applied.  A new maintainer over the same log, with analytics
    made as the first were, takes all complete batches as one before it goes on, so a restart with the same checkpoint loses none.
    Without a log state ends with the driver, and a restart needs a new checkpoint.
    """

    def __init__(self, analytics: list, answer: Callable[[], DataFrame] | None = None, path: str | None = None, log: LogStore | None = None):
        self.analytics, self.answer, self.path, self.log, self.done = analytics, answer, path, log, -1
        if log:
            self._restore()

    def _restore(self) -> None:
        last = self.log.last()
        if last is None:
            return
        logged = self.log.log(last)
        graphs = {id(a.graph): (a.graph, a.graph.version) for a in self.analytics}
        for a in self.analytics:
            a.apply(logged)
        versions = logged.select("version").distinct().count()
        for graph, before in graphs.values():
            graph.version = before + versions
        self.done = last

    def process(self, batch: DataFrame, number: int) -> None:
        if number > self.done:
            if self.log:
                self.log.append(batch, number)
                batch = self.log.batch(number)
            batch = batch.persist()
            try:
                for a in self.analytics:
                    a.apply(batch)
            finally:
                batch.unpersist()
            self.done = number
        if number == self.done and self.answer and self.path:
            self.answer().write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, updates: DataFrame, checkpoint: str, **trigger):
        """Run over a streaming frame of updates; by default, until all that is available has been read."""
        return updates.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_updates(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema.UPDATES).option("maxFilesPerTrigger", per_batch).parquet(path)


class LogStore:
    """A log of updates as Parquet by version; a rewritten batch replaces its own folder only, so retries are safe."""

    def __init__(self, spark: SparkSession, path: str, updates: str = schema.UPDATES):
        self.spark, self.path, self.updates = spark, path, updates

    def append(self, batch: DataFrame, number: int) -> None:
        """Store a batch as version ``number``; its own (version, seq) become one sequence of the same order (64 bits, or an error)."""
        lo, hi, first, last = batch.agg(F.min("version"), F.max("version"), F.min("seq"), F.max("seq")).first()
        if lo != hi:
            batch = batch.withColumn("seq", (F.col("version") - lo) * F.lit(last - first + 1).cast("long") + (F.col("seq") - first))
        numbered = batch.withColumn("version", F.lit(number).cast("long"))
        numbered.write.mode("overwrite").parquet(f"{self.path}/v={number}")

    def last(self) -> int | None:
        """The last version that was written to its end; None without any."""
        marks = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")
        found = marks.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
        return max((int(f.getPath().getParent().getName()[2:]) for f in found or ()), default=None)

    def log(self, upto: int | None = None) -> DataFrame:
        """All updates, or those up to a version; folders of later ones are not read."""
        found = self.spark.read.schema(self.updates + ", v long").option("basePath", self.path).parquet(self.path)
        return (found if upto is None else found.where(F.col("v") <= upto)).drop("v")

    def batch(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.updates).parquet(f"{self.path}/v={number}")

    def snapshot(self, version: int, directed: bool) -> DataFrame:
        return snapshot(self.log(version), directed)
