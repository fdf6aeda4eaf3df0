"""Stream sinks: append tables, and update-mode tables kept as one folder per micro-batch."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tallyframe.operators.state import upsert_latest
from tallyframe.sources import versions

BATCH = "batch_id"


def as_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a zoned timestamp; files often hold zone-free ones."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_sink(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, rocks: bool = False) -> StreamingQuery:
    """Exactly-once append; without ``every`` all available input is processed and the query ends.

    ``rocks`` starts the query on the state store that operators with timers, lists or time to live need; the session's own
    setting is put back, since a query keeps what it was started with.
    """
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    try:
        if rocks:
            spark.conf.set(_PROVIDER, _ROCKS)
        writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
        return _trigger(writer, every).start(path)
    finally:
        if rocks:
            spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Update-mode results, one folder per micro-batch; a replayed batch overwrites its own folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Current rows of an ``upsert_sink`` table: the newest batch per key wins."""
    return upsert_latest(None, spark.read.parquet(path), keys, [BATCH]).drop(BATCH)


def fold_sink(
    stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]],
    every: str | None = None,
) -> StreamingQuery:
    """Per micro-batch ``(output, new_state) = step(batch, state)``, both kept as tables.

    State is written under the batch's own number and read from the previous one, so a batch that
    is replayed after a failure starts from the same state and overwrites its own output.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{path}/state/{BATCH}={batch_id - 1}") if batch_id else None
        out, state = step(batch, before)
        out.write.mode("overwrite").parquet(f"{path}/out/{BATCH}={batch_id}")
        state.write.mode("overwrite").parquet(f"{path}/state/{BATCH}={batch_id}")

    writer = stream.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def lookup_sink(
    stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], every: str | None = None
) -> StreamingQuery:
    """``step(batch)`` per micro-batch, one folder each; tables that ``step`` reads are read anew every time.

    A table joined to a stream directly is listed once, when the frame is made, so what is written later
    is never seen. Read it inside ``step``: ``lambda b: live.fenced_writes(b, spark.read.parquet(jobs))``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = stream.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


class DropCounts(StreamingQueryListener):
    """Writes what a query's state operators dropped, one row per micro-batch; ``wait`` until the query's last row is written."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path, self._run, self._done = spark, name, path, None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._run = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        again = sum(o.customMetrics.get("numDroppedDuplicateRows", 0) for o in p.stateOperators)
        row = self.spark.createDataFrame([(late, again)], "too_late bigint, repeated bigint").coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self._run:
            self._done.set()

    def wait(self, seconds: float = 60.0) -> None:
        """Progress reaches listeners after the query has gone on, so the last row may come after its end."""
        if not self._done.wait(seconds):
            raise TimeoutError(f"no end of query {self.name} within {seconds} s")
        self.spark.streams.removeListener(self)


def counted_sink(
    stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], marks: dict[str, Column],
    ts: str, delay: str, keys: Sequence[str], every: str | None = None,
) -> tuple[StreamingQuery, DropCounts]:
    """``lookup_sink`` that takes each key once within ``delay`` and counts per micro-batch what becomes of the rows.

    ``marks`` name conditions on the rows of ``step(batch)``; they are counted while the output is written, without a second
    pass. Rows behind the watermark and repeated keys never reach ``step``: the state operator counts them and a listener writes
    its numbers. State is one entry per key for ``delay``. After a failure a batch overwrites its own output and marks;
    a driver lost between a batch and its progress report loses that batch's dropped counts, which ``read_counts`` shows as NULL.
    """
    spark, name = stream.sparkSession, f"counted-{uuid.uuid4().hex}"
    drops = DropCounts(spark, name, f"{path}/dropped")
    once = as_event_time(stream, ts, delay).dropDuplicatesWithinWatermark(list(keys))

    def run(batch: DataFrame, batch_id: int) -> None:
        seen, out = Observation(), step(batch)
        counts = [F.count(F.when(c, 1)).alias(m) for m, c in marks.items()]
        out.observe(seen, *counts).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/out/{BATCH}={batch_id}")
        row = spark.createDataFrame([tuple(seen.get[m] for m in marks)], ", ".join(f"`{m}` bigint" for m in marks)).coalesce(1)
        row.write.mode("overwrite").parquet(f"{path}/marks/{BATCH}={batch_id}")

    spark.streams.addListener(drops)
    writer = once.writeStream.queryName(name).outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start(), drops


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id``, the marks, ``too_late`` and ``repeated`` of a ``counted_sink``; batches without any of them are left out."""
    marks = spark.read.parquet(f"{path}/marks")
    both = marks.join(spark.read.parquet(f"{path}/dropped"), BATCH, "left")
    told = [c for c in both.columns if c != BATCH]
    return both.filter(F.greatest(*[F.coalesce(c, F.lit(1 if c == "too_late" else 0)) for c in told]) > 0)


def versioned_sink(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], keep: str = "last",
    name: str = "stream", every: str | None = None, buckets: int = 64,
) -> StreamingQuery:
    """Every micro-batch is one version of the table at ``path`` (``versions.read_version``), a replayed one none.

    ``name`` tells this query's batch numbers from those of other writers; keep it over restarts from the same checkpoint
    and take a new one with a new checkpoint, whose numbers begin at 0 again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        # Read more than once; what stands above the sink should not run again for that.
        kept = batch.persist(StorageLevel.DISK_ONLY)
        try:
            versions.apply_batch(kept, path, keys, order, keep, name, batch_id, buckets)
        finally:
            kept.unpersist()

    writer = stream.writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def compact_latest(spark: SparkSession, path: str, keys: Sequence[str], to: str) -> None:
    """Write the current rows of a stopped ``upsert_sink`` table as the single batch of a new one."""
    newest = spark.read.parquet(path).agg(F.max(BATCH)).first()[0]
    read_latest(spark, path, keys).write.mode("overwrite").parquet(f"{to}/{BATCH}={newest}")
