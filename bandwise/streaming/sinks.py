"""Checkpointed sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bandwise.streaming.batches import END, MARK


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    *,
    name: str = "bandwise",
    available_now: bool = False,
    refresh: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Append micro-batches to a Parquet table; a repeated batch replaces its own files.

    ``refresh`` is called with each batch as written, for example to allocate new thresholds.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        if refresh is not None:
            written = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={epoch}")
            refresh(written, epoch)

    writer = (
        df.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .foreachBatch(save)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_bounded(
    df: DataFrame,
    path: str,
    checkpoint: str,
    marks: str,
    *,
    name: str = "bandwise",
    refresh: Callable[[DataFrame, int], None] | None = None,
    more: Sequence[Callable[[], None]] = (),
) -> None:
    """Write what a bounded input gives, the open state at its end included.

    ``df`` reads its events through ``until_end`` with the same folder.  The mark comes after all
    input has been worked on, so no event is late because of it.  Steps in ``more`` each add input
    after everything before them has been worked on.
    """

    def work() -> None:
        write_stream(
            df, path, checkpoint, name=name, available_now=True, refresh=refresh
        ).awaitTermination()

    work()
    for step in more:
        step()
        work()
    df.sparkSession.createDataFrame([(END,)], MARK).write.mode("append").parquet(marks)
    work()
