"""Templates that arrive as a stream, matched against a static index batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def match_stream(templates: DataFrame, match: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes ``match``'s rows for each micro-batch of templates as Parquet under path/batch=<number>.

    Matching takes several passes over a batch, so it runs in foreachBatch; a batch that is repeated after a failure replaces
    its own folder, so each template is written once. ``once`` handles what is there and stops.
    """

    def handle(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = templates.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
