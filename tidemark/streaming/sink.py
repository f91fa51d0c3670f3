"""Structured Streaming into a store.

Points may come however late: the last write of a timestamp wins when read, so
there is no watermark and no state.  A batch and the note that its stream has
written it are one commit of the store's manifest, so a batch that is tried again
after a failure is in the store once, with the order number of its first commit.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import PointStore


def _stream_id(store: PointStore, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream, which a new checkpoint in the same place would not have."""
    path = store._hadoop.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(store.spark._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(store.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def write_points(
    stream: DataFrame, store: PointStore, checkpoint: str, to_points: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = False, partitions: int | None = None
) -> StreamingQuery:
    """Append each micro-batch to the store, each once, whatever other streams write there.

    ``to_points`` turns a micro-batch of raw rows into points; ``partitions`` bounds
    those of a micro-batch, as in :meth:`PointStore.append`.
    """
    more = {} if partitions is None else {"partitions": partitions}

    def append(batch: DataFrame, number: int) -> None:
        own = _stream_id(store, checkpoint)
        if number <= store.manifest().get("streams", {}).get(own, -1):
            return
        points = batch if to_points is None else to_points(batch)
        if not points.isEmpty():
            store.append(points, check_types=False, note={"streams": {own: number}}, **more)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
