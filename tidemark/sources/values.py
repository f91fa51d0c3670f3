"""Value files: blocks kept apart from the points that point at them.

A batch is a Parquet folder with one directory for each value file, whose number
holds the batch, the life-cycle and the task that wrote it, so that a file has one
life-cycle.  What a pointer needs is the file and the block in it.  Files that
garbage collection has emptied are named by the store's manifest, are no longer
read, and go with the next vacuum.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.garbage import RECORD_BYTES, collectable, resolve
from .store import PointStore

#: Bits of a file number for the task and for the life-cycle.
TASK_BITS, CYCLE_BITS = 24, 8
BLOCKS = "key string, ts_min bigint, ts_max bigint, lifecycle int, block_id bigint, size bigint, block binary, file_id bigint"


class ValueFiles:
    """The value files of a store."""

    def __init__(self, store: PointStore) -> None:
        self.store, self.spark = store, store.spark

    def _state(self) -> tuple[dict, list[str], list[int]]:
        state = self.store.manifest()
        return state, state.get("values", []), state.get("emptied", [])

    def read(self) -> DataFrame:
        """All blocks of files that are not emptied."""
        _, batches, emptied = self._state()
        if not batches:
            return self.spark.createDataFrame([], BLOCKS)
        found = None
        for b in batches:  # each batch has its own file directories
            rows = self.spark.read.schema(BLOCKS).parquet(f"{self.store.path}/{b}")
            found = rows if found is None else found.unionByName(rows)
        return found.where(~F.col("file_id").isin(emptied)) if emptied else found

    def _written(self, rows: DataFrame, state: dict) -> tuple[str, DataFrame]:
        name = f"values-{state['next']}-{uuid.uuid4().hex[:8]}"
        at = F.monotonically_increasing_id()
        task = F.shiftright(at, 33)
        fits = (task < F.lit(1 << TASK_BITS)) & F.col("lifecycle").between(0, (1 << CYCLE_BITS) - 1)
        file_id = F.lit(state["next"] << (TASK_BITS + CYCLE_BITS)) + F.shiftleft(F.col("lifecycle").cast("bigint"), TASK_BITS) + task
        told = rows.withColumn("block_id", at.bitwiseAND((1 << 33) - 1)).withColumn("size", (F.octet_length("block") + F.octet_length("key") + RECORD_BYTES).cast("bigint"))
        told = told.withColumn("file_id", F.when(fits, file_id).otherwise(F.raise_error(F.lit("a life-cycle or a task beyond what a file number holds")).cast("bigint")))
        told.write.partitionBy("file_id").parquet(f"{self.store.path}/{name}")
        return name, self.spark.read.parquet(f"{self.store.path}/{name}")

    def write(self, blocks: DataFrame) -> DataFrame:
        """Add ``(key, ts_min, ts_max, lifecycle, block)``; gives a pointer for each: ``file_id, block_id`` in place of ``block``."""
        with self.store._lock:
            state, batches, _ = self._state()
            name, rows = self._written(blocks.select("key", "ts_min", "ts_max", F.col("lifecycle").cast("int").alias("lifecycle"), F.col("block").cast("binary").alias("block")), state)
            self.store._commit(state | {"next": state["next"] + 1, "values": [*batches, name]})
        return rows.drop("block").withColumn("file_id", F.col("file_id").cast("bigint"))

    def resolve(self, pointers: DataFrame) -> DataFrame:
        """Pointers with their block, null where the file is gone."""
        return resolve(pointers, self.read().select("file_id", "block_id", "block"))

    def totals(self, pointers: DataFrame) -> DataFrame:
        """``file_id, size, discard``: bytes of each file and of its blocks that no pointer names."""
        named = pointers.select("file_id", "block_id", F.lit(True).alias("named")).distinct()
        rows = self.read().select("file_id", "block_id", "size").join(named, ["file_id", "block_id"], "left")
        return rows.groupBy("file_id").agg(F.sum("size").alias("size"), F.sum(F.when(F.col("named"), 0).otherwise(F.col("size"))).alias("discard"))

    def collect_garbage(self, pointers: DataFrame, ratio: float) -> DataFrame:
        """Rewrite the live blocks of files with more than ``ratio`` of garbage; gives all pointers as they then are.

        The files to collect are few numbers on the driver, one for each file of up to a
        gigabyte.  The new batch and the emptied files are one commit.
        """
        with self.store._lock:
            state, batches, emptied = self._state()
            chosen = [r["file_id"] for r in collectable(self.totals(pointers), ratio).select("file_id").collect()]
            if not chosen:
                return pointers
            live = pointers.where(F.col("file_id").isin(chosen)).select("file_id", "block_id").distinct()
            old = self.read().where(F.col("file_id").isin(chosen)).join(live, ["file_id", "block_id"], "left_semi")
            moved = old.select("key", "ts_min", "ts_max", "lifecycle", "block", F.col("file_id").alias("old_file"), F.col("block_id").alias("old_block"))
            name, rows = self._written(moved, state)
            self.store._commit(state | {"next": state["next"] + 1, "values": [*batches, name], "emptied": [*emptied, *chosen]})
        new = rows.select("old_file", "old_block", F.col("file_id").cast("bigint").alias("new_file"), F.col("block_id").alias("new_block"))
        told = pointers.join(new, (F.col("file_id") == F.col("old_file")) & (F.col("block_id") == F.col("old_block")), "left")
        kept = [c for c in pointers.columns if c not in ("file_id", "block_id")]
        return told.select(*kept, F.coalesce("new_file", "file_id").alias("file_id"), F.coalesce("new_block", "block_id").alias("block_id"))

    def vacuum(self) -> list[int]:
        """Remove the directories of emptied files; the manifest goes on naming them."""
        _, batches, emptied = self._state()
        gone, path = [], self.store._hadoop.Path
        for b in batches:
            for f in emptied:
                at = path(f"{self.store.path}/{b}/file_id={f}")
                if self.store._fs.exists(at):
                    self.store._fs.delete(at, True)
                    gone.append(f)
        return sorted(gone)
