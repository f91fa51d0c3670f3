"""A store of points: Parquet batches under a folder, named by a manifest.

Every write, delete or compaction writes new files and then one new manifest;
readers see the newest manifest whole.  Files and manifests go through the Hadoop
file system, so the folder may be local or shared.  One process writes at a time;
its threads, such as several streams, take turns.

The manifest also holds the types of all fields, the last batch of every stream
and the last entry of the write log that the points contain, so that a batch and
the note that it has been written are one commit.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MAX_NS, MIN_NS, POINTS, TOMBSTONES, TypeConflict
from ..operators.points import IDENTITY, apply_tombstones, last_write_wins, live, type_conflicts

#: Bits of ``seq`` for the row in its partition and for the partition; the batch has the rest.
ROW_BITS, PARTITION_BITS = 27, 17
BATCH_BITS = ROW_BITS + PARTITION_BITS
#: Fields whose types the manifest itself lists; beyond, they are a table that it names.
LISTED_TYPES = 10_000

_turns: dict[str, threading.RLock] = {}
_turns_guard = threading.Lock()


def _turn(path: str) -> threading.RLock:
    """The lock of a store's folder in this process."""
    with _turns_guard:
        return _turns.setdefault(path, threading.RLock())


class PointStore:
    """Points and tombstones in a folder.

    The last write of a timestamp wins.  A store that is new and made with
    ``every_write`` keeps and reads all writes that no delete covers; its manifest
    says so from then on.
    """

    def __init__(self, spark: SparkSession, path: str, every_write: bool = False) -> None:
        self.spark, self.path, self._every_write = spark, path.rstrip("/"), every_write
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)
        self._lock = _turn(str(self._fs.makeQualified(root).toString()))

    # -- manifest ---------------------------------------------------------------

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest state: batches of points and of tombstones, the next batch number, types, streams, log."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "next": 1, "points": [], "tombstones": [], "types": []} | ({"every_write": True} if self._every_write else {})
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/manifest-{versions[-1]}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        state = state | {"version": state["version"] + 1}
        draft, final = (self._hadoop.Path(f"{self.path}/{n}{state['version']}.json") for n in (".draft-", "manifest-"))
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer has committed version {state['version']}")

    # -- reading ----------------------------------------------------------------

    def raw(self) -> DataFrame:
        """All points as written."""
        batches = self.manifest()["points"]
        if not batches:
            return self.spark.createDataFrame([], POINTS)
        return self.spark.read.schema(POINTS).parquet(*(f"{self.path}/{b}" for b in batches))

    def tombstones(self) -> DataFrame:
        """All deletes."""
        batches = self.manifest()["tombstones"]
        if not batches:
            return self.spark.createDataFrame([], TOMBSTONES)
        return self.spark.read.schema(TOMBSTONES).parquet(*(f"{self.path}/{b}" for b in batches))

    def read(self) -> DataFrame:
        """Live points."""
        seen = apply_tombstones if self.manifest().get("every_write") else live
        return seen(self.raw(), self.tombstones())

    def catalog(self) -> DataFrame:
        """Fields that have a type: ``key, field, ftype``; from the manifest or the table that it names, not from the points."""
        types = self.manifest()["types"]
        if isinstance(types, str):
            return self.spark.read.schema("key string, field string, ftype string").parquet(f"{self.path}/{types}")
        return self.spark.createDataFrame([tuple(t) for t in types], "key string, field string, ftype string")

    # -- writing ----------------------------------------------------------------

    def append(self, points: DataFrame, check_types: bool = True, partitions: int = 1 << PARTITION_BITS, note: dict | None = None) -> int:
        """Add points; their ``seq`` is set by the batch, later rows of a batch counting as later.

        With ``check_types`` a field that has another type already, or two in
        ``points``, raises :class:`TypeConflict` and nothing is written.  A batch of
        more than 131,072 partitions must say how many it may have at most: it takes
        several batch numbers.  More partitions than told, or more than 134,217,728
        rows in one, make the write fail before anything is committed.  ``note`` is
        merged into the manifest by the same commit.
        """
        with self._lock:
            state = self.manifest()
            batch, span = state["next"], -(-partitions // (1 << PARTITION_BITS))
            if batch + span > 1 << (63 - BATCH_BITS):
                raise OverflowError("the store has no batch numbers left; compact it into a new one")
            known = self.catalog()
            own = points.select("key", "field", "ftype").distinct()
            if check_types:
                clash = type_conflicts(known, own).first()
                if clash is not None:
                    raise TypeConflict(f"{clash['key']}.{clash['field']} is {clash['existing']}, not {clash['ftype']}")
                twice = own.groupBy("key", "field").agg(F.min("ftype").alias("a"), F.max("ftype").alias("b")).where("a <> b").first()
                if twice is not None:
                    raise TypeConflict(f"{twice['key']}.{twice['field']} is {twice['a']} and {twice['b']} in one batch")
            at = F.monotonically_increasing_id()
            part, row = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
            fits = (part < F.lit(span << PARTITION_BITS)) & (row < F.lit(1 << ROW_BITS))
            order = F.when(fits, F.shiftleft(part, ROW_BITS).bitwiseOR(row)).otherwise(F.raise_error(F.lit("more partitions, or rows in one, than a batch can number")).cast("bigint"))
            rows = points.withColumn("seq", F.lit(batch << BATCH_BITS) + order).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in POINTS))
            name = f"points-{batch}-{uuid.uuid4().hex[:8]}"
            rows.sortWithinPartitions(*IDENTITY).write.parquet(f"{self.path}/{name}")
            # Types of what has been written, not of a second reading of its source.
            fresh = self.spark.read.schema(POINTS).parquet(f"{self.path}/{name}").select("key", "field", "ftype").distinct()
            types = self._with_types(state, known, fresh.join(known, ["key", "field"], "left_anti"), batch)
            self._commit(state | {"next": batch + span, "points": [*state["points"], name], "types": types} | self._merged(state, note))
            return batch

    def _with_types(self, state: dict, known: DataFrame, fresh: DataFrame, batch: int) -> list | str:
        """The manifest's types after a batch: a list, or the name of a table once there are many."""
        types = state["types"]
        new = [tuple(r) for r in fresh.limit(LISTED_TYPES + 1).collect()]
        if not new or (isinstance(types, list) and len(types) + len(new) <= LISTED_TYPES):
            return types if not new else [*types, *new]
        name = f"types-{batch}-{uuid.uuid4().hex[:8]}"
        known.unionByName(fresh).write.parquet(f"{self.path}/{name}")
        return name

    @staticmethod
    def _merged(state: dict, note: dict | None) -> dict:
        """``note`` as it is merged into a manifest: dictionaries key by key."""
        return {k: (state.get(k, {}) | v if isinstance(v, dict) else v) for k, v in (note or {}).items()}

    def delete(self, key: str, lo: int = MIN_NS, hi: int = MAX_NS, field: str | None = None) -> int:
        """Delete what has been written so far of a series (one field or all) in ``[lo, hi]``."""
        return self.delete_ranges(self.spark.createDataFrame([(key, field, lo, hi)], "key string, field string, ts_min bigint, ts_max bigint"))

    def delete_ranges(self, ranges: DataFrame) -> int:
        """Delete many ``(key, field, ts_min, ts_max)`` at once."""
        with self._lock:
            state = self.manifest()
            batch = state["next"]
            name = f"tombstones-{batch}-{uuid.uuid4().hex[:8]}"
            rows = ranges.withColumn("del_seq", F.lit(batch << BATCH_BITS)).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in TOMBSTONES))
            rows.write.parquet(f"{self.path}/{name}")
            self._commit(state | {"next": batch + 1, "tombstones": [*state["tombstones"], name]})
            return batch

    def compact(self, batches: list[str] | None = None, fast: bool = False) -> str:
        """Rewrite batches (all by default) as one, sorted by series and time.

        Rewriting all applies and drops the tombstones; a part keeps them, as other
        batches may need them.  Each point keeps its ``seq``, so reads see no change.
        With ``fast`` only series fields that more than one of the batches has, or
        that a tombstone names, are merged; all others are copied as they are,
        without a shuffle.
        """
        with self._lock:
            state = self.manifest()
            chosen = state["points"] if batches is None else [b for b in state["points"] if b in batches]
            if not chosen:
                return ""
            rows = self.spark.read.schema(POINTS).parquet(*(f"{self.path}/{b}" for b in chosen))
            whole = len(chosen) == len(state["points"])
            every = state.get("every_write", False)
            latest = (lambda r: r) if every else last_write_wins
            merged = lambda r: latest(apply_tombstones(r, self.tombstones()) if whole else r)
            name = f"points-{state['next']}c-{uuid.uuid4().hex[:8]}"
            if fast:
                parts = [self.spark.read.schema(POINTS).parquet(f"{self.path}/{b}").select("key", "field").distinct().withColumn("part", F.lit(i)) for i, b in enumerate(chosen)]
                shared = parts[0]
                for p in parts[1:]:
                    shared = shared.unionByName(p)
                touched = shared.groupBy("key", "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "field")
                if not every:
                    # A series that a batch has twice at one time overlaps itself.
                    crowded = rows.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "field")
                    touched = touched.union(crowded).distinct()
                if whole:
                    touched = touched.union(rows.select("key", "field").distinct().join(self.tombstones().select("key").distinct(), "key", "left_semi")).distinct()
                # Few bytes beside the points; written, their size is known and decides how they are joined.
                scratch = f"{self.path}/.overlaps-{uuid.uuid4().hex[:8]}"
                touched.write.parquet(scratch)
                touched = self.spark.read.schema("key string, field string").parquet(scratch)
                rows.join(touched, ["key", "field"], "left_anti").select(*rows.columns).sortWithinPartitions(*IDENTITY).write.parquet(f"{self.path}/{name}")
                again = merged(rows.join(touched, ["key", "field"], "left_semi").select(*rows.columns))
                again.repartitionByRange(*IDENTITY).sortWithinPartitions(*IDENTITY).write.mode("append").parquet(f"{self.path}/{name}")
                self._fs.delete(self._hadoop.Path(scratch), True)
            else:
                merged(rows).repartitionByRange(*IDENTITY).sortWithinPartitions(*IDENTITY).write.parquet(f"{self.path}/{name}")
            rest = [b for b in state["points"] if b not in chosen]
            self._commit(state | {"next": state["next"] + 1, "points": [name, *rest], "tombstones": [] if whole else state["tombstones"]})
            return name

    def vacuum(self) -> list[str]:
        """Remove folders and manifests that the newest manifest no longer names."""
        state = self.manifest()
        kept = {*state["points"], *state["tombstones"], f"manifest-{state['version']}.json", str(state["types"])}
        gone = []
        for s in self._fs.listStatus(self._hadoop.Path(self.path)):
            name = s.getPath().getName()
            if name.startswith(("points-", "tombstones-", "types-", "manifest-", ".draft-", ".overlaps-")) and name not in kept:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return sorted(gone)
