"""Reading tables, the shared folder, connected components, grouped Arrow streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a partition in the rounds that find components.
ROUND_ROWS = 200_000
#: The characters that separate words, as the body of a character class.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows and bytes of an Arrow batch, since a row may hold a very long text; a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only on a single machine where none is configured."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, without their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows from a Parquet table in the shared folder; for wide rows that compress."""
    path = path or new_table(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def new_table(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """The same rows, kept on the executors' disks once computed and computed again where one is lost.

    For frames that are read twice within a query: unlike a written table it
    leaves no files in the shared folder, but it keeps its lineage.  A session
    that runs many queries frees them with ``spark.catalog.clearCache()``.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes that a frame reads: Catalyst's sizes of its sources, or its texts' bytes where a source has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if total < 1 << 60:
        return total
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def partitions_for(df: DataFrame, text_col: str, bytes_each: int) -> int:
    """As many partitions as keep each near ``bytes_each``, and no fewer than the session asks for."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, input_bytes(df, text_col) // bytes_each + 1)


def join_apart(rows: DataFrame, grouped: DataFrame, key: str) -> DataFrame:
    """Join rows to an aggregate over the same key so that a hot key's rows can be split over tasks.

    Joined by the key itself, the aggregate's own exchange would serve both and
    Spark could split neither; a hash beside the key gives both sides an exchange
    of their own, and the hint one to whatever is aggregated next.
    """
    left, right = (x.withColumn("key_hash", F.xxhash64(key)) for x in (rows, grouped))
    return left.join(right, ["key_hash", key]).drop("key_hash").hint("rebalance")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``, the smallest node of each.

    Alternating large-star and small-star rounds: a hub's minimum comes from a
    pre-aggregated group, and its rows are only joined, never gathered.  Each
    round is cut to the shared folder, until every node is linked to its root alone.
    No edges give no rows; self-loops and repeated edges change nothing.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        both = pairs.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = join_apart(both, least, "u")
        if large:
            return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(own).where("a <> b").distinct()

    def settled(pairs: DataFrame) -> bool:
        """Whether each node has one edge, to a node that has none."""
        sides = F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))
        ends = pairs.select(F.explode(sides).alias("e")).groupBy("e.n").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("all"))
        return ends.where("up > 1 or (up = 1 and all > 1)").isEmpty()

    current = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not settled(current):
        # A round never adds edges, so their number now bounds the partitions that the next needs.
        enough = current.count() // ROUND_ROWS + 1
        after = star(star(current, True), False)
        current = cut(after.coalesce(enough) if enough < int(current.sparkSession.conf.get("spark.sql.shuffle.partitions")) else after)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Split a stream sorted by ``key`` into one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if held and keys[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.Table.from_batches(held)


def linked_sets(linked: np.ndarray) -> list[np.ndarray]:
    """Connected sets of two or more rows of a symmetric boolean matrix."""
    out, todo = [], linked.any(1)
    while todo.any():
        reached = np.zeros(len(linked), bool)
        front = np.flatnonzero(todo)[:1]
        reached[front] = True
        while len(front):
            fresh = linked[front].any(0) & ~reached
            reached |= fresh
            front = np.flatnonzero(fresh)
        out.append(np.flatnonzero(reached))
        todo &= ~reached
    return out


def deal_in_blocks(rows: DataFrame, key: str, item: str, cap: int, size: str = "1", size_cap: int | None = None) -> DataFrame:
    """Deal the rows of each ``key`` into cells of at most about ``2 * cap`` rows that together hold every pair.

    ``size_cap`` bounds the sum of ``size`` likewise.  A key within the bounds is one cell; a larger one is cut into
    blocks by a hash of ``item`` and has a cell for each pair of blocks.  Keys with
    one row are left out: they have no pair.  Adds ``cell`` (a hash), ``side`` (0 or
    1: the row's block in the cell) and ``within`` (whether the cell is one block).
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / cap), F.ceil(F.sum(F.expr(size)) / (size_cap or cap)))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_of_key"), F.least(blocks, F.count(F.lit(1))).alias("n_blocks")).where("n_of_key > 1")
    sized = join_apart(rows, sizes, key).withColumn("own", F.expr(f"pmod(xxhash64({item}), n_blocks)"))
    spread = sized.withColumn("other", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
    return (
        spread.withColumn("cell", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        .withColumn("within", F.col("own") == F.col("other"))
        .drop("n_of_key", "n_blocks", "own", "other")
    )
