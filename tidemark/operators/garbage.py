"""Value files: regions, pointers, garbage counts and what to collect."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import LIFECYCLE_DAYS
from .spread import dealt

#: Bytes of a value record besides its key and block: header and checksum.
RECORD_BYTES = 30 + 4


def regions(blocks: DataFrame) -> DataFrame:
    """Files, blocks and bytes of each life-cycle's region, and whether the life-cycle is known."""
    known = F.col("lifecycle").isin(*LIFECYCLE_DAYS)
    return blocks.groupBy("lifecycle").agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("n_bytes")).withColumn("known", known)


def resolve(pointers: DataFrame, values: DataFrame) -> DataFrame:
    """Pointers with their block; null where the value file is gone."""
    return pointers.join(values, ["file_id", "block_id"], "left")


def discard(deleted: DataFrame) -> DataFrame:
    """Bytes that replaced blocks have turned to garbage, by file."""
    return deleted.groupBy("file_id").agg(F.sum(F.col("size") + F.octet_length("key") + RECORD_BYTES).alias("discard"))


def most_garbage(totals: DataFrame) -> DataFrame:
    """The file with the most garbage; the smallest id of several."""
    best = F.max_by("file_id", F.struct("discard", -F.col("file_id")))
    return totals.agg(best.alias("file_id"), F.max("discard").alias("discard"))


def collectable(files: DataFrame, ratio: float) -> DataFrame:
    """Files whose garbage exceeds ``ratio`` of their size, except the newest, with their valid bytes."""
    newest = files.agg(F.max("file_id").alias("newest"))
    rows = files.join(newest, F.col("file_id") < F.col("newest"), "left_semi")
    return rows.where(F.col("discard") > ratio * F.col("size")).withColumn("valid", F.col("size") - F.col("discard"))


def pairs_at_most(keys: DataFrame, tasks: int | None = None) -> int:
    """How many pairs of rows of ``keys(file_id, key)`` have a key in common: no graph has more edges."""
    counts = dealt(keys.select("key"), tasks, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return int(counts.agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("decimal(38,0)")).alias("pairs")).first()["pairs"] or 0)


def edge_weights(files: DataFrame, keys: DataFrame, key_tasks: int | None = None, pair_tasks: int | None = None) -> DataFrame:
    """Weight of each two files with a key in common.

    ``files(file_id, size, valid)``, ``keys(file_id, key)``.  With ``r`` the valid
    share of both, ``J`` common and ``U`` all keys: ``(1 - r + J/U) / (1 + r - 1/U)``.
    A key's list has each file once, so its length is bounded by the files; the
    graph itself has no more rows than pairs of files.  With ``key_tasks`` and
    ``pair_tasks`` keys and pairs are dealt to so many before they are aggregated or
    joined, so that a task's share is bounded where their number follows the rows'.
    """
    own = dealt(keys.select("file_id", "key"), key_tasks, "key").distinct()
    counts = own.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    info = files.join(counts, "file_id").select("file_id", "size", "valid", "n")
    # Keys with the same files are counted together before their pairs are made.
    lists = own.groupBy("key").agg(F.sort_array(F.collect_list("file_id")).alias("files")).where(F.size("files") > 1).groupBy("files").agg(F.count(F.lit(1)).alias("n_keys"))
    first = dealt(lists, pair_tasks, "files").select("n_keys", "files", F.posexplode("files").alias("at", "i"))
    told = dealt(first.select("n_keys", "i", F.explode(F.expr("slice(files, at + 2, size(files))")).alias("j")), pair_tasks, "i", "j")
    pairs = told.groupBy("i", "j").agg(F.sum("n_keys").alias("common"))
    named = lambda s: info.select(*(F.col(c).alias(f"{c}_{s}") for c in info.columns))
    half = dealt(pairs, pair_tasks, "i").join(named("i"), F.col("i") == F.col("file_id_i"))
    both = dealt(half, pair_tasks, "j").join(named("j"), F.col("j") == F.col("file_id_j"))
    union = F.col("n_i") + F.col("n_j") - F.col("common")
    r = (F.col("valid_i") + F.col("valid_j")) / (F.col("size_i") + F.col("size_j"))
    return both.select("i", "j", "common", union.alias("all"), ((1 - r + F.col("common") / union) / (1 + r - 1 / union)).alias("weight"))


def heaviest(edges: DataFrame, budget: int, tasks: int | None = None) -> DataFrame:
    """Of ``edges(i, j, weight)`` those that :func:`component` may follow: the ``budget`` heaviest of each file.

    A part of at most ``budget`` files has fewer than ``budget`` neighbours of a file
    inside, so its best way out of that file is among these.  As many rows as files
    times ``budget`` at most.  With ``tasks`` the ends are dealt to so many before
    they are sorted.
    """
    ends = F.array(F.col("i"), F.col("j"))
    order = Window.partitionBy("file").orderBy(F.col("weight").desc(), "i", "j")
    ranked = dealt(edges.select("i", "j", "weight", F.explode(ends).alias("file")), tasks, "file").withColumn("nth", F.row_number().over(order))
    return ranked.where(F.col("nth") <= budget).select("i", "j", "weight").distinct()


def component(edges: Iterable[tuple[int, int, float]], budget: int) -> list[int]:
    """Grow a set of files along the heaviest edges until it has ``budget`` of them.

    Each part starts from the heaviest edge not wholly inside; the heaviest edge
    that touches the part is added next.  Ends when no edge is left.  Edges are
    taken from queues, each once.
    """
    ordered = sorted((-w, i, j) for i, j, w in edges)
    of: dict[int, list[tuple]] = {}
    for e in ordered:
        for end in e[1:]:
            of.setdefault(end, []).append(e)
    chosen: set[int] = set()
    at = 0
    while len(chosen) < budget and at < len(ordered):
        start = ordered[at]
        if set(start[1:]) <= chosen:
            at += 1
            continue
        queue: list[tuple] = []
        grown: set[int] = set()

        def take(file: int, queue=queue, grown=grown) -> None:
            if file not in grown:
                grown.add(file)
                for e in of[file]:
                    heapq.heappush(queue, e)

        for file in start[1:]:
            take(file)
        chosen |= grown
        while queue and len(chosen) < budget:
            edge = heapq.heappop(queue)
            if not set(edge[1:]) <= chosen:
                for file in edge[1:]:
                    take(file)
                chosen |= grown
    return sorted(chosen)
