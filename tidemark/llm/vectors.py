"""Near-duplicate vectors by collision counting over projections.

Vectors of unit length are projected on random lines.  On each of ``LINES`` lines
the rows are sorted, every row opens a window around its own value, and the
windows' collisions are counted for each pair.  Pairs that reach a count which
pairs at the threshold almost surely reach are verified by their cosine.

A window that pairs at the threshold hardly miss holds a fifth of all rows, so
counting over a whole table would take a share of all pairs.  Tables deal the rows
first, by the intervals that a few further lines are cut into; lines are counted
within each cell of a table.  The lines of a table grow with the logarithm of the
rows, so that cells keep their size, and the number of tables is the least that
finds a pair at the threshold with probability ``TARGET_RECALL``; it grows with
about the fifth root of the rows.  A pair that meets in several tables counts in
the first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, deal_in_blocks, kept, runs_of

TARGET_RECALL = 0.99
#: Lines whose collisions are counted, and the half-width of a window in distances at the threshold.
LINES, WINDOW = 16, 1.25
#: Rows that a cell of a table should have, the width of its intervals on a line, and the most rows compared at once.
CELL_ROWS, INTERVAL, BLOCK_ROWS = 64, 1.5, 512
#: Possible pairs that a task counts at once, unless one cell has more.
COUNTED_PAIRS = 4 << 20
#: Rows of cells that a task compares.
TASK_ROWS = 200_000


def normal_within(x: float) -> float:
    """The share of a standard normal within ``x`` of 0."""
    return math.erf(x / math.sqrt(2))


def least_collisions(miss: float = 0.001) -> int:
    """Windows that a pair at the threshold shares with probability ``1 - miss``."""
    p, tail = normal_within(WINDOW), 0.0
    for n in range(LINES + 1):
        tail += math.comb(LINES, n) * p**n * (1 - p) ** (LINES - n)
        if tail > miss:
            return n
    return LINES


def table_plan(rows: int, distance: float) -> tuple[int, int]:
    """Lines of each table, so that cells stay small, and the number of tables."""
    wide = INTERVAL / math.sqrt(2)
    apart = math.erf(wide / math.sqrt(2)) - math.sqrt(2 / math.pi) / wide * (1 - math.exp(-wide * wide / 2))
    lines = max(1, math.ceil(math.log(rows / CELL_ROWS, 1 / apart))) if rows > CELL_ROWS else 1
    near = INTERVAL / distance
    same = math.erf(near / math.sqrt(2)) - math.sqrt(2 / math.pi) / near * (1 - math.exp(-near * near / 2))
    return lines, math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - same**lines))


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors = flat.reshape(len(lists), -1)
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _gaussians(dimensions: int, lines: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimensions]).standard_normal((dimensions, lines))


def table_keys(unit: np.ndarray, lines: int, tables: int) -> np.ndarray:
    """The cell of each row of ``unit`` in each table."""
    d = unit.shape[1]
    values = unit @ _gaussians(d, lines * tables, 1) / INTERVAL
    values = np.floor(values + np.random.default_rng(2).random(lines * tables)).astype(np.int64).reshape(len(unit), tables, lines)
    hashed = np.full(values.shape[:2], 1469598103934665603 + d, np.int64).view(np.uint64)
    for k in range(lines):
        hashed = (hashed ^ values[:, :, k].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
    return (hashed + np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def _dealt(lines: int, tables: int):
    """Reads (rep, vector); gives the rows' ids with their cell in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray([len(x) for x in batch.column(1)])
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                keys = table_keys(_unit(part.column(1)), lines, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["rep", "keys"])

    return run


def colliding_pairs(cells: np.ndarray, values: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell that lie in each other's window on ``least`` lines or more.

    ``cells`` are ascending numbers; ``values`` has a column for each line.
    """
    n = len(cells)
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])[:n])
    sizes = np.diff(np.append(first, n))
    number = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(n) - first[number]
    bins = np.concatenate([[0], np.cumsum(sizes * sizes)])
    span = 2 * half + 1 + float(values.max() - values.min()) if n else 1.0
    hits = []
    for line in values.T:
        shifted = number * span + line
        order = np.argsort(shifted)
        ordered = shifted[order]
        later = np.searchsorted(ordered, ordered + half, "right") - np.arange(1, n + 1)
        a = np.repeat(np.arange(n), later)
        b = np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later) + a + 1
        i, j = order[a], order[b]
        i, j = np.minimum(i, j), np.maximum(i, j)
        hits.append(bins[number[i]] + within[i] * sizes[number[i]] + within[j])
    found = np.flatnonzero(np.bincount(np.concatenate(hits)) >= least) if hits else np.zeros(0, np.int64)
    cell = np.searchsorted(bins, found, "right") - 1
    place = found - bins[cell]
    return first[cell] + place // sizes[cell], first[cell] + place % sizes[cell]


def least_linked(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the smallest id that links lead to."""
    root = ids.copy()
    while True:
        least = np.minimum(root[i], root[j])
        if (least == root[i]).all() and (least == root[j]).all():
            return root
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)


def _verified(threshold: float, distance: float, lines: int, tables: int):
    """Reads cells of (cell, side, within, rep, weight, vector, t); gives (node, root, links)."""
    least = least_collisions()

    def counted(group: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        """Links within the given cells, whose vectors are of one dimension."""
        sizes = [c.num_rows for c in group]
        rows = pa.concat_tables(group).combine_chunks()
        reps, side, weight, t = (rows.column(c).to_numpy() for c in ("rep", "side", "weight", "t"))
        within = rows.column("within").to_numpy(zero_copy_only=False)
        unit = _unit(rows.column("vector"))
        i, j = colliding_pairs(np.repeat(np.arange(len(sizes)), sizes), unit @ _gaussians(unit.shape[1], LINES, 3), WINDOW * distance, least)
        on = within[i] | (side[i] != side[j])
        i, j = i[on], j[on]
        near = [np.einsum("ij,ij->i", unit[i[lo : lo + 65536]], unit[j[lo : lo + 65536]]) >= threshold for lo in range(0, len(i), 65536)]
        if not near or not (near := np.concatenate(near)).any():
            return
        i, j = i[near], j[near]
        some, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
        keys = np.concatenate([table_keys(unit[some[lo : lo + 4096]], lines, tables) for lo in range(0, len(some), 4096)])
        a, b = inverse[: len(i)], inverse[len(i) :]
        earlier = [((keys[a[lo : lo + 65536]] == keys[b[lo : lo + 65536]]) & (np.arange(tables) < t[i[lo : lo + 65536], None])).any(1) for lo in range(0, len(i), 65536)]
        fresh = ~np.concatenate(earlier)
        a, b, ids, weight = a[fresh], b[fresh], reps[some], weight[some]
        links = (np.bincount(a, weight[b], len(some)) + np.bincount(b, weight[a], len(some))).astype(np.int64)
        root = least_linked(ids, a, b)
        has = links > 0
        if has.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[has].astype(np.int64)) for x in (ids, root, links)], names=["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pairs, width = [], 0, 0
        for cell in runs_of(batches, "cell"):
            d = len(cell.column("vector")[0])
            if group and (pairs + cell.num_rows**2 > COUNTED_PAIRS or d != width):
                yield from counted(group)
                group, pairs = [], 0
            group.append(cell)
            pairs, width = pairs + cell.num_rows**2, d
        if group:
            yield from counted(group)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Two vectors of one dimension are linked when their cosine, in double
    precision, is ``threshold`` or more.  Null, empty and zero vectors and those
    with null or non-finite components are linked with nothing, as is a null id
    (whose component is null and which is kept).  Equal vectors are one until
    the end and count as links of each other; repeated rows likewise.  Other
    columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    distance = math.sqrt(2 - 2 * threshold)
    # Vectors travel as they are stored and become doubles where they are compared.
    kind = dict(vectors.dtypes)[vector_col]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    sound = "vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    rows = rows.withColumn("vector", F.when(F.expr(sound) & F.col("vec_id").isNotNull(), F.col("vector")))
    copies = kept(rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    n = copies.count()
    lines, tables = table_plan(n, distance)
    dealt = copies.select("rep", "vector").mapInArrow(_dealt(lines, tables), "rep long, keys array<long>")
    # Cells are made of ids alone; vectors join when it is known which cells they go to.
    cells = deal_in_blocks(dealt.select("rep", F.posexplode("keys").alias("t", "key")), "key", "rep", BLOCK_ROWS).select("cell", "side", "within", "rep", "t")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * tables // TASK_ROWS)
    cells = cells.join(copies, "rep").select("cell", "side", "within", "rep", "weight", "vector", "t").repartition(tasks, "cell").sortWithinPartitions("cell")
    verified = kept(cells.mapInArrow(_verified(threshold, distance, lines, tables), "node long, root long, links long"))
    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    linked = copies.join(links, F.col("rep") == F.col("node"), "left").drop("node").join(classes, F.col("rep") == F.col("node"), "left")
    linked = linked.select("vector", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    told = rows.join(linked, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return told.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
