"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed runs of five words.  Each set is embedded as 64
minhash coordinates, of which each holds a sampled token.  A run of the join
starts each set in the node of one coordinate's value, hence among the sets that
share this token.  A node with more than ``NODE_ROWS`` sets is split, again and
again, by two coordinates that its path chooses: a set goes to the two children
of its values there.  A pair with similarity 0.8 goes on together in one child at
least with probability 0.96, and through any number of splits in 0.9375 of all
cases.  Splitting ends where a node is small, or where it keeps more than half of
what its parent had, so that most of its pairs are alike and all are compared, in
blocks, each pair of blocks a task of its own.  Runs are repeated until a pair at
the threshold is found with probability ``TARGET_RECALL`` at least.

The pairs found are joined into candidate groups, whose texts are read again and
compared exactly, in blocks too.  Documents with the same words are one set from
the start.  What leaves a task is for each set its number of links and the least
set it is linked with through others, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, deal_in_blocks, kept, linked_sets, partitions_for, runs_of, written
from .words import WordHasher, mixed, rolled, stretches, texts_of, words_in

#: Coordinates of the embedding; the first of them start the runs.
COORDINATES = 64
TARGET_RECALL = 0.995
#: Sets from which on a node is split, the children that each of its sets goes to, and the share of it that a child must fall below.
NODE_ROWS, CHILDREN, PARTS = 512, 2, 0.5
#: Sets of a node that one block has; two blocks are compared at once.
BLOCK_ROWS = 192
#: The same for a candidate group, and the words of its sets.
GROUP_ROWS, GROUP_WORDS = 256, 300_000


def survival(threshold: float) -> float:
    """The chance that a pair at ``threshold`` stays together in some child, however often its node is split."""
    lost = 0.0
    for _ in range(1000):
        lost = (1 - threshold + threshold * lost) ** CHILDREN
    return 1 - lost


def runs_needed(threshold: float, recall: float = TARGET_RECALL) -> int:
    """Runs until a pair at ``threshold`` meets in a last node in one of them."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * survival(threshold)))


def least_equal(threshold: float) -> int:
    """Equal coordinates, of 64, that all but few pairs at ``threshold`` have."""
    return math.floor(COORDINATES * threshold - 4 * math.sqrt(COORDINATES * threshold * (1 - threshold)))


def shingle_sets(data: np.ndarray, bounds: np.ndarray, hasher: WordHasher, k: int) -> tuple[np.ndarray, ...]:
    """Of adjoining texts: all shingles, the text of each, two hashes of each text's words and their number.

    A text of fewer than ``k`` words, but some, has its whole as one shingle.
    """
    n = len(bounds) - 1
    starts, ends, of = words_in(data, bounds)
    hashes = hasher.hashes(data, starts, ends)
    counts = np.bincount(of, minlength=n)
    begin = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(of)) - begin[of]
    digests = []
    for salt in (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93):
        spot = mixed(hashes + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(salt))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(spot), dtype=np.uint64)])
        digests.append(mixed(sums[begin[1:]] - sums[begin[:-1]] + counts.astype(np.uint64)))
    if len(of) >= k:
        whole = of[: len(of) - k + 1] == of[k - 1 :]
        shingles, texts = rolled(hashes, k)[whole], of[: len(whole)][whole]
    else:
        shingles, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        shingles, texts = np.concatenate([shingles, digests[0][short]]), np.concatenate([texts, short])
        order = np.argsort(texts, kind="stable")
        shingles, texts = shingles[order], texts[order]
    return shingles, texts, digests[0], digests[1], counts


def _embedded(k: int, runs: int):
    """Reads (doc_id, text); gives (doc_id, d1, d2, words, first nodes, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        odd = np.random.default_rng(77).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            data, bounds = texts_of(batch.column(1))
            for lo, hi in stretches(bounds):
                n = hi - lo
                shingles, texts, d1, d2, counts = shingle_sets(data, bounds[lo : hi + 1], hasher, k)
                least = np.zeros((COORDINATES, n), np.uint64)
                has = np.flatnonzero(np.bincount(texts, minlength=n))
                at = np.searchsorted(texts, has)
                if len(has):
                    for c in range(COORDINATES):
                        least[c, has] = np.minimum.reduceat(shingles * odd[c], at)
                least = mixed(least)
                roots = np.stack([mixed(least[r] + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) for r in range(runs)], 1)
                empty = np.ones(n, bool)
                empty[has] = False
                sketch = (least & np.uint64(255)).astype(np.uint8).T.copy()
                nodes = pa.ListArray.from_arrays(pa.array(np.arange(0, n * runs + 1, runs, dtype=np.int32)), pa.array(roots.view(np.int64).reshape(-1)))
                sketches = pa.array([None if e else s.tobytes() for e, s in zip(empty, sketch, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(counts), nodes, sketches], names=["doc_id", "d1", "d2", "words", "nodes", "sketch"])

    return run


def _compared(least: int):
    """Reads cells of (cell, rep, sketch); gives links (a, b) to the least set of each connected part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for cell in runs_of(batches, "cell"):
            reps = cell.column("rep").to_numpy()
            sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(len(reps), COORDINATES)
            if len(reps) <= 32:
                same = (sketch[:, None, :] == sketch[None, :, :]).sum(2)
            else:
                same = np.zeros((len(reps), len(reps)), np.uint8)
                for c in range(COORDINATES):
                    same += sketch[:, c][:, None] == sketch[:, c][None, :]
            linked = same >= least
            np.fill_diagonal(linked, False)
            for part in linked_sets(linked):
                ids = reps[part]
                a += ids.tolist()
                b += [int(ids.min())] * len(ids)
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def intersections(shingles: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """Common elements of each two of ``n`` sets, given as distinct (shingle, text) pairs."""
    _, inverse, counts = np.unique(shingles, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    _, columns = np.unique(inverse[shared], return_inverse=True)
    owners = texts[shared]
    common = np.zeros((n, n), np.float64)
    order = np.argsort(columns, kind="stable")
    columns, owners = columns[order], owners[order]
    top = int(columns[-1]) + 1 if len(columns) else 0
    for lo in range(0, top, 4096):
        a, b = np.searchsorted(columns, (lo, lo + 4096))
        block = np.zeros((n, min(4096, top - lo)), np.float32)
        block[owners[a:b], columns[a:b] - lo] = 1
        common += block @ block.T
    return common.astype(np.int64)


def _verified(k: int, threshold: float):
    """Reads cells of (cell, side, within, rep, weight, text); gives (node, root, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for cell in runs_of(batches, "cell"):
            reps = cell.column("rep").to_numpy()
            cell = cell.filter(pa.array(np.concatenate([[True], reps[1:] != reps[:-1]]))).combine_chunks()  # a repeated row is one set
            reps, side, weight = (cell.column(c).to_numpy() for c in ("rep", "side", "weight"))
            n = len(reps)
            shingles, texts = [], []
            at = 0
            for chunk in cell.column("text").chunks:
                data, bounds = texts_of(chunk)
                for lo, hi in stretches(bounds):
                    s, t, *_ = shingle_sets(data, bounds[lo : hi + 1], hasher, k)
                    shingles.append(s)
                    texts.append(t + at)
                    at += hi - lo
            shingles, texts = np.concatenate(shingles), np.concatenate(texts)
            order = np.lexsort((texts, shingles))
            shingles, texts = shingles[order], texts[order]
            fresh = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (texts[1:] != texts[:-1])]) if len(texts) else np.zeros(0, bool)
            shingles, texts = shingles[fresh], texts[fresh]
            sizes = np.bincount(texts, minlength=n)
            common = intersections(shingles, texts, n)
            linked = (common > 0) & (common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9)
            np.fill_diagonal(linked, False)
            if not cell.column("within")[0].as_py():
                linked &= side[:, None] != side[None, :]
            root = reps.copy()
            for part in linked_sets(linked):
                root[part] = reps[part].min()
            links = linked @ weight
            some = np.flatnonzero(links)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in (reps, root, links)], names=["node", "root", "links"])

    return run


def split(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(rep, key)``: the last nodes of the sets ``(rep, sketch)`` that start in ``nodes(rep, key, used)``.

    ``used`` has a bit for each coordinate of the node's path.  Every round is a
    table in the shared folder, which holds the sets of large nodes alone; as a child
    that is split again has at most half of the sets of its parent, there are no more
    rounds than the logarithm of the sets.
    """
    unused = f"filter(sequence(0, {COORDINATES - 1}), i -> shiftrightunsigned(used, i) & 1L = 0)"
    # Two different coordinates, by hashes of the path.
    picks = ["get(free, cast(pmod(xxhash64(key), size(free)) as int))", "get(free, cast(pmod(pmod(xxhash64(key), size(free)) + 1 + pmod(xxhash64(key, 7L), size(free) - 1), size(free)) as int))"]
    child = [f"named_struct('key', xxhash64(key, {p}, substring(sketch, {p} + 1, 1)), 'used', used | shiftleft(1L, {p}))" for p in picks]
    done, current, parents = [], nodes.withColumn("parent", F.lit(None).cast("long")), None
    while True:
        large = current.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent")).where(F.col("n") > NODE_ROWS)
        if parents is not None:
            large = large.join(parents.select(F.col("key").alias("parent"), F.col("n").alias("parent_n")), "parent").where(F.col("n") <= PARTS * F.col("parent_n"))
        # Large nodes are few; written, their size is known and decides how they are joined.
        large = written(large.select("key", "n"))
        done.append(current.join(large.select("key"), "key", "left_anti").select("rep", "key"))
        if large.isEmpty():
            break
        inside = current.join(large.select("key"), "key", "left_semi").join(sets, "rep").withColumn("free", F.expr(unused))
        current = written(inside.select("rep", F.col("key").alias("parent"), F.explode(F.array(*map(F.expr, child))).alias("c")).select("rep", "parent", "c.key", "c.used"))
        parents = large
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def jaccard_classes(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links`` of every row: near-duplicate groups of documents.

    Two documents are linked when the Jaccard similarity of their sets of ``k``-word
    runs is ``threshold`` or more; ``class_id`` is the smallest id reachable by
    links and ``n_links`` the number of rows linked directly, copies included.
    Words are split at white space and compared unchanged.  A document of fewer
    than ``k`` words is one run; one without words (null and empty texts) is
    linked with nothing.  A null id gives a row with a null class and no links.
    Repeated rows count as copies.  Other columns are ignored.
    """
    spark = docs.sparkSession
    runs = runs_needed(threshold)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    embedded = kept(rows.mapInArrow(_embedded(k, runs), "doc_id long, d1 long, d2 long, words long, nodes array<long>, sketch binary"))

    known = embedded.where("doc_id is not null and sketch is not null")
    # Documents with the same words have the same shingles, so any one's nodes and sketch serve.
    same = [F.first(c).alias(c) for c in ("words", "nodes", "sketch")]
    sets = kept(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), *same))
    copies = sets.select("d1", "d2", "rep", "weight", "words")
    node = split(sets.select("rep", "sketch"), sets.select("rep", F.posexplode("nodes").alias("run", "key")).selectExpr("rep", "key", "shiftleft(1L, run) as used"))
    # Most sets are alone in their nodes; only the others' sketches travel.
    cells = deal_in_blocks(node, "key", "rep", BLOCK_ROWS).select("cell", "rep").join(sets.select("rep", "sketch"), "rep").select("cell", "rep", "sketch")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(_compared(least_equal(threshold)), "a long, b long")
    groups = components(found)

    members = groups.join(copies.withColumnRenamed("rep", "node"), "node").select("node", "component", "weight", "words")
    members = deal_in_blocks(members, "component", "node", GROUP_ROWS, "words", GROUP_WORDS)
    # A representative's text is read once and sent to the cells of its group.
    texts = rows.where("doc_id is not null").join(members.groupBy("node").agg(F.collect_list(F.struct("cell", "side", "within", "weight")).alias("cells")), F.col("doc_id") == F.col("node"))
    texts = texts.select("node", "text", F.explode("cells").alias("c")).select("c.cell", "c.side", "c.within", F.col("node").alias("rep"), "c.weight", "text")
    dealt = texts.repartition(partitions_for(docs, text_col, 16 << 20), "cell").sortWithinPartitions("cell", "rep")
    verified = kept(dealt.mapInArrow(_verified(k, threshold), "node long, root long, links long"))

    classes = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    linked = copies.join(links.withColumnRenamed("node", "rep"), "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.select("d1", "d2", F.coalesce("component", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    told = embedded.select("doc_id", "d1", "d2", (F.col("doc_id").isNotNull() & F.col("sketch").isNotNull()).alias("has")).join(linked, ["d1", "d2"], "left")
    return told.select("doc_id", F.when(F.col("has"), F.col("class")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("has"), F.col("links")).otherwise(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of the first document of each class.

    Rows with a null id stay.  Rows that repeat an id are one document: the
    first stays with all its rows.
    """
    classes = jaccard_classes(docs, k, threshold, id_col, text_col)
    others = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("other_id")).distinct()
    return docs.join(others, docs[id_col] == others["other_id"], "left_anti")
