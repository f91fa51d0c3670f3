"""The two similarity joins at sizes where their splitting and dealing matter."""

import numpy as np
import pytest

from tidemark.llm import near, vectors
from tidemark.llm.common import arrow_rows

from .test_operators import brute_links, prose, roots


def planted_texts(rng):
    """Texts that share a long common passage, pairs just above 0.8 and a large group of near copies."""
    passage, texts = prose(1, 60), []
    for k in range(120):
        texts.append(f"{passage} {prose(1000 + k, 60, 5000)}")
    for k in range(60):
        base = prose(3000 + k, 154, 5000).split(" ")
        other = base.copy()
        for at in (20, 70, 120):
            other[at] = f"x{k}"
        texts += [" ".join(base), " ".join(other)]
    base = prose(5000, 150, 5000).split(" ")
    for k in range(90):
        other = base.copy()
        other[int(rng.integers(0, 150))] = f"y{k}"
        texts.append(" ".join(other))
    return texts


def test_splitting_keeps_pairs_together(spark, monkeypatch):
    monkeypatch.setattr(near, "NODE_ROWS", 12)
    monkeypatch.setattr(near, "BLOCK_ROWS", 8)
    monkeypatch.setattr(near, "GROUP_ROWS", 16)
    arrow_rows(spark)
    texts = planted_texts(np.random.default_rng(3))
    links = brute_links(texts)
    degree = np.bincount(np.asarray(links).reshape(-1), minlength=len(texts))
    root = roots(len(texts), links)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    found = sum(got[i][1] for i in range(len(texts))) / degree.sum()
    assert found >= 0.97 and all(got[i][0] == root[i] for i in range(120)) and sum(got[i] == (root[i], degree[i]) for i in range(len(texts))) >= 0.95 * len(texts)


def test_large_nodes_are_parted_and_alike_ones_are_not(spark, monkeypatch):
    monkeypatch.setattr(near, "NODE_ROWS", 20)
    rng = np.random.default_rng(5)
    different = rng.integers(0, 256, (300, near.COORDINATES), dtype=np.uint8)
    alike = np.repeat(rng.integers(0, 256, (1, near.COORDINATES), dtype=np.uint8), 100, 0)
    sets = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(np.concatenate([different, alike]))], "rep long, sketch binary")
    nodes = sets.selectExpr("rep", "if(rep < 300, 1L, 2L) as key", "1L as used")
    sizes = {r.key: r.n for r in near.split(sets, nodes).groupBy("key").agg({"rep": "count"}).withColumnRenamed("count(rep)", "n").collect()}
    assert max(n for n in sizes.values() if n != 100) <= 20 and 100 in sizes.values()


def planted_vectors(n, pairs, dimensions=64, seed=7):
    """Random vectors, and ``pairs`` of them with a partner at a cosine just above 0.95."""
    rng = np.random.default_rng(seed)
    own = rng.standard_normal((n, dimensions))
    own /= np.linalg.norm(own, axis=1)[:, None]
    aside = rng.standard_normal((pairs, dimensions))
    aside -= (aside * own[:pairs]).sum(1)[:, None] * own[:pairs]
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    cosine = rng.uniform(0.9501, 0.955, pairs)[:, None]
    return np.concatenate([own, own[:pairs] * cosine + aside * np.sqrt(1 - cosine**2)])


def brute_vectors(x, threshold=0.95):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return [(a, b) for lo in range(0, len(x), 2000) for a, b in zip(*(v.tolist() for v in np.nonzero(unit[lo : lo + 2000] @ unit.T >= threshold)), strict=True) for a in [a + lo] if a > b]


@pytest.mark.parametrize("count", [60, 6000])
def test_planted_vectors_are_found(spark, count):
    arrow_rows(spark)
    x = planted_vectors(count, count // 3)
    links = brute_vectors(x)
    degree = np.bincount(np.asarray(links).reshape(-1), minlength=len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    assert sum(got.values()) >= 0.98 * degree.sum() and all(got[i] <= degree[i] for i in range(len(x)))


def test_a_cosine_at_the_threshold_links(spark):
    # Exactly representable: the products and norms round nowhere, and the cosine is 0.96, or 0.5, itself.
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.96, 0.28, 0.0]), (3, [0.0, 1.0, 1.0]), (4, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = np.asarray([0.96, 0.28]) / np.sqrt(0.96**2 + 0.28**2)
    assert {r.vec_id: r.component_id for r in vectors.near_vectors(df, float(unit[0])).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.vec_id: r.component_id for r in vectors.near_vectors(df, float(np.nextafter(unit[0], 2))).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_tables_follow_the_rows():
    plans = [vectors.table_plan(n, np.sqrt(0.1)) for n in (10, 10_000, 1_000_000, 100_000_000, 10_000_000_000)]
    assert [p[0] for p in plans] == sorted({p[0] for p in plans}) and plans[3][1] < 100


def test_colliding_pairs_against_a_plain_count():
    rng = np.random.default_rng(4)
    for _ in range(30):
        cells = np.sort(rng.integers(0, 5, rng.integers(1, 60)))
        values = np.round(rng.standard_normal((len(cells), 6)), 1)
        want = {(i, j) for j in range(len(cells)) for i in range(j) if cells[i] == cells[j] and (np.abs(values[i] - values[j]) <= 0.45).sum() >= 3}
        assert set(zip(*(v.tolist() for v in vectors.colliding_pairs(cells, values, 0.45, 3)), strict=True)) == want
