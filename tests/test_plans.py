"""Compaction planning, value files and cost figures."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import costs
from tidemark.operators import garbage, reports
from tidemark.plans import compaction as c


def gens(*levels, size=10, tombstones=()):
    return [c.Generation(i + 1, v, size, i in tombstones, 0, [f"{i + 1:09d}-{v:09d}.sst"]) for i, v in enumerate(levels)]


def test_levels():
    assert [len(g) for g in c.plan_level(gens(*[1] * 17), 1)] == [8, 8]
    assert [len(g) for g in c.plan_level(gens(*[1] * 9, tombstones=[8]), 1)] == [8, 1]
    assert c.plan_level(gens(1), 1) == [] and c.plan_level(gens(1, tombstones=[0]), 1) != []
    assert [len(g) for g in c.plan_level(gens(4, 4, 2, 2, 2, 2, 1), 2)] == [4]
    # A generation before a higher one joins the open run, whatever its level.
    assert [len(g) for g in c.plan_level(gens(2, 2, 1, 2, 2), 2)] == [4]


def test_plan_of_old_generations():
    assert [len(g) for g in c.plan(gens(*[4] * 9))] == [4, 4]
    assert c.plan(gens(3, 4, 4, 4, 4)) == []
    big = gens(*[4] * 5)
    big[0].size = 100  # more than twice the next: left alone
    assert [len(g) for g in c.plan(big)] == [4]
    full = gens(*[5] * 6)
    full[0].size, full[0].first_block = c.MAX_FILE_BYTES + 1, 2000
    assert c.plan(full)[0][0] == full[1].files[0]
    assert len(c.plan(gens(1, 1, 4), cold=True)[0]) == 3 and c.plan(gens(1), cold=True) == []


def test_optimize():
    assert [len(g) for g in c.plan_optimize(gens(4, 4, 4, 4, 4, 1))] == [5]
    assert c.plan_optimize(gens(4, 4, 4)) == [] and c.plan_optimize(gens(4, 4, 4, tombstones=[1])) != []


def test_scheduler():
    assert c.next_level({1: 1, 2: 1, 3: 5, 4: 1}, {}, 4) == 3
    assert c.next_level({1: 1, 3: 2}, {}, 4) == 1  # equal weight: the lowest
    assert c.next_level({1: 3}, {1: 4}, 4) is None and c.next_level({}, {}, 4) is None


def test_groups_by_levels_match_a_walk():
    rng = random.Random(3)
    for _ in range(50):
        g = gens(*[rng.randint(1, 5) for _ in range(rng.randint(0, 30))], tombstones={i for i in range(30) if rng.random() < 0.1})
        runs, open_run = [], []
        for i, x in enumerate(g):
            rises = i + 1 < len(g) and x.level < g[i + 1].level
            if rises or not open_run or max(y.level for y in open_run) == x.level:
                open_run = [*open_run, x]
            else:
                runs.append(open_run)
                open_run = [x]
        runs += [open_run] if open_run else []
        assert c._runs(g) == runs


def test_component():
    assert garbage.component([(1, 2, 0.9), (2, 3, 0.1), (4, 5, 0.8)], 3) == [1, 2, 3]
    assert garbage.component([(1, 2, 0.9), (4, 5, 0.8)], 4) == [1, 2, 4, 5]
    assert garbage.component([(1, 2, 0.9)], 5) == [1, 2] and garbage.component([], 3) == []


def test_edge_weights(spark):
    files = spark.createDataFrame([(1, 100, 50), (2, 100, 100), (3, 10, 1)], "file_id bigint, size bigint, valid bigint")
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "z")], "file_id bigint, key string")
    (edge,) = garbage.edge_weights(files, keys).collect()
    r, common, union = 150 / 200, 1, 3
    assert (edge.i, edge.j, edge.common, edge["all"]) == (1, 2, 1, 3)
    assert abs(edge.weight - (1 - r + common / union) / (1 + r - 1 / union)) < 1e-12


def test_zeta_against_a_plain_sum():
    import math

    n, gap, delay, k, samples, mu, sigma = 3, 0.5, 0.7, 20, 5, 4.0, 1.5
    pdf = lambda x: math.exp(-((x - mu) ** 2) / (2 * sigma**2)) / (sigma * math.sqrt(2 * math.pi))
    cdf = lambda x: 0.5 * (1 + math.erf((x - mu) / (sigma * math.sqrt(2))))
    h, step, total = (mu + 5 * sigma) / 1000, max(1, k // samples), 0.0
    for i in range(0, k, step):
        total += 1 - sum(pdf(s * h) * math.prod(cdf((i + j) * (gap + delay) + s * h) for j in range(1, n + 1)) * h for s in range(1000))
    assert np.isclose(costs.zeta_of(n, gap, delay, k, samples, mu, sigma), k / ((k + step - 1) // step) * total)
    assert costs.zeta_of(3, 1, 1, 0, 5, 4, 1) == 0 and costs.zeta_of(3, 1, 1, 5, 0, 4, 1) == 0


def test_coupled_averages(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("a", i, rng.uniform(-5, 5), rng.uniform(-5, 5)) for i in range(60)]
    first = second = 0.0
    for _, _, td, tg in rows:
        first = (td + second) / 2 if td > 0 else first
        second = (tg + first) / 2 if tg > 0 else second
    df = spark.createDataFrame(rows, "k string, at int, td double, tg double").repartition(4)
    for chunk in (4096, 3):  # chunks of chunks of chunks
        monkeypatch.setattr(reports, "CHUNK", chunk)
        (got,) = reports.coupled_averages(df, "k", "at").collect()
        assert np.allclose([got.avg_td, got.avg_tg], [first, second])
        latest = reports.running_latency(df, "k", "at", "td").collect()
        assert len(latest) == 60 and all(np.isclose(r.latency, np.mean([x[2] for x in rows[max(0, r["at"] - 3) : r["at"] + 1]])) for r in latest)
    assert reports.coupled_averages(df.limit(0), "k", "at").count() == 0


def test_separation(spark):
    df = spark.createDataFrame([(40.0, 4.0, 10.0, 100.0), (5.0, 4.0, 10.0, 100.0)], "z double, n double, k double, v double")
    decided = [r[0] for r in df.select(costs.separates(F.col("z"), F.col("n"), F.col("k"), F.col("v"), F.lit(20.0))).collect()]
    assert decided == [False, True]


def test_component_of_the_heaviest_edges(spark):
    rng = random.Random(4)
    for budget in (2, 4, 7):
        edges = [(i, j, rng.choice([0.1, 0.5, 0.9, rng.random()])) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.6]
        top = [tuple(r) for r in garbage.heaviest(spark.createDataFrame(edges, "i bigint, j bigint, weight double"), budget).collect()]
        assert len(top) <= 14 * budget and garbage.component(top, budget) == garbage.component(edges, budget) == slow_component(edges, budget)


def slow_component(edges, budget):
    ordered, chosen = sorted(edges, key=lambda e: (-e[2], e[0], e[1])), set()
    while len(chosen) < budget and (start := next((e for e in ordered if not {e[0], e[1]} <= chosen), None)):
        part = {start[0], start[1]}
        chosen |= part
        while len(chosen) < budget and (step := next((e for e in ordered if (e[0] in part or e[1] in part) and not {e[0], e[1]} <= chosen), None)):
            part |= {step[0], step[1]}
            chosen |= part
    return sorted(chosen)


def test_planner_takes_and_gives_back():
    p, g = c.Planner(), gens(*[1] * 16)
    level, first = p.next_group(g, {}, 4)
    assert level == 1 and first == [x.files[0] for x in g[:8]]
    assert not p.acquire([first]) and [x.id for x in p.free(g)] == list(range(9, 17))
    assert p.next_group(g, {1: 1}, 4)[1] == [x.files[0] for x in g[8:]] and p.next_group(g, {1: 2}, 4) is None
    p.release([first])
    p.force_full()
    assert p.queues(g)[4] == [sorted(first)] and p.queues(g)[1] == [first]


def test_metric_lines(spark):
    df = spark.createDataFrame([(30.0,), (80.5,), (700.0,)], "d double")
    lines = [r.line for r in reports.exposition(reports.histogram_metrics(reports.delay_classes(df, "d"), "wait")).collect()]
    assert lines == ['wait_bucket{le="50"} 1', 'wait_bucket{le="100"} 2', 'wait_bucket{le="500"} 2', 'wait_bucket{le="+Inf"} 3', "wait_count 3", "wait_sum 810.5"]
