"""Mixing: small groups, rates near whole numbers, long texts, skewed mixes."""

import numpy as np

from tidemark.llm import mixing


def frames(spark, data):
    """The texts and the labels of ``(text, domain)`` rows."""
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    return texts, spark.createDataFrame([(i, d) for i, (_, d) in enumerate(data)], "doc_id long, domain string")


def test_no_group_is_starved_of_features(spark):
    """A small language keeps its words however many a large one has."""
    rng = np.random.default_rng(3)
    plain, large, small = [[f"{kind}{k}" for k in range(n)] for kind, n in (("plain", 300), ("large", 90), ("small", 6))]
    mixed = lambda vile: " ".join([*rng.choice(plain, 60), *rng.choice(vile, 40)])
    data = [(" ".join(rng.choice(plain, 100)), "clean") for _ in range(1500)]
    data += [(mixed(large), "toxic") for _ in range(150)] + [(mixed(small), "toxic") for _ in range(12)]
    texts, labels = frames(spark, data)
    model = mixing.train(texts, labels)
    assert set(large + small) <= set(model.words)
    rated = mixing.rated(texts, model, {"clean": 1.0}, anchor="clean").collect()
    assert not [x.row.doc_id for x in rated if x.copies and data[x.row.doc_id][1] == "toxic"]


def test_rates_near_whole_numbers_are_rounded_without_bias(spark):
    rng = np.random.default_rng(4)
    data = [(" ".join(rng.choice([f"{d}{k}" for k in range(20)], 50)), d) for d in "abc" for _ in range(1000)]
    texts, labels = frames(spark, data)
    model = mixing.train(texts, labels)
    for share in ({"a": 0.355, "b": 0.325, "c": 0.32}, {"a": 0.94, "b": 0.04, "c": 0.02}):
        rated = mixing.rated(texts, model, share).collect()
        for d, x in share.items():
            assert abs(sum(r.copies for r in rated if data[r.row.doc_id][1] == d) - 3000 * x) < 40


def test_a_stray_word_does_not_remove_a_long_text(spark):
    rng = np.random.default_rng(6)
    plain, vile = [f"plain{k}" for k in range(300)], [f"vile{k}" for k in range(20)]
    data = [(" ".join(rng.choice(plain, 100)), "clean") for _ in range(800)]
    data += [(" ".join(rng.permutation([*rng.choice(plain, 95), *rng.choice(vile, 5)])), "toxic") for _ in range(100)]
    data += [(" ".join([*rng.choice(plain, 3000), vile[k]]), "clean") for k in range(4)]
    texts, labels = frames(spark, data)
    model = mixing.train(texts, labels, dense=True)
    rated = mixing.rated(texts, model, {"clean": 1.0}, anchor="clean").withColumn("copies", mixing.whole_copies(model, "clean")).collect()
    assert all(x.copies == (data[x.row.doc_id][1] == "clean") for x in rated)
    assert [x.row.doc_id for x in rated if x.rate < 0.5 and data[x.row.doc_id][1] == "clean"]
