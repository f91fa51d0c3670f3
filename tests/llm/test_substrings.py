"""The parse of substring dedup: longest matches, rows that repeat an id, hot phrases."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import substrings

from .test_operators import prose, rows, words


def brute(texts, window=13):
    """``(doc_id, n_words, n_removed, kept_sha256)`` of each row, by the contract."""
    first = {}
    for i, t in texts:
        w = words(t)
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), i), i)
    out = []
    for i, t in texts:
        w = words(t)
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df, **more):
    return rows(substrings.remove_duplicates(df, **more), "doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_texts_that_share_an_id_are_each_judged_and_each_a_source(spark, parts):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    texts = [(1, a), (1, b), (2, a), (3, b), (3, a + " " + prose(4, 30)), (3, b)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
    got = result(df)
    assert got == brute(texts) and [r[2] for r in got] == [0, 0, 20, 20, 20, 20]


@pytest.mark.parametrize("least", [0, substrings.FREQUENT_LEAST])
def test_hot_phrases_change_nothing(spark, monkeypatch, least):
    """An eight-word phrase in every text, between words of its own; dealt whole and window by window."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 4000)
    hot, passage = prose(90, 8), prose(91, 40)
    texts = [(i, f"{prose(100 + i, 30)} {hot} {prose(200 + i, 30)} {passage if i % 5 == 0 else ''} {hot}") for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    keyed = df.selectExpr("doc_id", "hash(text) as salt", "text")
    assert bool(substrings.frequent_minimizers(keyed, 13, least)) == (least == 0)
    assert result(df, frequent_least=least) == brute(texts)


def test_longest_matches_and_factors_against_a_plain_search():
    rng = np.random.default_rng(1)
    for _ in range(100):
        lengths = rng.integers(1, 15, rng.integers(1, 12))
        phrases, docs = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.sort(rng.integers(0, 6, len(lengths))), lengths)
        classes = np.unique(rng.integers(0, 3, len(phrases)), return_inverse=True)[1]
        n = len(classes)

        def alike(i, j):
            k = 0
            while max(i, j) + k < n and phrases[i + k] == phrases[i] and phrases[j + k] == phrases[j] and classes[i + k] == classes[j + k]:
                k += 1
            return k

        longest, source = substrings.longest_matches(classes, phrases, docs)
        assert longest.tolist() == [max((alike(i, j) for j in range(n) if docs[j] < docs[i]), default=0) for i in range(n)]
        assert all(docs[source[i]] < docs[i] and alike(i, source[i]) == longest[i] for i in np.flatnonzero(longest))
        covered = np.zeros(n, bool)
        for at in substrings.greedy_factors(longest, phrases):
            assert not covered[at]
            covered[at : at + longest[at]] = True
        assert (covered == (longest > 0)).all()


def test_windows_are_told_apart_by_their_words(monkeypatch):
    codes = np.random.default_rng(2).integers(0, 3, 500)
    at = np.arange(488)
    classes = substrings.window_classes(codes, at, 13)
    known = {}
    assert all(known.setdefault(tuple(codes[i : i + 13].tolist()), classes[i]) == classes[i] for i in at) and len(known) == classes.max() + 1
    # Fingerprints that collide are noticed and drawn again.
    drawn, real = [], substrings.rolled
    monkeypatch.setattr(substrings, "rolled", lambda h, k: real(h, k) & np.uint64(3 if drawn.append(1) or len(drawn) == 1 else 2**64 - 1))
    assert np.array_equal(np.unique(substrings.window_classes(codes, at, 13)), np.unique(classes)) and len(drawn) == 2


def test_a_block_gives_sources(spark):
    a, b = np.asarray([[1, 0, 0, 8]]).T, np.asarray([[2, 0, 5, 8]]).T
    text = " ".join(f"w{i}" for i in range(20)).encode()
    squeezed = substrings._squeezed(text)
    block = substrings.ReferenceBlock([(substrings._packed(*b), squeezed), (substrings._packed(*a), squeezed), (substrings._packed(*a), squeezed)], 13)
    at, length, source = block.factors()
    assert [(block.docs[i], block.places[i], n, block.docs[s], block.places[s]) for i, n, s in zip(at, length, source, strict=True)] == [(2, 5, 8, 1, 0)]


def test_packing_is_a_round_trip():
    arrays = [np.asarray(x) for x in ([5, 5, -(1 << 63), (1 << 63) - 1], [-1, 0, 7, 7], [0, 0, 0, 0])]
    assert np.array_equal(substrings._unpacked(substrings._packed(*arrays), 3), np.stack(arrays)) and substrings._unpacked(substrings._packed(*(np.zeros(0, int),) * 3), 3).shape == (3, 0)
