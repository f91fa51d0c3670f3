"""The registered queries of the package, on whole small tables, against their SQL or plain Python."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidemark.llm import queries, secrets, tokens

from ..test_queries import same
from .test_joins import brute_vectors, planted_vectors

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no data")


def oracle(name, folder):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            at = f"{folder}/{t}.parquet"
            db.sql(f"create view {t} as select * from '{at}{'/*.parquet' if Path(at).is_dir() else ''}'")
    return db.sql(queries.ORACLES[name]).df()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_and_sql(spark, name):
    assert same(queries.QUERIES[name](spark, DATA).toPandas(), oracle(name, DATA))


def test_vectors_with_links_and_sql(spark, tmp_path):
    """The given vectors have no links; these have pairs, a chain, copies and rows that link with nothing."""
    x = planted_vectors(300, 100, 16)
    chain = [np.cos(k * 0.3) * x[0] / np.linalg.norm(x[0]) + np.sin(k * 0.3) * np.linalg.qr(x[:2].T)[0][:, 1] for k in range(5)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate([*x, *chain, x[7], x[7]])] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = oracle("op9_near_vectors", tmp_path)
    assert (want.n_links > 0).sum() > 200 and len(brute_vectors(x)) >= 100
    assert same(queries.QUERIES["op9_near_vectors"](spark, str(tmp_path)).toPandas(), want)


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_token_counts(spark, documents):
    library = tokens.load(queries.vocabulary("word_bpe_49k.json"))
    for r in queries.QUERIES["op2_token_counts"](spark, DATA).collect():
        text = documents[r.doc_id].text or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids)) and r.over_limit == (r.n_tokens > 2048)


def test_secret_spans(spark, documents):
    patterns = [(n, re.compile(p.replace("(?i:", "(?:"), re.I | re.A) if n == "assign" else re.compile(p), g, k) for n, p, g, k in secrets.BASE]
    got = queries.QUERIES["op3_secret_scan"](spark, DATA).collect()
    assert len(got) == len(documents)
    for r in got:
        text = documents[r.doc_id].text or ""
        base = sorted((m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(patterns) for m in p.finditer(text) if len(m[g]) >= least)
        listed = [f"{n}:{s}:{e}" for s, _, e, n in base]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r.spans.split(","))


def test_mixing_meets_its_targets(spark, documents):
    got = queries.QUERIES["op5_mixing"](spark, DATA).collect()
    total = sum(r.n_tokens for r in got)
    assert len(got) == len(documents) and total == sum(len((d.text or "").split()) for d in documents.values())
    domains = [c[2:] for c in got[0].asDict() if c.startswith("p_")]
    reached = {d: sum(r.copies * r.n_tokens * r[f"p_{d}"] for r in got) / total for d in domains}
    wanted = {"clean": 0.85, "low": 0.1, "toxic": 0.05}
    assert max(abs(reached[d] - wanted[d]) / wanted[d] for d in domains) <= got[0].miss + 1e-6


def test_packed_pieces(spark, documents):
    library = tokens.load(queries.vocabulary("byte_bpe_50k.json"))
    pieces = queries.QUERIES["op6_packing"](spark, DATA).collect()
    of, filled = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        of[p.doc_id].append(p)
        filled[p.sequence_id] += p.length
    assert set(of) == set(documents) and max(filled.values()) <= 1024
    for i, d in documents.items():
        ids = np.asarray([*library.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(of[i], key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()] and sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)


def test_languages_of_documents_held_out(spark, documents):
    got = queries.QUERIES["op10_language_id"](spark, DATA).collect()
    assert len(got) == len(documents) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [(r.lang_pred, documents[r.doc_id].lang) for r in got if r.held_out and documents[r.doc_id].lang and re.search(r"[^\W\d_]", documents[r.doc_id].text or "")]
    assert len(judged) > 20 and np.mean([a == b for a, b in judged]) > 0.95
