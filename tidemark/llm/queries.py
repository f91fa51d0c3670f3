"""The registered queries of this package, over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages, mixing, near, packing, quality, secrets, substrings, tokens, urls, vectors
from .common import arrow_rows, table

#: (verdict, host, path) of the URL rules.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return substrings.remove_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, mixing.domain_labels(table(spark, sf_dir, "labels")))
    rated = mixing.rated(docs, model, {"clean": 0.85, "low": 0.1, "toxic": 0.05}, keep=["doc_id"])
    posteriors = [F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(model.domains)]
    return rated.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", *posteriors, "rate", "copies", "miss")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return near.jaccard_classes(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules)


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)
    docs = table(spark, sf_dir, "documents")
    return languages.identify(docs, languages.train(docs))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_url_filters": op8_url_filters,
    "op9_near_vectors": op9_near_vectors,
    "op10_language_id": op10_language_id,
}

_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

ORACLES = {
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        g AS (SELECT *, string_agg(word, ' ') OVER s AS g, count(*) OVER s AS n FROM p WINDOW s AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
        f AS (SELECT g, min(doc_id) AS f FROM g WHERE n = 13 GROUP BY g),
        c AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i FROM g JOIN f USING (g) WHERE n = 13 AND f < doc_id), range(13) t(k)),
        k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN c USING (r, i) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
        g AS (SELECT doc_id, n, string_agg(word, ' ') OVER s AS g, count(*) OVER s AS k FROM p WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
        s AS (SELECT DISTINCT doc_id, g FROM g WHERE k = least(5, n)),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT a, b FROM x JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 5 * x.n >= 4 * (ca.n + cb.n - x.n)),
        t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
        SELECT d.doc_id, least(d.doc_id, coalesce(m.m, d.doc_id)) AS class_id, coalesce(l.n, 0)::BIGINT AS n_links FROM d
        LEFT JOIN (SELECT a, min(b) AS m FROM t GROUP BY a) m ON m.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = d.doc_id""",
    "op9_near_vectors": r"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        s AS (SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
        e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
        t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
        r AS (SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.m, vec_id)) AS component_id FROM v LEFT JOIN (SELECT a, min(b) AS m FROM t GROUP BY a) m ON m.a = vec_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = vec_id)
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM r""",
    "op4_quality_rules": rf"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
        p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w),
        t AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
        c AS (SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM t WHERE n > 1) GROUP BY r),
        f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
                len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines FROM w LEFT JOIN c USING (r)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 15 AND n_symbols / greatest(n_words, 1) <= 0.1
                AND n_stop_words / greatest(n_words, 1) >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept, n_stop_words, n_lines
        FROM b""",
    "op8_url_filters": r"""
        WITH r AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://((?s:.*))$', 1) AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        rules(verdict, h, pp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        best AS (SELECT host, path, arg_max(h || pp, length(h || pp)) AS rule, arg_max(verdict, length(h || pp)) AS verdict
            FROM (SELECT DISTINCT host, path FROM p), rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pp) GROUP BY host, path)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (host, path)""",
}
