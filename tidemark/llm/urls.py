"""URL rules: allow and block lists matched by host suffix and path prefix.

A URL expands into (host suffix, path prefix) expressions, no more labels and
path levels than the deepest rule has.  Expressions meet rules by an equi-join
on a short hash prefix; the full digest then confirms the match, the rest of the
rule's path is compared, and the longest fitting rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest on which expressions and rules are joined.
PREFIX_DIGITS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """The host and the path of a URL column, both empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``rules(verdict, host, path)``: a rule fits its host and all subdomains when
    the URL's path starts with the rule's.  The longest fitting rule (host and
    path together) wins, then the one with the longer path, then block before
    allow; without one ``rule`` is null and ``verdict`` is ``default``.  Each distinct (host, path)
    is judged once, so a hot URL costs one judgement and a join.  Null ids and
    repeated rows give a row each; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    # A rule is keyed by its path up to the last slash, which is where URLs are cut.
    stem = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0)
    keyed = rules.where("host is not null and path is not null").select(
        F.col("verdict").alias("rule_verdict"), F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path")
    )
    keyed = keyed.withColumn("rule_digest", F.sha2(F.concat("rule_host", F.lit("\n"), stem), 256)).withColumn("key", F.substring("rule_digest", 1, PREFIX_DIGITS))
    deepest = rules.agg(F.max(F.size(F.split("host", "[.]"))), F.max(F.size(F.split("path", "/")))).first()
    labels, levels = (x or 0 for x in deepest)

    distinct = rows.distinct()
    suffixes = F.expr(
        f"transform(sequence(1, least(size(split(host, '[.]', -1)), {max(labels, 1)})), k -> substring_index(host, '.', -k))"
    )
    # Prefixes that end at the 1st, 2nd, ... slash, and the empty one for rules without a slash.
    prefixes = F.expr(
        f"concat(array(''), transform(filter(sequence(1, {max(levels, 1)}), k -> k < size(split(path, '/', -1))), k -> concat(substring_index(path, '/', k), '/')))"
    )
    spread = distinct.withColumn("suffix", F.explode(F.array_distinct(suffixes))).withColumn("prefix", F.explode(F.array_distinct(prefixes)))
    spread = spread.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)).withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    fitting = spread.join(keyed, "key").where(F.col("digest") == F.col("rule_digest")).where(F.expr("startswith(path, rule_path)"))
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_path"), (F.col("rule_verdict") == "block").cast("int"), "rule_host")
    best = fitting.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), order).alias("best"))
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
