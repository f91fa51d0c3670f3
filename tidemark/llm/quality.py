"""Quality rules: a threshold table compiled into one projection.

Every figure is a built-in expression over one text's own words and lines, so
the plan is a scan and a projection, with no shuffle and no user function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in is that it for on with as was by at be this are from or an a "
    "der die das und ist den von zu mit auf für ein eine im nicht "
    "le la les de et un une est en que pour dans des du qui "
    "el los las y es por con una del se"
).split()

#: Least words of a text, and the greatest share of its words in repeated three-word windows.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: The method's thresholds: a ratio and the bounds between which a text is kept.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("word_chars / n_words", 2.0, 15.0),
    ("n_symbols / n_words", None, 0.1),
    ("n_stop_words / n_words", 0.02, None),
    ("n_dup_lines / n_lines", None, 0.5),
]


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_of(text: str) -> str:
    """SQL for the words of a text."""
    return f"filter(split({text}, '[{SPACE_CLASS.replace(chr(92), chr(92) * 2)}]+', -1), w -> w <> '')"


def repeated_words(words: str) -> str:
    """SQL for how many of ``words`` lie in a three-word window that occurs twice or more.

    Windows are sorted by hash with their places; those equal to a neighbour are
    repeated, and each covers up to three words until the next one starts.
    """
    windows = f"transform(slice({words}, 1, greatest(size({words}) - 2, 0)), (x, i) -> struct(xxhash64(x, get({words}, i + 1), get({words}, i + 2)) as h, i as p))"
    twice = "filter(s, (x, i) -> x.h <=> get(s, i - 1).h or x.h <=> get(s, i + 1).h)"
    covered = "aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0, (a, x) -> a + x)"
    return let(f"sort_array({windows})", "s", let(f"sort_array(transform({twice}, x -> x.p))", "p", covered))


def _judged(docs: DataFrame, thresholds, stop_words, text_col: str) -> DataFrame:
    """``row`` (the columns of ``docs``) with the figures and the verdict of its text."""
    text = f"coalesce(row.`{text_col}`, '')"
    spaces = " \\t\\n\\u000b\\u000c\\r"
    stops = ", ".join("'" + w.replace("'", "\\'") + "'" for w in stop_words)
    lines = f"filter(split({text}, '\\n', -1), l -> translate(l, '{spaces}', '') <> '')"
    by_word = let(
        words_of(text), "w", f"struct(size(w) as n_words, {repeated_words('w')} as n_repeat_words, size(filter(w, x -> x in ({stops}))) as n_stop_words)"
    )
    by_line = let(lines, "l", "struct(size(l) as n_lines, size(array_distinct(l)) as n_distinct)")
    figures = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select(
        "row",
        F.expr(by_word).alias("by_word"),
        F.expr(by_line).alias("by_line"),
        F.expr(f"length(translate({text}, '{spaces}', ''))").alias("word_chars"),
        F.expr(f"length({text}) - length(translate({text}, '#*$%&|<>', ''))").alias("n_symbols"),
    )
    figures = figures.select(
        "row",
        *(F.col(c).cast("long").alias(n) for n, c in (
            ("n_words", "by_word.n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_repeat_words", "by_word.n_repeat_words"),
            ("n_stop_words", "by_word.n_stop_words"), ("n_lines", "by_line.n_lines"),
        )),
        (F.col("by_line.n_lines") - F.col("by_line.n_distinct")).cast("long").alias("n_dup_lines"),
    )
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words")
    passes = F.lit(True)
    for ratio, low, high in thresholds:
        top, bottom = ratio.split(" / ")
        share = F.col(top) / F.greatest(F.col(bottom), F.lit(1))
        if low is not None:
            passes = passes & (share >= low)
        if high is not None:
            passes = passes & (share <= high)
    return figures.withColumn("base_failed", failed).withColumn("kept", ~failed & passes)


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, stop_words=STOP_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures and verdict of every row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    ``n_stop_words`` and ``n_lines`` (lines with a word) follow.  A null or empty
    text has no words and fails.  Windows of three words are compared by a
    64-bit hash within one text.  Repeated rows and null ids give a row each;
    other columns are ignored; no rows give no rows.
    """
    judged = _judged(docs.select(id_col, text_col), thresholds, stop_words, text_col)
    return judged.select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")


def passing(docs: DataFrame, thresholds=THRESHOLDS, stop_words=STOP_WORDS, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text passes the rules; null texts do not."""
    return _judged(docs, thresholds, stop_words, text_col).where("kept").select("row.*")
