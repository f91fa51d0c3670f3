"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained on labelled samples.  A run of token characters whose
mean log-likelihood ratio per character pair is high reads as random; how high is
fitted on strings that were held out of the training.  Scanning
is one projection of built-in expressions; a text is split by a pattern, and the
lengths of what lies between the matches give their places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality import let

#: Kind, pattern, group whose length counts, least length; in the order in which kinds are listed.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: Runs that the models judge, their least length, their kind, and a secret's least number of different characters.
MIN_RUN, KIND, MIN_DIFFERENT = 16, "markov", 8
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}"
#: The usual least mean log ratio of a secret; the greatest share of ordinary strings that may reach the fitted one, the
#: share of random ones that has to, its steps in a unit, and of how many strings one is held out.
MIN_RATIO, FALSE_SHARE, RECALL, STEPS, HELD_OUT = 2.0, 0.001, 0.99, 20, 4
#: Documents whose tokens are labelled ordinary or, inside base spans, random; and generated random strings.
SAMPLE_DOCS, GENERATED = 2000, 2000
CODES = 128
#: What a character alone counts for beside the pairs seen after another.
BACKING = 5.0


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str) -> str:
    """SQL for the running sums of an array, in stretches so that long arrays cost little."""
    fold = "aggregate({}, named_struct('s', 0L, 'o', cast(array() as array<bigint>)), (a, x) -> named_struct('s', a.s + x, 'o', concat(a.o, array(a.s + x))), a -> a.o)"
    parts = "transform(slice(sequence(0, size(v) div 256), 1, (size(v) + 255) div 256), k -> slice(v, k * 256 + 1, 256))"
    totals = fold.format("transform(c, y -> aggregate(y, 0L, (a, x) -> a + x))")
    each = "flatten(transform(c, (y, k) -> transform(" + fold.format("y") + ", z -> z + coalesce(get(t, k - 1), 0L))))"
    return let(values, "v", let(parts, "c", let(totals, "t", each)))


def matches(text: str, pattern: str, group: int = 0, least: int = 1) -> str:
    """SQL for the matches of a pattern as structs of start, end and value, leftmost and non-overlapping.

    Matches whose group is shorter than ``least`` are dropped after matching.
    """
    p = _literal(pattern)
    ends = running("zip_with(slice(g, 1, size(h)), h, (a, b) -> cast(length(a) + length(b) as bigint))")
    value = "get(q, i)" if group else "get(h, i)"
    found = f"transform({ends}, (e, i) -> named_struct('s', e - length(get(h, i)), 'e', e, 'v', {value}))"
    if group:
        found = let(f"regexp_extract_all({text}, {p}, {group})", "q", found)
    found = let(f"split({text}, {p}, -1)", "g", let(f"regexp_extract_all({text}, {p}, 0)", "h", found))
    return f"case when {text} rlike {p} then filter({found}, x -> length(x.v) >= {least}) else cast(array() as array<struct<s:bigint,e:bigint,v:string>>) end"


@dataclass(frozen=True)
class MarkovRatio:
    """Log ratios of character pairs, random against ordinary, at ``128 * first + second``.

    ``least`` is the mean ratio from which on a run is a secret; ``held_out`` has the
    random strings held out, those of them that reach it, and the same of ordinary ones.
    """

    ratios: tuple[float, ...]
    least: float = MIN_RATIO
    held_out: tuple[int, int, int, int] = (0, 0, 0, 0)

    @property
    def recall(self) -> float:
        """The share of held-out random strings that are found."""
        return self.held_out[1] / self.held_out[0] if self.held_out[0] else 0.0

    @property
    def false_share(self) -> float:
        """The share of held-out ordinary strings that are taken for random ones."""
        return self.held_out[3] / self.held_out[2] if self.held_out[2] else 0.0

    def column(self, run: str) -> str:
        """SQL for the mean log ratio of a run of ASCII characters."""
        table = "from_json('[" + ",".join(f"{x:.5f}" for x in self.ratios) + "]', 'array<double>')"
        pair = f"get({table}, ascii(substr(r, i, 1)) * {CODES} + ascii(substr(r, i + 1, 1)))"
        return let(run, "r", f"aggregate(sequence(1, length(r) - 1), 0D, (a, i) -> a + {pair}) / (length(r) - 1)")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> MarkovRatio:
    """Fit both models on at most ``SAMPLE_DOCS`` documents (those of least id hash) and generated strings.

    Random: values of the base patterns, and encoded digests of counters.
    Ordinary: the other token runs of four and more characters, and identifiers
    made of the words among them (``WordWord``, ``word_word``, ``word-word``).  Each
    distinct string counts once, and in it each pair of characters once.  One string
    in ``HELD_OUT``, by its hash, is held out.  The threshold is ``MIN_RATIO``, or less if
    fewer than ``RECALL`` of the random ones held out reach it, or more if more than
    ``FALSE_SHARE`` of the ordinary ones do.  Without documents the generated strings
    still train.
    """
    spark = docs.sparkSession
    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("chosen")).orderBy(F.xxhash64("chosen"), "chosen").limit(SAMPLE_DOCS).distinct()
    chosen = written(chosen)
    texts = docs.join(chosen, docs[id_col] == chosen["chosen"], "left_semi").select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = "concat(" + ", ".join(f"transform({matches('t', p, g, n)}, x -> x.v)" for _, p, g, n in BASE) + ")"
    plain = "t"
    for _, p, _, _ in BASE[:2]:
        plain = f"regexp_replace({plain}, {_literal(p)}, ' ')"
    random = texts.select(F.explode(F.expr(base)).alias("s"), F.lit(1).alias("random"))
    ordinary = texts.select(F.explode(F.expr(f"filter(regexp_extract_all({plain}, '[A-Za-z0-9+/_=-]{{4,}}', 0), x -> not x rlike '^[0-9a-f]{{24,}}$')")).alias("s"), F.lit(0).alias("random"))
    word = "s rlike '^[A-Za-z]+$'"
    joined = "array(s, if({0}, concat(initcap(s), initcap(s)), s), if({0}, concat(s, '_', s), s), if({0}, concat(s, '-', s), s))".format(word)
    ordinary = ordinary.distinct().select(F.explode(F.expr(joined)).alias("s"), "random")
    digest = "sha2(cast(id as string), 256)"
    made = spark.range(GENERATED).selectExpr(f"explode(array({digest}, substr({digest}, 1, 18), base64(unhex({digest})), upper(substr(replace(base64(unhex({digest})), '/', ''), 1, 20)))) as s", "1 as random")
    strings = written(random.union(ordinary).union(made).distinct().where("length(s) > 1").withColumn("held", F.expr(f"pmod(xxhash64(s, 3L), {HELD_OUT}) = 0")))
    pairs = strings.where("not held").select("random", F.explode(F.expr("array_distinct(transform(sequence(1, length(s) - 1), i -> substr(s, i, 2)))")).alias("p")).selectExpr("random", "ascii(p) as a", "ascii(substr(p, 2, 1)) as b")
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.where(f"a < {CODES} and b < {CODES}").groupBy("random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = sorted({c for k in counts for c in k[1:]})
    after = {(k, a): sum(counts.get((k, a, b), 0) for b in used) for k in (0, 1) for a in used}
    alone = {(k, b): sum(counts.get((k, a, b), 0) for a in used) for k in (0, 1) for b in used}
    total = {k: sum(after[k, a] for a in used) for k in (0, 1)}

    def log_p(k: int, a: int, b: int) -> float:
        # A pair is backed by how common its second character is, so one that a model hardly knows stays unlikely.
        single = (alone[k, b] + 0.5) / (total[k] + 0.5 * len(used))
        return math.log((counts.get((k, a, b), 0) + BACKING * single) / (after[k, a] + BACKING))

    model = MarkovRatio(tuple(log_p(1, a, b) - log_p(0, a, b) if a in used and b in used else 0.0 for a in range(CODES) for b in range(CODES)))
    judged = strings.where(f"held and length(s) >= {MIN_RUN} and s rlike '^{RUN}$' and size(array_distinct(split(s, ''))) >= {MIN_DIFFERENT}")
    step = F.floor(F.expr(model.column("s")) * STEPS).cast("int")
    found = {(r["random"], r["step"]): r["n"] for r in judged.select("random", step.alias("step")).groupBy("random", "step").agg(F.count(F.lit(1)).alias("n")).collect()}
    return fitted(model, found)


def fitted(model: MarkovRatio, found: dict[tuple[int, int], int]) -> MarkovRatio:
    """The model with its threshold, given how many held-out strings of each kind have a ratio in each step."""
    of = [{step: n for (kind, step), n in found.items() if kind == k} for k in (0, 1)]
    total = [sum(x.values()) for x in of]
    if not all(total):
        return model
    reach = lambda k, least: sum(n for step, n in of[k].items() if step >= least)
    # The usual ratio; lower where too few random strings reach it, and higher where too many ordinary ones do.
    steps = range(min(*of[0], *of[1]), max(*of[0], *of[1]) + 2)
    least = min(round(MIN_RATIO * STEPS), max(s for s in steps if reach(1, s) >= RECALL * total[1]))
    least = max(least, next(s for s in steps if reach(0, s) <= FALSE_SHARE * total[0]))
    return MarkovRatio(model.ratios, least / STEPS, (total[1], reach(1, least), total[0], reach(0, least)))


def spans_of(model: MarkovRatio, text: str) -> str:
    """SQL for a struct of the arrays ``base`` and ``extra``; spans are structs of start, kind's rank, end and kind."""
    span = "transform({m}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'kind', '{name}'))"
    base = "concat(" + ", ".join(span.format(m=matches(text, p, g, n), k=k, name=name) for k, (name, p, g, n) in enumerate(BASE)) + ")"
    runs = f"filter({matches(text, RUN)}, x -> not exists(b, y -> y.s < x.e and x.s < y.e) and size(array_distinct(split(x.v, ''))) >= {MIN_DIFFERENT} and {model.column('x.v')} >= {model.least!r}D)"
    return let(f"sort_array({base})", "b", f"named_struct('base', b, 'extra', {span.format(m=runs, k=len(BASE), name=KIND)})")


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"


def scan(docs: DataFrame, model: MarkovRatio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row, and ``n_markov``.

    A span is a whole match, ``kind:start:end`` in code points with the end
    exclusive; spans are ordered by start and then kind.  Runs that overlap a
    base span or have few different characters are not judged.  A null or empty text has no spans.  Repeated rows
    and null ids give a row each; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select("doc_id", F.expr(spans_of(model, "text")).alias("f"))
    counts = [F.expr(f"cast(size(filter(f.base, x -> x.k = {k})) as bigint)").alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(_listed("f.base")), 256).alias("base_sha256"),
        F.expr(_listed("sort_array(concat(f.base, f.extra))")).alias("spans"),
        F.expr("cast(size(f.extra) as bigint)").alias(f"n_{KIND}"),
    )


def redact(docs: DataFrame, model: MarkovRatio, mark: str = "[REDACTED]", text_col: str = "text") -> DataFrame:
    """The same rows and columns with each span of the text replaced by ``mark``.

    Overlapping spans become one.  Null texts stay null, others are unchanged
    where nothing was found.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("f", F.expr(spans_of(model, f"coalesce(row.`{text_col}`, '')")))
    # What lies between spans: from the greatest end so far to the next start, if that is later.
    fold = (
        "aggregate(sort_array(concat(f.base, f.extra)), named_struct('at', 0L, 'out', cast(array() as array<string>)), (a, x) -> named_struct('at', greatest(a.at, x.e), 'out',"
        f" if(x.s < a.at, a.out, concat(a.out, array(substr(t, cast(a.at + 1 as int), cast(x.s - a.at as int)), {_literal(mark)})))),"
        " a -> concat(array_join(a.out, ''), substr(t, cast(a.at + 1 as int))))"
    )
    clean = F.expr(f"case when size(f.base) + size(f.extra) = 0 then row.`{text_col}` else " + let(f"row.`{text_col}`", "t", fold) + " end")
    return packed.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
