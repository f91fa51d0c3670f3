"""Mixing sources to target weights by soft membership.

A classifier trained on a labelled table gives each document a posterior over
domains.  Document rates, none negative, are fitted so that the expected tokens
of each domain (rate times tokens times posterior, summed) match the targets:
weighted least squares, solved by accelerated projected gradients from rates of 1.
A document's rate depends only on its posterior and the sequence of domain
residuals, so an iteration is one aggregate over the corpus and a few numbers on
the driver.  Once expected totals match, the same steps go on with the totals of
whole copies, so that what rounding adds or takes is corrected as well.  Tokens are
words, unless a column holds their number.
"""

from __future__ import annotations

import collections
import json
import math
import warnings
import zlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, written
from .quality import let, words_of
from .secrets import _literal

#: Labelled rows on which the classifier is fitted, in expectation; they bound the number of its features.
SAMPLE_LABELS = 8000
#: Least lift and chi-square of a feature in its domain, and what stands for having no feature.
LIFT, CHI, NONE = 2.0, 25.0, " none"
#: Features of a whole text besides its words, with a space so that no word equals them; t is the text, w its words, d the distinct ones.
MARKS = [
    (" symbols", "length(t) - length(translate(t, '#*$%&|<>!', '')) > 0.1 * size(w)"),
    (" capitals", "2 * length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) < length(t)"),
    (" repeats", "size(w) > 50 and 5 * size(d) < size(w)"),
    (" short", "size(w) < 50"),
]
#: Greatest share of its target by which a domain may miss it (of the total where the target is 0), in expectation and in whole copies.
TOLERANCE, COPIES_TOLERANCE = 0.001, 0.005
#: Iterations without a residual smaller by a twentieth after which no more is tried, and the most of all, for each of the two.
PATIENCE, ITERATIONS = 6, 100
#: Where text should stay as it is, a rate this near a whole number is that number.
WHOLE = 0.1


def features(text: str) -> str:
    """SQL for the distinct words of a text and the marks that apply to it, with the number of its words."""
    marks = "filter(array(" + ", ".join(f"if({test}, '{name}', '')" for name, test in MARKS) + "), x -> x <> '')"
    told = f"named_struct('n_tokens', cast(size(w) as bigint), 'seen', concat(d, {marks}))"
    return let(text, "t", let(words_of("t"), "w", let("array_distinct(w)", "d", told)))


@dataclass(frozen=True)
class DomainModel:
    """Log prior of each domain, and for each feature its log ratio of frequency in the domain to that overall.

    With densities also, for each domain, the log share of its labelled words that
    each feature makes up, and the share of all features together.
    """

    domains: list[str]
    words: list[str]
    bias: list[float]
    weights: list[list[float]]
    densities: list[list[float]] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)

    def posterior(self, words: str) -> str:
        """SQL for the posterior, an array in the order of ``domains``, given an array of features."""
        found, order = self._places(words)
        none = order.index(self.words.index(NONE))
        return let(let(found, "f", f"if(size(f) > 0, f, array({none}))"), "i", self._soft(self.weights, order))

    def thin(self, text: str, domain: str) -> str:
        """SQL for whether a text's words speak less against ``domain`` than so long a text's would.

        Words are taken as Poisson counts, so one that is a feature says the less the
        longer the text without others is.  Never so for a text with a mark, which is
        a share of the whole text already, or without features.
        """
        found, order = self._places("w")
        tests = [test for name, test in MARKS if name in self.words]
        marked = "(" + " or ".join([*tests, "false"]) + ")"
        less = [f" - size(w) * {x!r}D" for x in self.spread]
        likely = let(self._soft(self.densities, order, less), "q", f"get(q, {self.domains.index(domain)}) >= 0.5")
        told = let(found, "i", f"if(size(i) = 0 or {marked}, false, {likely})")
        return let(text, "t", let(words_of("t"), "w", let("array_distinct(w)", "d", told)))

    def _soft(self, numbers: list[list[float]], order: list[int], more: list[str] | None = None) -> str:
        """SQL for the domains' chances from the numbers of the features at the places ``i``."""
        rows = [f"from_json('{json.dumps([row[j] for j in order])}', 'array<double>')" for row in numbers]
        more = more or [""] * len(rows)
        scores = "array(" + ", ".join(f"{b}D + aggregate(i, 0D, (a, x) -> a + get({r}, x)){m}" for b, r, m in zip(self.bias, rows, more, strict=True)) + ")"
        soft = let("transform(s, x -> exp(x - array_max(s)))", "e", "transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))")
        return let(scores, "s", soft)

    def _places(self, words: str) -> tuple[str, list[int]]:
        """SQL for the places of the features among ``words``, and the order of features that places are in.

        Features are found by slots of their CRC-32, as a list would be searched from its start for each word.
        """
        mask = (1 << (4 * len(self.words)).bit_length()) - 1
        slots = [zlib.crc32(w.encode()) & mask for w in self.words]
        order = sorted(range(len(slots)), key=lambda j: slots[j])
        first: list[int | None] = [None] * (mask + 1)
        for k in reversed(range(len(order))):
            first[slots[order[k]]] = k
        table = f"from_json({_literal(json.dumps([self.words[j] for j in order]))}, 'array<string>')"
        start = f"get(from_json('{json.dumps(first)}', 'array<int>'), cast(crc32(x) & {mask}L as int))"
        most = max(collections.Counter(slots).values())
        place = let(start, "s", let(f"array_position(slice({table}, s + 1, {most}), x)", "p", "if(p > 0, cast(s + p - 1 as int), -1)"))
        return f"filter(transform(filter({words}, x -> {start} is not null), x -> {place}), x -> x >= 0)", order


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: bool = False) -> DomainModel:
    """Fit on about ``SAMPLE_LABELS`` rows of ``labelled(doc_id, domain)``, chosen by a hash of the id.

    Each domain gives every word and mark that is ``LIFT`` times as frequent there as
    overall and whose presence speaks for it (chi-square, more than ``CHI``).
    Labels without a domain, an id or a document are left out; without any label
    the model has no domain.  ``dense`` asks for densities.
    """
    labels = labelled.where("doc_id is not null and domain is not null").select(F.col("doc_id").alias("labelled_id"), "domain")
    n = labels.count()
    sample = written(labels.where(F.expr("(xxhash64(labelled_id, 5L) & 1073741823L) / 1073741824D") * n < SAMPLE_LABELS).coalesce(1))
    texts = docs.select(F.col(id_col).alias("labelled_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = [F.expr(words_of("text")).alias("every")] if dense else []
    rows = texts.join(sample, "labelled_id").select("domain", F.expr(features("text")).getField("seen").alias("w"), *every)
    rows = kept(rows)
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains, total = sorted(sizes), sum(sizes.values())
    if not domains:
        return DomainModel([], [], [], [])
    counts = [F.sum((F.col("domain") == d).cast("long")).alias(f"c{k}") for k, d in enumerate(domains)]
    seen = kept(rows.select("domain", F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *counts))
    telling = F.lit(False)
    for k, d in enumerate(domains):
        expected = F.col("n") * (sizes[d] / total)
        score = F.round(F.pow(F.col(f"c{k}") - expected, 2) / expected, 6)
        telling |= (F.col(f"c{k}") > LIFT * expected) & (score > CHI)
    best = sorted((r.asDict() for r in seen.where(telling).collect()), key=lambda r: r["word"])
    wanted = F.expr(f"from_json({_literal(json.dumps([r['word'] for r in best]))}, 'array<string>')")
    bare = {r["domain"]: r["n"] for r in rows.where(~F.arrays_overlap("w", wanted)).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    best.append({"word": NONE, "n": sum(bare.values()), **{f"c{k}": bare.get(d, 0) for k, d in enumerate(domains)}})
    # That one feature is absent says nothing, as languages and topics differ within a domain; that all are says much.
    weights = [[math.log((r[f"c{k}"] + 0.5) / (sizes[d] + 1.0) * (total + 1.0) / (r["n"] + 0.5)) for r in best] for k, d in enumerate(domains)]
    model = DomainModel(domains, [r["word"] for r in best], [math.log(sizes[d] / total) for d in domains], weights)
    if not dense:
        return model
    lengths = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.sum(F.size("every")).alias("n")).collect()}
    telling_words = seen.where(telling).select("word")
    times = rows.select("domain", F.explode("every").alias("word")).join(F.broadcast(telling_words), "word").groupBy("domain", "word").agg(F.count(F.lit(1)).alias("n"))
    counts_of = {(r["domain"], r["word"]): r["n"] for r in times.collect()}
    densities = [[math.log((counts_of.get((d, w), 0) + 0.5) / (lengths[d] + 1.0)) for w in model.words] for d in domains]
    spread = [sum(counts_of.get((d, w), 0) for w in model.words) / (lengths[d] + 1.0) for d in domains]
    return replace(model, densities=densities, spread=spread)


def soft_members(docs: DataFrame, model: DomainModel, text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """``row`` (the columns of ``docs``), ``n_tokens`` and ``posterior``, read once from the texts."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    posterior = model.posterior("m.seen") if model.domains else "cast(array() as array<double>)"
    tokens = "m.n_tokens" if tokens_col is None else f"cast(coalesce(row.`{tokens_col}`, 0) as bigint)"
    told = packed.withColumn("m", F.expr(let(features(f"coalesce(row.`{text_col}`, '')"), "m", f"named_struct('n_tokens', {tokens}, 'posterior', {posterior})")))
    return told.select("row", "m.n_tokens", "m.posterior")


@dataclass(frozen=True)
class RateFit:
    """Gradient steps, each a momentum and a number for each domain, and what they reach."""

    domains: list[str] = field(default_factory=list)
    steps: list[list[float]] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    expected: list[float] = field(default_factory=list)
    realised: list[float] = field(default_factory=list)

    def miss(self, now: list[float]) -> float:
        """The greatest share by which a domain misses its target."""
        total = sum(self.targets)
        return max((abs(n - t) / (t if t > 0 else total) for n, t in zip(now, self.targets, strict=True)), default=0.0) if total > 0 else 0.0


def fitted_rate(steps: list[list[float]]):
    """The rate of a document after gradient steps, each a momentum and a number for each domain."""
    if not steps:
        return F.lit(1.0)
    taken = f"from_json('{json.dumps(steps)}', 'array<array<double>>')"
    ahead = "s.r + g[0] * (s.r - s.p)"
    down = "aggregate(zip_with(posterior, slice(g, 2, size(g) - 1), (x, y) -> x * y), 0D, (a, x) -> a + x)"
    return F.expr(f"aggregate({taken}, named_struct('p', 1D, 'r', 1D), (s, g) -> named_struct('p', s.r, 'r', greatest(0D, {ahead} - {down})), s -> s.r)")


def _chance(id_col: str):
    """A number below 1 that a row's id gives it, for rounding."""
    return F.expr(f"(xxhash64(row.`{id_col}`, 9L) & 1073741823L) / 1073741824D")


def fit_rates(members: DataFrame, model: DomainModel, shares: dict[str, float], anchor: str | None = None, id_col: str = "doc_id") -> RateFit:
    """Gradient steps whose rates bring each domain's expected tokens, and then those of whole copies, to its target.

    Targets are ``shares`` (scaled to sum to 1; domains not named get none) of the
    present total or, with ``anchor``, of the total that leaves the anchor's tokens
    as they are.  A domain without tokens cannot be raised.  The fit ends when the
    targets are met or the residual has hardly fallen for ``PATIENCE`` steps; the best
    steps and their totals are returned, with a warning where a target is missed.
    """
    k = range(len(model.domains))
    if not k:
        return RateFit()

    def totals(weight) -> list[float]:
        row = members.agg(*(F.sum(weight * F.col("n_tokens") * F.col("posterior")[i]).alias(f"t{i}") for i in k)).first()
        return [x or 0.0 for x in row]

    def copies(steps: list[list[float]]) -> list[float]:
        return totals(F.floor(fitted_rate(steps) + _chance(id_col)))

    mass = totals(F.lit(1.0))
    total, share = sum(mass), [shares.get(d, 0.0) / sum(shares.values()) for d in model.domains]
    budget = total
    if anchor in model.domains and share[model.domains.index(anchor)] > 0:
        budget = mass[model.domains.index(anchor)] / share[model.domains.index(anchor)]
    fit = RateFit(model.domains, [], [s * budget for s in share], mass, mass)
    if total <= 0:
        return fit

    def pull(now: list[float], damped: float) -> list[float]:
        # In the metric that weighs documents by tokens and domains by their mass the curvature is 1 at most: a step of 1.
        return [damped * (now[i] - fit.targets[i]) / mass[i] if mass[i] > 0 else 0.0 for i in k]

    def descend(start: list[list[float]], reached, tolerance: float, momentum: bool, damped: float) -> tuple[list[list[float]], list[float]]:
        steps, now = start, reached(start)
        best, best_now, since, speed, last = steps, now, 0, 1, fit.miss(now)
        for _ in range(ITERATIONS):
            if fit.miss(best_now) <= tolerance or since >= PATIENCE:
                break
            b = (speed - 1) / (speed + 2) if momentum else 0.0
            # The gradient belongs to the point that momentum leads to, which is a step without pull.
            at = reached([*steps, [b, *(0.0 for _ in k)]]) if b else now
            steps = [*steps, [b, *pull(at, damped)]]
            now = reached(steps)
            speed = speed + 1 if fit.miss(now) <= last else 1
            last = fit.miss(now)
            since = 0 if last < 0.95 * fit.miss(best_now) else since + 1
            best, best_now = (steps, now) if last < fit.miss(best_now) else (best, best_now)
        return best, best_now

    steps, expected = descend([], lambda s: totals(fitted_rate(s)), TOLERANCE, True, 1.0)
    # Copies change by steps of whole documents, so these go on more slowly.
    steps, realised = descend(steps, copies, COPIES_TOLERANCE, False, 0.5)
    fit = replace(fit, steps=steps, expected=totals(fitted_rate(steps)), realised=realised)
    if fit.miss(realised) > COPIES_TOLERANCE:
        off = ", ".join(f"{d} {n:.0f} of {t:.0f}" for d, n, t in zip(fit.domains, realised, fit.targets, strict=True))
        warnings.warn(f"rates miss a target by {fit.miss(realised):.2%}: {off}", stacklevel=2)
    return fit


def rated(
    docs: DataFrame, model: DomainModel, shares: dict[str, float], anchor: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, tokens_col: str | None = None
) -> DataFrame:
    """``row``, ``n_tokens``, ``posterior``, ``rate``, ``copies`` and ``miss`` of every row.

    ``row`` holds the columns ``keep`` (all by default).  ``copies`` is the rate
    rounded up or down by a hash of the id; ``miss`` is the greatest share by which
    the copies of all rows miss a domain's target, the same in each row.  A null or
    empty text has no tokens and the posterior of a text without known words.  Null
    ids and repeated rows are rated like any other; without rows or labels rates are 1.
    """
    columns = docs.columns if keep is None else keep
    members = soft_members(docs, model, text_col, tokens_col)
    members = written(members.withColumn("row", F.struct(*(F.col(f"row.`{c}`").alias(c) for c in columns))))
    fit = fit_rates(members, model, shares, anchor, id_col)
    told = members.withColumn("rate", fitted_rate(fit.steps))
    return told.withColumn("copies", F.floor(F.col("rate") + _chance(id_col)).cast("long")).withColumn("miss", F.lit(fit.miss(fit.realised)))


def whole_copies(model: DomainModel, anchor: str, text_col: str = "text"):
    """The copies of a rated row, or its rate as a whole number where it is within ``WHOLE`` of one.

    A row that would be lowered although its text is ``thin`` in evidence against
    ``anchor`` is one copy.
    """
    thin = F.expr(model.thin(f"coalesce(row.`{text_col}`, '')", anchor)) if anchor in model.domains else F.lit(False)
    spared = F.when(F.col("rate") < 1 - WHOLE, thin).otherwise(False)
    return F.when(spared, F.lit(1).cast("long")).when(F.abs(F.col("rate") - F.round("rate")) <= WHOLE, F.round("rate").cast("long")).otherwise(F.col("copies"))


def domain_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labelled table: toxic, low (quality) or clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", domain.alias("domain"))
