"""Language identification of mixed texts.

Each word is scored under character n-gram models of the languages learned.  Its
script, told from code point ranges, first narrows the candidates to the languages
that use it.  The Viterbi path over a text's words, with a penalty for switching,
labels spans of one language; the language with most words is the text's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import byte_balanced

#: First code point of each range and its script; letters elsewhere have script 0.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x30000, "other"),
]
_NAMES = sorted({name for _, name in SCRIPTS})
#: Documents of each language on whose whole texts the model is fitted, in expectation.
SAMPLE_PER_LANGUAGE = 1500
#: Hashed n-grams, smoothing, log-probability lost by a switch, score of a language that a script excludes.
BUCKETS, SMOOTHING, SWITCH, EXCLUDED = 1 << 15, 0.5, 8.0, -60.0
#: Words that a task remembers, and words on which it runs one pass.
MEMO_WORDS, PASS_WORDS = 200_000, 2_000_000


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


class Grams:
    """N-grams of one to three characters of padded words, as arrays."""

    def __init__(self) -> None:
        self.starts = np.asarray([s for s, _ in SCRIPTS], np.uint32)
        self.names = np.asarray([_NAMES.index(n) for _, n in SCRIPTS])

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, the word of each, each word's script, and its number of letters."""
        letters = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in map(str.lower, words)]
        counts = np.asarray([len(x) for x in letters], np.int64)
        codes = np.frombuffer("".join(f"\x01{x}\x02" for x in letters).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        of = np.repeat(np.arange(len(words)), counts + 2)
        first = np.cumsum(counts + 2) - (counts + 2)
        script = self.names[np.searchsorted(self.starts, codes[np.minimum(first + 1, len(codes) - 1)].astype(np.uint32), "right") - 1]
        buckets, owners = [], []
        value = np.zeros(len(codes), np.uint64)
        for n in (1, 2, 3):
            m = len(codes) - n + 1
            if m <= 0:
                break
            value = value[:m] * np.uint64(0x9E3779B97F4A7C15) + (codes[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
            same = of[:m] == of[n - 1 :]
            mixed = value[same]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(of[:m][same])
        buckets, owners = np.concatenate(buckets), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return buckets[order], owners[order], script, counts


class LanguageModel:
    """Log-probabilities of n-grams and the scripts of each language."""

    def __init__(self, languages: list[str], log_p: np.ndarray, uses: np.ndarray) -> None:
        self.languages, self.log_p, self.uses = languages, log_p, uses

    @classmethod
    def fitted(cls, languages: list[str], grams: np.ndarray, scripts: np.ndarray) -> LanguageModel:
        """From the counts of n-grams and of letters by script, a row for each language."""
        log_p = np.log((grams + SMOOTHING) / (grams.sum(1, keepdims=True) + SMOOTHING * BUCKETS))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        return cls(languages, log_p.T.astype(np.float32), (share >= 0.01).T)

    def scores(self, words: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word under each language, relative to the best, and whether it has a letter."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        buckets, owners, script, letters = grams.of(words)
        out += np.add.reduceat(self.log_p[buckets], np.searchsorted(owners, np.arange(len(words))), axis=0)
        allowed = self.uses[script]
        out[~allowed & allowed.any(1, keepdims=True)] += EXCLUDED
        out -= out.max(1, keepdims=True)
        out[letters == 0] = 0
        return out, letters > 0


def best_paths(table: np.ndarray, words: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The Viterbi label of each word of many texts at once.

    ``words`` index the score table; text ``i`` has ``words[bounds[i]:bounds[i + 1]]``.
    """
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    begin, length = bounds[:-1][order], length[order]
    top = int(length[0]) if len(length) else 0
    kind = np.uint8 if table.shape[1] <= 256 else np.uint16
    if not top:
        return np.zeros(0, kind)
    active = np.searchsorted(-length, -np.arange(top), "left")  # texts longer than t
    labels = np.zeros(len(words), kind)
    back = np.zeros((len(words), table.shape[1]), kind)
    own = np.arange(table.shape[1], dtype=kind)
    value = np.zeros((len(order), table.shape[1]), np.float32)
    for t in range(top):
        n = int(active[t])
        at = begin[:n] + t
        v = value[:n]
        if t:
            best = v.argmax(1)
            jump = v[np.arange(n), best][:, None] - np.float32(switch)
            stay = v >= jump
            back[at] = np.where(stay, own[None, :], best[:, None])
            v = np.where(stay, v, jump)
        v = v + table[words[at]]
        value[:n] = v - v.max(1, keepdims=True)
    state = value.argmax(1)
    for t in range(top - 1, -1, -1):
        n = int(active[t])
        at = begin[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on documents that are not held out and have a text and a language.

    Each language gives about ``SAMPLE_PER_LANGUAGE`` documents, chosen by a hash of
    their id; what reaches the driver is one count for each language and bucket.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held"))
    rows = rows.where("id is not null and text is not null and lang is not null and not held").select("id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chance = F.expr("(xxhash64(id, 11L) & 1073741823L) / 1073741824D")
    sample = rows.join(written(sizes), "lang").where(chance * F.col("n") < SAMPLE_PER_LANGUAGE).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.split())
            for lang, seen in words.items():
                if not seen:
                    continue
                weight = np.asarray(list(seen.values()), np.float64)
                buckets, owners, script, letters = grams.of(list(seen))
                weight[letters == 0] = 0
                total = found.setdefault(lang, np.zeros(BUCKETS + len(_NAMES)))
                total[:BUCKETS] += np.bincount(buckets, weight[owners], BUCKETS)
                total[BUCKETS:] += np.bincount(script, weight * letters, len(_NAMES))
        for lang, total in found.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(total[some])], names=["lang", "slot", "n"])

    counts = sample.mapInArrow(run, "lang string, slot long, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    table = np.zeros((len(languages), BUCKETS + len(_NAMES)))
    table[[languages.index(x) for x in counts["lang"]], counts["slot"].to_numpy(np.int64)] = counts["n"]
    return LanguageModel.fitted(languages, table[:, :BUCKETS], table[:, BUCKETS:])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``lang_pred`` has the most of the words with a letter (the smallest of several
    such languages), ``score`` is its share of them.  A text that is null or
    without a letter, or a model without languages, gives ``und`` and 0.  With
    ``spans`` the column ``spans`` lists ``lang:first:end`` over the words, split at
    white space.  Repeated rows and null ids (not held out) give a row each.
    """
    # Plain arrays: 32,768 numbers for each language.
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.uses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, grams = LanguageModel(*shared.value), Grams()
        languages = len(model.languages)
        memo: dict[str, int] = {}
        table, lettered, size = np.zeros((1024, max(languages, 1)), np.float32), np.zeros(1024, bool), 0
        waiting: list[tuple] = []
        held: list[np.ndarray] = []
        count = 0

        def learn(chunks: list[str]) -> None:
            nonlocal table, lettered, size
            scores, letters = model.scores(chunks, grams)
            while size + len(chunks) > len(table):
                table, lettered = np.concatenate([table, np.zeros_like(table)]), np.concatenate([lettered, np.zeros_like(lettered)])
            table[size : size + len(chunks)], lettered[size : size + len(chunks)] = scores, letters
            memo.update(zip(chunks, range(size, size + len(chunks)), strict=True))
            size += len(chunks)

        def flush() -> pa.RecordBatch:
            nonlocal waiting, held, count, memo, size
            words = np.concatenate(held) if held else np.zeros(0, np.int64)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            n = len(waiting)
            pred, score, found = ["und"] * n, np.zeros(n), [""] * n
            if languages and len(words):
                labels = best_paths(table, words, bounds)
                of = np.repeat(np.arange(n), np.diff(bounds))
                good = lettered[words]
                votes = np.bincount(of[good] * languages + labels[good], minlength=n * languages).reshape(n, languages)
                total = votes.sum(1)
                best = votes.argmax(1)
                score = np.where(total > 0, votes[np.arange(n), best] / np.maximum(total, 1), 0.0)
                pred = [model.languages[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
                if spans:
                    for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                        own = labels[lo:hi]
                        cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]).tolist() if len(own) else []
                        found[i] = ",".join(f"{model.languages[own[a]]}:{a}:{b}" for a, b in zip(cuts[:-1], cuts[1:], strict=True)) if total[i] else ""
            out = pa.RecordBatch.from_arrays([pa.array([w[0] for w in waiting], pa.int64()), pa.array([w[1] for w in waiting], pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "spans"])
            waiting, held, count = [], [], 0
            if len(memo) > MEMO_WORDS:
                memo, size = {}, 0
            return out

        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for texts in byte_balanced(batch.column(2).to_pylist()):
                split = [text.split() if languages else [] for text in texts]
                fresh = [c for c in set().union(*split) if c not in memo]
                for lo in range(0, len(fresh), 16384):
                    learn(fresh[lo : lo + 16384])
                for chunks, name in zip(split, names):  # noqa: B905  the texts of a group end first
                    held.append(np.asarray(list(map(memo.__getitem__, chunks)), np.int64))
                    waiting.append(name)
                    count += len(chunks)
                if count > PASS_WORDS:
                    yield flush()
        if waiting:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans string")
    return told if spans else told.drop("spans")
