"""Substring dedup by relative Lempel-Ziv parsing.

The reference (all documents) is indexed in blocks.  A document's windows of 13
words are grouped into phrases: runs of windows with the same minimizer, the
least hash of the four-word runs in a window.  Equal windows have equal
minimizers, so the block that owns a minimizer holds every occurrence of all its
windows, and a phrase needs no other block.  A few minimizers may be very
frequent; those with more than 1/65,536 of all phrases, of which there can be no
more than 65,536, are found first, and their windows are dealt one by one.

A block holds the words of its phrases, in order of document, and an index from
each window to its places.  Phrases are parsed greedily: at a place whose window
occurs in a document with a smaller id, the factor is the longest stretch, of 13
words or more, that continues word by word in one such document.  The next factor
may start while 12 words of the last are still to come, so every window across a
boundary between factors is looked up as well, and factors end where phrases end,
each window belonging to exactly one phrase.  Words are compared themselves, not
by hashes of them.

Tasks that read documents parse their own stretch of rows by the same routine
first and send only the windows that no smaller id in the stretch has, so a
passage with very many copies is sent once for each stretch of input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for
from .words import WordHasher, mixed, rolled, sliding_min, spaced_words, stretches, texts_of, words_in

#: Words of the runs whose least hash is a window's minimizer.
ANCHOR_WORDS = 4
#: Windows that a reading task holds before it sends them, and windows of the longest phrase.
HELD_WINDOWS, PHRASE_WINDOWS = 1_500_000, 64
#: Bytes of stored input for which there is one reference block, blocks of one task, and the most blocks.
BLOCK_BYTES, TASK_BLOCKS, MOST_BLOCKS = 2 << 20, 4, 1 << 20
#: The share of all phrases from which on a minimizer is frequent, and the least number of phrases.
FREQUENT_SHARE, FREQUENT_LEAST = 1 / 65536, 4096

_CODEC, LEVEL = "zstd", 6


def _squeezed(data: bytes | pa.Buffer) -> bytes:
    """Compressed bytes, after their number before."""
    return len(data).to_bytes(8, "little") + pa.Codec(_CODEC, LEVEL).compress(data, asbytes=True)


def _restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec=_CODEC, asbytes=True)


def _packed(*arrays: np.ndarray) -> bytes:
    """Ids and small numbers as differences, compressed byte plane by byte plane."""
    each = [np.diff(a.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return _squeezed(b"".join(each))


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_restored(data), np.uint8).reshape(n, 8, -1)
    return np.cumsum(planes.transpose(0, 2, 1).copy().view(np.int64)[:, :, 0], axis=1)


def _stretched(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of ``first[i], first[i] + 1, ...``, ``lengths[i]`` numbers each."""
    ends = np.cumsum(lengths)
    return np.repeat(first - np.concatenate([[0], ends[:-1]]), lengths) + np.arange(ends[-1] if len(ends) else 0)


def window_classes(codes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the distinct windows that start at ``at``: equal exactly where all their words are."""
    if not len(at):
        return np.zeros(0, np.int64)
    salt = 0
    while True:
        prints = rolled(mixed(codes.astype(np.uint64) + np.uint64(salt)), window)[at]
        order = np.argsort(prints, kind="stable")
        ordered = prints[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        heads = at[order[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]]
        if all(np.array_equal(codes[heads + k], codes[at[order] + k]) for k in range(window)):
            break
        salt += 0x9E3779B97F4A7C15 >> 8  # two windows shared a fingerprint
    classes = np.empty(len(at), np.int64)
    classes[order] = np.cumsum(fresh) - 1
    return classes


def longest_matches(classes: np.ndarray, phrases: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the most windows from it on that continue alike in one smaller document, and where.

    Windows of a phrase adjoin.  Ranks of the next 1, 2, 4, ... windows put all
    places in the order of what follows them; of the places with a smaller document
    the nearest on either side in that order agrees longest.
    """
    n = len(classes)
    longest, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    if not n:
        return longest, source
    least, most = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max), np.full(int(classes.max()) + 1, np.iinfo(np.int64).min)
    np.minimum.at(least, classes, docs)
    np.maximum.at(most, classes, docs)
    active = np.flatnonzero((least < most)[classes])
    if not len(active):
        return longest, source
    left = np.append(np.flatnonzero(phrases[1:] != phrases[:-1]) + 1, n)
    left = left[np.searchsorted(left, active, "right")] - active  # windows to the end of the phrase

    def ranked(keys: np.ndarray) -> np.ndarray:
        """Ranks of the active places, and for all others a number that nothing else has."""
        out = np.arange(len(active), len(active) + n, dtype=np.int64)
        out[active] = np.unique(keys, return_inverse=True)[1]
        return out

    ranks, width = [ranked(classes[active])], 1
    while True:
        last = ranks[-1]
        then = np.where(left > width, last[np.minimum(active + width, n - 1)], len(active) + n + np.arange(len(active)))
        ranks.append(ranked(last[active] * (2 * len(active) + n) + then))
        width *= 2
        order = np.argsort(ranks[-1][active], kind="stable")
        ordered, owners = ranks[-1][active][order], docs[active][order]
        if not ((ordered[1:] == ordered[:-1]) & (owners[1:] != owners[:-1])).any():
            break
    places = active[order]
    m = len(places)
    owners = np.concatenate([owners, [np.iinfo(np.int64).min]])  # a smallest document beyond either end
    for way in (-1, 1):
        near = np.arange(m + 1) + way
        near[near < 0] = m
        near[m] = m
        while len(far := np.flatnonzero(owners[near[:m]] >= owners[:m])):
            near[far] = near[near[far]]
        here = np.flatnonzero(near[:m] < m)
        a, b = places[here], places[near[here]]
        same = np.zeros(len(here), np.int64)
        for k in reversed(range(len(ranks))):
            x, y = a + same, b + same
            fits = (x < n) & (y < n)
            fits[fits] = (ranks[k][x[fits]] == ranks[k][y[fits]]) & (phrases[x[fits]] == phrases[a[fits]]) & (phrases[y[fits]] == phrases[b[fits]])
            same += fits.astype(np.int64) << k
        better = same > longest[a]
        longest[a[better]], source[a[better]] = same[better], b[better]
    return longest, source


def greedy_factors(longest: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """Windows at which the factors of a greedy parse start, phrase by phrase."""
    n = len(longest)
    if not n:
        return np.zeros(0, np.int64)
    place = np.flatnonzero(np.concatenate([[True], phrases[1:] != phrases[:-1]]))
    end = np.append(place[1:], n)
    following = np.minimum.accumulate(np.where(longest > 0, np.arange(n), n)[::-1])[::-1]
    following = np.append(following, n)
    out = []
    while True:
        place = following[place]
        on = place < end
        place, end = place[on], end[on]
        if not len(place):
            return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)
        out.append(place)
        place = place + longest[place]


def _spans(docs: np.ndarray, salts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans as rows of document, salt, start and end, with those that touch made one."""
    order = np.lexsort((starts, salts, docs))
    docs, salts, starts, ends = docs[order], salts[order], starts[order], ends[order]
    # Ends grow with starts, as longer factors would have been found at the earlier place; the maximum guards rows that repeat.
    opens = np.concatenate([[True], (docs[1:] != docs[:-1]) | (salts[1:] != salts[:-1]) | (starts[1:] > ends[:-1])])[: len(docs)]
    at = np.flatnonzero(opens)
    return np.stack([docs[at], salts[at], starts[at], np.maximum.reduceat(ends, at) if len(at) else ends])


class _Stretch:
    """Words of the documents of a stretch of rows."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.hashes: list[np.ndarray] = []
        self.ids: list[int] = []
        self.salts: list[int] = []
        self.counts: list[int] = []
        self.seen: set[tuple[int, int]] = set()
        self.n = 0

    def documents(self, window: int) -> tuple:
        """In order of id: word codes, words, hashes, and each word's document; windows' starts."""
        words = pa.concat_arrays(self.words)
        codes = words.dictionary_encode().indices.to_numpy()
        hashes, counts = np.concatenate(self.hashes), np.asarray(self.counts, np.int64)
        ids, salts = np.asarray(self.ids, np.int64), np.asarray(self.salts, np.int64)
        order = np.lexsort((salts, ids))
        if (order[1:] < order[:-1]).any():
            at = _stretched((np.cumsum(counts) - counts)[order], counts[order])
            words, codes, hashes = words.take(pa.array(at)), codes[at], hashes[at]
        of = np.repeat(np.arange(len(order)), counts[order])
        whole = np.flatnonzero(of[: max(0, len(of) - window + 1)] == of[window - 1 :])
        begin = (np.cumsum(counts[order]) - counts[order])[of]
        return words, codes, hashes, ids[order], salts[order], of, begin, whole


def _read(window: int, hold: int, flush):
    """Reads (doc_id, salt, text); calls ``flush`` with stretches of rows without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, turn = WordHasher(), _Stretch(), 0
        for batch in batches:
            ids, salts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            turn = turn or (int(ids[0]) if len(ids) else 0)
            data, bounds = texts_of(batch.column(2))
            for lo, hi in stretches(bounds):
                starts, ends, of = words_in(data, bounds[lo : hi + 1])
                counts = np.bincount(of, minlength=hi - lo)
                # Rows that repeat id and text are one document; short ones have no window.
                known = [c < window or (key in held.seen or held.seen.add(key)) for key, c in zip(zip(ids[lo:hi].tolist(), salts[lo:hi].tolist(), strict=True), counts.tolist(), strict=True)]
                fresh = ~np.asarray(known, bool)
                if not fresh.any():
                    continue
                if not fresh.all():
                    starts, ends = starts[fresh[of]], ends[fresh[of]]
                held.words.append(spaced_words(data, starts, ends))
                held.hashes.append(hasher.hashes(data, starts, ends))
                held.ids += ids[lo:hi][fresh].tolist()
                held.salts += salts[lo:hi][fresh].tolist()
                held.counts += counts[fresh].tolist()
                held.n += len(starts)
                if held.n >= hold:
                    yield from flush(held, turn)
                    held, turn = _Stretch(), turn + 1
        if held.n:
            yield from flush(held, turn)

    return run


def _minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    return sliding_min(rolled(hashes, ANCHOR_WORDS), window - ANCHOR_WORDS + 1)


def _frequent(window: int):
    """Gives (minimizer, n): phrases of a stretch by minimizer, those that may be frequent, and all phrases under null."""

    def flush(held: _Stretch, turn: int) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.concatenate(held.hashes), np.asarray(held.counts)
        of = np.repeat(np.arange(len(counts)), counts)
        whole = np.flatnonzero(of[: max(0, len(of) - window + 1)] == of[window - 1 :])
        least = _minimizers(hashes, window)[whole]
        of = of[whole]
        at = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (least[1:] != least[:-1])])[: len(of)])
        some, n = np.unique(least[at], return_counts=True)
        many = n > max(2, len(at) * FREQUENT_SHARE)
        yield pa.RecordBatch.from_arrays([pa.array([*some[many].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[many].tolist(), len(at)], pa.int64())], names=["minimizer", "n"])

    return flush


def frequent_minimizers(rows: DataFrame, window: int, least: int = FREQUENT_LEAST) -> list[int]:
    """Minimizers that have more than a fixed share of all phrases, hence no more than its inverse.

    Stretches report only what is frequent in them, so a minimizer is missed only
    if its share is below twice the fixed one.
    """
    counts = rows.mapInArrow(_read(window, HELD_WINDOWS, _frequent(window)), "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("n"))
    top = counts.where((F.col("n") > least) | F.col("minimizer").isNull()).orderBy(F.col("n").desc()).limit(1 + round(1 / FREQUENT_SHARE)).collect()
    total = next((r["n"] for r in top if r["minimizer"] is None), 0)
    return sorted(r["minimizer"] for r in top if r["minimizer"] is not None and r["n"] > total * FREQUENT_SHARE)


def _phrases(blocks: int, window: int, frequent: np.ndarray):
    """Gives (block, phrases, words, known): phrases for the blocks, and spans found in the stretch itself."""

    def flush(held: _Stretch, turn: int) -> Iterator[pa.RecordBatch]:
        words, codes, hashes, ids, salts, of, begin, at = held.documents(window)
        held.__init__()
        classes = window_classes(codes, at, window)
        doc, place = of[at], at - begin[at]
        whole = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1])])[: len(doc)])
        longest, _ = longest_matches(classes, whole, ids[doc])
        factors = greedy_factors(longest, whole)
        known = _spans(ids[doc[factors]], salts[doc[factors]], place[factors], place[factors] + longest[factors] - 1 + window)
        # What no smaller id of the stretch has is sent, in phrases.
        least = _minimizers(hashes, window)[at]
        rest = longest == 0
        at, doc, place, least = at[rest], doc[rest], place[rest], least[rest]
        alone = np.isin(least, frequent)
        opens = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (least[1:] != least[:-1])])[: len(at)] | alone
        first = np.flatnonzero(opens)
        run = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        first = np.flatnonzero(opens | (run % PHRASE_WINDOWS == 0))
        length = np.diff(np.append(first, len(at)))
        dealt = np.where(alone[first], rolled(hashes, window)[at[first]], least[first])
        block = (dealt % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        first, length, block = first[order], length[order], block[order]
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])[: len(block)]).tolist() + [len(block)]
        rows: tuple[list, ...] = ([], [], [], [])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            a, n = first[lo:hi], length[lo:hi]
            text = words.take(pa.array(_stretched(at[a], n + window - 1)))
            rows[0].append(int(block[lo]))
            rows[1].append(_packed(ids[doc[a]], salts[doc[a]], place[a], n))
            rows[2].append(_squeezed(text.buffers()[2]))
            rows[3].append(None)
            if sum(map(len, rows[2])) > 4 << 20:
                yield _message(rows)
                rows = ([], [], [], [])
        if known.shape[1]:
            rows[0].append(turn % blocks)
            rows[1].append(None)
            rows[2].append(None)
            rows[3].append(_packed(*known))
        yield _message(rows)

    return flush


def _message(rows: tuple[list, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["block", "phrases", "words", "known"])


class ReferenceBlock:
    """The phrases of one block in order of document, their words and the classes of their windows."""

    def __init__(self, messages: list[tuple[bytes, bytes]], window: int) -> None:
        words = []
        for _, w in messages:
            data = np.frombuffer(_restored(w), np.uint8)
            words.append(spaced_words(data, *words_in(data, np.asarray([0, len(data)]))[:2]))
        codes = pa.concat_arrays(words).dictionary_encode().indices.to_numpy()
        phrases = np.concatenate([_unpacked(p, 4) for p, _ in messages], axis=1)
        start = np.cumsum(phrases[3] + window - 1) - (phrases[3] + window - 1)
        order = np.lexsort(phrases[::-1])
        phrases = phrases[:, order]
        fresh = np.concatenate([[True], (phrases[:, 1:] != phrases[:, :-1]).any(0)])  # a row that repeats is one document
        phrases, start = phrases[:, fresh], start[order][fresh]
        lengths = phrases[3]
        self.docs, self.salts = np.repeat(phrases[0], lengths), np.repeat(phrases[1], lengths)
        self.places, self.phrases = _stretched(phrases[2], lengths), np.repeat(np.arange(len(lengths)), lengths)
        self.classes = window_classes(codes, _stretched(start, lengths), window)

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The factors of all phrases: first window, number of windows, first window of the source."""
        longest, source = longest_matches(self.classes, self.phrases, self.docs)
        at = greedy_factors(longest, self.phrases)
        return at, longest[at], source[at]


def _parsed(window: int):
    """Reads the rows of whole blocks, in order; gives (doc_id, salt, spans)."""

    def parsed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = [_unpacked(k, 4) for _, _, k in rows if k is not None]
        messages = [(p, w) for p, w, _ in rows if p is not None]
        rows.clear()
        if messages:
            block = ReferenceBlock(messages, window)
            at, length, _ = block.factors()
            found.append(_spans(block.docs[at], block.salts[at], block.places[at], block.places[at] + length - 1 + window))
        if not found:
            return
        docs, salts, starts, ends = _spans(*np.concatenate(found, axis=1))
        at = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (salts[1:] != salts[:-1])])[: len(docs)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(docs)).astype(np.int32)), pa.array((starts << 32) | ends))
        yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(salts[at].astype(np.int32)), lists], names=["doc_id", "salt", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and block != now:
                    yield from parsed(rows)
                    rows = []
                now = block
                rows.append(row)
        if rows:
            yield from parsed(rows)

    return run


def duplicate_spans(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", frequent_least: int = FREQUENT_LEAST) -> DataFrame:
    """``(doc_id, salt, spans)``: the word spans, packed as ``start << 32 | end``, that repeat a smaller id's document.

    ``salt`` is Spark's 32-bit hash of the text, so that texts that share an id are
    told apart.  Spans may overlap or touch.  Texts without any have no row.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("salt"), F.col(text_col).alias("text"))
    blocks = min(partitions_for(docs, text_col, BLOCK_BYTES), MOST_BLOCKS)
    frequent = np.asarray(frequent_minimizers(rows, window, frequent_least), np.int64).view(np.uint64)
    sent = rows.mapInArrow(_read(window, HELD_WINDOWS, _phrases(blocks, window, frequent)), "block int, phrases binary, words binary, known binary")
    dealt = sent.repartition(-(-blocks // TASK_BLOCKS), "block").sortWithinPartitions("block")
    found = dealt.mapInArrow(_parsed(window), "doc_id long, salt int, spans array<long>")
    return found.groupBy("doc_id", "salt").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_duplicates(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, frequent_least: int = FREQUENT_LEAST) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row, and the kept words as ``kept`` on request.

    A word goes when a window of ``window`` consecutive words that covers it also
    starts in a document with a smaller id; windows are those of the input.  A null
    or empty text has no words.  A null id has no smaller one and is no source: its
    text stays.  Rows that repeat an id are texts of one document: none is the
    other's source, each is a source for greater ids and each is judged by its own
    words, whatever else the rows hold.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i in range(batch.num_rows):
                words = batch.column(1)[i].as_buffer().to_pybytes().split()
                spans = batch.column(2)[i].values
                n = len(words)
                if spans is not None and len(spans):
                    packed = spans.to_numpy()
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, np.minimum(packed >> 32, n), 1)
                    np.add.at(change, np.minimum(packed & 0xFFFFFFFF, n), -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
                kept = b" ".join(words)
                for column, value in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    # A hash beside the key gives both sides exchanges of their own, so that the rows of a hot key can be split.
    keyed = lambda df: df.withColumn("key_hash", F.xxhash64("doc_id", "salt"))
    spans = keyed(duplicate_spans(docs, window, id_col, text_col, frequent_least))
    rows = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text_col).alias("salt"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    joined = rows.join(spans, ["key_hash", "doc_id", "salt"], "left").select("doc_id", "text", "spans")
    done = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if keep_text else done.drop("kept")
