"""Packing documents into training sequences by multiway differencing.

A document's whole 1024-token stretches fill sequences of their own; what is
left of it is cut into near-equal pieces of at most ``grain`` tokens.  Groups of
such pieces are dealt into windows by the Karmarkar-Karp method: each piece
starts as a partial partition with one used window, and the two partitions of
largest imbalance are merged, largest window onto smallest, until one is left.
If a window exceeds the capacity the group is dealt again with one more window.

Everything happens in the task that reads the documents, so packing shuffles
nothing and keeps at most one group of pieces in memory.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import insort
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Memo, byte_balanced, lasting

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences that one task can number.
TASK_SEQUENCES = 1 << 36

_CUTS = re.compile(r"(?<=\S)(?= \S)")


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return np.asarray(ids, "<u4").tobytes()


class SpacedMemo(Memo):
    """Ids of words that follow a space, the space included.

    Words are encoded joined: in this vocabulary the first token of a word after
    a space, and no other, begins with a space.  Plain words (Latin letters, then
    perhaps punctuation) take a shorter way: the file's own merges, without the
    general pattern; the library encodes the rest.  A chunk that is empty or has
    white space at an end is no word and has None.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path, id_bytes)
        vocabulary = self.tokenizer.get_vocab(True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.plain = plain_encoder(self.tokenizer)

    def encode(self, chunks: list[str]) -> Iterable[tuple[str, object]]:
        words = [c for c in chunks if c and not (c[0].isspace() or c[-1].isspace())]
        plain = [c for c in words if is_plain(c)] if self.plain else []
        rest = words if not plain else list(set(words).difference(plain))
        found = dict.fromkeys(chunks) if len(words) < len(chunks) else {}
        if plain:
            found.update(self.cut(plain, np.asarray(self.plain.encode_to_numpy(" " + " ".join(plain)), "<u4")))
        if rest:
            found.update(self.cut(rest, np.asarray(self.tokenizer.encode_batch_fast([" " + " ".join(rest)], add_special_tokens=False)[0].ids, "<u4")))
        return found

    def cut(self, words: list[str], ids: np.ndarray) -> Iterable[tuple[str, bytes]]:
        """Each word with its part of the ids of all."""
        at, data = (4 * np.flatnonzero(self.begins[ids])).tolist(), ids.tobytes()
        return zip(words, map(data.__getitem__, map(slice, at, [*at[1:], len(data)])), strict=True)


def is_plain(word: str) -> bool:
    """Letters up to U+024F, which are letters in every version of Unicode, then perhaps punctuation."""
    core = word.rstrip(".,;:!?")
    return core.isalpha() and (core.isascii() or max(core) < "\u0250")


def plain_encoder(tokenizer):
    """A faster encoder of plain words after spaces; None where the vocabulary's merges are not in the order of its ids."""
    model = json.loads(tokenizer.to_str())["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if order != sorted(order):
        return None
    # Byte-level vocabularies write bytes that do not print as characters from U+0100 on.
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printing)))}
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    return tiktoken.Encoding("plain", pat_str=r" [^\s.,;:!?]+|[.,;:!?]+", mergeable_ranks=ranks, special_tokens={})


class TextIds:
    """Ids of whole texts, from the ids of their chunks.

    A text is cut before each single space between two other characters.  The
    byte-level pattern joins such a space to what follows and no token spans the
    cut, so the chunks' ids in a row are the text's ids.
    """

    def __init__(self, path: str) -> None:
        self.spaced, self.exact = SpacedMemo(path), Memo(path, id_bytes)

    def of(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        spaced = self.spaced.learn(set().union(*split))
        first = self.exact.learn({p[0] for p in split})
        out: list[bytes] = []
        for text, parts in zip(texts, split, strict=True):
            try:
                if spaced[parts[0]] is None:
                    raise TypeError
                out.append(first[parts[0]] + b"".join(map(spaced.__getitem__, islice(parts, 1, None))))
            except TypeError:  # spaces in a row, or beside other white space
                chunks = _CUTS.split(text)
                exact = self.exact.learn(set(chunks))
                out.append(b"".join(map(exact.__getitem__, chunks)))
        return out


def differencing(sizes: list[int], windows: int) -> tuple[list[list[int]], int]:
    """Deal items into ``windows`` near-equal windows; their items and the largest sum.

    A partial partition lists its used windows by sum, each with the tree of its
    items.  Of two partitions the largest windows meet the smallest, which are
    unused ones as long as there are enough.
    """
    heap = [(-size, item, [(size, item)]) for item, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        if len(one) < len(two):
            one, two = two, one
        meet = len(one) + len(two) - windows
        if meet <= 0:
            if len(two) == 1:
                insort(one, two[0], key=itemgetter(0))
            else:
                one = sorted(one + two, key=itemgetter(0))
        else:
            # The largest of the one fill the other's unused windows; the rest meet its smallest, large with small.
            both = [(a + b, (x, y)) for (a, x), (b, y) in zip(one[:meet], reversed(two[:meet]), strict=True)]
            one = sorted(both + one[meet:] + two[meet:], key=itemgetter(0))
        low = one[0][0] if len(one) == windows else 0
        heapq.heappush(heap, (low - one[-1][0], tie, one))
    dealt: list[list[int]] = []
    for _, tree in heap[0][2]:
        items, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node[::-1]
            else:
                items.append(node)
        dealt.append(items)
    return dealt, heap[0][2][-1][0]


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Deal items into windows, more of them as long as the largest exceeds the capacity.

    The count starts from the least possible and rises by what the largest
    window's distance from the mean asks for, by one at least.
    """
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while True:
        dealt, largest = differencing(sizes, windows)
        if largest <= capacity:
            return dealt
        room = max(1, capacity - (largest - total // windows))
        windows = max(windows + 1, -(-total // room))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, grain: int = 256, group: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document: where it comes from and where it lies.

    ``start`` and ``length`` place the piece in the document's ids (which end with
    ``end_id``), ``sequence_id`` and ``offset`` in the sequences.  A null or empty
    text is the one id ``end_id``.  Repeated rows and null ids are packed like any
    others; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = lasting(f"ids {tokenizer_path}", lambda: TextIds(tokenizer_path))
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) * TASK_SEQUENCES
        end = np.asarray([end_id], "<u4").tobytes()
        waiting: list[tuple] = []
        rows: list[tuple] = []

        def deal() -> None:
            nonlocal number, waiting
            for window in near_equal_windows([p[2] for p in waiting], capacity):
                at = 0
                for i in window:
                    rows.append((*waiting[i], number, at))
                    at += waiting[i][2]
                number += 1
            waiting = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in byte_balanced(batch.column(1).to_pylist()):
                for ids, doc in zip(encoder.of(texts), names):  # noqa: B905  the texts of a group end first
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total - total % capacity, capacity):
                        rows.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, number, 0))
                        number += 1
                    rest = total % capacity
                    start, pieces = total - rest, -(-rest // grain)
                    for k in range(pieces):
                        lo, hi = start + rest * k // pieces, start + rest * (k + 1) // pieces
                        waiting.append((doc, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), total))
                    if len(waiting) >= group:
                        deal()
            yield flushed()
        if waiting:
            deal()
        yield flushed()

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, SCHEMA)
