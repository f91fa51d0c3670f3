"""Token counts of whole texts.

Texts travel in Arrow batches and only lengths come back.  A long text is split
at safe boundaries (white space, which no token of the vocabulary spans, and in texts
without it the ends of runs of letters), so the tokenizer sees many short chunks; chunks not met before are encoded in batches
of bounded bytes and their lengths are kept in a bounded table per worker.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one call of the tokenizer gets.
BATCH_BYTES = 1 << 20
#: Chunks whose result a worker remembers, and the longest such chunk.
MEMO_CHUNKS, MEMO_CHARS = 400_000, 64
#: The longest chunk that is not cut within, and where chunks are: behind a letter, before a digit or a full-width mark.
LONG_CHARS = 4096
_INNER = re.compile("(?<=[^\\W\\d_])(?=[0-9\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")


def load(path: str):
    """The tokenizer of a ``.json`` file; threads are left to Spark."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_balanced(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Group texts so that each group holds about ``limit`` bytes, or one longer text."""
    group: list[str] = []
    held = 0
    for text in texts:
        size = len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))
        if group and held + size > limit:
            yield group
            group, held = [], 0
        group.append(text)
        held += size
    if group:
        yield group


def lasting(name: str, make):
    """What ``make`` gives, kept for the later tasks of this Python worker."""
    store = sys.modules.setdefault("_tidemark_lasting", types.ModuleType("_tidemark_lasting")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


class Memo:
    """Results by chunk, encoded in batches; when too many, those met in one batch only are forgotten."""

    def __init__(self, path: str, result) -> None:
        self.tokenizer, self.result = load(path), result
        self.known: dict = {}
        self.again: set[str] = set()

    def encode(self, chunks: list[str]) -> Iterable[tuple[str, object]]:
        """Each chunk with its result."""
        return zip(chunks, [self.result(x.ids) for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)], strict=True)

    def learn(self, chunks: set[str]) -> dict:
        """A table that covers ``chunks``."""
        if len(self.known) > MEMO_CHUNKS:
            kept = self.again if 2 * len(self.again) < MEMO_CHUNKS else chunks
            self.known, self.again = {c: self.known[c] for c in kept if c in self.known}, set()
        known, long = self.known, {}
        fresh = [c for c in chunks if c not in known]
        self.again |= chunks.difference(fresh)
        short = [c for c in fresh if len(c) <= MEMO_CHARS]
        for lo in range(0, len(short), 8192):  # half a megabyte at most
            known.update(self.encode(short[lo : lo + 8192]))
        if len(short) < len(fresh):
            for group in byte_balanced(c for c in fresh if len(c) > MEMO_CHARS):
                long.update(self.encode(group))
        return known | long if long else known


def spaced_chunks(text: str) -> list[str]:
    """Cut at spaces and line ends, and chunks that are still long at other places; for vocabularies that drop white space.

    The other places are those between a letter and a digit or a full-width mark: such
    a vocabulary's pattern ends a run of letters there, nothing composes across them
    and no special string holds one.
    """
    chunks = text.replace("\n", " ").split(" ")
    if max(map(len, chunks)) <= LONG_CHARS:
        return chunks
    return [part for c in chunks for part in (_INNER.split(c) if len(c) > LONG_CHARS else (c,))]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    For vocabularies in which white space only separates.  Special strings in a
    text count as the library's default has it; nothing is added or truncated.
    A null text is an empty one: 0 bytes, 0 tokens.  Repeated rows and null ids
    give a row each; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = lasting(f"counts {tokenizer_path}", lambda: Memo(tokenizer_path, len))
        for batch in batches:
            counts: list[int] = []
            for group in byte_balanced(batch.column(2).to_pylist()):
                pieces = [spaced_chunks(text) for text in group]
                table = memo.learn(set().union(*pieces))
                counts += [sum(map(table.__getitem__, p)) for p in pieces]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
