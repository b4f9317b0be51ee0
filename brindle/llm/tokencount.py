"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries: before every U+0020 that a non-space
character follows. Byte-level pre-tokenisation attaches such a space to what
follows it, so no token crosses the boundary and the pieces' counts add up. This
also cuts long texts: no call encodes more than one piece at a time, and the
pieces a worker has met before come from a bounded memo. Pieces not met before
are encoded in batches balanced by bytes. A long piece (text without spaces) is cut
further where the vocabulary's own pre-tokeniser cuts it, unless it holds an added
token; only a run that the pre-tokeniser keeps whole is encoded whole.

Defined results: null text counts as empty (0 bytes, 0 tokens); null ids are
kept; repeated rows are counted once each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .shared import small_batches

BATCH_BYTES = 1 << 20
MEMO_PIECES = 600_000
MEMO_BYTES = 64
LONG_PIECE = 8192

#: Memo keys are pieces without the space they start with. The first piece of a
#: text has none; a lone surrogate, which no text can hold, marks it.
FIRST = "\ud800"
CUT = re.compile(r" (?=\S)")
UNSAFE = re.compile(r" (?!\S)")


def split_safely(text: str) -> list[str]:
    """Memo keys of a text's pieces, in order."""
    if UNSAFE.search(text) is None:
        first, *rest = text.split(" ")
        return [FIRST + first, *rest]
    first, *rest = CUT.split(text)
    return [FIRST + first, *rest]


class PieceCounter:
    """Token counts by piece for one vocabulary file, with a bounded memo."""

    def __init__(self, vocabulary: str, batch_bytes: int = BATCH_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.batch_bytes = batch_bytes
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, int] = {}

    def long_piece(self, text: str) -> int:
        """Tokens of a long piece, by the pre-tokeniser's cuts."""
        cuts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if self.tokenizer.normalizer is None and not any(t in text for t in self.added) else []
        if len(cuts) < 2:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        parts = Counter(text[a:b] for _, (a, b) in cuts)
        return sum(n * len(self.tokenizer.encode(part, add_special_tokens=False)) for part, n in parts.items())

    def learn(self, keys: list[str]) -> None:
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        text = lambda key: key[1:] if key.startswith(FIRST) else " " + key
        for key in keys:
            if len(key) > LONG_PIECE:
                self.memo[key] = self.long_piece(text(key))
        keys = [k for k in keys if len(k) <= LONG_PIECE]
        at = 0
        while at < len(keys):
            size, end = 0, at
            while end < len(keys) and (size < self.batch_bytes or end == at):
                size += len(keys[end])
                end += 1
            own = keys[at:end]
            for key, coded in zip(own, self.tokenizer.encode_batch_fast([text(k) for k in own], add_special_tokens=False)):
                self.memo[key] = len(coded)
            at = end

    def count(self, texts: list[str]) -> list[int]:
        split = [split_safely(t) if t else [] for t in texts]
        memo = self.memo
        missing = {k for keys in split for k in keys if k not in memo}
        if missing:
            if len(memo) > MEMO_PIECES:
                missing = {k for keys in split for k in keys}
            self.learn(sorted(missing))
        get = self.memo.__getitem__
        counts = [sum(map(get, keys)) for keys in split]
        for key in missing:
            if len(key) > MEMO_BYTES:  # long pieces hardly come back
                del self.memo[key]
        return counts


def balanced(column: pa.ChunkedArray | pa.Array, batch_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together reach ``batch_bytes`` at most, or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > batch_bytes:
            yield start, row
            start, total = row, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def count_tokens(documents: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            counts: list[int] = []
            for start, end in balanced(texts, counter.batch_bytes):
                counts += counter.count(texts.slice(start, end - start).to_pylist())
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, n, pa.compute.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = documents.select("doc_id").dtypes[0][1]
    return small_batches(documents).select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
