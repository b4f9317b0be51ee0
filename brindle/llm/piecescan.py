"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The lattice. Nodes are positions of the normalised text, arcs are vocabulary pieces
(or one unknown character). A path's score adds up. For unigram models an arc has
its piece's log probability; for BPE models an arc has 0 and may follow another only
if the two pieces are what the merges make of their concatenation (a sequence whose
neighbours are all compatible is the BPE encoding, and there is one), else minus
infinity. So both kinds are best paths in the max-plus semiring, and the BPE scan
gives exactly what the library gives.

The scan. A document above ``chunk_chars`` is cut every ``chunk_chars`` characters.
A boundary state is the piece that crosses (or ends at) the cut. Each chunk yields a
transfer matrix (entry state x exit state). Products are associative, so the matrices
combine up a tree: each round multiplies ``FAN`` neighbours in a task of their own, until
a document has no more than that; then the best boundary states go down the tree, round
by round, to all cuts, and every chunk is backtraced on its own. No task holds more than
``FAN`` matrices or one chunk, however long a document is. Chunks travel with ``reach`` characters of
context on both sides only. No piece crosses from a non-space to a space (checked
against the vocabulary), so such places are single states: a matrix needs the
lattice near its chunk's ends only, and the middle is encoded in the backtrace.
A chunk without such a place is scanned as a whole.

Short documents are one chunk between two known states: nothing is to be combined,
and the library encodes their words, which a bounded memo keeps. The model reads a
literal U+2581 as a space, so words are cut at both.

Defined results: null text counts as empty (no pieces); null ids are kept;
repeated rows are encoded alike; empty tables give no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, thrifty, written
from .tokencount import balanced

if TYPE_CHECKING:  # pandas is loaded in the functions that need it, not in every worker
    import pandas as pd

CHUNK_CHARS = 32_768
MEMO_WORDS = 60_000
#: Matrices that one task multiplies in a round.
FAN = 16
WORD = re.compile(r" *[^ ]+| +")
NONE = -np.inf
State = tuple[int, int]  # end of a piece, counted from the cut; the piece, -1 - code point for an unknown character


class Pieces:
    """A SentencePiece model: its arcs, compatibilities, and the library's encoder."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        self.unigram = model.trainer_spec.model_type == model.trainer_spec.UNIGRAM
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        self.library = spm.SentencePieceProcessor(model_file=path)
        model.normalizer_spec.add_dummy_prefix = False
        self.raw = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        n = self.library.get_piece_size()
        self.text = [self.library.id_to_piece(i) for i in range(n)]
        skip = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i) for i in range(n)]
        self.ids = {t: i for i, t in enumerate(self.text) if not skip[i]}
        self.scores = [self.library.get_score(i) for i in range(n)]
        self.reach = max(map(len, self.ids))
        plain = model.normalizer_spec.name == "identity" and not model.normalizer_spec.remove_extra_whitespaces
        self.words_are_apart = plain and not any(re.search("[^▁]▁", t) for t in self.ids)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.numbers = list(range(n))  # one object an id, shared by all memo entries

    def normalised(self, text: str) -> str:
        return self.library.normalize(text) if text else ""

    def unknown(self, char: str) -> list[int]:
        """Ids of a character outside the vocabulary: bytes, or the unknown piece."""
        return self.raw.encode(char)

    @lru_cache(maxsize=50_000)
    def follows(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may come right after piece ``a`` in an encoding."""
        if self.unigram or a < 0 or b < 0:
            return True
        return self.raw.encode((self.text[a] + self.text[b]).replace("▁", " ")) == [a, b]

    def arcs(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """``(end, piece, score)`` of the pieces that start at a position."""
        found = []
        for end in range(at + 1, min(at + self.reach, len(text)) + 1):
            piece = self.ids.get(text[at:end])
            if piece is not None:
                found.append((end, piece, self.scores[piece] if self.unigram else 0.0))
        if not any(end == at + 1 for end, _, _ in found):
            found.append((at + 1, -1 - ord(text[at]), min(self.scores) - 10.0 if self.unigram else 0.0))
        return found

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a word with the spaces before it, as inside a text."""
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            ids = self.library.encode(word[1:]) if len(word) > 1 and word[0] == " " and self.dummy_prefix else self.raw.encode(word)
            known = tuple(map(self.numbers.__getitem__, ids))
            if len(word) < 40:
                self.memo[word] = known
        return known

    def encode(self, text: str) -> list[int]:
        """Ids of a whole short text."""
        if not text:
            return []
        if not self.words_are_apart or self.unigram:
            return self.library.encode(text)
        text = text.replace("▁", " ")
        out: list[int] = []
        extend, ids = out.extend, self.word_ids
        if self.dummy_prefix and "  " not in text and text[-1] != " " and text[0] != " ":
            memo = self.memo
            for word in text.split(" "):
                key = " " + word
                extend(memo[key] if key in memo else ids(key))
        else:
            for word in WORD.findall(" " * self.dummy_prefix + text):
                extend(ids(word))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""

    def comes_back(self, ids: list[int], text: str | None) -> bool:
        """Whether the ids decode to the text, or to what normalisation makes of it."""
        back = self.decode(ids)
        if back == (text or ""):
            return True
        whole = self.normalised(text or "").replace("▁", " ")
        return back == (whole[1:] if self.dummy_prefix and whole.startswith(" ") else whole)


@lru_cache(maxsize=1)
def load(path: str) -> Pieces:
    """The model of a worker, kept between its tasks."""
    return Pieces(path)


# The max-plus scan --------------------------------------------------------------


def forward(pieces: Pieces, text: str, starts: dict[State, float], stop: int) -> tuple[dict[State, float], dict[State, State | None]]:
    """Best scores of the states whose piece ends at ``stop`` or later, and how each
    state was reached. States are (position, piece)."""
    best, back = dict(starts), dict.fromkeys(starts)
    at_position: dict[int, list[State]] = {}
    for state in starts:
        at_position.setdefault(state[0], []).append(state)
    done: dict[State, float] = {}
    for at in range(min(at_position, default=stop), len(text) + 1):
        here = at_position.pop(at, ())
        if at >= stop:
            done.update({s: best[s] for s in here})
            continue
        arcs = pieces.arcs(text, at) if here else ()
        if pieces.unigram and here:
            here = [max(here, key=lambda s: (best[s], s))]
        for state in here:
            for end, piece, score in arcs:
                if pieces.follows(state[1], piece):
                    following, value = (end, piece), best[state] + score
                    if following not in best:
                        at_position.setdefault(end, []).append(following)
                    if value > best.get(following, NONE):
                        best[following], back[following] = value, state
    return done, back


START: State = (0, -1)


def crossing(pieces: Pieces, text: str, cut: int) -> list[State]:
    """All states a cut may have: pieces (or an unknown character) that start before
    it and end at it or later."""
    found = set()
    for start in range(max(0, cut - pieces.reach), cut):
        found.update((end, piece) for end, piece, _ in pieces.arcs(text, start) if end >= cut)
    return sorted(found)


def sync_places(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The first and last place in a range that no piece crosses."""
    found = [m.start() for m in re.finditer("(?<!▁)▁", text[:end]) if m.start() >= start and m.start() > 0]
    return (found[0], found[-1]) if found else None


def transfer(pieces: Pieces, text: str, start: int, end: int, first: bool, last: bool) -> tuple[list[State], list[State], np.ndarray]:
    """Entry states, exit states and matrix of the chunk ``text[start:end]``; states'
    positions count from the cut they belong to. ``text`` has context on both sides."""
    entries = [(start, -1)] if first else crossing(pieces, text, start)
    exits = [(end, -1)] if last else crossing(pieces, text, end)
    sync = sync_places(text, start, end) if pieces.words_are_apart and not pieces.unigram else None
    matrix = np.full((len(entries), len(exits)), NONE)
    if sync is None:
        for i, entry in enumerate(entries):
            done, _ = forward(pieces, text, {entry: 0.0}, end)
            _fill(matrix[i], done, exits, last)
    else:
        tail, _ = forward(pieces, text, {(sync[1], -1): 0.0}, end)
        row = np.full(len(exits), NONE)
        _fill(row, tail, exits, last)
        for i, entry in enumerate(entries):
            head = {} if entry[0] > sync[0] else forward(pieces, text[: sync[0]], {entry: 0.0}, sync[0])[0]
            if head:
                matrix[i] = max(head.values()) + row
    shift = lambda states, cut: [(p - cut, t) for p, t in states]
    return shift(entries, start), shift(exits, end), matrix


def _fill(row: np.ndarray, done: dict[State, float], exits: list[State], last: bool) -> None:
    for j, state in enumerate(exits):
        row[j] = max(done.values(), default=NONE) if last else done.get(state, NONE)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


Chunk = tuple[list[State], list[State], np.ndarray]


def _entering(before: Chunk, after: Chunk) -> list[int]:
    """Where the entry states of a chunk stand among the exit states of the one before."""
    order = {s: j for j, s in enumerate(before[1])}
    return [order[s] for s in after[0]]


def product(chunks: list[Chunk]) -> Chunk:
    """One chunk in the place of consecutive ones."""
    matrix = chunks[0][2]
    for before, after in zip(chunks, chunks[1:]):
        matrix = combine(matrix[:, _entering(before, after)], after[2])
    return chunks[0][0], chunks[-1][1], matrix


def boundary_states(chunks: list[Chunk], entry: State | None = None, exit_: State | None = None) -> list[State]:
    """The best path's state at every cut, both ends included. An end's state may be given."""
    row = chunks[0][0].index(entry) if entry is not None else 0
    prefix = [chunks[0][2][row]]
    for before, after in zip(chunks, chunks[1:]):
        prefix.append((prefix[-1][_entering(before, after)][:, None] + after[2]).max(axis=0))
    states = [exit_ if exit_ is not None else chunks[-1][1][int(prefix[-1].argmax())]]
    for k in range(len(chunks) - 1, 0, -1):
        entries, exits, matrix = chunks[k]
        into = prefix[k - 1][_entering(chunks[k - 1], chunks[k])] + matrix[:, exits.index(states[-1])]
        states.append(entries[int(into.argmax())])
    return [chunks[0][0][row], *reversed(states)]


def backtrace(pieces: Pieces, text: str, start: int, end: int, entry: State, exit_: State, last: bool) -> list[int]:
    """Ids of a chunk's pieces: those that start in it, given its boundary states."""
    begin, goal = (start + entry[0], entry[1]), (end + exit_[0], exit_[1])
    sync = sync_places(text, start, end) if pieces.words_are_apart and not pieces.unigram else None
    if sync is None or sync[0] < begin[0]:
        return _path_ids(pieces, text, begin, end, None if last else goal)
    head = _path_ids(pieces, text[: sync[0]], begin, sync[0], None)
    middle = [i for word in WORD.findall(text[sync[0] : sync[1]].replace("▁", " ")) for i in pieces.word_ids(word)]
    return head + middle + _path_ids(pieces, text, (sync[1], -1), end, None if last else goal)


def _path_ids(pieces: Pieces, text: str, begin: State, stop: int, goal: State | None) -> list[int]:
    done, back = forward(pieces, text, {begin: 0.0}, stop)
    state: State | None = goal if goal is not None else max(done, key=lambda s: (done[s], s)) if done else begin
    path = []
    while state is not None and state != begin:
        path.append(state[1])
        state = back[state]
    return [i for p in reversed(path) for i in ([p] if p >= 0 else pieces.unknown(chr(-1 - p)))]


# Spark --------------------------------------------------------------------------


def _chunks(giants: DataFrame, vocabulary: str, chunk_chars: int) -> DataFrame:
    """``digest, k, last, before, body, after`` of the normalised giant texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(vocabulary)
        for batch in batches:
            for digest, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = pieces.normalised(value.as_py())
                cuts = list(range(0, max(len(text), 1), chunk_chars))
                rows = [
                    (digest, k, at == cuts[-1], text[max(0, at - pieces.reach) : at], text[at : at + chunk_chars], text[at + chunk_chars : at + chunk_chars + pieces.reach])
                    for k, at in enumerate(cuts)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string()])],
                    ["digest", "k", "last", "before", "body", "after"],
                )

    return giants.select("digest", "text").mapInArrow(thrifty(run), "digest string, k long, last boolean, before string, body string, after string")


def _matrices(chunks: DataFrame, vocabulary: str) -> DataFrame:
    """``digest, k, entries, exits, matrix`` of each chunk, in bounded form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(vocabulary)
        for batch in batches:
            out = []
            for digest, k, last, before, body, after in zip(*(c.to_pylist() for c in batch.columns)):
                text, start = before + body + after, len(before)
                entries, exits, matrix = transfer(pieces, text, start, start + len(body), k == 0, last)
                out.append((digest, k, _flat(entries), _flat(exits), matrix.ravel().tolist()))
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(5)], ["digest", "k", "entries", "exits", "matrix"])

    return chunks.select("digest", "k", "last", "before", "body", "after").mapInArrow(thrifty(run), _MATRICES)


def _flat(states: list[State]) -> list[int]:
    return [x for s in states for x in s]


def _pairs(flat: Iterable[int]) -> list[State]:
    values = [int(x) for x in flat]
    return list(zip(values[::2], values[1::2]))


def _group(table: pd.DataFrame) -> list[Chunk]:
    """The chunks of a group in order."""
    found = []
    for entries, exits, matrix in zip(table.entries, table.exits, table.matrix):
        entries, exits = _pairs(entries), _pairs(exits)
        found.append((entries, exits, np.asarray(matrix).reshape(len(entries), len(exits))))
    return found


_MATRICES = "digest string, k long, entries array<long>, exits array<long>, matrix array<double>"


def _products(matrices: DataFrame, fan: int) -> DataFrame:
    """The products of every ``fan`` neighbours of a document."""
    import pandas as pd

    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        entries, exits, matrix = product(_group(table.sort_values("k")))
        return pd.DataFrame({"digest": [key[0]], "k": [key[1]], "entries": [_flat(entries)], "exits": [_flat(exits)], "matrix": [matrix.ravel()]})

    up = F.expr(f"k div {fan}").alias("up")
    return matrices.select("digest", up, "k", "entries", "exits", "matrix").groupBy("digest", "up").applyInPandas(run, _MATRICES)


def _ends(matrices: DataFrame, bounds: DataFrame | None, fan: int) -> DataFrame:
    """``digest, k, entry, exit``: the states at both ends of each chunk. ``bounds`` has
    those of every ``fan`` neighbours together; without it a group is a whole document."""
    import pandas as pd

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("k")
        given = [tuple(int(x) for x in table[n].iloc[0]) for n in ("entry", "exit")] if "entry" in table else [None, None]
        states = boundary_states(_group(table), *given)
        return pd.DataFrame({"digest": table.digest, "k": table.k, "entry": [list(s) for s in states[:-1]], "exit": [list(s) for s in states[1:]]})

    rows = matrices.withColumn("up", F.expr(f"k div {fan}"))
    if bounds is not None:
        rows = rows.join(bounds.select("digest", F.col("k").alias("up"), "entry", "exit"), ["digest", "up"])
    return rows.groupBy("digest", "up").applyInPandas(run, "digest string, k long, entry array<long>, exit array<long>")


def _states(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """``digest, k, entry, exit`` of each chunk: products up the tree, states down."""
    levels = [written(matrices, "piece-matrices")]
    last = levels[0].agg(F.max("k")).first()[0] or 0
    while last >= fan:
        levels.append(written(_products(levels[-1], fan), "piece-products"))
        last //= fan
    ends = None
    for level in reversed(levels):
        ends = _ends(level, ends, fan)
        ends = ends if level is levels[0] else written(ends, "piece-ends")
    return ends


def _encode_giants(giants: DataFrame, vocabulary: str, chunk_chars: int) -> DataFrame:
    """``digest, ids`` of distinct giant texts."""
    chunks = written(_chunks(giants, vocabulary, chunk_chars).repartition("digest", "k"), "piece-chunks")
    states = _states(_matrices(chunks, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(vocabulary)
        for batch in batches:
            ids = []
            for last, before, body, after, entry, exit_ in zip(*(batch.column(n).to_pylist() for n in ("last", "before", "body", "after", "entry", "exit"))):
                text, start = before + body + after, len(before)
                ids.append(backtrace(pieces, text, start, start + len(body), tuple(entry), tuple(exit_), last))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("k"), pa.array(ids, pa.list_(pa.int32()))], ["digest", "k", "ids"])

    traced = chunks.join(states, ["digest", "k"]).mapInArrow(thrifty(run), "digest string, k long, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("k", "ids")))
    return traced.groupBy("digest").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def encode(documents: DataFrame, vocabulary: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip`` of every document: the ids are what the
    library's ``encode`` gives; ``round_trip`` says whether decoding them gives the
    (normalised) text back."""
    kind = documents.select("doc_id").dtypes[0][1]
    rows = small_batches(documents).select("doc_id", "text")
    giant = F.coalesce(F.length("text") > chunk_chars, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(vocabulary)
        for batch in batches:
            for start, end in balanced(batch.column(1), 1 << 20):
                texts = batch.column(1).slice(start, end - start).to_pylist()
                ids = [pieces.encode(t) if t else [] for t in texts]
                sizes = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1]))
                back = [pieces.comes_back(i, t) for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(np.diff(sizes).astype(np.int64)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(back)],
                    ["doc_id", "n_pieces", "ids", "round_trip"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(vocabulary)
        for batch in batches:
            back = [pieces.comes_back(i, t) for i, t in zip(batch.column("ids").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("ids"), pa.array(back, pa.bool_())], ["digest", "ids", "round_trip"])

    short = rows.where(~giant).mapInArrow(thrifty(run), f"doc_id {kind}, n_pieces long, ids array<int>, round_trip boolean")
    long = rows.where(giant).withColumn("digest", F.sha2("text", 256))
    distinct = long.groupBy("digest").agg(F.first("text").alias("text"))
    coded = distinct.join(_encode_giants(distinct, vocabulary, chunk_chars), "digest").select("digest", "ids", "text")
    coded = coded.mapInArrow(thrifty(compare), "digest string, ids array<int>, round_trip boolean")
    giants = long.select("doc_id", "digest").join(coded, "digest")
    return short.unionByName(giants.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip"))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of ``(doc_id, ids)``: the normalised text of an encoding."""
    kind = encoded.select("doc_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(vocabulary)
        for batch in batches:
            texts = [pieces.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(thrifty(run), f"doc_id {kind}, text string")
