"""Toxicity scores after noisy-channel deobfuscation.

1. A character 4-gram language model is counted over all documents (letters are
   folded to a-z plus a boundary, so the table has 27^4 cells at most).
2. Suspicious tokens - leetspeak, letters torn apart by spaces or dots, repeated
   letters - become character lattices. An arc has the channel's log probability of
   what is seen given the letter meant (a substitution is one of the letter's
   substitutes, each further repetition has a probability of its own). Viterbi
   decoding of channel and language model picks the reading; the restored word joins
   the text's own words.
3. Features of a document: 5-letter windows of its words (a boundary may be the first
   or last character; a word of two letters is one window with two boundaries at its
   end), whole words of at least four letters, and the first six letters of words of
   at least five, once for each of one, two and three sightings in the document. A
   feature's weight is the lower Wilson bound of the share of toxic documents among
   the labelled ones that hold it, so few sightings never weigh much. All labelled
   training rows count.
4. A document's score comes from the mean weight of its ``TOP`` strongest features, or
   of all windows of a word of two to four letters (fewer than ``TOP``) where that is more.
   On all training rows the mean is found that parts toxic from clean rows best,
   precision counting twice as much as recall; it becomes the decision threshold, so
   that scores mean the same on any table.

The language model and the feature table have fixed size bounds (27^4 cells; 27^5 and
4 times 2^22 cells, words and beginnings by hash); only they reach the driver.

Letters: Latin ones lose their accents, Greek and Cyrillic lookalikes become the Latin
letter, combining marks vanish, and every other letter of two or three bytes stands for
one of the 26 codes (by its number), so that texts of all scripts have features.

Defined results: null and empty texts score 0; null ids are kept (such
rows have no label, and count as not held out); a document labelled twice is toxic
if any label says so; null labels are skipped; repeated rows are scored alike;
without labels every score is 0; empty tables give no rows; extra
columns are ignored or, in ``reject_toxic``, carried along.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .shared import plain_columns, relieve, small_batches, thrifty, written

A = 27  # letters a-z and the boundary, which is 0
CELLS4, CELLS5 = A**4, A**5
#: Cells of each hashed kind of feature: words, and beginnings seen once, twice, three times.
HASHED = 1 << 22
CELLS = CELLS5 + 4 * HASHED
WORD_LETTERS, BEGINNING, BEGINNING_OF = 4, 6, 5
THRESHOLD, TOP = 0.3, 3
GRID = 100  # steps of the means that may become the decision threshold
#: Training labels are broadcast up to these bytes, else joined by a shuffle.
LABEL_BYTES = 32 << 20
#: Sightings of features a training task holds before it hands their counts on.
SIGHTINGS = 1_000_000
#: Bytes of text worked on at a time: a dozen arrays of eight bytes for each are held.
BLOCK_BYTES = 1 << 18

#: Characters and the letters they may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
#: Greek and Cyrillic letters that look like Latin ones.
LOOKALIKES = dict(zip("авекмнорстухіѕјԁԛԝαβεικμνορτυχ", "abekmhopctyxisjdqwabeikmvoptux"))
#: The channel: how often a letter is written as one of its substitutes, and how often it is repeated once more.
SUBSTITUTED, REPEATED = 0.05, 0.2
SUBSTITUTES = Counter("".join(LEET.values()))

FOLD = np.zeros(256, np.uint8)
FOLD[65:91] = FOLD[97:123] = np.arange(1, 27)
DROP = 255  # a combining mark


def _letter(char: str) -> int:
    """The code of a letter beyond ASCII, 0 for anything else, ``DROP`` for a combining mark."""
    kind = unicodedata.category(char)
    if kind == "Mn":
        return DROP
    if kind[0] != "L":
        return 0
    plain = unicodedata.normalize("NFD", char.lower())[0]
    plain = LOOKALIKES.get(plain, {"ß": "s", "æ": "a", "ø": "o", "œ": "o", "ı": "i", "ł": "l", "đ": "d", "þ": "t", "ð": "d"}.get(plain, plain))
    return ord(plain) - 96 if "a" <= plain <= "z" else ord(plain) % 26 + 1


#: Codes of the characters of two bytes, by number.
WIDE = np.array([0] * 128 + [_letter(chr(c)) for c in range(128, 0x800)], np.uint8)
IS_LEET = np.zeros(256, bool)
IS_LEET[[ord(c) for c in "0123456789@$!|+("] + [0xE2]] = True
IS_JOINT = np.zeros(256, bool)
IS_JOINT[[ord(c) for c in "._-*~"]] = True


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of a block of texts and the row of each code.

    Runs of anything else become one boundary; every text starts and ends with one.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    out = np.full(len(data) + 2 * n + 1, 0x20, np.uint8)
    out[np.arange(len(data)) + 2 * row + 1] = data
    rows = np.repeat(np.arange(n + 1), np.append(lengths + 2, 1))
    codes = FOLD[out]
    two = np.flatnonzero((out[:-1] >= 0xC2) & (out[:-1] < 0xE0))
    codes[two] = WIDE[((out[two].astype(np.int64) & 0x1F) << 6) | (out[two + 1] & 0x3F)]
    three = np.flatnonzero((out[:-2] == 0xE0) | (out[:-2] == 0xE1) | (out[:-2] >= 0xE3) & (out[:-2] < 0xEE))
    number = ((out[three].astype(np.int64) & 0x0F) << 12) | ((out[three + 1].astype(np.int64) & 0x3F) << 6) | (out[three + 2] & 0x3F)
    codes[three] = np.where((number >= 0x3000) & (number < 0x3040), 0, number % 26 + 1)
    keep = ((out < 0x80) | (out >= 0xC0)) & (codes != DROP)
    codes, rows = codes[keep], rows[keep]
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == 0) & (codes[:-1] == 0) & (rows[1:] == rows[:-1])
    return codes[~again], rows[~again]


Windows = tuple[np.ndarray, np.ndarray]


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """The number of every window of ``size`` codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = codes[:n].astype(np.int64)
    for k in range(1, size):
        total = total * A + codes[k : n + k]
    return total


def word_windows(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """5-code windows inside one word and their rows; an end may be the boundary.

    A word of two letters makes one window, filled up with a second boundary."""
    g = grams(codes, 5)
    n = len(g)
    inner = (codes[1 : n + 1] != 0) & (codes[2 : n + 2] != 0) & (codes[3 : n + 3] != 0) & (rows[:n] == rows[4 : n + 4])
    ends = np.flatnonzero(codes == 0)
    pair = ends[:-1][np.diff(ends) == 3]
    two = (codes[pair + 1].astype(np.int64) * A + codes[pair + 2]) * A * A
    return np.concatenate([g[inner], two]), np.concatenate([rows[:n][inner], rows[pair]])


def short_words(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and row of each word of two to four letters. Four letters
    have two windows, fewer have one."""
    ends = np.flatnonzero(codes == 0)
    size = np.diff(ends) - 1
    out = []
    for n in (2, 3, 4):
        at = ends[:-1][size == n]
        word = np.zeros(len(at), np.int64)
        for k in range(1, n + 1):
            word = word * A + codes[at + k]
        last = word * A ** max(4 - n, 1)
        out.append((word if n == 4 else last, last, rows[at]))
    return tuple(np.concatenate(x) for x in zip(*out))


def words_and_beginnings(codes: np.ndarray, rows: np.ndarray) -> tuple[Windows, Windows]:
    """Cell and row of every word of at least ``WORD_LETTERS`` letters, and of the first
    ``BEGINNING`` letters of every word of at least ``BEGINNING_OF``; cells are below ``HASHED``."""
    ends = np.flatnonzero(codes == 0)
    starts, size = ends[:-1] + 1, np.diff(ends) - 1
    long = size >= min(WORD_LETTERS, BEGINNING_OF)
    starts, size = starts[long], size[long]
    up, down = textkit._POWERS.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(textkit.BYTE_VALUES[codes] * up[: len(codes)], out=sums[1:])

    def cells(at: np.ndarray, length: np.ndarray) -> Windows:
        value = textkit.mix((sums[at + length] - sums[at]) * down[at] + length.astype(np.uint64))
        return (value & np.uint64(HASHED - 1)).astype(np.int64), rows[at]

    word, begin = size >= WORD_LETTERS, size >= BEGINNING_OF
    return cells(starts[word], size[word]), cells(starts[begin], np.minimum(size[begin], BEGINNING))


@lru_cache(maxsize=65_536)
def letters(text: str) -> str:
    """The letters of a character or word folded to a-z."""
    codes, _ = fold(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    return "".join(chr(96 + c) for c in codes if c)


def language_model(documents: DataFrame, smoothing: float = 5.0) -> np.ndarray:
    """log P(d | a b c) for all 27^4 windows, from counts over every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS4, np.int64)
        for batch in batches:
            data, offsets = textkit.text_buffer(batch.column(0))
            for row, end in textkit.blocks(offsets, BLOCK_BYTES):
                for own, inner in _parts(data, offsets, row, end):
                    counts += np.bincount(grams(fold(own, inner)[0], 4), minlength=CELLS4)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["window", "n"])

    rows = small_batches(documents).select("text").mapInArrow(thrifty(run), "window long, n long").groupBy("window").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS4)
    counts[rows["window"].to_numpy()] = rows["n"].to_numpy()
    four = counts.reshape(A, A, A, A)
    lower = np.full(A, 1.0 / A)
    for keep in (1, 2, 3):  # unigram, bigram, trigram distributions, each backing off to the last
        level = four.sum(axis=tuple(range(4 - keep)))
        total = level.sum(axis=-1, keepdims=True)
        lower = (level + smoothing * lower) / (total + smoothing)
    return np.log((four + smoothing * lower) / (four.sum(axis=-1, keepdims=True) + smoothing))


def _parts(data: np.ndarray, offsets: np.ndarray, row: int, end: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows as they are; one long text in pieces that end after a word of three
    bytes or more, so that no word torn apart by spaces is cut."""
    own = data[offsets[row] : offsets[end]]
    if end > row + 1:
        yield own, offsets[row : end + 1] - offsets[row]
    else:
        for a, b in textkit.pieces(own, block_bytes, 3):
            yield own[a:b], np.array([0, b - a])


class Decoder:
    """Viterbi decoding of obfuscated tokens under the character model."""

    MEMO = 30_000

    def __init__(self, model: np.ndarray):
        #: log P(d | a b c) at ((a * A + b) * A + c) * A + d; a state is the last three codes.
        self.flat = array("d", model.ravel().tobytes())
        self.memo: dict[str, str] = {}

    def lattice(self, token: str) -> list[tuple[tuple[str, float], ...]]:
        """The readings of each position (letters, a doubled letter, or nothing) with the
        channel's log probability of what is seen given the reading."""
        places: list[tuple[tuple[str, float], ...]] = []
        for run in re.finditer(r"(.)\1*", token, re.DOTALL):
            char, n = run[1], len(run[0])
            if char in LEET:
                options = [(o, log(SUBSTITUTED / SUBSTITUTES[o])) for o in LEET[char]]
            else:
                folded = letters(char)
                options = [(folded, log(1 - SUBSTITUTED))] if folded else [("", 0.0)]
            if options[0][0] == "" or n == 1:
                places.append(tuple(options))
                continue
            once = [(o, p + (n - 1) * log(REPEATED)) for o, p in options]
            twice = [(o * 2, 2 * p + (n - 2) * log(REPEATED)) for o, p in options]
            places.append(tuple(twice if n == 2 and char not in LEET else once + twice))
        return places

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest letters of a token; ``spaced`` lets word boundaries in."""
        key = token + "\n" * spaced
        if (known := self.memo.get(key)) is not None:
            return known
        flat, states = self.flat, A**3
        beam: dict[int, tuple[float, str]] = {0: (0.0, "")}
        for at, options in enumerate(self.lattice(token)):
            readings = [([ord(c) - 96 for c in o], o, p) for o, p in options]
            if spaced and at:
                readings += [([0, *codes], " " + o, p) for codes, o, p in readings if o]
            following: dict[int, tuple[float, str]] = {}
            for state, (score, text) in beam.items():
                for codes, shown, seen in readings:
                    now, own = state, score + seen
                    for k in codes:
                        cell = now * A + k
                        own += flat[cell]
                        now = cell % states
                    if now not in following or own > following[now][0]:
                        following[now] = (own, text + shown)
            beam = following
        best = max(beam.items(), key=lambda x: (x[1][0] + flat[x[0] * A], x[1][1]))[1][1]
        if len(self.memo) > self.MEMO:
            self.memo.clear()
        self.memo[key] = best
        return best


_decoders: dict[str, Decoder] = {}


def decoder_of(model: np.ndarray) -> Decoder:
    """The decoder of a worker for a model, kept between its tasks with what it has decoded."""
    key = hashlib.md5(np.ascontiguousarray(model).tobytes()).hexdigest()
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(model)
    return _decoders[key]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


EDGES = ".,;:?!\"')]}%&#*<>"
TORN = re.compile(r"[^\W\d_](?:[._\-*~]+[^\W\d_]){2,}", re.UNICODE)


def restored(data: np.ndarray, offsets: np.ndarray, decoder: Decoder) -> Iterator[tuple[int, str]]:
    """(row, restored word or words) of the suspicious tokens of a block of texts."""
    hashes, at, to = textkit.word_hashes(data, offsets[1:-1])
    if not len(at):
        return
    rows = np.searchsorted(offsets, at, side="right") - 1

    def within(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[to] - sums[at]

    code = FOLD[data]
    letter = within((code > 0) | (data >= 0xC3))
    leet = within(IS_LEET[data])
    triple = np.zeros(len(data), bool)
    triple[2:] = (code[2:] > 0) & (code[2:] == code[1:-1]) & (code[1:-1] == code[:-2])
    torn = (within(IS_JOINT[data]) >= 2) & (letter >= 3)
    odd = ((leet > 0) & (letter > 0)) | (within(triple) > 0) | torn
    for k in np.flatnonzero(odd):
        token = data[at[k] : to[k]].tobytes().decode("utf-8", "replace").strip(EDGES)
        if m := TORN.fullmatch(token):
            yield int(rows[k]), decoder.decode(re.sub(r"[._\-*~]", "", m[0]))
        elif len(token) > 2 and (any(c in LEET for c in token) or re.search(r"([^\W\d_])\1\1", token, re.IGNORECASE)):
            yield int(rows[k]), decoder.decode(token.lower())
    single = (to - at == 1) & ((FOLD[data[at]] > 0) | IS_LEET[data[at]]) | (to - at == 2) & (data[at] == 0xC3)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a < 3:
            continue
        start = a
        for k in range(a, b + 1):  # a run ends at its text's end too
            if k == b or rows[k] != rows[start]:
                if k - start >= 3:
                    run = b"".join(data[at[i] : to[i]].tobytes() for i in range(start, k)).decode("utf-8", "replace")
                    yield int(rows[start]), decoder.decode(run.lower(), spaced=True)
                start = k


Short = tuple[np.ndarray, np.ndarray, np.ndarray]


def windows(data: np.ndarray, offsets: np.ndarray, decoder: Decoder) -> tuple[Windows, Windows, Windows, Short]:
    """Windows, words and beginnings with their rows, and the short words, of a block's
    own and of its restored words."""
    folded = fold(data, offsets)
    found = [(word_windows(*folded), *words_and_beginnings(*folded), short_words(*folded), None)]
    restorations = list(restored(data, offsets, decoder))
    if restorations:
        texts = [t.encode() for _, t in restorations]
        folded = fold(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        owner = np.array([row for row, _ in restorations], np.int64)
        found.append((word_windows(*folded), *words_and_beginnings(*folded), short_words(*folded), owner))
    out = []
    for k in range(4):
        parts = [(*f[k][:-1], f[k][-1] if f[4] is None else f[4][f[k][-1]]) for f in found]
        out.append(tuple(np.concatenate(x) for x in zip(*parts)))
    return tuple(out)


def sightings(cells: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys (row * ``CELLS`` + feature) of the beginnings seen once, twice, three times in a row."""
    pair, n = distinct(rows * HASHED + cells)
    row, cell = pair // HASHED, pair % HASHED
    return np.concatenate([(row * CELLS + CELLS5 + k * HASHED + cell)[n >= k] for k in (1, 2, 3)])


def feature_keys(parts: list[tuple[Windows, Windows, Windows]]) -> np.ndarray:
    """Distinct keys (row * ``CELLS`` + feature) of the parts of one block."""
    joined = [tuple(np.concatenate(x) for x in zip(*kind)) for kind in zip(*parts)]
    (g, r), (word, word_rows), (begin, begin_rows) = joined
    return distinct(np.concatenate([r * CELLS + g, word_rows * CELLS + CELLS5 + word, sightings(begin, begin_rows)]))[0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """``doc_id, toxic, text`` of the labelled rows that are not held out, and the number of labels."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known, "training-labels")
    n = known.count()
    if n * 16 <= LABEL_BYTES:  # an id and a label a row
        known = F.broadcast(known)
    return documents.select("doc_id", "text").join(known, "doc_id").select("doc_id", "toxic", "text"), n


def feature_table(rows: DataFrame, model: np.ndarray, z: float = 2.5, least_share: float = 0.35) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights learnt from all training rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_of(shared.value)
        held: list[np.ndarray] = []  # feature * 2 + label of every sighting
        size = 0

        def counted() -> pa.RecordBatch:
            key, n = distinct(np.concatenate(held))
            toxic = key % 2 == 1
            return pa.RecordBatch.from_arrays([pa.array(key // 2), pa.array(np.where(toxic, 0, n)), pa.array(np.where(toxic, n, 0))], ["feature", "clean", "toxic"])

        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = textkit.text_buffer(batch.column(1))
            for row, end in textkit.blocks(offsets, BLOCK_BYTES):
                parts = [windows(own, inner, decoder)[:3] for own, inner in _parts(data, offsets, row, end)]
                if not parts:
                    continue
                key = feature_keys(parts)
                held.append(key % CELLS * 2 + (toxic[row + key // CELLS] == 1))
                size += len(key)
                if size > SIGHTINGS:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    n, p, zz = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic")), z * z
    bound = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    table = (
        rows.select("toxic", "text").mapInArrow(thrifty(run), "feature long, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where("toxic > 0")
        .select("feature", bound.alias("weight"))
        .where(F.col("weight") >= least_share)
        .toArrow()
    )
    order = np.argsort(table["feature"].to_numpy())
    return table["feature"].to_numpy()[order], table["weight"].to_numpy()[order]


def combine(weights: np.ndarray, word: float = 0.0) -> float:
    """The evidence of a document's features: the mean of its ``TOP`` strongest weights,
    where missing ones are 0, or ``word``, the mean weight of its strongest short word, if
    more. A telling word has several features, a chance meeting of letters hardly more
    than one, but a short word's few are all of it."""
    return max(float(np.sort(weights)[::-1][:TOP].sum()) / TOP, word)


def evidence(rows: DataFrame, model: np.ndarray, known: np.ndarray, weights: np.ndarray, *carry: str) -> DataFrame:
    """``carry`` columns and ``evidence`` of every row's ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast((model, known, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, weights = shared.value
        decoder = decoder_of(model)
        listed = np.zeros(CELLS, bool)
        listed[known] = True
        # What each kind of feature is looked up in before anything is sorted.
        begins = listed[CELLS5 + HASHED : CELLS].reshape(3, HASHED).any(axis=0)
        tables = (listed[:CELLS5], listed[CELLS5 : CELLS5 + HASHED], begins)

        def weight(features: np.ndarray) -> np.ndarray:
            out, hit = np.zeros(len(features)), listed[features]
            out[hit] = weights[np.searchsorted(known, features[hit])]
            return out

        for batch in batches:
            means = np.zeros(batch.num_rows)
            data, offsets = textkit.text_buffer(batch.column("text"))
            for row, end in textkit.blocks(offsets, BLOCK_BYTES):
                parts, word = [], np.zeros(end - row)
                for own, inner in _parts(data, offsets, row, end):
                    *found, (first, last, owner) = windows(own, inner, decoder)
                    np.maximum.at(word, owner, (weight(first) + weight(last)) / 2)
                    parts.append([(g[hit], r[hit]) for (g, r), hit in ((kind, table[kind[0]]) for kind, table in zip(found, tables))])
                key = feature_keys(parts) if parts else np.zeros(0, np.int64)
                key = key[listed[key % CELLS]]
                own_rows, feature = key // CELLS, key % CELLS
                cut = np.flatnonzero(np.diff(own_rows, prepend=-1))
                for a, b in zip(cut, [*cut[1:], len(key)]):
                    means[row + own_rows[a]] = combine(weight(feature[a:b]), word[own_rows[a]])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in carry), pa.array(means)], [*carry, "evidence"])

    rows = small_batches(rows).select(*carry, *([] if "text" in carry else ["text"]))
    fields = dict(rows.dtypes)
    return rows.mapInArrow(thrifty(run), ", ".join([*(f"`{n}` {fields[n]}" for n in carry), "evidence double"]))


def best_cut(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The evidence from which on a row is called toxic: a quarter of the way through the
    steps with the best F-measure (precision twice as important), given the number of rows of
    each step. Toxic rows with words that few labelled rows have lie between the two classes,
    so the cut stands nearer to the clean ones."""
    found, right = np.cumsum((clean + toxic)[::-1])[::-1], np.cumsum(toxic[::-1])[::-1]
    quality = 1.25 * right / np.maximum(found + 0.25 * toxic.sum(), 1)
    quality[0] = 0.0  # no evidence at all
    if not quality.any():
        return 0.5
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    return (3 * best[0] + best[-1]) / 4 / GRID


def calibrate(rows: DataFrame, model: np.ndarray, known: np.ndarray, weights: np.ndarray) -> float:
    """The cut on all training rows; only the counts of the steps reach the driver."""
    judged = evidence(rows, model, known, weights, "toxic")
    steps = np.zeros((2, GRID + 1))
    for row in judged.groupBy(F.floor(F.col("evidence") * GRID).cast("int").alias("step"), F.expr("int(toxic = 1)").alias("toxic")).count().collect():
        steps[row.toxic, row.step] = row["count"]
    return best_cut(*steps)


def score_toxicity(documents: DataFrame, labels: DataFrame, *carry: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, and ``carry`` columns."""
    model = language_model(documents)
    rows, _ = training_rows(documents, labels)
    known, weights = feature_table(rows, model)
    cut = calibrate(rows, model, known, weights) if len(known) else 0.5
    relieve(documents.sparkSession)
    documents = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *[c for c in carry if c != "text"])
    scored = evidence(documents, model, known, weights, "doc_id", "held_out", *carry)
    mean = F.col("evidence")
    score = F.when(mean < cut, THRESHOLD * mean / cut).otherwise(THRESHOLD + (1 - THRESHOLD) * (mean - cut) / (1 - cut))
    return scored.withColumn("score", score).drop("evidence").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def reject_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, that are not predicted toxic."""
    plain, restore = plain_columns(documents, "doc_id", "text")
    carried = [c for c in plain.columns if c != "doc_id"]
    return restore(score_toxicity(plain, labels, *carried).where("predicted = 0"))
