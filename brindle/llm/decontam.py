"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names (capitalised words inside a sentence, but not
words in capitals throughout) and units (ambiguous ones right after a number only)
turn into typed placeholders, everything else is lower-cased with punctuation at its
ends removed. Windows of five template
words of the documents are hash-joined with those of the benchmark items.

A bitmap of fixed size over the benchmark's window hashes spares all other windows
the way through the join; it only filters, so its false positives cost time and
nothing else. It is the only thing that is broadcast, and its size does not depend
on the data.

Slot consistency: along one alignment (item, document, distance of positions) the
same item value must meet the same document value of the same type; so a
re-parameterised question is caught, while a chance meeting of placeholders is not.
Where an item value meets several, the one of the most windows counts (of equally
many, the item's own), and the windows that hold another are discarded.
Windows of placeholders alone prove nothing and are not used, unless an item has no
other windows.

A document is contaminated by an item when the consistent windows cover at least
``coverage`` (0.8) of the item's windows, or a run of ``passage_words`` (13) of its
words. Items below five words are compared as a whole: one window of all their
words must occur between sentence ends. Where such an item is placeholders alone,
a part of a document must have its values too; a whole document need not.

Defined results: null or empty texts hold no windows; null ids are carried (rows
are told apart by id and text digest); repeated rows are judged alike; empty
tables give no matches; extra columns are ignored or, in ``drop_contaminated``,
carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit
from .pii import let
from .shared import plain_columns, sized, small_batches, thrifty, written

U64 = np.uint64
WINDOW, COVERAGE, PASSAGE_WORDS = 5, 0.8, 13
#: Words before a piece of a giant text that are read again; a word's template depends
#: on the words right before it only.
CONTEXT_WORDS = 8
BITMAP_BITS = 24

#: Unit words, lower-cased; the second list is ambiguous in prose and
#: counts right after a number only.
UNITS = (
    "mm cm km mi inch inches mile miles meter meters metre metres kilometer kilometers kilometre kilometres kg mg lb lbs oz "
    "gram grams kilogram kilograms ounce ounces tonne tonnes ml liter liters litre litres gallon gallons minute minutes hour "
    "hours percent celsius fahrenheit kelvin usd eur dollar dollars cents euro euros hz khz mhz ghz kw kwh kj kcal volt volts "
    "mph kmh km/h m/s"
).split()
UNITS_AFTER_NUMBERS = (
    "in m g k s h w j a v l ft yd foot feet yard yards pound pounds ton tons min mins sec secs second seconds hr hrs day days "
    "week weeks month months year years degrees cent cal amp amps % $ € £"
).split()

NUMBER, NAME, UNIT = (textkit.mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))
PLACEHOLDERS = np.array(sorted([NUMBER, NAME, UNIT]), np.uint64)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,-+/:"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Bytes that do not belong to a word when they stand at its ends.
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>*_"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and U+00C0-U+00DE lower-cased."""
    out = data + np.where(_UPPER[data], 32, 0).astype(np.uint8)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    capital = after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[capital] += 32
    return out


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(textkit.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))[0])


UNIT_HASHES, AFTER_NUMBER_HASHES = _hashes(UNITS), _hashes(UNITS_AFTER_NUMBERS)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values if len(table) else np.zeros(len(values), bool)


def templates(data: np.ndarray, breaks: np.ndarray, begins: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, value hash, start of each word, and whether a sentence starts there.

    Words of edge punctuation alone are left out. The value hash stands for what a
    placeholder replaces. ``begins`` says whether the first word starts a sentence.
    """
    _, at, to = textkit.word_hashes(data, breaks)
    if not len(at):
        empty = np.zeros(0, np.uint64)
        return empty, empty, at, np.zeros(0, bool)
    whole_at, whole_to = at.copy(), to.copy()
    while len(trim := np.flatnonzero((at < to) & _EDGE[data[np.minimum(at, len(data) - 1)]])):
        at[trim] += 1
    while len(trim := np.flatnonzero((at < to) & _EDGE[data[to - 1]])):
        to[trim] -= 1
    ended = np.zeros(len(at), bool)
    ended[0] = begins
    new_line = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 10, out=new_line[1:])
    ended[1:] = _STOP[data[whole_to[:-1] - 1]] | (new_line[whole_at[1:]] > new_line[whole_to[:-1]])
    if len(breaks):
        ended[np.searchsorted(whole_at, breaks[breaks <= whole_at[-1]])] = True
    full = to > at
    carried = np.maximum.accumulate(np.where(full, np.arange(len(at)), -1))  # a lone mark hands its sentence end on
    ended |= np.concatenate([[begins], ~full[:-1] & ended[:-1] | begins & (carried[:-1] < 0)])
    at, to, start = at[full], to[full], ended[full]
    if not len(at):
        empty = np.zeros(0, np.uint64)
        return empty, empty, at, start
    low = _lower(data)
    up, down = textkit._POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(textkit.BYTE_VALUES[low] * up[: len(data)], out=sums[1:])
    value = textkit.mix((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64))

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total[to] - total[at]

    number = (within(_NUMERIC[data]) == to - at) & (within(_DIGIT[data]) > 0)
    first, second = data[at], data[np.minimum(at + 1, len(data) - 1)]
    capital = _UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    small = ((data >= 97) & (data <= 122)) | (np.concatenate([[False], data[:-1] == 0xC3]) & (data >= 0x9F))
    unit = _member(value, UNIT_HASHES)
    unit[1:] |= _member(value[1:], AFTER_NUMBER_HASHES) & number[:-1]
    name = capital & ~start & (within(small) > 0)  # words in capitals throughout are no names
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    return template, value, at, start


def _windows(template: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and usability of the windows inside one row."""
    n = len(template) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    total = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        total = textkit.mix(total + template[k : n + k] + U64(0x9E3779B97F4A7C15))
    literal = (~_member(template, PLACEHOLDERS)).astype(np.int32)
    sums = np.concatenate([[0], np.cumsum(literal)])
    whole = np.flatnonzero(rows[:n] == rows[WINDOW - 1 :])
    return total[whole], whole, (sums[whole + WINDOW] - sums[whole]) > 0


def _row_templates(column: pa.Array, block_bytes: int = textkit.BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, end row, templates, values, sentence starts, row of each word)`` block by block."""
    data, offsets = textkit.text_buffer(column)
    for row, end in textkit.blocks(offsets, block_bytes):
        own = data[offsets[row] : offsets[end]]
        if end > row + 1:
            inner = offsets[row : end + 1] - offsets[row]
            template, value, at, start = templates(own, inner[1:-1][inner[1:-1] < len(own)])
            yield row, end, template, value, start, np.searchsorted(inner, at, side="right") - 1
        else:
            parts = []
            for a, b in textkit.pieces(own, block_bytes):
                seen = textkit.words_before(own, a, CONTEXT_WORDS) if a else 0
                found = templates(own[seen:b], np.zeros(0, np.int64), not a)
                fresh = found[2] >= a - seen
                parts.append([x[fresh] for x in found])
            t = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            v = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
            start = np.concatenate([p[3] for p in parts]) if parts else np.zeros(0, bool)
            yield row, end, t, v, start, np.zeros(len(t), np.int64)


def _slots(template: np.ndarray, value: np.ndarray, at: int) -> list[int]:
    """Values behind the placeholders of one window, in order."""
    span = slice(at, at + WINDOW)
    return value[span][_member(template[span], PLACEHOLDERS)].view(np.int64).tolist()


_SLOTTED = "window long, place long, slots array<long>"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, item_windows, item_words, window, item_place, item_slots``; ``item_windows``
    is the number of an item's usable windows. Short items have one window of all words,
    and one of their values besides where they are placeholders alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for first, end, template, value, _, rows in _row_templates(batch.column(1)):
                h, at, usable = _windows(template, rows)
                owner = rows[at] if len(at) else at
                for r in range(end - first):
                    own = np.flatnonzero(owner == r)
                    start = int(np.searchsorted(rows, r))
                    words = int(np.searchsorted(rows, r, side="right")) - start
                    if not words:
                        continue
                    item = batch.column(0)[first + r].as_py()
                    if words < WINDOW:
                        span = slice(start, start + words)
                        hashes = [template[span], value[span]] if _member(template[span], PLACEHOLDERS).all() else [template[span]]
                        out += [(item, 1, words, int(_short(x, words).view(np.int64)[0]), 0, []) for x in hashes]
                        continue
                    own = own[usable[own]] if usable[own].any() else own
                    for k in own:
                        out.append((item, len(own), words, int(h[k].view(np.int64)), int(at[k] - start), _slots(template, value, int(at[k]))))
            names = ["item_id", "item_windows", "item_words", "window", "item_place", "item_slots"]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(6)], names)

    kind = benchmark.select("item_id").dtypes[0][1]
    return benchmark.select("item_id", "text").mapInArrow(
        thrifty(run), f"item_id {kind}, item_windows long, item_words long, window long, item_place long, item_slots array<long>"
    )


def _short(template: np.ndarray, size: int) -> np.ndarray:
    """The values of the windows of ``size`` words, fewer than five."""
    n = len(template) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        total = textkit.mix(total + template[k : n + k] + U64(0x2545F4914F6CDD1D))
    return textkit.mix(total + U64(size))


def _sentence_windows(template: np.ndarray, value: np.ndarray, start: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and first word of the windows of ``size`` words between two sentence ends
    of a row. Placeholders alone stand for their values unless they are the whole row."""
    n = len(template) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    other = rows[1:] != rows[:-1]
    first, last = np.concatenate([[True], other]), np.concatenate([other, [True]])
    ends = last | np.append(start[1:], True)
    at = np.flatnonzero((start | first)[:n] & ends[size - 1 :] & (rows[:n] == rows[size - 1 :]))
    sums = np.concatenate([[0], np.cumsum(_member(template, PLACEHOLDERS))])
    slots_only = (sums[at + size] - sums[at] == size) & ~(first[at] & last[at + size - 1])
    return np.where(slots_only, _short(value, size)[at], _short(template, size)[at]), at


def _bits(windows: np.ndarray) -> np.ndarray:
    return (textkit.mix(windows.view(np.uint64)) >> U64(64 - BITMAP_BITS)).astype(np.int64)


def window_bitmap(items: DataFrame) -> np.ndarray:
    """A bitmap (one byte a bit, 16 MiB) of the items' windows, OR-ed in tasks; each
    task sends its packed 2 MiB, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITMAP_BITS, bool)
        for batch in batches:
            bits[_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    total = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in items.select("window").coalesce(16).mapInArrow(thrifty(run), "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return total


def candidate_windows(documents: DataFrame, bitmap: np.ndarray, short_words: set[int]) -> DataFrame:
    """``doc_id, digest, window, place, slots`` of the documents' windows in the bitmap.

    Whole sentences of fewer than five words count as windows too where an item is
    that short.
    """
    shared = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            texts = batch.column(1)
            data, offsets = textkit.text_buffer(texts)
            for first, end, template, value, start, rows in _row_templates(texts):
                h, at, _ = _windows(template, rows)
                hit = np.flatnonzero(listed[_bits(h)]) if len(h) else np.zeros(0, np.int64)
                windows, places, slots = h[hit].view(np.int64).tolist(), at[hit], [_slots(template, value, int(p)) for p in at[hit]]
                for size in short_words:
                    short, k = _sentence_windows(template, value, start, rows, size)
                    met = np.flatnonzero(listed[_bits(short)]) if len(short) else np.zeros(0, np.int64)
                    windows += short[met].view(np.int64).tolist()
                    places = np.concatenate([places, k[met]])
                    slots += [[]] * len(met)
                if not windows:
                    continue
                owner = rows[places]
                digest = {int(r): hashlib.md5(data[offsets[first + r] : offsets[first + r + 1]]).digest() for r in np.unique(owner)}
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner + first)),
                        pa.array([digest[int(r)] for r in owner], pa.binary()),
                        pa.array(windows, pa.int64()),
                        pa.array(places - np.searchsorted(rows, owner)),
                        pa.array(slots, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "digest", "window", "place", "slots"],
                )

    kind = documents.select("doc_id").dtypes[0][1]
    return small_batches(documents).select("doc_id", "text").mapInArrow(thrifty(run), f"doc_id {kind}, digest binary, window long, place long, slots array<long>")


def _agreeing(windows: str) -> Column:
    """The windows of an alignment without those that hold an outvoted slot."""
    slots = F.flatten(F.transform(windows, lambda w: w["slots"]))

    def outvoted(found: Column, bound: Column) -> Column:
        torn = F.filter(bound, lambda s: F.size(F.filter(bound, lambda t: t["item"] == s["item"])) > 1)
        votes = F.transform(
            torn,
            lambda s: F.struct(
                s["item"].alias("item"),
                F.struct(F.size(F.filter(found, lambda t: t == s)).alias("n"), (s["item"] == s["doc"]).alias("own"), s["doc"].alias("doc")).alias("rank"),
            ),
        )
        lost = let(votes, lambda v: F.filter(v, lambda x: F.exists(v, lambda y: (y["item"] == x["item"]) & (y["rank"] > x["rank"]))))
        return F.transform(lost, lambda x: F.struct(x["item"].alias("item"), x["rank"]["doc"].alias("doc")))

    def kept(found: Column, bound: Column) -> Column:
        consistent = F.size(bound) == F.size(F.array_distinct(F.transform(bound, lambda s: s["item"])))
        without = let(outvoted(found, bound), lambda lost: F.filter(windows, lambda w: ~F.exists(w["slots"], lambda s: F.array_contains(lost, s))))
        return F.when(consistent, F.col(windows)).otherwise(without)

    return let(slots, lambda found: let(F.array_distinct(found), lambda bound: kept(found, bound)))


def find_contamination(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``doc_id, digest, item_id, n_windows, item_windows, longest_run, reworded`` of the
    contaminated pairs. ``reworded`` says that slot values differ."""
    items = written(item_windows(benchmark), "item-windows")
    short_words = {r[0] for r in items.where(F.col("item_words") < WINDOW).select("item_words").distinct().collect()}
    found = candidate_windows(documents, window_bitmap(items), short_words)
    pair = ["doc_id", "digest", "item_id"]
    met = found.join(items, "window").where(F.size("slots") == F.size("item_slots")).select(
        *pair,
        (F.col("place") - F.col("item_place")).alias("shift"),
        "item_place",
        "item_windows",
        "item_words",
        F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc"))).alias("slots"),
    )
    aligned = met.groupBy(*pair, "shift").agg(
        F.collect_set(F.struct(F.col("item_place").alias("place"), "slots")).alias("windows"),
        F.first("item_windows").alias("item_windows"),
        F.first("item_words").alias("item_words"),
    )
    agreeing = aligned.withColumn("windows", _agreeing("windows")).where(F.size("windows") > 0)
    pairs = agreeing.groupBy(*pair).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.transform("windows", lambda w: w["place"]))))).alias("places"),
        F.max(F.exists("windows", lambda w: F.exists(w["slots"], lambda s: s["item"] != s["doc"]))).alias("reworded"),
        F.first("item_windows").alias("item_windows"),
        F.first("item_words").alias("item_words"),
    )
    run = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("now"), F.lit(-2).cast("long").alias("last")),
        lambda acc, p: F.struct(
            F.greatest(acc["best"], F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(F.lit(1).cast("long"))).alias("best"),
            F.when(p == acc["last"] + 1, acc["now"] + 1).otherwise(F.lit(1).cast("long")).alias("now"),
            p.alias("last"),
        ),
        lambda acc: acc["best"],
    )
    judged = pairs.withColumn("longest_run", run).withColumn("n_windows", F.size("places").cast("long"))
    enough = (F.col("n_windows") >= coverage * F.col("item_windows")) | (F.col("longest_run") >= passage_words - WINDOW + 1)
    return judged.where(enough).select(*pair, "n_windows", "item_windows", "longest_run", "reworded")


def judge_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, n_items, items`` for every document; ``items`` joins the
    item ids in order by commas."""
    hits = find_contamination(documents, benchmark).groupBy("doc_id", "digest").agg(
        F.count("*").alias("n_items"), F.array_join(F.transform(F.sort_array(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items")
    )
    rows = documents.select("doc_id", F.unhex(F.md5("text")).alias("digest"))
    same = rows.doc_id.eqNullSafe(hits.doc_id) & (rows.digest == hits.digest)
    return rows.join(hits, same, "left").select(
        rows.doc_id, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no benchmark item."""
    documents, restore = plain_columns(documents, "doc_id", "text")
    hits = find_contamination(documents, benchmark).select(F.col("doc_id").alias("_hit_id"), F.col("digest").alias("_hit_digest")).distinct()
    same = documents["doc_id"].eqNullSafe(F.col("_hit_id")) & (F.unhex(F.md5(documents["text"])) == F.col("_hit_digest"))
    return restore(documents.join(sized(hits), same, "left_anti"))
