"""Sentences, n-gram mentions and the ordered lookup of mention spellings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: A sentence ends at a line end, or at . ? ! before white space and a capital, quote or
#: digit, unless a short capitalised abbreviation stands before the dot.
SENTENCE_END = r"\n+|(?<=[.?!])(?<!\b[A-Z][a-z]?\.)\s+(?=[\p{Lu}\"'(0-9])"


def _cut(text: Column, boundary: str) -> Column:
    """``array<struct<sentence, pos_start>>`` of a text's sentences that are not blank."""
    parts, gaps = F.split(text, boundary, -1), F.regexp_extract_all(text, F.lit(boundary), F.lit(0))
    sizes = F.zip_with(parts, gaps, lambda s, g: F.length(s) + F.coalesce(F.length(g), F.lit(0)))

    def placed(cut: Column) -> Column:
        return F.zip_with(cut, X.exclusive_sums(sizes), lambda s, at: F.struct(s.alias("sentence"), at.cast("int").alias("pos_start")))

    return X.named(parts, lambda cut: F.filter(placed(cut), lambda x: F.trim(x["sentence"]) != ""))


def sentence_list(text: Column, boundary: str = SENTENCE_END) -> Column:
    """``array<struct<sentence, pos_start>>`` of a text, as ``sentences`` numbers them."""
    return _cut(F.coalesce(text, F.lit("")), boundary)


def sentences(docs: DataFrame, boundary: str = SENTENCE_END, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, sent_idx, sentence, pos_start, pos_end`` (code points of the document).

    Offsets are sums of the lengths of sentences and boundaries, taken inside the row: no
    search and no shuffle. Blank sentences are dropped before numbering.
    """
    rows = docs.select("doc_id", *carry, F.posexplode(sentence_list(F.col("text"), boundary)).alias("sent_idx", "x"))
    return rows.select("doc_id", *carry, "sent_idx", "x.sentence", "x.pos_start", (F.col("x.pos_start") + F.length("x.sentence")).alias("pos_end"))


def place_number(document: str, *order: str) -> Column:
    """0, 1, 2, ... of the mentions of a document."""
    return F.row_number().over(Window.partitionBy(document).orderBy(*order)) - 1


def spans_in_sentences(spans: DataFrame, sents: DataFrame) -> DataFrame:
    """Given spans (``doc_id, start, length``) with the sentence they start in."""
    inside = (F.col("s.doc_id") == F.col("x.doc_id")) & (F.col("x.start") >= F.col("s.pos_start")) & (F.col("x.start") < F.col("s.pos_end"))
    return spans.alias("x").join(sents.alias("s"), inside).select("x.*", "s.sent_idx", "s.sentence", "s.pos_start")


PUNCTUATION = re.compile(r"[\W_]+")


#: Bits of the filter over the spellings of an index: a fixed size, whatever the index has.
FILTER_BITS = 26


def _bit(crc: int) -> int:
    return crc & ((1 << FILTER_BITS) - 1)


class SpellingFilter:
    """Which n-grams may be found in an index: a bitmap over its lower-cased spellings and
    the most words one has. It passes some others, and loses none."""

    def __init__(self, bits: bytes, words: int):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, index: DataFrame) -> SpellingFilter:
        """Every task sends its bitmap (8 MiB, deflated), one after another."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = np.zeros(1 << FILTER_BITS, bool)
            words = 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    if text:
                        flags[_bit(zlib.crc32(text.lower().encode()))] = True
                        words = max(words, len(text.split()))
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)], pa.binary()), pa.array([words])], ["bits", "words"])

        total, words = np.zeros(1 << (FILTER_BITS - 3), np.uint8), 0
        for row in index.select("mention").coalesce(8).mapInArrow(run, "bits binary, words long").toLocalIterator(prefetchPartitions=True):
            total |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
            words = max(words, row.words)
        return cls(total.tobytes(), words)

    def may_hold(self, crc: int) -> bool:
        """Whether a spelling with this checksum of its lower-cased text may be known."""
        k = _bit(crc)
        return bool(self.bits[k >> 3] >> (k & 7) & 1)


STRIPPED = str.maketrans("", "", X.NOISE)


def _sizes(tokens: list[str], clean: list[bool], at: int, n: int, passes: SpellingFilter | None) -> Iterator[int]:
    """Sizes of the n-grams that begin at a token and may be known. A checksum grows with its
    n-gram, so no text is made for those that are not."""
    crc, noisy = 0, False
    for size in range(1, n + 1):
        k = at + size - 1
        if k >= len(tokens) or not clean[k]:
            return
        if passes is None:
            yield size
            continue
        crc = zlib.crc32((" " + tokens[k] if size > 1 else tokens[k]).lower().encode(), crc)
        noisy = noisy or not NOISE.isdisjoint(tokens[k])
        if passes.may_hold(crc):
            yield size
        elif noisy:
            bare = " ".join(tokens[at : k + 1]).translate(STRIPPED).strip(" ")
            if passes.may_hold(zlib.crc32(bare.lower().encode())):
                yield size


NOISE = frozenset(X.NOISE)


def ngrams(sents: DataFrame, n: int = 5, known: SpellingFilter | None = None) -> DataFrame:
    """``doc_id, sent_idx, [carried,] size, start, ngram``: white-space n-grams with offsets in
    their sentence, each once; none holds a punctuation-only token. With a filter only those
    that an index may know, spelled as they are or without noise; columns of ``sents``
    other than the sentence are carried.

    An Arrow function: array expressions that grow a token list copy it for each token,
    which is quadratic on long lines.
    """
    carried = [c for c in sents.columns if c != "sentence"]
    shared = None if known is None else sents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = None if shared is None else shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                row: list[int] = []
                sizes: list[int] = []
                starts: list[int] = []
                texts: list[str] = []
                for k, sentence in enumerate(part.column("sentence").to_pylist()):
                    found = [(m.start(), m[0]) for m in re.finditer(r"\S+", sentence or "")]
                    tokens = [t for _, t in found]
                    clean = [PUNCTUATION.fullmatch(t) is None for t in tokens]
                    for at in range(len(tokens)):
                        for size in _sizes(tokens, clean, at, n, passes):
                            row.append(k)
                            sizes.append(size)
                            starts.append(found[at][0])
                            texts.append(" ".join(tokens[at : at + size]))
                index = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(index) for c in carried), pa.array(sizes, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())],
                    [*carried, "size", "start", "ngram"],
                )

    kind = dict(sents.dtypes)
    schema = ", ".join([*(f"{c} {kind[c]}" for c in carried), "size int", "start int", "ngram string"])
    return sents.select(*carried, "sentence").mapInArrow(run, schema)


def spelling_lookup(surfaces: DataFrame, index: DataFrame) -> DataFrame:
    """``surface, mention, freq`` of distinct surfaces, by the decision list below.

    1. v1 = title case of an all-caps surface, else the surface; unknown: the surface.
    2. The surface itself where it is more frequent.
    3. Still unknown: a stored mention equal but for case (the first by order).
    4. Still unknown: the surface without noise characters.
    Unknown means no or zero frequency. All variants are looked up in one join.
    """
    surface = F.col("surface")
    variants = F.array(
        F.struct(F.lit("v1").alias("how"), X.title_if_upper(surface).alias("key")),
        F.struct(F.lit("m").alias("how"), surface.alias("key")),
        F.struct(F.lit("t").alias("how"), X.strip_noise(surface).alias("key")),
    )
    asked = surfaces.select("surface").distinct().select("surface", F.explode(variants).alias("v")).select("surface", "v.how", "v.key")
    exact = asked.join(index.select(F.col("mention").alias("key"), "freq"), "key", "left")
    folded = index.groupBy("lower").agg(F.min(F.struct("mention", "freq")).alias("low"))
    wide = exact.groupBy("surface").agg(
        *[F.max(F.when(F.col("how") == h, F.col("key"))).alias(h) for h in ("v1", "t")],
        *[F.coalesce(F.max(F.when(F.col("how") == h, F.col("freq"))), F.lit(0)).alias(f"f_{h}") for h in ("v1", "m", "t")],
    )
    wide = wide.join(folded, F.lower("surface") == F.col("lower"), "left")
    v1_first = (F.col("f_v1") > 0) & ~(F.col("f_m") > F.col("f_v1"))
    low_known = F.coalesce(F.col("low.freq"), F.lit(0)) > 0
    mention = (
        F.when(v1_first, F.col("v1"))
        .when(F.col("f_m") > 0, surface)
        .when(low_known, F.col("low.mention"))
        .when(F.col("f_t") > 0, F.col("t"))
        .otherwise(F.coalesce("low.mention", surface))
    )
    freq = F.when(v1_first, F.col("f_v1")).when(F.col("f_m") > 0, F.col("f_m")).when(low_known, F.col("low.freq")).otherwise(F.col("f_t"))
    return wide.select("surface", mention.alias("mention"), freq.alias("freq"))


def longest_mentions(known: DataFrame) -> DataFrame:
    """Known n-grams of a sentence, longest first, without those nested in an accepted one.

    ``known`` has ``doc_id, sent_idx, size, start, ngram`` and columns to carry. A shorter
    n-gram is dropped if it is part of an accepted text and their ranges meet; partly
    overlapping ones both stay. The order matters, so it is a fold over a sentence's sorted
    n-grams; accepted ones are kept by the stretches of text they touch, so it is linear.
    """
    more = [c for c in known.columns if c not in ("doc_id", "sent_idx", "size", "start", "ngram")]
    cells = F.struct((-F.col("size")).alias("rank"), "start", "ngram", *more)
    grouped = known.groupBy("doc_id", "sent_idx").agg(F.sort_array(F.collect_list(cells)).alias("cells"))
    places = F.transform("cells", lambda c: F.struct(c["start"].alias("start"), c["ngram"].alias("ngram")))

    @F.pandas_udf("array<int>")
    def accepted(lists: pd.Series) -> pd.Series:
        out = []
        for cells in lists:
            touched: dict[int, list[tuple[int, int, str]]] = {}
            kept = []
            for k, cell in enumerate(cells):
                text, start = cell["ngram"], cell["start"]
                end = start + len(text)
                stretches = range(start // 64, (end - 1) // 64 + 1)
                if any(text in t and start < e and s < end for j in stretches for s, e, t in touched.get(j, ())):
                    continue
                for j in stretches:
                    touched.setdefault(j, []).append((start, end, text))
                kept.append(k)
            out.append(kept)
        return pd.Series(out)

    chosen = grouped.select("doc_id", "sent_idx", "cells", F.explode(accepted(places)).alias("k"))
    rows = chosen.select("doc_id", "sent_idx", F.col("cells")[F.col("k")].alias("x"))
    return rows.select("doc_id", "sent_idx", (-F.col("x.rank")).alias("size"), *[f"x.{c}" for c in ("start", "ngram", *more)])


def ngram_mentions(docs: DataFrame, index: DataFrame, n: int = 5) -> DataFrame:
    """``doc_id, sent_idx, pos, surface, mention, freq, tag`` found by the n-gram tagger.

    Whatever the decision list finds equals the n-gram, or the n-gram without noise, but for
    case; so a filter over the index's spellings stops all others where they arise. Positions
    and what was found travel with the n-grams.
    """
    sents = sentences(docs).select("doc_id", "sent_idx", "pos_start", "sentence")
    known = SpellingFilter.of(index)
    grams = ngrams(sents, min(n, max(known.words, 1)), known)
    spelled = spelling_lookup(grams.select(F.col("ngram").alias("surface")), index).where("freq > 0")
    met = grams.join(spelled.select(F.col("surface").alias("ngram"), "mention", "freq"), "ngram")
    return longest_mentions(met).select(
        "doc_id",
        "sent_idx",
        (F.col("pos_start") + F.col("start")).alias("pos"),
        F.col("ngram").alias("surface"),
        "mention",
        "freq",
        F.lit("#NGRAM#").alias("tag"),
    )


def candidate_lists(mentions: DataFrame, index: DataFrame, k: int = 100, keep_empty: bool = False) -> DataFrame:
    """Adds ``cands`` (at most k) to mentions; without any they go unless kept."""
    joined = mentions.join(index.select("mention", F.slice("cands", 1, k).alias("cands")), "mention", "left")
    empty = F.array().cast("array<struct<entity:string,p:double>>")
    joined = joined.withColumn("cands", F.coalesce("cands", empty))
    return joined if keep_empty else joined.where(F.size("cands") > 0)


def clamp(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-3), p))
