"""Model inputs of mentions: candidates, context words and their vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import ranking

PAD = "#UNK#"
ENTITY = "ENTITY/"
UNKNOWN = {"word": "#WORD/UNK#", "entity": "#ENTITY/UNK#", "near": "#SND/UNK#"}
MAX_CANDIDATES, CONTEXT_WORDS, PRERANK_WORDS, NEAR_WORDS = 30, 50, 25, 3


def entity_word(name: Column) -> Column:
    """The key of an entity among the vectors."""
    return F.concat(F.lit(ENTITY), name)


def entity_name(word: Column) -> Column:
    return F.regexp_replace(word, f"^{ENTITY}", "")


def require_unknown(vectors: DataFrame) -> DataFrame:
    """The vectors, once the rows that stand for unknown words are there; raises otherwise."""
    there = {r[0] for r in vectors.where(F.col("word").isin(*UNKNOWN.values())).select("word").distinct().collect()}
    if missing := sorted(set(UNKNOWN.values()) - there):
        raise ValueError(f"the vectors have no rows for unknown words: {missing}")
    return vectors


def candidate_cells(mentions: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """``doc_id, mention_ord, idx, entity, p``: the first ``most`` candidates, p clamped."""
    rows = mentions.select("doc_id", "mention_ord", F.posexplode(F.slice("cands", 1, most)).alias("idx", "c"))
    return rows.select("doc_id", "mention_ord", "idx", F.col("c.entity").alias("entity"), F.least(F.lit(1.0), F.greatest(F.lit(1e-3), F.col("c.p"))).alias("p"))


def context_words(side: Column) -> Column:
    """Telling words of a context."""
    return F.filter(X.tokens_with_separators(F.trim(side)), lambda w: X.is_important(w))


def near_words(mentions: DataFrame, n: int = NEAR_WORDS) -> dict[str, Column]:
    """The ``n`` white-space tokens left and right of a mention in its sentence, and its own.
    ``start`` and ``end`` are offsets in the sentence."""
    left = X.space_tokens(F.expr("substring(sentence, 1, start)"))
    right = X.space_tokens(F.expr("substring(sentence, end + 1, length(sentence))"))
    return {"left": X.tail(left, n), "inside": X.space_tokens(F.col("surface")), "right": F.slice(right, 1, n)}


def mention_words(mentions: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """``doc_id, chunk, mention_ord, names, prior`` and the words ``l, r, left, inside, right``
    of mentions with candidates: a few hundred bytes where their vectors take tens of kB."""
    first = F.slice("cands", 1, most)
    clamped = F.transform(first, lambda c: F.least(F.lit(1.0), F.greatest(F.lit(1e-3), c["p"])))
    sides = {"l": context_words(F.col("left_ctx")), "r": context_words(F.col("right_ctx"))} | near_words(mentions)
    fixed = [F.transform(first, lambda c: c["entity"]).alias("names"), clamped.alias("prior")]
    return mentions.where(F.size("cands") > 0).select("doc_id", "chunk", "mention_ord", *fixed, *[v.alias(k) for k, v in sides.items()])


class Vectors:
    """Vectors by word, as rows of one matrix."""

    def __init__(self, words: list[str], rows: list[bytes], dim: int):
        self.at = {w: k for k, w in enumerate(words)}
        self.matrix = np.frombuffer(b"".join(rows), np.float32).reshape(-1, dim)

    def of(self, words: list[str], other: str | None = None) -> np.ndarray:
        """The words' vectors; unknown words take that of ``other`` or drop out."""
        places = [self.at.get(w, -1 if other is None else self.at[other]) for w in words]
        return self.matrix[[k for k in places if k >= 0]].astype(float)


def _placed_words(role: str, words: Column) -> Column:
    return F.transform(words, lambda w, k: F.struct(F.lit(role).alias("role"), k.alias("place"), w.alias("word")))


def packed(vectors: DataFrame, wanted: Callable[[str], bool] | None = None) -> DataFrame:
    """``word, emb`` with the vectors' numbers as bytes (32-bit floats), which shuffles and
    Arrow functions carry without touching each number; those of the ``wanted`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array([wanted(w) for w in batch.column(0).to_pylist()], pa.bool_()))
            rows = [None if v is None else np.asarray(v, np.float32).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["word", "emb"])

    return vectors.select("word", "emb").mapInArrow(run, "word string, emb binary")


def unpacked(rows: list[bytes] | None, dim: int) -> np.ndarray:
    """Packed vectors as a matrix."""
    return np.frombuffer(b"".join(rows or ()), np.float32).reshape(-1, dim).astype(float)


def kept_candidates(scores: np.ndarray, keep_context: int, keep_total: int) -> list[int]:
    """The candidates that stay, in their order: the best by context, the first of the rest."""
    best = np.argsort(-scores, kind="stable")[:keep_context].tolist()
    rest = [k for k in range(len(scores)) if k not in best][: max(keep_total - len(best), 0)]
    return sorted(best + rest)


FEATURES = "names array<string>, prior array<double>, entities array<binary>, tokens array<binary>, left array<binary>, inside array<binary>, right array<binary>"


def mention_features(mentions: DataFrame, vectors: DataFrame, keep_context: int = ranking.KEEP_CONTEXT, keep_total: int = ranking.KEEP_TOTAL) -> DataFrame:
    """``doc_id, chunk, mention_ord, names, prior, entities, tokens, left, inside, right``.

    ``mentions`` has ``doc_id, mention_ord, chunk, sentence, start, end, surface, left_ctx,
    right_ctx, cands``; ``vectors`` has ``word, emb``, words and entities and the unknown
    ones. Context words without a vector drop out, the last and first ``CONTEXT_WORDS``
    stay; entities and near words without one take the unknown vector. Of the first
    ``MAX_CANDIDATES`` those stay, in their order, that are best by log-softmax of their
    product with the mean of the nearest context words, and the first others. One join
    finds all vectors of words, one those of entities; nothing is collected beyond one
    mention's own words and candidates.
    """
    key = ["doc_id", "mention_ord"]
    known = packed(vectors)
    unknown = {r.word: bytes(r.emb) for r in known.where(F.col("word").isin(*UNKNOWN.values())).collect()}
    dim = len(unknown[UNKNOWN["word"]]) // 4
    near = near_words(mentions)
    sides = list(near)
    roles = {"l": context_words(F.col("left_ctx")), "r": context_words(F.col("right_ctx"))}
    roles |= {k: F.when(F.size(v) > 0, v).otherwise(F.array(F.lit(UNKNOWN["near"]))) for k, v in near.items()}
    listed = F.concat(*[_placed_words(role, words) for role, words in roles.items()])
    cells = mentions.select(*key, F.explode(listed).alias("x")).select(*key, "x.role", "x.place", "x.word")
    found = cells.join(known, "word", "left").withColumn("emb", F.when(F.col("role").isin("l", "r"), F.col("emb")).otherwise(F.coalesce("emb", F.lit(unknown[UNKNOWN["near"]]))))

    def of(role: str) -> Column:
        own = F.sort_array(F.collect_list(F.when((F.col("role") == role) & F.col("emb").isNotNull(), F.struct("place", "emb"))))
        return F.transform(own, lambda x: x["emb"])

    words = found.groupBy(*key).agg(*[of(r).alias(r) for r in roles])
    cands = candidate_cells(mentions).withColumn("word", entity_word(F.col("entity"))).join(known, "word", "left")
    named = cands.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("idx", "entity", "p", F.coalesce("emb", F.lit(unknown[UNKNOWN["entity"]])).alias("emb")))).alias("c"))
    rows = mentions.select("doc_id", "chunk", "mention_ord").join(named, key).join(words, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, l, r in zip(*(batch.column(n).to_pylist() for n in ("c", "l", "r"))):
                left, right = l[-CONTEXT_WORDS:], r[:CONTEXT_WORDS]
                nearest = left[-PRERANK_WORDS:] + right[:PRERANK_WORDS] or [unknown[UNKNOWN["word"]]]
                scores = unpacked([x["emb"] for x in c], dim) @ unpacked(nearest, dim).mean(axis=0)
                kept = [c[k] for k in kept_candidates(scores, keep_context, keep_total)]
                out.append(([x["entity"] for x in kept], [x["p"] for x in kept], [x["emb"] for x in kept], left + right or [unknown[UNKNOWN["word"]]]))
            kinds = [pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            own = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            fixed = [batch.column(n) for n in ("doc_id", "chunk", "mention_ord")]
            yield pa.RecordBatch.from_arrays([*fixed, *own, *(batch.column(n) for n in sides)], ["doc_id", "chunk", "mention_ord", "names", "prior", "entities", "tokens", *sides])

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"doc_id {kind['doc_id']}, chunk {kind['chunk']}, mention_ord {kind['mention_ord']}, {FEATURES}")


def with_gold(features: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``gold``, the place of the right entity (``doc_id, mention_ord, gold`` names it)
    among the kept candidates; mentions without it there go (for training)."""
    named = gold.select("doc_id", "mention_ord", F.col("gold").alias("_gold"))
    place = F.array_position("names", F.col("_gold")).cast("int") - 1
    return features.join(named, ["doc_id", "mention_ord"]).withColumn("gold", place).where("gold >= 0").drop("_gold")


def gold_into_candidates(mentions: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """For training: a right entity (``gold``) that stands beyond the first ``most`` candidates
    takes the last of their places; mentions without candidates go."""
    beyond = F.element_at(F.filter("cands", lambda c: c["entity"] == F.col("gold")), 1)
    first = F.slice("cands", 1, most)
    late = F.exists("cands", lambda c: c["entity"] == F.col("gold")) & ~F.exists(first, lambda c: c["entity"] == F.col("gold"))
    return mentions.where(F.size("cands") > 0).withColumn("cands", F.when(late, F.concat(F.slice("cands", 1, most - 1), F.array(beyond))).otherwise(first))
