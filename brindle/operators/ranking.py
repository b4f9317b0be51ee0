"""Embedding look-ups, preranking, decisions and calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

KEEP_CONTEXT, KEEP_TOTAL = 3, 7


def unknown_vectors(vectors: DataFrame, kind: str = "kind") -> DataFrame:
    """Element-wise mean vector of each kind (``kind, emb``)."""
    each = vectors.select(kind, F.posexplode("emb").alias("pos", "x")).groupBy(kind, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(kind).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("emb"))


def appended_vectors(vectors: DataFrame, more: DataFrame) -> DataFrame:
    """The vectors and those of ``more`` whose words are new."""
    return vectors.select("word", "emb").unionByName(more.join(vectors.select("word"), "word", "left_anti").select("word", "emb"))


def vocabulary(words: DataFrame) -> DataFrame:
    """``word, id``: distinct words numbered from 0 in their order."""
    return words.select("word").distinct().withColumn("id", F.row_number().over(Window.orderBy("word")) - 1)


def word_ids(tokens: DataFrame, known: DataFrame, unknown: int = -1) -> DataFrame:
    """Adds ``id`` by ``word``; unknown words get that of the unknown word."""
    return tokens.join(known.select("word", "id"), "word", "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def context_mean(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ctx``: the mean vector of a group's token vectors (``emb``)."""
    each = tokens.select(*keys, F.posexplode("emb").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("ctx"))


#: Vectors of a block; a pair of blocks is one matrix product.
BLOCK_VECTORS = 4096


def _blocks(rows: DataFrame) -> DataFrame:
    """``ids, matrix`` of blocks of ``rows`` (``id, emb``), as they stand in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(at, BLOCK_VECTORS)
                matrix = np.asarray(part.column("emb").to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())], ["ids", "matrix"])

    return rows.where("id IS NOT NULL AND emb IS NOT NULL").select("id", "emb").mapInArrow(run, "ids array<long>, matrix binary")


def top_products(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``qid, id, rank, score``: the ``k`` rows of the largest dot product with each query, of
    equal ones the smaller id. Both have ``id, emb``. Blocks of queries meet blocks of rows;
    a pair of blocks keeps k rows a query, so few scores are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, left, ids, right in zip(*(batch.column(n).to_pylist() for n in ("asked", "left", "ids", "right"))):
                scores = np.frombuffer(left).reshape(len(asked), -1) @ np.frombuffer(right).reshape(len(ids), -1).T
                own, most = np.asarray(ids), min(k, len(ids))
                order = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :most]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asked, most)), pa.array(own[order].ravel()), pa.array(np.take_along_axis(scores, order, axis=1).ravel())], ["qid", "id", "score"]
                )

    pairs = _blocks(rows).select("ids", F.col("matrix").alias("right")).crossJoin(_blocks(queries).select(F.col("ids").alias("asked"), F.col("matrix").alias("left")))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return pairs.mapInArrow(run, "qid long, id long, score double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def prerank(cands: DataFrame, keys: list[str], keep_context: int = KEEP_CONTEXT, keep_total: int = KEEP_TOTAL) -> DataFrame:
    """Rows of each mention that stay: the best by ``ctx_score`` and, in candidate order
    (``idx``), as many more as make ``keep_total`` together."""
    own = Window.partitionBy(*keys)
    ranked = cands.withColumn("ctx_rank", F.row_number().over(own.orderBy(F.desc("ctx_score"), "idx")))
    won = ranked.withColumn("by_ctx", F.col("ctx_rank") <= keep_context)
    fill = F.row_number().over(Window.partitionBy(*keys, "by_ctx").orderBy("idx"))
    winners = F.least(F.count("*").over(own), F.lit(keep_context))
    return won.withColumn("_fill", fill).withColumn("_room", keep_total - winners).where(F.col("by_ctx") | (F.col("_fill") <= F.col("_room"))).drop("_fill", "_room")


def first_best(scored: DataFrame, keys: list[str], score: str = "score", pad: str = "#UNK#") -> DataFrame:
    """``keys, entity, score`` of the best candidate, the first of equals; ``NIL`` where a
    padding entry wins."""
    best = scored.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("score"), (-F.col("idx")).alias("neg"), "entity")).alias("b"))
    return best.select(*keys, F.when(F.col("b.entity") == pad, F.lit("NIL")).otherwise(F.col("b.entity")).alias("entity"), F.col("b.score").alias("score"))


def confidence(score: Column, weight: float, bias: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(weight) * score + F.lit(bias))))


def hinge_confidence(scores: Column, best: Column) -> Column:
    """One minus the mean hinge of the other scores against the best one."""
    loss = F.aggregate(F.transform(scores, lambda s: F.greatest(F.lit(0.0), s - best + 1.0)), F.lit(0.0), lambda acc, x: acc + x)
    return 1.0 - loss / F.greatest(F.size(scores).cast("double"), F.lit(1.0))


def fit_calibration(rows: DataFrame, c: float = 1.0) -> tuple[float, float]:
    """(weight, bias) of a logistic fit of ``label`` on ``score``: L2 with strength 1/(n c),
    the intercept unpenalised, no standardisation."""
    data = VectorAssembler(inputCols=["score"], outputCol="features").transform(rows.select(F.col("score").cast("double"), F.col("label").cast("double")))
    n = data.count()
    model = LogisticRegression(regParam=1.0 / (n * c), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(data)
    return float(model.coefficients[0]), float(model.intercept)


def thresholded_f1(rows: DataFrame, threshold: float = 0.3) -> DataFrame:
    hit = F.col("prob") >= threshold
    out = rows.agg(F.count_if(hit & (F.col("label") == 1)).alias("tp"), F.count_if(hit).alias("found"), F.count_if(F.col("label") == 1).alias("gold"))
    return out.withColumn("f1", F.try_divide(2.0 * F.col("tp"), F.col("found") + F.col("gold")))


def decode(names: Column, mask: Column, scores: Column) -> Column:
    """The candidate with the best score (the first of equals); candidate 0 where padding
    wins, ``NIL`` where that is padding too."""
    best = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return F.when(F.get(mask, best) == 1, F.get(names, best)).when(F.get(mask, F.lit(0)) == 1, F.get(names, F.lit(0))).otherwise(F.lit("NIL"))


def log_probabilities(cands: DataFrame, keys: list[str], score: str = "ctx_score") -> DataFrame:
    """``score`` replaced by its log-softmax over the candidates of each mention."""
    own = Window.partitionBy(*keys)
    top = F.max(score).over(own)
    return cands.withColumn(score, F.col(score) - top - F.log(F.sum(F.exp(F.col(score) - top)).over(own)))
