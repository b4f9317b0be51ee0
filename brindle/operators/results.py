"""Results, evaluation and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_results(mentions: DataFrame, predictions: DataFrame) -> DataFrame:
    """``doc_id, start, length, ngram, entity, conf_ed, conf_md, tag`` by (doc_id,
    mention_ord); ``NIL`` predictions are left out."""
    joined = mentions.join(predictions, ["doc_id", "mention_ord"]).where("entity <> 'NIL'")
    return joined.select("doc_id", F.col("pos").alias("start"), F.length("ngram").alias("length"), "ngram", "entity", "conf_ed", "conf_md", "tag")


def response(results: DataFrame) -> DataFrame:
    """``doc_id, body``: the JSON list of a document's result rows, by start."""
    cells = ("start", "length", "ngram", "entity", "conf_ed", "conf_md", "tag")
    nested = results.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*cells))).alias("r"))
    return nested.select("doc_id", F.to_json("r").alias("body"))


def micro_scores(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``tp, n_pred, n_gold, n_nil, precision, recall, f1`` of (gold, pred) rows. NIL
    predictions do not count as found; all gold rows do. Zero denominators give null."""
    hit = (F.col("gold") == F.col("pred")) & (F.col("pred") != "NIL")
    sums = [
        F.count_if(hit).alias("tp"),
        F.count_if(F.col("pred") != "NIL").alias("n_pred"),
        F.count("*").alias("n_gold"),
        F.count_if(F.col("pred") == "NIL").alias("n_nil"),
    ]
    out = pairs.groupBy(*by).agg(*sums) if by else pairs.agg(*sums)
    precision, recall = F.try_divide("tp", "n_pred"), F.try_divide("tp", "n_gold")
    return out.withColumns({"precision": precision, "recall": recall, "f1": F.try_divide(2 * precision * recall, precision + recall)})


def candidate_recall(mentions: DataFrame) -> DataFrame:
    """Share of mentions whose ``gold`` is among the candidates."""
    has = F.exists("cands", lambda c: c["entity"] == F.col("gold"))
    return mentions.agg(F.count_if(has).alias("has_gold"), F.count("*").alias("total")).withColumn("recall", F.try_divide("has_gold", "total"))


def timing_statistics(log: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """Mean, population deviation and sum of columns."""
    cells = []
    for c in columns:
        cells += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.sum(c).alias(f"{c}_sum")]
    return log.groupBy(*by).agg(*cells)


def mentions_by_document(mentions: DataFrame) -> DataFrame:
    """``doc_id, n_mentions, mentions``: each document's mention rows in order, and their number."""
    nested = F.sort_array(F.collect_list(F.struct("mention_ord", *[c for c in mentions.columns if c not in ("doc_id", "mention_ord")])))
    return mentions.groupBy("doc_id").agg(F.count("*").alias("n_mentions"), nested.alias("mentions"))


def relocated(results: DataFrame, sents: DataFrame, docs: DataFrame) -> DataFrame:
    """Result rows (``doc_id, sent_idx, start`` in the sentence, ...) with ``start`` counted in
    the document: where the sentence's text first stands there."""
    rows = results.join(sents.select("doc_id", "sent_idx", "sentence"), ["doc_id", "sent_idx"]).join(docs.select("doc_id", "text"), "doc_id")
    return rows.withColumn("start", F.col("start") + F.expr("locate(sentence, text) - 1")).drop("sentence", "text")


def sentence_only(mentions: DataFrame) -> DataFrame:
    """Mentions with contexts cut to their own sentence and all text lower-cased, as linkers
    without document context take them."""
    left, right = F.expr("substring(sentence, 1, start)"), F.expr("substring(sentence, end + 1, length(sentence))")
    return mentions.withColumns({"left_ctx": F.lower(F.trim(left)), "right_ctx": F.lower(F.trim(right)), "surface": F.lower("surface")})
