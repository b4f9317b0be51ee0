"""Gold corpora: token streams with mention marks to sentences and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import context, mentions


def token_rows(lines: DataFrame) -> DataFrame:
    """``file, doc, doc_name, dataset, ord, words, mark, mention, url, ends`` of a
    tab-separated token stream (``file, ord, line``).

    A ``-DOCSTART-`` line opens a document. Four fields: a marked token without a link; six
    or more: with one. A row that begins a mention stands for all its words, rows inside a
    mention for none; words in capitals get title case. A lone dot ends a sentence.
    """
    p = F.split("line", "\t")
    rows = lines.select("file", "ord", "line", p.alias("p"), F.col("line").contains("-DOCSTART-").alias("opens"))
    order = Window.partitionBy("file").orderBy("ord")
    rows = rows.withColumn("doc", F.sum(F.col("opens").cast("int")).over(order))
    part = F.regexp_extract("line", r"(\S*test[ab]\S*)", 1)
    name = F.when(F.col("opens"), F.when(part != "", F.regexp_replace(part, "[()]", "")).otherwise(F.substring("line", 13, 1_000_000)))
    rows = rows.withColumn("doc_name", F.last(name, ignorenulls=True).over(order)).where("NOT opens")
    dataset = F.when(F.col("doc_name").contains("testa"), "development").when(F.col("doc_name").contains("testb"), "test").otherwise("train")
    mark = F.get("p", F.lit(1))
    own = F.when(mark == "I", F.array().cast("array<string>")).otherwise(X.ascii_tokens(F.when(mark == "B", F.get("p", F.lit(2))).otherwise(F.col("p")[0])))
    return rows.select(
        "file",
        "doc",
        "doc_name",
        dataset.alias("dataset"),
        "ord",
        F.transform(own, X.title_if_upper).alias("words"),
        mark.alias("mark"),
        F.get("p", F.lit(2)).alias("mention"),
        F.when(F.size("p") >= 6, F.get("p", F.lit(4))).alias("url"),
        (F.col("p")[0] == ".").alias("ends"),
    )


def _parts(tokens: DataFrame) -> DataFrame:
    """Token rows of sentences: their number in the document and where their words begin."""
    order = Window.partitionBy("file", "doc").orderBy("ord")
    ended = F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = tokens.withColumn("part", ended).where("NOT ends AND size(words) > 0")
    number = F.dense_rank().over(Window.partitionBy("file", "doc").orderBy("part")) - 1
    inside = Window.partitionBy("file", "doc", "part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.array_join("words", " ")) + 1
    return kept.withColumn("sent_idx", number).withColumn("start", F.coalesce(F.sum(size).over(inside), F.lit(0)).cast("int"))


def gold_sentences(tokens: DataFrame) -> DataFrame:
    """``file, doc, sent_idx, sentence``; the closing dot is not part of a sentence."""
    grouped = _parts(tokens).groupBy("file", "doc", "sent_idx").agg(F.sort_array(F.collect_list(F.struct("ord", "words"))).alias("t"))
    text = F.array_join(F.flatten(F.transform("t", lambda x: x["words"])), " ")
    return grouped.select("file", "doc", "sent_idx", text.alias("sentence"))


def gold_mentions(tokens: DataFrame) -> DataFrame:
    """``file, doc, doc_name, dataset, mention_ord, sent_idx, start, mention, title`` of the
    rows that begin a linked mention; ``start`` is an offset in the sentence."""
    begins = _parts(tokens).where("mark = 'B' AND url IS NOT NULL AND url NOT IN ('', '--NME--')")
    order = Window.partitionBy("file", "doc").orderBy("ord")
    return begins.select(
        "file", "doc", "doc_name", "dataset", (F.row_number().over(order) - 1).alias("mention_ord"), "sent_idx", "start", "mention", X.title_from_url(F.col("url")).alias("title")
    )


def repaired_titles(gold: DataFrame, names: DataFrame, redirects: DataFrame) -> DataFrame:
    """Unknown gold titles replaced by their normalised, redirected form where that is known."""
    known = names.select(F.col("name").alias("_known")).distinct()
    fixed = gold.withColumn("_fixed", F.col("title"))
    from .kb import redirect_titles

    fixed = redirect_titles(fixed, redirects, "_fixed")
    fixed = fixed.join(known, F.col("title") == F.col("_known"), "left").withColumnRenamed("_known", "_own")
    fixed = fixed.join(known, F.col("_fixed") == F.col("_known"), "left")
    title = F.when(F.col("_own").isNull() & F.col("_known").isNotNull(), F.col("_fixed")).otherwise(F.col("title"))
    return fixed.withColumn("title", title).drop("_fixed", "_own", "_known")


def placed_annotations(annotations: DataFrame, texts: DataFrame, slack: int = 10) -> DataFrame:
    """Annotations (``doc_name, mention, title, start``) at their true offsets: the first
    occurrence of the surface from ``slack`` characters before the given start on."""
    joined = annotations.join(texts, "doc_name")
    at = F.expr(f"locate(mention, text, greatest(start - {slack}, 0) + 1)")
    return joined.withColumn("pos", at - 1).where("pos >= 0").withColumn("end_pos", F.col("pos") + F.length("mention")).drop("text")


def annotated_sentences(annotations: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences (``doc_id, sent_idx, sentence, pos_start, pos_end``) and gold mentions
    (``doc_id, mention_ord, sent_idx, sentence, start, surface, title``) of annotated raw texts.

    Lines are sentences. Of several annotations at one place the last counts. Raises where an
    annotation is not in its text, or in no line.
    """
    once = texts.groupBy("doc_name").agg(F.min("text").alias("text"))
    wanted = annotations.join(once.select("doc_name"), "doc_name", "left_semi")
    placed = placed_annotations(wanted, once)
    last = Window.partitionBy("doc_name", "pos").orderBy(F.desc("annotation_ord"))
    single = placed.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    sents = mentions.sentences(once.withColumnRenamed("doc_name", "doc_id"), "\n")
    inside = (F.col("g.doc_name") == F.col("s.doc_id")) & (F.col("g.pos") >= F.col("s.pos_start")) & (F.col("g.pos") <= F.col("s.pos_end") + 1 - F.length("g.mention"))
    found = single.alias("g").join(sents.alias("s"), inside).select(
        "s.doc_id", "s.sent_idx", "s.sentence", (F.col("g.pos") - F.col("s.pos_start")).alias("start"), F.col("g.mention").alias("surface"), "g.title", "g.pos"
    )
    gold = found.withColumn("mention_ord", mentions.place_number("doc_id", "pos")).drop("pos")
    missing = wanted.count() - placed.count()
    lost = single.count() - gold.count()
    if missing or lost:
        raise ValueError(f"{missing} annotations are not in their texts, {lost} in no line")
    return sents, gold


def gold_records(gold: DataFrame, sents: DataFrame, index: DataFrame, words: int = 100) -> DataFrame:
    """Gold mentions (``doc_id, mention_ord, sent_idx, sentence, start, surface, title``) with
    ``gold`` (the entity's key), candidates (maybe none) and contexts."""
    spelled = mentions.spelling_lookup(gold, index)
    rows = gold.join(spelled, "surface").withColumns({"gold": X.entity_key(F.col("title")), "end": F.col("start") + F.length("surface")})
    return context.mention_contexts(mentions.candidate_lists(rows, index, keep_empty=True), sents, words)


def train_and_rest(gold: DataFrame, train: str = "train") -> tuple[DataFrame, DataFrame]:
    return gold.where(F.col("dataset") == train), gold.where(F.col("dataset") != train)
