"""End-to-end plans: building the mention index and linking documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import counts, mentions, pem, results


def page_lines(pages: DataFrame) -> DataFrame:
    """``page_id, ord, line`` of the pages' markup."""
    return pages.select("page_id", F.posexplode(F.split("html", "\n")).alias("ord", "line"))


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, ord, k, mention, target, entity`` of the pages' valid links."""
    links = counts.valid_links(counts.anchors(page_lines(pages), ["page_id", "ord"]))
    return links.withColumn("entity", X.entity_key(X.normalise_entity(F.regexp_replace("target", "^/", ""))))


def page_index(pages: DataFrame) -> DataFrame:
    """The mention index of the pages' links; mentions are lower-cased labels, so that
    spellings of one word compete."""
    links = page_links(pages).withColumn("mention", F.lower("mention"))
    pairs = counts.pair_counts(links)
    return pem.mention_index(pem.top_entities(pairs).select("mention", "entity", "p"), counts.mention_frequency(pairs))


def link_documents(docs: DataFrame, index: DataFrame, n: int = 3) -> DataFrame:
    """Documents -> sentences -> n-gram mentions -> candidates -> best prior -> results."""
    found = mentions.ngram_mentions(docs, index, n)
    listed = mentions.candidate_lists(found, index)
    best = listed.withColumn("entity", F.get("cands", F.lit(0))["entity"]).withColumn("conf_ed", mentions.clamp(F.get("cands", F.lit(0))["p"]))
    return best.select("doc_id", F.col("pos").alias("start"), F.length("surface").alias("length"), F.col("surface").alias("ngram"), "entity", "conf_ed", F.col("freq").cast("double").alias("conf_md"), "tag")


def answer(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``doc_id, body``: a JSON response for every document, ``[]`` where nothing is found.

    Documents with spans are disambiguated at these spans, others are searched.
    """
    free = link_documents(docs.where(F.size("spans") == 0), index)
    given = docs.where(F.size("spans") > 0).select("doc_id", "text", F.posexplode("spans").alias("mention_ord", "s"))
    surface = F.expr("substring(text, s.start + 1, s.length)")
    given = given.select("doc_id", "mention_ord", F.col("s.start").alias("start"), F.col("s.length").alias("length"), surface.alias("surface"))
    spelled = mentions.spelling_lookup(given, index)
    listed = mentions.candidate_lists(given.join(spelled, "surface"), index)
    placed = listed.select(
        "doc_id", "start", "length", F.col("surface").alias("ngram"), F.get("cands", F.lit(0))["entity"].alias("entity"),
        mentions.clamp(F.get("cands", F.lit(0))["p"]).alias("conf_ed"), F.lit(None).cast("double").alias("conf_md"), F.lit("NULL").alias("tag"),
    )
    bodies = results.response(free.unionByName(placed))
    return docs.select("doc_id").join(bodies, "doc_id", "left").select("doc_id", F.coalesce("body", F.lit("[]")).alias("body"))
