"""The mention index of a knowledge base from its sources: links, cross-corpus counts, a prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import counts, kb, pem
from ..sources import readers
from .disambiguation import Dimensions


def canonical_names(names: DataFrame) -> DataFrame:
    """``id, title``: one name of each id, the last one."""
    return kb.last_wins(names.select("ord", "id", F.col("name").alias("title")), "id")


def link_counts(lines: DataFrame, dimensions: Dimensions, keys: list[str]) -> DataFrame:
    """``mention, entity, cnt`` of the links in article lines (``keys, line``): targets are
    normalised, redirected twice and looked up; links to unknown titles go."""
    links = counts.valid_links(counts.anchors(lines.withColumn("line", X.percent_decode(F.col("line"))), keys))
    once = kb.redirect_titles(links.withColumn("title", F.col("target")), dimensions.redirects)
    once = once.where("NOT startswith(title, 'List of ') AND NOT contains(title, '#')")
    known = kb.title_ids(kb.redirect_titles(once, dimensions.redirects), kb.last_wins(dimensions.names, "name")).where("id <> -1")
    named = known.drop("title").join(canonical_names(dimensions.names), "id")
    return counts.pair_counts(named.withColumn("entity", X.entity_key(F.col("title"))))


def cross_counts(lines: DataFrame, dimensions: Dimensions) -> DataFrame:
    """``mention, entity, cnt`` of ragged count lines; ids are redirected where unknown."""
    rows = kb.redirect_ids(readers.cross_counts(lines), canonical_names(dimensions.names).select("id", F.col("title").alias("name")), dimensions.redirects)
    return rows.groupBy("mention", X.entity_key(F.col("title")).alias("entity")).agg(F.sum("cnt").alias("cnt"))


def known_pairs(pairs: DataFrame, dimensions: Dimensions) -> DataFrame:
    """``mention, entity`` pairs whose entity, redirected, is a known title; keys with underscores."""
    titled = kb.redirect_titles(pairs.select("mention", F.col("entity").alias("title")), dimensions.redirects)
    names = dimensions.names.select("name")
    return kb.known_only(titled.select("mention", F.col("title").alias("entity")), names).select("mention", X.entity_key(F.col("entity")).alias("entity")).distinct()


def build_index(sources: list[DataFrame], prior: DataFrame | None = None, k: int = pem.TOP) -> DataFrame:
    """The mention index of count sources (``mention, entity, cnt``) and the pairs of a
    uniform prior (``mention, entity``)."""
    merged = counts.merge_counts(*sources)
    shares = pem.top_entities(merged, k).select("mention", "entity", "p")
    if prior is not None:
        shares = pem.merge_prior(shares, pem.uniform_prior(prior))
    return pem.mention_index(shares, counts.mention_frequency(merged, prior), k)
