"""Link extraction from article lines and mention/entity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

ANCHOR = r'<a href="(.*?)">(.*?)(?:</a>|$)'


def anchors(lines: DataFrame, keys: list[str], column: str = "line") -> DataFrame:
    """``keys, k, target, mention`` of every link of a line, in order. Targets are decoded; a
    link that is not closed goes on to the end of its line."""
    body = F.col(column)
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(1)).alias("target"), F.regexp_extract_all(body, F.lit(ANCHOR), F.lit(2)).alias("mention")
    )
    rows = lines.select(*keys, F.posexplode(pairs).alias("k", "a"))
    return rows.select(*keys, "k", X.percent_decode(F.col("a.target")).alias("target"), F.col("a.mention").alias("mention"))


def valid_links(links: DataFrame) -> DataFrame:
    """Links with a usable mention and target: no encyclopedia names, lists or fragments."""
    target = X.strip_scheme_wikt(F.col("target"))
    mention = F.col("mention")
    usable = (F.length(mention) >= 1) & ~mention.contains("Wikipedia") & ~mention.contains("wikipedia")
    return links.withColumn("target", target).where(usable & ~target.startswith("List of ") & ~target.contains("#"))


def running_documents(lines: DataFrame, order: list[str], shard: str | None = None) -> DataFrame:
    """Lines of documents whose id exceeds all ids before it, with that ``doc_id``.

    ``lines`` has ``header_id`` (null on body lines). The running maximum is inherently
    ordered over a whole corpus; it is taken in two levels: per ``shard`` (a file, say),
    with the maxima of earlier shards, of which there is one row each, joined in.
    """
    if shard is None:
        whole = Window.orderBy(*order)
        before, within = whole.rowsBetween(Window.unboundedPreceding, -1), whole
        earlier = F.lit(-1)
    else:
        own = Window.partitionBy(shard).orderBy(*order)
        before, within = own.rowsBetween(Window.unboundedPreceding, -1), own
        tops = lines.groupBy(shard).agg(F.max("header_id").alias("_top"))
        ahead = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
        lines = lines.join(tops.select(shard, F.coalesce(F.max("_top").over(ahead), F.lit(-1)).alias("_earlier")), shard)
        earlier = F.col("_earlier")
    largest = F.greatest(F.coalesce(F.max("header_id").over(before), F.lit(-1)), earlier)
    marked = lines.withColumn("_ok", F.when(F.col("header_id").isNotNull(), F.col("header_id") > largest))
    marked = marked.withColumn("doc_id", F.last("header_id", ignorenulls=True).over(within)).withColumn("_in", F.last("_ok", ignorenulls=True).over(within))
    return marked.where("_in").drop("_ok", "_in", "_earlier")


def pair_counts(links: DataFrame, entity: str = "entity", place: list[str] | None = None) -> DataFrame:
    """``mention, entity, cnt``, and ``first``, the place (by some columns) where a pair was
    seen first, if asked for."""
    first = [] if place is None else [F.min(F.struct(*place)).alias("first")]
    return links.groupBy("mention", F.col(entity).alias("entity")).agg(F.count("*").alias("cnt"), *first)


def merge_counts(*sources: DataFrame) -> DataFrame:
    """Counts of several corpora added up by (mention, entity)."""
    merged = sources[0].select("mention", "entity", "cnt")
    for more in sources[1:]:
        merged = merged.unionByName(more.select("mention", "entity", "cnt"))
    return merged.groupBy("mention", "entity").agg(F.sum("cnt").alias("cnt"))


def mention_frequency(counts: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """``mention, freq``: all counts of a mention, and one more for each custom mention."""
    rows = counts.groupBy("mention").agg(F.sum("cnt").alias("freq"))
    if custom is not None:
        rows = rows.unionByName(custom.select("mention").distinct().withColumn("freq", F.lit(1).cast("long")))
    return rows.groupBy("mention").agg(F.sum("freq").alias("freq"))


def link_quality(lines: DataFrame, links: DataFrame, column: str = "line") -> DataFrame:
    """One row: anchors opened and closed, links found, targets without an id (-1)."""
    marks = lines.agg(
        F.sum(F.size(F.split(column, "<a href=")) - 1).alias("opened"), F.sum(F.size(F.split(column, "</a>")) - 1).alias("closed")
    )
    found = links.agg(F.count("*").alias("links"), F.count_if(F.col("id") == -1).alias("unresolved"))
    return marks.crossJoin(found)
