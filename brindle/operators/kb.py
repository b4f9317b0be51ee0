"""Entity dimensions: canonical titles, redirects and identifier lookups.

Dimensions are small beside the corpora but not bounded, so no broadcast is forced:
the optimiser broadcasts what its size estimates allow and shuffles the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def last_wins(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """One row a key: the one with the largest order."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = F.max(F.struct(order, *rest)).alias("m")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def first_wins(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """One row a key: the one with the smallest order."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = F.min(F.struct(order, *rest)).alias("m")
    return rows.groupBy(key).agg(best).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def without_disambiguation(names: DataFrame, disambiguation: DataFrame) -> DataFrame:
    """``name, id``: the name map less disambiguation pages, last line of a name wins."""
    return last_wins(names.join(disambiguation.select("id"), "id", "left_anti").select("ord", "name", "id"), "name")


def redirect_titles(rows: DataFrame, redirects: DataFrame, column: str = "title", hops: int = 1) -> DataFrame:
    """``column`` normalised and redirected ``hops`` times; titles without a redirect stay."""
    for _ in range(hops):
        to = redirects.select(F.col("from_title").alias("_from"), F.col("to_title").alias("_to"))
        normal = rows.withColumn(column, X.normalise_entity(F.col(column)))
        rows = normal.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
    return rows


def title_ids(rows: DataFrame, names: DataFrame, column: str = "title") -> DataFrame:
    """Adds ``id``: the title's id, -1 where it has none."""
    known = names.select(F.col("name").alias("_name"), "id")
    return rows.join(known, F.col(column) == F.col("_name"), "left").drop("_name").withColumn("id", F.coalesce("id", F.lit(-1)))


def redirect_ids(rows: DataFrame, names: DataFrame, redirects: DataFrame, column: str = "target_id") -> DataFrame:
    """Adds ``title``: of a known id its own title, of an unknown one that of its redirect
    where this leads to a known title. Rows that stay unknown are dropped."""
    own = names.select(F.col("id").alias("_id"), F.col("name").alias("_own"))
    way = redirects.where("from_id IS NOT NULL").select(F.col("from_id").alias("_from"), F.col("to_title").alias("_to"))
    ends = names.select(F.col("name").alias("_end"))
    joined = (
        rows.join(own, F.col(column) == F.col("_id"), "left")
        .join(way, (F.col(column) == F.col("_from")) & F.col("_own").isNull(), "left")
        .join(ends, F.col("_to") == F.col("_end"), "left")
    )
    return joined.withColumn("title", F.coalesce("_own", "_end")).where("title IS NOT NULL").drop("_id", "_own", "_from", "_to", "_end")


def known_only(pairs: DataFrame, names: DataFrame, column: str = "entity") -> DataFrame:
    """Semi join of (mention, entity) pairs with the known titles."""
    return pairs.join(names.select(F.col("name").alias(column)).distinct(), column, "left_semi")
