"""The mention index: p(entity | mention) from counts and a uniform prior."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 100


def top_entities(counts: DataFrame, k: int = TOP) -> DataFrame:
    """``mention, entity, cnt, rank, p``: the k most frequent entities of a mention with
    shares among those kept. Ties go by where a pair was seen first, where ``counts`` says
    so (``first``), else by entity.

    The rank filter becomes a group limit before the shuffle's sort, so a hot mention
    sends k rows from each task only.
    """
    order = Window.partitionBy("mention").orderBy(F.desc("cnt"), *(["first"] if "first" in counts.columns else []), "entity")
    ranked = counts.where("length(mention) > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    total = F.sum("cnt").over(Window.partitionBy("mention"))
    return ranked.withColumn("_total", total).where("_total >= 1").withColumn("p", F.col("cnt") / F.col("_total")).drop("_total")


def uniform_prior(pairs: DataFrame) -> DataFrame:
    """``mention, entity, prior`` = 1/n over the n distinct entities of a mention."""
    distinct = pairs.select("mention", "entity").distinct()
    n = distinct.groupBy("mention").agg(F.count("*").alias("n"))
    return distinct.join(n, "mention").select("mention", "entity", (1.0 / F.col("n")).alias("prior"))


def merge_prior(pem: DataFrame, prior: DataFrame) -> DataFrame:
    """``mention, entity, p``: where a mention has counts, a prior pair adds up and is
    rounded to three digits (at most 1); mentions of the prior alone keep it unrounded,
    and pairs without a prior keep theirs."""
    counted = pem.select("mention").distinct().withColumn("counted", F.lit(True))
    both = pem.select("mention", "entity", "p").join(prior, ["mention", "entity"], "full_outer").join(counted, "mention", "left")
    added = F.bround(F.least(F.lit(1.0), F.coalesce("p", F.lit(0.0)) + F.col("prior")), 3)
    merged = F.when(F.col("prior").isNull(), F.col("p")).when(F.col("counted"), added).otherwise(F.col("prior"))
    return both.select("mention", "entity", merged.alias("p"))


def mention_index(pem: DataFrame, freq: DataFrame, k: int = TOP) -> DataFrame:
    """``mention, lower, freq, cands``: at most k candidates, best first (ties by entity)."""
    ranked = pem.withColumn("_r", F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("p"), "entity"))).where(F.col("_r") <= k)
    nested = ranked.groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("_r", "entity", "p"))).alias("c"))
    cands = F.transform("c", lambda x: F.struct(x["entity"].alias("entity"), x["p"].alias("p")))
    return nested.join(freq, "mention", "left").select(
        "mention", F.lower("mention").alias("lower"), F.coalesce("freq", F.lit(0)).alias("freq"), cands.alias("cands")
    )
