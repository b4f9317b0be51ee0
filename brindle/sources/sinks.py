"""Sinks: the mention index, vectors, articles, side tables, models."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows, once no key occurs twice; raises otherwise."""
    double = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if double:
        raise ValueError(f"{key} {double[0][0]!r} occurs more than once")
    return rows


def write_index(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Overwrites the mention index: ranges of mentions, sorted, so that lookups prune."""
    unique = require_unique(index, "mention")
    ranged = unique.repartitionByRange("mention") if partitions is None else unique.repartitionByRange(partitions, "mention")
    ranged.sortWithinPartitions("mention").write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, unknown: DataFrame, path: str) -> None:
    """Overwrites word and entity vectors together with the unknown vectors."""
    rows = vectors.select("word", "emb").unionByName(unknown.select("word", F.col("emb").cast("array<float>").alias("emb")))
    require_unique(rows, "word").write.mode("overwrite").parquet(path)


def article_document(page: DataFrame, url_base: str) -> DataFrame:
    """``value``: articles in ``<doc>`` elements."""
    head = F.concat(F.lit('<doc id="'), F.col("id").cast("string"), F.lit(f'" url="{url_base}?curid='), F.col("id").cast("string"), F.lit('" title="'), F.col("title"), F.lit('">\n'))
    return page.select(F.concat(head, F.col("title"), F.lit("\n\n"), F.col("text"), F.lit("\n</doc>")).alias("value"))


def write_articles(pages: DataFrame, path: str, url_base: str, as_json: bool = False, compress: bool = False, per_file: int = 1000, file_bytes: int | None = None, order: str | None = None) -> None:
    """Articles (``id, title, text``) as ``<doc>`` text or JSON lines, optionally bzip2.

    ``file_bytes`` rolls files near that size (by the mean length), ``order`` (a column)
    makes the files one after another the order of the pages."""
    if file_bytes is not None:
        mean = pages.agg(F.avg(F.octet_length("text"))).first()[0] or 1.0
        per_file = max(1, int(file_bytes / max(mean, 1.0)))
    if order is not None:
        pages = pages.orderBy(order)
    options = {"maxRecordsPerFile": str(per_file)} | ({"compression": "bzip2"} if compress else {})
    if as_json:
        url = F.concat(F.lit(f"{url_base}?curid="), F.col("id").cast("string"))
        pages.select("id", url.alias("url"), "title", "text").write.mode("overwrite").options(**options).json(path)
    else:
        article_document(pages, url_base).write.mode("overwrite").options(**options).text(path)


def byte_size(text: str) -> int:
    """A size such as ``500K``, ``1M`` or ``2g`` in bytes; raises where it is none."""
    number, unit = (text[:-1], text[-1].lower()) if text and text[-1].isalpha() else (text, "")
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]


def write_templates(pages: DataFrame, path: str) -> None:
    """The template and module pages of a dump (``title, text``), to be read back as Parquet."""
    from ..operators.wikitext import template_pages

    template_pages(pages).write.mode("overwrite").parquet(path)


def write_side_tables(pages: DataFrame, path: str) -> None:
    """Redirects, disambiguation pages and the name map of a dump's pages, tab-separated."""
    from ..operators.markup import DISAMBIGUATION

    def save(rows: DataFrame, name: str, *columns: str) -> None:
        rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(f"{path}/{name}")

    save(pages.where("is_redirect"), "redirects", "title", "redirect_title", "id")
    save(pages.where(F.col("text").rlike(DISAMBIGUATION) & (F.col("ns") == "0")), "disambiguation", "id", "title")
    save(pages.where("ns = '0'"), "names", "title", "id")


def write_gold(mentions: DataFrame, path: str) -> None:
    mentions.write.mode("overwrite").partitionBy("dataset").parquet(path)


def save_parameters(spark: SparkSession, parameters: dict[str, np.ndarray], config: dict, path: str) -> None:
    """Model parameters as Parquet rows (name, shape, data), its configuration as JSON."""
    rows = [(k, list(v.shape), np.asarray(v, float).ravel().tolist()) for k, v in parameters.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_parameters(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    rows = spark.read.parquet(f"{path}/parameters").collect()
    config = json.loads(spark.read.text(f"{path}/config").first().value)
    return {r.name: np.array(r.data).reshape(r.shape) for r in rows}, config
