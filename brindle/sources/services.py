"""Requests and responses of linking services, as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a health check answers, where entities of a response live, and the
#: namespaces behind the prefixes of annotation types.
STATUS = {"schemaVersion": 1, "label": "status", "message": "up", "color": "green"}
RESOURCES = "http://dbpedia.org/resource/"
TYPE_PREFIXES = {"freebase": "http://rdf.freebase.com/ns/", "dbpedia": "http://dbpedia.org/ontology/"}


def request_body(text: Column, spans: Column) -> Column:
    """The JSON body that asks for spans (``start, length``) of a text."""
    return F.to_json(F.struct(text.alias("text"), spans.alias("spans")))


def nif_responses(results: DataFrame, uri: str = "http://document/") -> DataFrame:
    """``doc_id, turtle``: results (``doc_id, start, length, entity``) as NIF phrases that name
    their entities."""
    quoted = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"^^xsd:nonNegativeInteger'))
    end = F.col("start") + F.col("length")
    line = F.concat(
        F.lit(f"<{uri}#char="), F.col("start").cast("string"), F.lit(","), end.cast("string"), F.lit("> a nif:Phrase ;\n  nif:beginIndex "), quoted(F.col("start")),
        F.lit(" ;\n  nif:endIndex "), quoted(end), F.lit(" ;\n  itsrdf:taIdentRef <"), F.lit(RESOURCES), F.col("entity"), F.lit("> ."),
    )
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "length", line.alias("line")))), lambda x: x["line"]), "\n")
    return results.groupBy("doc_id").agg(lines.alias("turtle"))


def annotations(rows: DataFrame, prefixes: Mapping[str, str] = TYPE_PREFIXES) -> DataFrame:
    """``doc_id, start, length, uri, types`` of JSON annotation answers (``doc_id, body``).
    A type is its prefix's namespace and name; types of unknown prefixes are left out."""
    schema = "Resources array<struct<`@URI`:string,`@offset`:string,`@surfaceForm`:string,`@types`:string>>"
    each = rows.select("doc_id", F.explode(F.from_json("body", schema)["Resources"]).alias("r"))
    names = F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair])
    parts = F.transform(F.split("r.`@types`", ","), lambda t: F.split(t, ":"))
    types = F.transform(parts, lambda p: F.concat(F.try_element_at(names, F.lower(F.get(p, F.lit(0)))), F.get(p, F.lit(1))))
    return each.select(
        "doc_id",
        F.col("r.`@offset`").try_cast("int").alias("start"),
        F.length("r.`@surfaceForm`").alias("length"),
        F.col("r.`@URI`").alias("uri"),
        F.coalesce(F.filter(types, lambda t: t.isNotNull()), F.array().cast("array<string>")).alias("types"),
    )


def answered(rows: DataFrame) -> DataFrame:
    """``doc_id, body`` of service answers (``doc_id, status, body``): null where a call failed."""
    return rows.select("doc_id", F.when(F.col("status").between(200, 299), F.col("body")).alias("body"))
