"""Readers of the line-oriented and structured inputs of a knowledge-base build.

Every reader has a fixed schema. ``ord`` is a line's number in its file where a later
operator needs an order. Files are read in splits, so one large file is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import counts


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, ord, line``: lines with their numbers, exact across splits.

    A split's rows are consecutive in its task, so a line's place in its split is the
    distance of its row id from the split's first; the lines of earlier splits of the file
    are counted by a scan without text. There is one row a split to join.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"), "value"
    )
    splits = raw.groupBy("file", "_split").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "_split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = raw.join(splits, ["file", "_split"])
    return rows.select("file", (F.col("_row") - F.col("_first") + F.col("_before")).cast("long").alias("ord"), F.regexp_replace("value", r"\r$", "").alias("line"))


def document_id(line: Column) -> Column:
    """The id in a document's header line, null on other lines."""
    return F.regexp_extract(line, '<doc id="([0-9]+)"', 1).try_cast("bigint")


def anchor_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, ord, doc_id, line`` of the body lines of a folder of extracted articles.
    Documents whose id does not exceed all ids before them (files by name) are left out."""
    lines = numbered_lines(spark, path).withColumn("header_id", document_id(F.col("line")))
    kept = counts.running_documents(lines, ["ord"], "file")
    return kept.where("header_id IS NULL").select("file", "ord", "doc_id", "line")


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text, spans``: one request a line, blank lines left out."""
    rows = numbered_lines(spark, path).where("trim(line) <> ''")
    return rows.select(F.concat_ws("#", "file", F.col("ord").cast("string")).alias("doc_id"), F.col("line").alias("text"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))


def site_information(spark: SparkSession, path: str) -> DataFrame:
    """``sitename, base, namespaces`` of a dump."""
    schema = "sitename string, base string, namespaces struct<namespace:array<struct<_key:int,_VALUE:string>>>"
    rows = spark.read.format("xml").option("rowTag", "siteinfo").schema(schema).load(path)
    return rows.select("sitename", "base", F.transform("namespaces.namespace", lambda n: F.struct(n["_key"].alias("key"), n["_VALUE"].alias("name"))).alias("namespaces"))


def single_article(pages: DataFrame, page_id: int | None = None, title: str | None = None) -> DataFrame:
    """The page of an id or title."""
    return pages.where(F.col("id") == page_id) if page_id is not None else pages.where(F.col("title") == title)


def name_map(spark: SparkSession, path: str, disambiguation: DataFrame) -> DataFrame:
    """``ord, name, id`` of ``title<TAB>id`` lines, disambiguation pages left out."""
    parts = numbered_lines(spark, path).select("ord", F.split("line", "\t").alias("p")).where(F.size("p") >= 2)
    rows = parts.select("ord", X.percent_decode(F.col("p")[0]).alias("name"), F.col("p")[1].cast("long").alias("id"))
    return rows.join(disambiguation.select("id"), "id", "left_anti").select("ord", "name", "id")


def disambiguation_pages(spark: SparkSession, path: str) -> DataFrame:
    """``id, title``; an id that is no positive integer fails the read."""
    parts = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("p"))
    number = F.expr("try_cast(p[0] AS bigint)")
    checked = F.when(number > 0, number).otherwise(F.raise_error(F.concat(F.lit("bad page id: "), F.col("p")[0])).cast("long"))
    return parts.select(checked.alias("id"), F.get("p", F.lit(1)).alias("title"))


def redirects(spark: SparkSession, path: str) -> DataFrame:
    """``ord, from_title, to_title, from_id``; lines below two fields are skipped, the id
    is there only with exactly three."""
    parts = numbered_lines(spark, path).select("ord", F.split("line", "\t").alias("p")).where(F.size("p") >= 2)
    return parts.select(
        "ord",
        X.percent_decode(F.col("p")[0]).alias("from_title"),
        X.percent_decode(F.col("p")[1]).alias("to_title"),
        F.when(F.size("p") == 3, F.get("p", F.lit(2)).cast("long")).alias("from_id"),
    )


def cross_counts(lines: DataFrame) -> DataFrame:
    """``mention, target_id, cnt`` of ragged ``mention<TAB>total<TAB>id,cnt<TAB>...`` lines."""
    parts = lines.select(F.split("line", "\t").alias("p")).where(F.size("p") > 2)
    rows = parts.select(X.percent_decode(F.col("p")[0]).alias("mention"), F.explode(F.slice("p", F.lit(3), F.size("p"))).alias("pair"))
    rows = rows.where("pair LIKE '%,%' AND NOT (mention LIKE '%Wikipedia%' OR mention LIKE '%wikipedia%')")
    pair = F.split("pair", ",")
    return rows.select("mention", pair[0].cast("long").alias("target_id"), pair[1].cast("long").alias("cnt"))


def ontology_means(lines: DataFrame) -> DataFrame:
    """``mention, entity`` of ``"mention"<TAB>entity`` lines: the mention unquoted, the entity
    with its unicode, markup and percent escapes decoded."""
    parts = lines.select(F.split("line", "\t").alias("p")).where(F.size("p") >= 2)
    mention = F.trim(F.substring(F.col("p")[0], F.lit(2), F.length(F.col("p")[0]) - 2))
    entity = X.percent_decode(F.replace(X.unescape_unicode(F.col("p")[1]), F.lit("&amp;"), F.lit("&")))
    return parts.select(mention.alias("mention"), X.normalise_entity(entity).alias("entity")).distinct()


def persons(spark: SparkSession, path: str) -> DataFrame:
    """Distinct person names, spaces as underscores."""
    return spark.read.text(path).select(X.entity_key(F.trim(F.regexp_replace("value", r"\t", " "))).alias("name")).where("name <> ''").distinct()


def vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``ord, word, emb`` of text vectors with an ``n d`` header. A row of another length
    fails; of equal words the first counts."""
    lines = numbered_lines(spark, path).where("line <> ''")
    first = lines.where("ord = 0").select(F.split("line", " ")[1].cast("int").alias("dims"))
    rows = lines.where("ord > 0")
    rows = rows if limit is None else rows.where(F.col("ord") <= limit)
    parts = rows.select("ord", F.split(F.rtrim("line"), " ").alias("p")).crossJoin(F.broadcast(first))
    values = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x.cast("float"))
    checked = F.when(F.size("p") == F.col("dims") + 1, values).otherwise(F.raise_error(F.lit("a vector of another length")).cast("array<float>"))
    return (
        parts.select("ord", F.col("p")[0].alias("word"), checked.alias("emb"))
        .groupBy("word")
        .agg(F.min(F.struct("ord", "emb")).alias("m"))
        .select("m.ord", "word", "m.emb")
    )


def dump_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a MediaWiki XML dump (plain, .gz or .bz2)."""
    schema = (
        "title string, ns string, id long, redirect struct<_title:string>, "
        "revision struct<id:long,text:struct<_VALUE:string>>"
    )
    rows = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    text = F.coalesce(F.col("revision.text._VALUE"), F.lit(""))
    cats = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[Category:([^\]|]+)"), F.lit(1)), lambda x: F.trim(x))
    return rows.select(
        "id",
        F.col("revision.id").alias("revid"),
        "title",
        "ns",
        cats.alias("cats"),
        text.alias("text"),
        F.col("redirect").isNotNull().alias("is_redirect"),
        F.col("redirect._title").alias("redirect_title"),
    )


def annotated_corpus(spark: SparkSession, xml_path: str) -> DataFrame:
    """``doc_name, annotation_ord, mention, title, start, length`` of XML gold annotations."""
    schema = "_docName string, annotation array<struct<mention:string,wikiName:string,offset:long,length:long>>"
    rows = spark.read.format("xml").option("rowTag", "document").schema(schema).load(xml_path)
    each = rows.select(F.replace("_docName", F.lit("&amp;"), F.lit("&")).alias("doc_name"), F.posexplode("annotation").alias("annotation_ord", "a"))
    return each.where("a.wikiName IS NOT NULL AND a.wikiName NOT IN ('', 'NIL')").select(
        "doc_name", "annotation_ord", F.col("a.mention").alias("mention"), F.col("a.wikiName").alias("title"), F.col("a.offset").alias("start"), F.col("a.length").alias("length")
    )


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """``doc_name, text`` of a folder of text files; every line but the first gets a space
    before it, as in the corpora whose offsets count so."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_name"), "value")
    text = F.replace(F.replace("value", F.lit("\n"), F.lit("\n ")), F.lit("&amp;"), F.lit("&"))
    return rows.select(F.url_decode("doc_name").alias("doc_name"), F.regexp_replace(text, r"\n \z", "\n").alias("text"))


def gold_datasets(spark: SparkSession, path: str, names: list[str] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Stored gold mentions (``dataset, doc_id, ...``), some datasets or all, less documents
    that are known to be broken."""
    rows = spark.read.parquet(path)
    rows = rows if names is None else rows.where(F.col("dataset").isin(*names))
    return rows.where(~F.col("doc_id").isin(*without)) if without else rows


def category_filter(spark: SparkSession, path: str) -> DataFrame:
    """``category, exclude`` of a filter file: ``#`` comments, ``^`` excludes."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    return rows.select(F.regexp_replace("line", r"^\^", "").alias("category"), F.col("line").startswith("^").alias("exclude"))


def timing_log(spark: SparkSession, path: str) -> DataFrame:
    """``n_words, n_mentions, t_md, t_ed`` of white-space rows."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(p.alias("p")).where(F.size("p") >= 4)
    return rows.selectExpr("int(p[0]) n_words", "int(p[1]) n_mentions", "double(p[2]) t_md", "double(p[3]) t_ed")


REQUEST = "text string, spans array<struct<start:int,length:int>>"


def requests(rows: DataFrame) -> DataFrame:
    """``doc_id, text, spans`` of JSON bodies (``doc_id, body``); spans as objects or as
    pairs, none as an empty array."""
    named = F.from_json("body", REQUEST)
    paired = F.from_json("body", "text string, spans array<array<int>>")
    spans = F.coalesce(
        F.when(F.exists(named["spans"], lambda s: s["start"].isNotNull()), named["spans"]),
        F.transform(F.filter(paired["spans"], lambda s: s.isNotNull()), lambda s: F.struct(s[0].alias("start"), s[1].alias("length"))),
        F.array().cast("array<struct<start:int,length:int>>"),
    )
    text = F.replace(F.coalesce(F.get_json_object("body", "$.text"), F.lit("")), F.lit("&amp;"), F.lit("&"))
    return rows.select("doc_id", text.alias("text"), spans.alias("spans"))


def nif_documents(rows: DataFrame) -> DataFrame:
    """``doc_id, text, spans`` of NIF Turtle documents (``doc_id, turtle``): the context's
    string and the begin/end indexes of the phrases."""
    begin = F.regexp_extract_all("turtle", F.lit(r'nif:beginIndex\s+"(\d+)"'), F.lit(1))
    end = F.regexp_extract_all("turtle", F.lit(r'nif:endIndex\s+"(\d+)"'), F.lit(1))
    text = F.regexp_extract("turtle", r'nif:isString\s+"((?:[^"\\]|\\.)*)"', 1)
    pairs = F.arrays_zip(begin.alias("b"), end.alias("e"))
    spans = F.transform(pairs, lambda x: F.struct(x["b"].cast("int").alias("start"), (x["e"].cast("int") - x["b"].cast("int")).alias("length")))
    whole = F.length(text)
    return rows.select("doc_id", text.alias("text"), F.filter(spans, lambda s: ~((s["start"] == 0) & (s["length"] == whole))).alias("spans"))
