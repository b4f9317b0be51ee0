"""Registered queries and their SQL oracles over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, counts, features, joint, kb, markup, mentions, pem, ranking, results, stored, wikitext
from ..sources import readers
from . import disambiguation, knowledge, linking

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Links and counts ---------------------------------------------------------------------

_LINKS = """
lines AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS ord FROM pages),
raw AS (SELECT page_id, ord, unnest(range(len(regexp_extract_all(line, '<a href="(.*?)">(.*?)</a>')))) AS k,
  unnest(regexp_extract_all(line, '<a href="(.*?)">(.*?)</a>', 1)) AS target0, unnest(regexp_extract_all(line, '<a href="(.*?)">(.*?)</a>', 2)) AS mention FROM lines),
links AS (SELECT page_id, ord, k, mention, regexp_replace(url_decode(target0), '^wikt:', '') AS target FROM raw
  WHERE length(mention) >= 1 AND mention NOT LIKE '%Wikipedia%' AND mention NOT LIKE '%wikipedia%'),
good AS (SELECT *, replace(replace(trim(regexp_replace(target, '^/', '')), '_', ' '), '&amp;', '&') AS t FROM links
  WHERE target NOT LIKE 'List of %' AND target NOT LIKE '%#%'),
named AS (SELECT *, replace(replace(upper(t[1:1]), 'ẞ', 'SS') || t[2:], ' ', '_') AS entity FROM good)
"""


@query(f"WITH {_LINKS} SELECT page_id, ord, k, mention, target, entity FROM named")
def anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.page_links(table(spark, sf_dir, "pages")).select("page_id", "ord", "k", "mention", "target", "entity")


@query(f"WITH {_LINKS} SELECT mention, entity, count(*) AS cnt FROM named GROUP BY ALL")
def anchor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pair_counts(linking.page_links(table(spark, sf_dir, "pages")))


_WORD_COUNTS = """
wc AS (SELECT w AS mention, CAST(p_partkey AS VARCHAR) AS entity, count(*) AS cnt
  FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) p JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)
"""


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous counts: a word of a part's name, the part, its line items."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("mention"))
    joined = words.join(lines, words.p_partkey == lines.l_partkey)
    return joined.groupBy("mention", F.col("p_partkey").cast("string").alias("entity")).agg(F.sum("n").alias("cnt"))


_PRIOR = """
pr AS (SELECT mention, entity, 1.0::DOUBLE / count(*) OVER (PARTITION BY mention) AS prior FROM (
  SELECT DISTINCT mention, entity FROM (
    SELECT unnest(string_split(p_name, ' ')) AS mention, CAST(p_partkey AS VARCHAR) AS entity FROM part WHERE p_size <= 10
    UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 10)))
"""


def prior_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = table(spark, sf_dir, "part").where("p_size <= 10")
    entity = F.col("p_partkey").cast("string").alias("entity")
    return small.select(F.explode(F.split("p_name", " ")).alias("mention"), entity).unionByName(small.select(F.col("p_brand").alias("mention"), entity))


@query(f"""WITH {_LINKS}, {_WORD_COUNTS}, {_PRIOR},
u AS (SELECT mention, count(*) AS n FROM named GROUP BY 1 UNION ALL SELECT mention, sum(cnt) FROM wc GROUP BY 1
  UNION ALL SELECT DISTINCT mention, 1 FROM pr)
SELECT mention, CAST(sum(n) AS BIGINT) AS freq FROM u GROUP BY 1""")
def mention_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = counts.merge_counts(counts.pair_counts(linking.page_links(table(spark, sf_dir, "pages"))), word_counts(spark, sf_dir))
    return counts.mention_frequency(merged, prior_pairs(spark, sf_dir))


@query(f"""WITH {_LINKS}, names AS (SELECT DISTINCT regexp_replace(word, '[.,]$', '') AS name FROM (
  SELECT unnest(string_split(text, ' ')) AS word FROM benchmark)),
m AS (SELECT sum(len(string_split(line, '<a href=')) - 1) AS opened, sum(len(string_split(line, '</a>')) - 1) AS closed FROM lines),
f AS (SELECT count(*) AS links, count(*) FILTER (WHERE n.name IS NULL) AS unresolved FROM named LEFT JOIN names n ON named.entity = n.name)
SELECT CAST(opened AS BIGINT) AS opened, CAST(closed AS BIGINT) AS closed, links, unresolved FROM m, f""")
def link_qa_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    names = words.select(F.regexp_replace("w", "[.,]$", "").alias("name")).distinct().withColumn("id", F.lit(1))
    return counts.link_quality(linking.page_lines(pages), kb.title_ids(linking.page_links(pages), names, "entity"))


# Dimensions ---------------------------------------------------------------------------


@query("""SELECT p_name AS name, max(p_partkey) AS id FROM part WHERE p_partkey % 50 <> 0 GROUP BY 1""")
def name_map_anti_disambig(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return kb.without_disambiguation(names, part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id")))


def _titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    title = lambda k: F.concat(F.lit("Part "), k.cast("string"))
    moved = part.where("p_partkey % 10 IN (1, 2)").select(
        F.col("p_partkey").alias("ord"), title(F.col("p_partkey")).alias("from_title"), title(F.col("p_partkey") - 1).alias("to_title"), F.col("p_partkey").alias("from_id")
    )
    return part.select("p_partkey", F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("title")), moved


@query("SELECT p_partkey, 'Part ' || CAST(p_partkey - CASE WHEN p_partkey % 10 IN (1, 2) THEN 1 ELSE 0 END AS VARCHAR) AS title FROM part")
def redirect_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles, moved = _titles(spark, sf_dir)
    return kb.redirect_titles(titles, moved).select("p_partkey", "title")


@query("SELECT p_partkey, 'Part ' || CAST(p_partkey - CASE p_partkey % 10 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS VARCHAR) AS title FROM part")
def redirect_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles, moved = _titles(spark, sf_dir)
    return kb.redirect_titles(titles, moved, hops=2).select("p_partkey", "title")


@query("""SELECT l_orderkey, l_linenumber, 'Part ' || CAST(l_partkey - CASE WHEN l_partkey % 10 = 1 THEN 1 ELSE 0 END AS VARCHAR) AS title
FROM lineitem WHERE l_partkey % 10 < 5 AND l_partkey % 10 <> 2""")
def redirect_id_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    _, moved = _titles(spark, sf_dir)
    known = part.where("p_partkey % 10 IN (0, 3, 4)").select(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("id"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("target_id"))
    return kb.redirect_ids(rows, known, moved).select("l_orderkey", "l_linenumber", "title")


def _cross_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    part = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    pairs = F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("n").cast("string")))), "\t")
    grouped = part.groupBy("p_type", "p_brand").agg(F.sum("n").alias("total"), pairs.alias("pairs"))
    return grouped.select(F.concat_ws("\t", F.concat_ws("%20", "p_type", "p_brand"), F.col("total").cast("string"), "pairs").alias("line"))


@query("""SELECT p_type || ' ' || p_brand AS mention, p_partkey AS target_id, count(*) AS cnt
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL""")
def cross_counts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.cross_counts(_cross_lines(spark, sf_dir))


@query(f"""WITH {_WORD_COUNTS}, x AS (SELECT p_type || ' ' || p_brand AS mention, CAST(p_partkey AS VARCHAR) AS entity, count(*) AS cnt
  FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL),
y AS (SELECT w AS mention, CAST(p_partkey AS VARCHAR) AS entity, 1 AS cnt FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part))
SELECT mention, entity, CAST(sum(cnt) AS BIGINT) AS cnt FROM (FROM wc UNION ALL FROM x UNION ALL FROM y) GROUP BY ALL""")
def counts_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = readers.cross_counts(_cross_lines(spark, sf_dir)).select("mention", F.col("target_id").cast("string").alias("entity"), "cnt")
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("mention"), F.col("p_partkey").cast("string").alias("entity"), F.lit(1).cast("long").alias("cnt"))
    return counts.merge_counts(word_counts(spark, sf_dir), cross, names)


# The mention index --------------------------------------------------------------------

_TOP = f"""{_WORD_COUNTS},
rk AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY cnt DESC, entity) AS rank FROM wc),
top AS (SELECT mention, entity, cnt, rank, cnt / sum(cnt) OVER (PARTITION BY mention) AS p FROM rk WHERE rank <= 100)
"""


@query(f"WITH {_TOP} SELECT mention, entity, cnt, rank, round(p, 9) AS p FROM top")
def pem_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pem.top_entities(word_counts(spark, sf_dir)).withColumn("p", F.round("p", 9))


_MERGED = f"""{_TOP}, {_PRIOR}, has AS (SELECT DISTINCT mention FROM top),
mg AS (SELECT coalesce(t.mention, r.mention) AS mention, coalesce(t.entity, r.entity) AS entity,
  CASE WHEN r.prior IS NULL THEN t.p WHEN h.mention IS NOT NULL THEN round_even(least(1.0, coalesce(t.p, 0) + r.prior), 3) ELSE r.prior END AS p
  FROM top t FULL JOIN pr r ON t.mention = r.mention AND t.entity = r.entity
  LEFT JOIN has h ON h.mention = coalesce(t.mention, r.mention))
"""


@query(f"WITH {_MERGED} SELECT mention, entity, round(p, 9) AS p FROM mg")
def pem_merge_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).withColumn("p", F.round("p", 9))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pem.merge_prior(pem.top_entities(word_counts(spark, sf_dir)), pem.uniform_prior(prior_pairs(spark, sf_dir)))


@query(f"""WITH {_MERGED}, o AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY p DESC, entity) AS rank FROM mg),
f AS (SELECT mention, CAST(sum(cnt) AS BIGINT) AS freq FROM wc GROUP BY 1)
SELECT o.mention, lower(o.mention) AS lower, coalesce(freq, 0) AS freq, rank, entity, round(p, 9) AS p FROM o LEFT JOIN f ON o.mention = f.mention WHERE rank <= 100""")
def pem_nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = pem.mention_index(_merged(spark, sf_dir), counts.mention_frequency(word_counts(spark, sf_dir)))
    each = index.select("mention", "lower", "freq", F.posexplode("cands").alias("k", "c"))
    return each.select("mention", "lower", "freq", (F.col("k") + 1).cast("long").alias("rank"), F.col("c.entity").alias("entity"), F.round("c.p", 9).alias("p"))


@query(f"WITH {_PRIOR} SELECT mention, entity, round(prior, 9) AS prior FROM pr")
def uniform_prior_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pem.uniform_prior(prior_pairs(spark, sf_dir)).withColumn("prior", F.round("prior", 9))


@query("""WITH e AS (SELECT event_id, event_id // 500 AS shard, CASE WHEN event_type = 'click' THEN user_id * 100 + event_id // 40 END AS header_id FROM events),
m AS (SELECT *, coalesce(max(header_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev,
  last_value(header_id IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS doc_id FROM e),
k AS (SELECT *, last_value(CASE WHEN header_id IS NOT NULL THEN header_id > prev END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ok FROM m)
SELECT event_id, doc_id FROM k WHERE ok""")
def monotone_doc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("event_type") == "click", F.col("user_id") * 100 + F.expr("event_id div 40"))
    lines = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 500").alias("shard"), header.alias("header_id"))
    return counts.running_documents(lines, ["event_id"], "shard").select("event_id", "doc_id")


_KB = f"""{_LINKS},
titled AS (SELECT mention, replace(entity, '_', ' ') AS title FROM named),
moved AS (SELECT mention, CASE WHEN length(title) % 5 = 0 THEN 'The' ELSE title END AS title FROM titled),
known AS (SELECT DISTINCT title FROM moved),
n AS (SELECT mention, replace(m.title, ' ', '_') AS entity, count(*) AS cnt FROM moved m GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY cnt DESC, entity) AS r FROM n),
tp AS (SELECT mention, entity, cnt / sum(cnt) OVER (PARTITION BY mention) AS p FROM rk WHERE r <= 100),
words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS mention FROM benchmark),
pairs AS (SELECT DISTINCT mention, CASE WHEN length(e) % 5 = 0 THEN 'The' ELSE e END AS title FROM (
  SELECT mention, unnest([replace(upper(mention[1:1]), 'ẞ', 'SS') || mention[2:], 'The']) AS e FROM words)),
pr AS (SELECT mention, replace(title, ' ', '_') AS entity, 1.0::DOUBLE / count(*) OVER (PARTITION BY mention) AS prior FROM pairs WHERE title IN (SELECT title FROM known)),
has AS (SELECT DISTINCT mention FROM tp),
mg AS (SELECT coalesce(t.mention, r.mention) AS mention, coalesce(t.entity, r.entity) AS entity,
  CASE WHEN r.prior IS NULL THEN t.p WHEN h.mention IS NOT NULL THEN round_even(least(1.0, coalesce(t.p, 0) + r.prior), 3) ELSE r.prior END AS p
  FROM tp t FULL JOIN pr r ON t.mention = r.mention AND t.entity = r.entity LEFT JOIN has h ON h.mention = coalesce(t.mention, r.mention)),
fq AS (SELECT mention, CAST(sum(c) AS BIGINT) AS freq FROM (SELECT mention, sum(cnt) AS c FROM n GROUP BY 1 UNION ALL SELECT DISTINCT mention, 1 FROM pr) GROUP BY 1)
"""


@query(f"WITH {_KB} SELECT mg.mention, lower(mg.mention) AS lower, freq, entity, round(p, 9) AS p FROM mg JOIN fq ON mg.mention = fq.mention")
def kb_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, redirects, known titles, counts, prior and index in one plan."""
    pages = table(spark, sf_dir, "pages")
    titles = linking.page_links(pages).select(F.replace("entity", F.lit("_"), F.lit(" ")).alias("name")).distinct()
    moved = titles.where("length(name) % 5 = 0").select(F.lit(0).alias("ord"), F.col("name").alias("from_title"), F.lit("The").alias("to_title"), F.lit(None).cast("long").alias("from_id"))
    names = titles.where("length(name) % 5 <> 0").union(spark.sql("SELECT 'The'")).distinct().select(F.crc32("name").alias("ord"), "name", F.xxhash64("name").alias("id"))
    dimensions = disambiguation.Dimensions(names.select("id").limit(0), moved, names)
    lines = linking.page_lines(pages).withColumn("line", F.regexp_replace("line", '<a href="/', '<a href="'))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("mention")).distinct()
    title = F.explode(F.array(X.first_upper(F.col("mention")), F.lit("The")))
    redirected = words.select("mention", title.alias("entity")).withColumn("entity", F.when(F.length("entity") % 5 == 0, "The").otherwise(F.col("entity")))
    prior = knowledge.known_pairs(redirected, dimensions)
    index = knowledge.build_index([knowledge.link_counts(lines, dimensions, ["page_id", "ord"])], prior)
    each = index.select("mention", "lower", "freq", F.explode("cands").alias("c"))
    return each.select("mention", "lower", "freq", F.col("c.entity").alias("entity"), F.round("c.p", 9).alias("p"))


# Vectors ------------------------------------------------------------------------------

_KIND = "CASE WHEN label < 5 THEN 'entity' ELSE 'word' END"


@query(f"""SELECT kind, pos, round(avg(x), 6) AS x FROM (SELECT {_KIND} AS kind, unnest(range(len(embedding))) AS pos,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL""")
def vector_unk_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.expr(_KIND).alias("kind"), F.col("embedding").alias("emb"))
    means = ranking.unknown_vectors(vectors)
    return means.select("kind", F.posexplode("emb").alias("pos", "x")).select("kind", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("""WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qe FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id, list_dot_product(qe, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated query set (ids divisible by 100) against all rows, in blocks."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))
    best = ranking.top_products(rows.where("id % 100 = 0"), rows, 5)
    return best.select("qid", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


_BAG = """
tok AS (SELECT vec_id // 20 AS mention, CAST(embedding AS DOUBLE[]) AS e, vec_id FROM embeddings),
ctx AS (SELECT mention, list(x ORDER BY pos) AS c FROM (SELECT mention, pos, avg(x) AS x FROM (
  SELECT mention, unnest(range(len(e))) AS pos, unnest(e) AS x FROM tok WHERE vec_id % 20 < 10) GROUP BY ALL) GROUP BY 1),
sc AS (SELECT t.mention, vec_id % 20 AS idx, vec_id, list_dot_product(e, c) AS s FROM tok t JOIN ctx ON t.mention = ctx.mention WHERE vec_id % 20 >= 10),
rk AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY s DESC, idx) AS cr FROM sc),
fl AS (SELECT *, row_number() OVER (PARTITION BY mention, cr <= 3 ORDER BY idx) AS fr FROM rk)
"""


@query(f"WITH {_BAG} SELECT mention, vec_id, cr AS ctx_rank, round(s, 6) AS ctx_score FROM fl WHERE cr <= 3 OR fr <= 4")
def bag_mean_prerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("mention"), (F.col("vec_id") % 20).alias("idx"), "vec_id", F.col("embedding").alias("emb"))
    ctx = ranking.context_mean(rows.where("idx < 10"), ["mention"])
    scored = rows.where("idx >= 10").join(ctx, "mention").withColumn("ctx_score", X.dot(F.col("emb"), F.col("ctx")))
    return ranking.prerank(scored, ["mention"]).select("mention", "vec_id", "ctx_rank", F.round("ctx_score", 6).alias("ctx_score"))


# Text functions -----------------------------------------------------------------------


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\pL\pN_]+')) AS BIGINT) AS n_words,
  list_aggregate(regexp_extract_all(text, '[\pL\pN_]+'), 'string_agg', ' ') AS words FROM documents""")
def tokens_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.word_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), F.when(F.size(words) > 0, F.array_join(words, " ")).alias("words"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_]')) AS w FROM documents)
SELECT doc_id, count(*) AS n_important, count(DISTINCT lower(w)) AS n_distinct FROM t
WHERE length(w) > 1 AND lower(w) NOT IN ({_STOP}) AND NOT regexp_full_match(lower(w), '[0-9]+(_[0-9]+)*(e[0-9]+)?|nan|inf|infinity') GROUP BY 1""")
def tokens_important(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.explode(X.tokens_with_separators(F.col("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", token.alias("w")).where(X.is_important(F.col("w")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_important"), F.countDistinct(F.lower("w")).alias("n_distinct"))


@query("""SELECT p_partkey, upper(p_name[1:1]) || p_name[2:] AS first_up, trim(regexp_replace(p_name || '(.|,!''x ', '[(.|,!'']', '', 'g')) AS stripped,
  replace(p_name, ' ', '_') AS entity_key, lower(p_brand) AS lowered, url_decode(replace(p_name, ' ', '%20') || '+%zz') AS decoded FROM part""")
def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.first_upper(name).alias("first_up"),
        X.strip_noise(F.concat(name, F.lit("(.|,!'x "))).alias("stripped"),
        X.entity_key(name).alias("entity_key"),
        F.lower("p_brand").alias("lowered"),
        X.percent_decode(F.concat(F.replace(name, F.lit(" "), F.lit("%20")), F.lit("+%zz"))).alias("decoded"),
    )


@query(r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(upper(p_name || '''' || p_brand), '\pL+|[^\pL]+'),
  lambda p: upper(p[1:1]) || lower(p[2:])), '') AS title FROM part""")
def title_if_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.title_if_upper(F.upper(F.concat_ws("'", "p_name", "p_brand"))).alias("title"))


@query("""SELECT o_orderkey, list_aggregate(list_transform(a, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS padded,
  list_aggregate(list_transform(m, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',') AS mask FROM (
  SELECT o_orderkey, (list(l_linenumber ORDER BY l_linenumber) || [0, 0, 0, 0])[1:4] AS a,
    ([1 FOR x IN list(l_linenumber)] || [0, 0, 0, 0])[1:4] AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""")
def pad_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"))
    strings = lambda a: F.array_join(F.transform(a, lambda x: x.cast("int").cast("string")), ",")
    return own.select("o_orderkey", strings(X.pad_right(F.col("a"), 4, F.lit(0))).alias("padded"), strings(X.pad_mask(F.col("a"), 4)).alias("mask"))


# Sentences, mentions, contexts --------------------------------------------------------

_SENT = r"""
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS part FROM documents),
pl AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY part ROWS UNBOUNDED PRECEDING) - length(s) - 1 AS pos_start FROM cut),
sent AS (SELECT doc_id, s AS sentence, CAST(pos_start AS INTEGER) AS pos_start, CAST(pos_start + length(s) AS INTEGER) AS pos_end,
  row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS sent_idx FROM pl WHERE trim(s) <> '')
"""


@query(f"WITH {_SENT} SELECT doc_id, sent_idx, sentence, pos_start, pos_end FROM sent")
def sentence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.sentences(table(spark, sf_dir, "documents"), "\n")


#: Marks stand for the dot of an abbreviation (chr 1) and around a boundary (chr 2).
_SPLIT = r"""
ab AS (SELECT doc_id, regexp_replace(text, '\b([A-Z][a-z]?)\.', '\1' || chr(1), 'g') AS t FROM documents),
bd AS (SELECT doc_id, regexp_replace(t, '([.?!])([ \t\n\x0B\f\r]+)([\p{Lu}"''(0-9])', '\1' || chr(2) || '\2' || chr(2) || '\3', 'g') AS t FROM ab),
cuts AS (SELECT doc_id, string_split_regex(t, '\x02[ \t\n\x0B\f\r]+\x02|\n+') AS parts, regexp_extract_all(t, '\x02[ \t\n\x0B\f\r]+\x02|\n+') AS gaps FROM bd),
lines AS (SELECT doc_id, unnest(parts) AS s, unnest(gaps || ['']) AS gap, generate_subscripts(parts, 1) AS part FROM cuts),
sized AS (SELECT doc_id, part, replace(replace(s, chr(1), '.'), chr(2), '') AS s, length(replace(gap, chr(2), '')) AS gap FROM lines),
placed AS (SELECT *, sum(length(s) + gap) OVER (PARTITION BY doc_id ORDER BY part ROWS UNBOUNDED PRECEDING) - length(s) - gap AS pos FROM sized)
"""


@query(f"""WITH {_SPLIT} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS sent_idx, s AS sentence,
  CAST(pos AS INTEGER) AS pos_start, CAST(pos + length(s) AS INTEGER) AS pos_end FROM placed WHERE trim(s) <> ''""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.sentences(table(spark, sf_dir, "documents"))


def _spans(docs: DataFrame) -> DataFrame:
    each = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return docs.select("doc_id", each.alias("k"), F.length("text").alias("n")).select("doc_id", ((F.col("k") * F.col("n")).cast("double") / 5).cast("int").alias("start"), F.lit(3).alias("length"))


@query(f"""WITH {_SENT}, sp AS (SELECT doc_id, CAST(floor(k * length(text) / 5.0) AS INTEGER) AS start, 3 AS length FROM documents, range(5) r(k))
SELECT sp.doc_id, start, length, sent_idx, start - pos_start AS in_sentence FROM sp JOIN sent ON sp.doc_id = sent.doc_id AND start >= pos_start AND start < pos_end""")
def span_to_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = mentions.spans_in_sentences(_spans(docs), mentions.sentences(docs, "\n"))
    return placed.select("doc_id", "start", "length", "sent_idx", (F.col("start") - F.col("pos_start")).alias("in_sentence"))


@query(rf"""WITH {_SENT}, wd AS (SELECT doc_id, sent_idx, list_filter(string_split_regex(trim(sentence), '\s+'), lambda x: x <> '') AS w FROM sent),
al AS (SELECT doc_id, sent_idx, list(w) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS b,
  list(w) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 1 FOLLOWING AND 100 FOLLOWING) AS a FROM wd)
SELECT doc_id, sent_idx, coalesce(array_to_string(list_slice(flatten(b), greatest(len(flatten(b)) - 99, 1), len(flatten(b))), ' '), '') AS left_ctx,
  coalesce(array_to_string(list_slice(flatten(a), 1, 100), ' '), '') AS right_ctx FROM al""")
def context_left_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = mentions.sentences(table(spark, sf_dir, "documents"), "\n")
    return context.sentence_contexts(sents).select("doc_id", "sent_idx", F.array_join("before", " ").alias("left_ctx"), F.array_join("after", " ").alias("right_ctx"))


_INDEX = f"""{_LINKS},
lc AS (SELECT lower(mention) AS mention, entity, count(*) AS cnt FROM named GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY cnt DESC, entity) AS r, cnt / sum(cnt) OVER (PARTITION BY mention) AS p FROM lc),
ix AS (SELECT mention, lower(mention) AS low, CAST(sum(cnt) AS BIGINT) AS freq, arg_min(entity, r) AS best, max(p) AS p FROM lr GROUP BY 1)
"""
_ASK = """ask AS (SELECT DISTINCT s AS surface FROM (SELECT mention AS s FROM named UNION ALL SELECT replace(upper(mention), 'ẞ', 'SS') FROM named
  UNION ALL SELECT mention || ',' FROM named UNION ALL SELECT lower(mention) FROM named))"""


def _surfaces(links: DataFrame) -> DataFrame:
    m = F.col("mention")
    return links.select(F.explode(F.array(m, F.upper(m), F.concat(m, F.lit(",")), F.lower(m))).alias("surface")).distinct()


@query(f"""WITH {_INDEX}, {_ASK},
v AS (SELECT surface, CASE WHEN surface = replace(upper(surface), 'ẞ', 'SS') THEN array_to_string(list_transform(regexp_extract_all(surface, '\\pL+|[^\\pL]+'),
    lambda p: upper(p[1:1]) || lower(p[2:])), '') ELSE surface END AS v1,
  trim(regexp_replace(surface, '[(.|,!'']', '', 'g')) AS t FROM ask),
lo AS (SELECT low, min(mention) AS lm, arg_min(freq, mention) AS lf FROM ix GROUP BY 1),
j AS (SELECT v.*, coalesce(a.freq, 0) AS f1, coalesce(b.freq, 0) AS fm, coalesce(c.freq, 0) AS ft, lm, coalesce(lf, 0) AS lf FROM v
  LEFT JOIN ix a ON a.mention = v1 LEFT JOIN ix b ON b.mention = surface LEFT JOIN ix c ON c.mention = t LEFT JOIN lo ON lo.low = lower(surface))
SELECT surface, CASE WHEN f1 > 0 AND NOT fm > f1 THEN v1 WHEN fm > 0 THEN surface WHEN lf > 0 THEN lm WHEN ft > 0 THEN t ELSE coalesce(lm, surface) END AS mention,
  CASE WHEN f1 > 0 AND NOT fm > f1 THEN f1 WHEN fm > 0 THEN fm WHEN lf > 0 THEN lf ELSE ft END AS freq FROM j""".replace("\\\\p", "\\p"))
def mention_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return mentions.spelling_lookup(_surfaces(linking.page_links(pages)), linking.page_index(pages))


@query(f"""WITH {_INDEX}, q AS (SELECT DISTINCT lower(mention) AS mention FROM named UNION SELECT 'nowhere')
SELECT q.mention, best AS entity, round(least(1.0, greatest(0.001, p)), 9) AS p, freq FROM q JOIN ix ON q.mention = ix.mention""")
def candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    asked = linking.page_links(pages).select(F.lower("mention").alias("mention")).union(spark.sql("SELECT 'nowhere'")).distinct()
    index = linking.page_index(pages)
    listed = mentions.candidate_lists(asked, index).join(index.select("mention", "freq"), "mention")
    return listed.select("mention", F.get("cands", F.lit(0))["entity"].alias("entity"), F.round(mentions.clamp(F.get("cands", F.lit(0))["p"]), 9).alias("p"), "freq")


@query(r"""WITH s AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM conversations),
t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM s),
n AS (SELECT doc_id, unnest([w[i:i], w[i:i+1], w[i:i+2]]) AS g, unnest([1, 2, 3]) AS size, i, len(w) AS m FROM t)
SELECT doc_id, size, count(*) AS n_ngrams, count(DISTINCT array_to_string(g, ' ')) AS n_distinct FROM n
WHERE i + size - 1 <= m AND len(list_filter(g, lambda x: regexp_full_match(x, '[^\pL\pN]+'))) = 0 GROUP BY ALL""")
def ngram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    whole = turns.select("doc_id", F.lit(0).alias("sent_idx"), F.col("text").alias("sentence"))
    return mentions.ngrams(whole, 3).groupBy("doc_id", "size").agg(F.count("*").alias("n_ngrams"), F.countDistinct("ngram").alias("n_distinct"))


@query()
def ngram_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.ngram_mentions(table(spark, sf_dir, "documents"), linking.page_index(table(spark, sf_dir, "pages")), 3)


_COREF = """
mm AS (SELECT p_size AS doc_id, p_partkey AS mention_ord, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END AS mention, p_brand AS e1, p_type AS e2 FROM part),
pr AS (SELECT a.doc_id, a.mention_ord, b.e1, b.e2 FROM mm a JOIN mm b ON a.doc_id = b.doc_id AND lower(a.mention) <> lower(b.mention)
  AND b.e1 IN ('Brand#1', 'Brand#2', 'Brand#3') AND instr(lower(b.mention), lower(a.mention)) > 0
  AND (instr(lower(b.mention), lower(a.mention)) = 1 OR substr(lower(b.mention), instr(lower(b.mention), lower(a.mention)) - 1, 1) = ' ')
  AND (instr(lower(b.mention), lower(a.mention)) + length(a.mention) - 1 = length(b.mention) OR substr(lower(b.mention), instr(lower(b.mention), lower(a.mention)) + length(a.mention), 1) = ' ')),
ct AS (SELECT doc_id, mention_ord, count(*) AS n_coref FROM pr GROUP BY ALL),
ea AS (SELECT doc_id, mention_ord, e1 AS entity, 0.75 AS p FROM pr UNION ALL SELECT doc_id, mention_ord, e2, 0.25 FROM pr)
"""


@query(f"""WITH {_COREF} SELECT ea.doc_id, ea.mention_ord, any_value(n_coref) AS n_coref, entity, round(CAST(sum(p) AS DOUBLE) / any_value(n_coref), 9) AS p
FROM ea JOIN ct ON ea.doc_id = ct.doc_id AND ea.mention_ord = ct.mention_ord GROUP BY ALL""")
def coref_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, persons = _coref_input(spark, sf_dir)
    return context.coreferent_candidates(rows, persons).withColumn("p", F.round("p", 9))


def _coref_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.split("p_name", " ")[0]).otherwise(F.col("p_name"))
    cands = F.array(F.struct(F.col("p_brand").alias("entity"), F.lit(0.75).alias("p")), F.struct(F.col("p_type").alias("entity"), F.lit(0.25).alias("p")))
    rows = part.select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("mention_ord"), name.alias("mention"), cands.alias("cands"))
    return rows, spark.createDataFrame([(f"Brand#{k}",) for k in (1, 2, 3)], "name string")


@query()
def coref_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _coref_input(spark, sf_dir)
    return context.coreference_fold(rows, {"Brand#1", "Brand#2", "Brand#3"})


@query("SELECT l_orderkey % 50 AS doc_id, l_orderkey * 10 + l_linenumber AS mention_ord, (row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 100 AS chunk FROM lineitem")
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention_ord"))
    return context.document_chunks(rows)


# Decisions, results, evaluation -------------------------------------------------------

_BEST = """
sc AS (SELECT p_type, p_brand, p_partkey AS idx, p_retailprice AS score, CASE WHEN p_partkey % 7 = 0 THEN '#UNK#' ELSE p_name END AS entity FROM part),
bs AS (SELECT p_type, p_brand, CASE WHEN e = '#UNK#' THEN 'NIL' ELSE e END AS entity, score FROM (
  SELECT p_type, p_brand, first(entity ORDER BY score DESC, idx) AS e, max(score) AS score FROM sc GROUP BY ALL))
"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    entity = F.when(F.col("p_partkey") % 7 == 0, "#UNK#").otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_type", "p_brand", F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("score"), entity.alias("entity"))
    return ranking.first_best(rows, ["p_type", "p_brand"])


@query(f"WITH {_BEST} SELECT p_type, p_brand, entity, score FROM bs")
def argmax_nil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


@query("""SELECT o_custkey AS doc_id, CAST(o_orderkey % 1000 AS INTEGER) AS start, CAST(length(o_orderpriority) AS INTEGER) AS length, o_orderpriority AS ngram,
  o_orderstatus AS entity, round(1.0 / (1.0 + exp(-(0.00001 * o_totalprice - 1.0))), 9) AS conf_ed, 0.5::DOUBLE AS conf_md, 'LOC' AS tag FROM orders WHERE o_orderstatus <> 'P'""")
def results_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    found = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("mention_ord"), (F.col("o_orderkey") % 1000).cast("int").alias("pos"), F.col("o_orderpriority").alias("ngram"), F.lit(0.5).alias("conf_md"), F.lit("LOC").alias("tag"))
    entity = F.when(F.col("o_orderstatus") == "P", "NIL").otherwise(F.col("o_orderstatus"))
    said = orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("mention_ord"), entity.alias("entity"), F.round(ranking.confidence(F.col("o_totalprice"), 1e-5, -1.0), 9).alias("conf_ed"))
    return results.shape_results(found, said)


@query("""WITH g AS (SELECT source, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS gold, CASE WHEN toxic = 1 THEN 'NIL' WHEN labels.doc_id % 3 = 0 THEN 'B' ELSE 'A' END AS pred
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id),
s AS (SELECT source, count(*) FILTER (WHERE gold = pred AND pred <> 'NIL') AS tp, count(*) FILTER (WHERE pred <> 'NIL') AS n_pred, count(*) AS n_gold, count(*) FILTER (WHERE pred = 'NIL') AS n_nil FROM g GROUP BY 1)
SELECT source, tp, n_pred, n_gold, n_nil, round(tp / nullif(n_pred, 0), 9) AS precision, round(tp / n_gold, 9) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * (tp / n_pred) * (tp / n_gold) / (tp / n_pred + tp / n_gold) END, 9) AS f1 FROM s""")
def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    gold = F.when(F.col("quality") == 1, "A").otherwise("B")
    pred = F.when(F.col("toxic") == 1, "NIL").when(F.col("doc_id") % 3 == 0, "B").otherwise("A")
    out = results.micro_scores(rows.select("source", gold.alias("gold"), pred.alias("pred")), ["source"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""SELECT count(*) FILTER (WHERE p_brand IN ('Brand#' || CAST(p_size % 25 + 1 AS VARCHAR), 'Brand#3')) AS has_gold, count(*) AS total,
  round(count(*) FILTER (WHERE p_brand IN ('Brand#' || CAST(p_size % 25 + 1 AS VARCHAR), 'Brand#3')) / count(*), 9) AS recall FROM part""")
def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit("Brand#"), (F.col("p_size") % 25 + 1).cast("string"))
    cands = F.array(F.struct(one.alias("entity"), F.lit(0.6).alias("p")), F.struct(F.lit("Brand#3").alias("entity"), F.lit(0.4).alias("p")))
    return results.candidate_recall(table(spark, sf_dir, "part").select(F.col("p_brand").alias("gold"), cands.alias("cands"))).withColumn("recall", F.round("recall", 9))


@query("SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(sum(value), 4) AS value_sum FROM events GROUP BY 1")
def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.timing_statistics(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"), F.round("value_sum", 4).alias("value_sum"))


@query(rf"""WITH {_SENT}, f AS (SELECT doc_id, sentence, min(sent_idx) AS k FROM sent GROUP BY ALL)
SELECT doc_id, string_agg(sentence, '. ' ORDER BY k) AS text, CAST(sum(len(list_filter(string_split_regex(trim(sentence), '\s+'), lambda x: x <> ''))) AS BIGINT) AS n_words
FROM f GROUP BY 1 HAVING n_words > 200""")
def distinct_sentences_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    sents = mentions.sentences(table(spark, sf_dir, "documents"), "\n")
    first = sents.groupBy("doc_id", "sentence").agg(F.min("sent_idx").alias("k")).withColumn("n", X.word_count(F.col("sentence")))
    joined = first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "sentence"))).alias("s"), F.sum("n").alias("n_words"))
    return joined.where("n_words > 200").select("doc_id", F.array_join(F.transform("s", lambda x: x["sentence"]), ". ").alias("text"), "n_words")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice / 100000, 9) AS score, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS label,
  round(1.0 / (1.0 + exp(-(0.7 * l_extendedprice / 100000 + 0.1))), 9) AS conf FROM lineitem""")
def confidence_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_extendedprice") / 100000)
    return rows.select("l_orderkey", "l_linenumber", F.round("score", 9).alias("score"), (F.col("l_returnflag") == "A").cast("int").alias("label"), F.round(ranking.confidence(F.col("score"), 0.7, 0.1), 9).alias("conf"))


@query("""SELECT l_orderkey, round(1 - sum(greatest(0, x - b + 1)) / greatest(count(*), 1), 9) AS conf FROM (
  SELECT l_orderkey, l_discount AS x, max(l_discount) OVER (PARTITION BY l_orderkey) AS b FROM lineitem) GROUP BY 1""")
def legacy_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_discount")).alias("s"))
    return own.select("l_orderkey", F.round(ranking.hinge_confidence(F.col("s"), F.array_max("s")), 9).alias("conf"))


@query()
def lr_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("score"), (F.col("l_quantity") + 40 * F.col("l_discount") > 27).cast("int").alias("label"))
    weight, bias = ranking.fit_calibration(rows)
    return ranking.thresholded_f1(rows.withColumn("prob", ranking.confidence(F.col("score"), weight, bias)))


@query(f"""WITH {_SENT}, g AS (SELECT doc_id, k * 37 AS pos, 4 AS len FROM documents, range(6) r(k))
SELECT g.doc_id, g.pos, sent_idx FROM g JOIN sent s ON g.doc_id = s.doc_id AND g.pos >= pos_start AND g.pos <= pos_end + 1 - g.len""")
def gold_offset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gold = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(185), F.lit(37))).alias("pos"))
    sents = mentions.sentences(docs, "\n").select(F.col("doc_id").alias("d"), "sent_idx", "pos_start", "pos_end")
    return gold.join(sents, (F.col("doc_id") == F.col("d")) & (F.col("pos") >= F.col("pos_start")) & (F.col("pos") <= F.col("pos_end") - 3)).select("doc_id", "pos", "sent_idx")


def _wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("{{disambig}}\n"), F.col("html"))).otherwise(F.col("html"))
    cats = F.split(F.regexp_extract("url", r"://([^/?#]*)", 1), r"\.")
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, "14").otherwise("0").alias("ns"), text.alias("text"), (F.col("page_id") % 7 == 0).alias("is_redirect"), cats.alias("cats"))


@query("""SELECT count(*) AS n_pages, count(*) FILTER (WHERE page_id % 5 <> 0) AS n_articles, count(*) FILTER (WHERE page_id % 7 = 0) AS n_redirects,
  count(*) FILTER (WHERE page_id % 5 <> 0 AND page_id % 11 = 0) AS n_disambiguation,
  count(*) FILTER (WHERE page_id % 5 <> 0 AND page_id % 11 <> 0 AND page_id % 7 <> 0) AS n_used FROM pages""")
def page_filter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.page_counters(_wiki_pages(spark, sf_dir))


@query("""SELECT page_id FROM pages WHERE list_has_any(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.'), ['org', 'net'])
  AND NOT list_has_any(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.'), ['m', 'blog'])""")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wiki_pages(spark, sf_dir).where(markup.category_selected(F.col("cats"), ["org", "net"], ["m", "blog"])).select("page_id")


@query()
def wikitext_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.clean_text("html").alias("text"))


#: Templates of the expansion query.
_TEMPLATES = {
    "Card": "<{{{kind}}}> {{#ifeq:{{{1}}}|7|seven|{{uc:n}}{{{1}}}}}{{Mark|{{{2|none}}}}}",
    "Mark": "#REDIRECT [[Template:Real mark]]",
    "Real mark": "<noinclude>doc</noinclude> ({{#if:{{{1}}}|{{#invoke:String|sub|{{{1}}}|1|3}}|-}})",
}


@query("""SELECT page_id, '<' || CASE page_id % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END || '> ' || CASE WHEN page_id = 7 THEN 'seven' ELSE 'N' || CAST(page_id AS VARCHAR) END
  || ' (' || CASE WHEN page_id % 2 = 0 THEN 'P ' || left(CAST(page_id AS VARCHAR), 1) ELSE 'non' END || ')' || ' = ' || CAST(page_id * 2 + 1 AS VARCHAR) AS text FROM pages""")
def wikitext_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("page_id").cast("string")
    second = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("|{{PAGENAME}}"))).otherwise("")
    text = F.concat(
        F.lit("{{Card|"), number, F.lit("|kind={{#switch:{{#expr:"), number, F.lit(" mod 3}}|0=zero|1=one|#default=many}}"), second, F.lit("}} = {{#expr:"), number, F.lit("*2+1}}")
    )
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("P "), number).alias("title"), text.alias("text"))
    return wikitext.expand_pages(pages, _TEMPLATES).select("page_id", "text")


@query("""SELECT conv_id * 1000 + turn AS doc_id, replace(text, '&amp;', '&') AS text, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS n_spans,
  CASE WHEN turn % 2 = 0 THEN 'ED' ELSE 'EL' END AS mode FROM conversations""")
def request_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    spans = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("length"))))
    bodies = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.to_json(F.struct("text", spans.alias("spans"))).alias("body"))
    asked = readers.requests(bodies)
    return asked.select("doc_id", "text", F.size("spans").alias("n_spans"), F.when(F.size("spans") > 0, "ED").otherwise("EL").alias("mode"))


@query()
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.link_documents(table(spark, sf_dir, "documents"), linking.page_index(table(spark, sf_dir, "pages")))


@query()
def ranker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("emb"))
    rows = features.packed(vectors).select(F.col("word").cast("long").alias("vec_id"), F.col("emb").alias("embedding")).withColumn("m", F.expr("vec_id div 16"))
    own = rows.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v")).where(F.size("v") == 16)
    vectors = F.transform("v", lambda x: x["embedding"])
    shaped = own.select(
        F.expr("m div 8").alias("doc_id"), F.lit(0).cast("long").alias("chunk"), F.col("m").alias("mention_ord"), F.slice(vectors, 1, 5).alias("tokens"),
        F.slice(vectors, 6, 2).alias("left"), F.slice(vectors, 8, 1).alias("inside"), F.slice(vectors, 9, 2).alias("right"),
        F.slice(vectors, F.lit(11), (F.col("m") % 6 + 1).cast("int")).alias("entities"), F.array_repeat(F.lit(0.25), (F.col("m") % 6 + 1).cast("int")).alias("prior"),
    )
    scored = joint.joint_scores(shaped, joint.initial_parameters(64), np.full(64, 0.01))
    return scored.select("doc_id", "mention_ord", F.posexplode("scores").alias("k", "s")).select("doc_id", "mention_ord", "k", F.round("s", 6).alias("score"))


# Disambiguation -------------------------------------------------------------------------


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


def _knowledge(spark: SparkSession, sf_dir: str) -> disambiguation.KnowledgeBase:
    """An ambiguous index over words of the turns (a word, and four words that it may stand
    for), vectors of nine in ten of these by hash, three words as persons."""
    words = _turns(spark, sf_dir).select(F.explode(X.space_tokens(F.col("text"))).alias("mention")).groupBy("mention").agg(F.count("*").alias("freq"))
    words = stored.written(words, "words")
    entity = lambda k: F.concat(F.lit("E"), F.pmod(F.crc32("mention") + 7 * k, F.lit(97)).cast("string"))
    cands = F.array(*[F.struct(entity(k).alias("entity"), F.lit(p).alias("p")) for k, p in ((0, 0.4), (1, 0.3), (2, 0.2), (3, 0.1))])
    index = words.where("length(mention) > 2").select("mention", F.lower("mention").alias("lower"), "freq", cands.alias("cands"))
    keys = words.select(F.col("mention").alias("word")).union(spark.range(97).select(F.concat(F.lit("ENTITY/E"), F.col("id").cast("string"))))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("emb"))
    known = keys.where("crc32(word) % 10 <> 0").withColumn("v", F.crc32("word") % F.lit(rows.count()))
    unknown = spark.createDataFrame([(w,) for w in features.UNKNOWN.values()], "word string").withColumn("v", F.lit(0).cast("long"))
    vectors = known.unionByName(unknown).join(rows, "v").select("word", "emb")
    return disambiguation.KnowledgeBase(index, vectors, spark.createDataFrame([("E1",), ("E2",), ("E3",)], "name string"))


@query()
def ed_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns to mentions, contexts, candidates, coreference, features, joint scores, decisions."""
    linker = disambiguation.Linker(_knowledge(spark, sf_dir), joint.initial_parameters(64), (0.5, -0.1))
    return linker.linked(_turns(spark, sf_dir))


@query("""WITH e AS (SELECT vec_id // 10 AS m, vec_id % 10 AS idx, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 10 <= vec_id // 10 % 9),
q AS (SELECT vec_id AS m, CAST(embedding AS DOUBLE[]) AS c FROM embeddings),
s AS (SELECT e.m, idx, list_dot_product(x, c) AS s FROM e JOIN q ON e.m = q.m),
t AS (SELECT *, max(s) OVER (PARTITION BY m) AS top FROM s)
SELECT m, idx, round(s - top - ln(sum(exp(s - top)) OVER (PARTITION BY m)), 6) AS log_p FROM t""")
def prerank_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    cands = rows.select(F.expr("vec_id div 10").alias("m"), (F.col("vec_id") % 10).alias("idx"), F.col("embedding").alias("emb")).where("idx <= m % 9")
    scored = cands.join(rows.select(F.col("vec_id").alias("m"), F.col("embedding").alias("ctx")), "m").withColumn("ctx_score", X.dot(F.col("emb"), F.col("ctx")))
    return ranking.log_probabilities(scored, ["m"]).select("m", "idx", F.round("ctx_score", 6).alias("log_p"))


@query("""WITH c AS (SELECT l_orderkey AS m, list(CAST(l_suppkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS names,
  list(CASE WHEN l_linenumber <= l_orderkey % 4 THEN 1.0 ELSE 0.0 END ORDER BY l_linenumber, l_partkey, l_suppkey) AS mask,
  list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_suppkey) AS scores FROM lineitem GROUP BY 1)
SELECT m, CASE WHEN mask[list_position(scores, list_max(scores))] = 1 THEN names[list_position(scores, list_max(scores))]
  WHEN mask[1] = 1 THEN names[1] ELSE 'NIL' END AS entity FROM c""")
def decode_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.when(F.col("l_linenumber") <= F.col("l_orderkey") % 4, 1.0).otherwise(0.0)
    cells = F.struct("l_linenumber", "l_partkey", "l_suppkey", mask.alias("mask"), "l_extendedprice")
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("m")).agg(F.sort_array(F.collect_list(cells)).alias("c"))
    pick = lambda f: F.transform("c", lambda x: f(x))
    return own.select("m", ranking.decode(pick(lambda x: x["l_suppkey"].cast("string")), pick(lambda x: x["mask"]), pick(lambda x: x["l_extendedprice"])).alias("entity"))
