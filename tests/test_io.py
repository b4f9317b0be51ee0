"""Sinks, gold corpora, taggers and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import corpora, joint, markup, ranking, taggers, wikitext
from brindle.operators.results import relocated
from brindle.plans import disambiguation, knowledge, linking
from brindle.sources import readers, services, sinks
from brindle.streaming import linking as stream

CANDS = "mention string, lower string, freq long, cands array<struct<entity:string,p:double>>"


def test_index_sink(spark, tmp_path):
    rows = [("Fox", "fox", 5, [("E", 1.0)]), ("Ant", "ant", 1, [("A", 1.0)])]
    sinks.write_index(spark.createDataFrame(rows, CANDS), str(tmp_path / "i"), 2)
    assert [r.mention for r in spark.read.parquet(str(tmp_path / "i")).orderBy("mention").collect()] == ["Ant", "Fox"]
    with pytest.raises(ValueError, match="more than once"):
        sinks.write_index(spark.createDataFrame([*rows, rows[0]], CANDS), str(tmp_path / "j"))


def test_articles_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(7, "T", 'see <a href="New%20York">NY</a>', "0", False, None), (8, "R", "{{disambig}}", "0", True, "T")], "id long, title string, text string, ns string, is_redirect boolean, redirect_title string")
    sinks.write_articles(pages, str(tmp_path / "a"), "http://w", compress=True)
    lines = readers.numbered_lines(spark, str(tmp_path / "a"))
    assert lines.where("line LIKE '<doc id=%'").count() == 2
    sinks.write_articles(pages, str(tmp_path / "b"), "http://w", as_json=True)
    assert {r.url for r in spark.read.json(str(tmp_path / "b")).collect()} == {"http://w?curid=7", "http://w?curid=8"}
    sinks.write_side_tables(pages, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s/redirects")).first().value == "R\tT\t8"
    assert spark.read.text(str(tmp_path / "s/disambiguation")).first().value == "8\tR"


def test_parameters_round_trip(spark, tmp_path):
    p = joint.initial_parameters(6)
    sinks.save_parameters(spark, p, {"a": 1}, str(tmp_path / "m"))
    back, config = sinks.load_parameters(spark, str(tmp_path / "m"))
    assert config == {"a": 1} and all(np.array_equal(back[k], v) for k, v in p.items())


def test_gold_tokens(spark):
    lines = [
        "-DOCSTART- (1testa EU)", "EU\tB\tEU\tEuropean_Union\thttp://kb/wiki/European_Union\t9", "says\t", "no", "", "to", "NEW\tB\tNEW YORK\tx\thttp://kb/wiki/New_York\t7\t8", "YORK\tI\tNEW YORK", "Élan",
        ".", "", "GERMAN\tB\tGERMAN\t--NME--", "Lamb", "-DOCSTART- (2 Other)", "x",
    ]
    frame = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, ord long, line string")
    tokens = corpora.token_rows(frame)
    sents = [(r.doc, r.sent_idx, r.sentence) for r in corpora.gold_sentences(tokens).orderBy("doc", "sent_idx").collect()]
    assert sents == [(1, 0, "Eu says no to New York Elan"), (1, 1, "German Lamb"), (2, 0, "x")]
    gold = corpora.gold_mentions(tokens).orderBy("mention_ord").collect()
    assert [(r.doc_name, r.dataset, r.sent_idx, r.start, r.mention, r.title) for r in gold] == [("1testa", "development", 0, 0, "EU", "European Union"), ("1testa", "development", 0, 14, "NEW YORK", "New York")]
    train, rest = corpora.train_and_rest(tokens)
    assert {r.doc for r in train.collect()} == {2} and {r.doc for r in rest.collect()} == {1}


def test_annotated_texts(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "d one").write_text("Ann &amp; Bob met\n\nBob in York\n")
    (tmp_path / "ann.xml").write_text(
        "<x><document docName='d one'><annotation><mention>Bob</mention><wikiName>Bob</wikiName><offset>6</offset><length>3</length></annotation>"
        "<annotation><mention>York</mention><wikiName>York_city</wikiName><offset>28</offset><length>4</length></annotation>"
        "<annotation><mention>Ann</mention><wikiName>NIL</wikiName><offset>0</offset><length>3</length></annotation></document></x>"
    )
    texts = readers.raw_texts(spark, str(tmp_path / "raw"))
    assert texts.first().text == "Ann & Bob met\n \n Bob in York\n"
    annotations = readers.annotated_corpus(spark, str(tmp_path / "ann.xml"))
    sents, gold = corpora.annotated_sentences(annotations, texts)
    found = [(r.mention_ord, r.sent_idx, r.start, r.surface, r.sentence) for r in gold.orderBy("mention_ord").collect()]
    assert found == [(0, 0, 6, "Bob", "Ann & Bob met"), (1, 1, 8, "York", " Bob in York")]
    index = spark.createDataFrame([("York", "york", 5, [("York_city", 1.0)])], CANDS)
    records = {r.surface: r for r in corpora.gold_records(gold, sents, index).collect()}
    assert records["York"].gold == "York_city" and records["York"].cands[0].entity == "York_city" and records["York"].left_ctx == "Ann & Bob met Bob in" and not records["Bob"].cands
    path = str(tmp_path / "gold")
    sinks.write_gold(gold.withColumn("dataset", F.lit("w")), path)
    assert readers.gold_datasets(spark, path, ["w"]).count() == 2 and readers.gold_datasets(spark, path, None, ("d one",)).count() == 0
    bad = annotations.withColumn("mention", F.lit("Nobody"))
    with pytest.raises(ValueError, match="not in their texts"):
        corpora.annotated_sentences(bad, texts)


def test_numbered_lines_across_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" for k in range(5000)))
    (tmp_path / "b.txt").write_text("x\r\n\ny")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).collect()
        assert readers.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {n: sorted((r.ord, r.line) for r in rows if r.file.endswith(n)) for n in ("a.txt", "b.txt")}
    assert by_file["a.txt"] == [(k, f"line {k}") for k in range(5000)] and by_file["b.txt"] == [(0, "x"), (1, ""), (2, "y")]


def test_anchor_lines(spark, tmp_path):
    (tmp_path / "AA").write_text('<doc id="3" url="u" title="A">\n<a href="X">x</a>\n</doc>\n<doc id="2" url="u" title="B">\nold\n</doc>\n')
    (tmp_path / "BB").write_text('<doc id="3" url="u" title="A">\nagain\n</doc>\n<doc id="9" url="u" title="C">\n<a href="Y%20Z">y <b>open\n</doc>\n')
    rows = readers.anchor_lines(spark, str(tmp_path)).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.line) for r in rows] == [(3, '<a href="X">x</a>'), (3, "</doc>"), (9, '<a href="Y%20Z">y <b>open'), (9, "</doc>")]
    from brindle.operators import counts, pem

    links = counts.anchors(spark.createDataFrame(rows), ["doc_id", "ord"])
    assert [(r.target, r.mention) for r in links.orderBy("doc_id").collect()] == [("X", "x"), ("Y Z", "y <b>open")]
    seen = spark.createDataFrame([(1, "m", "b"), (2, "m", "a")], "ord int, mention string, entity string")
    assert [r.entity for r in pem.top_entities(counts.pair_counts(seen, place=["ord"])).orderBy("rank").collect()] == ["b", "a"]
    assert [r.entity for r in pem.top_entities(counts.pair_counts(seen)).orderBy("rank").collect()] == ["a", "b"]


def test_knowledge_base_from_files(spark, tmp_path):
    """Dimensions in their order, links with two redirects, cross counts, a prior, the index."""
    for name, text in (("disambiguation", "7\tB (disambiguation)\n"), ("redirects", "Nyc\tBig apple\nBig apple\tNew York\nOld\tParis\t90\n"), ("names", "New%20York\t1\nB\t7\nParis\t2\n")):
        (tmp_path / name).write_text(text)
    dimensions = disambiguation.Dimensions.load(spark, f"{tmp_path}/")
    lines = spark.createDataFrame([(0, '<a href="nyc">ny</a> <a href="New_York">ny</a> <a href="Paris">ny</a> <a href="B">ny</a> <a href="List of x">l</a> <a href="wikt:Paris">p</a>')], "ord int, line string")
    links = knowledge.link_counts(lines, dimensions, ["ord"])
    assert {(r.mention, r.entity): r.cnt for r in links.collect()} == {("ny", "New_York"): 2, ("ny", "Paris"): 1, ("p", "Paris"): 1}
    cross = knowledge.cross_counts(spark.createDataFrame([("ny\t9\t1,4\t90,5\t55,1",)], "line string"), dimensions)
    assert {(r.mention, r.entity): r.cnt for r in cross.collect()} == {("ny", "New_York"): 4, ("ny", "Paris"): 5}
    prior = knowledge.known_pairs(spark.createDataFrame([("ny", "nyc"), ("only", "Paris"), ("only", "Nowhere")], "mention string, entity string"), dimensions)
    index = {r.mention: r for r in knowledge.build_index([links, cross], prior).collect()}
    # The prior's title is redirected once only, to a title that is not known.
    assert [(c.entity, round(c.p, 3)) for c in index["ny"].cands] == [("New_York", 0.5), ("Paris", 0.5)] and index["ny"].freq == 12
    assert [tuple(c) for c in index["only"].cands] == [("Paris", 1.0)] and index["only"].freq == 1


def test_long_ragged_lines(spark):
    pairs = "\t".join(f"{k},1" for k in range(3000))
    lines = spark.createDataFrame([(f"m\t3000\t{pairs}",), ("n\t1",), ("Wikipedia\t1\t5,5",)], "line string")
    assert readers.cross_counts(lines).count() == 3000


def test_services(spark, tmp_path):
    results = spark.createDataFrame([(1, 4, 3, "New_York"), (1, 0, 3, "A"), (2, 1, 1, "B")], "doc_id int, start int, length int, entity string")
    turtle = {r.doc_id: r.turtle for r in services.nif_responses(results).collect()}
    assert turtle[1].index("/A>") < turtle[1].index(services.RESOURCES + "New_York") and 'nif:endIndex "7"' in turtle[1]
    body = '{"Resources":[{"@URI":"http://u/Q","@offset":"5","@surfaceForm":"word","@types":"DBpedia:Place,Schema:Place,Freebase:/m"}]}'
    got = services.annotations(spark.createDataFrame([(1, body), (2, "{}"), (3, None)], "doc_id int, body string")).collect()
    assert [(r.doc_id, r.start, r.length, r.uri, list(r.types)) for r in got] == [(1, 5, 4, "http://u/Q", ["http://dbpedia.org/ontology/Place", "http://rdf.freebase.com/ns//m"])]
    asked = spark.createDataFrame([(1, "t&amp;", [(0, 1)])], "doc_id int, text string, spans array<struct<start:int,length:int>>")
    bodies = asked.select("doc_id", services.request_body(F.col("text"), F.col("spans")).alias("body"))
    assert readers.requests(bodies).first() == (1, "t&", [(0, 1)])
    assert [r.body for r in services.answered(spark.createDataFrame([(1, 200, "x"), (2, 500, "y")], "doc_id int, status int, body string")).orderBy("doc_id").collect()] == ["x", None]
    (tmp_path / "q").write_text("first\n\nsecond\n")
    assert sorted(r.text for r in readers.query_lines(spark, str(tmp_path / "q")).collect()) == ["first", "second"]
    sents = spark.createDataFrame([(1, 1, "Fox ran.")], "doc_id int, sent_idx int, sentence string")
    docs = spark.createDataFrame([(1, "Hi. Fox ran.")], "doc_id int, text string")
    assert relocated(spark.createDataFrame([(1, 1, 0, "Fox")], "doc_id int, sent_idx int, start int, ngram string"), sents, docs).first().start == 4


def test_dump_extras(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        "<mediawiki><siteinfo><sitename>W</sitename><base>http://b</base><namespaces><namespace key='10'>Template</namespace></namespaces></siteinfo>"
        "<page><title>Template:hi</title><ns>10</ns><id>5</id><revision><id>6</id><text>Hello {{{1}}}</text></revision></page>"
        "<page><title>P</title><ns>0</ns><id>7</id><revision><id>8</id><text>{{Hi|you}} {{PAGENAME}}</text></revision></page></mediawiki>"
    )
    pages = readers.dump_pages(spark, str(tmp_path / "d.xml"))
    info = readers.site_information(spark, str(tmp_path / "d.xml")).first()
    assert (info.sitename, info.base, info.namespaces[0].name) == ("W", "http://b", "Template")
    assert readers.single_article(pages, 7).first().title == "P" and readers.single_article(pages, title="P").count() == 1
    sinks.write_templates(pages, str(tmp_path / "t"))
    table = wikitext.template_table(spark.read.parquet(str(tmp_path / "t")))
    assert table == {"Hi": "Hello {{{1}}}"}
    with pytest.raises(ValueError, match="more than"):
        wikitext.template_table(wikitext.template_pages(pages), 3)
    assert wikitext.expand_pages(pages.where("ns = '0'"), table).first().text == "Hello you P"
    assert [sinks.byte_size(x) for x in ("7", "2k", "1M", "3G")] == [7, 2048, 1 << 20, 3 << 30]
    twice = spark.createDataFrame([("f", 1, 5), ("f", 2, 5), ("f", 3, 6), ("f", 4, 5)], "file string, ord int, id int")
    assert [r.ord for r in markup.consecutive_once(twice).orderBy("ord").collect()] == [1, 3, 4]
    sinks.write_articles(pages.select("id", "title", "text"), str(tmp_path / "o"), "http://w", as_json=True, file_bytes=10, order="id")
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_vocabulary_and_vectors(spark):
    words = spark.createDataFrame([("b",), ("a",), ("b",)], "word string")
    known = ranking.vocabulary(words)
    assert {r.word: r.id for r in known.collect()} == {"a": 0, "b": 1}
    assert sorted((r.word, r.id) for r in ranking.word_ids(spark.createDataFrame([("a",), ("z",)], "word string"), known, 9).collect()) == [("a", 0), ("z", 9)]
    old, new = (spark.createDataFrame([(w, [x])], "word string, emb array<float>") for w, x in (("a", 1.0), ("b", 2.0)))
    assert ranking.appended_vectors(old, old.unionByName(new)).count() == 2


def test_annotations_and_titles(spark):
    ann = spark.createDataFrame([("d", "York", "York", 14)], "doc_name string, mention string, title string, start int")
    texts = spark.createDataFrame([("d", "York and new York too")], "doc_name string, text string")
    assert corpora.placed_annotations(ann, texts).first().pos == 13
    gold = spark.createDataFrame([("nyc",), ("Known",), ("lost",)], "title string")
    names = spark.createDataFrame([("New York", 1), ("Known", 2)], "name string, id long")
    red = spark.createDataFrame([(0, "Nyc", "New York", 5)], "ord int, from_title string, to_title string, from_id long")
    assert sorted(r.title for r in corpora.repaired_titles(gold, names, red).collect()) == ["Known", "New York", "lost"]


def test_tagger(spark):
    def capitals(sentence):
        at = 0
        for word in sentence.split(" "):
            if word[:1].isupper():
                yield word, at, at + len(word), 1.0, "CAP"
            at += len(word) + 1

    sents = spark.createDataFrame([(1, "a Fox and Bob"), (2, "none")], "doc_id int, sentence string")
    assert [(r.doc_id, r.text, r.start_pos) for r in taggers.tag_sentences(sents, capitals).orderBy("start_pos").collect()] == [(1, "Fox", 2), (1, "Bob", 10)]


def test_stream_equals_batch(spark, tmp_path):
    index = spark.createDataFrame([("Fox", "fox", 5, [("E", 1.0)])], CANDS)
    docs = spark.createDataFrame([(k, f"the Fox {k}", []) for k in range(6)], stream.DOCUMENTS)
    docs.repartition(3).write.json(str(tmp_path / "in"))
    query = stream.link_stream(stream.read_documents(spark, str(tmp_path / "in"), 1), index, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("doc_id", "body").collect()))
    assert got == sorted(map(tuple, linking.answer(docs, index).collect())) and len(got) == 6
