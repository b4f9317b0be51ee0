"""Small hand-computed cases for the entity-linking operators."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import context, counts, kb, markup, mentions, pem, ranking, results
from brindle.plans import linking
from brindle.sources import readers


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    "f, given, want",
    [
        (X.first_upper, "élan", "Élan"),
        (X.first_upper, "", ""),
        (X.percent_decode, "a+b%20c%C3%A9%zz%", "a+b cé%zz%"),
        (X.normalise_entity, " new_york &amp; co ", "New york & co"),
        (X.strip_noise, "(Place,!'", "Place"),
        (X.title_if_upper, "O'BRIEN AL-NAHAR U.S. STEEL", "O'Brien Al-Nahar U.S. Steel"),
        (X.title_if_upper, "Mixed Case", "Mixed Case"),
        (X.to_ascii, "Ünß", "Unss"),
        (X.title_from_url, "http://kb/wiki/New_York", "New York"),
        (X.unescape_unicode, r"café 😀", "café 😀"),
        (X.bracket_token, "-LRB-", "("),
    ],
)
def test_scalars(spark, f, given, want):
    assert one(spark, given, f) == want


def test_predicates(spark):
    rows = spark.createDataFrame([(w,) for w in ("the", "a", "x", "1_000", "3.5e2", "nan", "word", "-7", "v2")], "w string")
    assert [r.w for r in rows.where(X.is_important(F.col("w"))).collect()] == ["word", "v2"]
    assert one(spark, "a,b c", X.tokens_with_separators) == ["a", ",", "b", "c"]
    assert one(spark, "._-", X.is_punctuation) and not one(spark, "a.", X.is_punctuation)


def test_padding_and_tail(spark):
    row = spark.createDataFrame([([1, 2, 3],)], "a array<int>").select(
        X.tail(F.col("a"), 5).alias("t"), X.tail(F.col("a"), 2).alias("u"), X.pad_right(F.col("a"), 5, F.lit(0)).alias("p"), X.pad_mask(F.col("a"), 5).alias("m")
    )
    assert tuple(row.first()) == ([1, 2, 3], [2, 3], [1, 2, 3, 0, 0], [1.0, 1.0, 1.0, 0.0, 0.0])


def test_readers(spark, tmp_path):
    (tmp_path / "dis.txt").write_text("7\tA (disambiguation)\n")
    (tmp_path / "names.txt").write_text("New%20York\t1\nB\t7\nParis\t2\nParis\t3\n")
    (tmp_path / "red.txt").write_text("NYC\tNew York\nbroken\nOld\tParis\t9\n")
    dis = readers.disambiguation_pages(spark, str(tmp_path / "dis.txt"))
    names = readers.name_map(spark, str(tmp_path / "names.txt"), dis)
    assert {(r.name, r.id) for r in kb.last_wins(names, "name").collect()} == {("New York", 1), ("Paris", 3)}
    red = readers.redirects(spark, str(tmp_path / "red.txt"))
    assert [(r.from_title, r.to_title, r.from_id) for r in red.orderBy("ord").collect()] == [("NYC", "New York", None), ("Old", "Paris", 9)]
    (tmp_path / "vec.txt").write_text("3 2\na 1 2\nb 3 4\na 9 9\n")
    assert {r.word: list(r.emb) for r in readers.vectors(spark, str(tmp_path / "vec.txt")).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    (tmp_path / "bad.txt").write_text("1 2\na 1\n")
    with pytest.raises(Exception, match="another length"):
        readers.vectors(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "dump.xml").write_text(
        "<mediawiki><page><title>T</title><ns>0</ns><id>5</id><revision><id>6</id><text xml:space='preserve'>x [[Category:C|k]]</text></revision></page>"
        "<page><title>R</title><ns>0</ns><id>8</id><redirect title='T'/><revision><id>9</id><text>#R</text></revision></page></mediawiki>"
    )
    pages = {r.id: r for r in readers.dump_pages(spark, str(tmp_path / "dump.xml")).collect()}
    assert pages[5].cats == ["C"] and not pages[5].is_redirect and pages[8].redirect_title == "T"
    (tmp_path / "cats.txt").write_text("# no\nIn\n^Out\n")
    assert {tuple(r) for r in readers.category_filter(spark, str(tmp_path / "cats.txt")).collect()} == {("In", False), ("Out", True)}


def test_requests_and_nif(spark):
    bodies = [(1, '{"text":"a &amp; b","spans":[{"start":1,"length":2}]}'), (2, '{"text":"x","spans":[[0,1]]}'), (3, '{"text":"y"}'), (4, "broken")]
    got = {r.doc_id: (r.text, [tuple(s) for s in r.spans]) for r in readers.requests(spark.createDataFrame(bodies, "doc_id int, body string")).collect()}
    assert got == {1: ("a & b", [(1, 2)]), 2: ("x", [(0, 1)]), 3: ("y", []), 4: ("", [])}
    turtle = '<#c> nif:isString "hello you" ; nif:beginIndex "0" ; nif:endIndex "9" . <#s> nif:beginIndex "6" ; nif:endIndex "9" .'
    row = readers.nif_documents(spark.createDataFrame([(1, turtle)], "doc_id int, turtle string")).first()
    assert row.text == "hello you" and [tuple(s) for s in row.spans] == [(6, 3)]


def test_redirect_hops(spark):
    red = spark.createDataFrame([(0, "A", "B", 1), (1, "B", "C", 2), (2, "C", "D", 3)], "ord int, from_title string, to_title string, from_id long")
    rows = spark.createDataFrame([("a",), ("z",)], "title string")
    assert {r.title for r in kb.redirect_titles(rows, red).collect()} == {"B", "Z"}
    assert {r.title for r in kb.redirect_titles(rows, red, hops=2).collect()} == {"C", "Z"}
    names = spark.createDataFrame([("D", 7)], "name string, id long")
    assert [r.id for r in kb.title_ids(spark.createDataFrame([("D",), ("Q",)], "title string"), names).orderBy("title").collect()] == [7, -1]
    ids = kb.redirect_ids(spark.createDataFrame([(7,), (3,), (55,)], "target_id long"), names, red)
    assert sorted(r.target_id for r in ids.collect()) == [3, 7]


def test_links(spark):
    lines = spark.createDataFrame([(1, 'x <a href="New%20York">NY</a> <a href="List of x">l</a> <a href="wikt:b">b</a> <a href="c#d">c</a> <a href="e">Wikipedia</a>')], "page int, line string")
    got = counts.valid_links(counts.anchors(lines, ["page"]))
    assert {(r.mention, r.target) for r in got.collect()} == {("NY", "New York"), ("b", "b")}


def test_running_documents_by_shard(spark):
    rows = [(0, 0, 3), (0, 1, None), (0, 2, 2), (0, 3, None), (1, 4, 5), (1, 5, None), (2, 6, 4), (2, 7, None), (2, 8, 9)]
    frame = spark.createDataFrame(rows, "shard int, ord int, header_id long")
    whole = {(r.ord, r.doc_id) for r in counts.running_documents(frame, ["ord"]).collect()}
    assert whole == {(0, 3), (1, 3), (4, 5), (5, 5), (8, 9)}
    by_shard = counts.running_documents(frame, ["ord"], "shard").collect()
    assert {(r.ord, r.doc_id) for r in by_shard if r.header_id is not None} == {(0, 3), (4, 5), (8, 9)}


def test_index(spark):
    rows = [("m", f"e{k:03}", 200 - k) for k in range(150)] + [("q", "x", 3), ("q", "y", 1), ("", "z", 5)]
    frame = spark.createDataFrame(rows, "mention string, entity string, cnt long")
    top = pem.top_entities(frame)
    assert top.where("mention = 'm'").count() == 100 and top.where("mention = ''").count() == 0
    assert abs(top.where("mention = 'm'").agg(F.sum("p")).first()[0] - 1) < 1e-9
    prior = pem.uniform_prior(spark.createDataFrame([("q", "x"), ("q", "x"), ("q", "new"), ("only", "a"), ("only", "b"), ("only", "c")], "mention string, entity string"))
    got = {(r.mention, r.entity): r.p for r in pem.merge_prior(top, prior).collect() if r.mention != "m"}
    assert got == {("q", "x"): 1.0, ("q", "y"): 0.25, ("q", "new"): 0.5, ("only", "a"): 1 / 3, ("only", "b"): 1 / 3, ("only", "c"): 1 / 3}


def index_of(spark, *rows):
    return spark.createDataFrame([(m, m.lower(), f, [(e, p) for e, p in c]) for m, f, c in rows], "mention string, lower string, freq long, cands array<struct<entity:string,p:double>>")


def test_sentences_and_ngrams(spark):
    docs = spark.createDataFrame([(1, "Fox, Fox. Fox."), (2, "Fox." + " " * 16 + "Fox." + " " * 19 + "Fox."), (3, None), (4, "alpha , beta")], "doc_id int, text string")
    sents = mentions.sentences(docs)
    assert [(r.pos_start, r.sentence) for r in sents.where("doc_id = 2").orderBy("sent_idx").collect()] == [(0, "Fox."), (20, "Fox."), (43, "Fox.")]
    index = index_of(spark, ("Fox", 5, [("E", 1.0)]))
    found = mentions.ngram_mentions(docs, index, 2).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.mention) for r in found] == [(1, 0, "Fox"), (1, 5, "Fox"), (1, 10, "Fox"), (2, 0, "Fox"), (2, 20, "Fox"), (2, 43, "Fox")]
    assert {r.ngram for r in mentions.ngrams(sents.where("doc_id = 4"), 3).collect()} == {"alpha", "beta"}
    pangram = spark.createDataFrame([(1, "the brown fox jumped over the lazy dog")], "doc_id int, text string")
    words = index_of(spark, *[(w, 1, [("E", 1.0)]) for w in "the brown fox jumped over lazy dog".split()])
    spans = sorted((r.pos, r.pos + len(r.surface)) for r in mentions.ngram_mentions(pangram, words, 5).collect())
    assert spans == [(0, 3), (4, 9), (10, 13), (14, 20), (21, 25), (26, 29), (30, 34), (35, 38)]


def test_nested_mentions_lose(spark):
    docs = spark.createDataFrame([(1, "new york city hall")], "doc_id int, text string")
    index = index_of(spark, *[(m, 2, [("E", 1.0)]) for m in ("new york", "york", "york city hall", "hall")])
    assert {r.surface for r in mentions.ngram_mentions(docs, index, 3).collect()} == {"york city hall", "new york"}


def test_spelling_fallback(spark):
    index = index_of(spark, ("Paris", 9, []), ("PARIS", 2, []), ("nasa", 4, []), ("NASA", 7, []), ("Place", 3, []), ("zero", 0, []), ("iPhone", 6, []))
    asked = spark.createDataFrame([(s,) for s in ("PARIS", "NASA", "IPHONE", "Place,", "zero", "none")], "surface string")
    got = {r.surface: (r.mention, r.freq) for r in mentions.spelling_lookup(asked, index).collect()}
    assert got == {"PARIS": ("Paris", 9), "NASA": ("NASA", 7), "IPHONE": ("iPhone", 6), "Place,": ("Place", 3), "zero": ("zero", 0), "none": ("none", 0)}


def test_contexts(spark):
    sents = spark.createDataFrame([(1, k, f"w{k}a w{k}b") for k in range(4)], "doc_id int, sent_idx int, sentence string")
    around = {r.sent_idx: (r.before, r.after) for r in context.sentence_contexts(sents, 3).collect()}
    assert around[2] == (["w0b", "w1a", "w1b"], ["w3a", "w3b"])
    ments = sents.where("sent_idx = 1").select("*", F.lit(4).alias("start"), F.lit(7).alias("end"))
    row = context.mention_contexts(ments, sents, 3).first()
    assert (row.left_ctx, row.right_ctx) == ("w0a w0b w1a", "w2a w2b w3a")


def test_coreference(spark):
    rows = [(1, 0, "Abraham Lincoln", [("P", 0.8), ("Q", 0.2)]), (1, 1, "Lincoln", [("C", 1.0)]), (1, 2, "linc", [("L", 1.0)]), (2, 0, "Lincoln", [("C", 1.0)])]
    frame = spark.createDataFrame(rows, "doc_id int, mention_ord int, mention string, cands array<struct<entity:string,p:double>>")
    people = spark.createDataFrame([("P",)], "name string")
    got = {(r.doc_id, r.mention_ord, r.entity, r.p) for r in context.coreferent_candidates(frame, people).collect()}
    assert got == {(1, 1, "P", 0.8), (1, 1, "Q", 0.2)}
    exact = {(r.doc_id, r.mention_ord): [c.entity for c in r.cands] for r in context.coreference_fold(frame, {"P"}).collect()}
    assert exact == {(1, 0): ["P", "Q"], (1, 1): ["P", "Q"], (1, 2): ["L"], (2, 0): ["C"]}


def test_prerank_and_decisions(spark):
    rows = [(1, k, [0.1, 0.9, 0.2, 0.8, 0.3, 0.7, 0.6, 0.5, 0.4, 0.0][k]) for k in range(10)]
    frame = spark.createDataFrame(rows, "m int, idx int, ctx_score double")
    assert sorted(r.idx for r in ranking.prerank(frame, ["m"]).collect()) == [0, 1, 2, 3, 4, 5, 6]
    scored = spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "b", 0.5), (2, 0, "#UNK#", 0.9), (2, 1, "c", 0.1)], "m int, idx int, entity string, score double")
    assert {(r.m, r.entity) for r in ranking.first_best(scored, ["m"]).collect()} == {(1, "a"), (2, "NIL")}


def test_micro_scores(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "NIL"), ("c", "x"), ("NIL", "NIL")], "gold string, pred string")
    r = results.micro_scores(rows).first()
    assert (r.tp, r.n_pred, r.n_gold, r.n_nil, r.precision, r.recall) == (1, 2, 4, 2, 0.5, 0.25)
    none = results.micro_scores(rows.where("pred = 'NIL'")).first()
    assert none.precision is None and none.f1 is None


def test_calibration(spark):
    r = np.random.default_rng(1)
    score = r.normal(size=400)
    label = (score + 0.5 * r.normal(size=400) > 0).astype(int)
    weight, bias = ranking.fit_calibration(spark.createDataFrame(list(zip(score.tolist(), label.tolist())), "score double, label int"))
    p = 1 / (1 + np.exp(-(weight * score + bias)))
    assert abs(((p - label) * score).sum() + weight) < 0.1 and abs((p - label).sum()) < 0.1  # the penalised optimum


def test_markup():
    page = "{{Info|a={{x}}}}'''Bold''' text [[Target|label]]s and [[plain]] [[File:a.png|thumb|cap [[x]]]]<!-- no --><ref>r</ref>\n== Head ==\n* item\nMore <b>text</b> &amp; [http://x.y link] <nowiki>[[kept]]</nowiki>.\n{| table |}"
    assert markup.clean_wikitext(page) == "Bold text labels and plain\nMore text & link [[kept]]."
    assert markup.clean_wikitext(page, lists=True, sections=True).split("\n")[1:3] == ["Section::::Head.", "BULLET::::- item"]
    assert markup.clean_wikitext("H<sub>2</sub>O x<sup>2</sup> <small>s</small><indicator n=a>i</indicator>end") == "HO x end"
    assert markup.clean_wikitext("see [http://a.b http://c.d/e.png] and [http://a.b] or [http://a.b the site]") == "see and or the site"
    assert markup.clean_wikitext("a<div>x<div>y</div>z</div>b") == "ab" and markup.clean_wikitext("a <div>open") == "a open"


def test_answers(spark):
    index = index_of(spark, ("Fox", 5, [("Fox_(animal)", 0.9), ("Fox_TV", 0.1)]))
    docs = spark.createDataFrame([(1, "A Fox", []), (2, "the Fox", [(4, 3)]), (3, "", [])], "doc_id int, text string, spans array<struct<start:int,length:int>>")
    bodies = {r.doc_id: r.body for r in linking.answer(docs, index).collect()}
    assert '"start":2,"length":3,"ngram":"Fox","entity":"Fox_(animal)"' in bodies[1] and '"start":4' in bodies[2] and bodies[3] == "[]"


def _fold_by_loops(rows, persons):
    """Every mention against every other, in order."""
    cands = {k: list(c) for k, _, c in rows}
    for k, name, _ in rows:
        total, met = {}, 0
        for j, other, _ in rows:
            a, b = name.lower(), other.lower()
            at = b.find(a)
            if at >= 0 and a != b and b[:at][-1:] in ("", " ") and b[at + len(a) :][:1] in ("", " ") and cands[j] and cands[j][0][0] in persons:
                met += 1
                for e, p in cands[j]:
                    total[e] = total.get(e, 0.0) + p
        if met:
            place = {e: i for i, e in enumerate(total)}
            cands[k] = sorted(((e, p / met) for e, p in total.items()), key=lambda x: (-x[1], -place[x[0]]))
    return cands


def test_fold_of_nested_names_equals_loops(spark):
    """Names of several levels in any order, with spaces at odd places and shares that round."""
    r = np.random.default_rng(3)
    words = ["ann", "Bo", "cy", "d", ""]
    docs = {d: [(k, " ".join(r.choice(words, r.integers(1, 5))), [(f"E{r.integers(9)}", float(r.random())) for _ in range(r.integers(0, 4))]) for k in range(150)] for d in range(4)}
    cells = "doc_id long, mention_ord int, mention string, cands array<struct<entity:string,p:double>>"
    frame = spark.createDataFrame([(d, *row) for d, own in docs.items() for row in own], cells)
    got = {(x.doc_id, x.mention_ord): [tuple(c) for c in x.cands] for x in context.coreference_fold(frame, {"E1", "E2", "E3"}).collect()}
    assert got == {(d, k): c for d, own in docs.items() for k, c in _fold_by_loops(own, {"E1", "E2", "E3"}).items()}


def test_fold_of_a_large_document_is_not_quadratic(spark):
    """60,000 mentions of one document: all pairs of them would take hours."""
    rows = spark.range(60_000).selectExpr(
        "1 AS doc_id", "id AS mention_ord", "IF(id % 3 = 0, 'w' || id % 40, 'w' || id % 40 || ' x' || id % 5000) AS mention",
        "array(named_struct('entity', 'E' || id % 25, 'p', 0.75D)) AS cands",
    )
    began = time.time()
    got = context.coreference_fold(rows, {"E1", "E2"}).where("mention_ord % 3 = 0").agg(F.count("*"), F.max(F.size("cands"))).first()
    assert got[0] == 20_000 and got[1] >= 1 and time.time() - began < 60
