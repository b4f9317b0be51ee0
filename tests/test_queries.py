"""Registered queries over whole small tables: against their SQL, and the others against plain loops."""

import decimal
import math

import duckdb
import numpy as np
import pytest
import regex

import brindle.plans.catalogue as catalogue
from brindle.functions import text as X
from brindle.plans import linking

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(float(value)) else float(f"{float(value):.9g}")
    return value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sql, name):
    frame = catalogue.QUERIES[name](spark, SF)
    found = sql.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr) == want


END = regex.compile(r"\n+|(?<=[.?!])(?<!\b[A-Z][a-z]?\.)[ \t\n\x0b\f\r]+(?=[\p{Lu}\"'(0-9])")


def plain_sentences(text):
    out, at = [], 0
    for m in [*END.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip(" "):
            out.append((text[at:end], at))
        at = m.end() if m else end
    return out


def plain_spelling(surface, freq, lower):
    """(mention, freq) by the decision list, one question after another."""
    title = regex.sub(r"\p{L}+", lambda m: m[0][:1].upper() + m[0][1:].lower(), surface) if surface == surface.upper() else surface
    now = title if freq.get(title, 0) > 0 else surface
    if freq.get(surface, 0) > freq.get(now, 0):
        now = surface
    if not freq.get(now) and surface.lower() in lower and freq[lower[surface.lower()]] > 0:
        now = lower[surface.lower()]
    if not freq.get(now):
        bare = "".join(c for c in surface if c not in X.NOISE).strip(" ")
        if freq.get(bare):
            now = bare
    return now, freq.get(now, 0)


def test_linked_documents_equal_loops(spark):
    """All documents: sentences, n-grams longest first, spelling, best candidate."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    index = {r.mention: r for r in linking.page_index(pages).collect()}
    freq, lower = {m: r.freq for m, r in index.items()}, {}
    for m in sorted(index, reverse=True):
        lower[m.lower()] = m
    mentions, links = [], []
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for k, (sentence, at) in enumerate(plain_sentences(doc.text or "")):
            tokens = [(m.start(), m[0]) for m in regex.finditer(r"\S+", sentence)]
            accepted = []
            for size in (3, 2, 1):
                for i in range(len(tokens) - size + 1):
                    own = [t for _, t in tokens[i : i + size]]
                    if any(regex.fullmatch(r"[\W_]+", t) for t in own):
                        continue
                    surface, start = " ".join(own), tokens[i][0]
                    if any(surface in s and start < b + len(s) and b < start + len(surface) for b, s in accepted):
                        continue
                    mention, n = plain_spelling(surface, freq, lower)
                    if n > 0:
                        accepted.append((start, surface))
                        mentions.append((doc.doc_id, k, at + start, surface, mention, n))
                        if index[mention].cands:
                            best = index[mention].cands[0]
                            links.append((doc.doc_id, at + start, len(surface), best.entity, min(1.0, max(1e-3, best.p)), float(n)))
    got = catalogue.QUERIES["ngram_link"](spark, SF).select("doc_id", "sent_idx", "pos", "surface", "mention", "freq").collect()
    assert sorted(map(tuple, got)) == sorted(mentions) and len(mentions) > 1000
    got = catalogue.QUERIES["linked_documents"](spark, SF).select("doc_id", "start", "length", "entity", "conf_ed", "conf_md").collect()
    assert sorted(map(tuple, got)) == sorted(links)


def test_coref_exact_equals_loops(spark):
    rows, _ = catalogue._coref_input(spark, SF)
    persons, docs = {"Brand#1", "Brand#2", "Brand#3"}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.mention_ord)):
        docs.setdefault(r.doc_id, []).append([r.mention_ord, r.mention.lower(), [(c.entity, c.p) for c in r.cands]])
    for own in docs.values():
        for m in own:
            met = []
            for _, other, cands in own:
                at = other.find(m[1])
                if at >= 0 and other != m[1] and cands[0][0] in persons and other[:at][-1:] in ("", " ") and other[at + len(m[1]) :][:1] in ("", " "):
                    met.append(cands)
            if met:
                total = {}
                for cands in met:
                    for e, p in cands:
                        total[e] = total.get(e, 0.0) + p
                place = {e: k for k, e in enumerate(total)}
                m[2] = [(e, total[e] / len(met)) for e in sorted(total, key=lambda e: (-total[e] / len(met), -place[e]))]
    want = {(d, m[0]): [(e, round(p, 9)) for e, p in m[2]] for d, own in docs.items() for m in own}
    got = {(r.doc_id, r.mention_ord): [(c.entity, round(c.p, 9)) for c in r.cands] for r in catalogue.QUERIES["coref_exact"](spark, SF).collect()}
    assert got == want


def test_calibration_equals_newton(spark, sql):
    score, label = map(np.array, zip(*sql.execute("SELECT l_quantity / 50, l_quantity + 40 * l_discount > 27 FROM lineitem").fetchall()))
    x, y = np.stack([score.astype(float), np.ones(len(score))], axis=1), label.astype(float)
    w = np.zeros(2)
    for _ in range(60):  # mean log-loss + |weight|^2 / 2n
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) / len(y) + np.array([w[0], 0]) / len(y)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag([1 / len(y), 0])
        w -= np.linalg.solve(curve, slope)
    hit = 1 / (1 + np.exp(-x @ w)) >= 0.3
    row = catalogue.QUERIES["lr_calibration"](spark, SF).first()
    assert (row.tp, row.found, row.gold) == (int((hit & (y == 1)).sum()), int(hit.sum()), int(y.sum()))


def test_linked_turns_are_sound(spark):
    """Every result of the whole chain lies in its text, names a candidate, and none repeats."""
    turns = {r.doc_id: r.text for r in catalogue._turns(spark, SF).collect()}
    index = {r.mention: {c.entity for c in r.cands} for r in catalogue._knowledge(spark, SF).index.collect()}
    rows = catalogue.QUERIES["ed_pipeline"](spark, SF).collect()
    assert len(rows) > 50 and len({(r.doc_id, r.start, r.length) for r in rows}) == len(rows)
    entities = set().union(*index.values())
    for r in rows:
        assert turns[r.doc_id][r.start : r.start + r.length] == r.ngram and r.entity in entities and 0 < r.conf_ed < 1
