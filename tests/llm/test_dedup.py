import random
from collections import Counter

import numpy as np
import pyarrow as pa

from brindle.llm import bagminhash as b
from brindle.llm import textkit

from .conftest import prose


def bag(text, size=5):
    words = text.split()
    grams = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)] or ([tuple(words)] if words else [])
    return Counter(grams)


def similarity(x, y):
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def brute_classes(texts, least=0.8):
    """Class (index of its first member) of each text."""
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= least:
                a, c = root[i], root[j]
                root = [min(a, c) if r in (a, c) else r for r in root]
    return root


def varied(seed, n=60, kinds=6):
    """Groups of mutated copies with similarities all over the range."""
    draw = random.Random(seed)
    out = []
    for k in range(n):
        words = prose(k % kinds, 80).split()
        for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 9])):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        out.append(" ".join(words * draw.choice([1, 1, 1, 2])))
    return out


def test_signatures_are_unbiased():
    texts = varied(1, 30)
    _, end, hashes, rows = next(textkit.words_by_row(pa.array(texts)))
    h, r, w = textkit.multisets(*textkit.shingles(hashes, rows, 5))
    m = 4096
    registers = b.bag_signatures(h, r, w, end, m)
    bags = [bag(t) for t in texts]
    gaps = [(registers[i] == registers[j]).mean() - similarity(bags[i], bags[j]) for i in range(30) for j in range(i)]
    assert abs(np.mean(gaps)) < 0.01 and np.abs(gaps).max() < 0.05


def test_words_and_shingles_do_not_depend_on_blocks():
    texts = [*varied(2, 10), "", None, "one two", "é x  \n y", "z" * 5000]
    def all_of(size):
        return [(row + int(k), int(h)) for row, _, hashes, rows in textkit.words_by_row(pa.array(texts), size) for k, h in zip(rows, hashes)]
    assert all_of(1 << 20) == all_of(64) == all_of(700)
    assert len(all_of(64)) == sum(len([w for w in (t or "").replace(" ", "_").split() if w]) for t in texts)


def test_classes_equal_brute_force(spark):
    texts = varied(3, 120)
    texts += [texts[5]] * 4 + ["short text"] * 2 + ["", " "]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in b.near_duplicate_classes(frame).collect()}
    assert got == dict(enumerate(brute_classes(texts)))


def test_blocks_lose_no_links(spark, monkeypatch):
    """The same classes when a hub's group is cut into many blocks."""
    monkeypatch.setattr(b, "BLOCK_NODES", 7)
    texts = varied(4, 90, kinds=2)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in b.near_duplicate_classes(frame).collect()} == dict(enumerate(brute_classes(texts)))


def test_star_then_rest(spark, monkeypatch):
    """Near copies of one text, and chains that leave it step by step, in many small blocks."""
    monkeypatch.setattr(b, "BLOCK_NODES", 5)
    draw = random.Random(8)
    base = prose(1, 90).split()
    texts = []
    for k in range(60):
        words = list(base)
        words[draw.randrange(90)] = f"one{k}"
        texts.append(" ".join(words))
    for chain in range(4):
        words = list(base)
        for k in range(12):
            words[(chain * 20 + 7 * k) % 90] = f"c{chain}x{k}"
            texts.append(" ".join(words))
    draw.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in b.near_duplicate_classes(frame).collect()} == dict(enumerate(brute_classes(texts)))


def test_recall_at_the_threshold():
    """Pairs just above the similarity share a band and pass the agreement test."""
    draw = np.random.default_rng(12)
    n, size, lost, agree = 1500, 180, 0, 0
    for start in range(0, n, 250):
        hashes, rows = [], []
        for k in range(250):
            common, own = draw.integers(1, 2**63, size).astype(np.uint64), draw.integers(1, 2**63, (2, size // 8)).astype(np.uint64)
            for side in (0, 1):  # size / (size + 2 * size / 8) = 0.8
                grams = np.sort(np.concatenate([common, own[side][: size // 8]]))
                hashes.append(grams)
                rows.append(np.full(len(grams), 2 * k + side))
        h, r = np.concatenate(hashes), np.concatenate(rows)
        registers = b.bag_signatures(h, r, np.ones(len(h), np.int64), 500)
        bands = b.band_values(registers, b.BANDS, b.ROWS)
        lost += int((bands[::2] != bands[1::2]).all(axis=1).sum())
        same = (registers[::2] == registers[1::2]).sum(axis=1)
        m = b.REGISTERS
        agree += int((same < m * 0.8 - b.SLACK * np.sqrt(m * 0.8 * 0.2)).sum())
    assert lost <= 1 and agree == 0


def test_components(spark):
    draw = random.Random(6)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    frame = spark.createDataFrame(edges, "a long, b long")
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, c in edges:
            root[a] = root[c] = min(root[a], root[c])
    got = {r.id: r.root for r in b.components(frame).collect()}
    assert got == {v: r for v, r in root.items() if v != r}


def test_odd_rows(odd_documents):
    got = sorted(((r.doc_id, r.class_id) for r in b.near_duplicate_classes(odd_documents).collect()), key=repr)
    want = [(0, 0), (0, 0), (1, 0), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9), (10, 10), (None, None), (None, None)]
    assert got == sorted(want, key=repr)
    kept = b.keep_one_per_class(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((repr(r.doc_id) for r in kept.collect())) == sorted(map(repr, [0, 2, 3, 4, None, None, 5, 7, 8, 9, 10]))
    assert b.near_duplicate_classes(odd_documents.limit(0)).count() == 0
    assert b.keep_one_per_class(odd_documents.limit(0)).count() == 0
