import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import piecescan, tokencount

ALPHABET = st.text(alphabet=st.sampled_from(list("abé日😀▁ \n\t .'sl0<|>")), max_size=80)


def test_pieces_add_up(vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    counter = tokencount.PieceCounter(vocabulary("byte_bpe_50k.json"))

    @settings(max_examples=300, deadline=None)
    @given(ALPHABET)
    def check(text):
        assert counter.count([text])[0] == len(tokenizer.encode(text, add_special_tokens=False).ids)

    check()
    for text in ("a <|endoftext|> b", "<|endoftext|>", " x", "x ", "it's  \n ok", "\x00 \x00a"):
        assert counter.count([text])[0] == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_long_pieces_are_cut_by_the_pretokeniser(vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    counter = tokencount.PieceCounter(vocabulary("byte_bpe_50k.json"))
    draw = random.Random(2)
    for letters in ("日本語。、it's", "ab1'!\n\t\u00a0", "x", "a<|endoftext|>9"):
        text = "".join(draw.choice(letters) if "<" not in letters else draw.choice([letters, "z1", "\n"]) for _ in range(12_000))
        assert counter.count([text]) == [len(tokenizer.encode(text, add_special_tokens=False).ids)], letters


def test_balanced_ranges():
    texts = pa.array(["a" * 10, None, "b" * 25, "c", "d" * 9])
    assert list(tokencount.balanced(texts, 20)) == [(0, 2), (2, 3), (3, 5)]
    assert list(tokencount.balanced(pa.array([], pa.string()), 20)) == []


def test_counts_of_odd_rows(odd_documents, vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = odd_documents.select("doc_id", "text").collect()
    got = tokencount.count_tokens(odd_documents, vocabulary("byte_bpe_50k.json")).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in rows]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(map(repr, want))
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokencount.count_tokens(odd_documents.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def scan(pieces, text, size):
    """Chunks, matrices, states and backtraces of one text."""
    whole = pieces.normalised(text)
    cuts = list(range(0, max(len(whole), 1), size))
    parts = []
    for k, at in enumerate(cuts):
        before, body = whole[max(0, at - pieces.reach) : at], whole[at : at + size]
        text = before + body + whole[at + size : at + size + pieces.reach]
        parts.append((text, len(before), len(before) + len(body), k == 0, at == cuts[-1]))
    states = piecescan.boundary_states([piecescan.transfer(pieces, *p) for p in parts])
    return [i for k, (t, a, b, _, last) in enumerate(parts) for i in piecescan.backtrace(pieces, t, a, b, states[k], states[k + 1], last)]


def test_scan_equals_library(vocabulary):
    pieces = piecescan.load(vocabulary("piece_bpe_32k.model"))

    @settings(max_examples=150, deadline=None)
    @given(ALPHABET, st.sampled_from([3, 8, 31]))
    def check(text, size):
        want = pieces.library.encode(text)
        assert scan(pieces, text, size) == want
        assert pieces.encode(text) == want

    check()
    for text in ("▁ ", " ▁", "▁", "a▁ b", "▁▁x ▁"):
        assert pieces.encode(text) == pieces.library.encode(text), text


def test_short_path_equals_library_on_any_text(vocabulary):
    pieces = piecescan.load(vocabulary("piece_bpe_32k.model"))

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def check(text):
        assert pieces.encode(text) == pieces.library.encode(text)

    check()


def test_whole_documents_equal_library(spark, vocabulary):
    """The registered chunk size over a table of the test data, whole."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = vocabulary("piece_bpe_32k.model")
    library = piecescan.load(path).library
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = piecescan.encode(documents, path).collect()
    assert len(got) == len(texts)
    assert all(list(r.ids) == library.encode(texts[r.doc_id] or "") for r in got)


def test_unigram_scan_is_the_best_path():
    """The scan of a toy unigram model against all segmentations."""

    class Toy(piecescan.Pieces):
        def __init__(self):
            scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.1, "aab": -4.6, "bb": -4.0, "abab": -5.5}
            self.text = list(scores)
            self.ids = {t: i for i, t in enumerate(self.text)}
            self.scores = list(scores.values())
            self.reach, self.words_are_apart, self.unigram, self.dummy_prefix = 4, False, True, False

        def normalised(self, text):
            return text

    toy = Toy()

    def brute(text):
        best = {0: 0.0}
        for end in range(1, len(text) + 1):
            best[end] = max((best[a] + toy.scores[toy.ids[text[a:end]]] for a in range(end) if text[a:end] in toy.ids), default=float("-inf"))
        return best[len(text)]

    draw = random.Random(5)
    for _ in range(60):
        text = "".join(draw.choice("ab") for _ in range(draw.randint(1, 30)))
        ids = scan(toy, text, draw.choice([2, 5, 9]))
        assert "".join(toy.text[i] for i in ids) == text
        assert abs(sum(toy.scores[i] for i in ids) - brute(text)) < 1e-9


def test_products_associate():
    import numpy as np

    r = np.random.default_rng(0)
    a, b, c = r.normal(size=(2, 3)), r.normal(size=(3, 4)), r.normal(size=(4, 2))
    assert np.allclose(piecescan.combine(piecescan.combine(a, b), c), piecescan.combine(a, piecescan.combine(b, c)))


def test_tree_of_products(spark, vocabulary):
    """Products up and states down a tree give the states of one pass over all chunks."""
    path = vocabulary("piece_bpe_32k.model")
    pieces = piecescan.load(path)
    text = " ".join(random.Random(3).choice(["alpha", "beta▁", "x", "日本", "superfluous", "  ", "zz"]) for _ in range(400))
    giants = spark.createDataFrame([("d", text), ("e", "y" * 500), ("f", "z")], "digest string, text string")
    matrices = piecescan._matrices(piecescan._chunks(giants, path, 20), path).cache()
    want = {}
    for digest in ("d", "e", "f"):
        table = matrices.where(f"digest = '{digest}'").orderBy("k").toPandas()
        want[digest] = piecescan.boundary_states(piecescan._group(table))
    for fan in (2, 3, 1000):
        got = piecescan._states(matrices, fan).collect()
        for digest, states in want.items():
            own = sorted((r.k, tuple(r.entry), tuple(r.exit)) for r in got if r.digest == digest)
            assert own == [(k, states[k], states[k + 1]) for k in range(len(states) - 1)]
    assert pieces.reach > 1


def test_encode_and_decode_odd_rows(odd_documents, vocabulary):
    path = vocabulary("piece_bpe_32k.model")
    library = piecescan.load(path).library
    got = piecescan.encode(odd_documents, path, chunk_chars=1000).collect()
    rows = odd_documents.select("doc_id", "text").collect()
    want = sorted(repr((r.doc_id, library.encode(r.text) if r.text else [])) for r in rows)
    assert sorted(repr((r.doc_id, list(r.ids))) for r in got) == want
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    back = piecescan.decode(piecescan.encode(odd_documents, path), path).collect()
    assert sorted(repr((r.doc_id, r.text)) for r in back) == sorted(repr((r.doc_id, r.text or "")) for r in rows)
    assert piecescan.encode(odd_documents.limit(0), path).count() == 0
