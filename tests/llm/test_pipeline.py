"""The pipeline over planted cases, and every stage over odd and empty tables."""

import numpy as np

import corpus_pipeline
from brindle.llm import piecescan, queries, shared, toxicity

from .conftest import prose


def planted():
    rude = "what a moron"
    rows = {k: f"{prose(k, 40)} {rude if k % 5 == 0 else 'fine'} {prose(k + 900, 40)}" for k in range(150)}
    item = prose(5000, 30)
    rows |= {
        200: prose(200, 80),
        201: prose(200, 80),
        202: prose(200, 80).replace(prose(200, 80).split()[40], "altered"),
        203: f"{prose(203)} {item} {prose(204)}",
        204: f"{prose(205)} write to ann@example.org or 10.0.0.1 {prose(206)}",
        205: f"{prose(207)} you m0r0n {prose(208)}",
        206: "",
        207: None,
    }
    return rows, item


def save(spark, path, documents, labels, benchmark):
    for name, frame in (("documents", documents), ("labels", labels), ("benchmark", benchmark)):
        frame.write.parquet(f"{path}/{name}.parquet")


def test_planted_cases(spark, tmp_path, vocabulary):
    rows, item = planted()
    documents = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(150)], "doc_id long, quality int, toxic int")
    save(spark, str(tmp_path), documents, labels, spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {k: t for k, t in rows.items() if not (k < 150 and k % 5 == 0) and k not in (201, 202, 203, 205)}
    assert set(got) == set(want)
    library = piecescan.load(vocabulary("piece_bpe_32k.model")).library
    for k, text in want.items():
        text = (text or "").replace("ann@example.org", "<EMAIL>").replace("10.0.0.1", "<IP>")
        assert list(got[k].ids) == (library.encode(text) if text else []), k


def test_stages_over_odd_tables(spark, odd_documents, labels, tmp_path):
    benchmark = spark.createDataFrame([(1, prose(7, 30)), (None, None)], "item_id long, text string")
    save(spark, str(tmp_path / "odd"), odd_documents, labels, benchmark)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_documents, odd_documents.limit(0)):
            out = stage(spark, docs, str(tmp_path / "odd"))
            assert name == "piece_encoding" or out.columns == odd_documents.columns
            assert out.count() <= docs.count()


def test_registration():
    assert [n.split("_")[0] for n in list(queries.queries())[:10]] == [f"op{k}" for k in range(1, 11)]
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= {*queries.queries(), "pipeline"} and corpus_pipeline.ORACLE_SQL is None


def test_memory_goes_back_at_a_tasks_end():
    """Many small arrays below one that stays: the allocator alone would keep what they held."""
    import psutil

    kept, rss = [], lambda: psutil.Process().memory_info().rss >> 20

    def run(batches):
        held = [np.ones(8_000) for _ in range(4_000)]  # 64 kB each
        kept.append(np.ones(8_000))
        yield from batches
        del held

    before = rss()
    assert list(shared.thrifty(run)(iter([1, 2]))) == [1, 2] and rss() < before + 60


def test_the_driver_gives_back_what_it_freed(spark):
    """Native blocks of the driver's JVM below one that stays: malloc alone would keep them."""
    import psutil

    jvm = spark._jvm
    process = psutil.Process(jvm.java.lang.ProcessHandle.current().pid())
    shared.written(spark.range(3), "compiled")  # so that the second write takes little
    blocks = [jvm.java.util.zip.Deflater() for _ in range(4000)]
    for block in blocks[:-1]:
        block.end()
    before = process.memory_info().rss >> 20
    assert shared.written(spark.range(3), "relieved").count() == 3
    after = process.memory_info().rss >> 20
    blocks[-1].end()
    assert after < before - 100


def test_reject_toxic_learns_from_all_rows(spark, monkeypatch):
    """The stage's cut is that of all training rows, not of a sample of about 20,000."""
    frame = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'wretch', 'friend') AS text", "'en' AS lang")
    labels = frame.selectExpr("doc_id", "1 AS quality", "int(doc_id % 3 = 0) AS toxic")
    seen, cut = [], toxicity.best_cut
    monkeypatch.setattr(toxicity, "best_cut", lambda clean, toxic: seen.append(clean.sum() + toxic.sum()) or cut(clean, toxic))
    kept = toxicity.reject_toxic(frame, labels)
    assert seen == [labels.where(~toxicity.held_out(labels.doc_id)).count()] and kept.where("text = 'wretch'").count() == 0 and kept.count() == 20_000


def test_reject_toxic_counts_every_row(spark, monkeypatch):
    """The stage's language model counts all documents, its weights all training rows."""
    frame = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'wretch', 'friend') AS text", "'en' AS lang")
    labels = frame.selectExpr("doc_id", "1 AS quality", "int(doc_id % 3 = 0) AS toxic")
    found = {}
    for name in ("language_model", "feature_table"):
        learn = getattr(toxicity, name)
        monkeypatch.setattr(toxicity, name, lambda *given, name=name, learn=learn: found.setdefault(name, learn(*given)))
    toxicity.reject_toxic(frame, labels)
    w, r, e, t = (ord(c) - 96 for c in "wret")
    # Anything but t after wre has only what two levels of smoothing (5) leave, and 2 of 3 e's have no t behind.
    other = -np.expm1(found["language_model"][w, r, e, t])
    assert abs(5 / np.sqrt(1.5 * other) - 5 - 10_000) < 2
    # Wilson's lower bound (z = 2.5) of n of n is n / (n + z * z).
    most = found["feature_table"][1].max()
    assert round(6.25 * most / (1 - most)) == labels.where("toxic = 1").where(~toxicity.held_out(labels.doc_id)).count()
