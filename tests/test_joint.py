"""The joint model against loops, its gradients against differences, and the linker end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import features, gradients, joint, passage, ranking
from brindle.plans import catalogue, disambiguation

DIM = 5
SF = "/root/testdata/sf0.001"


def chunk(seed, n=3, width=4, gold=True):
    r = np.random.default_rng(seed)
    some = lambda most: [r.normal(size=(r.integers(1, most), DIM)) for _ in range(n)]
    tokens, token_mask = joint.padded(some(6), DIM)
    near = [joint.padded(some(4), DIM) for _ in range(3)]
    mask = np.zeros((n, width))
    for k in range(n):
        mask[k, : 1 + (k + seed) % width] = 1
    prior = np.where(mask > 0, r.uniform(0.01, 1, (n, width)), 1e-8)
    return joint.Chunk(tokens, token_mask, near, r.normal(size=(n, width, DIM)), mask, prior, np.zeros(n, int) if gold else None)


def slow_scores(c, p, keep=25, rounds=10, damping=0.3):
    """Every formula with loops over mentions, candidates and tokens."""
    n, width = c.mask.shape
    soft = lambda x: np.exp(x - max(x)) / np.exp(x - max(x)).sum()
    local, context = [], []
    for i in range(n):
        real = [t for t in range(c.tokens.shape[1]) if c.token_mask[i, t]]
        votes = [max(sum(c.entities[i, k] * p["attention"] * c.tokens[i, t]) for k in range(width)) for t in real]
        best = sorted(range(len(real)), key=lambda t: -votes[t])[:keep]
        share = soft(np.array([votes[t] for t in best]))
        ctx = sum(s * p["token_score"] * c.tokens[i, real[t]] for s, t in zip(share, best))
        local.append([c.entities[i, k] @ ctx if c.mask[i, k] else -1e10 for k in range(width)])
        means = [sum(v[i][m[i] > 0], np.zeros(DIM)) / (m[i].sum() + 1e-5) for v, m in c.near]
        context.append(np.tanh(np.concatenate(means) @ p["context"] + p["context_bias"]))
    local.append([0.0] * width)
    context.append(p["pad_context"])
    ents = [*c.entities, np.tile(p["pad_entity"], (width, 1))]
    mask = [*c.mask, [1] + [0] * (width - 1)]
    prior = [*c.prior, [1] + [0] * (width - 1)]
    n += 1
    pair = np.zeros((n, width, n, width))
    for r in range(len(p["entity_relation"])):
        probs = [soft(np.array([(context[i] * p["mention_relation"][r] @ context[j] - (1e10 if i == j else 0)) / np.sqrt(DIM) for j in range(n)])) for i in range(n)]
        for i in range(n):
            for j in range(n):
                for a in range(width):
                    for b in range(width):
                        one = ents[i][a] * p["entity_relation"][r] @ ents[j][b] if mask[j][b] else -1e10
                        pair[i, a, j, b] += one * (probs[i][j] + probs[j][i]) / len(p["entity_relation"])
    message = np.zeros((n, width, n))
    for _ in range(rounds):
        fresh = np.zeros_like(message)
        for i in range(n):
            for j in range(n):
                votes = [max(pair[i, a, j, b] + local[j][b] + sum(message[j, b, k] for k in range(n) if k != i) for b in range(width)) for a in range(width)]
                fresh[i, :, j] = np.log(damping * soft(np.array(votes)) + (1 - damping) * np.exp(message[i, :, j]))
        message = fresh
    out = []
    for i in range(n - 1):
        belief = soft(np.array([local[i][a] + sum(message[i, a, j] for j in range(n) if j != i) for a in range(width)]))
        out.append([np.maximum(np.array([b, np.log(q + 1e-20)]) @ p["hidden"] + p["hidden_bias"], 0) @ p["output"] + p["output_bias"][0] for b, q in zip(belief, prior[i])])
    return np.array(out)


@pytest.mark.parametrize("seed", range(4))
def test_scores_equal_loops(seed):
    p = joint.initial_parameters(DIM, hidden=6, seed=seed)
    c = chunk(seed, n=1 + seed)
    assert np.allclose(joint.score(c, p), slow_scores(c, p))


def test_gradients_equal_differences():
    p = joint.initial_parameters(DIM, hidden=6, seed=3)
    c = chunk(2)
    c.gold = np.array([0, 1, 0])
    value, slope = joint.gradient(c, p)
    plain = lambda q: joint.loss(joint.chunk_scores(c, {k: gradients.Var(v) for k, v in q.items()}), c.gold, {k: gradients.Var(v) for k, v in q.items()}).value
    assert np.isclose(plain(p), value)
    r = np.random.default_rng(0)
    for name, v in p.items():
        for _ in range(3):
            at = tuple(r.integers(0, s) for s in v.shape)
            up, down = ({k: x.copy() for k, x in p.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert np.isclose((plain(up) - plain(down)) / 2e-5, slope[name][at], atol=1e-5), name


def test_norms_and_diversity():
    p = joint.initial_parameters(DIM, hidden=6)
    p["output"] = np.full(6, 1000.0)
    assert np.isclose(np.linalg.norm(joint.bounded(p)["output"]), 100) and (joint.bounded(p)["hidden"] == p["hidden"]).all()
    x = p["entity_relation"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(d for a in unit for b in unit if (d := np.sqrt(((a - b) ** 2).sum() + 1e-5)) < 1)
    assert np.isclose(joint.diversity(gradients.Var(x)).value, want)


def test_decision(spark):
    rows = spark.createDataFrame(
        [(["a", "b"], [1.0, 1.0, 0.0], [0.1, 0.3, 0.2]), (["a"], [1.0, 0.0], [0.1, 0.9]), ([], [0.0, 0.0], [0.5, 0.1]), (["a", "b"], [1.0, 1.0], [0.2, 0.2])],
        "names array<string>, mask array<double>, scores array<double>",
    )
    assert [r[0] for r in rows.select(ranking.decode(F.col("names"), F.col("mask"), F.col("scores"))).collect()] == ["b", "a", "NIL", "a"]


WORDS = "fox brown quick jumped lazy over dog river bank money water".split()


@pytest.fixture(scope="module")
def knowledge(spark):
    def vector(k):
        return [float(x) for x in np.random.default_rng(k).normal(size=DIM)]

    cands = {"fox": [("Fox", 0.6), ("Fox_(band)", 0.4)], "dog": [("Dog", 1.0)], "bank": [("Bank", 0.7), ("Bank_(river)", 0.3)]}
    index = spark.createDataFrame([(m, m, 5, c) for m, c in cands.items()], "mention string, lower string, freq long, cands array<struct<entity:string,p:double>>")
    words = [(w, vector(k)) for k, w in enumerate(WORDS)] + [(f"ENTITY/{e}", vector(100 + k)) for k, e in enumerate(["Fox", "Dog", "Bank", "Bank_(river)"])]
    words += [(w, vector(200 + k)) for k, w in enumerate(features.UNKNOWN.values())]
    return disambiguation.KnowledgeBase(index, spark.createDataFrame(words, "word string, emb array<float>"), spark.createDataFrame([("Dog",)], "name string"))


PANGRAM = "the quick brown fox jumped over the lazy dog"


def test_linker_end_to_end(spark, knowledge):
    linker = disambiguation.Linker(knowledge, joint.initial_parameters(DIM))
    docs = spark.createDataFrame(
        [("a", PANGRAM, []), ("b", PANGRAM + ".\nThe bank of a river.", [(16, 3), (0, 3), (50, 4)]), ("c", "nothing", []), ("d", None, []), ("e", "", [])],
        "doc_id string, text string, spans array<struct<start:int,length:int>>",
    )
    bodies = {r.doc_id: r.body for r in linker.answer(docs).collect()}
    import json

    found = {k: [(x["start"], x["length"], x["ngram"], x["entity"]) for x in json.loads(b)] for k, b in bodies.items()}
    assert found["a"] == [(16, 3, "fox", found["a"][0][3]), (41, 3, "dog", "Dog")]
    assert [x[:3] for x in found["b"]] == [(16, 3, "fox"), (50, 4, "bank")] and found["b"][1][3].startswith("Bank")
    assert found["c"] == found["d"] == found["e"] == []


def test_features_by_hand(spark, knowledge):
    linker = disambiguation.Linker(knowledge, joint.initial_parameters(DIM))
    found = linker.found_mentions(spark.createDataFrame([(1, PANGRAM)], "doc_id long, text string"))
    rows = {r.mention_ord: r for r in features.mention_features(found.withColumn("chunk", F.lit(0).cast("long")), knowledge.vectors).collect()}
    vectors = {r.word: list(r.emb) for r in knowledge.vectors.collect()}
    rows = {k: r.asDict() | {n: features.unpacked(list(r[n]), DIM).tolist() for n in ("tokens", "left", "inside", "right", "entities")} for k, r in rows.items()}
    fox = rows[0]
    # "the" and "over" are function words; all others have vectors.
    assert fox["tokens"] == [vectors[w] for w in ("quick", "brown", "jumped", "lazy", "dog")]
    near = vectors["#SND/UNK#"]
    assert fox["left"] == [near, vectors["quick"], vectors["brown"]] and fox["inside"] == [vectors["fox"]]
    assert fox["right"] == [vectors["jumped"], vectors["over"], near]
    assert fox["names"] == ["Fox", "Fox_(band)"] and fox["prior"] == [0.6, 0.4]
    assert fox["entities"] == [vectors["ENTITY/Fox"], vectors["#ENTITY/UNK#"]]


def test_training_lowers_the_loss_and_learns(spark, knowledge):
    texts = [f"{a} water river bank {b}" for a in ("quick", "lazy") for b in ("jumped", "over", "dog")]
    linker = disambiguation.Linker(knowledge, joint.initial_parameters(DIM, hidden=8, seed=2))
    found = linker.found_mentions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("surface = 'bank'")
    gold = found.withColumns({"gold": F.lit("Bank_(river)"), "dataset": F.lit("toy")}).cache()
    schedule = joint.Schedule(steps=16, every=8, rate=0.05, rate_later=0.05)
    rows = linker.training_rows(gold).cache()
    _, _, losses = joint.train(rows, linker.parameters, knowledge.unknown_entity(), lambda p: 0.0, joint.Schedule(steps=4, rate=0.01))
    assert losses[-1] < losses[0]
    trained, f1 = linker.train(gold, gold, schedule)
    before = linker.evaluate(gold).first()
    assert f1 >= 0.8 and f1 > (before.f1 or 0.0) and trained.evaluate(gold).first().tp == round(f1 * len(texts))
    weight, bias = trained.calibrated(gold).calibration
    assert weight > 0 and np.isfinite(bias)
    assert trained.calibration_rows(gold).groupBy("label").count().count() == 2


def test_settings_and_stored_models(spark, knowledge, tmp_path):
    assert disambiguation.settings({"keep_total": 9}, {"keep_total": 5})["keep_total"] == 5
    with pytest.raises(ValueError):
        disambiguation.Linker.load(spark, "x", "y", {"mode": "train"})
    with pytest.raises(ValueError):
        features.require_unknown(knowledge.vectors.where("word <> '#SND/UNK#'"))
    linker = disambiguation.Linker(knowledge, joint.initial_parameters(DIM), (1.0, 2.0))
    linker.save(spark, str(tmp_path / "model"))
    knowledge.index.write.parquet(str(tmp_path / "index"))
    knowledge.vectors.write.parquet(str(tmp_path / "vectors"))
    (tmp_path / "persons.txt").write_text("Dog\t\n")
    again = disambiguation.Linker.load(spark, f"{tmp_path}/", str(tmp_path / "model"), {"keep_total": 99})
    assert again.calibration == (1.0, 2.0) and again.config["keep_total"] == 7 and again.config["model_path"].endswith("model")
    assert all((again.parameters[k] == v).all() for k, v in linker.parameters.items())


def test_gold_beyond_the_cut(spark):
    cands = [(f"e{k}", 1.0 - k / 100) for k in range(40)]
    rows = spark.createDataFrame([(1, "e35", cands), (2, "e3", cands), (3, "no", cands), (4, "x", [])], "doc_id long, gold string, cands array<struct<entity:string,p:double>>")
    got = {r.doc_id: [c.entity for c in r.cands] for r in features.gold_into_candidates(rows).collect()}
    assert set(got) == {1, 2, 3} and got[1] == [f"e{k}" for k in range(29)] + ["e35"] and got[2] == [f"e{k}" for k in range(30)]


@pytest.mark.parametrize("most", [joint.VECTOR_BYTES, 0])
def test_scores_from_words_equal_those_from_vectors(spark, knowledge, monkeypatch, most):
    """Vectors sent to the workers or joined to a chunk's words: the same scores as from a mention's own."""
    monkeypatch.setattr(joint, "VECTOR_BYTES", most)
    linker = disambiguation.Linker(knowledge, joint.initial_parameters(DIM))
    texts = [(1, PANGRAM), (2, PANGRAM + ".\nThe bank of a river."), (3, "fox"), (4, "bank dog bank")]
    found = linker.found_mentions(spark.createDataFrame(texts, "doc_id long, text string")).withColumn("chunk", F.lit(0).cast("long"))
    pad = knowledge.unknown_entity()
    inputs = features.mention_features(found, knowledge.vectors)
    want = {(r.doc_id, r.mention_ord): r for r in inputs.select("doc_id", "mention_ord", "names").join(joint.joint_scores(inputs, linker.parameters, pad), ["doc_id", "mention_ord"]).collect()}
    got = {(r.doc_id, r.mention_ord): r for r in joint.scored_mentions(found, knowledge.vectors, linker.parameters, pad).collect()}
    assert got.keys() == want.keys() and len(got) > 5
    for k, r in want.items():
        assert (got[k].names, got[k].mask) == (r.names, r.mask) and np.allclose(got[k].scores, r.scores, rtol=0, atol=1e-9)


def test_a_linker_keeps_no_contexts_or_vectors(spark, knowledge):
    linker = disambiguation.Linker(knowledge, joint.initial_parameters(DIM))
    linker.results(linker.found_mentions(spark.createDataFrame([(1, PANGRAM)], "doc_id long, text string"))).collect()
    kept = {c for frame in linker.persisted for c in frame.columns}
    linker.release()
    assert kept and not kept & {"left_ctx", "right_ctx", "sentence", "tokens", "left", "right", "entities"}


@pytest.mark.parametrize("n,most", [(1, 1), (4, 2), (9, 4), (6, 3)])
def test_quick_scores_equal_the_models(n, most):
    r, width, pad = np.random.default_rng(n), 4, np.ones(DIM)
    lists = {k: [r.normal(size=(r.integers(1, 5), DIM)) for _ in range(n)] for k in ("tokens", "left", "inside", "right")}
    lists["entities"] = [r.normal(size=(most if k == 0 else r.integers(1, most + 1), DIM)) for k in range(n)]
    whole, p = joint.as_chunk(lists, [r.uniform(0.01, 1, len(x)) for x in lists["entities"]], width, pad), joint.initial_parameters(DIM, hidden=6, seed=n)
    columns = min(most + 1, width)
    cut = joint.Chunk(whole.tokens, whole.token_mask, whole.near, *(x[:, :columns] for x in (whole.entities, whole.mask, whole.prior)))
    want = joint.score(whole, p)
    assert np.allclose(want, slow_scores(whole, p)) and np.allclose(joint.quick_scores(cut, p, most, width - columns + 1), want[:, :columns], rtol=0, atol=1e-12)


def odd_turns():
    texts = [
        "The  quick\tfox, (fox) FOX fox. 12 1e5 nan of_the fox_1\u00a0dog bank\u00a0fox dog\u00a0", None, "", "  ", "\u0130stanbul bank dog \u0301fox \u1c89\ua7cb fox bank", "dog bank fox",
        " ".join(["fox the bank, of river DOG"] * 60) + ".\nNext dog bank! \"Bank dog\" big  dog   bank x", "Dog.\n\nBank? 3 dogs (dog bank.) !! dog - bank ... fox's Fox",
    ]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "fox dog")]


@pytest.mark.parametrize("most,spellings", [(joint.VECTOR_BYTES, passage.FREQUENT_SPELLINGS), (0, 0), (12 * DIM, 2)])
def test_passages_equal_mentions(spark, knowledge, monkeypatch, most, spellings):
    """Document by document: the mentions, candidates and scores of the operators that have a row for each."""
    monkeypatch.setattr(joint, "VECTOR_BYTES", most)
    monkeypatch.setattr(passage, "FREQUENT_SPELLINGS", spellings)
    more = [("big dog bank", "big dog bank", 2, [("Dog", 0.9), ("Bank", 0.4)]), ("dog bank", "dog bank", 3, [("Dog", 0.5), ("Fox", 0.5), ("No", 0.1)]), ("nil", "nil", 1, [])]
    index = knowledge.index.union(spark.createDataFrame(more, knowledge.index.schema))
    docs = spark.createDataFrame(odd_turns(), "doc_id long, text string")
    linker = disambiguation.Linker(disambiguation.KnowledgeBase(index, knowledge.vectors, knowledge.persons), joint.initial_parameters(DIM), (0.5, -0.1))
    found = linker.found_mentions(docs).cache()
    want = {(r.doc_id, r.pos, r.surface): r for r in linker.predict(found).join(found, ["doc_id", "mention_ord"]).select("doc_id", "pos", "surface", "freq", "names", "scores").collect()}
    rows = linker.scored_passages(docs).collect()
    got = {(r.doc_id, r.pos, r.surface): r for r in rows}
    assert got.keys() == want.keys() and len(got) == len(rows) > 150
    for k, r in want.items():
        assert (got[k].freq, got[k].names) == (r.freq, r.names) and np.allclose(got[k].scores[: len(r.names)], r.scores, rtol=0, atol=1e-9), k
    results = [{tuple(r)[:5] + tuple(r)[6:]: round(r.conf_ed, 9) for r in rows.collect()} for rows in (linker.linked(docs), linker.results(linker.found_mentions(docs)))]
    assert results[0] == results[1] and len(results[0]) > 150
    found.unpersist()
    linker.release()


def test_linked_turns_shuffle_no_mentions(spark):
    """What the executors keep between the steps of ``ed_pipeline`` are spellings and whole chunks, no row of a mention."""
    linker = disambiguation.Linker(catalogue._knowledge(spark, SF), joint.initial_parameters(64), (0.5, -0.1))
    turns = catalogue._turns(spark, SF)
    n = linker.linked(turns).count()
    kept = [frame.count() for frame in linker.persisted]
    columns = {c for frame in linker.persisted for c in frame.columns}
    linker.release()
    assert not columns & {"pos", "mention_ord", "sentence", "left_ctx", "start"} and kept[-1] < n / 10
