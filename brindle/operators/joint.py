"""The joint disambiguation model: scores of the mentions of a chunk, and its training.

The model is written once, over ``gradients``; without wanted gradients it is plain
NumPy. A chunk is a bounded number of mentions, so its tensors are bounded.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gradients as G
from . import features, ranking
from .features import unpacked

FAR = 1e10
TOP_TOKENS, ROUNDS, DAMPING, RELATIONS, HIDDEN = 25, 10, 0.3, 3, 100
MARGIN, DIVERSITY, MAX_NORM = 0.01, 1e-7, 100.0

Parameters = dict[str, np.ndarray]


def initial_parameters(dim: int, relations: int = RELATIONS, hidden: int = HIDDEN, seed: int = 1) -> Parameters:
    """Seeded parameters: unit diagonals, relations near zero but the first near one."""
    r = np.random.default_rng(seed)
    near_one = np.zeros((relations, dim))
    near_one[0] = 1.0
    return {
        "attention": np.ones(dim),
        "token_score": np.ones(dim),
        "context": r.uniform(-1, 1, (3 * dim, dim)) / np.sqrt(3 * dim),
        "context_bias": np.zeros(dim),
        "mention_relation": near_one + 0.01 * r.standard_normal((relations, dim)),
        "entity_relation": near_one + 0.01 * r.standard_normal((relations, dim)),
        "pad_entity": 0.1 * r.standard_normal(dim),
        "pad_context": 0.1 * r.standard_normal(dim),
        "hidden": r.uniform(-1, 1, (2, hidden)) / np.sqrt(2),
        "hidden_bias": np.zeros(hidden),
        "output": r.uniform(-1, 1, hidden) / np.sqrt(hidden),
        "output_bias": np.zeros(1),
    }


@dataclass
class Chunk:
    """Mentions x ...: token vectors with masks of the wide context, of the words left of,
    inside and right of the mention, candidate vectors, their mask and prior."""

    tokens: np.ndarray
    token_mask: np.ndarray
    near: list[tuple[np.ndarray, np.ndarray]]
    entities: np.ndarray
    mask: np.ndarray
    prior: np.ndarray
    gold: np.ndarray | None = None


def padded(lists: list[np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of vectors as one array with zeros at the end, and the mask."""
    longest = max([len(x) for x in lists] + [1])
    out, mask = np.zeros((len(lists), longest, dim)), np.zeros((len(lists), longest))
    for k, own in enumerate(lists):
        if len(own):
            out[k, : len(own)], mask[k, : len(own)] = own, 1.0
    return out, mask


def local_scores(chunk: Chunk, p: dict[str, G.Var], keep: int = TOP_TOKENS) -> G.Var:
    """Each candidate against the context that the most telling tokens make up."""
    votes = G.product("icd,itd->ict", G.var(chunk.entities) * p["attention"], chunk.tokens)
    votes = votes * chunk.token_mask[:, None, :] + (chunk.token_mask[:, None, :] - 1) * FAR
    weight = G.largest(votes, 1)
    order = np.argsort(-weight.value, axis=1, kind="stable")[:, : min(keep, weight.value.shape[1])]
    rows = np.arange(len(order))[:, None]
    share = G.softmax(weight[rows, order], 1)
    context = G.product("it,itd->id", share, G.var(chunk.tokens[rows, order]) * p["token_score"])
    scores = G.product("icd,id->ic", chunk.entities, context)
    return scores * chunk.mask + (chunk.mask - 1) * FAR


def mention_vectors(chunk: Chunk, p: dict[str, G.Var]) -> G.Var:
    """Masked means of the words left of, inside and right of each mention, through one layer."""
    means = [(v * m[:, :, None]).sum(axis=1) / (m.sum(axis=1, keepdims=True) + 1e-5) for v, m in chunk.near]
    return G.tanh(G.product("ik,kd->id", np.concatenate(means, axis=1), p["context"]) + p["context_bias"])


def relation_weights(vectors: G.Var, p: dict[str, G.Var]) -> G.Var:
    """Relations x mentions x mentions: softmax over the other mentions, plus its transpose."""
    n, dim = vectors.value.shape
    rows = G.product("id,rd->rid", vectors, p["mention_relation"])
    raw = G.product("rid,jd->rij", rows, vectors) + np.eye(n) * -FAR
    soft = G.softmax(raw * (1 / np.sqrt(dim)), 2)
    return soft + G.swap(soft, 0, 2, 1)


def coherence(entities: G.Var, mask: np.ndarray, weights: G.Var, p: dict[str, G.Var]) -> G.Var:
    """``[i, c, j, d]``: how well two candidates go together, by weighted relations."""
    parts = None
    for r in range(weights.value.shape[0]):
        one = G.product("icd,jed->icje", entities * p["entity_relation"][r], entities)
        one = (one * mask + (mask - 1) * FAR) * weights[r][:, None, :, None]
        parts = one if parts is None else parts + one
    return parts * (1 / weights.value.shape[0])


def belief_propagation(local: G.Var, pair: G.Var, rounds: int = ROUNDS, damping: float = DAMPING) -> G.Var:
    """Max-product messages between all mentions; ``message[i, c, j]`` goes to i from j."""
    local, pair = G.var(local), G.var(pair)
    n, c = local.value.shape
    others = 1.0 - np.eye(n)
    message = G.Var(np.zeros((n, c, n)))
    for _ in range(rounds):
        heard = G.product("jdk,ik->ijd", message, others)  # all that j heard but from i
        best = G.largest(pair + local + heard[:, None, :, :], 3)
        message = G.log(G.softmax(best, 1) * damping + G.exp(message) * (1 - damping))
    return G.softmax(local + G.total(message * others[:, None, :], 2), 1)


def chunk_scores(chunk: Chunk, p: dict[str, G.Var]) -> G.Var:
    """Mentions x candidates. A padding mention joins, so that there are two at least."""
    n, c, dim = chunk.entities.shape
    pad = np.zeros((1, c))
    pad[0, 0] = 1.0
    local = G.joined([local_scores(chunk, p), np.zeros((1, c))])
    entities = G.joined([chunk.entities, p["pad_entity"] * np.ones((1, c, dim))])
    vectors = G.joined([mention_vectors(chunk, p), p["pad_context"] * np.ones((1, dim))])
    mask, prior = np.concatenate([chunk.mask, pad]), np.concatenate([chunk.prior, pad])
    belief = belief_propagation(local, coherence(entities, mask, relation_weights(vectors, p), p))
    hidden = G.relu(belief[:, :, None] * p["hidden"][0] + np.log(prior + 1e-20)[:, :, None] * p["hidden"][1] + p["hidden_bias"])
    return (G.product("ich,h->ic", hidden, p["output"]) + p["output_bias"])[:n]


def score(chunk: Chunk, parameters: Parameters) -> np.ndarray:
    return chunk_scores(chunk, {k: G.Var(v) for k, v in parameters.items()}).value


def quick_scores(chunk: Chunk, parameters: Parameters, real: int, repeat: int = 1) -> np.ndarray:
    """``score`` without gradients, for chunks whose candidates from place ``real`` on are masked.
    The last candidate counts ``repeat`` times; masked ones give no message, as their local
    scores lie far below all others, and so do those of the padding mention."""
    p, (n, c, dim) = parameters, chunk.entities.shape
    rows = np.arange(n)[:, None]
    votes = (chunk.entities * p["attention"]) @ chunk.tokens.transpose(0, 2, 1)
    votes = votes * chunk.token_mask[:, None, :] + (chunk.token_mask[:, None, :] - 1) * FAR
    weight = votes.max(axis=1)
    order = np.argsort(-weight, axis=1, kind="stable")[:, :TOP_TOKENS]
    share = _soft(weight[rows, order], 1)
    context = (share[:, None, :] @ (chunk.tokens[rows, order] * p["token_score"]))[:, 0, :]
    local = (chunk.entities @ context[:, :, None])[:, :, 0] * chunk.mask + (chunk.mask - 1) * FAR
    local = np.concatenate([local, np.zeros((1, c))])
    entities = np.concatenate([chunk.entities, np.broadcast_to(p["pad_entity"], (1, c, dim))])
    means = [(v * m[:, :, None]).sum(axis=1) / (m.sum(axis=1, keepdims=True) + 1e-5) for v, m in chunk.near]
    vectors = np.concatenate([np.tanh(np.concatenate(means, axis=1) @ p["context"] + p["context_bias"]), p["pad_context"][None]])
    pad = np.zeros((1, c))
    pad[0, 0] = 1.0
    mask, n = np.concatenate([chunk.mask, pad])[:, :real].T, n + 1
    # Pair scores as mention, candidate, other candidate, other mention.
    others = entities[:, :real].transpose(1, 0, 2).reshape(real * n, dim).T
    pair, weights = np.zeros((n, c, real, n)), np.zeros((n, n))
    for r in range(len(p["entity_relation"])):
        raw = (vectors * p["mention_relation"][r]) @ vectors.T + np.eye(n) * -FAR
        soft = _soft(raw * (1 / np.sqrt(dim)), 1)
        soft = (soft + soft.T) / len(p["entity_relation"])
        one = ((entities * p["entity_relation"][r]).reshape(n * c, dim) @ others).reshape(n, c, real, n)
        one *= soft[:, None, None, :]
        pair += one
        weights += soft
    pair *= mask
    pair += ((mask - 1) * FAR * weights[:, None, :])[:, None]
    times = np.ones((c, 1))
    times[-1] = repeat
    message, shares, heard = np.zeros((n, c, n)), np.ones((n, c, n)), np.empty_like(pair)
    for _ in range(ROUNDS):
        # All that a mention heard but from the one that it speaks to: [to, candidate, from].
        said = local[:, :real].T + message.sum(axis=2)[:, :real].T - message[:, :real].transpose(2, 1, 0)
        np.add(pair, said[:, None], out=heard)
        best = heard.max(axis=2)
        best -= best.max(axis=1, keepdims=True)
        np.exp(best, out=best)
        best *= DAMPING / (best * times).sum(axis=1, keepdims=True)
        shares *= 1 - DAMPING
        shares += best
        message = np.log(shares)
    total = local + message.sum(axis=2) - message[np.arange(n), :, np.arange(n)]
    total = np.exp(total - total.max(axis=1, keepdims=True))
    belief = (total / (total * times[:, 0]).sum(axis=1, keepdims=True))[:-1]
    hidden = np.maximum(belief[:, :, None] * p["hidden"][0] + np.log(chunk.prior + 1e-20)[:, :, None] * p["hidden"][1] + p["hidden_bias"], 0.0)
    return hidden @ p["output"] + p["output_bias"]


def _soft(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


# Training -------------------------------------------------------------------------


def diversity(vectors: G.Var) -> G.Var:
    """Sum of the distances below one between the normalised relations."""
    unit = vectors * (1 / np.maximum(np.linalg.norm(vectors.value, axis=1, keepdims=True), 1e-12))
    n = vectors.value.shape[0]
    gaps = unit[:, None, :] - unit[None, :, :]
    far = G.root(G.total(gaps * gaps, 2) + 1e-5)
    return G.total(far * (far.value < 1.0) * np.ones((n, n)))


def loss(scores: G.Var, gold: np.ndarray, p: dict[str, G.Var], margin: float = MARGIN, weight: float = DIVERSITY) -> G.Var:
    """Mean multi-class margin loss less the relations' diversity."""
    n, c = scores.value.shape
    right = scores[np.arange(n), gold]
    wrong = np.ones((n, c))
    wrong[np.arange(n), gold] = 0.0
    gaps = G.relu(scores - right[:, None] + margin) * wrong
    return G.total(gaps) * (1 / (n * c)) - (diversity(p["mention_relation"]) + diversity(p["entity_relation"])) * weight


def gradient(chunk: Chunk, parameters: Parameters) -> tuple[float, Parameters]:
    p = {k: G.Var(v, wanted=True) for k, v in parameters.items()}
    value = loss(chunk_scores(chunk, p), chunk.gold, p)
    value.backward()
    return float(value.value), {k: v.grad if v.grad is not None else np.zeros_like(v.value) for k, v in p.items()}


def bounded(parameters: Parameters, most: float = MAX_NORM) -> Parameters:
    """Tensors of the last two layers scaled back to a norm of at most ``most``."""
    out = dict(parameters)
    for k in ("hidden", "hidden_bias", "output", "output_bias"):
        norm = np.linalg.norm(out[k])
        if norm > most:
            out[k] = out[k] * (most / norm)
    return out


class Adam:
    def __init__(self, parameters: Parameters, rate: float = 1e-4):
        self.rate, self.steps = rate, 0
        self.first = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.second = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, parameters: Parameters, slope: Parameters) -> Parameters:
        self.steps += 1
        out = {}
        for k, v in parameters.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * slope[k]
            self.second[k] = 0.999 * self.second[k] + 0.001 * slope[k] ** 2
            m, s = self.first[k] / (1 - 0.9**self.steps), self.second[k] / (1 - 0.999**self.steps)
            out[k] = v - self.rate * m / (np.sqrt(s) + 1e-8)
        return out


# Spark ----------------------------------------------------------------------------

#: One mention: what ``features.mention_features`` gives.
COLUMNS = ("tokens", "left", "inside", "right", "entities", "prior")


def to_chunk(table: pd.DataFrame, width: int, pad_vector: np.ndarray) -> Chunk:
    """Rows of one chunk, in order, as tensors; candidates are filled up to ``width``. Vectors
    come packed (see ``features.packed``)."""
    dim = len(pad_vector)
    lists = {n: [unpacked(None if v is None else list(v), dim) for v in table[n]] for n in ("tokens", "left", "inside", "right", "entities")}
    return as_chunk(lists, list(table.prior), width, pad_vector, np.asarray(table.gold, int) if "gold" in table else None)


def as_chunk(lists: dict[str, list[np.ndarray]], priors: list[np.ndarray], width: int, pad_vector: np.ndarray, gold: np.ndarray | None = None) -> Chunk:
    """The vectors of a chunk's mentions as tensors."""
    dim = len(pad_vector)
    tokens, token_mask = padded(lists["tokens"], dim)
    near = [padded(lists[n], dim) for n in ("left", "inside", "right")]
    n = len(priors)
    entities, mask, prior = np.tile(pad_vector, (n, width, 1)), np.zeros((n, width)), np.full((n, width), 1e-8)
    for k, (own, p) in enumerate(zip(lists["entities"], priors)):
        if len(own):
            entities[k, : len(own)], mask[k, : len(own)], prior[k, : len(own)] = own, 1.0, p
    return Chunk(tokens, token_mask, near, entities, mask, prior, gold)


def joint_scores(mentions: DataFrame, parameters: Parameters, pad_vector: np.ndarray, width: int = 7) -> DataFrame:
    """``doc_id, mention_ord, scores, mask`` of mentions (``doc_id, chunk, mention_ord`` and
    ``COLUMNS``); scores are those of the candidates in order, filled up to ``width``."""
    shared = mentions.sparkSession.sparkContext.broadcast((parameters, pad_vector))

    def run(table: pd.DataFrame) -> pd.DataFrame:
        known, pad = shared.value
        table = table.sort_values("mention_ord")
        chunk = to_chunk(table, width, pad)
        return pd.DataFrame({"doc_id": table.doc_id, "mention_ord": table.mention_ord, "scores": list(score(chunk, known)), "mask": list(chunk.mask)})

    kind = dict(mentions.dtypes)
    rows = mentions.select("doc_id", "chunk", "mention_ord", *COLUMNS)
    return rows.groupBy("doc_id", "chunk").applyInPandas(run, f"doc_id {kind['doc_id']}, mention_ord {kind['mention_ord']}, scores array<double>, mask array<double>")


#: Vectors are sent to every worker up to these bytes; beyond, a chunk's own are joined to it.
VECTOR_BYTES = 32 << 20


def scored_mentions(
    mentions: DataFrame, vectors: DataFrame, parameters: Parameters, pad_vector: np.ndarray, keep_context: int = ranking.KEEP_CONTEXT, keep_total: int = ranking.KEEP_TOTAL
) -> DataFrame:
    """``doc_id, mention_ord, names, scores, mask`` of mentions (as ``features.mention_features``
    takes them): the scores of ``joint_scores`` over these features.

    Words travel, not vectors: a mention has hundreds of context words, and those of a
    chunk's mentions are nearly the same, so a chunk meets each word's vector once.
    """
    rows, known, key = features.mention_words(mentions), features.packed(vectors), ["doc_id", "chunk"]
    dim, kind = len(pad_vector), dict(rows.dtypes)
    spark, near = mentions.sparkSession, features.UNKNOWN["near"]
    listed = list(features.UNKNOWN.values())
    small = vectors.count() * dim * 4 <= VECTOR_BYTES
    found = (known if small else known.where(F.col("word").isin(*listed))).toArrow()
    shared = spark.sparkContext.broadcast((parameters, pad_vector, features.Vectors(found["word"].to_pylist(), found["emb"].to_pylist(), dim) if small else dict(zip(found["word"].to_pylist(), found["emb"].to_pylist()))))

    def scored(table: pd.DataFrame, vector: features.Vectors) -> pd.DataFrame:
        own, pad = shared.value[:2]
        table = table.sort_values("mention_ord")
        lists: dict[str, list[np.ndarray]] = {n: [] for n in ("tokens", "left", "inside", "right", "entities")}
        names, priors = [], []
        for row in table.itertuples(index=False):
            left, right = vector.of(row.l)[-features.CONTEXT_WORDS :], vector.of(row.r)[: features.CONTEXT_WORDS]
            nearest = np.concatenate([left[-features.PRERANK_WORDS :], right[: features.PRERANK_WORDS]])
            both = np.concatenate([left, right])
            none = vector.of([features.UNKNOWN["word"]])
            entities = vector.of([features.ENTITY + x if x is not None else None for x in row.names], features.UNKNOWN["entity"])
            kept = features.kept_candidates(entities @ (nearest if len(nearest) else none).mean(axis=0), keep_context, keep_total)
            lists["tokens"].append(both if len(both) else none)
            lists["entities"].append(entities[kept])
            for side in ("left", "inside", "right"):
                words = getattr(row, side)
                lists[side].append(vector.of(words if len(words) else [near], near))
            names.append([row.names[k] for k in kept])
            priors.append(np.asarray(row.prior)[kept])
        chunk = as_chunk(lists, priors, keep_total, pad)
        return pd.DataFrame({"doc_id": table.doc_id, "mention_ord": table.mention_ord, "names": names, "scores": list(score(chunk, own)), "mask": list(chunk.mask)})

    schema = f"doc_id {kind['doc_id']}, mention_ord {kind['mention_ord']}, names array<string>, scores array<double>, mask array<double>"
    if small:
        return rows.groupBy(*key).applyInPandas(lambda table: scored(table, shared.value[2]), schema)

    def joined(table: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if table.empty:
            return pd.DataFrame({n: [] for n in ("doc_id", "mention_ord", "names", "scores", "mask")})
        every = shared.value[2] | dict(zip(own.word, own.emb))
        return scored(table, features.Vectors(list(every), list(every.values()), dim))

    words = F.concat("l", "r", "left", "inside", "right", F.transform("names", features.entity_word))
    asked = rows.select(F.col("doc_id").alias("_doc_id"), F.col("chunk").alias("_chunk"), F.explode(words).alias("word")).distinct()
    return rows.groupBy(*key).cogroup(asked.join(known, "word").groupBy("_doc_id", "_chunk")).applyInPandas(joined, schema)


def summed_gradient(mentions: DataFrame, parameters: Parameters, pad_vector: np.ndarray, width: int = 7) -> tuple[float, int, Parameters]:
    """Loss, chunks and gradient summed over all chunks of ``mentions`` (with ``gold``, the
    place of the right candidate). A task sends its sum only, whatever it holds."""
    shared = mentions.sparkSession.sparkContext.broadcast((parameters, pad_vector))

    def chunks(table: pd.DataFrame) -> pd.DataFrame:
        known, pad = shared.value
        value, slope = gradient(to_chunk(table.sort_values("mention_ord"), width, pad), known)
        return pd.DataFrame({"loss": [value], "slope": [pickle.dumps(slope)]})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, n, total = 0.0, 0, None
        for batch in batches:
            for own, data in zip(batch.column("loss").to_pylist(), batch.column("slope").to_pylist()):
                slope = pickle.loads(data)
                value, n = value + own, n + 1
                total = slope if total is None else {k: total[k] + v for k, v in slope.items()}
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([n]), pa.array([pickle.dumps(total)], pa.binary())], ["loss", "n", "slope"])

    rows = mentions.select("doc_id", "chunk", "mention_ord", *COLUMNS, "gold").groupBy("doc_id", "chunk").applyInPandas(chunks, "loss double, slope binary")
    value, n, total = 0.0, 0, {k: np.zeros_like(v) for k, v in parameters.items()}
    for row in rows.mapInArrow(sums, "loss double, n long, slope binary").toLocalIterator():
        value, n = value + row.loss, n + row.n
        total = {k: total[k] + v for k, v in pickle.loads(row.slope).items()}
    return value, n, total


@dataclass
class Schedule:
    """Steps at most, how often and when to evaluate, and what an evaluation changes."""

    steps: int = 1000
    every: int = 5
    every_later: int = 2
    rate: float = 1e-4
    rate_later: float = 1e-5
    change_at: float = 0.915
    patience: int = 10


def train(
    mentions: DataFrame, parameters: Parameters, pad_vector: np.ndarray, evaluate: Callable[[Parameters], float], schedule: Schedule = Schedule(), width: int = 7
) -> tuple[Parameters, float, list[float]]:
    """Best parameters by ``evaluate`` (F1 on development data), that F1, and the mean losses.

    Each step is a pass of all chunks in parallel and one Adam step on the driver. The
    rate drops once when the F1 reaches ``change_at``; training ends after ``patience``
    evaluations without a better F1.
    """
    adam, best, best_f1, worse, every = Adam(parameters, schedule.rate), parameters, -1.0, 0, schedule.every
    losses = []
    for step in range(1, schedule.steps + 1):
        value, n, slope = summed_gradient(mentions, parameters, pad_vector, width)
        if not n:
            break
        losses.append(value / n)
        parameters = bounded(adam.step(parameters, {k: v / n for k, v in slope.items()}))
        if step % every:
            continue
        f1 = evaluate(parameters)
        if adam.rate == schedule.rate and f1 >= schedule.change_at and schedule.rate_later != schedule.rate:
            adam.rate, every, best_f1, worse = schedule.rate_later, schedule.every_later, f1, 0
        if f1 < best_f1:
            worse += 1
        else:
            best, best_f1, worse = parameters, f1, 0
        if worse >= schedule.patience:
            break
    return best, best_f1, losses
