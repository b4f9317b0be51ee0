"""A document in one row: its mentions, coreference and contexts, and the scores of its chunks.

What the operators of ``mentions``, ``context`` and ``features`` say with joins of one row
for each mention is said here inside a document: a mention's contexts and candidates are
never rows of their own. Spellings and words that are frequent are sent to the workers, up
to a fixed size; a document or chunk is joined once to those of its own that are not.
"""

from __future__ import annotations

import pickle
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import context, features, joint, mentions, pem, stored

#: Spellings sent to the workers at most, and their candidates together.
FREQUENT_SPELLINGS, FREQUENT_CANDIDATES = 1 << 15, 1 << 18
#: Rows of an Arrow batch that are Python objects at once.
STEP = 64

TOKEN = re.compile(r"[^ \t\n\x0b\f\r]+")
NUMBER = re.compile(r"[0-9]+(?:_[0-9]+)*(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|nan|inf(?:inity)?")
STOPWORDS = frozenset(X.STOPWORDS)
CHUNK = "doc_id {}, chunk long, rare array<string>, body binary"


def telling(word: str) -> bool:
    """``X.is_important`` of a run of letters, digits and underscores."""
    low = word.lower()
    return len(word) > 1 and low not in STOPWORDS and NUMBER.fullmatch(low) is None


def spellings(grams: DataFrame, index: DataFrame, persons: DataFrame) -> DataFrame:
    """``surface, n, low, freq, person, cands`` of the n-grams that are found: how often they
    are met, their lower case where it differs, whether their best candidate is a person."""
    asked = grams.groupBy(F.col("ngram").alias("surface")).agg(F.count("*").alias("n"))
    found = mentions.spelling_lookup(asked, index).where("freq > 0")
    listed = mentions.candidate_lists(found, index, pem.TOP, keep_empty=True)
    named = persons.select(F.col("name").alias("_person")).distinct()
    listed = listed.join(asked, "surface").join(named, F.get("cands", F.lit(0))["entity"] == F.col("_person"), "left")
    low = F.when(F.lower("surface") != F.col("surface"), F.lower("surface"))
    return listed.select("surface", "n", low.alias("low"), "freq", F.col("_person").isNotNull().alias("person"), "cands")


SPELLING = ("low", "freq", "person", "cands")


def frequent_spellings(known: DataFrame) -> dict[str, tuple]:
    """What the most frequent spellings stand for, bounded by number and candidates."""
    out: dict[str, tuple] = {}
    total = 0
    for r in known.orderBy(F.desc("n"), "surface").limit(FREQUENT_SPELLINGS).select("surface", *SPELLING).toArrow().to_pylist():
        total += len(r["cands"])
        if total > FREQUENT_CANDIDATES:
            break
        out[r["surface"]] = _spelling(r)
    return out


def _spelling(r: Mapping[str, Any]) -> tuple:
    return r["low"] or r["surface"], r["freq"], r["person"], [(c["entity"], c["p"]) for c in r["cands"]]


def frequent_words(docs: DataFrame, known: DataFrame, vectors: DataFrame, dim: int, most: int) -> tuple[dict[str, int], np.ndarray, dict[str, np.ndarray]]:
    """Places of the most frequent words in a matrix of at most ``most`` bytes (-1 for words
    without a vector), the matrix, and the vectors that stand for unknown ones."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\n")).alias("line"))
    words = lines.select(F.explode(F.concat(features.context_words(F.col("line")), X.space_tokens(F.col("line")))).alias("word"), F.lit(1).cast("long").alias("n"))
    entities = known.select("n", F.explode(F.slice("cands", 1, features.MAX_CANDIDATES)).alias("c")).select(features.entity_word(F.col("c.entity")).alias("word"), "n")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).union(entities.groupBy("word").agg(F.sum("n").alias("n"))).where("word IS NOT NULL")
    top = top.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(max(most // (4 * dim), 0)).select("word")
    place = dict.fromkeys([*features.UNKNOWN.values(), *top.toArrow()["word"].to_pylist()], -1)
    asked = docs.sparkSession.sparkContext.broadcast(frozenset(place))
    found = features.packed(vectors, lambda w: w in asked.value).where("emb IS NOT NULL").toArrow()
    rows: list[bytes] = []
    for word, emb in zip(found["word"].to_pylist(), found["emb"].to_pylist()):
        if place[word] < 0:
            place[word] = len(rows)
            rows.append(emb)
    asked.destroy()
    matrix = np.frombuffer(b"".join(rows), np.float32).reshape(-1, dim)
    return place, matrix, {k: matrix[place[w]].astype(float) for k, w in features.UNKNOWN.items()}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        for first in range(0, batch.num_rows, STEP):
            yield batch.slice(first, STEP).to_pydict()


def _grams(sentence: str, n: int, passes: mentions.SpellingFilter) -> Iterator[tuple[int, int, str]]:
    """``size, start, ngram`` of a sentence's n-grams that an index may know, as ``mentions.ngrams`` gives them."""
    found = [(m.start(), m[0]) for m in re.finditer(r"\S+", sentence)]
    tokens = [t for _, t in found]
    clean = [mentions.PUNCTUATION.fullmatch(t) is None for t in tokens]
    for at in range(len(tokens)):
        for size in mentions._sizes(tokens, clean, at, n, passes):
            yield size, found[at][0], " ".join(tokens[at : at + size])


def rare_spellings(docs: DataFrame, n: int, passes: Broadcast, frequent: Broadcast) -> DataFrame:
    """``doc_id, surface``: each document's n-grams that an index may know, but for the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            row: list[int] = []
            texts: list[str] = []
            for k, cut in enumerate(part["sents"]):
                own = {g for x in cut for _, _, g in _grams(x["sentence"], n, passes.value) if g not in frequent.value}
                row += [k] * len(own)
                texts += own
            ids = pa.array(part["doc_id"], kind).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["doc_id", "surface"])

    name = dict(docs.dtypes)["doc_id"]
    kind = _arrow(docs, "doc_id")
    return docs.select("doc_id", mentions.sentence_list(F.col("text")).alias("sents")).mapInArrow(stored.thrifty(run), f"doc_id {name}, surface string")


def _arrow(frame: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema[column].dataType)


def longest(cells: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``mentions.longest_mentions`` of one sentence's ``size, start, ngram``."""
    touched: dict[int, list[tuple[int, int, str]]] = {}
    kept = []
    for cell in sorted(cells, key=lambda c: (-c[0], c[1], c[2])):
        _, start, text = cell
        end = start + len(text)
        stretches = range(start // 64, (end - 1) // 64 + 1)
        if any(text in t and start < e and s < end for j in stretches for s, e, t in touched.get(j, ())):
            continue
        for j in stretches:
            touched.setdefault(j, []).append((start, end, text))
        kept.append(cell)
    return kept


def coreferent(found: list[tuple]) -> dict[str, list[tuple[str, float]]]:
    """``context.coreferent_candidates`` of a document's spellings (``low, freq, person,
    cands``, one for each mention, in order): new candidates by lower-cased name."""
    people: dict[str, list[list]] = {}
    for low, _, person, cands in found:
        if person:
            people.setdefault(low, []).append(cands)
    if not people:
        return {}
    names = list(dict.fromkeys(x[0] for x in found))
    out = {}
    for name, held in zip(names, context.containers(names)):
        lists = [c for k in held for c in people.get(names[k], ())]
        if not lists:
            continue
        sums: dict[str | None, float | None] = {}
        for cands in lists:
            for entity, p in cands:
                before = sums.get(entity)
                sums[entity] = before if p is None else p if before is None else before + p
        shares = [(e, None if s is None else s / len(lists)) for e, s in sums.items()]
        out[name] = sorted(shares, key=lambda x: (x[1] is not None, -(x[1] or 0.0), x[0] is not None, x[0] or ""))
    return out


class Words:
    """The words of a chunk, each once, by number."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}

    def of(self, words: list[str]) -> list[int]:
        return [self.at.setdefault(w, len(self.at)) for w in words]


class Text:
    """A document's white-space tokens with their telling words, and where a sentence's begin."""

    def __init__(self, sents: list[dict]):
        self.tokens: list[str] = []
        self.words: list[list[str]] = []
        self.base: list[int] = []
        self.spans: list[tuple[list[int], list[int]]] = []
        self.runs: list[tuple[list[int], list[int]]] = []
        self.text = [x["sentence"] for x in sents]
        for x in sents:
            sentence, at = x["sentence"], 0
            cut = [m.span() for m in TOKEN.finditer(sentence)]
            begins, ends = [], []
            for run in x["runs"]:
                at = sentence.index(run, at)
                begins.append(at)
                at += len(run)
                ends.append(at)
            self.base.append(len(self.tokens))
            self.spans.append(([a for a, _ in cut], [b for _, b in cut]))
            self.runs.append((begins, ends))
            k = 0
            for a, b in cut:
                own = []
                while k < len(begins) and begins[k] < b:
                    if telling(word := sentence[begins[k] : ends[k]]):
                        own.append(word)
                    k += 1
                self.tokens.append(sentence[a:b])
                self.words.append(own)

    def piece(self, s: int, a: int, b: int) -> tuple[str, list[str]]:
        """A part of a token, with its telling words."""
        begins, ends = self.runs[s]
        own = [self.text[s][max(begins[k], a) : min(ends[k], b)] for k in range(bisect_right(ends, a), bisect_left(begins, b))]
        return self.text[s][a:b], [w for w in own if telling(w)]

    def sides(self, s: int, start: int, end: int) -> tuple[int, tuple | None, int, tuple | None, list[str], list[str]]:
        """Tokens before a place of a sentence, what it cuts off the next one, and the same behind
        it; the nearest tokens of its sentence on both sides."""
        begins, ends = self.spans[s]
        k = bisect_right(ends, start)
        left = self.piece(s, begins[k], start) if k < len(begins) and begins[k] < start else None
        j = bisect_left(begins, end)
        right = self.piece(s, end, ends[j - 1]) if j and ends[j - 1] > end else None
        base, n = self.base[s], features.NEAR_WORDS
        before = self.tokens[max(base + k - n, base) : base + k] + ([left[0]] if left else [])
        after = ([right[0]] if right else []) + self.tokens[base + j : min(base + j + n, base + len(begins))]
        return base + k, left, base + j, right, before[-n:], after[:n]


def chunks(docs: DataFrame, n: int, passes: Broadcast, frequent: Broadcast, places: Broadcast, config: Mapping[str, Any]) -> DataFrame:
    """``doc_id, chunk, rare, body`` of documents (``doc_id, text, own``, their rare spellings): at
    most ``chunk_mentions`` mentions with the words around them, and those of its words that are
    not among ``places``. A task holds a document at a time."""
    kind, size, reach, together = _arrow(docs, "doc_id"), config["chunk_mentions"], config["context_words"], config["coreference"] != "none"

    def of(sents: list[dict], own: dict[str, tuple]) -> Iterator[tuple[int, list[str], bytes]]:
        found = []
        for s, x in enumerate(sents):
            met = [(size, start, g) for size, start, g in _grams(x["sentence"], n, passes.value) if g in own or g in frequent.value]
            found += [(x["pos_start"] + start, x["pos_start"] + start + len(g), s, start, g) for _, start, g in longest(met)]
        found.sort()
        said = [own.get(x[4]) or frequent.value[x[4]] for x in found]
        new = coreferent(said) if together else {}
        text = Text(sents) if found else None
        for first in range(0, len(found), size):
            words, rows, entities, asked = Words(), [], set(), []
            for (pos, _, s, start, g), (low, freq, _, cands) in zip(found[first : first + size], said[first : first + size]):
                cands = (new.get(low) or cands)[: features.MAX_CANDIDATES]
                if cands:
                    asked.append((pos, g, freq, cands, *text.sides(s, start, start + len(g))))
                    entities.update(features.ENTITY + e for e, _ in cands if e is not None)
            if not asked:
                continue
            lo, hi = max(0, min(x[4] for x in asked) - reach), min(len(text.tokens), max(x[6] for x in asked) + reach)
            ids = [words.of(w) for w in text.words[lo:hi]]
            for pos, g, freq, cands, at, left, behind, right, before, after in asked:
                near = [words.of(w) for w in (before, TOKEN.findall(g), after)]
                rows.append((pos, g, freq, cands, at - lo, words.of(left[1]) if left else None, behind - lo, words.of(right[1]) if right else None, near))
            every = list(words.at)
            rare = [w for w in {*every, *entities} if w not in places.value.places]
            body = (every, np.cumsum([0, *map(len, ids)]).astype(np.int32), np.array([w for x in ids for w in x], np.int32), rows)
            yield first // size, rare, zlib.compress(pickle.dumps(body, 5), 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            for doc, sents, own in zip(part["doc_id"], part["sents"], part["own"]):
                out = list(of(sents, {r["surface"]: _spelling(r) for r in own or ()}))
                if out:
                    numbers, rare, bodies = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(out), kind), pa.array(numbers, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(bodies, pa.binary())], ["doc_id", "chunk", "rare", "body"]
                    )

    runs = lambda x: F.regexp_extract_all(x["sentence"], F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    cut = F.transform(mentions.sentence_list(F.col("text")), lambda x: F.struct(x["sentence"].alias("sentence"), x["pos_start"].alias("pos_start"), runs(x).alias("runs")))
    return docs.select("doc_id", cut.alias("sents"), "own").mapInArrow(stored.thrifty(run), CHUNK.format(dict(docs.dtypes)["doc_id"]))


def _cells(lists: list[np.ndarray | list[int]], none: int) -> np.ndarray:
    """Numbers of words as rows of one table, filled up with ``none``."""
    out = np.full((len(lists), max([len(x) for x in lists] + [1])), none)
    for k, own in enumerate(lists):
        out[k, : len(own)] = own
    return out


class Scorer:
    """Scores of chunks' bodies over the frequent words' vectors and a chunk's own."""

    def __init__(self, parameters: joint.Parameters, places: dict[str, int], matrix: np.ndarray, unknown: dict[str, np.ndarray], config: Mapping[str, Any]):
        self.parameters, self.places, self.matrix, self.unknown = parameters, places, matrix, unknown
        self.reach, self.keep_context, self.keep_total = config["context_words"], config["keep_context"], config["keep_total"]

    def vectors(self, words: list[str], own: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words' vectors and which of them have one."""
        at = np.array([self.places.get(w, -1) for w in words], int)
        out, known = np.zeros((len(words), self.matrix.shape[1])), at >= 0
        out[known] = self.matrix[at[known]]
        if own:
            for k in np.flatnonzero(~known):
                emb = own.get(words[k])
                if emb is not None:
                    out[k], known[k] = np.frombuffer(emb, np.float32), True
        return out, known

    def __call__(self, body: bytes, own: dict[str, bytes]) -> Iterator[tuple]:
        """``pos, surface, freq, names, scores, mask`` of a chunk's mentions."""
        words, offsets, flat, rows = pickle.loads(zlib.decompress(body))
        named = {e: None for x in rows for e, _ in x[3]}
        entities, there = self.vectors([features.ENTITY + e if e is not None else "" for e in named], own)
        entities[~there] = self.unknown["entity"]
        named = {e: k for k, e in enumerate(named)}
        vector, known = self.vectors(words, own)
        n = len(words)
        # Rows behind the words: nothing, and what stands for unknown words.
        vector = np.concatenate([vector, np.zeros((1, vector.shape[1])), [self.unknown["word"], self.unknown["near"]]])
        nothing, no_word, no_near = n, n + 1, n + 2
        near_at = np.append(np.where(known, np.arange(n), no_near), [nothing, no_word, no_near])
        has = known[flat]
        kept_words, kept_offsets = flat[has], np.concatenate([[0], np.cumsum(has)])[offsets]
        last = len(offsets) - 1
        tokens, near, chosen, names, priors = [], ([], [], []), [], [], []
        for _, _, _, cands, at, left, behind, right, sides in rows:
            l = kept_words[kept_offsets[max(at - self.reach + (left is not None), 0)] : kept_offsets[at]]
            r = kept_words[kept_offsets[behind] : kept_offsets[min(behind + self.reach - (right is not None), last)]]
            if left:
                l = np.append(l, [w for w in left if known[w]]).astype(int)
            if right:
                r = np.append([w for w in right if known[w]], r).astype(int)
            l, r = l[-features.CONTEXT_WORDS :], r[: features.CONTEXT_WORDS]
            nearest = np.concatenate([l[-features.PRERANK_WORDS :], r[: features.PRERANK_WORDS]])
            both = np.concatenate([l, r])
            places = [named[e] for e, _ in cands]
            kept = features.kept_candidates(entities[places] @ vector[nearest if len(nearest) else [no_word]].mean(axis=0), self.keep_context, self.keep_total)
            tokens.append(both if len(both) else [no_word])
            for into, side in zip(near, sides):
                into.append(near_at[side] if len(side) else [no_near])
            chosen.append([places[k] for k in kept])
            names.append([cands[k][0] for k in kept])
            priors.append([min(1.0, max(1e-3, cands[k][1])) if cands[k][1] is not None else 1e-3 for k in kept])
        width = self.keep_total
        count = np.array([len(x) for x in chosen])
        # Candidates beyond all mentions' own are alike: one column stands for them.
        most = int(count.max())
        columns = min(most + 1, width)
        cell = _cells(chosen, len(entities))
        cell = np.concatenate([cell, np.full((len(rows), columns - cell.shape[1]), len(entities))], axis=1)
        at = np.concatenate([entities, [self.unknown["entity"]]])[cell]
        mask, prior = np.zeros((len(rows), columns)), np.full((len(rows), columns), 1e-8)
        for k, p in enumerate(priors):
            mask[k, : len(p)], prior[k, : len(p)] = 1.0, p
        table = _cells(tokens, nothing)
        sides = [(vector[x], (x != nothing).astype(float)) for x in (_cells(side, nothing) for side in near)]
        chunk = joint.Chunk(vector[table], (table != nothing).astype(float), sides, at, mask, prior)
        scores = joint.quick_scores(chunk, self.parameters, most, width - columns + 1)
        scores = np.concatenate([scores, np.repeat(scores[:, -1:], width - columns, axis=1)], axis=1)
        masks = np.arange(width) < count[:, None]
        for x, said, score, real in zip(rows, names, scores, masks):
            yield x[0], x[1], x[2], said, score, real.astype(float)


SCORED = "doc_id {}, pos int, surface string, freq bigint, names array<string>, scores array<double>, mask array<double>"


def scored(rows: DataFrame, scorer: Broadcast) -> DataFrame:
    """The scores of chunks (``doc_id, body, own``, the vectors of its rare words)."""
    kind = _arrow(rows, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            ids, out = [], []
            for doc, body, own in zip(part["doc_id"], part["body"], part["own"]):
                said = list(scorer.value(body, {r["word"]: r["emb"] for r in own or ()}))
                ids += [doc] * len(said)
                out += said
            pos, surface, freq, names, scores, mask = zip(*out) if out else ((),) * 6
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(pos, pa.int32()), pa.array(surface, pa.string()), pa.array(freq, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(list(scores), lists), pa.array(list(mask), lists)],
                ["doc_id", "pos", "surface", "freq", "names", "scores", "mask"],
            )

    return rows.select("doc_id", "body", "own").mapInArrow(stored.thrifty(run), SCORED.format(dict(rows.dtypes)["doc_id"]))
