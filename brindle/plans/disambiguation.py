"""Disambiguation end to end: a knowledge base, a model and the linker over both."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context, features, joint, mentions, passage, pem, ranking, results, stored
from ..sources import readers, sinks

#: Settings of a linker; a user's settings are laid over these.
DEFAULTS: dict[str, Any] = {
    "mode": "eval",
    "max_candidates": features.MAX_CANDIDATES,
    "keep_context": ranking.KEEP_CONTEXT,
    "keep_total": ranking.KEEP_TOTAL,
    "context_words": 100,
    "chunk_mentions": 100,
    "ngram_words": 5,
    "coreference": "snapshot",
}


def settings(*overlays: Mapping[str, Any]) -> dict[str, Any]:
    """The defaults under the given settings, later ones on top."""
    out = dict(DEFAULTS)
    for own in overlays:
        out.update(own)
    return out


@dataclass(frozen=True)
class Dimensions:
    """Entity dimensions, read in the order in which they need one another."""

    disambiguation: DataFrame
    redirects: DataFrame
    names: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, base: str) -> Dimensions:
        base = base.rstrip("/")
        ambiguous = readers.disambiguation_pages(spark, f"{base}/disambiguation")
        return cls(ambiguous, readers.redirects(spark, f"{base}/redirects"), readers.name_map(spark, f"{base}/names", ambiguous))


@dataclass(frozen=True)
class KnowledgeBase:
    """The mention index, vectors (``word, emb``) and person names (``name``)."""

    index: DataFrame
    vectors: DataFrame
    persons: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, base: str) -> KnowledgeBase:
        base = base.rstrip("/")
        vectors = features.require_unknown(spark.read.parquet(f"{base}/vectors"))
        return cls(spark.read.parquet(f"{base}/index"), vectors, readers.persons(spark, f"{base}/persons.txt"))

    def unknown_entity(self) -> np.ndarray:
        row = self.vectors.where(F.col("word") == features.UNKNOWN["entity"]).select("emb").first()
        return np.asarray(row.emb, float)


@dataclass(frozen=True)
class Linker:
    """Detection, disambiguation and result shaping over a knowledge base."""

    kb: KnowledgeBase
    parameters: joint.Parameters
    calibration: tuple[float, float] | None = None
    config: dict[str, Any] = field(default_factory=settings)
    persisted: list[DataFrame] = field(default_factory=list, compare=False)

    @classmethod
    def load(cls, spark: SparkSession, kb_base: str, model_path: str, config: Mapping[str, Any] = {}) -> Linker:
        """A linker with a stored model. The stored settings win over the user's, but for
        the model's path; a linker that trains cannot start from a stored model."""
        if config.get("mode") == "train":
            raise ValueError("a stored model is for evaluation; start training from initial parameters")
        parameters, stored = sinks.load_parameters(spark, model_path)
        calibration = stored.pop("calibration", None)
        merged = settings(config, stored, {"model_path": model_path})
        return cls(KnowledgeBase.load(spark, kb_base), parameters, None if calibration is None else tuple(calibration), merged)

    def found_mentions(self, docs: DataFrame) -> DataFrame:
        """Mentions of ``docs`` (doc_id, text) by the n-gram tagger, with contexts and candidates."""
        sents = mentions.sentences(docs)
        found = mentions.ngram_mentions(docs, self.kb.index, self.config["ngram_words"])
        placed = found.join(sents.select("doc_id", "sent_idx", "sentence", "pos_start"), ["doc_id", "sent_idx"])
        placed = placed.withColumns({"start": F.col("pos") - F.col("pos_start"), "end": F.col("pos") - F.col("pos_start") + F.length("surface"), "conf_md": F.col("freq").cast("double")})
        return self._with_context(placed, sents)

    def given_mentions(self, docs: DataFrame) -> DataFrame:
        """Mentions at the given ``spans`` of ``docs`` (doc_id, text, spans)."""
        sents = mentions.sentences(docs)
        spans = docs.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.length").alias("length"))
        placed = mentions.spans_in_sentences(spans, sents)
        at = F.col("start") - F.col("pos_start")
        placed = placed.select("doc_id", "sent_idx", "sentence", F.col("start").alias("pos"), at.alias("start"), (at + F.col("length")).alias("end"))
        placed = placed.withColumn("surface", F.expr("substring(sentence, start + 1, end - start)"))
        spelled = mentions.spelling_lookup(placed, self.kb.index)
        placed = placed.join(spelled, "surface").withColumns({"conf_md": F.lit(None).cast("double"), "tag": F.lit("NULL")})
        return self._with_context(placed, sents)

    def _with_context(self, placed: DataFrame, sents: DataFrame) -> DataFrame:
        listed = mentions.candidate_lists(placed, self.kb.index, pem.TOP, keep_empty=True)
        numbered = listed.withColumn("mention_ord", mentions.place_number("doc_id", "pos", "end"))
        return context.mention_contexts(numbered, sents, self.config["context_words"])

    def _kept(self, frame: DataFrame) -> DataFrame:
        """A frame that several later steps read: persisted (on executors, spilling to their
        disks; a lost part is computed again) until ``release``."""
        self.persisted.append(frame.persist(StorageLevel.MEMORY_AND_DISK))
        return frame

    def _written(self, frame: DataFrame, label: str) -> DataFrame:
        """A table of spellings or chunks that several later steps read, on shared storage."""
        self.persisted.append(stored.written(frame, label))
        return self.persisted[-1]

    def release(self) -> None:
        while self.persisted:
            self.persisted.pop().unpersist()

    def predict(self, found: DataFrame, slim: DataFrame | None = None) -> DataFrame:
        """``doc_id, mention_ord, entity, conf_ed, names, scores`` of mentions with contexts
        and candidates: coreference, features, joint scores, decision. ``slim`` has the
        mentions without contexts where they are kept."""
        rows = context.document_chunks(self._coreferent(found if slim is None else slim), self.config["chunk_mentions"])
        if slim is not None:
            rows = found.drop("cands").join(rows.select("doc_id", "mention_ord", "chunk", "cands"), ["doc_id", "mention_ord"])
        both = joint.scored_mentions(rows, self.kb.vectors, self.parameters, self.kb.unknown_entity(), self.config["keep_context"], self.config["keep_total"])
        entity = ranking.decode(F.col("names"), F.col("mask"), F.col("scores"))
        sure = F.lit(0.0) if self.calibration is None else ranking.confidence(F.array_max("scores"), *self.calibration)
        return both.select("doc_id", "mention_ord", entity.alias("entity"), sure.alias("conf_ed"), "names", F.slice("scores", 1, F.size("names")).alias("scores"))

    def _coreferent(self, found: DataFrame) -> DataFrame:
        way = self.config["coreference"]
        if way == "none":
            return found
        key = ["doc_id", "mention_ord"]
        named = found.withColumn("mention", F.col("surface"))
        if way == "exact":
            persons = {r[0] for r in self.kb.persons.collect()}
            new = context.coreference_fold(named.select(*key, "mention", "cands"), persons).select(*key, F.col("cands").alias("_cands"))
        else:
            each = context.coreferent_candidates(named, self.kb.persons)
            new = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("q"), "entity"))).alias("c"))
            new = new.select(*key, F.transform("c", lambda x: F.struct(x["entity"].alias("entity"), (-x["q"]).alias("p"))).alias("_cands"))
        return found.join(new, key, "left").withColumn("cands", F.coalesce("_cands", "cands")).drop("_cands")

    def results(self, found: DataFrame) -> DataFrame:
        """Result rows of mentions; those that end as ``NIL`` are left out. Contexts, the bulk
        of a mention, are not kept: they are made once, on the way to the scores."""
        slim = self._kept(found.select("doc_id", "mention_ord", "pos", "surface", "cands", "conf_md", "tag"))
        return results.shape_results(slim.withColumn("ngram", F.col("surface")), self.predict(found, slim).select("doc_id", "mention_ord", "entity", "conf_ed"))

    def scored_passages(self, docs: DataFrame) -> DataFrame:
        """``doc_id, pos, surface, freq, names, scores, mask``: what ``predict`` says of the
        ``found_mentions`` of ``docs`` (doc_id, text), made document by document, so that no
        mention's contexts, candidates or vectors are shuffled. Not for exact coreference."""
        docs = stored.small_batches(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()))
        send = docs.sparkSession.sparkContext.broadcast
        spelled = mentions.SpellingFilter.of(self.kb.index)
        n = min(self.config["ngram_words"], max(spelled.words, 1))
        known = self._written(passage.spellings(mentions.ngrams(mentions.sentences(docs), n, spelled), self.kb.index, self.kb.persons), "spellings")
        dim = len(self.parameters["attention"])
        places, matrix, unknown = passage.frequent_words(docs, known, self.kb.vectors, dim, joint.VECTOR_BYTES)
        passes, frequent = send(spelled), send(passage.frequent_spellings(known))
        scorer = send(passage.Scorer(self.parameters, places, matrix, unknown, self.config))
        asked = passage.rare_spellings(docs, n, passes, frequent)
        own = asked.join(known, "surface").groupBy("doc_id").agg(F.collect_list(F.struct("surface", *passage.SPELLING)).alias("own"))
        rows = self._written(passage.chunks(docs.join(own, "doc_id", "left"), n, passes, frequent, scorer, self.config), "chunks")
        rare = features.packed(self.kb.vectors, lambda w: w not in scorer.value.places)
        words = rows.select("doc_id", "chunk", F.explode("rare").alias("word")).join(rare, "word")
        words = words.groupBy("doc_id", "chunk").agg(F.collect_list(F.struct("word", "emb")).alias("own"))
        return passage.scored(rows.drop("rare").join(words, ["doc_id", "chunk"], "left"), scorer)

    def linked(self, docs: DataFrame) -> DataFrame:
        """Result rows of ``docs`` (doc_id, text) by the n-gram tagger: those of ``results`` over
        ``found_mentions``. The exact coreference goes the long way."""
        if self.config["coreference"] == "exact":
            return self.results(self.found_mentions(docs))
        said = self.scored_passages(docs)
        sure = F.lit(0.0) if self.calibration is None else ranking.confidence(F.array_max("scores"), *self.calibration)
        decided = said.withColumn("entity", ranking.decode(F.col("names"), F.col("mask"), F.col("scores"))).where("entity <> 'NIL'")
        return decided.select(
            "doc_id", F.col("pos").alias("start"), F.length("surface").alias("length"), F.col("surface").alias("ngram"),
            "entity", sure.alias("conf_ed"), F.col("freq").cast("double").alias("conf_md"), F.lit("#NGRAM#").alias("tag"),
        )

    def answer(self, docs: DataFrame) -> DataFrame:
        """``doc_id, body``: JSON responses for ``docs`` (doc_id, text, spans); documents with
        spans are disambiguated there, others are searched."""
        free, given = docs.where(F.size("spans") == 0), docs.where(F.size("spans") > 0)
        rows = self.linked(free).unionByName(self.results(self.given_mentions(given)))
        return docs.select("doc_id").join(results.response(rows), "doc_id", "left").select("doc_id", F.coalesce("body", F.lit("[]")).alias("body"))

    def evaluate(self, gold: DataFrame) -> DataFrame:
        """Micro scores by ``dataset`` of gold mentions with contexts and candidates; gold and
        predictions meet by document and place."""
        said = self.predict(gold).select("doc_id", "mention_ord", F.col("entity").alias("pred"))
        both = gold.select("dataset", "doc_id", "mention_ord", "gold").join(said, ["doc_id", "mention_ord"], "left")
        return results.micro_scores(both.select("dataset", "gold", F.coalesce("pred", F.lit("NIL")).alias("pred")), ["dataset"])

    def training_rows(self, gold: DataFrame) -> DataFrame:
        """Features of gold mentions whose right entity is among the kept candidates."""
        rows = context.document_chunks(features.gold_into_candidates(gold, self.config["max_candidates"]), self.config["chunk_mentions"])
        inputs = features.mention_features(rows, self.kb.vectors, self.config["keep_context"], self.config["keep_total"])
        return features.with_gold(inputs, gold)

    def train(self, gold: DataFrame, development: DataFrame, schedule: joint.Schedule = joint.Schedule()) -> tuple[Linker, float]:
        """A linker with trained parameters and its best F1 on the development mentions."""
        rows = self.training_rows(gold).cache()
        try:
            def f1(parameters: joint.Parameters) -> float:
                linker = Linker(self.kb, parameters, None, self.config)
                own = linker.evaluate(development.withColumn("dataset", F.lit("dev"))).first()
                linker.release()
                return 0.0 if own is None or own.f1 is None else float(own.f1)

            parameters, best, _ = joint.train(rows, self.parameters, self.kb.unknown_entity(), f1, schedule, self.config["keep_total"])
        finally:
            rows.unpersist()
        return Linker(self.kb, parameters, self.calibration, self.config), best

    def calibration_rows(self, gold: DataFrame) -> DataFrame:
        """``score, label``: each real candidate's score and whether it is right."""
        said = self.predict(gold).select("doc_id", "mention_ord", F.explode(F.arrays_zip("names", "scores")).alias("c"))
        named = said.join(gold.select("doc_id", "mention_ord", "gold"), ["doc_id", "mention_ord"])
        return named.where(F.col("c.names") != features.PAD).select(F.col("c.scores").alias("score"), (F.col("c.names") == F.col("gold")).cast("int").alias("label"))

    def calibrated(self, gold: DataFrame) -> Linker:
        return Linker(self.kb, self.parameters, ranking.fit_calibration(self.calibration_rows(gold)), self.config)

    def save(self, spark: SparkSession, path: str) -> None:
        sinks.save_parameters(spark, self.parameters, self.config | {"calibration": self.calibration}, path)
