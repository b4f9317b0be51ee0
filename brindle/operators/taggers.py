"""Pluggable mention taggers as Python table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "text string, start_pos int, end_pos int, score double, tag string"


def tagger(predict: Callable[[str], Iterable[tuple[str, int, int, float, str]]]):
    """A table function of ``sentence`` that yields a tagger's spans."""

    class Tagger:
        def eval(self, sentence: str):
            yield from predict(sentence or "")

    return F.udtf(Tagger, returnType=SPAN)


def tag_sentences(sents: DataFrame, predict: Callable[[str], Iterable[tuple[str, int, int, float, str]]]) -> DataFrame:
    """``sents`` joined laterally with the tagger's spans; positions are sentence offsets."""
    spark = sents.sparkSession
    spark.udtf.register("_tag_sentence", tagger(predict))
    return spark.sql("SELECT s.*, t.* FROM {sents} s, LATERAL _tag_sentence(s.sentence) t", sents=sents)
