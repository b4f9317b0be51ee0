"""Quality rules as a short-circuit cascade, in SQL expressions only.

A base measures every text (words, symbols, repeated lines and word windows) and
fails texts that are too short or too repetitive. What passes goes through a list
of rules. On a sample the cost (seconds a row) and selectivity (share rejected) of
each rule are measured: a rule is evaluated many times over a sample in memory, the
time that the same job takes without a rule is taken off, and the least of several
runs counts, so a job's start-up is no part of a rule's cost. The rules then run in the order of rejection per cost; a
rule is a branch of one CASE, so a text evaluates no rule after its first hit.

The order changes the cost alone: a text is kept if no rule rejects it, whatever
the order, so results do not depend on timings.

The sample has about ``sample_rows`` rows (a documented parameter), drawn at random over
the whole table, so that tables sorted by source or quality are no special case.

Defined results: null text counts as empty (no words: fails the base); null ids
are kept; repeated rows are judged alike; empty tables give no rows; extra columns
are ignored. Long texts are measured whole.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 400
#: How often a rule is evaluated on each sampled row in one run, and the number of runs.
TIMES, RUNS = 20, 3
#: Seconds a row below which a rule counts as free: the resolution of the measurement.
FREE = 1e-7
#: Characters that separate words, and the pattern of their runs.
SEPARATORS, GAP = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _count(text: Column, characters: str) -> Column:
    """How many characters of a text are among the given ones."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _repeat_words() -> Column:
    """Words inside 5-word windows that occur at least twice in the array ``words``.

    Window hashes with a repetition are rare; only then are (hash, position) pairs
    sorted, neighbours of equal hash kept, and the covered words counted.
    """
    twice = """
      sort_array(transform(
        filter(
          transform(sequence(0, size(sorted) - 1), k -> named_struct('p', sorted[k].p, 'r',
            (k > 0 AND sorted[k].h = sorted[greatest(k - 1, 0)].h) OR
            (k < size(sorted) - 1 AND sorted[k].h = sorted[least(k + 1, size(sorted) - 1)].h))),
          x -> x.r),
        x -> x.p))"""
    pairs = "sort_array(transform(hs, (h, p) -> named_struct('h', h, 'p', p)))"
    places = _let(pairs, "sorted", twice)
    covered = f"""aggregate({places}, named_struct('n', 0L, 'to', 0),
        (acc, p) -> named_struct('n', acc.n + {WINDOW} - greatest(0, acc.to - p), 'to', p + {WINDOW}),
        acc -> acc.n)"""
    return F.expr(_let("windows", "hs", f"CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0L ELSE {covered} END"))


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and ``body`` with it under a name.

    Inlining by the optimiser (a filter pushed below a projection) then costs one
    evaluation more, not one for every use inside a lambda.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    base_failed``; text is never null."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", GAP), ""))
    hashed = ", ".join(f"ws[i + {k}]" for k in range(WINDOW))
    each = f"CASE WHEN size(ws) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(ws) - {WINDOW}), i -> xxhash64({hashed})) END"
    windows = _let("words", "ws", each)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0)
    rows = rows.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SEPARATORS, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        lines.alias("lines"),
        F.expr(windows).cast("array<long>").alias("windows"),
    )
    rows = rows.select(
        "doc_id",
        "text",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def default_rules() -> dict[str, Column]:
    """Name -> what rejects a text, over the columns of ``measured``."""
    text, n = F.col("text"), F.col("n_words")
    upper, lower = F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")), F.length(F.regexp_replace(text, r"[^\p{Ll}]", ""))
    lettered = F.size(F.regexp_extract_all(text, F.lit(r"(?:^|(?<=[\x20\x09-\x0D]))[^\x20\x09-\x0D]*?\p{L}"), F.lit(0)))
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") > 15 * n) | (2 * F.col("word_chars") < 5 * n),
        "exclamations": 5 * _count(text, "!") > n,
        "ellipses": 5 * F.size(F.split(text, r"\.\.\.|…")) > n + 5,
        "shouting": upper > lower,
        "few_letters": 10 * lettered < 7 * n,
    }


def measure_rules(sample: DataFrame, rules: Mapping[str, Column], times: int = TIMES, runs: int = RUNS) -> dict[str, tuple[float, float]]:
    """Name -> (seconds a row, share rejected) over a sample, which should be in memory."""
    total = sample.count()
    if not total:
        return dict.fromkeys(rules, (FREE, 0.0))
    again = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def timed(rule: Column) -> tuple[float, int]:
        job = again.agg(F.sum(rule.cast("long")).alias("n"))
        seconds = []
        for _ in range(runs):
            began = time.perf_counter()
            hits = job.first().n
            seconds.append(time.perf_counter() - began)
        return min(seconds), hits or 0

    nothing, _ = timed(F.col("_time") < 0)
    found = {}
    for name, rule in rules.items():
        seconds, hits = timed(rule)
        found[name] = (max(seconds - nothing, 0.0) / (total * times) + FREE, hits / (total * times))
    return found


def cascade_order(figures: Mapping[str, tuple[float, float]]) -> list[str]:
    """Rules by rejection per cost, best first; of equals the cheaper one, then by name."""
    return sorted(figures, key=lambda k: (-figures[k][1] / figures[k][0], figures[k][0], k))


def rejected(rules: Mapping[str, Column], order: Sequence[str]) -> Column:
    """Whether any rule rejects; evaluates none after the first that does."""
    verdict = F.lit(False)
    for name in reversed(order):
        verdict = F.when(rules[name], True).otherwise(verdict)
    return verdict


def judge_quality(documents: DataFrame, rules: Mapping[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept`` for every row of ``documents``."""
    rules = rules or default_rules()
    share = min(1.0, sample_rows / max(documents.count(), 1))
    sample = measured(documents.select("doc_id", "text").sample(share, seed=7).repartition(4)).where(~F.col("base_failed")).cache()
    try:
        order = cascade_order(measure_rules(sample, rules))
    finally:
        sample.unpersist()
    kept = F.when(F.col("base_failed"), False).otherwise(~rejected(rules, order))
    return measured(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ln,
  list_transform(range(1, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) - 3, 1)), lambda i: i) AS ix
  FROM documents),
g AS (SELECT row_number() OVER () AS row_id, t.*, list_transform(ix, lambda i: array_to_string(w[i:i+4], ' ')) AS grams FROM t),
e AS (SELECT row_id, unnest(grams) AS gram, unnest(ix) AS p FROM g),
d AS (SELECT row_id, p FROM (SELECT row_id, p, count(*) OVER (PARTITION BY row_id, gram) AS c FROM e) WHERE c > 1),
c AS (SELECT row_id, count(DISTINCT q) AS n FROM (SELECT row_id, unnest(range(p, p + 5)) AS q FROM d) GROUP BY row_id),
m AS (SELECT doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, w
  FROM g LEFT JOIN c ON g.row_id = c.row_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
    OR word_chars > 15 * n_words OR 2 * word_chars < 5 * n_words
    OR 5 * (length(text) - length(replace(text, '!', ''))) > n_words
    OR 5 * (len(regexp_extract_all(text, '\.\.\.|…')) + 1) > n_words + 5
    OR length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > length(regexp_replace(text, '[^\p{Ll}]', '', 'g'))
    OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words) AS kept
FROM b
"""
