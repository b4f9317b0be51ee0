"""Personal data: validated base patterns, and secrets chosen by boosted trees.

Everything is a DataFrame or SQL expression. A pattern's spans come from splitting
the text by it: the lengths of the parts between and of the matches themselves
give code-point offsets.

Base kinds (email, ip, card, phone) are fixed patterns with checks of their matches.

The method adds ``secret`` spans (keys, tokens, passwords), ``iban`` spans (account
numbers) and ``address`` spans (spelled-out addresses). High-recall generators propose
overlapping spans; each gets features of its format (shares of digits, cases and vowels,
changes between kinds of characters, the longest run of digits, the generator) and its
context (quotes, the mark and the word before it, letters around it). Gradient-boosted
trees score them. There are no labels for this in the corpus, so a strict teacher labels
all candidates: known key formats, assignments to credential words, the check digits of
account numbers, bracketed spellings. What the teacher looks at - formats by name, the
credential word, the assignment, length, variety of characters, check digits - is no
feature, so the trees have to learn other traits of the same spans and find spans that
look alike beyond the teacher's rules. The trees are fitted to a bounded sample
(``sample_rows``, a documented parameter): each class has half as many buckets, and a
bucket gives its candidate of the least hash, so the sample does not depend on where
candidates stand. The threshold is the lowest score at which the precision against the
teacher, over all candidates of the table, is at least ``precision``. The trees become
one nested CASE expression that scores candidates where they are, without a shuffle.
A candidate is selected by the trees or by the teacher. Selected spans that overlap a
base span or an earlier selected one are dropped; base spans stay.

Defined results: null and empty texts have no spans; null ids are kept; repeated
rows are judged alike; without candidates that the teacher knows the method adds nothing;
empty tables give no rows; extra columns are ignored or, in ``redact``, kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import relieve, written

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "address")
SAMPLE_ROWS = 4000
PRECISION = 0.99

#: The base patterns, with possessive repeats and start conditions that
#: change no match but keep the search linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9]){12,}+"  # shorter runs of digits fail the length check anyway
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Credential words, and the generators of secret candidates.
CREDENTIAL = r"(?:password|passwd|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|auth|bearer|credential)"
ASSIGNED = rf"(?i){CREDENTIAL}\s{{0,3}}[=:]\s{{0,3}}[\"']?[^\s\"']{{6,}}"
HEXADECIMAL = r"(?<![0-9A-Za-z])[0-9a-f]{16,}+(?![0-9A-Za-z])"
CODE = r"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])[0-9A-Za-z]{12,}+"
DOTTED = r"(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+(?:\.[0-9A-Za-z_-]{8,}+)?"
KNOWN_KEY = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^sk[-_][0-9A-Za-z]{20,}$|^eyJ[0-9A-Za-z_-]+\.eyJ"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}+(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
ADDRESS = r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{2,}+ ?[\[({ ]at[\])} ] ?[0-9A-Za-z-]{2,}+(?: ?[\[({ ]dot[\])} ] ?[0-9A-Za-z-]{2,}+)++"
BRACKETED = r"[\[({]at[\])}].*[\[({]dot[\])}]"

#: What the trees see of a candidate; the teacher sees none of it.
FEATURES = ("generator", "digits", "upper", "lower", "vowels", "marks", "changes", "longest_digits", "first_digit", "quoted", "mark_before", "word_before", "letters_before", "letters_after")
GENERATORS = ("assigned", "hexadecimal", "code", "dotted", "iban", "address")
#: Rows a leaf needs: the few spans that the teacher overlooks are not split off from those it knows.
LEAF_ROWS = 20
#: Matches placed in one fold; longer lists are placed group by group, so the cost stays linear.
GROUP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


Found = "array<struct<start:int,end:int,found:string,before:string,after:string>>"
#: Code points of context before and after a match, at most, and not past the next match.
BEFORE, AFTER = 24, 8


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, found, before, after>>`` of a pattern's matches, in order.

    Places are sums of lengths. An array that grows by one is copied each time, so the
    matches are placed in groups of ``GROUP``, and the groups one after another.
    """

    def cells(found: Column, parts: Column) -> Column:
        return F.transform(
            found,
            lambda hit, k: let(
                F.get(parts, k),
                lambda part: F.struct(
                    F.length(part).alias("gap"),
                    F.length(hit).alias("size"),
                    hit.alias("found"),
                    F.right(part, F.lit(BEFORE)).alias("before"),
                    F.left(F.get(parts, k + 1), F.lit(AFTER)).alias("after"),
                ),
            ),
        )

    def placed(own: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast(Found).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["found"].alias("found"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct((start + x["size"]).alias("at"), F.array_append(acc["out"], span).alias("out"))

        return F.aggregate(own, first, step)

    def shifted(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["found"], x["before"], x["after"]))

    def joined_groups(groups: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{Found}>").alias("out"))

        def step(acc: Column, g: Column) -> Column:
            return F.struct((acc["at"] + g["at"]).alias("at"), F.array_append(acc["out"], shifted(g["out"], acc["at"]).cast(Found)).alias("out"))

        return F.flatten(F.aggregate(groups, first, step, lambda acc: acc["out"]))

    def located(found: Column) -> Column:
        def in_groups(all_cells: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.floor((F.size(all_cells) - 1) / GROUP).cast("int"))
            return joined_groups(F.transform(numbers, lambda g: placed(F.slice(all_cells, g * GROUP + 1, F.lit(GROUP)))))

        several = let(let(F.split(text, pattern, -1), lambda parts: cells(found, parts)), in_groups)
        return F.when(F.size(found) == 0, F.array().cast(Found)).otherwise(several)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c, k: c.cast("int") * (1 + k % 2))
    total = F.aggregate(figures, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0))
    return total % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> ``array<struct<start, end, found>>`` of the valid base spans."""
    none = F.array().cast(Found)
    digits = text.rlike("[0-9]")

    def when(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(none)

    def is_card(x: Column) -> Column:
        return let(F.translate(x["found"], " -", ""), lambda d: F.length(d).between(13, 19) & luhn(d))

    def is_phone(x: Column) -> Column:
        return F.length(F.regexp_replace(x["found"], "[^0-9]", "")).between(9, 15)

    return {
        "email": when(F.instr(text, "@") > 0, matches(text, EMAIL)),
        "ip": when(digits, F.filter(matches(text, IP), lambda x: x["found"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))),
        "card": when(digits, F.filter(matches(text, CARD), is_card)),
        "phone": when(digits & (F.instr(text, "+") > 0), F.filter(matches(text, PHONE), is_phone)),
    }


def iban_valid(found: Column) -> Column:
    """Whether the check digits of an account number are right."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    figures = F.transform(turned, lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(figures, F.lit(0), lambda acc, x: F.when(x > 9, acc * 100 + x).otherwise(acc * 10 + x) % 97)
    return (F.length(plain) >= 15) & (rest == 1)


def candidates(text: Column) -> Column:
    """``array<struct<start, end, found, kind, credential, assigned, features...>>`` of
    possible personal data beyond the base kinds, overlaps included."""
    value = r"[=:]\s{0,3}[\"']?([^\s\"']{6,})$"

    def value_only(x: Column) -> Column:
        return let(
            F.regexp_extract(x["found"], value, 1),
            lambda v: F.struct(
                (x["end"] - F.length(v)).alias("start"),
                x["end"].alias("end"),
                v.alias("found"),
                F.right(F.left(x["found"], F.length(x["found"]) - F.length(v)), F.lit(BEFORE)).alias("before"),
                x["after"],
            ),
        )

    def share(x: Column, other: str) -> Column:
        return F.length(F.regexp_replace(x["found"], other, "")) / F.length(x["found"])

    def described(x: Column, generator: int) -> Column:
        kind = {"iban": "iban", "address": "address"}.get(GENERATORS[generator], "secret")
        before, found = x["before"], x["found"]
        shape = F.regexp_replace(F.regexp_replace(found, "[0-9]+", "9"), "[A-Za-z]+", "a")
        values = (
            F.lit(float(generator)),
            share(x, "[^0-9]"),
            share(x, "[^A-Z]"),
            share(x, "[^a-z]"),
            share(x, "(?i)[^aeiou]"),
            share(x, "[0-9A-Za-z]"),
            F.length(shape) / F.length(found),
            F.array_max(F.transform(F.split(found, "[^0-9]+"), F.length)) / F.length(found),
            found.rlike("^[0-9]").cast("double"),
            (before.rlike("[\"'`]$") & x["after"].rlike("^[\"'`]")).cast("double"),
            F.coalesce(F.ascii(F.right(F.regexp_replace(before, r"[\s\"'`]+$", ""), F.lit(1))), F.lit(0)).cast("double"),
            F.pmod(F.xxhash64(F.lower(F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1))), F.lit(61)).cast("double"),
            F.length(F.regexp_replace(before, r"\P{L}", "")).cast("double"),
            F.length(F.regexp_replace(x["after"], r"\P{L}", "")).cast("double"),
        )
        return F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            found.alias("found"),
            F.lit(kind).alias("kind"),
            before.rlike(rf"(?i){CREDENTIAL}\W{{0,8}}$").alias("credential"),
            before.rlike(r"[=:]\s{0,3}[\"']?$").alias("assigned"),
            *[v.alias(f) for f, v in zip(FEATURES, values)],
        )

    def of(generator: int, spans: Column, when: Column) -> Column:
        kept = F.filter(spans, lambda x: x["end"] > x["start"])
        return F.when(when, F.transform(kept, lambda x: described(x, generator))).otherwise(F.array().cast(kind))

    kind = "array<struct<start:int,end:int,found:string,kind:string,credential:boolean,assigned:boolean," + ",".join(f"{f}:double" for f in FEATURES) + ">>"
    digits = text.rlike("[0-9]")
    return F.concat(
        of(0, F.transform(matches(text, ASSIGNED), value_only), text.rlike(rf"(?i){CREDENTIAL}\s{{0,3}}[=:]")),
        of(1, matches(text, HEXADECIMAL), digits),
        of(2, matches(text, CODE), digits),
        of(3, matches(text, DOTTED), F.instr(text, "eyJ") > 0),
        of(4, matches(text, IBAN), digits),
        of(5, matches(text, ADDRESS), text.rlike(r"[\[({ ]dot[\])} ]")),
    )


Score = Callable[[Column], Column]


def tree_score(lines: list[str]) -> Score:
    """One tree of a model's debug string, as nested CASE over a candidate's features."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        value = float(line.split(":")[1])
        return lambda c: F.lit(value)
    m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    if m is None:
        raise ValueError(f"unknown node: {line}")
    low = tree_score(lines)
    lines.pop(0)  # the Else line
    high = tree_score(lines)
    feature, bound = FEATURES[int(m[1])], float(m[2])
    return lambda c: F.when(c[feature] <= bound, low(c)).otherwise(high(c))


def model_score(description: str, weights: list[float]) -> Score:
    """The boosted trees' probability of a candidate."""
    parts = re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", description)[1:]
    trees = [tree_score([x for x in p.splitlines() if x.strip()]) for p in parts]

    def score(c: Column) -> Column:
        margin = F.lit(0.0)
        for weight, tree in zip(weights, trees):
            margin = margin + weight * tree(c)
        return 1 / (1 + F.exp(-2 * margin))

    return score


def taught(c: Column) -> Column:
    """The teacher's verdict on a candidate."""
    varied = let(F.split(c["found"], ""), lambda chars: F.size(F.array_distinct(chars)) >= 0.3 * F.size(chars))
    secret = c["found"].rlike(KNOWN_KEY) | (c["credential"] & c["assigned"] & (F.length(c["found"]) >= 8) & varied)
    return F.when(c["kind"] == "iban", iban_valid(c["found"])).when(c["kind"] == "address", c["found"].rlike(BRACKETED)).otherwise(secret)


def proposed(documents: DataFrame) -> DataFrame:
    """``label, order`` (a hash) and the features of every candidate of a table."""
    each = documents.select(F.explode(candidates(F.coalesce("text", F.lit("")))).alias("c"))
    return each.select(taught(F.col("c")).cast("int").alias("label"), F.xxhash64("c.found", "c.start", "c.generator").alias("order"), *[F.col(f"c.{f}").alias(f) for f in FEATURES])


def draw(proposals: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` candidates' features and ``label``, half of each class."""
    bucket = F.pmod(F.xxhash64("order"), F.lit(max(sample_rows // 2, 1)))
    rows = proposals.select(F.col("label").cast("double").alias("label"), bucket.alias("bucket"), F.struct("order", *FEATURES).alias("x"))
    return rows.groupBy("label", "bucket").agg(F.min("x").alias("x")).select("label", *[F.col(f"x.{f}").alias(f) for f in FEATURES])


def teach(proposals: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION, rounds: int = 8, depth: int = 4) -> tuple[Score, float] | None:
    """Score and threshold, or None where a class is missing or no score is precise.

    ``proposals`` as from ``proposed``.
    """
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(draw(proposals, sample_rows)).select("features", "label").cache()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7, maxBins=64, minInstancesPerNode=LEAF_ROWS).fit(rows)
    finally:
        rows.unpersist()
    score = model_score(model.toDebugString, list(model.treeWeights))
    scored = proposals.select(F.round(score(F.struct(*FEATURES)), 3).alias("score"), F.col("label").cast("long").alias("label"))
    at = scored.groupBy("score").agg(F.sum("label").alias("right"), F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    relieve(proposals.sparkSession)
    right = n = 0
    threshold = None
    for row in at:  # one row a distinct score: at most the 1001 roundings
        right, n = right + row["right"], n + row["n"]
        if right / n >= precision:
            threshold = row.score
    if threshold is None:
        return None
    return score, max(threshold - 0.0005, 0.5)


def numbered(kind: int, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def counted() -> list[Column]:
    """The number of base spans of each kind."""

    def count(k: int) -> Column:
        return F.size(F.filter("_base", lambda x: x["kind"] == k)).cast("long")

    return [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]


def with_spans(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> DataFrame:
    """``documents`` and ``_base`` (kind number, start, end) and ``_all`` spans, both
    ordered by kind as listed, then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    learnt = teach(written(proposed(documents), "proposals"), sample_rows, precision)

    base = F.concat(*[numbered(k, spans) for k, spans in enumerate(base_spans(text).values())])
    rows = documents.withColumn("_base", base)
    chosen = F.filter(candidates(text), taught)
    if learnt is not None:
        score, threshold = learnt
        chosen = F.filter(candidates(text), lambda c: taught(c) | (score(c) >= threshold))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.sort_array(
        F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("end"), F.array_position(names, c["kind"]).cast("int").alias("kind")))
    )
    kept = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("to"), F.array().cast("array<struct<kind:int,start:int,end:int>>").alias("out")),
        lambda acc, x: F.when(
            (x["start"] < acc["to"]) | F.exists("_base", lambda b: (b["start"] < -x["end"]) & (b["end"] > x["start"])), acc
        ).otherwise(
            F.struct(
                (-x["end"]).alias("to"),
                F.array_append(acc["out"], F.struct((x["kind"] - 1).alias("kind"), x["start"].alias("start"), (-x["end"]).alias("end"))).alias("out"),
            )
        ),
        lambda acc: F.sort_array(acc["out"]),
    )
    return rows.withColumn("_all", F.concat("_base", kept))


def joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def find_personal_data(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, ``base_sha256`` of the joined
    base spans, and ``spans``, all spans joined as ``kind:start:end``."""
    rows = with_spans(documents.select("doc_id", "text"), sample_rows, precision)
    return rows.select("doc_id", *counted(), F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_all").alias("spans"))


def base_personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, and ``base_sha256``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", F.concat(*[numbered(k, spans) for k, spans in enumerate(base_spans(F.col("text")).values())]).alias("_base"))
    return rows.select("doc_id", *counted(), F.sha2(joined("_base"), 256).alias("base_sha256"))


def redact(documents: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> DataFrame:
    """``documents``, all columns, with every span replaced by ``<KIND>``.

    Overlapping spans become one, named by the first. ``n_chars``, where there is
    such a column, follows the changed texts.
    """
    names = documents.columns
    inner = {c: f"_c{k}" for k, c in enumerate(names) if c != "text"}
    rows = with_spans(documents.select(*[F.col(f"`{c}`").alias(inner.get(c, c)) for c in names]), sample_rows, precision)
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.sort_array(F.transform("_all", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    text = F.col("text")
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("to"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.when(x["start"] < acc["to"], F.struct(F.greatest(acc["to"], -x["end"]).alias("to"), acc["out"].alias("out"))).otherwise(
            F.struct(
                (-x["end"]).alias("to"),
                F.concat(acc["out"], F.array(F.substring(text, acc["to"] + 1, x["start"] - acc["to"]), F.get(tags, x["kind"]))).alias("out"),
            )
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["to"] + 1, F.length(text))),
    )
    changed = F.size("_all") > 0
    out = rows.select(*rows.columns, F.when(changed, done).otherwise(text).alias("_text"), changed.alias("_changed"))
    plain = {"text": F.col("_text")}
    if "n_chars" in inner:
        kind = dict(documents.dtypes)["n_chars"]
        plain["n_chars"] = F.when(F.col("_changed"), F.length("_text").cast(kind)).otherwise(F.col(inner["n_chars"]))
    return out.select(*[plain.get(c, F.col(inner.get(c, c))).alias(c) for c in names])


def _spans_sql(kind: str, pattern: str, valid: str) -> str:
    """DuckDB SQL of one kind's spans: ``{kind}`` lists ``kind:start:end`` of the valid matches."""
    start = "list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0)"
    return f"""{kind} AS (SELECT row_id, list_transform(list_filter(range(1, len(f) + 1), lambda i: {valid}),
  lambda i: '{kind}:' || CAST(CAST({start} AS BIGINT) AS VARCHAR) || ':' || CAST(CAST({start} + length(f[i]) AS BIGINT) AS VARCHAR)) AS spans
  FROM (SELECT row_id, regexp_extract_all(text, '{pattern}') AS f, string_split_regex(text, '{pattern}') AS s FROM t))"""


_DIGITS = "regexp_replace(f[i], '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse({_DIGITS})[k] AS INTEGER)
  ELSE CAST(reverse({_DIGITS})[k] AS INTEGER) * 2 - CASE WHEN CAST(reverse({_DIGITS})[k] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""

BASE_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
{_spans_sql("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true")},
{_spans_sql("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(f[i], '.'), lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST(x AS INTEGER) > 255)) = 0")},
{_spans_sql("card", "[0-9]([ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}")},
{_spans_sql("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15")}
SELECT doc_id, CAST(len(email.spans) AS BIGINT) AS n_email, CAST(len(ip.spans) AS BIGINT) AS n_ip, CAST(len(card.spans) AS BIGINT) AS n_card, CAST(len(phone.spans) AS BIGINT) AS n_phone,
  sha256(array_to_string(email.spans || ip.spans || card.spans || phone.spans, ',')) AS base_sha256
FROM t JOIN email USING (row_id) JOIN ip USING (row_id) JOIN card USING (row_id) JOIN phone USING (row_id)
"""
