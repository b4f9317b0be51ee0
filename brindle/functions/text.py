"""Scalar text functions as Catalyst expressions (pandas UDFs only where noted)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default function words for ``important``; any other list may be passed.
STOPWORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can "
    "could did do does doing down during each either else ever few for from further had has have having he her here hers him "
    "himself his how however i if in into is it its itself just me more most much must my myself neither no nor not now of off "
    "on once only or other our ours out over own rather same she should since so some such than that the their theirs them then "
    "there these they this those through to too under until up upon very was we were what when where which while who whom whose "
    "why will with within without would yet you your yours yourself"
).split()

#: The characters that count as noise at the edges of a mention.
NOISE = "(.|,!'"
#: Latin letters and the plain letters they are written with in ASCII.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"
#: Bracket codes of tokenised corpora.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def first_upper(s: Column) -> Column:
    """First character to upper case; empty strings stay."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2_147_483_647))


def first_lower(s: Column) -> Column:
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 2_147_483_647))


def percent_decode(s: Column) -> Column:
    """Lenient percent-decoding: ``+`` stays, malformed escapes stay as they are."""
    guarded = F.regexp_replace(F.regexp_replace(s, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(guarded), s)


def normalise_entity(s: Column) -> Column:
    """Trim, decode ``&amp;`` and ``&quot;``, underscores to spaces, first letter up."""
    t = F.replace(F.replace(F.replace(F.trim(s), F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"')), F.lit("_"), F.lit(" "))
    return first_upper(t)


def entity_key(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit("_"))


def strip_noise(s: Column) -> Column:
    return F.trim(F.translate(s, NOISE, ""))


def title_case(s: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere: apostrophes and hyphens
    split words too, unlike ``initcap``."""
    parts = F.split(s, r"(?<=\P{L})(?=\p{L})|(?<=\p{L})(?=\P{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2_147_483_647)))), "")


def title_if_upper(s: Column) -> Column:
    return F.when(s == F.upper(s), title_case(s)).otherwise(s)


def to_ascii(s: Column) -> Column:
    """Latin letters without their marks; sharp s becomes ss, other characters stay."""
    return F.replace(F.translate(s, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def ascii_words(s: Column) -> Column:
    """Word runs without accents."""
    return F.transform(word_tokens(s), to_ascii)


def ascii_tokens(s: Column) -> Column:
    """White-space tokens without accents."""
    return F.transform(space_tokens(s), to_ascii)


def word_tokens(s: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def space_tokens(s: Column) -> Column:
    """White-space tokens; an empty array for blank text."""
    return F.array_remove(F.split(F.trim(s), r"\s+"), "")


def tokens_with_separators(s: Column) -> Column:
    """Word runs and each single non-word character; lone spaces and empty strings removed."""
    parts = F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"), F.lit(0))
    return F.filter(parts, lambda x: x != " ")


def is_number(s: Column) -> Column:
    """What parses as a float, digit groups by underscores and nan/inf included."""
    return F.lower(s).rlike(r"^\s*[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|nan|inf(?:inity)?)\s*$")


def is_important(s: Column, stopwords: list[str] | None = None) -> Column:
    """Longer than one character, no function word, no number."""
    listed = F.lower(s).isin(*(STOPWORDS if stopwords is None else stopwords))
    return (F.length(s) > 1) & ~listed & ~is_number(s)


def bracket_token(s: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in BRACKETS.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, s), s)


def is_punctuation(s: Column) -> Column:
    return s.rlike(r"^(?:_|[^\p{L}\p{N}_])+$")


def strip_scheme_wikt(s: Column) -> Column:
    return F.regexp_replace(s, "^wikt:", "")


def title_from_url(s: Column) -> Column:
    return F.replace(F.substring_index(s, "/wiki/", -1), F.lit("_"), F.lit(" "))


def word_count(s: Column) -> Column:
    return F.size(space_tokens(s))


def clean_label(s: Column) -> Column:
    """Tidy extracted text: no-break spaces, guillemets, space and dot runs, orphaned commas."""
    for pattern, to in (
        (" ", " "), ("<<", "«"), (">>", "»"), (r"\t", " "), (r" {2,}", " "), (r"\.{4,}", "..."),
        (r" ([,:.)\]»])", "$1"), (r"([\[(«]) ", "$1"), (r"(?m)^\W+$\n?", ""), (",,", ","), (r",\.", "."),
    ):
        s = F.regexp_replace(s, pattern, to)
    return s


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def tail(array: Column, n: int) -> Column:
    """The last ``n`` elements, all where there are fewer."""
    return F.slice(array, F.greatest(F.lit(1), F.size(array) - (n - 1)), n)


#: Elements summed in one fold; a growing array is copied each time, so long lists go group by group.
GROUP = 64


def exclusive_sums(sizes: Column) -> Column:
    """``array<long>``: the sum of all elements before each one. Linear: sums inside groups
    of ``GROUP`` elements, then the groups one after another."""
    empty = F.array().cast("array<bigint>")

    def grown(acc: Column, size: Column, more: Column) -> Column:
        return F.struct((acc["at"] + size).alias("at"), more.alias("out"))

    def inside(group: Column) -> Column:
        return F.aggregate(group, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), lambda acc, x: grown(acc, x.cast("long"), F.array_append(acc["out"], acc["at"])))

    def across(groups: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
        moved = lambda acc, g: F.array_append(acc["out"], F.transform(g["out"], lambda x: x + acc["at"]))
        return F.flatten(F.aggregate(groups, start, lambda acc, g: grown(acc, g["at"], moved(acc, g)), lambda acc: acc["out"]))

    numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / GROUP).cast("int"))
    return F.when(F.size(sizes) == 0, empty).otherwise(across(F.transform(numbers, lambda g: inside(F.slice(sizes, g * GROUP + 1, F.lit(GROUP))))))


def named(value: Column, body) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def flattened(lists: Column) -> tuple[Column, Column]:
    """All elements of a list of lists, and where each list begins."""
    return F.flatten(lists), exclusive_sums(F.transform(lists, F.size))


def pad_right(array: Column, n: int, filler: Column) -> Column:
    cut = F.slice(array, 1, n)
    return F.concat(cut, F.array_repeat(filler, n - F.size(cut)))


def pad_left(array: Column, n: int, filler: Column) -> Column:
    cut = tail(array, n)
    return F.concat(F.array_repeat(filler, n - F.size(cut)), cut)


def pad_mask_left(array: Column, n: int) -> Column:
    kept = F.least(F.size(array), F.lit(n))
    return F.concat(F.array_repeat(F.lit(0.0), n - kept), F.array_repeat(F.lit(1.0), kept))


def pad_mask(array: Column, n: int) -> Column:
    """1.0 for every element kept, 0.0 for padding."""
    kept = F.least(F.size(array), F.lit(n))
    return F.concat(F.array_repeat(F.lit(1.0), kept), F.array_repeat(F.lit(0.0), n - kept))


def unescape_unicode(s: Column) -> Column:
    r"""``\uXXXX`` escapes decoded, surrogate pairs joined: a run of escapes is UTF-16."""
    run = r"(?:\\u[0-9a-fA-F]{4})+"

    def decoded(found: Column) -> Column:
        return F.decode(F.unhex(F.replace(found, F.lit("\\u"), F.lit(""))), "UTF-16BE")

    hits = F.transform(F.regexp_extract_all(s, F.lit(run), F.lit(0)), decoded)
    parts = F.split(s, run, -1)
    whole = F.array_join(F.flatten(F.zip_with(parts, hits, lambda p, h: F.array(p, F.coalesce(h, F.lit(""))))), "")
    return F.when(F.instr(s, "\\u") > 0, whole).otherwise(s)


@F.pandas_udf(T.StringType())
def unescape_markup(s: pd.Series) -> pd.Series:
    """Named, decimal and hexadecimal character references decoded."""
    return s.map(lambda x: None if x is None else html.unescape(x))
