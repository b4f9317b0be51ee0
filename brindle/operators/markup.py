"""Wikitext to plain text, in one vectorised function, and page filters."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wikitext

DISAMBIGUATION = r"(?m)^(?:\{\{disambig(?:uation)?(?:\|[^}]*)?\}\}|__DISAMBIG__)"
#: Names of elements that the dump format's extractors discard with what they
#: hold, by what they are for; and prefixes of links that count as text.
DROPPED = (
    "table caption tr th td",
    "ul ol li dl dt dd menu dir",
    "form input select option textarea",
    "ref references sup sub small indicator",
    "gallery img imagemap timeline source",
    "div pre noinclude",
)
KEPT_NAMESPACES = ("w", "wiktionary", "wikt")
IMAGE = re.compile(r"(?:https?|ftp)://\S+\.(?:gif|png|jpe?g|svg|webp)", re.I)


def page_counters(pages: DataFrame) -> DataFrame:
    """One row: all pages, articles (ns 0), redirects, disambiguation pages, used articles."""
    article = F.col("ns") == "0"
    ambiguous = article & F.col("text").rlike(DISAMBIGUATION)
    return pages.agg(
        F.count("*").alias("n_pages"),
        F.count_if(article).alias("n_articles"),
        F.count_if(F.col("is_redirect")).alias("n_redirects"),
        F.count_if(ambiguous).alias("n_disambiguation"),
        F.count_if(article & ~ambiguous & ~F.col("is_redirect")).alias("n_used"),
    )


def long_enough(text: Column, least: int) -> Column:
    """Whether a page's paragraphs have at least ``least`` characters together."""
    return F.length(F.replace(text, F.lit("\n"), F.lit(""))) >= least


def consecutive_once(pages: DataFrame, order: str = "ord") -> DataFrame:
    """Pages without those that repeat the id of the page right before them in their file.

    ``pages`` has ``file, id`` and the order inside the file."""
    before = F.lag("id").over(Window.partitionBy("file").orderBy(order))
    return pages.withColumn("_before", before).where("NOT _before <=> id").drop("_before")


def category_selected(cats: Column, include: list[str], exclude: list[str]) -> Column:
    """No excluded category and, if any are listed, an included one."""
    strings = lambda x: F.array(*[F.lit(c) for c in x]).cast("array<string>")
    out = ~F.arrays_overlap(cats, strings(exclude)) if exclude else F.lit(True)
    return out & F.arrays_overlap(cats, strings(include)) if include else out


def drop_nested(text: str, opening: str, closing: str) -> str:
    """Without the outermost balanced regions between two patterns; unclosed ones stay."""
    out, depth, start, last = [], 0, 0, 0
    for m in re.finditer(f"(?P<open>{opening})|{closing}", text, re.I):
        if m["open"]:
            if not depth:
                start = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(text[last:start])
                last = m.end()
    return "".join(out) + text[last:]


def external_link(m: re.Match) -> str:
    """A bracketed link as its label; an image as its label shows nothing."""
    label = (m[1] or "").strip()
    return "" if IMAGE.fullmatch(label) else label


def replace_links(text: str) -> str:
    """``[[target|label]]`` to its label (the last one; letters that follow belong to it);
    links into other namespaces vanish. Nested links count as one."""
    out, last = [], 0
    for start, end in _balanced(text, "[[", "]]"):
        inner = text[start + 2 : end - 2]
        trail = re.compile(r"\w+").match(text, end)
        target, bar, label = inner.partition("|")
        if "[[" in label:
            label = replace_links(label)
        label = label.rsplit("|", 1)[-1] if bar else target
        prefix, colon, _ = target.lstrip(":").partition(":")
        keep = not colon or prefix.lower() in KEPT_NAMESPACES
        out.append(text[last:start] + (label + (trail[0] if trail else "") if keep else ""))
        last = trail.end() if trail else end
    return "".join(out) + text[last:]


def _balanced(text: str, opening: str, closing: str):
    depth, start = 0, 0
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if m[0] == opening:
            if not depth:
                start = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                yield start, m.end()


def clean_wikitext(text: str, lists: bool = False, sections: bool = False) -> str:
    """Plain paragraphs of a page: templates, tables, comments, references and tags gone,
    links and quotes resolved; headings and list items only on request."""
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    protected: list[str] = []

    def keep(m: re.Match) -> str:
        protected.append(m[1])
        return f"\x00{len(protected) - 1}\x00"

    text = re.sub(r"<nowiki>(.*?)</nowiki>", keep, text, flags=re.S | re.I)
    text = drop_nested(drop_nested(text, r"\{\{", r"\}\}"), r"\{\|", r"\|\}")
    text = re.sub(r"'{5}|'{3}|''", "", text)
    text = re.sub(r"__[A-Z]+__", "", text)
    text = re.sub(r"<(?:br|hr|ref|references|nowiki)\b[^<>]*/\s*>", "", text, flags=re.I)
    for tag in " ".join(DROPPED).split():
        text = drop_nested(text, rf"<\s*{tag}\b[^>/]*>", rf"<\s*/\s*{tag}\s*>")
    text = replace_links(text)
    text = re.sub(r"\[(?:https?|ftp|mailto)://[^\s\]]+([^\]]*)\]", external_link, text)
    text = html.unescape(re.sub(r"</?[a-zA-Z][^<>]*>", "", text)).replace("\xa0", " ")
    text = re.sub(r"\(\s*[,;]*\s*\)", "", text.replace("<<", "«").replace(">>", "»"))
    for pattern, to in ((r"[ \t]{2,}|\t", " "), (r"\.{4,}", "..."), (r" ([,:.)\]»])", r"\1"), (r"([\[(«]) ", r"\1"), (",,", ","), (r",\.", ".")):
        text = re.sub(pattern, to, text)
    text = "\n".join(line.rstrip() for line in text.split("\n"))
    text = wikitext.compact(text, lists, sections)
    text = "\n".join(line for line in text.split("\n") if re.search(r"\w|\x00", line))
    return re.sub("\x00(\\d+)\x00", lambda m: protected[int(m[1])], text)


@F.pandas_udf(T.StringType())
def clean_text(texts: pd.Series) -> pd.Series:
    """``clean_wikitext`` as a column function; null stays null."""
    return texts.map(lambda x: None if x is None else clean_wikitext(x))
