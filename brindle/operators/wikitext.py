"""Template expansion of wikitext: one parse into a tree, then evaluation with frames.

A page is parsed once: braces and links nest on a stack, and a closing run takes three
braces for an argument, two for a call. Calls are parser functions, module functions,
magic words or templates; branches of parser functions are evaluated when taken.
Evaluation ends at a depth of ``MAX_DEPTH``.

The template table is collected only after its bytes are measured.
"""

from __future__ import annotations

import ast
import operator
import re
import urllib.parse
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH, MAX_LENGTH = 30, 5_000_000
TEMPLATE_BYTES = 256 << 20
#: Namespaces of templates and modules.
TEMPLATE_NAMESPACES = ("10", "828")

# Parsing ----------------------------------------------------------------------------


@dataclass
class Call:
    """``{{...}}``: parts between pipes."""

    parts: list[list]


@dataclass
class Argument:
    """``{{{name|default}}}``."""

    parts: list[list]


@dataclass
class _Open:
    kind: str  # "{" or "["
    count: int
    parts: list[list] = field(default_factory=lambda: [[]])


TOKEN = re.compile(r"\{{2,}|\}{2,}|\[\[|\]\]|\|")


def _literal(opened: _Open) -> list:
    """An opening that never closes, as text."""
    out: list = [opened.kind * opened.count]
    for k, part in enumerate(opened.parts):
        out += (["|"] if k else []) + part
    return out


@lru_cache(maxsize=4096)
def parse(text: str) -> tuple:
    """Nodes of a text: strings, calls and arguments."""
    stack, last = [_Open("", 0)], 0

    def add(*nodes) -> None:
        stack[-1].parts[-1].extend(n for n in nodes if n != "")

    for m in TOKEN.finditer(text):
        add(text[last : m.start()])
        last, token = m.end(), m[0]
        if token[0] == "{":
            stack.append(_Open("{", len(token)))
        elif token == "[[":
            stack.append(_Open("[", 2))
        elif token == "|":
            if stack[-1].kind == "{":
                stack[-1].parts.append([])
            else:
                add("|")
        elif token == "]]":
            while len(stack) > 1 and stack[-1].kind != "[" and any(o.kind == "[" for o in stack):
                add(*_literal(stack.pop())) if stack[-1].kind == "[" else _fold(stack)
            if stack[-1].kind == "[":
                inner = stack.pop()
                add(*_literal(inner), "]]")
            else:
                add("]]")
        else:
            left = len(token)
            while left >= 2 and any(o.kind == "{" for o in stack):
                while stack[-1].kind != "{":
                    _fold(stack)
                opened = stack.pop()
                used = min(3, left, opened.count)
                node = Argument(opened.parts) if used == 3 else Call(opened.parts)
                left -= used
                rest = opened.count - used
                if rest >= 2:
                    stack.append(_Open("{", rest))
                elif rest:
                    add("{")
                add(node)
            add("}" * left)
    add(text[last:])
    while len(stack) > 1:
        _fold(stack)
    return tuple(stack[0].parts[0])


def _fold(stack: list[_Open]) -> None:
    nodes = _literal(stack.pop())
    stack[-1].parts[-1].extend(nodes)


# Expressions --------------------------------------------------------------------------

_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.MatMult: lambda a, b: round(a, int(b)),
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
}


def calculate(expression: str) -> str:
    """Value of an arithmetic expression; raises on anything else. ``div``, ``mod`` and
    ``round`` are operators, truth values are 1 and 0."""
    source = re.sub(r"(?<![!<>=])=(?!=)", "==", expression.replace("<>", "!="))
    for word, sign in (("mod", "%"), ("div", "/"), ("round", "@")):
        source = re.sub(rf"\b{word}\b", sign, source)

    def value(node: ast.AST) -> float:
        match node:
            case ast.Expression(body=body):
                return value(body)
            case ast.Constant(value=int() | float() as x):
                return x
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -value(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return value(x)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return int(not value(x))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](value(a), value(b))
            case ast.BoolOp(op=op, values=values):
                found = [bool(value(v)) for v in values]
                return int(all(found) if isinstance(op, ast.And) else any(found))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _BINARY:
                return int(_BINARY[type(op)](value(a), value(b)))
        raise ValueError("not arithmetic")

    result = value(ast.parse(source.strip(), mode="eval"))
    return str(int(result)) if isinstance(result, float) and result.is_integer() and abs(result) < 1e15 else str(result)


# Modules --------------------------------------------------------------------------------

Arguments = Mapping[str, str]


def _named(args: Arguments, *names: str) -> list[str]:
    """Values by name; names that are missing take the positional ones in order."""
    place, out = 1, []
    for name in names:
        if name in args:
            out.append(args[name])
        else:
            out.append(args.get(str(place), ""))
            place += 1
    return out


def _number(text: str, default: int) -> int:
    return int(text.strip()) if text.strip() else default


def _sub(args: Arguments) -> str:
    """Characters i to j, counted from 1, from the end where negative."""
    s, i, j = _named(args, "s", "i", "j")
    first, last = _number(i, 1), _number(j, -1)
    return s[first - 1 if first > 0 else max(len(s) + first, 0) : last if last >= 0 else len(s) + last + 1]


def _sub_length(args: Arguments) -> str:
    s, i, n = _named(args, "s", "i", "len")
    first = _number(i, 1) - 1
    return s[first : first + _number(n, 1)]


def _pos(args: Arguments) -> str:
    s, k = _named(args, "target", "pos")
    at = _number(k, 1)
    return s[at - 1 if at > 0 else at]


def _find(args: Arguments) -> str:
    s, target, start, plain = _named(args, "source", "target", "start", "plain")
    if not s or not target:
        return "0"
    begin = _number(start, 1) - 1
    if plain.strip() in ("", "true", "1", "yes"):
        return str(s.find(target, begin) + 1)
    found = re.compile(target).search(s, begin)
    return str(found.start() + 1 if found else 0)


def _replace(args: Arguments) -> str:
    s, pattern, new, count, plain = _named(args, "source", "pattern", "replace", "count", "plain")
    n = _number(count, 0)
    if plain.strip() in ("", "true", "1", "yes"):
        return s.replace(pattern, new, n or -1)
    return re.sub(pattern, lambda m: new, s, count=n)


def _repeat(args: Arguments) -> str:
    s, n = _named(args, "source", "count")
    return s * min(max(_number(n, 1), 0), MAX_LENGTH // max(len(s), 1))


#: Numerals in falling order.
NUMERALS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(args: Arguments) -> str:
    n = int(float(args.get("1", "")))
    if not 0 <= n < 5000:
        return args.get("2", "N/A")
    out = ""
    for size, sign in NUMERALS:
        times, n = divmod(n, size)
        out += sign * times
    return out


def _first_given(args: Arguments) -> str:
    return next((args[k] for k in sorted((k for k in args if k.isdigit()), key=int) if args[k]), "")


MODULES: dict[tuple[str, str], Callable[[Arguments], str]] = {
    ("convert", "convert"): lambda a: f"{a.get('1', '')} {a.get('2', '')}",
    ("If empty", "main"): _first_given,
    ("String", "len"): lambda a: str(len(_named(a, "s")[0])),
    ("String", "sub"): _sub,
    ("String", "sublength"): _sub_length,
    ("String", "pos"): _pos,
    ("String", "find"): _find,
    ("String", "replace"): _replace,
    ("String", "rep"): _repeat,
    ("Roman", "main"): roman,
    ("Numero romano", "main"): roman,
}

# Evaluation -----------------------------------------------------------------------------


def first_up(text: str) -> str:
    return text[:1].upper() + text[1:]


def template_title(name: str) -> str:
    """The stored title of a transclusion: namespace and first letter normalised; a leading
    colon stands for the main namespace."""
    name = re.sub(r"[\s_]+", " ", name).strip()
    if name.startswith(":"):
        return first_up(name[1:].strip())
    space, colon, rest = name.partition(":")
    if colon and space.strip().lower() in ("template", "t"):
        name = rest.strip()
    return first_up(name)


def normalised_title(title: str, namespaces: tuple[str, ...] = ()) -> str:
    """A page title: spaces single, namespace and first letter normalised. A prefix that is
    no namespace is part of the title."""
    title = re.sub(r"[\s_]+", " ", title).strip()
    space, colon, rest = title.partition(":")
    if colon:
        known = {n.lower(): n for n in namespaces}
        if space.strip().lower() in known:
            return f"{known[space.strip().lower()]}:{first_up(rest.strip())}"
        return f"{first_up(space.strip())}:{first_up(rest.strip()) if rest[:1] == ' ' else rest}"
    return first_up(title)


def definition(body: str) -> str:
    """What a template gives where it is used."""
    body = re.sub(r"<!--.*?-->", "", body, flags=re.S)
    only = re.findall(r"<onlyinclude>(.*?)</onlyinclude>", body, re.S)
    if only:
        return "".join(only)
    body = re.sub(r"<noinclude\s*/>|<noinclude>.*?(?:</noinclude>|\Z)", "", body, flags=re.S)
    return re.sub(r"</?includeonly\s*/?>", "", body)


REDIRECT = re.compile(r"\s*#REDIRECT\b[^\[]*\[\[([^\]|#]*)", re.I)
ERROR = re.compile(r"""<(?:strong|span|p|div)\s(?:[^\s>]+\s+)*?class="(?:[^"\s>]+\s+)*?error(?:\s[^">]*)?\"""")
EMPTY_FUNCTIONS = ("#rel2abs", "#ifexpr", "#language", "#time", "#timel", "#titleparts")


@dataclass
class Frame:
    title: str
    args: Arguments
    before: Frame | None = None


class Expander:
    """Expands the templates of one page."""

    def __init__(self, templates: Mapping[str, str], title: str = "", namespace: str = "", now: datetime | None = None):
        self.templates = templates
        self.words = magic_words(title, namespace, now or datetime(2000, 1, 1))
        self.room = MAX_LENGTH

    def expand(self, text: str) -> str:
        return self.evaluate(parse(text), Frame("", {}), 0)

    def evaluate(self, nodes: tuple | list, frame: Frame, depth: int) -> str:
        out = []
        for node in nodes:
            if isinstance(node, str):
                out.append(node)
            elif depth < MAX_DEPTH and self.room > 0:
                given = self.argument(node, frame, depth + 1) if isinstance(node, Argument) else self.call(node, frame, depth + 1)
                self.room -= len(given)
                out.append(given)
        return "".join(out)

    def argument(self, node: Argument, frame: Frame, depth: int) -> str:
        name = self.evaluate(node.parts[0], frame, depth).strip()
        if name in frame.args:
            return frame.args[name]
        if len(node.parts) > 1:
            return self.evaluate(node.parts[1], frame, depth)
        return "{{{" + name + "}}}"

    def call(self, node: Call, frame: Frame, depth: int) -> str:
        head = re.sub(r"^\s*(?:safe)?subst:", "", self.evaluate(node.parts[0], frame, depth), flags=re.I).strip()
        if len(node.parts) == 1 and head.lower() in self.words:
            return self.words[head.lower()]
        name, colon, first = head.partition(":")
        if colon and (name.strip().lower() in FUNCTIONS or name.strip().lower() in EMPTY_FUNCTIONS):
            value = lambda k: (first if k == 0 else self.evaluate(node.parts[k], frame, depth) if k < len(node.parts) else "")
            try:
                return FUNCTIONS.get(name.strip().lower(), lambda *_: "")(self, value, len(node.parts), node, frame, depth)
            except (ValueError, ArithmeticError, IndexError, TypeError, SyntaxError, re.error, RecursionError):
                return ""
        return self.template(template_title(head), node.parts[1:], frame, depth)

    def named_arguments(self, parts: list[list], frame: Frame, depth: int) -> dict[str, str]:
        """Arguments of a call: named ones trimmed (unless a link is inside), others numbered;
        the last of a name counts."""
        given, place = {}, 0
        for part in parts:
            key, value = _assignment(part)
            if key is None:
                place += 1
                given[str(place)] = self.evaluate(part, frame, depth)
            else:
                text = self.evaluate(value, frame, depth)
                given[self.evaluate(key, frame, depth).strip()] = text if "]]" in text else text.strip()
        return given

    def template(self, title: str, parts: list[list], frame: Frame, depth: int) -> str:
        body, seen = self.templates.get(title), {title}
        while body is not None and (to := REDIRECT.match(body)):
            title = template_title(to[1])
            body = None if title in seen else self.templates.get(title)
            seen.add(title)
        if body is None:
            return ""
        args = self.named_arguments(parts, frame, depth)
        return self.evaluate(parse(definition(body)), Frame(title, args, frame), depth)


def _assignment(part: list) -> tuple[list | None, list]:
    """Key and value of a part with an equals sign outside calls and links."""
    for k, node in enumerate(part):
        if isinstance(node, str) and "=" in node:
            if any(isinstance(n, str) and "[[" in n for n in part[:k]) or "[[" in node.split("=", 1)[0]:
                return None, part
            left, right = node.split("=", 1)
            return [*part[:k], left], [right, *part[k + 1 :]]
    return None, part


def _if(x: Expander, value, n: int, *_) -> str:
    return value(1).strip() if value(0).strip() else value(2).strip()


def _ifeq(x: Expander, value, n: int, *_) -> str:
    return (value(2) if value(0).strip() == value(1).strip() else value(3)).strip()


def _iferror(x: Expander, value, n: int, *_) -> str:
    if ERROR.match(value(0).strip()):
        return value(1).strip()
    return value(0).strip() if n < 3 else value(2).strip()


def _switch(x: Expander, value, n: int, node: Call, frame: Frame, depth: int) -> str:
    """The first case that matches, through cases without a value; else ``#default`` or a
    last part without an equals sign."""
    wanted, met, fallback = value(0).strip(), False, ""
    for k, part in enumerate(node.parts[1:], 1):
        key, result = _assignment(part)
        if key is None:
            case = x.evaluate(part, frame, depth).strip()
            met = met or case == wanted
            if k == n - 1 and not met:
                fallback = case
            continue
        case = x.evaluate(key, frame, depth).strip()
        if met or wanted in (c.strip() for c in case.split("|")):
            return x.evaluate(result, frame, depth).strip()
        if case == "#default":
            fallback = x.evaluate(result, frame, depth).strip()
    return fallback


def _expr(x: Expander, value, *_) -> str:
    try:
        return calculate(value(0))
    except (ValueError, ArithmeticError, SyntaxError, TypeError, RecursionError):
        return f'<span class="error">{value(0)}</span>'


def _invoke(x: Expander, value, n: int, node: Call, frame: Frame, depth: int) -> str:
    module, function = value(0).strip(), value(1).strip()
    if n > 2:
        args = x.named_arguments(node.parts[2:], frame, depth)
    else:  # the arguments of the template of that name, if one is being expanded
        own, args = frame, {}
        while own is not None:
            if own.title == template_title(module):
                args = own.args
                break
            own = own.before
    return MODULES.get((module, function), lambda a: "")(args)


FUNCTIONS: dict[str, Callable[..., str]] = {
    "#if": _if,
    "#ifeq": _ifeq,
    "#iferror": _iferror,
    "#ifexist": lambda x, value, *_: value(2).strip(),  # no page is known to exist
    "#switch": _switch,
    "#expr": _expr,
    "#invoke": _invoke,
    "urlencode": lambda x, value, *_: urllib.parse.quote(value(0)),
    "lc": lambda x, value, *_: value(0).lower(),
    "uc": lambda x, value, *_: value(0).upper(),
    "lcfirst": lambda x, value, *_: value(0)[:1].lower() + value(0)[1:],
    "ucfirst": lambda x, value, *_: first_up(value(0)),
    "int": lambda x, value, *_: str(int(value(0))),
}


def magic_words(title: str, namespace: str, now: datetime) -> dict[str, str]:
    """Values of magic words for a page; times are those of the run."""
    full = f"{namespace}:{title}" if namespace else title
    words = {
        "!": "|", "pagename": title, "fullpagename": full, "basepagename": title.rsplit("/", 1)[0], "subpagename": title.rsplit("/", 1)[-1],
        "namespace": namespace, "pagenamee": urllib.parse.quote(title.replace(" ", "_")), "fullpagenamee": urllib.parse.quote(full.replace(" ", "_")),
        "currentyear": f"{now:%Y}", "currentmonth": f"{now:%m}", "currentday": str(now.day), "currentday2": f"{now:%d}", "currenthour": f"{now:%H}", "currenttime": f"{now:%H:%M:%S}",
    }
    return words | {k.replace("current", "local"): v for k, v in words.items() if k.startswith("current")}


def expand(text: str, templates: Mapping[str, str], title: str = "", namespace: str = "", now: datetime | None = None) -> str:
    """The text with its templates expanded; ``nowiki`` regions are left as they are."""
    expander, out, last = Expander(templates, title, namespace, now), [], 0
    for m in re.finditer(r"<nowiki>.*?</nowiki>", text, re.S | re.I):
        out += [expander.expand(text[last : m.start()]), m[0]]
        last = m.end()
    return "".join([*out, expander.expand(text[last:])])


# Spark ------------------------------------------------------------------------------------


def template_pages(pages: DataFrame) -> DataFrame:
    """``title, text`` of the template and module pages of a dump, titles without namespace."""
    title = F.regexp_replace("title", r"^[^:]*:\s*", "")
    return pages.where(F.col("ns").isin(*TEMPLATE_NAMESPACES)).select(F.regexp_replace(title, "_", " ").alias("title"), "text")


def template_table(rows: DataFrame, most_bytes: int = TEMPLATE_BYTES) -> dict[str, str]:
    """The template table on the driver, once its bytes are known to be below a bound."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("title") + F.octet_length("text")), F.lit(0)).alias("n")).first().n
    if size > most_bytes:
        raise ValueError(f"the templates have {size} bytes, more than {most_bytes}")
    return {first_up(r.title): r.text for r in rows.where("title IS NOT NULL AND text IS NOT NULL").collect()}


def expand_pages(pages: DataFrame, templates: Mapping[str, str], now: datetime | None = None) -> DataFrame:
    """``pages`` (``title, text`` and others) with templates expanded; null texts stay."""
    shared = pages.sparkSession.sparkContext.broadcast((dict(templates), now))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = shared.value
        for batch in batches:
            texts = [None if t is None else expand(t, table, name or "", "", at) for name, t in zip(batch.column("title").to_pylist(), batch.column("text").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return pages.mapInArrow(run, pages.schema)


# Paragraphs -------------------------------------------------------------------------------

HEADING = re.compile(r"(=+)\s*(.*?)\s*\1\s*")


def compact(text: str, lists: bool = False, sections: bool = False) -> str:
    """Lines of prose. Headings wait for a line of their section and show only with
    ``sections``; list items show only with ``lists``; indented, preformatted, bracketed and
    punctuation-only lines and residues of tables go."""
    out: list[str] = []
    waiting: dict[int, str] = {}
    counts: list[int] = []
    levels, in_section = "", True

    def heads() -> None:
        if sections:
            out.extend(f"Section::::{waiting[level]}" for level in sorted(waiting))
        waiting.clear()

    for line in text.split("\n"):
        if not line.strip():
            levels, counts = "", []
            if out and out[-1]:
                out.append("")
            continue
        heading = HEADING.fullmatch(line)
        if heading:
            level, title = len(heading[1]), heading[2]
            for deeper in [k for k in waiting if k >= level]:
                del waiting[deeper]
            waiting[level] = title + ("" if not title or title[-1] in "!?" else ".")
            levels, counts, in_section = "", [], False
            continue
        marks = re.match(r"[*#;:]*", line)[0]
        if marks:
            same = next((k for k, (a, b) in enumerate(zip(levels, marks)) if a != b), min(len(levels), len(marks)))
            counts = (counts[:same] + [0] * (len(marks) - same))[: len(marks)]
            levels, item = marks, line[len(marks) :].strip()
            if lists and item and marks[0] != ":":
                heads()
                in_section = True
                counts[-1] += 1
                out.append((f"BULLET::::{counts[-1]}. " if marks[-1] == "#" else "BULLET::::- ") + item)
            continue
        levels, counts = "", []
        if line[0] in "{|!" or line[-1] == "}" or (line[0] == "(" and line[-1] == ")") or not line.strip(".-"):
            continue
        if line[0] == " " and not waiting:
            continue
        if waiting or in_section:
            heads()
            in_section = True
            out.append(line)
    return "\n".join(out).strip("\n")

