"""Template expansion and paragraphs by hand-computed cases."""

import pytest

from brindle.operators import wikitext as w

TEMPLATES = {
    "A": "[{{{1|none}}}]", "B": "{{A|{{{x}}}}}", "R": "#REDIRECT [[Template:A]]", "Loop": "{{Loop}}x", "Round": "#REDIRECT [[Template:Round]]",
    "N": "<noinclude>doc</noinclude>in<includeonly>!</includeonly>", "O": "a<onlyinclude>b</onlyinclude>c<onlyinclude>d</onlyinclude>", "Roman": "{{#invoke:Roman|main}}",
    "Join": "{{{a}}}-{{{b|}}}-{{{1}}}", "Def": "{{{{{which}}}|k}}", "Two words": "tw",
}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{{A}}", "[none]"), ("{{a|b}}", "[b]"), ("{{Template:A|b}}", "[b]"), ("{{two_words}}", "tw"), ("{{R|z}}", "[z]"), ("{{Round}}", ""), ("{{unknown|x}}", ""),
        ("{{B|x= y }}", "[y]"), ("{{A| y }}", "[ y ]"), ("{{A|1=p|1=q}}", "[q]"), ("{{Join|b=[[l|m]] |z|a=1}}", "1-[[l|m]] -z"), ("{{A|[[u=v]]}}", "[[[u=v]]]"),
        ("{{N}}", "in!"), ("{{O}}", "bd"), ("{{{p|d}}}", "d"), ("{{{p}}}", "{{{p}}}"), ("{{Def|which=A}}", "[k]"), ("{{A|{{{q|{{A|s}}}}}}}", "[[s]]"), ("{{subst:A|q}}", "[q]"),
        ("a {{ b", "a {{ b"), ("x }} y", "x }} y"), ("[[a|{{A|l}}]]", "[[a|[l]]]"), ("{{A|[[x|y]]|z}}", "[[[x|y]]]"), ("<nowiki>{{A}}</nowiki>{{A|s}}", "<nowiki>{{A}}</nowiki>[s]"),
        ("{{#if: a | b | c }}", "b"), ("{{#if: | b | {{A|c}} }}", "[c]"), ("{{#if:|b}}", ""), ("{{#ifeq: 1 | 1 | y | n}}", "y"), ("{{#ifeq:1|01|y|n}}", "n"), ("{{#ifexist:X|y|n}}", "n"),
        ("{{#switch: b | a = 1 | b | c = 2 | #default = 3}}", "2"), ("{{#switch:q|a=1|#default=3}}", "3"), ("{{#switch:q|a=1|last}}", "last"), ("{{#switch:a|a=x=y}}", "x=y"),
        ("{{#expr: 7 div 2 + 1 mod 3}}", "4.5"), ("{{#expr: 3.14159 round 2}}", "3.14"), ("{{#expr: 1 = 1 and not 0}}", "1"), ("{{#expr: 2 <> 2}}", "0"), ("{{#expr: -(3 - 5) * 4}}", "8"),
        ("{{#iferror: {{#expr: 1 div 0}} | bad | ok}}", "bad"), ("{{#iferror: {{#expr: open(1)}} | bad }}", "bad"), ("{{#iferror: fine | bad}}", "fine"),
        ("{{lc:ABC}}{{uc:d}}{{lcfirst:AB}}{{ucfirst:ab}}", "abcDaBAb"), ("{{urlencode:a b/ü}}", "a%20b/%C3%BC"), ("{{int:07}}", "7"), ("{{int:x}}", ""), ("{{#time:Y}}{{#titleparts:a/b|1}}", ""),
        ("{{#invoke:String|len|hello}}", "5"), ("{{#invoke:String|sub|hello|2|-2}}", "ell"), ("{{#invoke:String|sub|s=hello|i=-3}}", "llo"), ("{{#invoke:String|sublength|hello|2|3}}", "ell"),
        ("{{#invoke:String|pos|hello|-1}}", "o"), ("{{#invoke:String|find|hello|l}}", "3"), ("{{#invoke:String|find|hello|z}}", "0"), ("{{#invoke:String|find|source=hello|target=l+|plain=false}}", "3"),
        ("{{#invoke:String|replace|hello|l|L|1}}", "heLlo"), ("{{#invoke:String|replace|hello|l+|L|plain=false}}", "heLo"), ("{{#invoke:String|rep|ab|3}}", "ababab"),
        ("{{#invoke:If empty|main||x|y}}", "x"), ("{{#invoke:convert|convert|5|km}}", "5 km"), ("{{Roman|1994}}", "MCMXCIV"), ("{{#invoke:Roman|main|6000|big}}", "big"), ("{{#invoke:No|f}}", ""),
        ("{{PAGENAME}}{{!}}{{NAMESPACE}}", "My page|"), ("{{FULLPAGENAMEE}}", "My_page"), ("{{CURRENTYEAR}}", "2000"),
    ],
)
def test_expansion(text, want):
    assert w.expand(text, TEMPLATES, "My page") == want


def test_depth_and_size_are_bounded():
    assert len(w.expand("{{Loop}}", TEMPLATES)) < 40
    wide = {"W": "{{{1}}}" * 10} | {f"D{k}": f"{{{{D{k + 1}|{{{{{{1}}}}}}}}}}" * 10 for k in range(12)} | {"D12": "x" * 1000}
    assert len(w.expand("{{D0|y}}", wide)) <= 2 * w.MAX_LENGTH
    assert w.expand("{{" * 3000 + "}}" * 3000, {}) is not None


def test_titles():
    assert w.template_title(" template:foo_ bar ") == "Foo bar" and w.template_title(":talk") == "Talk"
    assert w.normalised_title("talk: x  y_z", ("Talk",)) == "Talk:X y z" and w.normalised_title("3:10 to Yuma") == "3:10 to Yuma" and w.normalised_title("a_b") == "A b"


def test_compact():
    text = "Intro.\n\n\n== H ==\n=== S ===\n* item\n# one\n# two\n## deep\nBody.\n(bracket)\n: indent\n{| t\n|-\nx}\n...\n== Empty ==\n== Next! ==\n pre\ntext\n tail"
    assert w.compact(text).split("\n") == ["Intro.", "", "Body.", " pre", "text"]
    full = w.compact(text, lists=True, sections=True).split("\n")
    assert full == ["Intro.", "", "Section::::H.", "Section::::S.", "BULLET::::- item", "BULLET::::1. one", "BULLET::::2. two", "BULLET::::1. deep", "Body.", "Section::::Next!", " pre", "text"]
