import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from htmlframe.functions import builder, serialize
from htmlframe.functions.dump import dump
from htmlframe.functions.tree import ELEMENT
from htmlframe.operators.parse import node_rows
from htmlframe.queries import TREES


@pytest.mark.parametrize(("text", "want"), TREES)
def test_trees(text, want):
    assert dump(builder.parse(text)) == want


BODIES = [
    ("<p>1<table><p>2</table>", "<p>1<p>2</p><table></table></p>"),
    ("<!doctype html><p>1<table>", "<p>1</p><table></table>"),
    ("<b><b><b><b>x", "<b><b><b><b>x</b></b></b></b>"),
    ("<p><b><b><b><b>x<p>y", "<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p>"),
    ("<nobr>1<nobr>2", "<nobr>1</nobr><nobr>2</nobr>"),
    ("<button>1<button>2", "<button>1</button><button>2</button>"),
    ("<form><form>x", "<form>x</form>"),
    ("<div></p>", "<div><p></p></div>"),
    ("</br>x", "<br>x"),
    ("<option>1<option>2", "<option>1</option><option>2</option>"),
    ("<table><td>x<table><td>y", "<table><tbody><tr><td>x<table><tbody><tr><td>y</td></tr></tbody></table></td></tr></tbody></table>"),
    ("<table><caption>c<tr><td>d", "<table><caption>c</caption><tbody><tr><td>d</td></tr></tbody></table>"),
    ("<table><col><td>x", "<table><colgroup><col></colgroup><tbody><tr><td>x</td></tr></tbody></table>"),
    ("<table><input type=hidden><input>", '<input><table><input type="hidden"></table>'),
    ("<select><input>", "<select></select><input>"),
    ("<select><b>x</b><p>y</select>", "<select><b>x</b><p>y</p></select>"),
    ("<a href=1><table><a href=2>x", '<a href="1"><a href="2">x</a><table></table></a>'),
    ("<pre>\n\nx</pre>", "<pre>\nx</pre>"),
    ("<li><div><li>x", "<li><div></div></li><li>x</li>"),
    ("<object><b>x</object>y", "<object><b>x</b></object>y"),
    ("<noscript><p>x</noscript>", "<noscript></noscript><p>x</p>"),
    ("<svg><p>x", "<svg></svg><p>x</p>"),
    ("<svg><a xlink:href=x>y</a></svg>", '<svg><a xlink:href="x">y</a></svg>'),
    ("<svg/><p>x", "<svg></svg><p>x</p>"),
    ("a\0b", "ab"),
]


@pytest.mark.parametrize(("text", "want"), BODIES)
def test_bodies(text, want):
    body = builder.parse(text).body()
    head = builder.parse(text).head()
    got = "".join(serialize.to_html(c) for c in [*(head.children if head else []), *body.children])
    assert got == want


def test_selected_content():
    doc = builder.parse("<select><button><selectedcontent></selectedcontent></button><option>1<option selected>2</select>")
    assert "<selectedcontent>2</selectedcontent>" in serialize.to_html(doc)


def test_fragments():
    tags = lambda text, context, ns="": [n.name for n in builder.parse_fragment(text, context, ns)]
    assert tags("<td>1<td>2", "tr") == ["td", "td"]
    assert tags("<td>1", "div") == []
    assert tags("x<b>y</b><i>", "div") == ["b", "i"]
    assert tags("<option>1<option>2", "select") == ["option", "option"]
    assert tags("<lineargradient>", "svg", "svg") == ["linearGradient"]
    assert tags("<b>", "script") == []


def test_srcdoc_and_quirks():
    assert builder.parse("<p>").quirks == 1
    assert builder.parse("<p>", srcdoc=True).quirks == 0
    assert builder.parse("<!DOCTYPE foo>", srcdoc=True).quirks == 0


MARKUP = st.lists(
    st.sampled_from("<p> </p> <b> </b> <a> </a> <table> </table> <tr> <td> </td> <select> </select> <svg> </svg> <math> <mi> <template> </template> <form> </form> <li> <ul> </ul> <!--c--> x & <h1> <title> </title> <frameset> <font> </font> <nobr> <button> <option> <caption> <col>".split()),
    max_size=25,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(MARKUP)
def test_any_markup_gives_a_sound_tree(text):
    doc = builder.parse(text)
    assert not any(e[0] == "internal-error" for e in doc.errors)
    rows = node_rows(0, doc)
    by_id = {r[1]: r for r in rows}
    for r in rows:
        assert r[3] >= r[1]
        if r[2] is not None:
            assert r[2] < r[1] <= r[3] <= by_id[r[2]][3]
    places = {}
    for r in rows:
        if r[5] == ELEMENT:
            places.setdefault((r[2], r[12]), []).append(r[13])
    assert all(p == list(range(1, len(p) + 1)) for p in places.values())


def test_deep_nesting():
    doc = builder.parse("<div>" * 3000 + "x")
    assert doc.text() == "x" and serialize.to_html(doc).count("<div>") == 3000
