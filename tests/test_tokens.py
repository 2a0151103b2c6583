import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from htmlframe.functions import charrefs
from htmlframe.functions import tokens as tk


def short(text, **o):
    found, _ = tk.tokenize(text, **o)
    return [(t.kind, t.name or t.data, list(t.attrs)) if t.kind == tk.START else (t.kind, t.name or t.data) for t in found]


def codes(text):
    return [e[0] for e in tk.tokenize(text)[1]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a<b>c</b>", [("Character", "a"), ("StartTag", "b", []), ("Character", "c"), ("EndTag", "b")]),
        ("<A HREF=x B>", [("StartTag", "a", [("href", "x"), ("b", "")])]),
        ("<a x=1 X=2>", [("StartTag", "a", [("x", "1")])]),
        ("<a x = 1>", [("StartTag", "a", [("x", "")])]),
        ("1<2", [("Character", "1"), ("Character", "<2")]),
        ("</>x", [("Character", "x")]),
        ("<?x>", [("Comment", "?x")]),
        ("<!--a--!>", [("Comment", "a")]),
        ("<!-->x", [("Comment", ""), ("Character", "x")]),
        ("<!--a--", [("Comment", "a")]),
        ("<title>&lt;<b></TITLE >x", [("StartTag", "title", []), ("Character", "<<b>"), ("EndTag", "title"), ("Character", "x")]),
        ("<style>&lt;</style>", [("StartTag", "style", []), ("Character", "&lt;"), ("EndTag", "style")]),
        ("<script><!--<script></script>--></script>", [("StartTag", "script", []), ("Character", "<!--<script></script>-->"), ("EndTag", "script")]),
        ("<script><!--x</script>", [("StartTag", "script", []), ("Character", "<!--x"), ("EndTag", "script")]),
        ("<plaintext></plaintext>", [("StartTag", "plaintext", []), ("Character", "</plaintext>")]),
        ("<iframe a=b>x<p>", [("StartTag", "iframe", [("a", "b")]), ("Character", "x"), ("StartTag", "p", [])]),
        ("<a", []),
        ("<a b='1", []),
        ("\r\na\rb", [("Character", "\na\nb")]),
        ("﻿x", [("Character", "x")]),
        ("<![CDATA[x]]>", [("Comment", "[CDATA[x]]")]),
    ],
)
def test_tokens(text, want):
    got = short(text)
    assert got == want


def test_doctypes():
    one = lambda s: [(t.name, t.public_id, t.system_id, t.force_quirks) for t in tk.tokenize(s)[0]][0]
    assert one("<!DOCTYPE HTML>") == ("html", None, None, False)
    assert one('<!doctype html public "a" \'b\'>') == ("html", "a", "b", False)
    assert one('<!doctype html system "b">') == ("html", None, "b", False)
    assert one("<!doctype>") == ("", None, None, True)
    assert one('<!doctype html  public "a">') == ("html", None, None, True)
    assert one('<!doctype html public "a>') == ("html", "a", None, True)
    assert one("<!doctype html x>") == ("html", None, None, True)


def test_errors_have_places():
    errors = tk.tokenize("x\n<a b=1 b=2>\0")[1]
    assert [(e[0], e[2]) for e in errors] == [("duplicate-attribute", 2), ("unexpected-null-character", 2)]
    assert codes("<a b=>") == ["missing-attribute-value"]
    assert codes("</>") == ["empty-end-tag"] and tk.tokenize("</>")[1][0][1] == "Unknown error"
    assert codes("<!--") == ["eof-in-comment"]


@pytest.mark.parametrize(
    ("text", "attribute", "want"),
    [
        ("&amp;&lt;", False, "&<"), ("&ampx", False, "&x"), ("&ampx", True, "&ampx"), ("&amp=", True, "&amp="), ("&copy", True, "©"), ("&notin;", False, "∉"), ("&notit;", False, "¬it;"),
        ("&#65;&#x42", False, "AB"), ("&#0;&#x110000;&#xD800;", False, "���"), ("&#x80;", False, "€"), ("&#;&#x;&;&", False, "&#;&#x;&;&"), ("&nothing;", False, "¬hing;"), ("&zzz;", False, "&zzz;"),
    ],
)
def test_character_references(text, attribute, want):
    assert charrefs.decode(text, attribute) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/!-='\" abpscript&;#\n\0?[]CDAT"), max_size=60))
def test_never_fails(text):
    tk.tokenize(text)


def test_xml_coercion():
    assert short("a\fb", xml_coercion=True) == [("Character", "a b")]
    assert short("<!--a--b-->", xml_coercion=True) == [("Comment", "a- -b")]
    assert short("é﷐", xml_coercion=True) == [("Character", "é�")]
