import time

import pytest

from htmlframe.functions import builder
from htmlframe.functions import selectors as s

PAGE = builder.parse(
    '<!doctype html><title>t</title><body><div id=a class="x y" data-k="v w"><p lang=en-US>1</p><p class=Z>2<b>3</b></p><span></span></div>'
    '<div id=b><p>4</p><i> </i><em><!--c--></em></div><svg><linearGradient id=g></linearGradient><a xlink:href=u></a></svg>'
)


def ids(selector, semantics="compat"):
    return [n.name + ("#" + n.id if n.id else "") for n in s.select(PAGE, selector, semantics)]


@pytest.mark.parametrize(
    ("selector", "want"),
    [
        ("p", ["p", "p", "p"]), ("P", ["p", "p", "p"]), ("#a", ["div#a"]), (".x.y", ["div#a"]), (".z", []), (".Z", ["p"]), ("[data-k]", ["div#a"]), ("[DATA-K~=w]", ["div#a"]), ("[data-k='v w']", ["div#a"]),
        ("[lang|=en]", ["p"]), ("[id^=a], [id$=b]", ["div#a", "div#b"]), ("[data-k*=' ']", ["div#a"]), ("[data-k^='']", []), ("p:first-child", ["p", "p"]), ("p:last-child", []), ("b:only-child", ["b"]),
        ("div:nth-of-type(2)", ["div#b"]), ("div > p + p", ["p"]), ("div > p ~ span", ["span"]), ("div b", ["b"]), (":root", ["html"]), ("i:empty, em:empty, span:empty", ["span", "i", "em"]),
        ("p:not(:first-child)", ["p"]), ("div:not(#a, .x)", ["div#b"]), ("p:not([lang='x y'])", []), ("lineargradient", []), ("[xlink\\:href]", []), ("p:hover", []), ("div:nth-child(n+2):nth-child(-n+2)", ["div#b"]),
        ("p:nth-child(2n + 1)", ["p", "p"]), ("p:nth-child(x)", []), ("p:not", ["p", "p", "p"]), ("*:not(p b", None), ("body > div", ["div#a", "div#b"]),
    ],
)
def test_matches(selector, want):
    if want is not None:
        assert ids(selector) == want
        assert ids(selector, "css") == want
    else:
        s.parse(selector)


@pytest.mark.parametrize("selector", ["", "  ", "[", "[a", "[a=", "[=x]", "#", ".", ":", "p >", "> p", "p,,q", "p,", "[a='x]", "[a=v i]", "ns|p", "p::before", "a^b", "p $", "[href=#x]", "(p)", "p)"])
def test_errors(selector):
    with pytest.raises(s.SelectorError):
        s.parse(selector)


def test_nearest_ancestor():
    doc = builder.parse("<x-a><y-b><y-b><z-c>")
    assert s.select(doc, "x-a > y-b z-c") == []
    assert [n.name for n in s.select(doc, "x-a > y-b z-c", "css")] == ["z-c"]


def test_nth():
    assert [s.nth(x) for x in ("odd", "even", "3", "n", "-n+3", "2n-1", "+2n", "x", "2n+", "")] == [(2, 1), (2, 0), (0, 3), (1, 0), (-1, 3), (2, -1), (2, 0), None, None, None]


def test_first_and_templates():
    doc = builder.parse("<p>1<p>2<template><p>3</template>")
    assert len(s.select(doc, "p")) == 2 and len(s.select(doc, "p", first=True)) == 1


def test_siblings_and_depth_grow_in_proportion():
    """Twice the items take about twice the time, not four times."""

    def took(n):
        begin = time.thread_time()
        builder.parse("<div>" * n)
        doc = builder.parse("<ul>" + "<li>x" * n)
        for q in ("li + li", "li ~ li ~ li", "ul ~ li"):
            for semantics in ("compat", "css"):
                s.select(doc, q, semantics)
        return time.thread_time() - begin

    assert min(took(8000) for _ in range(2)) < 10 * min(took(2000) for _ in range(2))
