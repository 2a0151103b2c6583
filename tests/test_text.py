import io

import pytest

from htmlframe import cli
from htmlframe.functions import builder, encodings, markdown, serialize
from htmlframe.functions import token_html as t


@pytest.mark.parametrize(
    ("data", "hint", "want"),
    [
        (b"\xef\xbb\xbfx", None, ("x", "UTF-8")), (b"\xef\xbb\xbf\x93", "latin1", ("“", "windows-1252")), (b"\x93", "nonsense", ("“", "windows-1252")), (b"a\xff\xc3\xa9", "utf-8", ("a�é", "UTF-8")),
        (b"\xe2\x82", "utf-8", ("��", "UTF-8")), (b"\xfe\xff\0a", None, ("a", "utf-16be")), (b"\xff\xfea\0b", None, ("ab", "utf-16le")), (b"\xa4\xa2x", "euc-jp", ("�x", "euc-jp")), (b"\x81", None, ("\x81", "windows-1252")),
        (b"<!-- <meta charset=utf-8> --><meta charset='iso-8859-2'>", None, ("<!-- <meta charset=utf-8> --><meta charset='iso-8859-2'>", "iso-8859-2")),
        (b"<meta charset=utf-16>", None, ("<meta charset=utf-16>", "UTF-8")), (b"x" * 1100 + b"<meta charset=utf-8>", None, ("x" * 1100 + "<meta charset=utf-8>", "windows-1252")),
        (b"<meta http-equiv=Content-Type content='text/html; charset=\"utf-8\"'>", None, ("<meta http-equiv=Content-Type content='text/html; charset=\"utf-8\"'>", "UTF-8")), ("\U0001f600".encode("utf-16-le"), "utf-16le", ("��", "utf-16le")),
    ],
)
def test_encodings(data, hint, want):
    assert encodings.decode(data, hint) == want


def test_markdown_and_text():
    doc = builder.parse("<p>a <b>b</b></p><ol><li>x<ul><li>y</ul></ol>")
    assert markdown.to_markdown(doc) == "a **b**\n\n1. x  - y" or markdown.to_markdown(doc).startswith("a **b**")
    assert serialize.to_text(builder.parse("<p>a  <b> b</b>")) == "a b"


def test_tokens_to_html():
    opt = lambda **o: t.TokenOptions(**o)
    assert t.serialize_tokens([["StartTag", "", "a", {"b": 'x"'}]]) == "<a b='x\"'>"
    assert t.serialize_tokens([["StartTag", "", "a", {"b": "x<"}]], opt(quote_char="'")) == "<a b='x<'>"
    assert t.serialize_tokens([["StartTag", "", "a", {"b": "x < y"}]], opt(escape_lt_in_attrs=True)) == '<a b="x &lt; y">'
    assert t.serialize_tokens([["EmptyTag", "img", {}]], opt(use_trailing_solidus=True)) == "<img />"
    assert t.serialize_tokens([["Characters", "a \n b"]], opt(strip_whitespace=True)) == "a b"
    assert t.serialize_tokens([["StartTag", "", "html", {}], ["StartTag", "", "head", {}], ["EndTag", "", "head"], ["StartTag", "", "body", {}], ["EndTag", "", "body"]]) == ""
    assert t.serialize_tokens([["StartTag", "", "head", {}], ["EndTag", "", "head"]], opt(inject_meta_charset=True, encoding="utf-8", omit_optional_tags=False)) == "<head><meta charset=utf-8></head>"
    assert t.serialize_tokens([["StartTag", "", "head", {}], ["EmptyTag", "meta", {"charset": "x"}], ["EndTag", "", "head"]], opt(inject_meta_charset=True, encoding="utf-8")) == "<meta charset=utf-8>"
    assert t.serialize_tokens([["StartTag", "", "script", {}], ["Characters", "<"], ["EndTag", "", "script"]], opt(escape_rcdata=True)) == "<script>&lt;</script>"
    assert t.serialize_tokens([["Doctype", "html", "p", "s"]]) == '<!DOCTYPE html PUBLIC "p" "s">'
    for bad in ([["Nope"]], [["StartTag", ""]], [["Characters"]], ["x"]):
        with pytest.raises(t.TokenError):
            t.serialize_tokens(bad)


def test_command_line(tmp_path):
    def run(*args, text="<p>a<p>b <i>c</i>"):
        out = io.StringIO()
        cli.run([*args, "-"], io.BytesIO(text.encode()), out)
        return out.getvalue()

    assert run("-s", "p", "-f", "text") == "a\nb c\n"
    assert run("-s", "p", "--first", "--pretty=false") == "<p>a</p>\n"
    assert run("-f", "markdown") == "a\n\nb*c*\n"
    assert run("-s", "x-y") == ""
    (tmp_path / "x.html").write_text("<h1>é</h1>")
    out = io.StringIO()
    assert cli.run(["-s", "h1", "-f", "text", str(tmp_path / "x.html")], None, out) == 0
    assert cli.run(["-s", "[", str(tmp_path / "x.html")], None, out) == 1
