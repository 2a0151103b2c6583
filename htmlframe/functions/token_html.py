"""HTML from a list of tokens in their JSON form.

Tokens: ["StartTag", namespace, name, attributes], ["EndTag", namespace, name], ["EmptyTag", name, attributes],
["Characters", text], ["Comment", text], ["Doctype", name, public?, system?]. Attributes are a list of
{namespace, name, value} or an object.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from htmlframe.functions.serialize import BLANKS, VOID, doctype, escape_text

RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
ENDS_P = frozenset(
    "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul datagrid".split()
)
#: An end tag may go before these start tags, and, where the flag says so, at the end of its parent.
ENDS = {
    "li": ({"li"}, True), "dt": ({"dt", "dd"}, False), "dd": ({"dt", "dd"}, True), "optgroup": ({"optgroup"}, True), "option": ({"option", "optgroup"}, True), "thead": ({"tbody", "tfoot"}, False),
    "tbody": ({"tbody", "tfoot"}, True), "tfoot": ({"tbody"}, True), "tr": ({"tr"}, True), "td": ({"td", "th"}, True), "th": ({"td", "th"}, True),
}


class TokenError(ValueError):
    """A token that isn't of a known form."""


@dataclass(frozen=True)
class TokenOptions:
    quote_char: str = '"'
    use_trailing_solidus: bool = False
    minimize_boolean_attributes: bool = True
    escape_lt_in_attrs: bool = False
    escape_rcdata: bool = False
    strip_whitespace: bool = False
    omit_optional_tags: bool = True
    inject_meta_charset: bool = False
    encoding: str = ""


_LEAST = {"StartTag": (3, "startTag needs at least 3 elements"), "EndTag": (3, "endTag needs at least 3 elements"), "EmptyTag": (2, "emptyTag needs at least 2 elements"), "Characters": (2, "characters token needs at least 2 elements"), "Comment": (2, "comment token needs at least 2 elements"), "Doctype": (2, "doctype token needs at least 2 elements")}


def _info(tokens: list, i: int) -> tuple[str, str]:
    if not 0 <= i < len(tokens) or not isinstance(tokens[i], list) or not tokens[i] or not isinstance(tokens[i][0], str):
        return "", ""
    t = tokens[i]
    at = 2 if t[0] in ("StartTag", "EndTag") else 1 if t[0] == "EmptyTag" else 99
    return t[0], t[at] if at < len(t) and isinstance(t[at], str) else ""


def _attributes(t: list) -> list[tuple[str, str]]:
    at = 3 if t[0] == "StartTag" else 2
    raw = t[at] if len(t) > at else None
    if isinstance(raw, list):
        return [(a.get("name", ""), a.get("value", "")) for a in raw]
    return list(raw.items()) if isinstance(raw, dict) else []


def _charset(attrs: list[tuple[str, str]]) -> bool:
    return any(k.lower() == "charset" or k.lower() == "http-equiv" and v.lower() == "content-type" for k, v in attrs)


def _with_encoding(attrs: list[tuple[str, str]], encoding: str) -> list[tuple[str, str]]:
    names = [k.lower() for k, _ in attrs]
    if "charset" in names:
        i = names.index("charset")
        return [*attrs[:i], (attrs[i][0], encoding), *attrs[i + 1 :]]
    if any(k == "http-equiv" and v.lower() == "content-type" for k, (_, v) in zip(names, attrs, strict=True)):
        content = f"text/html; charset={encoding}"
        if "content" not in names:
            return [*attrs, ("content", content)]
        return [(k, content if k.lower() == "content" else v) for k, v in attrs]
    return attrs


def _value(name: str, value: str, o: TokenOptions) -> str:
    if o.minimize_boolean_attributes and value in ("", name):
        return ""
    if not value:
        return '=""'
    if o.quote_char == "'":
        return "='" + value.replace("&", "&amp;").replace("'", "&#39;") + "'"
    if not re.search("[ \t\n\f\r\"'=>`]", value):
        return "=" + value
    safe = value.replace("&", "&amp;")
    if '"' in value and "'" not in value:
        return f"='{safe}'"
    safe = safe.replace('"', "&quot;")
    return '="' + (safe.replace("<", "&lt;") if o.escape_lt_in_attrs else safe) + '"'


def serialize_tokens(tokens: list, options: TokenOptions | None = None) -> str:
    """HTML of tokens. Raises TokenError for tokens of an unknown form."""
    o = options or TokenOptions()
    inject = o.inject_meta_charset and bool(o.encoding)
    out: list[str] = []
    raw = kept = 0
    for i, t in enumerate(tokens):
        if not isinstance(t, list):
            raise TokenError("invalid token format")
        if not t:
            continue
        kind = t[0]
        if kind not in _LEAST:
            raise TokenError(f"unknown token type: {kind}")
        if len(t) < _LEAST[kind][0]:
            raise TokenError(_LEAST[kind][1])
        after, name_after = _info(tokens, i + 1)
        blank = after == "Characters" and bool(tokens[i + 1][1][:1].strip(BLANKS) == "" and tokens[i + 1][1])
        if kind in ("StartTag", "EmptyTag"):
            name, attrs = _info(tokens, i)[1], _attributes(t)
            if kind == "EmptyTag" or not (o.omit_optional_tags and not attrs and _start_may_go(name, after, name_after, blank, _info(tokens, i - 1))):
                if inject and name == "meta":
                    attrs = _with_encoding(attrs, o.encoding)
                solidus = o.use_trailing_solidus and (kind == "EmptyTag" or name in VOID)
                out.append(f"<{name}" + "".join(f" {k}{_value(k, v, o)}" for k, v in sorted(attrs, key=lambda a: a[0])) + (" />" if solidus else ">"))
            if kind == "StartTag":
                kept += name in ("pre", "textarea")
                raw += name in RAW
                if name == "head" and inject and not _charset_ahead(tokens, i):
                    out.append(f"<meta charset{_value('charset', o.encoding, o)}>")
        elif kind == "EndTag":
            name = _info(tokens, i)[1]
            if not (o.omit_optional_tags and _end_may_go(name, after, name_after, blank)):
                out.append(f"</{name}>")
            kept -= kept > 0 and name in ("pre", "textarea")
            raw -= raw > 0 and name in RAW
        elif kind == "Characters":
            data = re.sub("[ \t\n\r\f]+", " ", t[1]) if o.strip_whitespace and not raw and not kept else t[1]
            out.append(data if raw and not o.escape_rcdata else escape_text(data))
        elif kind == "Comment":
            out.append(f"<!--{t[1]}-->")
        else:
            out.append(doctype(t[1], t[2] if len(t) > 2 else "", t[3] if len(t) > 3 else ""))
    return "".join(out)


def _charset_ahead(tokens: list, i: int) -> bool:
    for k in range(i + 1, len(tokens)):
        kind, name = _info(tokens, k)
        if not kind or (kind, name) == ("EndTag", "head"):
            return False
        if name == "meta" and kind != "EndTag" and _charset(_attributes(tokens[k])):
            return True
    return False


def _start_may_go(name: str, after: str, name_after: str, blank: bool, before: tuple[str, str]) -> bool:
    if name in ("html", "body"):
        return after != "Comment" and not blank
    if name == "head":
        return after in ("StartTag", "EmptyTag", "EndTag")
    if name == "colgroup":
        return after in ("StartTag", "EmptyTag") and name_after == "col"
    return name == "tbody" and (after, name_after) == ("StartTag", "tr") and before == ("StartTag", "table")


def _end_may_go(name: str, after: str, name_after: str, blank: bool) -> bool:
    if name in ("html", "head", "body", "colgroup"):
        return after != "Comment" and not blank and not (name == "colgroup" and (after, name_after) == ("StartTag", "colgroup"))
    if name == "p":
        return after in ("", "EndTag") or after in ("StartTag", "EmptyTag") and name_after in ENDS_P
    if name not in ENDS:
        return False
    names, at_end = ENDS[name]
    return at_end and after in ("", "EndTag") or after == "StartTag" and name_after in names
