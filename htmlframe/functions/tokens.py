"""Tokens of an HTML text.

The tokenizer moves in spans: a text run reaches to the next "<", a tag is read by a few expressions, and the raw modes
search for their end tag. A tree builder may change the mode between tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from htmlframe.functions.charrefs import decode

DATA, RCDATA, RAWTEXT, SCRIPT, PLAINTEXT, CDATA = "data", "rcdata", "rawtext", "script", "plaintext", "cdata"
START, END, TEXT, COMMENT, DOCTYPE, EOF = "StartTag", "EndTag", "Character", "Comment", "DOCTYPE", "EOF"

#: The mode that a start tag switches to.
SWITCHES = {"title": RCDATA, "textarea": RCDATA, "script": SCRIPT, "style": RAWTEXT, "xmp": RAWTEXT, "iframe": RAWTEXT, "noembed": RAWTEXT, "noframes": RAWTEXT, "plaintext": PLAINTEXT}

# Messages of the error codes that have one.
MESSAGES = {
    "abrupt-closing-of-empty-comment": "This error occurs if the parser encounters an empty comment that is abruptly closed by a U+003E (>) code point.",
    "abrupt-doctype-public-identifier": "This error occurs if the parser encounters a U+003E (>) code point in the DOCTYPE public identifier.",
    "abrupt-doctype-system-identifier": "This error occurs if the parser encounters a U+003E (>) code point in the DOCTYPE system identifier.",
    "absence-of-digits-in-numeric-character-reference": "This error occurs if the parser encounters a numeric character reference that doesn't contain any digits.",
    "cdata-in-html-content": "This error occurs if the parser encounters a CDATA section outside of foreign content (SVG or MathML).",
    "character-reference-outside-unicode-range": "This error occurs if the parser encounters a numeric character reference that references a code point greater than U+10FFFF.",
    "control-character-in-input-stream": "This error occurs if the input stream contains a control character other than ASCII whitespace or U+0000 NULL.",
    "control-character-reference": "This error occurs if the parser encounters a numeric character reference that references a control character.",
    "duplicate-attribute": "This error occurs if the parser encounters an attribute with the same name as an earlier attribute on the same tag.",
    "end-tag-with-attributes": "This error occurs if the parser encounters an end tag with attributes.",
    "end-tag-with-trailing-solidus": "This error occurs if the parser encounters an end tag with a trailing solidus (/).",
    "eof-before-tag-name": "This error occurs if the parser encounters EOF where a tag name is expected.",
    "eof-in-cdata": "This error occurs if the parser encounters EOF in a CDATA section.",
    "eof-in-comment": "This error occurs if the parser encounters EOF in a comment.",
    "eof-in-doctype": "This error occurs if the parser encounters EOF in a DOCTYPE.",
    "eof-in-script-html-comment-like-text": "This error occurs if the parser encounters EOF in a script element in an HTML comment-like text.",
    "eof-in-tag": "This error occurs if the parser encounters EOF in a tag.",
    "incorrectly-closed-comment": "This error occurs if the parser encounters an incorrectly closed comment.",
    "incorrectly-opened-comment": "This error occurs if the parser encounters an incorrectly opened comment.",
    "invalid-character-sequence-after-doctype-name": "This error occurs if the parser encounters an invalid character sequence after a DOCTYPE name.",
    "invalid-first-character-of-tag-name": "This error occurs if the parser encounters an invalid first character of a tag name.",
    "missing-attribute-value": "This error occurs if the parser encounters an attribute name not followed by an attribute value.",
    "missing-doctype-name": "This error occurs if the parser encounters a DOCTYPE without a name.",
    "missing-doctype-public-identifier": "This error occurs if the parser encounters a DOCTYPE with a missing public identifier.",
    "missing-doctype-system-identifier": "This error occurs if the parser encounters a DOCTYPE with a missing system identifier.",
    "missing-end-tag-name": "This error occurs if the parser encounters a missing end tag name.",
    "missing-quote-before-doctype-public-identifier": "This error occurs if the parser encounters a DOCTYPE public identifier without a leading quote.",
    "missing-quote-before-doctype-system-identifier": "This error occurs if the parser encounters a DOCTYPE system identifier without a leading quote.",
    "missing-semicolon-after-character-reference": "This error occurs if the parser encounters a character reference not terminated by a semicolon.",
    "missing-whitespace-after-doctype-public-keyword": "This error occurs if the parser encounters a DOCTYPE with missing whitespace after the PUBLIC keyword.",
    "missing-whitespace-after-doctype-system-keyword": "This error occurs if the parser encounters a DOCTYPE with missing whitespace after the SYSTEM keyword.",
    "missing-whitespace-before-doctype-name": "This error occurs if the parser encounters a DOCTYPE without whitespace before the name.",
    "missing-whitespace-between-attributes": "This error occurs if the parser encounters a missing whitespace between attributes.",
    "missing-whitespace-between-doctype-public-and-system-identifiers": "This error occurs if the parser encounters a DOCTYPE with missing whitespace between public and system identifiers.",
    "nested-comment": "This error occurs if the parser encounters a nested comment.",
    "noncharacter-character-reference": "This error occurs if the parser encounters a numeric character reference that references a noncharacter.",
    "noncharacter-in-input-stream": "This error occurs if the input stream contains a noncharacter.",
    "non-void-html-element-start-tag-with-trailing-solidus": "This error occurs if the parser encounters a non-void HTML element start tag with a trailing solidus.",
    "null-character-reference": "This error occurs if the parser encounters a numeric character reference that references U+0000 NULL.",
    "surrogate-character-reference": "This error occurs if the parser encounters a numeric character reference that references a surrogate.",
    "surrogate-in-input-stream": "This error occurs if the input stream contains a surrogate.",
    "unexpected-character-after-doctype-system-identifier": "This error occurs if the parser encounters an unexpected character after a DOCTYPE system identifier.",
    "unexpected-character-in-attribute-name": "This error occurs if the parser encounters an unexpected character in an attribute name.",
    "unexpected-character-in-unquoted-attribute-value": "This error occurs if the parser encounters an unexpected character in an unquoted attribute value.",
    "unexpected-equals-sign-before-attribute-name": "This error occurs if the parser encounters an equals sign before an attribute name.",
    "unexpected-null-character": "This error occurs if the parser encounters an unexpected null character.",
    "unexpected-question-mark-instead-of-tag-name": "This error occurs if the parser encounters a question mark instead of a tag name.",
    "unexpected-solidus-in-tag": "This error occurs if the parser encounters an unexpected solidus in a tag.",
    "unknown-named-character-reference": "This error occurs if the parser encounters an unknown named character reference.",
}

_SPACES = re.compile(r"[\t\n\f ]*")
_TAG_NAME = re.compile(r"[^\t\n\f />]*")
_ATTRIBUTE_NAME = re.compile(r"[^\t\n\f />=]*")
_UNQUOTED = re.compile(r"[^\t\n\f >]*")
_COMMENT_END = re.compile(r"--!?>")
_COMMENT_REST = re.compile(r"(?:--!?|-)\Z")
_BAD_UNQUOTED = re.compile("[\"'<=`]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_RAW_END = {n: re.compile(rf"</({n})(?=[\t\n\f\r />])", re.I | re.A) for n in SWITCHES}
_NONCHARACTERS = re.compile("[﷐-﷯]|[" + "".join(chr(p << 16 | 0xFFFE) + chr(p << 16 | 0xFFFF) for p in range(17)) + "]")
_LETTERS = re.compile(r"[^\W\d_]*")


class Token:
    """One token. Unused fields keep their defaults."""

    __slots__ = ("kind", "name", "attrs", "self_closing", "data", "public_id", "system_id", "force_quirks", "cut_off")

    def __init__(self, kind, name="", attrs=(), self_closing=False, data="", public_id=None, system_id=None, force_quirks=False, cut_off=False):
        self.kind, self.name, self.attrs, self.self_closing, self.data = kind, name, attrs, self_closing, data
        self.public_id, self.system_id, self.force_quirks, self.cut_off = public_id, system_id, force_quirks, cut_off


def coerce_text(text: str) -> str:
    """Text as XML can hold it."""
    text = text.replace("\f", " ")
    return text if text.isascii() else _NONCHARACTERS.sub("�", text)


class Tokenizer:
    """Iterator over tokens, the last one EOF. mode, raw_name and allow_cdata may be set between tokens."""

    def __init__(self, text: str, discard_bom: bool = True, xml_coercion: bool = False):
        if discard_bom and text.startswith("﻿"):
            text = text[1:]
        self.text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        self.at, self.mode, self.raw_name, self.last_start = 0, DATA, "", ""
        self.carry, self.allow_cdata, self.coerce = "", False, xml_coercion
        self.flaws: list[tuple[str, int]] = []
        self.waiting: list[Token] = []

    # errors are kept as offsets; lines and columns are worked out when somebody asks
    def flaw(self, code: str, at: int) -> None:
        self.flaws.append((code, at))

    def errors(self) -> list[tuple[str, str, int, int]]:
        """(code, message, line, column) of each error; lines and columns count from 1, and an error at the end of the text
        stands at its last character."""
        out, line, begin, seen = [], 1, -1, 0
        for code, at in sorted(self.flaws, key=lambda f: f[1]):
            at = min(at, len(self.text))
            line += self.text.count("\n", seen, at)
            last = self.text.rfind("\n", seen, at)
            begin, seen = (last if last >= 0 else begin), max(seen, at)
            out.append((code, MESSAGES.get(code, "Unknown error"), line, max(1, min(at, len(self.text) - 1) - begin)))
        return out

    def switch(self, mode: str, name: str = "") -> None:
        """Set the mode, with the name that its end tag must have."""
        self.mode = mode
        if name:
            self.last_start = self.raw_name = name

    def __iter__(self) -> Iterator[Token]:
        while True:
            token = self.next()
            yield token
            if token.kind == EOF:
                return

    def next(self) -> Token:
        if self.waiting:
            return self.waiting.pop(0)
        while True:
            token = getattr(self, "_" + self.mode)()
            if token is not None:
                return token

    def _run(self, text: str, references: bool) -> Token:
        if references:
            text = decode(text)
        return Token(TEXT, data=coerce_text(text) if self.coerce else text)

    def _nulls(self, text: str, at: int) -> str:
        if "\0" not in text:
            return text
        for i, c in enumerate(text):
            if c == "\0":
                self.flaw("unexpected-null-character", at + i)
        return text.replace("\0", "�")

    def _end(self) -> Token:
        self.at = len(self.text)
        return Token(EOF)

    # -- data

    def _data(self) -> Token | None:
        text, at = self.text, self.at
        lt = text.find("<", at)
        stop = lt if lt >= 0 else len(text)
        if stop > at or self.carry:
            run, self.carry, self.at = self.carry + text[at:stop], "", stop
            self._nulls(text[at:stop], at)
            return self._run(run, True)
        if lt < 0:
            return self._end()
        c = text[lt + 1 : lt + 2]
        if c.isascii() and c.isalpha():
            return self._tag(START, lt + 1)
        if c == "/":
            d = text[lt + 2 : lt + 3]
            if d.isascii() and d.isalpha():
                return self._tag(END, lt + 2)
            if not d:
                self.flaw("eof-before-tag-name", lt + 2)
                self.at = len(text)
                return self._run("</", False)
            if d == ">":
                self.flaw("empty-end-tag", lt + 2)
                self.at = lt + 3
                return None
            self.flaw("invalid-first-character-of-tag-name", lt + 2)
            return self._bogus(lt + 2)
        if c == "!":
            return self._declaration(lt + 2)
        if c == "?":
            self.flaw("unexpected-question-mark-instead-of-tag-name", lt + 1)
            return self._bogus(lt + 1)
        self.carry = "<"
        self.at = lt + 1
        self.flaw("invalid-first-character-of-tag-name" if c else "eof-before-tag-name", lt + 1)
        return None

    def _tag(self, kind: str, at: int) -> Token:
        m = _TAG_NAME.match(self.text, at)
        name = self._nulls(m.group(), at).translate(_LOWER)
        return self._attributes(kind, name, m.end())

    def _attributes(self, kind: str, name: str, at: int) -> Token:
        """The rest of a tag from the end of its name."""
        text, size = self.text, len(self.text)
        attrs: list[tuple[str, str]] = []
        seen: set[str] = set()
        closing = reset = False

        def keep(key: str, value: str, where: int) -> None:
            if key in seen:
                self.flaw("duplicate-attribute", where)
            else:
                seen.add(key)
                attrs.append((key, decode(value, True)))

        while True:
            at = _SPACES.match(text, at).end()
            if at >= size:
                break
            c = text[at]
            if c == ">":
                break
            if c == "/":
                if text[at + 1 : at + 2] == ">":
                    closing, at = True, at + 1
                    break
                at += 1
                if at < size:
                    self.flaw("unexpected-character-after-solidus-in-tag", at)
                continue
            if c == "=":
                self.flaw("unexpected-equals-sign-before-attribute-name", at)
            m = _ATTRIBUTE_NAME.match(text, at + 1)
            for i in range(at + 1, m.end()):
                if text[i] in "\"'<":
                    self.flaw("unexpected-character-in-attribute-name", i)
            key = self._nulls(text[at : m.end()], at).translate(_LOWER)
            at = m.end()
            if text[at : at + 1] != "=":
                if at >= size:
                    break
                keep(key, "", at)
                after = _SPACES.match(text, at).end()
                if after == at or text[after : after + 1] != "=":
                    at = after
                    continue
                # an equals sign after white space: the attribute is complete already, and the value goes to nobody
                key, at = "", after
            at = _SPACES.match(text, at + 1).end()
            if at >= size:
                break
            quote = text[at]
            if quote == ">":
                self.flaw("missing-attribute-value", at)
                if key:
                    keep(key, "", at)
                break
            if quote in "\"'":
                shut = text.find(quote, at + 1)
                value = self._nulls(text[at + 1 : shut if shut >= 0 else size], at + 1)
                if shut < 0 or shut + 1 >= size:
                    at = size
                    break
                at = shut + 1
                if text[at] not in "\t\n\f />":
                    self.flaw("missing-whitespace-between-attributes", at)
            else:
                m = _UNQUOTED.match(text, at)
                for bad in _BAD_UNQUOTED.finditer(text, at, m.end()):
                    self.flaw("unexpected-character-in-unquoted-attribute-value", bad.start())
                value = self._nulls(m.group(), at)
                at = m.end()
                if at >= size:
                    break
                reset = text[at] == ">"
            if key:
                keep(key, value, at)
        if at >= size:
            self.flaw("eof-in-tag", size)
            return self._end()
        self.at, self.mode = at + 1, DATA
        if kind == START:
            self.last_start = name
            if name in SWITCHES:
                self.raw_name = name
                if not reset:  # a tag that ends in an unquoted value goes back to data
                    self.mode = SWITCHES[name]
        return Token(kind, name, attrs, closing)

    # -- declarations and comments

    def _declaration(self, at: int) -> Token | None:
        text = self.text
        if text.startswith("--", at):
            return self._comment(at + 2)
        if text[at : at + 7].lower() == "doctype":
            return self._doctype(at + 7)
        if text.startswith("[CDATA[", at):
            if self.allow_cdata:
                self.at, self.mode = at + 7, CDATA
                return None
            self.flaw("cdata-in-html-content", at + 6)
        else:
            self.flaw("incorrectly-opened-comment", at - 1)
        return self._bogus(at)

    def _said(self, data: str, cut_off: bool = False) -> Token:
        return Token(COMMENT, data=data.replace("--", "- -") if self.coerce else data, cut_off=cut_off)

    def _bogus(self, at: int) -> Token:
        stop = self.text.find(">", at)
        data = self.text[at : stop if stop >= 0 else len(self.text)].replace("\0", "�")
        self.at = stop + 1 if stop >= 0 else len(self.text)
        return self._said(data, stop < 0)

    def _comment(self, at: int) -> Token:
        text = self.text
        for short in (">", "->"):
            if text.startswith(short, at):
                self.at = at + len(short)
                self.flaw("abrupt-closing-of-empty-comment", self.at - 1)
                return self._said("")
        m = _COMMENT_END.search(text, at)
        stop = m.start() if m else len(text)
        data = self._nulls(text[at:stop], at)
        for k in re.finditer(r"--(?![->!\0])(?=.)", data, re.S):
            self.flaw("incorrectly-closed-comment", at + k.end())
        if m:
            if "!" in m.group():
                self.flaw("incorrectly-closed-comment", m.end() - 1)
            self.at = m.end()
        else:
            self.flaw("eof-in-comment", len(text))
            data, self.at = _COMMENT_REST.sub("", data), len(text)
        return self._said(data)

    def _doctype(self, at: int) -> Token:
        text, size = self.text, len(self.text)
        name, ids = "", {"public": None, "system": None}
        quirks = False

        def done(at: int, code: str = "", force: bool = True) -> Token:
            """The token; at is where ">" is or the end of the text."""
            if code:
                self.flaw(code, at)
            self.at = min(at + 1, size)
            return Token(DOCTYPE, name, public_id=ids["public"], system_id=ids["system"], force_quirks=quirks or bool(code) and force)

        def bogus(at: int, code: str, force: bool = True) -> Token:
            nonlocal quirks
            self.flaw(code, at)
            quirks = quirks or force
            stop = text.find(">", at)
            return done(stop if stop >= 0 else size)

        if at >= size:
            return done(size, "eof-in-doctype")
        if text[at] not in "\t\n\f >":
            self.flaw("missing-whitespace-before-doctype-name", at)
        at = _SPACES.match(text, at).end()
        if at >= size:
            return done(size, "eof-in-doctype-name")
        if text[at] == ">":
            return done(at, "expected-doctype-name-but-got-right-bracket")
        begin = at
        while at < size and (text[at] not in "\t\n\f >" or at == begin):
            at += 1
        name = self._nulls(text[begin:at], begin).translate(_LOWER)
        if at >= size:
            return done(size, "eof-in-doctype-name")
        if text[at] == ">":
            return done(at)
        at += 1
        keyword = text[at : at + 6].lower()
        if keyword not in ("public", "system"):
            at = _SPACES.match(text, at).end()
            if at >= size:
                return done(size, "eof-in-doctype")
            return done(at) if text[at] == ">" else bogus(at, "missing-whitespace-after-doctype-name")
        at += 6
        for which in ("public", "system") if keyword == "public" else ("system",):
            later = which == "system" and keyword == "public"
            if at >= size:
                return done(size, "eof-in-doctype" if later else f"missing-quote-before-doctype-{which}-identifier")
            spaced = _SPACES.match(text, at).end()
            if spaced >= size:
                return done(size, "eof-in-doctype")
            c = text[spaced]
            if c == ">":
                return done(spaced) if later else done(spaced, f"missing-doctype-{which}-identifier")
            if c not in "\"'":
                return bogus(spaced, f"missing-quote-before-doctype-{which}-identifier" if later or spaced > at else f"unexpected-character-after-doctype-{which}-keyword")
            if spaced == at:
                self.flaw("missing-whitespace-between-doctype-public-and-system-identifiers" if later else "missing-whitespace-before-doctype-public-identifier" if which == "public" else "missing-whitespace-after-doctype-public-identifier", at)
            at = spaced + 1
            m = re.compile(f"[^{c}>]*").match(text, at)
            ids[which] = self._nulls(m.group(), at)
            at = m.end()
            if at >= size:
                return done(size, "eof-in-doctype")
            if text[at] == ">":
                return done(at, f"abrupt-doctype-{which}-identifier")
            at += 1
        at = _SPACES.match(text, at).end()
        if at >= size:
            return done(size, "eof-in-doctype")
        return done(at) if text[at] == ">" else bogus(at, "unexpected-character-after-doctype-system-identifier", False)

    # -- raw modes

    def _cdata(self) -> Token | None:
        stop = self.text.find("]]>", self.at)
        data = self.text[self.at : stop if stop >= 0 else len(self.text)]
        self.mode = DATA
        if stop < 0:
            self.flaw("eof-in-cdata", len(self.text))
        self.at = stop + 3 if stop >= 0 else len(self.text)
        return self._run(data, False) if data else None

    def _plaintext(self) -> Token:
        at = self.at
        if at >= len(self.text):
            return self._end()
        self.at = len(self.text)
        return self._run(self._nulls(self.text[at:], at), False)

    def _raw(self, references: bool) -> Token:
        at = self.at
        end = _RAW_END.get(self.raw_name) or re.compile(rf"</({re.escape(self.raw_name)})(?=[\t\n\f\r />])", re.I | re.A)
        m = end.search(self.text, at) if self.raw_name else None
        return self._raw_until(self._nulls(self.text[at : m.start() if m else len(self.text)], at), m, references)

    def _raw_until(self, data: str, m: re.Match | None, references: bool) -> Token:
        if m is None:
            self.at = len(self.text)
            return self._run(data, references) if data else self._end()
        self.mode = DATA
        tag = self._attributes(END, m.group(1).lower(), m.end())
        if not data:
            return tag
        self.waiting.append(tag)
        return self._run(data, references)

    def _rcdata(self) -> Token:
        return self._raw(True)

    def _rawtext(self) -> Token:
        return self._script() if self.raw_name == "script" else self._raw(False)

    def _script(self) -> Token:
        """Script text: plain until "<!--", then escaped until "-->", doubly escaped within an inner script."""
        text, at, size = self.text, self.at, len(self.text)
        end = _RAW_END["script"]
        if "<!--" not in text[at:]:
            return self._raw(False)
        out: list[str] = []
        level = 0

        def take(stop: int) -> None:
            nonlocal at
            out.append(self._nulls(text[at:stop], at))
            at = stop

        while True:
            lt = text.find("<", at)
            dashes = re.compile("--+>").search(text, at, lt if lt >= 0 else size) if level else None
            if dashes:
                take(dashes.end())
                level = 0
                continue
            if lt < 0:
                take(size)
                return self._raw_until("".join(out), None, False)
            m = end.match(text, lt)
            if level == 0:
                if m:
                    take(lt)
                    return self._raw_until("".join(out), m, False)
                level = int(text.startswith("<!--", lt))
                take(lt + (4 if level else 1))
                continue
            take(lt)
            if level == 1:
                if text.endswith("--", 0, lt) and not text.endswith("<!--", 0, lt):
                    out.append("<")  # after two dashes the sign is kept twice
                if m:
                    return self._raw_until("".join(out), m, False)
                word = _LETTERS.match(text, lt + 1)
                take(max(word.end(), lt + 1))
                if word.group().lower() == "script" and text[at : at + 1] in tuple(" \t\n\r\f/>"):
                    level = 2
            else:
                word = _LETTERS.match(text, lt + 2) if text.startswith("</", lt) else None
                take(word.end() if word else lt + 1)
                if word and word.group().lower() == "script" and text[at : at + 1] in tuple(" \t\n\r\f/>"):
                    level = 1


def tokenize(text: str, mode: str = DATA, last_start: str = "", **options) -> tuple[list[Token], list[tuple[str, str, int, int]]]:
    """All tokens but EOF, adjacent texts as they come, and the errors."""
    t = Tokenizer(text, **options)
    t.switch(mode, last_start)
    out = [x for x in t if x.kind != EOF]
    return out, t.errors()
