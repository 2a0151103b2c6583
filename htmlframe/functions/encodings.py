"""Bytes to text: labels, byte order marks, the search for a meta element, and the decoders."""

from __future__ import annotations

import codecs
import re

# Labels of the encodings.
LABELS = {
    "UTF-8": "utf-8 utf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8",
    "windows-1252": "windows-1252 windows1252 cp1252 x-cp1252 ansi_x3.4-1968 ascii us-ascii iso-ir-100 csisolatin1 iso-8859-1 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 latin1 latin-1 l1 cp819 ibm819 utf-7 utf7 x-utf-7",
    "iso-8859-2": "iso-8859-2 iso8859-2 iso88592 iso_8859-2 iso_8859-2:1987 iso-ir-101 csisolatin2 latin2 latin-2 l2",
    "euc-jp": "euc-jp eucjp cseucpkdfmtjapanese x-euc-jp",
    "utf-16": "utf-16 utf16",
    "utf-16le": "utf-16le utf16le",
    "utf-16be": "utf-16be utf16be",
}
_BY_LABEL = {label: name for name, labels in LABELS.items() for label in labels.split()}
BOMS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
MOST_SEARCHED, MOST_BYTES = 1024, 65536
_SPACE = b"\t\n\f\r "


def by_label(label: str | None) -> str | None:
    """Canonical name of a label, None if it isn't known. Labels of ISO-8859-1 and of UTF-7 mean windows-1252."""
    return _BY_LABEL.get((label or "").strip().lower())


def _declared(label: bytes) -> str | None:
    name = by_label(label.decode("latin-1"))
    return "UTF-8" if name and name.startswith("utf-16") else name


def _in_content(value: bytes) -> bytes | None:
    m = re.search(rb"charset *(?:=) *(?:\"([^\"]*)\"|'([^']*)'|([^\"' ;][^ ;]*))", re.sub(rb"[\t\n\f\r ]", b" ", value).lower())
    first = re.sub(rb"[\t\n\f\r ]", b" ", value).lower().find(b"charset")
    if not m or m.start() != first:
        return None
    return next(g for g in m.groups() if g is not None)


_ATTRIBUTE = re.compile(rb"([^\t\n\f\r =></]*)[\t\n\f\r ]*(=?)")
_BARE = re.compile(rb"[^\t\n\f\r ><]*")


def _meta(data: bytes, at: int) -> tuple[dict[bytes, bytes], int]:
    """Attributes of a meta element from behind its name, and where it ends; -1 if it doesn't end."""
    found: dict[bytes, bytes] = {}
    n = len(data)
    while at < min(n, MOST_BYTES):
        c = data[at : at + 1]
        if c == b">":
            return found, at + 1
        if c == b"<":
            return found, -1
        if c in b"\t\n\f\r /":
            at += 1
            continue
        m = _ATTRIBUTE.match(data, at)
        name, value, at = m.group(1).lower(), b"", m.end() if m.end() > at else at + 1
        if m.group(2):
            while at < n and data[at : at + 1] in (b"\t", b"\n", b"\f", b"\r", b" "):
                at += 1
            if at >= n:
                break
            quote = data[at : at + 1]
            if quote in (b'"', b"'"):
                shut = data.find(quote, at + 1)
                if shut < 0:
                    return {}, -1
                value, at = data[at + 1 : shut], shut + 1
            else:
                v = _BARE.match(data, at)
                value, at = v.group(), v.end()
        found[name] = value
    return found, -1


def _tag_end(data: bytes, at: int, budget: int) -> int:
    """Where a tag ends that isn't looked into; quotes hide its end."""
    quote = 0
    stop = min(len(data), MOST_BYTES, at + budget)
    while at < stop:
        c = data[at]
        at += 1
        if quote:
            quote = 0 if c == quote else quote
        elif c in b"\"'":
            quote = c
        elif c == 0x3E:
            break
    return at


def prescan(data: bytes) -> str | None:
    """Encoding that a meta element declares in the first 1024 bytes; comments don't count as bytes."""
    at = seen = 0
    n = min(len(data), MOST_BYTES)
    while at < n and seen < MOST_SEARCHED:
        lt = data.find(b"<", at, min(n, at + MOST_SEARCHED - seen))
        if lt < 0:
            return None
        seen += lt - at
        at = lt
        if data.startswith(b"<!--", at):
            shut = data.find(b"-->", at + 4)
            if shut < 0:
                return None
            at = shut + 3
            continue
        m = re.compile(rb"</|<([a-zA-Z]+)").match(data, at)
        if not m:
            at, seen = at + 1, seen + 1
        elif m.group(1) is None or m.group(1).lower() != b"meta":
            end = _tag_end(data, at, MOST_SEARCHED - seen)
            seen += end - at
            at = end
        else:
            found, end = _meta(data, m.end())
            if end < 0:
                at, seen = at + 1, seen + 1
                continue
            name = _declared(found[b"charset"].strip(_SPACE)) if b"charset" in found else None
            if name is None and found.get(b"http-equiv", b"").lower() == b"content-type" and b"content" in found:
                label = _in_content(found[b"content"])
                name = _declared(label) if label is not None else None
            if name is not None:
                return name
            seen += end - at
            at = end
    return None


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    """One replacement character for each byte that doesn't fit."""
    return "�", error.start + 1


codecs.register_error("htmlframe-each-byte", _each_byte)
_CP1252 = {b: bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in range(0x80, 0xA0)}


def decode_as(data: bytes, name: str) -> str:
    """Text of bytes in an encoding named canonically."""
    if name == "UTF-8":
        return data.decode("utf-8", "htmlframe-each-byte")
    if name == "windows-1252":
        return data.decode("latin-1").translate(_CP1252)
    if name == "iso-8859-2":
        return data.decode("iso-8859-2")
    if name == "euc-jp":
        return re.sub(rb"[\x80-\xff]{1,2}", b"\x80", data).decode("latin-1").replace("\x80", "�")
    if name == "utf-16":
        for mark, order in BOMS[1:]:
            if data.startswith(mark):
                return decode_as(data[2:], order)
        name = "utf-16le"
    data = data + b"\0" if len(data) % 2 else data
    # surrogates aren't joined: each of them is one replacement character
    units = data.decode(name, "surrogatepass")
    return "".join(c if ord(c) < 0x10000 else "��" for c in units).translate({c: "�" for c in range(0xD800, 0xE000)}) if not units.isascii() else units


def decode(data: bytes, hint: str | None = None) -> tuple[str, str]:
    """(text, encoding): a hint that is known, else a byte order mark, else a meta element, else windows-1252."""
    mark = next(((m, n) for m, n in BOMS if data.startswith(m)), None)
    name = by_label(hint)
    if name or mark:
        return decode_as(data[len(mark[0]) :] if mark else data, name or mark[1]), name or mark[1]
    name = prescan(data) or "windows-1252"
    return decode_as(data, name), name
