"""Character references, decoded in one pass over a finished run of text or an attribute value."""

from __future__ import annotations

import re
from html.entities import html5

_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_LEGACY = {k: v for k, v in html5.items() if not k.endswith(";")}
_LONGEST = max(map(len, _LEGACY))
_REFERENCE = re.compile(r"&(?:#(?:[xX]([0-9a-fA-F]*)|([0-9]*))(;?)|([^\W_]+)(;?))")
#: Bytes 80 to 9F stand for windows-1252 characters; U+0000 is replaced.
_NUMBERS = {0: "�"} | {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _number(digits: str, base: int) -> str:
    n = int(digits, base)
    if n in _NUMBERS:
        return _NUMBERS[n]
    return "�" if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)


def _prefix(name: str) -> str:
    """The longest legacy name that a name begins with."""
    for n in range(min(len(name), _LONGEST), 1, -1):
        if name[:n] in _LEGACY:
            return name[:n]
    return ""


def decode(text: str, attribute: bool = False) -> str:
    """Text with its references decoded. In attributes a name without semicolon counts only where no letter, digit or
    equals sign follows. References that name nothing stay as they are."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        hexa, number, _, name, end = m.groups()
        if name is None:
            digits = hexa if hexa is not None else number
            return _number(digits, 16 if hexa is not None else 10) if digits else m.group()
        if end and name in _NAMED:
            return _NAMED[name]
        if name in _LEGACY and not end:
            return m.group() if attribute and text[m.end() : m.end() + 1] == "=" else _LEGACY[name]
        known = "" if attribute else _prefix(name)
        return _LEGACY[known] + name[len(known) :] + end if known else m.group()

    return _REFERENCE.sub(one, text)
