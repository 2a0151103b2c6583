"""CSS selectors: one parser on the driver, one matcher over in-memory trees.

A selector list is a tuple of chains; a chain is a tuple of (combinator, compound) from left to right, the first one with
the combinator ''; a compound is a tuple of Simple. The matcher has two semantics. "compat" goes from right to left and
fixes the nearest ancestor or sibling that matches, without coming back; "css" tries them all.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from htmlframe.functions.tree import ELEMENT, FRAGMENT, TEXT, Document, Node

PSEUDO_FLAGS = ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type", "empty", "root")
PSEUDO_NTH = ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")


class SelectorError(ValueError):
    """A selector that can't be parsed. position: an offset in the text, or, after it was split, a token's number."""

    def __init__(self, selector: str, position: int, message: str):
        super().__init__(f'invalid selector "{selector}" at position {position}: {message}')
        self.selector, self.position, self.message = selector, position, message


@dataclass(frozen=True)
class Simple:
    """kind: tag, universal, id, class, attr or pseudo. op: how an attribute's value is compared, '' for existence."""

    kind: str
    name: str
    op: str = ""
    value: str = ""


Compound = tuple[Simple, ...]
Chain = tuple[tuple[str, Compound], ...]

_BLANKS = " \t\n\r\f"


def _name_char(c: str) -> bool:
    return c.isalpha() or c.isdigit() or c in "_-" or ord(c) > 127


class _Lexer:
    """Splits a selector into (type, value). What a character means depends on where it stands."""

    def __init__(self, text: str):
        self.text, self.at, self.out = text, 0, []
        self.attr = self.named = self.compared = self.valued = False
        self.depth, self.simple = 0, False

    def fail(self, message: str) -> SelectorError:
        return SelectorError(self.text, len(self.text[: self.at].encode()), message)

    def name(self) -> str:
        begin, text = self.at, self.text
        while self.at < len(text):
            if text[self.at] == "\\":
                self.at = min(self.at + 2, len(text))
            elif _name_char(text[self.at]):
                self.at += 1
            else:
                break
        return text[begin : self.at]

    def quoted(self, quote: str) -> str:
        out, text = [], self.text
        self.at += 1
        while self.at < len(text):
            c = text[self.at]
            self.at += 1
            if c == quote:
                return "".join(out)
            if c == "\\":
                c = text[self.at : self.at + 1]
                self.at += len(c)
            out.append(c)
        raise self.fail("unclosed string")

    def bare(self) -> str:
        out, text = [], self.text
        while self.at < len(text) and text[self.at] not in "] \t\n\r":
            if text[self.at] == "\\":
                self.at += 1
            out.append(text[self.at : self.at + 1])
            self.at += 1
        return "".join(out)

    def put(self, kind: str, value: str, simple: bool) -> None:
        self.out.append((kind, value))
        self.simple = simple

    def run(self) -> list[tuple[str, str]]:
        text = self.text
        while True:
            begin = self.at
            while self.at < len(text) and text[self.at] in _BLANKS:
                self.at += 1
            if self.at >= len(text):
                break
            c = text[self.at]
            if self.at > begin and self.simple and not self.attr and not self.depth and c not in ",])>+~":
                self.put("combinator", " ", False)
            if c in "*~" and self.attr and not self.compared:
                self.at += 1
                if text[self.at : self.at + 1] != "=":
                    raise self.fail("expected = after * in attribute selector" if c == "*" else "unexpected ~ in attribute selector")
                self.at += 1
                self.out.append(("op", c + "="))
                self.compared = True
            elif c == "*":
                self.at += 1
                self.put("universal", "*", True)
            elif c in "#.:":
                self.at += 1
                name = self.name()
                if not name:
                    raise self.fail("expected pseudo-class name after :" if c == ":" else f"expected identifier after {c}")
                self.put({"#": "id", ".": "class", ":": "pseudo"}[c], name, True)
            elif c in "[]":
                self.at += 1
                self.attr = c == "["
                self.named = self.compared = self.valued = False
                self.put(c, c, c == "]")
            elif c == "(":
                self.at += 1
                self.depth += 1
                self.put(c, c, False)
            elif c == ")":
                self.at += 1
                self.depth = max(0, self.depth - 1)
                self.put(c, c, True)
            elif c == ",":
                self.at += 1
                self.put(c, c, False)
            elif c in ">+~":
                self.at += 1
                self.put("combinator", c, False)
            elif c in "=^$|":
                if not self.attr:
                    raise self.fail(f"unexpected {c} outside attribute selector")
                self.at += 1
                if c != "=":
                    if text[self.at : self.at + 1] != "=":
                        raise self.fail(f"expected = after {c}")
                    self.at += 1
                self.out.append(("op", c if c == "=" else c + "="))
                self.compared = True
            elif c in "\"'":
                self.out.append(("string", self.quoted(c)))
                self.valued = self.valued or self.attr
            else:
                self.other(c)
        return self.out

    def other(self, c: str) -> None:
        if self.attr and self.compared and not self.valued:
            value = self.bare()
            if value:
                self.out.append(("string", value))
                self.valued = True
        elif c.isalpha() or c in "_-" or ord(c) > 127 or self.attr and not self.named:
            name = self.name()
            if not name:
                raise self.fail(f"unexpected character: {c}")
            if self.attr and not self.named:
                self.out.append(("tag", name))
                self.named = True
            elif self.depth:
                self.out.append(("string", name))
            else:
                self.put("tag", name.lower(), True)
        elif self.depth and c.isdigit():
            m = re.compile(r"[\dn+-]+").match(self.text, self.at)
            self.at = m.end()
            self.out.append(("string", m.group()))
        else:
            raise self.fail(f"unexpected character: {c}")


def parse(text: str) -> tuple[Chain, ...]:
    """The chains of a selector list. Raises SelectorError."""
    stripped = text.strip()
    if not stripped:
        raise SelectorError(text, 0, "empty selector")
    tokens = _Lexer(stripped).run()
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def fail(message: str) -> SelectorError:
        return SelectorError(stripped, at, message)

    def compound() -> Compound:
        nonlocal at
        out: list[Simple] = []
        while True:
            kind = peek()
            if kind in ("tag", "universal", "id", "class"):
                out.append(Simple(kind, tokens[at][1]))
                at += 1
            elif kind == "[":
                at += 1
                if peek() != "tag":
                    raise fail("expected attribute name")
                name, op, value = tokens[at][1], "", ""
                at += 1
                if peek() == "op":
                    op = tokens[at][1]
                    at += 1
                    if peek() != "string":
                        raise fail("expected attribute value")
                    value = tokens[at][1]
                    at += 1
                if peek() != "]":
                    raise fail("expected ]")
                at += 1
                out.append(Simple("attr", name, op, value))
            elif kind == "pseudo":
                name, value = tokens[at][1], ""
                at += 1
                if peek() == "(":
                    at += 1
                    depth, parts = 1, []
                    while depth and at < len(tokens):
                        k, v = tokens[at]
                        at += 1
                        depth += (k == "(") - (k == ")")
                        if depth:
                            parts.append({"id": "#", "class": ".", "pseudo": ":"}.get(k, "") + v)
                    value = "".join(parts).strip()
                out.append(Simple("pseudo", name, "", value))
            else:
                if not out:
                    raise fail("expected selector")
                return tuple(out)

    def chain() -> Chain:
        nonlocal at
        parts = [("", compound())]
        while peek() == "combinator":
            how = tokens[at][1]
            at += 1
            parts.append((how, compound()))
        return tuple(parts)

    out = [chain()]
    while peek() == ",":
        at += 1
        out.append(chain())
    if at < len(tokens):
        raise fail("unexpected token after selector list" if len(out) > 1 else f"unexpected token: {tokens[at][1]}")
    return tuple(out)


def nth(text: str) -> tuple[int, int] | None:
    """(a, b) of an An+B argument; None if it isn't one."""
    text = text.strip().lower()
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    if re.fullmatch(r"[+-]?\d+", text):
        return 0, int(text)
    m = re.fullmatch(r"([+-]?\d*)n\s*(?:\+?([+-]?\d+))?", text)
    if not m:
        return None
    a = {"": 1, "+": 1, "-": -1}.get(m[1])
    return (int(m[1]) if a is None else a), int(m[2] or 0)


def nth_matches(i: int, ab: tuple[int, int] | None) -> bool:
    if ab is None:
        return False
    a, b = ab
    return i == b if a == 0 else (i - b) * (1 if a > 0 else -1) >= 0 and (i - b) % a == 0


def _value_matches(got: str, op: str, want: str) -> bool:
    if op == "=":
        return got == want
    if op == "~=":
        return want in re.split(r"\s+", got.strip()) if want else False
    if op == "|=":
        return got == want or got.startswith(want + "-")
    return bool(want) and {"^=": got.startswith, "$=": got.endswith, "*=": got.__contains__}[op](want)


class Matcher:
    """Matches one selector against elements of one tree. Places among siblings are worked out once for each parent."""

    def __init__(self, selector: str | tuple[Chain, ...], semantics: str = "compat"):
        if semantics not in ("compat", "css"):
            raise ValueError("semantics must be compat or css")
        self.chains = parse(selector) if isinstance(selector, str) else selector
        self.compat = semantics == "compat"
        self.inner: dict[str, Matcher | None] = {}
        self.places: dict[int, dict[int, tuple[int, int, int, int]]] = {}
        self.kids: dict[int, list[Node]] = {}
        self.alike: dict[tuple[int, Compound], list[int]] = {}

    def _place(self, node: Node) -> tuple[int, int, int, int]:
        """Place and number among element siblings, and among those with the same name."""
        if node.parent is None:
            return 1, 1, 1, 1
        key = id(node.parent)
        if key not in self.places:
            kids = node.parent.elements()
            names = [k.name.lower() for k in kids]
            total = {n: names.count(n) for n in set(names)} if len(names) < 50 else {}
            if not total:
                for n in names:
                    total[n] = total.get(n, 0) + 1
            seen: dict[str, int] = {}
            found = {}
            for i, (k, n) in enumerate(zip(kids, names, strict=True), 1):
                seen[n] = seen.get(n, 0) + 1
                found[id(k)] = (i, len(kids), seen[n], total[n])
            self.places[key], self.kids[key] = found, kids
        return self.places[key].get(id(node), (1, 1, 1, 1))

    def _siblings(self, node: Node) -> tuple[list[Node], int]:
        """Element siblings, and a node's place among them from 0."""
        at = self._place(node)[0] - 1
        return self.kids[id(node.parent)], at

    def _pseudo(self, node: Node, s: Simple) -> bool:
        name = s.name
        if name == "not":
            if not s.value:
                return True
            if s.value not in self.inner:
                try:
                    self.inner[s.value] = Matcher(s.value, "compat" if self.compat else "css")
                except SelectorError:
                    self.inner[s.value] = None
            inner = self.inner[s.value]
            return inner is not None and not inner.matches(node)
        if name == "empty":
            return not any(c.kind == ELEMENT or c.kind == TEXT and c.data.strip() for c in node.children)
        if name == "root":
            return node.parent is not None and node.parent.kind in (Document().kind, FRAGMENT)
        if name in PSEUDO_NTH and node.parent is None:
            return False
        i, n, ti, tn = self._place(node)
        if name in PSEUDO_NTH:
            ab = nth(s.value)
            return nth_matches({"nth-child": i, "nth-last-child": n - i + 1, "nth-of-type": ti, "nth-last-of-type": tn - ti + 1}[name], ab)
        return {"first-child": i == 1, "last-child": i == n, "only-child": n == 1, "first-of-type": ti == 1, "last-of-type": ti == tn, "only-of-type": tn == 1}.get(name, False)

    def simple(self, node: Node, s: Simple) -> bool:
        if s.kind == "tag":
            return node.name == s.name
        if s.kind == "universal":
            return True
        if s.kind == "id":
            return node.id == s.name
        if s.kind == "class":
            return s.name in node.classes
        if s.kind == "attr":
            got = node.get(s.name)
            return got is not None and (not s.op or _value_matches(got, s.op, s.value))
        return self._pseudo(node, s)

    def compound(self, node: Node, c: Compound) -> bool:
        return all(self.simple(node, s) for s in c)

    def _before(self, node: Node, how: str, c: Compound):
        """The elements that a combinator leads to from an element and that match a compound, nearest first."""
        if how in (" ", ">"):
            up = node.parent
            while up is not None and up.kind == ELEMENT:
                if self.compound(up, c):
                    yield up
                if how == ">":
                    return
                up = up.parent
        elif node.parent is not None:
            kids, at = self._siblings(node)
            if how == "+":
                if at > 0 and self.compound(kids[at - 1], c):
                    yield kids[at - 1]
                return
            key = id(node.parent), c
            if key not in self.alike:
                self.alike[key] = [i for i, k in enumerate(kids) if self.compound(k, c)]
            places = self.alike[key]
            for k in range(bisect.bisect_left(places, at) - 1, -1, -1):
                yield kids[places[k]]

    def chain(self, node: Node, c: Chain) -> bool:
        if not self.compound(node, c[-1][1]):
            return False
        # candidates still to try, by the place of their compound in the chain, nearest first
        tries, met = [(iter((node,)), len(c) - 1)], set()
        while tries:
            found, i = tries[-1]
            at = next(found, None)
            if at is None:
                if self.compat:
                    return False
                tries.pop()
            elif i == 0:
                return True
            elif (id(at), i) not in met:
                met.add((id(at), i))
                tries.append((self._before(at, c[i][0], c[i - 1][1]), i - 1))
        return False

    def matches(self, node: Node) -> bool:
        return any(self.chain(node, c) for c in self.chains)

    def select(self, top: Node, first: bool = False) -> list[Node]:
        """Matching elements at and below top in document order; contents of templates take no part."""
        if isinstance(top, Document):
            root = top.root()
            if root is None:
                return []
            top = root
        out = []
        for n in top.walk():
            if n.kind == ELEMENT and self.matches(n):
                out.append(n)
                if first:
                    break
        return out


def select(top: Node, selector: str, semantics: str = "compat", first: bool = False) -> list[Node]:
    return Matcher(selector, semantics).select(top, first)
