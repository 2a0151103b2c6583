"""Tree construction: tokens become a tree.

Each insertion mode is a method that takes a token and says whether the token is to be looked at again. Most start tags of
"in body" differ only in a few habits (close an open paragraph, reopen formatting, be empty, forbid framesets), so those
are sets; what is left is a table of methods by tag.
"""

from __future__ import annotations

from htmlframe.functions import tokens as tk
from htmlframe.functions.tree import COMMENT, ELEMENT, HTML, MATHML, SVG, TEXT, Document, Node, new_element

_w = lambda s: frozenset(s.split())

# Element groups of the parsing rules.
SPECIAL = _w(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dialog dir div dl dt embed fieldset figcaption figure footer form"
    " frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu menuitem meta nav noembed noframes noscript object ol p param plaintext"
    " pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr"
)
FORMATTING = _w("a b big code em font i nobr s small strike strong tt u")
VOID = _w("area base br col embed hr img input keygen link meta param source track wbr")
IMPLIED = _w("dd dt li optgroup option p rb rp rt rtc")
HEADINGS = _w("h1 h2 h3 h4 h5 h6")
CONTAINERS = _w("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol search section summary ul")
TABLE_PARTS = _w("caption col colgroup tbody td tfoot th thead tr")
SECTIONS = _w("tbody thead tfoot")
HEAD_VOID = _w("base basefont bgsound link meta")
SCOPE = _w("applet caption html table td th marquee object template mi mo mn ms mtext annotation-xml foreignObject desc title")
SCOPES = {"": SCOPE, "list": SCOPE | {"ol", "ul"}, "definition": SCOPE | {"dl"}, "button": SCOPE | {"button"}}
TABLE_SCOPE = _w("html table template")
FOSTER = _w("table tbody tfoot thead tr")
BREAKOUT = _w("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var")
MATH_TEXT = _w("mi mo mn ms mtext")
SVG_HTML = _w("foreignObject desc title")
# Spellings of SVG elements, of SVG and MathML attributes, and attributes with a namespace.
SVG_TAGS = {t.lower(): t for t in _w(
    "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting feDisplacementMap"
    " feDistantLight feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject"
    " glyphRef linearGradient radialGradient textPath"
)}
SVG_ATTRIBUTES = {t.lower(): t for t in _w(
    "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines"
    " keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ"
    " preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod startOffset stdDeviation stitchTiles"
    " surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector yChannelSelector zoomAndPan"
)}
_XLINK, _XML, _XMLNS = "http://www.w3.org/1999/xlink", "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"
FOREIGN_ATTRIBUTES = {f"xlink:{n}": _XLINK for n in "actuate arcrole href role show title type".split()} | {"xml:lang": _XML, "xml:space": _XML, "xmlns": _XMLNS, "xmlns:xlink": _XMLNS}
# Public and system identifiers of old document types.
QUIRKY_PREFIXES = tuple(
    """-//advasoft ltd//dtd html 3.0 aswedit + extensions//
-//as//dtd html 3.0 aswedit + extensions//
-//ietf//dtd html 2.0 level 1//
-//ietf//dtd html 2.0 level 2//
-//ietf//dtd html 2.0 strict level 1//
-//ietf//dtd html 2.0 strict level 2//
-//ietf//dtd html 2.0 strict//
-//ietf//dtd html 2.0//
-//ietf//dtd html 2.1e//
-//ietf//dtd html 3.0//
-//ietf//dtd html 3.2 final//
-//ietf//dtd html 3.2//
-//ietf//dtd html 3//
-//ietf//dtd html level 0//
-//ietf//dtd html level 1//
-//ietf//dtd html level 2//
-//ietf//dtd html level 3//
-//ietf//dtd html strict level 0//
-//ietf//dtd html strict level 1//
-//ietf//dtd html strict level 2//
-//ietf//dtd html strict level 3//
-//ietf//dtd html strict//
-//ietf//dtd html//
-//metrius//dtd metrius presentational//
-//microsoft//dtd internet explorer 2.0 html strict//
-//microsoft//dtd internet explorer 2.0 html//
-//microsoft//dtd internet explorer 2.0 tables//
-//microsoft//dtd internet explorer 3.0 html strict//
-//microsoft//dtd internet explorer 3.0 html//
-//microsoft//dtd internet explorer 3.0 tables//
-//netscape comm. corp.//dtd html//
-//netscape comm. corp.//dtd strict html//
-//o'reilly and associates//dtd html 2.0//
-//o'reilly and associates//dtd html extended 1.0//
-//o'reilly and associates//dtd html extended relaxed 1.0//
-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//
-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//
-//spyglass//dtd html 2.0 extended//
-//sq//dtd html 2.0 hotmetal + extensions//
-//sun microsystems corp.//dtd hotjava html//
-//sun microsystems corp.//dtd hotjava strict html//
-//w3c//dtd html 3 1995-03-24//
-//w3c//dtd html 3.2 draft//
-//w3c//dtd html 3.2 final//
-//w3c//dtd html 3.2//
-//w3c//dtd html 3.2s draft//
-//w3c//dtd html 4.0 frameset//
-//w3c//dtd html 4.0 transitional//
-//w3c//dtd html experimental 19960712//
-//w3c//dtd html experimental 970421//
-//w3c//dtd w3 html//
-//w3o//dtd w3 html 3.0//
-//webtechs//dtd mozilla html 2.0//
-//webtechs//dtd mozilla html//""".split("\n")
)
QUIRKY_PUBLIC = frozenset(("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html"))
QUIRKY_SYSTEM = frozenset(("http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd",))
LIMITED_PREFIXES = ("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//")
HTML4_PREFIXES = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")

_SPACE = "\t\n\f\r "
#: Marks a border in the list of active formatting elements.
MARKER = None


def quirks_of(name: str, public: str | None, system: str | None, force: bool, srcdoc: bool) -> int:
    """0 no quirks, 1 quirks, 2 limited quirks."""
    p, s = (public or "").lower(), (system or "").lower()
    if force:
        return 1
    if srcdoc:
        return 0
    if name.lower() != "html" or p in QUIRKY_PUBLIC or s in QUIRKY_SYSTEM or p.startswith(QUIRKY_PREFIXES):
        return 1
    if p.startswith(LIMITED_PREFIXES):
        return 2
    return (1 if system is None else 2) if p.startswith(HTML4_PREFIXES) else 0


def _blank(text: str) -> bool:
    return not text.strip(_SPACE)


def _hidden(attrs) -> bool:
    return any(k == "type" and v.lower() == "hidden" for k, v in attrs)


class OpenElements(list):
    """The stack of open elements, which knows how many HTML elements of each name it holds."""

    def __init__(self) -> None:
        super().__init__()
        self.counts: dict[str, int] = {}

    def _count(self, nodes, by: int) -> None:
        for n in nodes:
            if n.ns == HTML:
                self.counts[n.name] = self.counts.get(n.name, 0) + by

    def append(self, node: Node) -> None:
        super().append(node)
        self._count((node,), 1)

    def insert(self, at: int, node: Node) -> None:
        super().insert(at, node)
        self._count((node,), 1)

    def pop(self, at: int = -1) -> Node:
        node = super().pop(at)
        self._count((node,), -1)
        return node

    def __setitem__(self, at: int, node: Node) -> None:
        self._count((self[at],), -1)
        super().__setitem__(at, node)
        self._count((node,), 1)

    def __delitem__(self, at: int | slice) -> None:
        self._count(self[at] if isinstance(at, slice) else (self[at],), -1)
        super().__delitem__(at)


class _Format:
    """An active formatting element."""

    __slots__ = ("name", "attrs", "node", "key")

    def __init__(self, name, attrs, node):
        self.name, self.attrs, self.node, self.key = name, attrs, node, tuple(sorted(attrs))


class TreeBuilder:
    def __init__(self, tokenizer: tk.Tokenizer, srcdoc: bool = False, context: str | None = None, context_ns: str = ""):
        self.tokens, self.srcdoc = tokenizer, srcdoc
        self.doc = Document()
        self.open = OpenElements()
        self.formats: list[_Format | None] = []
        self.templates: list[str] = []
        self.mode, self.after_text, self.after_table_text = "initial", "initial", None
        self.table_text: list[str] = []
        self.frameset_ok, self.foster, self.skip_lf, self.as_html = context is None, False, False, False
        self.head: Node | None = None
        self.form: Node | None = None
        self.context, self.context_node, self.top = context, None, None
        if context is not None:
            self._begin_fragment(context, context_ns)

    def _begin_fragment(self, context: str, ns: str) -> None:
        self.top = new_element("html")
        self.doc.append(self.top)
        self.open.append(self.top)
        tag = context.lower()
        if not tag:
            return
        if ns in ("svg", "mathml"):
            self.context_node = new_element(context, (), SVG if ns == "svg" else MATHML)
            self.top.append(self.context_node)
            self.open.append(self.context_node)
            self.mode = "in_body"
        else:
            modes = {"html": "before_head", "tr": "in_row", "td": "in_cell", "th": "in_cell", "caption": "in_caption", "colgroup": "in_column_group", "table": "in_table", "select": "in_select"}
            self.mode = "in_table_body" if tag in SECTIONS else modes.get(tag, "in_body")
            if tag == "script":
                self.tokens.switch(tk.PLAINTEXT, tag)
            elif tag in tk.SWITCHES:
                self.tokens.switch(tk.SWITCHES[tag], tag)
        self.after_text = self.mode

    # -- the tree

    def run(self) -> Document:
        tokens = self.tokens
        while True:
            current = self.open[-1] if self.open else None
            tokens.allow_cdata = current is not None and current.ns != HTML and not self._html_point(current) and not self._math_point(current)
            t = tokens.next()
            self.take(t)
            if t.kind == tk.EOF:
                break
        self._fill_selected()
        self.doc.errors = tokens.errors()
        return self.doc

    @property
    def current(self) -> Node | None:
        return self.open[-1] if self.open else None

    def at(self, *names: str) -> bool:
        return bool(self.open) and self.open[-1].name in names

    def place(self) -> tuple[Node, Node | None]:
        """Where a node goes: parent, and the child that it goes before."""
        current = self.current
        if current is None:
            return self.doc, None
        if current.content is not None:
            return current.content, None
        if self.foster and current.ns == HTML and current.name in FOSTER:
            return self.foster_place()
        return current, None

    def foster_place(self) -> tuple[Node, Node | None]:
        for i in range(len(self.open) - 1, -1, -1):
            node = self.open[i]
            if node.ns != HTML:
                continue
            if node.content is not None:
                return node.content, None
            if node.name == "table":
                if node.parent is not None:
                    return node.parent, node
                return (self.open[i - 1] if i else self.doc), None
        return (self.current or self.doc), None

    def put(self, node: Node, place: tuple[Node, Node | None] | None = None) -> None:
        parent, before = place or self.place()
        if before is None:
            parent.append(node)
        else:
            parent.insert_before(node, before)

    def say(self, data: str) -> None:
        """Insert text, joined to a text that it touches."""
        if not data:
            return
        parent, before = self.place()
        kids = parent.children
        at = len(kids) if before is None else next((i for i, c in enumerate(kids) if c is before), len(kids))
        if at and kids[at - 1].kind == TEXT:
            kids[at - 1].data += data
        else:
            node = Node(TEXT, data=data)
            node.parent = parent
            kids.insert(at, node)

    def remark(self, data: str) -> None:
        self.put(Node(COMMENT, data=data))

    def add(self, name: str, attrs=()) -> Node:
        """Insert an HTML element and open it."""
        node = new_element(name, attrs)
        self.put(node)
        self.open.append(node)
        return node

    def add_void(self, name: str, attrs=()) -> None:
        self.add(name, attrs)
        self.open.pop()

    def add_foreign(self, t: tk.Token, name: str, ns: str) -> None:
        spell = SVG_ATTRIBUTES if ns == SVG else {"definitionurl": "definitionURL"} if ns == MATHML else {}
        node = Node(ELEMENT, name, ns)
        for k, v in t.attrs:
            k = spell.get(k, k)
            node.set(k, v, FOREIGN_ATTRIBUTES.get(k.lower(), ""))
        self.put(node)
        if not t.self_closing:
            self.open.append(node)

    def merge(self, node: Node | None, attrs) -> None:
        if node is not None and not self.templates:
            for k, v in attrs:
                if node.get(k) is None:
                    node.set(k, v)

    def pop_to(self, name: str, html: bool = False) -> None:
        while self.open:
            node = self.open.pop()
            if node.name == name and (not html or node.ns == HTML):
                return

    def pop_cell(self) -> None:
        while self.open:
            node = self.open.pop()
            if node.ns == HTML and node.name in ("td", "th"):
                return

    def has(self, name: str) -> bool:
        return any(n.name == name for n in self.open)

    def in_scope(self, names, kind: str = "") -> bool:
        names, stop = (names,) if isinstance(names, str) else names, SCOPES[kind]
        if not any(self.open.counts.get(n) for n in names):
            return False
        for node in reversed(self.open):
            if node.ns == HTML:
                if node.name in names:
                    return True
                if node.name in stop:
                    return False
            elif self._html_point(node) or self._math_point(node):
                return False
        return False

    def in_table_scope(self, name: str) -> bool:
        for node in reversed(self.open):
            if node.ns == HTML:
                if node.name == name:
                    return True
                if node.name in TABLE_SCOPE:
                    return False
        return False

    def close_p(self) -> None:
        if self.in_scope("p", "button"):
            self.pop_to("p")

    def imply(self, but: str = "") -> None:
        while self.open and self.open[-1].ns == HTML and self.open[-1].name in IMPLIED and self.open[-1].name != but:
            self.open.pop()

    def clear_to(self, *names: str) -> None:
        while self.open and not (self.open[-1].ns == HTML and self.open[-1].name in names):
            self.open.pop()

    def clear_table(self) -> None:
        self.clear_to("table", "template", "html")

    # -- active formatting elements

    def unmark(self) -> None:
        while self.formats and self.formats.pop() is not MARKER:
            pass

    def format_at(self, name: str) -> int:
        for i in range(len(self.formats) - 1, -1, -1):
            f = self.formats[i]
            if f is MARKER:
                break
            if f.name == name:
                return i
        return -1

    def _opened(self, node: Node) -> int:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] is node:
                return i
        return -1

    def reopen(self) -> None:
        """Reconstruct the active formatting elements."""
        fs = self.formats
        if not fs or fs[-1] is MARKER or self._opened(fs[-1].node) >= 0:
            return
        i = len(fs) - 1
        while i > 0 and fs[i - 1] is not MARKER and self._opened(fs[i - 1].node) < 0:
            i -= 1
        for f in fs[i:]:
            f.node = self.add(f.name, f.attrs)

    def add_format(self, t: tk.Token) -> None:
        self.formats.append(_Format(t.name, t.attrs, self.add(t.name, t.attrs)))

    def cap_formats(self, t: tk.Token) -> None:
        """Of equal elements since the last marker at most three stay."""
        key, equal = tuple(sorted(t.attrs)), []
        for i, f in enumerate(self.formats):
            if f is MARKER:
                equal = []
            elif f.name == t.name and f.key == key:
                equal.append(i)
        if len(equal) >= 3:
            del self.formats[equal[0]]

    def forget_last(self, name: str) -> None:
        i = self.format_at(name)
        if i >= 0:
            del self.formats[i]
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name == name:
                del self.open[i]
                break

    def adopt(self, name: str) -> None:
        """The adoption agency: put misnested formatting right."""
        if self.at(name) and self.format_at(name) < 0:
            self.pop_to(name)
            return
        for _ in range(8):
            i = self.format_at(name)
            if i < 0:
                return
            entry = self.formats[i]
            wrong = entry.node
            at = self._opened(wrong)
            if at < 0:
                del self.formats[i]
                return
            if not self.in_scope(wrong.name):
                return
            deep = next((k for k in range(at + 1, len(self.open)) if self.open[k].ns == HTML and self.open[k].name in SPECIAL), -1)
            if deep < 0:
                del self.open[at:]
                self.formats.remove(entry)
                return
            block = self.open[deep]
            mark, last, rounds, k = i + 1, block, 0, deep
            while True:
                rounds += 1
                k -= 1
                node = self.open[k]
                if node is wrong:
                    break
                j = next((x for x in range(len(self.formats) - 1, -1, -1) if self.formats[x] is not MARKER and self.formats[x].node is node), -1)
                if rounds > 3 and j >= 0:
                    del self.formats[j]
                    mark -= j < mark
                    j = -1
                if j < 0:
                    del self.open[k]
                    continue
                copy = new_element(self.formats[j].name, self.formats[j].attrs)
                self.formats[j].node = self.open[k] = copy
                if last is block:
                    mark = j + 1
                last.remove()
                copy.append(last)
                last = copy
            last.remove()
            if not at:
                self.doc.append(last)
            else:
                above = self.open[at - 1]
                if above.content is not None:
                    above.content.append(last)
                elif above.ns == HTML and above.name in FOSTER:
                    self.put(last, self.foster_place())
                else:
                    above.append(last)
            i = next(x for x, f in enumerate(self.formats) if f is entry)
            fresh = new_element(entry.name, entry.attrs)
            for child in block.children:
                fresh.append(child)
            block.children = []
            block.append(fresh)
            entry.node = fresh
            del self.formats[i]
            self.formats.insert(max(0, min(mark - 1, len(self.formats))), entry)
            del self.open[self._opened(wrong)]
            self.open.insert(self._opened(block) + 1, fresh)

    # -- dispatch

    def take(self, t: tk.Token) -> None:
        while True:
            if self.skip_lf:
                self.skip_lf = False
                if t.kind == tk.TEXT and t.data.startswith("\n"):
                    t.data = t.data[1:]
                    if not t.data:
                        return
            if not self.as_html and self._is_foreign(t):
                if self.foreign(t):
                    continue
                return
            self.as_html = False
            current = self.current
            if current is not None and current.ns != HTML:
                if t.kind == tk.TEXT and self._math_point(current):
                    data = t.data.replace("\0", "").replace("\f", "")
                    if data and not _blank(data):
                        self.reopen()
                        self.frameset_ok = False
                    self.say(data)
                    return
                point = self._math_point(current) or self._html_point(current)
                if t.kind == tk.START and point and self.mode in ("in_table", "in_table_body", "in_row", "in_cell", "in_caption", "in_column_group") and not self.in_table_scope("table"):
                    saved, self.mode = self.mode, "in_body"
                    again = self.in_body(t)
                    if self.mode == "in_body":
                        self.mode = saved
                    if again:
                        continue
                    return
            if not getattr(self, self.mode)(t):
                return

    def raw(self, t: tk.Token) -> None:
        """Open an element whose text is read in a mode of its own."""
        self.add(t.name, t.attrs)
        self.after_text, self.mode = self.mode, "text"
        self.tokens.switch(tk.SWITCHES[t.name], t.name)

    def reset(self) -> None:
        """The insertion mode that the open elements call for."""
        modes = {"select": "in_select", "td": "in_cell", "th": "in_cell", "tr": "in_row", "tbody": "in_table_body", "thead": "in_table_body", "tfoot": "in_table_body", "caption": "in_caption"}
        modes |= {"colgroup": "in_column_group", "table": "in_table", "head": "in_head", "body": "in_body", "html": "in_body"}
        for node in reversed(self.open):
            if node.ns != HTML:
                continue
            if node.name == "template" and self.templates:
                self.mode = self.templates[-1]
                return
            if node.name in modes:
                self.mode = modes[node.name]
                return
        self.mode = "in_body"

    # -- before the body

    def initial(self, t: tk.Token) -> bool:
        if t.kind == tk.TEXT:
            t.data = t.data.lstrip(_SPACE)
            if not t.data:
                return False
        elif t.kind == tk.COMMENT:
            self.doc.append(Node(COMMENT, data=t.data))
            return False
        elif t.kind == tk.DOCTYPE:
            self.doc.doctype = (t.name, t.public_id, t.system_id)
            self.doc.quirks = quirks_of(t.name, t.public_id, t.system_id, t.force_quirks, self.srcdoc)
            self.mode = "before_html"
            return False
        self.doc.quirks = 0 if self.srcdoc else 1
        self.mode = "before_html"
        return True

    def before_html(self, t: tk.Token) -> bool:
        if t.kind == tk.DOCTYPE:
            return False
        if t.kind == tk.COMMENT:
            self.doc.append(Node(COMMENT, data=t.data))
            return False
        if t.kind == tk.TEXT:
            t.data = t.data.lstrip(_SPACE)
            if not t.data:
                return False
        if t.kind == tk.START and t.name == "html":
            self.add("html", t.attrs)
            self.mode = "before_head"
            return False
        if t.kind == tk.END and t.name not in ("head", "body", "html", "br"):
            return False
        self.add("html")
        self.mode = "before_head"
        return True

    def before_head(self, t: tk.Token) -> bool:
        if t.kind == tk.TEXT:
            t.data = t.data.lstrip(_SPACE)
            if not t.data:
                return False
        elif t.kind == tk.COMMENT:
            self.remark(t.data)
            return False
        elif t.kind == tk.DOCTYPE:
            return False
        elif t.kind == tk.START and t.name == "html":
            self.merge(self.open[0] if self.open else None, t.attrs)
            return False
        elif t.kind == tk.START and t.name == "head":
            self.head = self.add("head", t.attrs)
            self.mode = "in_head"
            return False
        elif t.kind == tk.END and t.name not in ("head", "body", "html", "br"):
            return False
        self.head = self.add("head")
        self.mode = "in_head"
        return True

    def leave_head(self) -> bool:
        self.pop_to("head")
        self.mode = "after_head"
        return True

    def in_head(self, t: tk.Token) -> bool:
        if t.kind == tk.TEXT:
            rest = t.data.lstrip(_SPACE)
            self.say(t.data[: len(t.data) - len(rest)])
            t.data = rest
            return bool(rest) and self.leave_head()
        if t.kind == tk.COMMENT:
            self.remark(t.data)
            return False
        if t.kind == tk.START:
            name = t.name
            if name == "html":
                self.merge(self.open[0] if self.open and self.open[0].name == "html" else None, t.attrs)
            elif name in ("title", "script", "style", "noframes"):
                self.raw(t)
            elif name == "noscript":
                self.add(name, t.attrs)
                self.mode = "in_head_noscript"
            elif name in HEAD_VOID:
                self.add_void(name, t.attrs)
            elif name == "template":
                self.add(name, t.attrs)
                self.formats.append(MARKER)
                self.frameset_ok = False
                self.mode = "in_template"
                self.templates.append(self.mode)
            elif name != "head":
                return self.leave_head()
            return False
        if t.kind == tk.END:
            if t.name == "head":
                self.leave_head()
                return False
            if t.name == "template":
                return self.end_template()
        return self.leave_head()

    def end_template(self) -> bool:
        if self.has("template"):
            self.imply()
            self.pop_to("template")
            self.unmark()
            if self.templates:
                self.templates.pop()
            self.reset()
        return False

    def in_head_noscript(self, t: tk.Token) -> bool:
        out = False
        if t.kind == tk.COMMENT or t.kind == tk.TEXT and _blank(t.data):
            return self.in_head(t)
        if t.kind == tk.START:
            if t.name in TABLE_PARTS or t.name in ("head", "noscript"):
                return False
            if t.name == "html":
                self.merge(self.open[0] if self.open and self.open[0].name == "html" else None, t.attrs)
                return False
            if t.name in ("basefont", "bgsound", "link", "meta", "noframes", "style"):
                return self.in_head(t)
            out = True
        elif t.kind == tk.END:
            if t.name not in ("noscript", "br"):
                return False
            out = t.name == "br"
        elif t.kind == tk.DOCTYPE:
            return False
        else:
            out = True
        self.pop_to("noscript")
        self.mode = "in_head"
        return out

    def after_head(self, t: tk.Token) -> bool:
        attrs = ()
        again = True
        if t.kind == tk.TEXT:
            t.data = t.data.replace("\0", "").replace("\f", "")
            if _blank(t.data):
                self.say(t.data)
                return False
        elif t.kind == tk.COMMENT:
            self.remark(t.data)
            return False
        elif t.kind == tk.START:
            name = t.name
            if name in TABLE_PARTS or name == "head" or name == "input" and _hidden(t.attrs):
                return False
            if name == "html":
                if self.context is None:
                    self.merge(self.open[0] if self.open and self.open[0].name == "html" else None, t.attrs)
                return False
            if name == "frameset":
                self.add(name, t.attrs)
                self.mode = "in_frameset"
                return False
            if name in HEAD_VOID or name in ("noframes", "script", "style", "title", "noscript"):
                if self.head is not None:
                    self.open.append(self.head)
                out = self.in_head(t)
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i] is self.head:
                        del self.open[i]
                        break
                if self.mode == "text" and self.after_text == "in_head":
                    self.after_text = "after_head"
                return out
            if name == "template":
                if self.head is not None:
                    self.open.append(self.head)
                self.mode = "in_head"
                return True
            if name == "body":
                attrs, again = t.attrs, False
                self.frameset_ok = False
        elif t.kind == tk.END and t.name not in ("body", "html", "br"):
            return False
        self.add("body", attrs)
        self.mode = "in_body"
        return again

    def text(self, t: tk.Token) -> bool:
        if t.kind == tk.TEXT:
            self.say(t.data)
            return False
        if t.kind in (tk.END, tk.EOF):
            if t.kind == tk.END:
                self.pop_to(t.name)
            self.mode = self.after_text
            self.tokens.mode = tk.DATA
            return t.kind == tk.EOF
        return False

    # -- in body

    def in_body(self, t: tk.Token) -> bool:
        if t.kind == tk.TEXT:
            data = t.data.replace("\0", "")
            if data:
                self.reopen()
                if not _blank(data):
                    self.frameset_ok = False
                self.say(data)
            return False
        if t.kind == tk.COMMENT:
            self.remark(t.data)
            return False
        if t.kind == tk.START:
            return self.start(t)
        if t.kind == tk.END:
            return self.end(t)
        return t.kind == tk.EOF and bool(self.templates) and self.in_template(t)

    def start(self, t: tk.Token) -> bool:
        name = t.name
        if name in TABLE_PARTS or name == "head":
            return False
        special = self._STARTS.get(name)
        if special:
            return bool(special(self, t))
        if name in CONTAINERS or name == "p":
            self.close_p()
            self.add(name, t.attrs)
        elif name in HEADINGS:
            self.close_p()
            if self.at(*HEADINGS):
                self.open.pop()
            self.add(name, t.attrs)
            self.frameset_ok = False
        elif name in HEAD_VOID:
            self.add_void(name, t.attrs)
        elif name in ("img", "area", "embed", "keygen", "wbr", "br"):
            self.reopen()
            self.add_void(name, t.attrs)
            self.frameset_ok = False
        elif name in FORMATTING:
            if name == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
                self.forget_last("nobr")
            self.reopen()
            self.cap_formats(t)
            self.add_format(t)
            self.frameset_ok = False
        else:
            self.reopen()
            self.add(name, t.attrs)
            if name in VOID:
                self.open.pop()
            elif not _blank(name):
                self.frameset_ok = False
        return False

    def s_html(self, t):
        if self.context is None:
            self.merge(self.open[0] if self.open and self.open[0].name == "html" else None, t.attrs)

    def s_body(self, t):
        if self.context is not None or self.templates:
            return
        body = self.doc.body()
        if body is not None:
            self.merge(body, t.attrs)
        else:
            self.add("body", t.attrs)
        self.frameset_ok = False

    def s_li(self, t):
        self.frameset_ok = False
        self.close_p()
        if self.in_scope("li", "list"):
            self.pop_to("li")
        self.add("li", t.attrs)

    def s_dd(self, t):
        self.frameset_ok = False
        self.close_p()
        for n in (t.name, "dt" if t.name == "dd" else "dd"):
            if self.in_scope(n, "definition"):
                self.pop_to(n)
        self.add(t.name, t.attrs)

    def s_pre(self, t):
        self.close_p()
        self.add(t.name, t.attrs)
        self.skip_lf, self.frameset_ok = True, False

    def s_hr(self, t):
        self.close_p()
        self.add_void("hr", t.attrs)
        self.frameset_ok = False

    def s_template(self, t):
        return self.in_head(t)

    def s_frameset(self, t):
        if not self.frameset_ok:
            return
        at = next((i for i, n in enumerate(self.open) if n.name == "body" and n.ns == HTML), -1)
        if at >= 0:
            self.open[at].remove()
            del self.open[at:]
            self.add("frameset", t.attrs)
            self.mode = "in_frameset"

    def s_form(self, t):
        if self.form is None:
            self.close_p()
            self.form = self.add("form", t.attrs)
            self.frameset_ok = False

    def s_button(self, t):
        if self.in_scope("button"):
            self.pop_to("button")
        self.add("button", t.attrs)
        self.frameset_ok = False

    def s_frame(self, t):
        if self.context is not None:
            self.add_void("frame", t.attrs)

    def s_svg(self, t):
        self.reopen()
        self.add_foreign(t, "svg", SVG)

    def s_math(self, t):
        self.reopen()
        self.add_foreign(t, "math", MATHML)

    def s_a(self, t):
        if self.format_at("a") >= 0:
            self.adopt("a")
            self.forget_last("a")
        self.reopen()
        self.add_format(t)
        self.frameset_ok = False

    def s_table(self, t):
        if self.doc.quirks != 1:
            self.close_p()
        self.add("table", t.attrs)
        self.frameset_ok, self.mode = False, "in_table"

    def s_select(self, t):
        self.reopen()
        self.add("select", t.attrs)
        self.frameset_ok, self.mode = False, "in_select"

    def s_option(self, t):
        if self.current is not None and self.current.name == "option" and self.current.ns == HTML:
            self.open.pop()
        self.reopen()
        self.add(t.name, t.attrs)

    def s_rt(self, t):
        self.imply("rtc")
        self.add(t.name, t.attrs)

    def s_rb(self, t):
        if self.at("rb", "rp", "rt", "rtc"):
            self.imply()
        self.add(t.name, t.attrs)

    def s_textarea(self, t):
        self.raw(t)
        if t.name == "textarea":
            self.skip_lf, self.frameset_ok = True, False

    def s_xmp(self, t):
        self.close_p()
        self.raw(t)
        self.frameset_ok = False

    def s_plaintext(self, t):
        self.close_p()
        self.add(t.name, t.attrs)
        self.tokens.switch(tk.PLAINTEXT, t.name)
        self.frameset_ok = False

    def s_image(self, t):
        self.add_void("img", t.attrs)
        self.frameset_ok = False

    def s_input(self, t):
        self.reopen()
        self.add_void("input", t.attrs)
        self.frameset_ok = self.frameset_ok and _hidden(t.attrs)

    def s_object(self, t):
        self.reopen()
        self.add(t.name, t.attrs)
        self.formats.append(MARKER)
        self.frameset_ok = False

    _STARTS = {
        "html": s_html, "body": s_body, "li": s_li, "dd": s_dd, "dt": s_dd, "pre": s_pre, "listing": s_pre, "hr": s_hr, "template": s_template, "frameset": s_frameset, "form": s_form,
        "button": s_button, "frame": s_frame, "svg": s_svg, "math": s_math, "a": s_a, "table": s_table, "select": s_select, "option": s_option, "optgroup": s_option, "rp": s_rt, "rt": s_rt,
        "rb": s_rb, "rtc": s_rb, "textarea": s_textarea, "title": s_textarea, "xmp": s_xmp, "plaintext": s_plaintext, "script": lambda self, t: self.raw(t), "style": lambda self, t: self.raw(t),
        "image": s_image, "input": s_input, "marquee": s_object, "object": s_object, "applet": s_object,
    }

    def end(self, t: tk.Token) -> bool:
        name = t.name
        if name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.imply()
                while self.open and self.open.pop().name not in HEADINGS:
                    pass
        elif name in CONTAINERS or name in ("listing", "pre", "button", "marquee", "object", "applet"):
            if self.in_scope(name):
                self.imply()
                self.pop_to(name)
                if name in ("marquee", "object", "applet"):
                    self.unmark()
        elif name in ("body", "html"):
            if self.in_scope("body"):
                self.mode = "after_body"
                return name == "html"
        elif name == "br":
            self.add_void("br")
            self.frameset_ok = False
        elif name == "p":
            if not self.in_scope("p", "button"):
                self.add("p")
            self.pop_to("p")
        elif name == "li":
            if self.in_scope("li", "list"):
                self.pop_to("li")
        elif name in ("dd", "dt"):
            if self.in_scope(name, "definition"):
                while self.open and self.open.pop().name not in ("dd", "dt"):
                    pass
        elif name == "form":
            if self.form is not None:
                at = self._opened(self.form)
                if at >= 0:
                    del self.open[at]
                self.form = None
        elif name == "template":
            return self.end_template()
        elif name in FORMATTING:
            self.adopt(name)
        else:
            for i in range(len(self.open) - 1, -1, -1):
                node = self.open[i]
                if node.name.lower() == name:
                    self.imply(name)
                    del self.open[i:]
                    break
                if node.ns == HTML and node.name in SPECIAL:
                    break
        return False

    # -- tables

    def fostered(self, t: tk.Token) -> bool:
        saved, self.foster = self.foster, True
        try:
            return self.in_body(t)
        finally:
            self.foster = saved

    def in_table(self, t: tk.Token) -> bool:
        name = t.name
        if t.kind == tk.TEXT:
            self.after_table_text, self.mode = self.mode, "in_table_text"
            self.table_text = []
            return True
        if t.kind == tk.COMMENT:
            self.remark(t.data)
            return False
        if t.kind == tk.START:
            if name == "input" and _hidden(t.attrs):
                self.add_void("input", t.attrs)
            elif name == "form":
                if self.form is None:
                    self.form = self.add("form", t.attrs)
                    self.open.pop()
            elif name == "caption":
                self.clear_table()
                self.formats.append(MARKER)
                self.add("caption", t.attrs)
                self.mode = "in_caption"
            elif name in ("col", "colgroup"):
                self.clear_table()
                self.add("colgroup", t.attrs if name == "colgroup" else ())
                self.mode = "in_column_group"
                return name == "col"
            elif name in SECTIONS:
                self.clear_table()
                self.add(name, t.attrs)
                self.mode = "in_table_body"
            elif name in ("tr", "td", "th"):
                self.clear_table()
                self.add("tbody")
                self.mode = "in_table_body"
                return True
            elif name == "table":
                if not self.in_table_scope("table"):
                    return False
                self.pop_to("table")
                self.reset()
                return True
            elif name in ("script", "style"):
                self.raw(t)
            elif name == "template":
                return self.in_head(t)
            else:
                return self.fostered(t)
            return False
        if t.kind == tk.END:
            if name == "table":
                if self.in_table_scope("table"):
                    self.pop_to("table")
                    self.reset()
                return False
            return False if name in TABLE_PARTS or name in ("body", "html") else self.fostered(t)
        return t.kind == tk.EOF and bool(self.templates) and self.in_template(t)

    def in_table_text(self, t: tk.Token) -> bool:
        if t.kind == tk.TEXT:
            self.table_text.append(t.data.replace("\0", "").replace("\f", ""))
            return False
        data, self.table_text = "".join(self.table_text), []
        if data and _blank(data):
            self.say(data)
        elif data:
            saved, self.foster = self.foster, True
            self.reopen()
            self.say(data)
            self.foster = saved
        self.mode, self.after_table_text = self.after_table_text or "in_table", None
        return True

    def close_caption(self) -> bool:
        if not self.in_table_scope("caption"):
            return False
        self.imply()
        self.pop_to("caption")
        self.unmark()
        self.mode = "in_table"
        return True

    def in_caption(self, t: tk.Token) -> bool:
        if t.kind == tk.END:
            if t.name == "caption":
                self.close_caption()
                return False
            if t.name == "table":
                return self.close_caption()
            if t.name in SECTIONS:
                return False
        elif t.kind == tk.START:
            if t.name in TABLE_PARTS:
                return self.close_caption()
            if t.name == "table" and self.close_caption():
                return True
        return self.in_body(t)

    def in_column_group(self, t: tk.Token) -> bool:
        name, current = t.name, self.current
        here = current is not None and current.name == "colgroup"
        if t.kind == tk.TEXT:
            rest = t.data.lstrip(_SPACE)
            if rest and self.at("template", "html"):
                return False
            lead = t.data[: len(t.data) - len(rest)]
            self.say(lead)
            t.data = rest
            if not rest:
                return False
        elif t.kind == tk.COMMENT:
            self.remark(t.data)
            return False
        elif t.kind == tk.START:
            if (self.context or "").lower() == "colgroup" and not self.in_table_scope("table") and name not in ("col", "colgroup", "template", "html"):
                return False
            if name == "col":
                self.add_void("col", t.attrs)
                return False
            if name == "template":
                return self.in_head(t)
            if name == "colgroup" and not here:
                return False
        elif t.kind == tk.END:
            if name == "colgroup":
                if here:
                    self.pop_to("colgroup")
                    self.mode = "in_table"
                return False
            if name == "col":
                return False
            if name == "template":
                return self.in_head(t)
        elif t.kind == tk.EOF and not here:
            return self.at("template") and self.in_template(t)
        if here:
            self.pop_to("colgroup")
        elif self.at("template", "html"):
            return False
        self.mode = "in_table"
        return True

    def _section_context(self) -> bool:
        return (self.context or "").lower() in SECTIONS and self.at("html")

    def in_table_body(self, t: tk.Token) -> bool:
        name = t.name
        if t.kind == tk.START:
            if name in ("tr", "td", "th"):
                self.clear_to("tbody", "tfoot", "thead", "template", "html")
                self.add("tr", t.attrs if name == "tr" else ())
                self.mode = "in_row"
                return name != "tr"
            if name in TABLE_PARTS or name == "table":
                if self._section_context() or self.at("template"):
                    return False
                if self.at(*SECTIONS):
                    self.open.pop()
                self.mode = "in_table"
                return True
        elif t.kind == tk.END:
            if name in SECTIONS:
                if not self.at("template") and self.in_table_scope(name):
                    self.pop_to(name)
                    self.mode = "in_table"
                return False
            if name == "table":
                if self.at("template") or self._section_context() or not self.in_table_scope("table"):
                    return False
                self.pop_to("tbody")
                self.mode = "in_table"
                return True
        return self.in_table(t)

    def in_row(self, t: tk.Token) -> bool:
        name = t.name
        if t.kind == tk.START and name in ("td", "th"):
            self.clear_to("tr", "template", "html")
            self.add(name, t.attrs)
            self.formats.append(MARKER)
            self.mode = "in_cell"
            return False
        closes = t.kind == tk.START and (name in TABLE_PARTS or name == "table") or t.kind == tk.END and name in ("tr", "table")
        if closes:
            if t.kind == tk.START and name != "tr" and self.at("template") or not self.in_table_scope("tr"):
                return False
            self.pop_to("tr")
            self.mode = "in_table_body"
            return not (t.kind == tk.END and name == "tr")
        return self.in_table(t)

    def close_cell(self) -> None:
        self.pop_cell()
        self.unmark()
        self.mode = "in_row"

    def in_cell(self, t: tk.Token) -> bool:
        name = t.name
        if t.kind == tk.END:
            if name in ("td", "th"):
                if self.in_table_scope(name):
                    self.pop_to(name, html=True)
                    self.unmark()
                    self.mode = "in_row"
                return False
            if name in ("tr", "table") or name in SECTIONS:
                if not self.in_table_scope(name):
                    return False
                self.close_cell()
                return True
        elif t.kind == tk.START and name in TABLE_PARTS:
            if not (self.in_table_scope("td") or self.in_table_scope("th")):
                return False
            self.close_cell()
            return True
        return self.in_body(t)

    # -- select

    def leave_select(self) -> None:
        self.pop_to("select")
        self.reset()

    def in_select(self, t: tk.Token) -> bool:
        name = t.name
        if t.kind == tk.TEXT:
            data = t.data.replace("\0", "").replace("\f", "")
            if data:
                self.reopen()
                self.say(data)
            return False
        if t.kind == tk.COMMENT:
            self.remark(t.data)
            return False
        if t.kind == tk.EOF:
            return self.in_body(t)
        if t.kind not in (tk.START, tk.END):
            return False
        start = t.kind == tk.START
        if name in TABLE_PARTS or name == "table" or start and name in ("input", "textarea"):
            if not self.has("select"):
                self.mode = "in_body"
                return self.in_body(t)
            self.leave_select()
            return True
        if name == "select":
            if self.has("select"):
                self.leave_select()
            else:
                self.mode = "in_body"
            return False
        if start:
            return self._select_start(t)
        if name in ("option", "optgroup"):
            if self.at("option"):
                self.open.pop()
            if name == "optgroup" and self.at("optgroup"):
                self.open.pop()
        elif name in FORMATTING:
            outer = next((i for i, n in enumerate(self.open) if n.name == "select"), -1)
            inner = max((i for i, n in enumerate(self.open) if n.name == name), default=-1)
            if outer < 0 or inner > outer:
                self.adopt(name)
        elif self.has(name):
            self.pop_to(name)
            self.reopen()
        return False

    def _select_start(self, t: tk.Token) -> bool:
        name = t.name
        if name == "html":
            self.merge(self.open[0] if self.open and self.open[0].name == "html" else None, t.attrs)
        elif name in ("option", "optgroup", "hr"):
            if self.at("option"):
                self.open.pop()
            if name != "option" and self.at("optgroup"):
                self.open.pop()
            if name == "hr":
                self.reopen()
            self.add(name, t.attrs)
            if name == "hr":
                self.open.pop()
        elif name in ("keygen", "br", "img"):
            self.reopen()
            self.add_void(name, t.attrs)
        elif name == "svg":
            self.s_svg(t)
        elif name == "math":
            self.s_math(t)
        elif name in ("menuitem", "selectedcontent", "p", "div", "span", "button", "datalist"):
            self.reopen()
            self.add(name, t.attrs)
            if t.self_closing and name != "menuitem":
                self.open.pop()
        elif name in ("script", "style", "template"):
            return self.in_head(t)
        elif name == "plaintext":
            self.add(name, t.attrs)
            self.tokens.switch(tk.PLAINTEXT, name)
        elif name in FORMATTING:
            self.reopen()
            self.add_format(t)
        elif self.context is not None:
            self.add(name, t.attrs)
        return False

    # -- template, and after the body

    def in_template(self, t: tk.Token) -> bool:
        name = t.name
        if t.kind in (tk.TEXT, tk.COMMENT):
            return self.in_body(t)
        if t.kind == tk.START:
            if name in HEAD_VOID or name in ("noframes", "script", "style", "template", "title"):
                return self.in_head(t)
            mode = {"col": "in_column_group", "tr": "in_table_body", "td": "in_row", "th": "in_row"}.get(name) or ("in_table" if name in TABLE_PARTS else "in_body")
            if self.templates:
                self.templates[-1] = mode
            else:
                self.templates.append(mode)
            self.mode = mode
            return True
        if t.kind == tk.END and name == "template":
            return self.in_head(t)
        if t.kind == tk.EOF and self.has("template"):
            self.pop_to("template")
            self.unmark()
            if self.templates:
                self.templates.pop()
            self.reset()
            return True
        return False

    def after_body(self, t: tk.Token) -> bool:
        if t.kind == tk.TEXT and _blank(t.data):
            self.in_body(t)
            return False
        if t.kind == tk.COMMENT:
            (self.open[0] if self.open else self.doc).append(Node(COMMENT, data=t.data))
            return False
        if t.kind == tk.END and t.name == "html":
            self.mode = "after_after_body"
            return False
        if t.kind == tk.EOF:
            return False
        self.mode = "in_body"
        return True

    def after_after_body(self, t: tk.Token, otherwise: str = "in_body") -> bool:
        if t.kind == tk.COMMENT:
            root = self.doc.root() if self.context is not None else None
            (root or self.doc).append(Node(COMMENT, data=t.data))
            return False
        if t.kind == tk.TEXT and _blank(t.data):
            self.in_body(t)
            return False
        if t.kind == tk.EOF:
            return False
        self.mode = "in_body" if t.kind == tk.START and t.name == "html" else otherwise
        return True

    def _frameset_text(self, t: tk.Token) -> bool:
        if t.kind == tk.TEXT:
            self.say("".join(c for c in t.data if c in _SPACE))
        elif t.kind == tk.COMMENT:
            self.remark(t.data)
        else:
            return False
        return True

    def in_frameset(self, t: tk.Token) -> bool:
        if self._frameset_text(t):
            return False
        if t.kind == tk.START:
            if t.name == "html":
                self.mode = "in_body"
                return True
            if t.name == "frameset":
                self.add("frameset", t.attrs)
            elif t.name == "frame":
                self.add_void("frame", t.attrs)
            elif t.name == "noframes":
                self.raw(t)
        elif t.kind == tk.END and t.name == "frameset":
            self.pop_to("frameset")
            if not self.has("frameset"):
                self.mode = "after_frameset"
        return False

    def after_frameset(self, t: tk.Token) -> bool:
        if self._frameset_text(t):
            return False
        if t.kind == tk.EOF:
            return False
        if t.kind == tk.START and t.name == "noframes":
            self.raw(t)
            return False
        if t.kind == tk.END and t.name == "html":
            self.mode = "after_after_frameset"
            return False
        self.mode = "in_body" if t.kind == tk.START and t.name == "html" else "in_frameset"
        return True

    def after_after_frameset(self, t: tk.Token) -> bool:
        if t.kind == tk.START and t.name == "noframes":
            self.raw(t)
            return False
        return self.after_after_body(t, "in_frameset")

    # -- foreign content

    def _html_point(self, node: Node) -> bool:
        if node.ns == SVG:
            return node.name in SVG_HTML
        return node.ns == MATHML and node.name == "annotation-xml" and (node.get("encoding") or "").lower() in ("text/html", "application/xhtml+xml")

    def _math_point(self, node: Node) -> bool:
        return node.ns == MATHML and node.name in MATH_TEXT

    def _is_foreign(self, t: tk.Token) -> bool:
        node = self.current
        if node is None or node.ns == HTML or t.kind == tk.EOF:
            return False
        start, text = t.kind == tk.START, t.kind == tk.TEXT
        if self._math_point(node) and (text or start and t.name not in ("mglyph", "malignmark")):
            return False
        if start and t.name == "svg" and node.ns == MATHML and node.name.lower() == "annotation-xml":
            return False
        return not (self._html_point(node) and (text or start))

    def break_out(self) -> bool:
        while self.open:
            node = self.open[-1]
            if node is self.context_node or node.ns == HTML or self._html_point(node):
                break
            self.open.pop()
        self.reset()
        self.as_html = True
        return True

    def foreign(self, t: tk.Token) -> bool:
        name = t.name
        if t.kind == tk.TEXT:
            if not _blank(t.data.replace("\0", "")):
                self.frameset_ok = False
            self.say(t.data.replace("\0", "�"))
        elif t.kind == tk.COMMENT:
            if t.data.startswith("[CDATA["):
                data = t.data[7:]
                self.say(data.removesuffix("]]>") if data.endswith("]]>") else data if t.cut_off else data.removesuffix("]]"))
            else:
                self.remark(t.data)
        elif t.kind == tk.START:
            if name in BREAKOUT or name == "font" and any(k in ("color", "face", "size") for k, _ in t.attrs):
                return self.break_out()
            ns = self.current.ns
            if name in tk.SWITCHES:
                self.tokens.mode = tk.DATA
            self.add_foreign(t, SVG_TAGS.get(name, name) if ns == SVG else name, ns)
        elif t.kind == tk.END:
            if name in ("br", "p"):
                return self.break_out()
            for i in range(len(self.open) - 1, -1, -1):
                node = self.open[i]
                if node.name.lower() == name and node.ns != HTML:
                    if node is not self.context_node:
                        del self.open[i:]
                    return False
                if node.ns == HTML:
                    self.as_html = True
                    return True
        return False

    def _fill_selected(self) -> None:
        """Copy the chosen option of each select into its selectedcontent."""
        for select in [n for n in self.doc.walk(True) if n.kind == ELEMENT and n.ns == HTML and n.name == "select"]:
            below = [n for n in select.walk(True) if n.kind == ELEMENT and n.ns == HTML]
            shown = next((n for n in below if n.name == "selectedcontent"), None)
            options = [n for n in below if n.name == "option"]
            if shown is None or not options:
                continue
            chosen = next((n for n in options if n.get("selected") is not None), options[0])
            copies = [c.clone() for c in chosen.children]
            shown.children = []
            for c in copies:
                shown.append(c)


def parse(text: str, srcdoc: bool = False, xml_coercion: bool = False, discard_bom: bool = True) -> Document:
    """The document of a text. Never fails: on an internal error the tree as far as it came is returned with the error
    internal-error."""
    builder = TreeBuilder(tk.Tokenizer(text, discard_bom, xml_coercion), srcdoc)
    return _guarded(builder)


def parse_fragment(text: str, context: str = "div", namespace: str = "", xml_coercion: bool = False) -> list[Node]:
    """The top-level elements of a text parsed inside an element."""
    builder = TreeBuilder(tk.Tokenizer(text, True, xml_coercion), context=context, context_ns=namespace)
    _guarded(builder)
    return (builder.context_node or builder.top).elements()


def _guarded(builder: TreeBuilder) -> Document:
    try:
        return builder.run()
    except Exception as e:  # noqa: BLE001  one bad page must not end a job over millions
        builder.doc.errors = [*builder.tokens.errors(), ("internal-error", f"{type(e).__name__}: {e}", 0, 0)]
        return builder.doc
