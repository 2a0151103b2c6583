"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element. A line weighs its characters outside links, and nothing if it is
mostly links. Lines in menus, headers, footers, sidebars, notices, adverts, forms and reader comments, as element names, roles
and class names of containers say, stand in the distribution with no weight and are never text. The same class names on a
paragraph, heading or list item only quarter its weight. If the page's marked articles hold most of its text, their lines get
BONUS more, lines outside them weigh a quarter, and the windows run over the articles and over each stretch outside by itself.

The weights are summed over sliding windows of WINDOW lines. A surge point is a line with weight whose window rises to SURGE
after one that was empty; the next dive point is where the window falls back to nothing; lines with weight right before a surge
belong to it. The lines from each surge to its dive, those wholly of links too, are the main text, and so are lines with weight
that stand in the same element as one of these. If there is no surge, all lines with weight are, of articles that hold most of
the text those in them.

A form that holds most of the page's text or an article is the page's wrapper, not a form. Null and empty pages and pages
without main text give an empty string. Repeated rows give repeated rows, an empty table none; only the columns named are read,
so other columns and their names don't matter. Every surge counts, so no span is chosen among others. Pages are read whole and
once forward, so that time grows in proportion to their length, malformed or not: if a quote in a tag stays open to the end of
the page, tags end at the next ">" from there on.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from htmlframe.llm.common import prepare, table

WINDOW, SURGE, BONUS = 3, 60, 20
# Element names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul title head option select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript noframes noembed iframe xmp template svg math object canvas audio video".split())
BOILER = frozenset("nav footer aside menu dialog button select option input fieldset legend label head".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("body html option select head title".split())
LISTS = frozenset("ul ol dl menu select table tbody thead tfoot".split())
# Elements that a start tag closes.
SAME = {"li": ("li",), "option": ("option",), "tr": ("tr",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption address".split())
# Words of class and id attributes that mark what isn't main text, anywhere and only outside a marked article, and
# words that may stand beside them.
EVERYWHERE = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion cookie cookies"
    " consent gdpr popup newsletter subscribe subscription signup share sharing social comment comments commentlist disqus reply replies respond responses toolbar pager pagination".split()
)
OUTSIDE = frozenset("header masthead topbar footer foot side rail banner notice notices notification alert modal overlay signin login register copyright widget widgets".split())
BESIDE = frozenset(
    "site page main top bottom left right upper lower global primary secondary mobile desktop sticky fixed box wrapper wrap container content inner outer list section area block panel row col column item items unit"
    " slot bar buttons button links link icons media form thread user reader post article blog entry text image google".split()
)
# Words of class and id attributes that say what a layout has or lacks, and the mark of a page's heading.
LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-][\w-]*", re.I)
TOP = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead|banner)(?=$|[\s_-])", re.I)
OWN_ARTICLES = re.compile("comment|repl|related|promo|sponsor|advert")
_WORDS = re.compile(r"[^\s_-]+")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _marks(value: str, in_article: bool) -> bool:
    """Whether a name in a class or id attribute says of nothing else than what isn't main text: each of its words is such a mark,
    a word that goes with one, or a number."""
    for name in value.split():
        words = [w for w in _WORDS.findall(name) if not w.isdigit()]
        marks = [w in EVERYWHERE or not in_article and w in OUTSIDE for w in words]
        if any(marks) and all(m or w in BESIDE or w in OUTSIDE for m, w in zip(marks, words, strict=True)):
            return True
    return False


def _is_boiler(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element holds something else than main text, and whether its class says so of a text element."""
    if name in BOILER or name == "header" and not in_article:
        return True, False
    if not attributes or name in ("html", "body"):
        return False, False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            value = LAYOUT.sub("", value)
            if name in HEADINGS:
                value = TOP.sub("", value)
            if name != "main" and _marks(value, in_article) and (name != "article" or OWN_ARTICLES.search(value)):
                return name not in TEXTS, name in TEXTS
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
    return False, False


class Line(NamedTuple):
    """own: characters outside links; article: 0 outside a marked one; boiler: never text; form: inside one; soft: marked as
    something else by its own class only; within: the element it stands in."""

    text: str
    own: int
    article: int
    boiler: bool
    form: bool
    soft: bool
    within: int


class _Open(NamedTuple):
    """An open element, with what holds for the lines in it."""

    name: str = ""
    boiler: bool = False
    article: int = 0
    own_header: bool = False
    form: bool = False
    soft: bool = False
    within: int = 0


class _Scanner:
    """Where tags end, read forward once."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end_of_tag(self, at: int) -> int:
        """Place of the ">" that ends a tag, -1 if there is none."""
        page = self.page
        if not self.quotes:
            return page.find(">", at)
        now = at
        while m := _STOP.search(page, now):
            if m.group() == ">":
                return m.start()
            now = page.find(m.group(), m.end()) + 1
            if not now:
                break
        self.quotes = False
        return page.find(">", at)


def lines(page: str) -> list[Line]:
    """The lines of a page in order."""
    out: list[Line] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
    blocks: list[int] = []  # places of open block elements
    parts: list[str] = []
    in_links = articles = elements = 0
    top = _Open()
    scanner, more = _Scanner(page), True

    def flush() -> None:
        nonlocal in_links
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            boiler = top.boiler or top.own_header and not any(places.get(h) for h in HEADINGS)
            out.append(Line(text, max(0, len(text) - in_links), top.article, boiler, top.form, top.soft, top.within))
        in_links = 0

    def say(text: str) -> None:
        nonlocal in_links
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if places.get("a"):
            in_links += len(text.strip())

    def close(at: int) -> None:
        nonlocal top
        while len(stack) > at:
            name = stack.pop().name
            places[name].pop()
            if name in BLOCKS:
                blocks.pop()
        top = stack[-1] if stack else _Open()

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        m = _NAME.match(page, lt + 1)
        if not m:
            sign = page[lt + 1 : lt + 2]
            comment = page.startswith("<!--", lt)
            shut = (page.find("-->", lt + 4) if comment else page.find(">", lt) if more else -1) if sign and sign in "!?/" else -1
            if comment:
                at = shut + 3 if shut >= 0 else end
            elif shut >= 0:
                at = shut + 1
            else:
                more = more and not (sign and sign in "!?/")
                say("<")
                at = lt + 1
            continue
        gt = scanner.end_of_tag(m.end()) if more else -1
        if gt < 0:  # no tag ends any more
            say(page[lt:])
            break
        at, name, attributes = gt + 1, m.group(2).lower(), page[m.end() : gt]
        if m.group(1):
            if name in BLOCKS:
                flush()
            k = last((name,))
            if k >= 0 and (name in BLOCKS or not blocks or k > blocks[-1]):
                close(k)
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = shut.end() if shut else end
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in BLOCKS:
            flush()
            if name in CLOSES_P and (k := last("p")) >= 0 and k == blocks[-1]:
                # what is open inside the paragraph goes with it, but a mark of boilerplate on it ends too
                close(k)
            if (k := last(SAME.get(name, ()))) >= 0 and k > last((*LISTS, "tr") if name in ("td", "th") else LISTS):
                close(k)
        if name in VOID:
            continue
        elements += 1
        inside, form = top.article, top.form or name == "form"
        if (name in ("article", "main") or 'role="main"' in attributes or "articleBody" in attributes) and not (top.article or top.boiler):
            articles += 1
            inside, form = articles, False
        boiler, soft = _is_boiler(name, attributes, bool(top.article))
        within = top.within if name in TEXTS or name not in BLOCKS else elements
        top = _Open(name, top.boiler or boiler, inside, top.own_header or name == "header" and bool(top.article), form, top.soft or soft, within)
        places.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append(top)
    flush()
    return out


def weights(found: list[Line]) -> tuple[list[int], list[bool]]:
    """What lines weigh in the distribution, -1 for what is never text; and which stand in articles that hold most of the text."""
    in_forms = sum(x.own for x in found if x.form and not x.boiler)
    wrapped = in_forms > sum(x.own for x in found if not x.form and not x.boiler)
    kept = [not x.boiler and (wrapped or not x.form) for x in found]
    marked = sum(x.own for x, k in zip(found, kept, strict=True) if k and x.article)
    most = marked > 0 and 2 * marked >= sum(x.own for x, k in zip(found, kept, strict=True) if k)
    inside = [most and x.article > 0 for x in found]
    own = []
    for x, k, a in zip(found, kept, inside, strict=True):
        weight = 0 if len(x.text) > 2 * x.own else max(1, x.own // 4) if x.soft or most and not a else x.own
        own.append((weight + BONUS * a) if k else -1)
    return own, inside


def spans(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """(first, behind the last) of the lines from each surge to its dive."""
    sums, total = [0] * len(weights), 0
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < len(weights) else 0)
        sums[i] = total
    found, start = [], None
    for i in range(len(weights) + 1):
        if start is None:
            if i < len(weights) and weights[i] and sums[i] >= surge:
                start = i
                while start and weights[start - 1]:  # short lines right before it, such as a heading
                    start -= 1
        elif i == len(weights) or not sums[i]:
            found.append((start, i))
            start = None
    return found


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page: its blocks in page order, one a line. Without a window all lines with weight are."""
    found = lines(page or "")
    own, articles = weights(found)
    picked: set[int] = set()
    parts = [[i for i, a in enumerate(articles) if a]]
    for i, a in enumerate(articles):
        if not a:
            if i == 0 or articles[i - 1]:
                parts.append([])
            parts[-1].append(i)
    for at in parts if window else ():
        picked.update(i for first, behind in spans([max(0, own[i]) for i in at], window, surge) for i in at[first:behind])
    if picked:
        homes = {found[i].within for i in picked if own[i] > 0}
        taken = [own[i] >= 0 and (i in picked or own[i] > 0 and x.within in homes) for i, x in enumerate(found)]
    else:
        taken = [w > 0 and (a or not window or not any(articles)) for w, a in zip(own, articles, strict=True)]
    return "\n".join(x.text for x, t in zip(found, taken, strict=True) if t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (id, url, text) for each page."""
    prepare(pages.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())], schema)

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "id long, url string, text string")


def query(spark, sf_dir):
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: For pages as regular as those of `pages`: one article with headings, paragraphs, bold text and line breaks.
ORACLE = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '') AS body FROM pages),
b AS (SELECT page_id, url, string_split_regex(replace(replace(replace(body, '<b>', ''), '</b>', ''), '<br>', ' '), '</?(?:h1|p)>') AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM b),
d AS (SELECT page_id, url, coalesce(array_to_string(parts, chr(10)), '') AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
