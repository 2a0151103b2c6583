import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers as pt
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from htmlframe.llm import bpe, chat, fingerprint, html_extract, labelled, packing, quality, toxicity

RANKS = pt.path("byte_bpe_multi_50k.tiktoken")
WORDS = pt.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "\n\n", "é\U0001f600<|endoftext|>", "x" * 3000, "It's  THE\tend.\r\n", "日本語 ½ ² ǅ"]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def clash(spark, rows=ODD):
    """Odd texts with repeated ids, a null id, and columns named like those the operators make."""
    data = [(None if i == 3 else i // 2, t, "ids", 1.5, "x") for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, id string, score double, sig string")


# -- byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(bpe.read_ranks(RANKS), pt.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_is_the_library(coder, library, documents):
    rnd = random.Random(5)
    texts = [r.text for r in documents.select("text").collect()] + [t or "" for t in ODD]
    for _ in range(1500):
        texts.append("".join(chr(rnd.choice((rnd.randint(32, 126), rnd.randint(97, 105), rnd.randint(0xC0, 0x24F), rnd.randint(0x4E00, 0x9FFF), 0x1F600, 10, 32))) for _ in range(rnd.randint(0, 30))))
    for t in texts:
        ids = coder.encode(t)
        assert ids == library.encode_ordinary(t)
        assert coder.decode(ids) == t


def test_bpe_small_tables_and_long_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    small = bpe.ByteBpe(bpe.read_ranks(RANKS), pt.PATTERN, most_pieces=5)
    small.transducer.most = 60
    t = "Wohin gehst du, école élémentaire? 日本語 " * 9
    assert small.encode(t) == library.encode_ordinary(t)
    assert small.decode(small.encode(t)) == t


def test_bpe_tables_stay_bounded(library):
    """One piece of 150,000 letters."""
    t = bpe.Transducer(bpe.read_ranks(RANKS), 1000)
    rnd = random.Random(7)
    piece = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150_000))
    assert t.encode_piece(piece.encode()) == library.encode_ordinary(piece)
    assert len(t.moves) <= 1000 and len(t.states) <= 1002


def test_bpe_borders(coder):
    rnd = random.Random(2)
    t = coder.transducer
    for _ in range(3000):
        a, b = rnd.randrange(50256), rnd.randrange(50256)
        assert t._compatible(a, b) == (bpe.merge_by_rank(t.bytes_of[a] + t.bytes_of[b], t.ranks) == [a, b])


def test_utf8_machine():
    raw = "aé日\U0001f600b".encode()
    for step in (1, 2, 3, 5):
        m = bpe.Utf8Machine()
        assert "".join([*(m.push(raw[i : i + step]) for i in range(0, len(raw), step)), m.finish()]) == "aé日\U0001f600b"
    m = bpe.Utf8Machine()
    assert m.push(b"a\xe6\x97") + m.finish() == "a�" and bpe.Utf8Machine().push(b"\xff\x80x") == "��x"


def test_bpe_query(spark, sf, library, documents):
    want = {r.doc_id: library.encode_ordinary(r.text) for r in documents.collect()}
    for r in bpe.query(spark, sf).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_bpe_odd_rows(spark):
    got = bpe.encode_documents(clash(spark), RANKS, pt.PATTERN).collect()
    assert len(got) == len(ODD) and sorted(r.decoded for r in got) == sorted(t or "" for t in ODD)
    assert bpe.encode_documents(clash(spark).limit(0), RANKS, pt.PATTERN).count() == 0


# -- packing


def test_words_are_the_library(documents):
    mine, library = packing.WordTokenizer(WORDS, 300), Tokenizer.from_file(WORDS)
    for t in [*(r.text for r in documents.select("text").collect()), *(t or "" for t in ODD), "don't ain't 3.14 a,b ΣΑΣ İ x² e\u0301"]:
        assert mine.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def fewest(lengths, capacity):
    """Sequences needed, by trying everything."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in sorted(set(range(len(rooms))), key=lambda k: rooms[k]):
            if rooms[k] >= lengths[i]:
                put(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def test_pack_is_the_best(spark):
    rnd = random.Random(1)
    for k in range(60):
        lengths = sorted((rnd.randint(5, 30 if k % 2 else 60) for _ in range(rnd.randint(0, 9))), reverse=True)
        got = packing.pack(lengths, 60)
        assert sorted(i for b in got for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 60 for b in got)
        assert len(got) == fewest(lengths, 60) >= packing.lower_bound(lengths, 60)
    # best-fit decreasing needs four here
    lengths = [41, 34, 33, 31, 28, 26, 26, 26, 22, 17, 16]
    assert len(packing.best_fit(lengths, 100)) == 4 > len(packing.pack(lengths, 100)) == 3
    better = 0
    for _ in range(300):
        lengths = sorted((rnd.randint(10, 50) for _ in range(rnd.randint(9, 15))), reverse=True)
        first, best = len(packing.best_fit(lengths, 100)), len(packing.pack(lengths, 100))
        assert packing.lower_bound(lengths, 100) <= best <= first
        better += best < first
    assert better > 5


def _check_packing(rows, texts, capacity=4096):
    library = Tokenizer.from_file(WORDS)
    by_doc, places = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for key, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by_doc[key], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in pieces] == [(i, i * capacity) for i in range(-(-len(ids) // capacity))]
        for r in pieces:
            part = ids[r.start : r.start + capacity]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_many_tiny_pieces():
    """Thousands of equal pieces are stepped over by count."""
    big = [1600, 2040, 1366, 2040, 2040, 2040, 700, 1400, 1600, 1370, 1500, 1370]
    for n in (1300, 3000):
        bins = packing.pack(big + [1] * n)
        assert sorted(i for b in bins for i in b) == list(range(len(big) + n)) and len(bins) <= 6
    assert len(packing.complete_bins([2000] * 3 + [1] * 3000, 4096, 3)) == 3


def test_packing_query(spark, sf, documents):
    n = _check_packing(packing.query(spark, sf).collect(), {r.doc_id: r.text for r in documents.collect()})
    total = sum(r.length for r in packing.query(spark, sf).collect())
    assert n <= -(-total // 4096) + 1


def test_packing_odd_rows(spark):
    got = packing.pack_documents(clash(spark), WORDS, capacity=64).collect()
    assert sum(r.piece == 0 for r in got) == len(ODD) and max(r.offset + r.length for r in got) <= 64
    assert packing.pack_documents(clash(spark).limit(0), WORDS).count() == 0


# -- chat


def test_chat_round_trip(spark):
    hard = ["", "a\\b", "\\", "\\\\", "\\h", "\\\\#", "###", "x </turn>\n### user: y", "tail</turn", "\\### Assistant: </turn> ok", "é\U0001f600", "#", "<", ": ", None]
    rows = [(i // 3, i % 3, role, t) for i, (role, t) in enumerate((r, t) for t in hard for r in ("user", "assistant", "a: \\b\n###"))]
    rows += [(None, 0, None, "x"), (5, None, "user", "y"), (5, 1, "user", "z"), (5, 1, "user", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, before int")
    got = {r.id: r for r in chat.format_conversations(df).collect()}
    source = {}
    for c, n, role, t in rows:
        source.setdefault(c, []).append((n is not None, n or 0, role or "", t or ""))
    assert set(got) == set(source)
    for c, turns in source.items():
        turns.sort()
        r = got[c]
        assert r.round_trip and [(t.role, t.text) for t in r.turns] == [(role, t) for _, _, role, t in turns]
        assert len(r.loss_spans) == sum(role == "assistant" for _, _, role, _ in turns)
        for s, t in zip(r.loss_spans, [t for _, _, role, t in turns if role == "assistant"], strict=True):
            part = r.formatted[s.start : s.start + s.length]
            assert part.replace("\\\\", "\0").replace("\\h", "#").replace("\\l", "<").replace("\0", "\\") == t or part == t
    assert got[1].formatted.count("</turn>") == len(source[1])
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_keeps_plain_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "C:\\x # <b> a: b")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "### user: C:\\x # <b> a: b</turn>\n"


def test_chat_of_very_long_texts(spark):
    text = ("x </turn>\n### user: \\y # < : " * 12_000) + "z" * 100_000
    r = chat.format_conversations(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")).first()
    assert r.round_trip and [t.text for t in r.turns] == [text, text]


# -- main text


PAGE = (
    "<html><body class='home has-sidebar'><header><h1>Site</h1><a href=x>Home</a></header><div class=cookie-notice>We use cookies here, and many of them</div><div class=sidebar><p>About us</div>"
    "<div class=content><h2>Main title</h2><p>First paragraph with <a href=y>a link</a> &amp; enough text to stand out.</p><div class=ad>Buy now</div><p>Second  one<br>goes on.<p>Third.<ul><li>item<li>item two</ul>"
    "<form><label>Mail</label></form></div><div id=comments><p>Great post, I liked it very much indeed, thank you for this.</div><footer>(c)</footer></body></html>"
)


def test_main_text():
    assert html_extract.main_text(PAGE) == "Main title\nFirst paragraph with a link & enough text to stand out.\nSecond one goes on.\nThird.\nitem\nitem two"
    assert html_extract.main_text("<article><header><h1>T</h1>by me</header><p>a<aside>x</aside><p>b</article><p>c") == "T\na\nb"
    assert html_extract.main_text("<main><p>a&nbsp;b</p><script>x</script><!-- y --><p hidden>n<p>z") == "a b\nz"
    for t in (None, "", "   ", "<", "<p", "<!--", "</p>", "<script>"):
        assert html_extract.main_text(t) in ("", "<", "<p")


LONG = "This sentence is long enough for a window to rise over the threshold of a surge."


def test_main_text_marked_pages():
    parts = [f"<article><h2>{n}</h2><p>{LONG} {n}</article>" + "<p>Outside line." * 4 for n in ("One", "Two")]
    want = f"One\n{LONG} One\nTwo\n{LONG} Two"
    assert html_extract.main_text("".join(parts)) == want
    assert html_extract.main_text("".join(parts) + "<article><p>Short.</article>") == want + "\nShort."
    # the windows run on marked pages, too: without one that can rise, no span is found
    assert html_extract.main_text(f"<article><p>{LONG}</article>", window=0) == LONG
    assert html_extract.main_text(f"<article><p>{LONG}<p><a href=x>Only a link</a><p>End.</article>") == f"{LONG}\nOnly a link\nEnd."


def test_main_text_unmarked_pages():
    box = "<div class=ad><p>Buy<p>this<p>now<p>please</div>"
    assert html_extract.main_text(f"<div><h1>T</h1><p>{LONG} 1{box}<p>{LONG} 2 and {LONG}</div>") == f"T\n{LONG} 1\n{LONG} 2 and {LONG}"
    links = "<p><a href=x>first link</a><p><a href=y>second link</a>"
    assert html_extract.main_text(f"<p>{LONG} 1{links}<p>{LONG} 2") == f"{LONG} 1\nfirst link\nsecond link\n{LONG} 2"
    assert html_extract.main_text(f"<p>{LONG} 1{links * 3}<p>{LONG} 2 and {LONG}") == f"{LONG} 1\n{LONG} 2 and {LONG}"


@pytest.mark.parametrize("attribute", ["class='wrap has-sidebar'", "id='no-sidebar'", "class='page-with-sidebar-left x'"])
def test_main_text_layout_classes(attribute):
    assert html_extract.main_text(f"<div {attribute}><h1 class='page-header'>T</h1><p>{LONG}</div>") == f"T\n{LONG}"
    assert html_extract.main_text(f"<div {attribute}><article><p>{LONG}</article><p>Outside.</div>") == LONG
    assert html_extract.main_text(f"<div class='has-x sidebar'><p>{LONG}</div><div class='comments-header'>{LONG}</div>") == ""


def plain_spans(w, window, surge):
    """Lines of all surges and their dives, from the definition, line by line."""
    inside, out = False, set()
    sums = [sum(w[i : i + window]) for i in range(len(w))]
    for i in range(len(w)):
        if not inside and w[i] and sums[i] >= surge:
            inside, k = True, i
            while k >= 0 and w[k]:
                out.add(k)
                k -= 1
        elif inside and not sums[i]:
            inside = False
        if inside:
            out.add(i)
    return out


def test_spans_are_the_plain_ones():
    rnd = random.Random(3)
    for _ in range(800):
        w = [rnd.choice((0, 0, 5, 30, 80)) for _ in range(rnd.randint(0, 25))]
        window, surge = rnd.randint(1, 4), rnd.choice((20, 60, 100))
        assert {i for a, b in html_extract.spans(w, window, surge) for i in range(a, b)} == plain_spans(w, window, surge)


def test_main_text_keeps_the_rest():
    links = "".join(f"<p><a href=x>link {i}</a>" for i in range(5))
    assert html_extract.main_text(f"<div><h2>A</h2><p>{LONG} 1<nav>{links}</nav><h2>B</h2><p>{LONG} 2</div>") == f"A\n{LONG} 1\nB\n{LONG} 2"
    assert html_extract.main_text(f"<p>{LONG} 1{links}<h2>B</h2><p>{LONG} 2") == f"{LONG} 1\nB\n{LONG} 2"
    kept = f"<section class='related-work'><h2>Related work</h2><p>{LONG}</section><p class='search-results'>Found.<p class='article-notice meta'>Noted.<footer>f</footer>"
    assert html_extract.main_text(f"<article><p>{LONG}{kept}<div class='share-buttons'>Share</div></article>") == f"{LONG}\nRelated work\n{LONG}\nFound.\nNoted."


@pytest.mark.parametrize("name", "text-navy navy menu-of-the-day social-history share-price replies-to-critics promo respond comments-on-law subscription-model rail widget-theory foot".split())
def test_main_text_keeps_paragraphs_of_any_class(name):
    for page in (f"<article><p>{LONG}<p class='{name}'>Short.<p>End.</article>", f"<div><p>{LONG}<p class='{name}'>Short.<p>End.</div>"):
        assert html_extract.main_text(page) == f"{LONG}\nShort.\nEnd."
    if "-" in name:
        assert html_extract.main_text(f"<article><p>{LONG}<div class='{name}'><p>Box.</div></article>") == f"{LONG}\nBox."


@pytest.mark.parametrize("name", ["ad", "ads", "ad-slot", "cookie-notice", "site-nav", "post-comments", "newsletter-signup", "share-buttons", "advert-1", "comment_list", "promo box"])
def test_main_text_leaves_marked_containers_out(name):
    assert html_extract.main_text(f"<article><p>{LONG}<div class='{name}'><p>{LONG} {LONG}</div><p>End.</article>") == f"{LONG}\nEnd."


def test_main_text_in_forms_and_beside_teasers():
    assert html_extract.main_text(f"<form id=f><article><p>{LONG}</article></form>") == LONG
    assert html_extract.main_text(f"<form id=aspnet><div><h1>T</h1><p>{LONG}<input value=x></div></form><p>Out.") == f"T\n{LONG}\nOut."
    assert html_extract.main_text(f"<div><p>{LONG}<form>Your name <input></form><p>{LONG} 2</div>") == f"{LONG}\n{LONG} 2"
    assert html_extract.main_text(f"<div><p>{LONG}<p>{LONG} 2</div><article>see this</article>").startswith(f"{LONG}\n{LONG} 2")
    links = "".join(f"<li><a href=x>link {i}</a>" for i in range(6))
    assert html_extract.main_text(f"<div><p>{LONG}<ul>{links}</ul><p>Short end.</div>") == f"{LONG}\nShort end."


def test_windows_decide_on_pages_with_an_article():
    """A stray line outside an article goes, a long text outside stays; without windows both stay."""
    page = f"<div>Stray line.</div><article><h1>T</h1><p>{LONG} {LONG} {LONG} {LONG} {LONG}</article><div>{{}}</div>"
    body = " ".join([LONG] * 5)
    assert html_extract.main_text(page.format("Other.")) == f"T\n{body}"
    assert html_extract.main_text(page.format("Other."), window=0) == f"Stray line.\nT\n{body}\nOther."
    assert html_extract.main_text(page.format(f"{LONG} {LONG} {LONG}")) == f"T\n{body}\n{LONG} {LONG} {LONG}"


def test_main_text_grows_in_proportion():
    """Malformed pages of twice the length take about twice the time."""
    for part in ('<a "x ', "<b><i></u>", "<p><b>x", "<", "<a href='x>y", "<!-- x", "</a ", "<li><b>y"):
        took = []
        for n in (3000, 12000):
            begin = time.thread_time()
            html_extract.main_text(part * n)
            took.append(time.thread_time() - begin)
        assert took[1] < 12 * took[0] + 0.2, part
    took = []
    for n in (4000, 16000):
        begin = time.thread_time()
        html_extract.main_text("<b><div>" + "<i>" * n + "</b>" * n)
        html_extract.main_text("<!" * 10 * n)
        took.append(time.thread_time() - begin)
    assert took[1] < 12 * took[0] + 0.2
    assert html_extract.main_text(f"<p>{LONG}<a href='x>y</a><p>{LONG} 2") == f"{LONG}y\n{LONG} 2"


def test_main_text_query(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.sql(html_extract.ORACLE).fetchall()}
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in html_extract.query(spark, sf).collect()} == want
    df = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "<p>x", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_extract.extract(df).collect()) == ["", "", "x"]
    assert html_extract.extract(df.limit(0)).count() == 0


# -- classifiers


def test_quality_learns(spark, documents):
    rows = [(f"plain words about thing {i} and the other side of it", 1) for i in range(40)] + [(f"BUY{i}!! NOW!! CHEAP%%% $$$ {i}", 0) for i in range(40)]
    m = quality.train(rows)
    assert m.score("quiet words about the garden and a side") > 0.5 > m.score("SALE!! SALE!! $$$ %%%")
    assert 0 <= m.score(None) <= 1 and m.score("") == m.score(None)
    again = quality.train(rows)
    assert again.score("words") == m.score("words")
    assert quality.train([]).score("x") == pytest.approx(0.5, abs=0.1)


def plain_quality_features(text):
    """Buckets of a text's words, n-grams and word pairs, one after another."""
    top, base, mix = 1 << 64, 0x100000001B3, 0x9E3779B97F4A7C15

    def spread(h, salt):
        h = (h + salt) * mix % top
        return (h ^ h >> 29) >> 20 & quality.BUCKETS - 1

    t = "".join(" " if c in "\t\n\v\f\r" else c for c in f" {text} ")
    power = [pow(base, i + 1, top) for i in range(4096)]
    out = []
    for n in quality.NGRAMS:
        for i in range(len(t) - n + 1):
            if " " not in t[i + 1 : i + n - 1]:
                out.append(spread(sum(ord(c) * power[j] for j, c in enumerate(t[i : i + n])) % top, n))
    words = [sum((ord(c) + 1) * power[j & 4095] for j, c in enumerate(w)) % top for w in t.split(" ") if w]
    return out + [spread(w, 1) for w in words] + [spread((a * mix + b) % top, 2) for a, b in zip(words, words[1:], strict=False)]


def test_quality_is_the_plain_scorer(documents):
    texts = [r.text for r in documents.limit(25).collect()] + [t or "" for t in ODD] + ["über Ölé 日本語", "no no\tno\r\nyes"]
    m = quality.train([(t, i % 2) for i, t in enumerate(texts)], epochs=1)
    for t in texts:
        f = plain_quality_features(t)
        assert sorted(quality.features(t).tolist()) == sorted(f)
        z = m.bias + (sum(float(m.weight[i]) for i in f) / len(f) if f else 0)
        assert m.score(t) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_quality_features_in_blocks(monkeypatch):
    text = "one two three four five sïx " * 20
    whole = np.bincount(quality.features(text), minlength=quality.BUCKETS)
    monkeypatch.setattr(quality, "BLOCK", 32)
    parts = sum(np.bincount(quality.features(b), minlength=quality.BUCKETS) for b in quality.blocks(text))
    assert "".join(quality.blocks(text)) == text and abs(whole - parts).sum() < 0.2 * whole.sum()
    assert "".join(quality.blocks("x" * 100)) == "x" * 100
    assert len(quality.features("nö nö nö")) == len(plain_quality_features("nö nö nö")) and quality.features("nö nä")[-1] != quality.features("nä nö")[-1]


def _labels(spark, sf, module, label, least):
    big = sf.replace("0.001", "0.1")
    got = module.query(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    one = got.where("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("a"), F.min("score"), F.max("score")).first()
    assert one.a >= least and one[1] >= 0 and one[2] <= 1
    wrong = module.query(spark, sf).where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)).count()
    assert wrong == 0


def test_quality_held_out(spark, sf):
    """0.962; it was 1.0 while any word said twice was one feature, which served these tables' junk and no other."""
    _labels(spark, sf, quality, "quality", 0.95)


def test_toxicity_held_out(spark, sf):
    _labels(spark, sf, toxicity, "toxic", 0.95)


def test_toxicity_learns():
    rnd = random.Random(3)
    plain = "the garden is green and the river runs slowly past old houses where people talk".split()
    rows = [(" ".join(rnd.choices(plain, k=30)), 0) for _ in range(300)]
    # voters are believed for agreeing, so a toxic text has more than one such word
    rows += [(" ".join([*rnd.choices(plain, k=20), *rnd.sample(["zornbold", "zornboldi", "zornboldas", "grumpf", "mulk"], k=rnd.choice((2, 3))), *rnd.choices(plain, k=9)]), 1) for _ in range(120)]
    m = toxicity.train(rows)
    assert m.score("the garden zornboldus runs, grumpf") > 0.7 and m.score("river grumpf. past mulk") > 0.7 and m.score("old houses and people") < 0.3
    assert m.score(" ".join(plain * 500) + " grumpf mulk") > 0.7
    assert m.score(None) == m.score("") < 0.7
    assert toxicity.train([]).score("x") < 0.7


def test_label_model_beats_its_voters():
    """Voters of known accuracy, and copies of a bad one: agreement alone finds them out, and the posterior needs it."""
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    right = [0.9, 0.85, 0.8, 0.8, 0.75, 0.7]
    own = [np.where(rng.random(4000) < r, y, ~y) for r in right]
    bad = rng.random(4000) < np.where(y, 0.55, 0.35)
    v = np.stack([*own, *[np.where(rng.random(4000) < 0.97, bad, ~bad) for _ in range(4)]], axis=1).astype(np.int8)
    p, rate, corr, weight = toxicity.label_model(v)
    good = lambda x: (x == y).mean()
    assert good(p > 0.5) > max(good(v[:, j] > 0) for j in range(10)) + 0.02
    assert good(p > 0.5) > good(v.sum(axis=1) > 5) + 0.05 and good(p > 0.5) > good(v.sum(axis=1) >= 2) + 0.05
    for j, r in enumerate(right):
        assert rate[0, j] == pytest.approx(r, abs=0.06) and rate[1, j] == pytest.approx(1 - r, abs=0.06)
    assert corr[6:, 6:].max() > 0.7 > 0.3 > corr[:6, :6].max() and weight[6:].max() < 0.5 < weight[:6].min()


def test_posterior_of_documents(spark, sf):
    """On real votes the posterior beats every voter, and labels only say which class is which."""
    big = sf.replace("0.001", "0.1")
    rows = labelled.sample(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"), "toxic", toxicity.MOST)
    e = toxicity.Evidence(toxicity.mine(rows))
    shown, y = [e.of(t) for t, _ in rows], np.array([y for _, y in rows])
    v, p = toxicity.votes(e, shown), toxicity.posterior(e, shown, y.tolist())
    fire = v.any(axis=0)
    assert fire.sum() >= 12 and ((p > 0.5) == y).mean() > max((v[:, j] == y).mean() for j in range(v.shape[1])) + 0.02
    half = y.copy()
    half[::2] = 0
    assert (toxicity.posterior(e, shown, half.tolist()) == p).all()


def test_toxicity_is_the_plain_scorer(documents):
    """Scores by looking for each term, word and pattern in turn."""
    texts = [r.text for r in documents.limit(150).collect()] + [t or "" for t in ODD] + ["You pathetic CLOWN, shut up.", "an idiot's idiotic trash-talk", "x " * 9000 + "moron scum"]
    terms = ["idio*", "trash", "talk*", "moron"]
    e = toxicity.Evidence(terms)
    m = toxicity.ToxicityModel(terms, np.random.default_rng(1).normal(size=e.width), -0.5)
    others = [w for x in toxicity.LEXICONS.values() for w in x.split() if w not in terms]
    for t in texts:
        low = t.lower()
        words = set(re.findall(r"[^\W\d_]+", low))
        shown = [any(w.startswith(x[:-1]) and len(w) >= len(x) for w in words) if x.endswith("*") else x in words for x in terms]
        shown += [w in words for w in others] + [bool(re.search(x, low)) for x in toxicity.PATTERNS.values()]
        assert m.score(t) == pytest.approx(1 / (1 + np.exp(0.5 - float(m.weight @ np.array(shown, float)))), abs=1e-9)


def test_toxicity_patterns_alone():
    e = toxicity.Evidence([])
    command, naming = e.width - 2, e.width - 1
    assert e.of("Now shut up, please") == e.of("go to hell") == e.of("get lost") == e.of("drop dead") == [command]
    assert e.of("a bunch of idiots") == e.of("such morons, total losers") == [naming]
    assert e.of("idiots sit there") == e.of("a calm text") == []
    rows = [(f"the garden number {i} is green", 0) for i in range(200)] + [(f"shut up about house {i}", 1) for i in range(60)]
    voted = toxicity.votes(toxicity.Evidence([]), [toxicity.Evidence([]).of(t) for t, _ in rows])
    assert voted[-1, -2] == 1 and voted[-1].sum() == 1 and not voted[:200].any()
    assert e.of("a pathetic, stupid remark")[-1] == e.width - 4


def test_classifiers_odd_rows(spark):
    df = clash(spark)
    for module, model in ((quality, quality.train([])), (toxicity, toxicity.train([]))):
        got = module.score(df, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert module.score(df.limit(0), model).count() == 0
    short = labelled.sample(df, spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int"), "quality", (9, 9), 10)
    assert 1 <= len(short) < len(ODD) and all(len(t) <= 10 for t, _ in short)
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (1, None, None), (1, 7, 7)], "doc_id long, quality int, toxic int")
    assert 0 <= quality.fit(df, labels).score("a") <= 1 and 0 <= toxicity.fit(df, labels.limit(0)).score("a") <= 1


# -- document fingerprints


def runs(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_query(spark, sf, documents):
    texts = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in fingerprint.query(spark, sf).collect()}
    off = []
    for i, (key, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = got[key]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(runs(t), runs(edited)), r.near_next - jaccard(runs(t), runs(after))]
    assert abs(np.mean(off)) < 0.01 and np.mean(np.abs(off)) < 0.04 and np.max(np.abs(off)) < 0.16
    same = {}
    for key, t in texts:
        assert same.setdefault(t, got[key].fingerprint) == got[key].fingerprint


def test_fingerprint_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE", 2)
    df = clash(spark)
    own = fingerprint.with_next(fingerprint.fingerprints(df), "id", ["text"], ["text"]).collect()
    order = sorted((t[0] is not None, t[0] or 0, t[1]) for t in [(None if i == 3 else i // 2, x or "") for i, x in enumerate(ODD)])
    after = sorted((a[2], b[2]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert sorted((r.text, r.next_text) for r in own) == after
    slots = {r.text: r.slots for r in own}
    assert len(slots[""]) == len(slots[" "]) == 0 and len(slots["a"]) == fingerprint.BINS
    one = fingerprint.with_next(fingerprint.fingerprints(df.limit(1)), "id", ["text"], ["text"]).collect()
    assert len(one) == 1 and one[0].next_text == one[0].text
    assert fingerprint.with_next(fingerprint.fingerprints(df.limit(0)), "id", ["text"], ["text"]).count() == 0


def spark_hash(*values):
    """Spark's xxhash64: each value hashed with the hash so far as its seed. Longs in pairs ("q", n), ints ("i", n), or text."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<" + v[0], v[1]), h)
    return h - (1 << 64) if h >> 63 else h


def plain_slots(text):
    """Stored bits of a text's bins, worked out value by value."""
    words = text.split()
    if not words:
        return []
    w = [("q", spark_hash(x)) for x in words]
    h = [spark_hash(*w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    least = {}
    for x in h:
        b = (x >> 56 & 255) ^ 128  # from the smallest signed value
        least[b] = min(x, least.get(b, x))
    out = []
    for b in range(fingerprint.BINS):
        own = [spark_hash(("q", b), ("i", r)) % fingerprint.BINS for r in range(fingerprint.TRIES)]
        x = least.get(b) if b in least else next((least[p] for p in own if p in least), None)
        if x is None:
            x = least[min(least, key=lambda o: (spark_hash(("q", b), ("q", o ^ 128)), least[o]))]
        out.append((x & 255) - 128)
    return out


def test_fingerprints_are_the_plain_ones(spark, documents):
    df = documents.select("doc_id", "text").limit(60).union(spark.createDataFrame([(-1, "one two three"), (-2, "a b c d e f g"), (-3, "word " * 20_000)], "doc_id long, text string"))
    for r in fingerprint.fingerprints(df).collect():
        assert list(r.slots) == plain_slots(r.text)


def test_ranges_of_ids_with_outliers(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE", 100)
    df = spark.range(2000).union(spark.createDataFrame([(10**15,), (-(10**17),)], "id long")).withColumn("text", F.col("id").cast("string"))
    sizes = [r["count"] for r in fingerprint.with_range(df, "id").groupBy("range_").count().collect()]
    assert sum(sizes) == 2002 and max(sizes) < 220 and len(sizes) > 15
    got = {r.id: r.next_text for r in fingerprint.with_next(df, "id", ["text"], ["text"]).collect()}
    ids = sorted(got)
    assert got == {a: str(b) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_fingerprints_of_very_long_texts(spark):
    text = " ".join(f"wort{i * 7919 % 99991}" for i in range(60_000))
    got = fingerprint.fingerprints(spark.createDataFrame([(1, text), (2, text + " end"), (3, None)], "doc_id long, text string")).select("text", "slots").collect()
    slots = {len(r.text or ""): list(r.slots) for r in got}
    assert slots[len(text)] == plain_slots(text) and sum(a != b for a, b in zip(slots[len(text)], slots[len(text) + 4], strict=True)) < 8
