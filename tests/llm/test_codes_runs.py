"""Vector codes, periodic runs and BPE by tree concatenation against plain versions and the public library."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as pt
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from htmlframe.llm import codes, runs, treebpe

PATH = pt.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "\n\n", "é\U0001f600<|endoftext|>", "x" * 3000, "It's  THE\tend.\r\n", "日本語 ½ ² ǅ", "la " * 40, "<|endoftext|>" * 3]


@pytest.fixture(scope="module")
def clash(spark):
    """Odd texts with repeated ids, a null id, and columns named like those the operators make."""
    rows = [(None if i == 3 else i // 2, t, "ids", 1.5, "x") for i, t in enumerate([*ODD, *ODD[-2:]])]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, runs double, key string")


# -- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error) by loops over Python integers."""
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[0])
    length = -(-max((len(v) for _, v in rows), default=0) // parts)
    whole = [[math.floor(256 * x) for x in v] + [0] * (parts * length - len(v)) for _, v in rows]
    cut = [[v[p * length : (p + 1) * length] for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def met(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in cut:
                got.setdefault(met(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e])] if e in got else c for e, c in enumerate(books[p])]
    best = [[met(v[p], books[p]) for p in range(parts)] for v in cut]
    return sorted((r[0], [e for _, e in b], sum(d for d, _ in b)) for r, b in zip(rows, best)), books


def test_codes_are_the_plain_ones(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.4) for _ in range(48)], rnd.choice(("a", "b", None))) for i in range(150)]
    rows += [(200, None, "a"), (201, [None] * 48, "a"), (202, [float("nan")] * 48, "b"), (203, [1.0] * 47 + [float("inf")], "b"), (204, [], "c"), (205, [0.5] * 5, None), (206, rows[0][1], "a"), (207, [-0.001] * 48, "b"), (208, [], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("error", F.lit(1)).repartition(5)
    got, books = codes.vector_codes(df)
    want, plain = plain_codes([r[:2] for r in rows])
    got = got.collect()
    assert sorted((r.id, r.codes, r.error) for r in got) == want
    assert books.tolist() == plain
    label = {r[0]: r[2] for r in rows}
    total = {k: sum(e for i, _, e in want if label[i] == k) for k in ("a", "b", "c", None)}
    assert all(r.label_error == total[r.label] and r.label == label[r.id] for r in got)


def test_codes_empty_small_repeated_and_large(spark):
    schema = "vec_id long, embedding array<float>, label int"
    got, books = codes.vector_codes(spark.createDataFrame([], schema))
    assert got.collect() == [] and books.size == 0
    got, _ = codes.vector_codes(spark.createDataFrame([(1, [], 1), (None, [], None)], schema))
    assert {(r.id, r.error, r.label_error) for r in got.collect()} == {(1, 0, 0), (None, 0, 0)}
    same = [0.25] * 16
    got, books = codes.vector_codes(spark.createDataFrame([(1, same, 1), (1, same, 1), (None, [0.75] * 16, None), (2, [3e38] * 16, 2)], schema))
    assert sorted((r.id or 0, r.codes[0], r.error) for r in got.collect()) == [(0, 3, 0), (1, 0, 0), (1, 0, 0), (2, 2, 0)]
    assert books[0, :, 0].tolist() == [64, 64, 1 << 28, 192]  # of equal entries the first is met, the second stays


def test_hot_labels_are_broadcast_and_the_rest_shuffled(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, "hot").otherwise(F.concat(F.lit("k"), F.floor(F.col("id") / 6))).alias("label"), F.col("id").alias("error"))
    for share in (0.001, 0.5, 0.0):
        monkeypatch.setattr(codes, "HOT_SHARE", share)
        got = codes.with_group_sum(rows, "label", "error", "s").groupBy("label").agg(F.sum("error").alias("e"), F.max("s").alias("s"), F.count("*").alias("n")).collect()
        assert all(r.e == r.s for r in got) and sum(r.n for r in got) == 3000


def test_codes_query_is_its_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    got = codes.query(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({codes.ORACLE})").fetchall())


# -- periodic runs


def plain_runs(w, least=24, times=3):
    n, out = len(w), set()
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            x = w[start : i + p]
            if len(x) >= max(least, times * p) and not any(x[:-q] == x[q:] for q in range(1, p)):
                out.add((start, len(x), p))
            i += 1
    return sorted(out)


def test_runs_are_the_plain_ones(monkeypatch):
    rnd = random.Random(1)
    for _ in range(600):
        n, signs = rnd.randint(0, 240), rnd.choice((1, 2, 2, 3, 5, 40))
        w = [rnd.randrange(signs) for _ in range(n)]
        for _ in range(rnd.randint(0, 4) if n else 0):
            s, q, length = rnd.randrange(n), rnd.randint(1, 30), rnd.randint(1, 120)
            for i in range(s + q, min(n, s + length)):
                w[i] = w[i - q]
        monkeypatch.setattr(runs, "SMALL_BLOCK", rnd.choice((1 << 16, 1, 50)))
        monkeypatch.setattr(runs, "BLOCK", rnd.choice((1 << 20, 100, 10)))
        monkeypatch.setattr(runs, "CHUNK", rnd.choice((1 << 16, 8)))
        for least, times in ((24, 3), (3, 3), (10, 4)):
            assert runs.find_runs(np.array(w, np.int32), least, times) == plain_runs(w, least, times)
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.int32), 2, 2)


def test_runs_of_very_long_periodic_texts():
    n = 400_000
    assert runs.find_runs(np.zeros(n, np.int32)) == [(0, n, 1)]
    assert runs.find_runs(np.tile(np.arange(n // 4), 4)) == [(0, n, n // 4)]
    many = runs.find_runs(np.repeat(np.arange(n // 25) % 7, 25))
    assert len(many) == n // 25 + 1 and many[1] == (0, n, 175)


def test_runs_odd_rows(spark, clash):
    got = runs.periodic_runs(clash).collect()
    assert len(got) == len(ODD) + 2 and sum(r.id is None for r in got) == 1
    for text in ODD:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert any(r.n_words == len(words) and [tuple(x) for x in r.runs] == plain_runs(words) for r in got)
    assert {r.collapsed for r in got if r.runs} == {"la"}
    assert runs.periodic_runs(clash.limit(0)).collect() == []


def test_runs_query_by_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    checked = 0
    for r in runs.query(spark, sf).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        if n > 2000:
            continue
        checked += 1
        found = plain_runs(w)
        gone = {i for s, length, p in found for i in range(s + p, s + length)}
        assert r.n_runs == len(found)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert checked > 100


# -- BPE by tree concatenation


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_tree_bpe_is_the_library(library, monkeypatch):
    coder, rnd = treebpe.coder(PATH, pt.PATTERN), random.Random(3)
    texts = [t or "" for t in ODD]
    for _ in range(800):
        texts.append("".join(rnd.choice((chr(rnd.randint(1, 0x24F)), chr(rnd.choice((32, 10, 9, 0x1C, 0x85, 0xA0, 0x2028, 0x3000))), chr(rnd.randint(97, 100)), "'s", "<|endoftext|>", chr(rnd.randint(0x4E00, 0x9FFF)), chr(0x1F600))) for _ in range(rnd.randint(0, 60))))
    for _ in range(60):
        texts.append("".join(chr(97 + rnd.randrange(rnd.choice((1, 2, 5, 26)))) for _ in range(rnd.randint(500, 4000))))
        texts.append("".join(rnd.choice("abcdeist") for _ in range(rnd.randint(1, 9))) * rnd.randint(100, 500))
        texts.append(rnd.choice((" ", "\n", "=", "-", "é", "日", "a", "0", " \n")) * rnd.randint(100, 5000))
    for leaf, few in ((512, 24), (7, 3), (64, 24)):
        monkeypatch.setattr(treebpe, "LEAF", leaf)
        monkeypatch.setattr(treebpe, "FEW", few)
        coder.memo.clear()
        for t in texts:
            ids = coder.encode(t)
            assert ids == library.encode(t, add_special_tokens=False).ids
            assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_tree_bpe_joins_whatever_stands_at_the_border(library):
    coder, rnd = treebpe.coder(PATH, pt.PATTERN), random.Random(4)
    for _ in range(400):
        text = "".join(rnd.choice(("a", "b", "ab", "the", "ing", "é", "日")) for _ in range(rnd.randint(2, 80))).encode()
        at = rnd.randint(0, len(text))
        assert coder.join(coder.merge(text[:at]), coder.merge(text[at:])) == coder.merge(text)


@pytest.mark.parametrize("long_text,most", [(1 << 18, 1 << 15), (200, 30), (1, 5)])
def test_tree_bpe_of_documents(spark, sf, library, clash, long_text, most):
    docs = clash.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    got = treebpe.encode_documents(docs, PATH, pt.PATTERN, long_text=long_text, most=most).collect()
    rows = docs.collect()
    assert sorted((str(r.id), r.decoded) for r in got) == sorted((str(r.doc_id), r.text or "") for r in rows)
    assert all(r.ids == library.encode(r.decoded, add_special_tokens=False).ids for r in got)
    assert treebpe.encode_documents(clash.limit(0), PATH, pt.PATTERN).collect() == []


def test_tree_bpe_refuses_other_kinds():
    with pytest.raises(ValueError):
        treebpe.TreeBpe({"model": {"type": "WordPiece"}}, "x")
