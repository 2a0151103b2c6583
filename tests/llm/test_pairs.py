import collections
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from htmlframe.llm import ann, common, linededup, simhash

# -- components


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    up = {n: n for e in edges for n in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for e in edges if e[0] != e[1] for n in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- SimHash


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, most=4):
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    least = {}
    for key, f in rows:
        if key is not None:
            least[top(f)] = min(key, least.get(top(f), key))
    return [(key, f, least.get(top(f))) for key, f in rows]


def test_golay_keys():
    table = simhash.golay_errors()
    n = (table >= 0).sum(axis=1)
    assert set(n.tolist()) == {1, 6} and (n == 1).sum() == 1 + 23 + 253
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 500)
    for flips in (1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= 1 << rng.integers(0, 23, 500)
        for a, b in zip(simhash.segment_keys(words), simhash.segment_keys(other), strict=True):
            assert set(a[a >= 0]) & set(b[b >= 0])
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = fps.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    assert all(np.intersect1d(a, b).size for a, b in zip(simhash.join_keys(fps), simhash.join_keys(near), strict=True))


def test_fingerprint_is_the_definition(spark, sf, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [None, "", "A b", "A\u00a0É x\x0by z w", "a b c d"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_simhash(t) for t in texts]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [simhash.fingerprint(t) for t in texts[:10]] == [plain_simhash(t) for t in texts[:10]]


def test_simhash_query(spark, sf):
    docs = [(r.doc_id, plain_simhash(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect())
    assert got == sorted((k, f"{f:016x}", c) for k, f, c in plain_components(docs))


def test_dense_groups_of_links(spark):
    rng = random.Random(8)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(400):
        f = centre
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.fp: r.component for r in simhash.link_components(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = plain_components([(f, f % (1 << 64)) for f in signed])
    group = collections.defaultdict(set)
    for f, _, c in want:
        group[c].add(f)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, [{f for f in got if got[f] == c} for c in set(got.values())]))


def test_simhash_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "one two three four five six", "c"), (4, "one two three four five six", "d"), (4, "one two three four five six", "e"), (None, "one two three four five six", "f"), (None, "lonely words stand here alone", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.id or -1, r.component or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 3), (1, 1), (2, 1), (3, 3), (4, 3), (4, 3)]
    left = simhash.drop_near_duplicates(df)
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 3] and left.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# -- line dedup


def plain_removed(docs, t=0.8, least=1):
    seen, gone = [], set()
    for key, text in sorted(docs):
        for i, line in enumerate(text.split("\n")):
            s = {w for w in line.split(" ") if w}
            if len(s) < least:
                continue
            if any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
                gone.add((key, i))
            seen.append(s)
    return gone


def check_lines(df, least=1):
    docs = [(r.doc_id, r.text) for r in df.collect()]
    gone = plain_removed([d for d in docs if d[1] is not None], least=least)
    want = sorted((k, "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone)) for k, t in docs if t is not None)
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df, min_words=least).collect() if r.text is not None) == want
    return len(gone)


@pytest.mark.parametrize("least", [1, 5])
def test_lines_of_documents(spark, sf, least):
    assert check_lines(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), least) > 20


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_dense_groups_of_lines(spark, broadcast, monkeypatch):
    monkeypatch.setattr(linededup, "MOST_BROADCAST", broadcast)
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(24)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = f"n{rnd.randint(0, 30)}"
        rows.append((i, " ".join(words) + "\n" + " ".join(rnd.choices(base, k=7))))
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string")) > 60


def test_dense_words_with_unlike_lines(spark, monkeypatch):
    """Lines that share a rare word with many, but match few of them, are found all the same; so is one of 20,000 words."""
    monkeypatch.setattr(linededup, "DENSE", 4)
    rnd = random.Random(9)
    rows = [(i, " ".join([*rnd.sample([f"{i % 13}{c}" for c in "abcdefghijkl"], k=10), "rare", f"rare{i % 13}"])) for i in range(150)]
    long = [f"w{i}" for i in range(20_000)]
    rows += [(150, " ".join(long)), (151, " ".join(long[:17_000])), (152, " ".join(long[:13_500]))]
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string")) > 20


def test_lines_odd_rows(spark):
    line = "one two three four five six"
    rows = [(1, line + "\nshort line", "x"), (2, "short line\n" + line, "y"), (2, "other words stand in this line\n" + line, "z"), (3, None, "n"), (4, "", "e"), (2, "short line\n" + line, "y"), (5, line + "  seven\n\n", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig string")
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "sig", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text or "", r.n_removed) for r in got.collect()) == [(1, line + "\nshort line", 0), (2, "", 2), (2, "", 2), (2, "other words stand in this line", 1), (3, "", 0), (4, "", 0), (5, "\n", 1)]
    null = spark.createDataFrame([(None, line), (1, line)], "doc_id long, text string")
    assert sorted(r.n_removed for r in linededup.dedup_lines(null).collect()) == [0, 1]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_lines_keep_columns_of_any_name(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(1, line, 1, 2, 3, 4, 5), (2, line, 1, 2, 3, 4, 5)], "doc_id long, text string, doc_ int, th_ int, gone_ int, n_removed int, doc int")
    got = linededup.dedup_lines(df)
    assert sorted(got.columns) == sorted([*df.columns, "n_lines"])
    assert sorted((r.doc_id, r.text, r.n_removed, r.doc_, r.th_, r.gone_, r.doc) for r in got.collect()) == [(1, line, 0, 1, 2, 3, 5), (2, "", 1, 1, 2, 3, 5)]


def test_lines_white_space(spark):
    words = ["one", "two", "three", "four", "five", "six"]
    rows = [(1, " ".join(words)), (2, "\t".join(words) + "\r"), (3, "  ".join(words) + "\r\nleft alone in this line here\r"), (4, "a\tb\tc\td\te\na\tb\tc\td\te"), (5, "one\x0btwo\fthree four five six")]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = plain_removed([(k, t.translate(dict.fromkeys(map(ord, "\t\r\x0b\f"), " "))) for k, t in rows])
    assert gone == {(2, 0), (3, 0), (4, 1), (5, 0)}
    assert got == {1: (rows[0][1], 0), 2: ("", 1), 3: ("left alone in this line here\r", 1), 4: ("a\tb\tc\td\te", 1), 5: ("", 1)}


def test_short_lines_of_the_query(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, "\n".join(" ".join(rnd.choices("abcdefg", k=rnd.randint(0, 7))) for _ in range(6))) for i in range(60)] + [(60, "The " * 99), (61, "The " * 98), (62, "字字字\n字字字\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = plain_removed(rows, least=1)
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in rows}
    assert {r.doc_id: r.text for r in linededup.query(spark, str(tmp_path)).collect()} == want
    assert want[61] == "" and want[62] == "字字字\n\n"


# -- nearest neighbours


def plain_nearest(rows, k=10, every=1):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        out[int(q)] = sorted((float(a), int(i)) for a, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def test_neighbours_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_nearest(rows, every=100)
    got = collections.defaultdict(list)
    for r in ann.query(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id, r.rank))
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, len(found) + 1)) and found == sorted(found)
    assert np.mean([len({i for _, i in want[q]} & {i for _, i, _ in got[q]}) / len(want[q]) for q in want]) >= 0.95


@pytest.mark.parametrize("step", [512, 3])
def test_shards_and_copies(spark, step, monkeypatch):
    monkeypatch.setattr(ann, "STEP", step)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    x[300:420] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = collections.defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=50, shard=200).orderBy("rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = plain_nearest(rows, every=50)
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in got[q]}) / 10 for q in want]) >= 0.95
    assert [i for _, i in got[300]] == [5, *range(301, 310)]


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (1, [1.0, 0.0], 2), (1, [1.0, 0.0], 3), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (200, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.neighbours(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 1.414214), (100, 1, 0, 1.414214), (100, 2, 1, 1.414214)]
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.usable(df, "vec_id", "embedding").where(F.size("v") == 2).count() == 3


def test_an_index_comes_once_for_all_blocks(spark, monkeypatch):
    """However many blocks of queries there are, each shard's index is one row of what the search reads."""
    rnd = random.Random(11)
    df = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(600)], "vec_id long, embedding array<float>")
    want = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.neighbours(df, every=2, shard=150).collect())
    monkeypatch.setattr(ann, "BLOCK", 20)
    monkeypatch.setattr(ann, "STEP", 7)
    got = ann.neighbours(df, every=2, shard=150)
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got.collect()) == want and len(want) == 3000
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_line_pairs_share_enough_prefix_words(spark, monkeypatch):
    """Long lines that have one rare word in common aren't verified on their texts; those at the threshold are, in whatever
    place their words differ."""
    asked, matches = [], linededup.matches
    monkeypatch.setattr(linededup, "matches", lambda pairs, *rest: asked.append(pairs.count()) or matches(pairs, *rest))
    rnd, rows = random.Random(4), []
    for i in range(12):  # unlike lines that have their rarest word but one in common, too long for a bitmap of 64 bits
        words = [f"u{i}_{k}" for k in range(298)]
        short = [f"{words[k]} {words[(k + 1) % 298]} {words[(k + 5) % 298]}" for k in range(298)]
        rows.append((i, "\n".join([" ".join([*words, f"shared{i // 2}", f"own{i}"]), *short])))
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string")) == 0
    assert sum(asked) == 0
    for i in range(30):  # 8 of 9 words at each size: likeness of 0.8 exactly, or just below
        words = [f"w{i}_{k}" for k in range(9 * (i % 10 + 1))]
        n = i % 10 + 1 + (i >= 20)
        other = list(words)
        for k in rnd.sample(range(len(words)), n):
            other[k] = f"x{i}_{k}"
        cut = words[: len(words) - len(words) // 5]  # a part only
        rows += [(100 + 3 * i, " ".join(words)), (101 + 3 * i, " ".join(other)), (102 + 3 * i, " ".join(cut))]
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string")) >= 20


def test_line_dedup_leaves_no_tables(spark):
    """Tables of lines and sets are gone before the texts are moved."""
    kept, left = linededup.kept, []
    rows = [(i, f"one two three four five six {i % 3}\nshort {i}") for i in range(12)]
    try:
        linededup.kept = lambda df, name: left.append(kept(df, name)) or left[-1]
        got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        linededup.kept = kept
    assert len(left) > 2 and not any(os.path.exists(df._kept_at.removeprefix("file:")) for df in left)
    assert sum(r.n_removed for r in got.collect()) == 9


def test_dense_groups_read_the_texts_once(spark, monkeypatch):
    """However many rounds find pairs, what lines of dense groups say is read once, and once more for the pairs of the join."""
    names, asked, kept, matches = [], [], linededup.kept, linededup.matches
    monkeypatch.setattr(linededup, "kept", lambda df, name: names.append(name) or kept(df, name))
    monkeypatch.setattr(linededup, "matches", lambda pairs, *rest: asked.append(pairs.count()) or matches(pairs, *rest))
    rnd, rows = random.Random(6), []
    for i in range(120):
        words = [f"w{k}" for k in range(24)]
        for k in rnd.sample(range(24), rnd.randint(0, 5)):
            words[k] = f"n{rnd.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string")) > 60
    assert sum(n > 0 for n in asked[:-1]) > 1 and names.count("held") <= 2
