"""Periodic runs of words.

A run is a stretch of consecutive words whose words `period` apart are identical, with the smallest such period, at least
`times` periods and `least` words long, that no neighbouring word extends. Runs are found by harmonic grid probing: for each
period p, words are compared with those p further on at the multiples of p only, since every run covers two neighbouring
points of that grid with all between them. What agrees at both, and at seven places between them, is extended to both sides
by comparing chunks of arrays. Grid points inside runs found before, whose period divides p, are passed over, so a text of n
words takes about n log n comparisons however periodic it is. Words are compared by their numbers in the text, exactly.

Null and blank texts have no words and no runs; their collapsed text is empty. Texts of any length are taken whole, a block
of periods at a time. Repeated rows give repeated rows, null ids stay. Only the id and the text column are read, so other
columns and their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from htmlframe.llm.common import prepare, table

#: A word is what stands between these signs.
WORD = "[^\\x20\\x09-\\x0D]+"
LEAST, TIMES = 24, 3
#: Comparisons made at a time, and how many may be made for periods that are multiples of each other.
BLOCK, SMALL_BLOCK = 1 << 20, 1 << 16
#: Words in the largest chunk compared at a time.
CHUNK = 1 << 16

_words = re.compile(WORD).findall
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[str]) -> np.ndarray:
    """Words as numbers: equal words have equal numbers."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first elements of two arrays of one length agree."""
    at, size = 0, 32
    while at < len(a):
        differ = a[at : at + size] != b[at : at + size]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, size = at + len(differ), min(2 * size, CHUNK)
    return at


def _blocks(steps: np.ndarray, periods: np.ndarray, n: int):
    """(first, last) of blocks of periods, and the numbers of grid points of all periods."""
    points = np.maximum((n - 1 - periods) // steps, 0)
    upto = np.concatenate([[0], np.cumsum(points)])
    first = 0
    while first < len(periods):
        small = int(np.searchsorted(upto, upto[first] + SMALL_BLOCK, "right")) - 1
        large = int(np.searchsorted(upto, upto[first] + BLOCK, "right")) - 1
        last = max(small, min(large, 2 * first + 1), first + 1)  # the periods from first + 1 to 2 * first + 1
        yield first, last, points
        first = last


def _probe(w: np.ndarray, p: np.ndarray, step: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points (period, step, place) at which words agree with those a period further on, there, at the next point, and at
    places between them."""
    total = int(points.sum())
    p, step = np.repeat(p, points), np.repeat(step, points)
    at = (np.arange(total) - np.repeat(np.cumsum(points) - points, points)) * step
    for k in (0, 8, 4, 2, 6, 1, 3, 5, 7):
        here = at + step * k // 8
        same = w[here] == w[here + p]
        p, step, at = p[same], step[same], at[same]
        if not len(p):
            break
    return p, step, at


def _outside(p: np.ndarray, at: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which grid points aren't inside a stretch (start, end, period) together with the next one, the period dividing p."""
    order = np.argsort(at, kind="stable")
    sorted_at, sorted_p = at[order], p[order]
    outside = np.ones(len(p), bool)
    for start, end, q in runs:
        lo, hi = np.searchsorted(sorted_at, (start, end))
        if lo < hi:
            inside = (sorted_p[lo:hi] % q == 0) & (sorted_at[lo:hi] + sorted_p[lo:hi] < end)
            outside[order[lo:hi][inside]] = False
    return outside


def find_runs(w: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in an array, by start, then period. times is 3 or more."""
    if times < 3:
        raise ValueError("runs of fewer than three periods aren't found by this grid")
    n = len(w)
    periods = np.arange(1, n // times + 1)
    # a run of a small period agrees over `least` words, so the grid may be wider, by whole periods
    steps = periods * np.maximum(1, (least - periods) // (2 * periods))
    found: list[tuple[int, int, int]] = []  # (start, end, period)
    if n < least:
        return []
    for first, last, points in _blocks(steps, periods, n):
        p, step, at = _probe(w, periods[first:last], steps[first:last], points[first:last])
        wide = [r for r in found if r[1] - r[0] > first + 1]
        if len(p) and wide:
            keep = _outside(p, at, wide)
            p, step, at = p[keep], step[keep], at[keep]
        multiples = last > 2 * first + 1
        i = 0
        while i < len(p):
            q, s, a = int(p[i]), int(step[i]), int(at[i])
            right = a + _agreeing(w[a : n - q], w[a + q :])
            if right < a + s:
                i += 1
                continue
            left = a - _agreeing(w[:a][::-1], w[q : a + q][::-1])
            end = right + q
            i += 1
            if end - left >= max(least, times * q):
                found.append((left, end, q))
            if multiples:
                keep = (p[i:] % q != 0) | (at[i:] < left) | (at[i:] + p[i:] >= end)
                p, step, at, i = p[i:][keep], step[i:][keep], at[i:][keep], 0
            else:
                i += int(np.searchsorted(at[i : i + int(np.searchsorted(p[i:], q, "right"))], right))
    return sorted((s, e - s, q) for s, e, q in found)


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(id, n_words, runs array<struct<start,length,period>>, collapsed) of each row: the runs of its whole text by start, then
    period, and the words that no run contains after its first period, joined by blanks."""
    prepare(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(text.as_py() or "")
                runs = find_runs(numbered(words), least, times)
                kept = [w for w, gone in zip(words, repeated(len(words), runs).tolist(), strict=True) if not gone] if runs else words
                rows.append((key, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], " ".join(kept)))
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text with its words from a place on repeated periodically, in rows whose id's checksum is a multiple of ten: word
    i >= a becomes word a + (i - a) % p. Other texts stay as they are."""
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"({WORD})"))

    def turned(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        a = (g % n).cast("int")
        return F.struct(w.alias("w"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p"))

    def said(x: Column) -> Column:
        rest = F.transform(F.sequence(F.lit(0), F.size(x["w"]) - x["a"] - 1), lambda i: F.get(x["w"], x["a"] + i % x["p"]))
        return F.array_join(F.concat(F.slice(x["w"], F.lit(1), x["a"]), rest), " ")

    # arrays of one element name what is worked out once for a text; those without words aren't turned
    once = F.transform(F.transform(F.filter(F.array(words), lambda w: F.size(w) > 0), turned), said)
    return F.when(h % 10 == 0, F.coalesce(F.get(once, F.lit(0)), F.col(text_col))).otherwise(F.col(text_col))


def query(spark, sf_dir):
    """Runs of all documents, some of them made periodic: their number, the one of the greatest exponent, and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", looped().alias("text"))
    # by start, then period, so only a greater exponent takes the place of one before
    greater = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), greater)
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[f].cast("string") for f in ("start", "length", "period"))))
    found = periodic_runs(docs).withColumn("best", best)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
