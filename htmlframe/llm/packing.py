"""Best-fit packing of documents into sequences by bin completion.

A document's token ids end in an end id; only documents over the capacity are cut, into pieces of the capacity and a
rest. Pieces are dealt by a hash of their ids and number, and of a number that tells repeated ones apart, into
groups of about GROUP pieces (the number of groups follows the number of documents), so the packing doesn't depend on how
files are split; each group is packed by itself, which costs at most one sequence a group. In a group, best-fit
decreasing gives the first solution. If that uses more sequences than the lower bound, branch and bound looks for a better
one: it takes the largest piece left, enumerates the undominated ways to fill up its sequence (none in which a piece can
be exchanged for a larger one left, or to which one can be added), least waste first, and turns back where the waste so
far leaves no room for a solution with fewer sequences. The search has a budget of nodes; every solution it returns holds
all pieces, so the budget limits only how long it tries to save another sequence.

Null texts count as empty; an empty document is its end id alone. Repeated rows are packed as often as they occur. A
null id stays null; an empty table has no pieces; pieces of equal length are taken in the order of their ids. Only the id
and text columns are read, so others and their names don't matter.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from htmlframe.llm.common import prepare, table

CAPACITY, END_ID = 4096, 1
GROUP = 4096
NODES = 4000
#: Fillings looked at for one sequence.
FILLINGS = 24
#: Words in each half of the memo of a worker.
MOST_WORDS = 500_000


#: The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordTokenizer:
    """Ids of whole texts by a tokenizers file, with a memo of words.

    A file that only composes, lower-cases and then drops the white space between what its expression finds treats words
    between white space each for itself, so the library encodes a word once and a memo keeps its ids. PLAIN texts go this
    way: lower-casing and white space are the same there for Python and the library. Other texts, texts in which a
    special token's string occurs, and files with other steps go to the library whole.
    """

    #: White space and letters up to U+024F, without separators on which libraries differ.
    PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")

    def __init__(self, path: str, most_words: int = MOST_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        self.special = [x["content"] for x in steps.get("added_tokens", [])]
        before = steps.get("normalizer") or {}
        kinds = [x["type"] for x in before.get("normalizers", [])]
        parts = (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])
        # a character outside PLAIN that is one token by itself: it stands between words that are encoded together
        self.mark, self.mark_id = next(((c, e.ids[0]) for c in "\u2122\u2764\u2026\u2019\u4e2d" if len((e := self.library.encode(c, add_special_tokens=False)).ids) == 1), ("", -1))
        self.by_word = bool(
            kinds == ["NFC", "Replace", "Lowercase"]
            and before["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
            and len(parts) == 2
            and (parts[0]["type"], parts[0].get("behavior"), parts[0].get("invert")) == ("Split", "Removed", True)
            and (parts[1]["type"], parts[1]["add_prefix_space"], parts[1].get("use_regex")) == ("ByteLevel", False, False)
            and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"]["Regex"]
        )
        self.ends = {c: np.array(self.library.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ".,;:!?"}
        self.most, self.memo, self.older = most_words, {}, {}

    def _word(self, word: str) -> bytes:
        """Ids of a word of letters: the library's model takes it whole, in its alphabet of bytes."""
        got = self.memo.get(word) or self.older.get(word)
        if got is None:
            ids = [x.id for x in self.library.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(ALPHABET))]
            got = struct.pack(f"<{len(ids)}I", *ids)
        self.memo[word] = got
        return got

    def _learn(self, words: set[str]) -> None:
        new = []
        for w in words:
            if w.isalpha():
                self._word(w)
            elif (got := self.older.get(w)) is not None:
                self.memo[w] = got
            elif w[-1] in self.ends and w[:-1].isalpha():
                self.memo[w] = self._word(w[:-1]) + self.ends[w[-1]]
            else:
                new.append(w)
        if new:
            ids = np.array(self.library.encode_batch_fast([f" {self.mark} ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            at = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            raw = ids.tobytes()
            for w, a, b in zip(new, at[:-1], at[1:], strict=True):
                self.memo[w] = raw[4 * a + 4 : 4 * b]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word or self.PLAIN.search(text) or not unicodedata.is_normalized("NFC", text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        found = list(map(self.memo.get, words))
        if None in found:
            if len(self.memo) >= self.most:
                self.older, self.memo = self.memo, {}
                self._learn(set(words))
            else:
                self._learn({w for w, x in zip(words, found, strict=True) if x is None})
            found = map(self.memo.__getitem__, words)
        return b"".join(found)


_made: dict[str, WordTokenizer] = {}


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, piece, start, length, ids_crc32) for each piece of each document."""
    prepare(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        if path not in _made:
            _made[path] = WordTokenizer(path)
        coder = _made[path]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py() or "") + end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, number, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.record_batch([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences needed at least: by the sum, and by the pieces too long to share one with others above a threshold."""
    x = np.sort(np.asarray(lengths, np.int64))
    if not len(x):
        return 0
    best = -(-int(x.sum()) // capacity)
    sums = np.concatenate([[0], np.cumsum(x)])
    for least in np.unique(x[x <= capacity // 2]):
        large, middle, low = (int(np.searchsorted(x, v, side)) for v, side in ((capacity - least, "right"), (capacity // 2, "right"), (least, "left")))
        alone, half = len(x) - large, large - middle
        rest = int(sums[middle] - sums[low]) - (half * capacity - int(sums[large] - sums[middle]))
        best = max(best, alone + half + max(0, -(-rest // capacity)))
    return max(best, int((x > capacity // 2).sum()))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the pieces of each sequence. Lengths are sorted, longest first."""
    room: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i, n in enumerate(lengths):
        at = bisect.bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([i])
            left, number = capacity - n, len(bins) - 1
        else:
            left, number = room.pop(at)
            bins[number].append(i)
            left -= n
        if left:
            bisect.insort(room, (left, number))
    return bins


def _fillings(sizes: list[int], counts: dict[int, int], room: int):
    """Ways to fill room with what is left so that nothing left fits in, as (waste, [(length, copies)]), the longest lengths
    and most copies first; an exact one ends the search."""
    taken: list[tuple[int, int]] = []
    # of each length chosen: the room below it, the place of the next length to try there, and its copies (None: as many as fit)
    frames: list[tuple[int, int, int | None]] = [(room, bisect.bisect_right(sizes, room) - 1, None)]
    if frames[0][1] < 0:
        yield room, []
    for _ in range(40 * FILLINGS):
        while frames and frames[-1][1] < 0:
            frames.pop()
            if taken:
                taken.pop()
        if not frames:
            return
        left, at, copies = frames.pop()
        n = sizes[at]
        k = min(counts[n], left // n) if copies is None else copies
        frames.append((left, at, k - 1) if k > 1 and at else (left, at - 1, None))
        taken.append((n, k))
        rest = left - k * n
        below = bisect.bisect_right(sizes, rest, 0, at) - 1
        if below >= 0:
            frames.append((rest, below, None))
            continue
        used = dict(taken)
        if all(counts[m] == used.get(m, 0) for m in sizes[: bisect.bisect_right(sizes, rest)]):
            yield rest, list(taken)
            if not rest:
                return
        taken.pop()


def _undominated(sizes: list[int], counts: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    out = []
    for waste, filling in sorted(_fillings(sizes, counts, room), key=lambda x: (x[0], sum(k for _, k in x[1]))):
        worse, used = False, dict(filling)
        for n in used:
            at = bisect.bisect_right(sizes, n + waste) - 1
            while at >= 0 and sizes[at] > n and not worse:
                worse = counts[sizes[at]] > used.get(sizes[at], 0)
                at -= 1
        if not worse:
            out.append((waste, filling))
            if not waste:
                break
    return out[:FILLINGS]


def complete_bins(lengths: list[int], capacity: int, most_bins: int, nodes: int = NODES) -> list[list[int]] | None:
    """Branch and bound for a solution of at most most_bins sequences, as lists of lengths; None if it found none."""
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    sizes = sorted(counts)
    spare = most_bins * capacity - sum(lengths)
    done: list[list[tuple[int, int]]] = []
    stack: list[tuple[int, list[tuple[int, list[tuple[int, int]]]], int]] = []
    left = len(lengths)

    def use(filling: list[tuple[int, int]], by: int) -> None:
        for n, k in filling:
            before = counts[n]
            counts[n] -= k * by
            if not counts[n]:
                sizes.pop(bisect.bisect_left(sizes, n))
            elif not before:
                bisect.insort(sizes, n)

    def open_bin() -> None:
        top = sizes[-1]
        use([(top, 1)], 1)
        stack.append((top, [x for x in _undominated(sizes, counts, capacity - top) if x[0] <= spare][::-1], -1))

    if spare < 0 or not left:
        return None if spare < 0 else []
    open_bin()
    while stack and nodes > 0:
        nodes -= 1
        top, choices, taken = stack.pop()
        if taken >= 0:
            filling = done.pop()
            use(filling[1:], -1)
            spare += taken
            left += sum(k for _, k in filling)
        if not choices or choices[-1][0] > spare:
            use([(top, 1)], -1)
            continue
        waste, filling = choices.pop()
        use(filling, 1)
        spare -= waste
        left -= sum(k for _, k in filling) + 1
        done.append([(top, 1), *filling])
        stack.append((top, choices, waste))
        if not left:
            return [[n for n, k in b for _ in range(k)] for b in done]
        open_bin()
    return None


def pack(lengths: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Sequences as lists of indices into lengths; every index once. No length may be over the capacity."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins = best_fit([lengths[i] for i in order], capacity)
    least = lower_bound(lengths, capacity)
    while len(bins) > least:
        better = complete_bins(lengths, capacity, len(bins) - 1, nodes)
        if better is None:
            break
        pool: dict[int, list[int]] = {}
        for at in range(len(order) - 1, -1, -1):
            pool.setdefault(lengths[order[at]], []).append(at)
        bins = [[pool[n].pop() for n in b] for b in better]
    return [[order[i] for i in b] for b in bins]


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cut_documents() with each piece's sequence_id and offset in its sequence."""
    groups = max(1, -(-docs.count() // group))
    pieces = cut_documents(docs, path, capacity, end_id, id_col, text_col)
    same = pieces.groupBy("id", "piece", "start", "length", "ids_crc32").agg(F.count("*").alias("n"))
    numbered = same.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
    dealt = numbered.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "number"), F.lit(groups))).drop("number")
    out = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_pylist()
        first = rows.column("bucket")[0].as_py() << 32
        ids, offsets = [0] * len(lengths), [0] * len(lengths)
        for number, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                ids[i], offsets[i] = first + number, at
                at += lengths[i]
        rows = rows.drop_columns(["bucket"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        return rows.cast(pa.schema(out))

    return dealt.groupBy("bucket").applyInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir):
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
