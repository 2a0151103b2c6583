"""BPE by tree concatenation: encoding and decoding with a vocabulary of merges.

Text is split at its special tokens and by the vocabulary's expression. Short pieces are merged directly. Unsplit text that is
longer than a leaf is halved until the parts are leaves; their ids are then joined pairwise, level by level. A join re-encodes
a window of tokens around the border, whose sides double until its first token is the one that was there on the left and its
last the one on the right, or the window reaches an end. A sequence of tokens is the BPE of its text exactly if each
two neighbours are the BPE of theirs; so where both sides agree, nothing outside the window changes.

Long texts are spread over tasks: distinct ones are cut into segments, at borders of pieces or, where a piece is longer than a
segment, at its halves; segments are dealt out and encoded in parallel, and the ids of a text are joined again. Only these ids
meet by text, and rows with the same text share them.

Null texts count as empty; an empty text has no ids. Repeated rows give repeated rows, null ids stay. Only the id and the text
column are read, so other columns and their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from htmlframe.llm.common import prepare, table

#: Symbols merged by looking through all pairs; with more, pairs wait in a heap.
FEW = 24
#: Bytes of a leaf, characters of a segment, and those from which a text is cut into segments.
LEAF, SEGMENT, LONG_TEXT = 512, 1 << 15, 1 << 18
#: Entries of each half of the memo of pieces, and bytes of the longest piece in it.
MOST_PIECES, LONGEST_KEPT = 350_000, 64
#: Pieces looked up at a time.
BLOCK = 65_536


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class TreeBpe:
    """Encoder and decoder of one byte-level vocabulary, given as the JSON of a tokenizer file and its splitting expression."""

    def __init__(self, spec: dict, pattern: str, most_pieces: int = MOST_PIECES):
        import regex

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or odd:
            raise ValueError("not a plain byte-level BPE")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens that take their neighbourhood in aren't supported")
        signs, ids = byte_signs(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = 1 + max([*ids.values(), *(t["id"] for t in added)], default=0)
        self.first = [ids.get(s, -1) for s, _ in sorted(signs.items(), key=lambda x: x[1])]
        #: pair -> rank and merged id in one number; a smaller one is merged first.
        self.pairs = {ids[a] * self.size + ids[b]: rank * self.size + ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.bytes_of = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(map(signs.__getitem__, token))
        self.special = {t["content"]: t["id"] for t in added}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.split = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.most_pieces, self.memo, self.older = most_pieces, {}, {}

    def _few(self, ids: list[int]) -> list[int]:
        """Merge a few symbols: the leftmost pair of the lowest rank, again and again."""
        get, size, none = self.pairs.get, self.size, 1 << 62
        ranks = [get(a * size + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best % size]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] * size + ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + ids[i], none)
        return ids

    def _many(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place) and linked symbols."""
        get, size, n = self.pairs.get, self.size, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] * size + ids[j]) != m:
                continue
            ids[i], ids[j] = m % size, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, (m, i))
            k = before[i]
            if k >= 0 and (m := get(ids[k] * size + ids[i])) is not None:
                heapq.heappush(heap, (m, k))
        return [i for i in ids if i >= 0]

    def merge(self, raw: bytes) -> list[int]:
        """The ids of bytes that are merged as a whole."""
        ids = [self.first[b] for b in raw]
        return self._few(ids) if len(ids) <= FEW else self._many(ids)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two texts that stand next to each other in one piece."""
        k = m = 1
        while left and right:
            a, b = left[-k:], right[:m]
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, a + b)))
            left_agrees, right_agrees = k >= len(left) or window[0] == a[0], m >= len(right) or window[-1] == b[-1]
            if left_agrees and right_agrees:
                return left[:-k] + window + right[m:]
            k, m = k if left_agrees else 2 * k, m if right_agrees else 2 * m
        return left or right

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Join neighbours level by level."""
        while len(parts) > 1:
            pairs = [self.join(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)]
            parts = pairs + parts[len(parts) & ~1 :]
        return parts[0] if parts else []

    def unsplit(self, raw: bytes) -> list[int]:
        """The ids of one piece of any length."""
        if len(raw) <= LEAF:
            return self.merge(raw)
        return self.join_all([self.merge(x) for x in halves(raw, LEAF)])

    def _piece(self, piece: str) -> list[int]:
        got = self.older.get(piece)
        if got is None:
            raw = piece.encode()
            got = self.unsplit(raw)
            if len(raw) > LONGEST_KEPT:
                return got
        if len(self.memo) >= self.most_pieces:
            self.older, self.memo = self.memo, {}
        self.memo[piece] = got
        return got

    def sections(self, text: str) -> Iterator[str]:
        """The parts of a text between special tokens, and these tokens."""
        if self.cut is None or not any(t in text for t in self.special):
            return iter((text,) if text else ())
        return (x for x in self.cut.split(text) if x)

    def encode(self, text: str) -> list[int]:
        out: list[list[int]] = []
        for section in self.sections(text):
            if section in self.special:
                out.append([self.special[section]])
                continue
            pieces = (m.group() for m in self.split.finditer(section)) if len(section) >= LONG_TEXT else iter(self.split.findall(section))
            while block := list(islice(pieces, BLOCK)):
                out += [self._piece(p) if x is None else x for p, x in zip(block, map(self.memo.get, block), strict=True)]
        return list(chain.from_iterable(out))

    def segments(self, text: str, most: int = SEGMENT) -> Iterator[tuple[bool, str]]:
        """(inside, segment) in order: a segment of whole pieces, or, inside, the first or a later part of one long piece, after
        which comes its next part, or an empty segment at its end."""
        for section in self.sections(text):
            if section in self.special:
                yield False, section
                continue
            begin = 0
            for m in self.split.finditer(section):
                start, end = m.span()
                if end - start > most:
                    if begin < start:
                        yield False, section[begin:start]
                    yield from ((True, x) for x in halves(section[start:end], most))
                    yield True, ""
                    begin = end
                elif end - begin >= most:
                    yield False, section[begin:end]
                    begin = end
            if begin < len(section):
                yield False, section[begin:]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def halves(x, most: int) -> list:
    """A string or bytes halved until no part is longer than most, in order. The left half is a whole tree of parts of that
    length, so tokens of repetitive text are likely to end at the borders."""
    return [x[i : i + most] for i in range(0, len(x), most)]


_made: dict[tuple[str, str], TreeBpe] = {}


def coder(path: str, pattern: str) -> TreeBpe:
    """One coder for a Python worker and vocabulary."""
    if (path, pattern) not in _made:
        with open(path, encoding="utf-8") as f:
            _made[path, pattern] = TreeBpe(json.load(f), pattern)
    return _made[path, pattern]


IDS = pa.list_(pa.int32())
CODED = pa.schema([("id", pa.int64()), ("ids", IDS), ("decoded", pa.string())])
CODED_SQL = "id long, ids array<int>, decoded string"


def long_ids(texts: DataFrame, path: str, pattern: str, most: int = SEGMENT) -> DataFrame:
    """(key, ids) of long texts (key, text): cut, encoded segment by segment in parallel, and joined."""
    segment = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("inside", pa.bool_()), ("segment", pa.string())])
    part = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("inside", pa.bool_()), ("ids", IDS)])

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = enumerate(coder(path, pattern).segments(text.as_py(), most))
                while block := list(islice(rows, 64)):
                    yield pa.record_batch([pa.array([key] * len(block)), pa.array([i for i, _ in block]), pa.array([x for _, (x, _) in block]), pa.array([x for _, (_, x) in block])], segment)

    def encode(batches):
        made = coder(path, pattern)
        for batch in batches:
            ids = [made.unsplit(s.as_py().encode()) if inside else made.encode(s.as_py()) for inside, s in zip(batch.column(2).to_pylist(), batch.column(3), strict=True)]
            yield pa.record_batch([*batch.columns[:3], pa.array(ids, IDS)], part)

    def join(batches):
        made = coder(path, pattern)
        for batch in batches:
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, piece = [], []
                for p in parts.as_py():
                    if not p["inside"]:
                        out.append(p["ids"])
                    elif p["ids"]:
                        piece.append(p["ids"])
                    else:
                        out.append(made.join_all(piece))
                        piece = []
                yield pa.record_batch([pa.array([key]), pa.array([list(chain.from_iterable(out))], IDS)], ["key", "ids"])

    dealt = texts.select("key", "text").mapInArrow(cut, "key string, seq long, inside boolean, segment string").repartition("key", "seq")
    parts = dealt.mapInArrow(encode, "key string, seq long, inside boolean, ids array<int>")
    return parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "inside", "ids"))).alias("parts")).mapInArrow(join, "key string, ids array<int>")


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", long_text: int = LONG_TEXT, most: int = SEGMENT) -> DataFrame:
    """One row (id, ids array<int>, decoded string) for each row: the ids of its whole text, and these ids decoded.

    path: a tokenizer file that every executor can read; pattern: the expression whose matches are encoded separately.
    Texts of long_text characters and more are cut into segments of about `most`.
    """
    prepare(docs.sparkSession)

    def run(batches):
        made = coder(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 64):
                ids = [made.encode(t.as_py() or "") for t in texts[at : at + 64]]
                yield pa.record_batch([pa.array(keys[at : at + 64], pa.int64()), pa.array(ids, IDS), pa.array([made.decode(x) for x in ids], pa.string())], CODED)

    def decoded(batches):
        made = coder(path, pattern)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.record_batch([pa.array([key], pa.int64()), pa.array([ids.as_py()], IDS), pa.array([made.decode(ids.as_py())])], CODED)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    is_long = F.coalesce(F.char_length("text") >= long_text, F.lit(False))
    short = rows.where(~is_long).mapInArrow(run, CODED_SQL)
    keyed = rows.where(is_long).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text")
    found = keyed.select("id", "key").join(long_ids(keyed.dropDuplicates(["key"]), path, pattern, most), "key")
    return short.union(found.select("id", "ids").mapInArrow(decoded, CODED_SQL))


def query(spark, sf_dir):
    """Ids of all documents: their number, the digest of the ids and of the decoded text."""
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
