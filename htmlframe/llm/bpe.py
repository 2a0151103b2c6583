"""Byte-level BPE encoding and decoding.

The ranks are compiled into a finite-state transducer that is determinised lazily. A nondeterministic configuration is
(tokens not yet emitted, last whole token, node of the vocabulary trie inside the next token). A token sequence is the
BPE of its bytes exactly if each two neighbours are the BPE of theirs, so a configuration may complete a token only if
that token is compatible with the one before. A state of the transducer is a set of configurations with what they
have in common already emitted; since exactly one configuration ends at each byte, tokens come out after a lookahead
bounded by the longest token. States and transitions are made when they are first needed and kept in tables of a bounded
size. Full tables are dropped, in the midst of a piece too, and go on from the state that was reached.

Decoding streams: a state machine over UTF-8 lead and continuation bytes holds back an incomplete character at the end
of each block of tokens, so that texts of any length decode in bounded memory.

Null texts count as empty; an empty text has no ids. Repeated rows give repeated rows. Only the id and text columns
are read, so other columns and their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from htmlframe.llm.common import prepare, table

#: Entries of the table of transitions before it is dropped and begun anew, and of each half of the memo of whole pieces.
MOST_TRANSITIONS = 700_000
MOST_PIECES = 350_000
#: Above every rank.
NEVER = 1 << 60
#: Pieces or tokens handled at a time.
BLOCK = 65_536
#: Texts above this many characters are split into pieces lazily.
LONG_TEXT = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines with a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[int]:
    """Plain BPE of one piece with ranks under a bound: merge the leftmost pair of the lowest rank, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, i = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """The lazily determinised transducer of a rank table."""

    def __init__(self, ranks: dict[bytes, int], most_transitions: int = MOST_TRANSITIONS):
        self.ranks = ranks
        self.most = most_transitions
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        self.inner = [True]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token_at[node] = rank
        self.fits: dict[int, bool] = {}
        self.edges: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self._reset()

    def _reset(self) -> None:
        start = (((), -1, 0),)
        self.states = [start]
        self.number = {start: 0}
        self.final: list[tuple[int, ...]] = [()]
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _edge(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The tokens that begin and that end with the first and the last byte while this token is being merged."""
        got = self.edges.get(token)
        if got is None:
            raw = self.bytes_of[token]
            if len(raw) == 1:
                got = ((token,), (token,))
            else:
                left, right = merge_by_rank(raw, self.ranks, token)
                got = ((*self._edge(left)[0], token), (*self._edge(right)[1], token))
            self.edges[token] = got
        return got

    def _compatible(self, last: int, token: int) -> bool:
        """Whether BPE leaves the border between two tokens alone: no merge across it comes before those beside it."""
        if last < 0:
            return True
        key = last << 32 | token
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) >= self.most:
                self.fits.clear()
            lefts, rights = self._edge(last)[1], self._edge(token)[0]
            i = j = 0
            ok = True
            while ok:
                across = self.ranks.get(self.bytes_of[lefts[i]] + self.bytes_of[rights[j]], NEVER)
                left = lefts[i + 1] if i + 1 < len(lefts) else NEVER
                right = rights[j + 1] if j + 1 < len(rights) else NEVER
                if across < left and across <= right and across != NEVER:
                    ok = False
                elif left == right == NEVER:
                    break
                elif left <= right:
                    i += 1
                else:
                    j += 1
            self.fits[key] = ok
        return ok

    def _state(self, configurations: tuple) -> int:
        """The number of a state."""
        to = self.number.get(configurations)
        if to is None:
            to = self.number[configurations] = len(self.states)
            self.states.append(configurations)
            self.final.append(configurations[-1][0])
        return to

    def _step(self, state: int, b: int) -> tuple[int, tuple[int, ...]]:
        """Make one transition. Configurations stay in the order in which their tokens began, so equal sets are equal
        tuples; the one that ends here comes last, and as there is only one, no other completion is tried after it."""
        child, inner, token_at, fits = self.child, self.inner, self.token_at, self.fits
        reached = []
        whole = None
        for config in self.states[state]:
            pending, last, node = config
            nxt = child.get(node << 8 | b)
            if nxt is None:
                continue
            if inner[nxt]:
                reached.append((pending, last, nxt))
            if whole is None:
                token = token_at[nxt]
                if token >= 0:
                    ok = fits.get(last << 32 | token) if last >= 0 else True
                    if ok or ok is None and self._compatible(last, token):
                        whole = ((*pending, token), token, 0)
        reached.append(whole)
        first = reached[0][0]
        if first:
            common = len(first)
            for config in reached:
                other = config[0]
                if other[:common] != first:
                    common = next(i for i, x in enumerate(first) if i >= len(other) or other[i] != x)
                    if not common:
                        break
                    first = first[:common]
            if common:
                reached = [(p[common:], last, node) for p, last, node in reached]
            else:
                first = ()
        to = self._state(tuple(reached))
        self.moves[state << 8 | b] = move = (to, first)
        return move

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece, read byte by byte; a token leaves as soon as no reading of the rest can change it."""
        out: list[int] = []
        state, moves = 0, self.moves
        for b in piece:
            move = moves.get(state << 8 | b)
            if move is None:
                if len(moves) >= self.most:  # begin anew, from the configurations of this very state
                    now = self.states[state]
                    self._reset()
                    state, moves = self._state(now), self.moves
                move = self._step(state, b)
            state, emitted = move
            if emitted:
                out += emitted
        out += self.final[state]
        return out


class Utf8Machine:
    """Incremental UTF-8 decoding: the state is the incomplete character at the end of what has come so far."""

    #: Bytes of a character by its lead byte.
    LENGTH = bytes([1] * 0xC2 + [2] * 0x1E + [3] * 0x10 + [4] * 5 + [1] * 11)

    def __init__(self) -> None:
        self.held = b""

    def push(self, block: bytes) -> str:
        data = self.held + block
        end = len(data)
        for back in range(1, min(3, end) + 1):
            b = data[end - back]
            if b & 0xC0 != 0x80:
                if self.LENGTH[b] > back:
                    end -= back
                break
        self.held = data[end:]
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = MOST_PIECES):
        import regex

        self.split = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.ranks = ranks
        self.most_pieces = most_pieces
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.vocabulary = [self.transducer.bytes_of.get(i, b"") for i in range(max(ranks.values(), default=-1) + 1)]

    def _piece(self, piece: str) -> list[int]:
        """The ids of a piece that the memo's newer half lacks."""
        got = self.older.get(piece)
        if got is None:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            got = [rank] if rank is not None else self.transducer.encode_piece(raw)
            if len(raw) > 64:
                return got
        if len(self.memo) >= self.most_pieces:
            self.older, self.memo = self.memo, {}
        self.memo[piece] = got
        return got

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG_TEXT:
            yield self.split.findall(text)
            return
        found = (m.group() for m in self.split.finditer(text))
        while block := list(islice(found, BLOCK)):
            yield block

    def encode_stream(self, text: str) -> Iterator[list[int]]:
        """Blocks of ids of a text of any length."""
        for pieces in self._pieces(text):
            found = list(map(self.memo.get, pieces))
            if None in found:
                found = [self._piece(p) if x is None else x for p, x in zip(pieces, found, strict=True)]
            yield list(chain.from_iterable(found))

    def encode(self, text: str) -> list[int]:
        blocks = list(self.encode_stream(text))
        return blocks[0] if len(blocks) == 1 else list(chain.from_iterable(blocks))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine, ids = Utf8Machine(), iter(ids)
        while block := b"".join(map(self.vocabulary.__getitem__, islice(ids, BLOCK))):
            yield machine.push(block)
        yield machine.finish()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


_made: dict[tuple[str, str], ByteBpe] = {}


def _coder(path: str, pattern: str) -> ByteBpe:
    """One coder for a Python worker and vocabulary."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _made[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids array<int>, decoded string) for each row: the ids of its whole text, and these ids decoded.

    path: a rank file that every executor can read; pattern: the expression whose matches are encoded separately.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        coder = _coder(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 64):
                ids = [coder.encode(t.as_py() or "") for t in texts[at : at + 64]]
                yield pa.record_batch([pa.array(keys[at : at + 64], pa.int64()), pa.array(ids, schema[1].type), pa.array([coder.decode(x) for x in ids], pa.string())], schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, ids array<int>, decoded string")


def query(spark, sf_dir):
    """Ids of all documents: their number, the digest of the ids and of the decoded bytes."""
    import public_tokenizers

    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
