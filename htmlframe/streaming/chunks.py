"""Events of pages that come in pieces.

Each page is a key with state: what follows the last event that no further text can change, the tokenizer's mode there, and
chunks that came before their turn. A chunk's bytes may end inside a character; such bytes wait, too. A page ends with its last
chunk, or when no chunk came for a while.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from htmlframe import schemas as sc
from htmlframe.functions import tokens as tk
from htmlframe.operators.parse import EVENT_TYPES
from htmlframe.session import ship

STATE = "pending string, held binary, mode string, raw_name string, last_start string, pos int, turn int, early string"
BEGIN = ("", b"", tk.DATA, "", "", 0, 0, "{}")


class Feed:
    """A tokenizer that is fed text in pieces and gives the tokens that are complete. Its state is a tuple of STATE's fields."""

    def __init__(self, state: tuple = BEGIN, encoding: str = "utf-8"):
        self.pending, held, self.mode, self.raw_name, self.last_start, self.pos, self.turn, early = state
        self.early: dict[str, list] = json.loads(early)
        self.closed = False
        self.decoder = codecs.getincrementaldecoder(encoding)("replace")
        self.decoder.setstate((bytes(held), 0))

    def state(self) -> tuple:
        return self.pending, self.decoder.getstate()[0], self.mode, self.raw_name, self.last_start, self.pos, self.turn, json.dumps(self.early)

    def _tokens(self, end: bool) -> Iterator[tuple[int, tk.Token]]:
        """Complete tokens with their places; at the end, all."""
        text = self.pending
        if not end and text.endswith("\r"):  # a line feed may follow
            text = text[:-1]
        t = tk.Tokenizer(text, discard_bom=self.pos == 0)
        rest = self.pending[len(text) :]
        t.mode, t.raw_name, t.last_start = self.mode, self.raw_name, self.last_start
        left = t.text + rest
        waiting: list[tk.Token] = []
        for token in t:
            if token.kind != tk.EOF:
                waiting.append(token)
            if token.kind == tk.EOF if end else t.at < len(t.text) and not t.waiting:
                for one in waiting:
                    yield self.pos, one
                    self.pos += 1
                waiting = []
                left, self.mode, self.raw_name, self.last_start = t.text[t.at :] + rest, t.mode, t.raw_name, t.last_start
        self.pending = left

    def push(self, number: int, chunk: bytes, last: bool) -> Iterator[tuple[int, tk.Token]]:
        """Take chunk `number`, counted from 0, and give what it completes. Chunks before their turn wait; repeats are left out."""
        if number >= self.turn:
            self.early[str(number)] = [chunk.hex(), last]
        while (now := self.early.pop(str(self.turn), None)) is not None:
            self.turn += 1
            self.pending += self.decoder.decode(bytes.fromhex(now[0]), now[1])
            yield from self._tokens(now[1])
            self.closed = self.closed or now[1]

    def finish(self) -> Iterator[tuple[int, tk.Token]]:
        self.pending += self.decoder.decode(b"", True)
        yield from self._tokens(True)


def _event(key: int, pos: int, t: tk.Token) -> tuple:
    return key, pos, EVENT_TYPES[t.kind], t.name, dict(t.attrs) if t.kind == tk.START else None, t.data, t.public_id or "", t.system_id or ""


def chunk_events(chunks: DataFrame, id_col: str = "page_id", number_col: str = "number", chunk_col: str = "chunk", last_col: str = "last", encoding: str = "utf-8", wait: str | None = None) -> DataFrame:
    """Events of a streaming table of chunks (page id, number from 0, bytes or text, whether it is the page's last).

    Events come out as soon as they are complete, in append mode. wait: a page for which no chunk came for so many milliseconds
    ends, and the chunks that come later begin it anew."""
    ship(chunks.sparkSession)
    columns = [f.name for f in sc.EVENTS]

    def run(key, batches, state):
        feed = Feed(state.get if state.exists else BEGIN, encoding)
        if state.hasTimedOut:
            rows = [_event(key[0], *x) for x in feed.finish()]
            state.remove()
            yield pd.DataFrame(rows, columns=columns)
            return
        came = sorted((r for b in batches for r in zip(b["number"], b["chunk"], b["last"], strict=True)), key=lambda r: r[0])
        rows = [_event(key[0], *x) for number, chunk, last in came for x in feed.push(int(number), bytes(chunk), bool(last))]
        if feed.closed:
            state.remove()
        else:
            state.update(feed.state())
            if wait:
                state.setTimeoutDuration(int(wait))
        yield pd.DataFrame(rows, columns=columns)

    chunk = F.col(chunk_col).cast("binary")
    rows = chunks.select(F.col(id_col).cast("long").alias("page"), F.col(number_col).cast("int").alias("number"), F.coalesce(chunk, F.lit(b"")).alias("chunk"), F.coalesce(F.col(last_col), F.lit(False)).alias("last"))
    return rows.groupBy("page").applyInPandasWithState(run, sc.EVENTS_SQL, STATE, "append", "ProcessingTimeTimeout" if wait else "NoTimeout")
