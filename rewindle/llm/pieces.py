"""SentencePiece encoding and decoding over an Aho-Corasick automaton.

The automaton holds the model's pieces. It passes over a text once, and at each place its output links
name the pieces that end there, each of which may better the score of the place. For a unigram model
that is the Viterbi search for the segmentation with the highest sum of scores. A BPE model does not maximize
a sum: there a piece may follow another only if merging the two together leaves them apart, and exactly
one chain of such pieces covers a text, the one that merging the whole text would give. Characters that no piece
has become byte pieces.

A text gets a blank in front, blanks are written as U+2581, and, as no piece has that sign after another
character, stretches that begin with it are encoded one by one and kept for their next occurrence. Models
with another kind of normalization are refused.

Nulls: a null text counts as empty and has no ids; a null id is kept. Equal rows get equal results. A text
that itself holds U+2581 decodes to a blank in its place, as in the reference library. A table without rows
gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewindle.llm.common import ready
from rewindle.llm.tokens import Recent

BLANK = "\u2581"
_PROBE = "  a\tb\ufb01 \u2460\n  c "


class Pieces:
    """One model's pieces, as an automaton and as bytes. ``merges``: whether it is a BPE model."""

    def __init__(self, path: str, merges: bool):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.decode(model.encode(_PROBE)) != _PROBE:
            raise ValueError("the model changes its text before encoding")
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.bytes = [0] * 256
        self.merges, self.unknown = merges, model.unk_id()
        self.plain, self.table = {}, []
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
                self.table.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.table.append(b"")
            else:
                self.plain[name] = i
                self.table.append(name.replace(BLANK, " ").encode())
        if any(BLANK in p.lstrip(BLANK) for p in self.plain):
            raise ValueError("a piece has a blank inside")
        self.automaton = ahocorasick.Automaton()
        for name, i in self.plain.items():
            self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        lone = "" if any("\n" in p for p in self.plain) else "\n"
        self.stretch = re.compile(f"{BLANK}*[^{BLANK}{lone}]+|{BLANK}+" + ("|\n" if lone else ""))
        self.known, self.apart = Recent(self._encoded), {}

    def merged(self, text: str) -> list[str]:
        """The symbols of a short text after merging the best pair, leftmost first, while there is one."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.plain.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _may_follow(self, first: int, second: int) -> bool:
        pair = first << 32 | second
        out = self.apart.get(pair)
        if out is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            a, b = self.names[first], self.names[second]
            out = self.apart[pair] = self.merged(a + b) == [a, b]
        return out

    def segments(self, text: str) -> list[int]:
        """The ids of a stretch of text that has its blanks written out already."""
        n = len(text)
        score, last, start = [0.0] + [-np.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        done = 0

        def bare(upto: int) -> None:
            """Places that no piece has reached hold a character no piece has."""
            nonlocal done
            while done < upto:
                done += 1
                if score[done] == -np.inf and text[done - 1] not in self.plain:
                    score[done], last[done], start[done] = score[done - 1], -1, done - 1

        for end, (piece, length) in self.automaton.iter(text):
            bare(end)
            at, begin = end + 1, end + 1 - length
            new = score[begin] + self.scores[piece]
            if new > score[at] and (not self.merges or begin == 0 or last[begin] < 0 or self._may_follow(last[begin], piece)):
                score[at], last[at], start[at] = new, piece, begin
        bare(n)
        out, at = [], n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode())] if any(self.bytes) else [self.unknown]
            at = start[at]
        return out[::-1]

    def _encoded(self, text: str) -> bytes:
        return np.array(self.segments(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, self.stretch.findall(BLANK + text.replace(" ", BLANK))))

    def decode(self, ids: bytes) -> str:
        whole = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return whole.removeprefix(b" ").decode("utf-8", "replace")


@cache
def pieces(path: str, merges: bool) -> Pieces:
    """One per process and file."""
    return Pieces(path, merges)


def encoded(df: DataFrame, path: str, merges: bool, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ``ids``) for every whole text."""
    ready(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, merges)
        for part in parts:
            lists = [np.frombuffer(model.encode(t.as_py() or ""), "<u4") for t in part.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = np.concatenate([*lists, np.empty(0, "<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "ids"])

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id)


def decoded(df: DataFrame, path: str, merges: bool, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, ``text``) of every list of ids; null for null."""
    ready(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, merges)
        for part in parts:
            texts = [None if x.as_py() is None else model.decode(np.array(x.as_py(), "<u4").tobytes()) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return df.select(F.col(id).alias("id"), F.col(ids).alias("ids")).mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id)


def round_trips(df: DataFrame, path: str, merges: bool, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ``n_ids``, ``ids_crc32``, ``decoded_chars``, ``decoded_crc32``, ``round_trip``) of every text, encoded and decoded."""
    ready(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()

    def both(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, merges)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        for part in parts:
            rows = []
            for value in part.column(1):
                text = value.as_py() or ""
                ids = model.encode(text)
                back = model.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), len(back), zlib.crc32(back.encode()), back == text))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_ids", "ids_crc32", "decoded_chars", "decoded_crc32", "round_trip"])

    schema = f"id {kind}, n_ids long, ids_crc32 long, decoded_chars long, decoded_crc32 long, round_trip boolean"
    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(both, schema).withColumnRenamed("id", id)
