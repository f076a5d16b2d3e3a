"""Encoding with a public byte-level BPE vocabulary by a lazily determinised finite-state transducer.

A byte string's BPE encoding is the one sequence of tokens in which each neighbouring pair is left alone by the merges
(a *compatible* pair). So the last token of every prefix is fixed: the token that ends the prefix and is compatible
with the last token of what is before it. The transducer reads byte after byte; its state is the last token written
and the bytes since. States and transitions are made when a text first needs them and kept. A token is written as soon
as every way on passes through its end, which no later byte than the longest token's length can decide.

Defined results: a null text and an empty text give the empty list; the strings of special tokens are ordinary text;
lone surrogates cannot occur in Spark strings; decoding replaces bytes that are not UTF-8 by U+FFFD, as standard UTF-8
decoders do.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.runtime import ship_package

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces, published with the vocabulary.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Kept states and pieces a worker; beyond that they are forgotten and made anew.
MOST_STATES = 200_000
MOST_PIECES = 300_000


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.prefixes = {k[:i] for k in ranks for i in range(1, len(k))}
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state: (last written token or -1, bytes since, last token of each prefix of them).
        self.states: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", ())]
        self.names = {(-1, b""): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merges applied plainly, for strings of two tokens at most."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4 * MOST_STATES:
                self.pairs.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        context, pending, lasts = self.states[state]
        pending += bytes([byte])
        n = len(pending)
        for start in range(max(0, n - self.longest), n):
            token = self.ranks.get(pending[start:])
            if token is None or (n - start > 1 and self.merged(pending[start:]) != [pending[start:]]):
                continue
            before = lasts[start - 1] if start else context
            if before < 0 or self.compatible(before, token):
                lasts += (token,)
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        written: list[int] = []
        while True:
            # Ends at which a later token may begin: here, and wherever the rest so far begins some token.
            live = [j for j in range(max(0, n - self.longest), n + 1) if j == n or pending[j:] in self.prefixes]
            if not live or live[0] == 0:
                break
            firsts = {self._first(lasts, j) for j in live}
            if len(firsts) > 1:
                break
            token = firsts.pop()
            cut = len(self.tokens[token])
            written.append(token)
            context, pending, lasts, n = token, pending[cut:], lasts[cut:], n - cut
            if not n:
                break
        name = self.names.get((context, pending))
        if name is None:
            name = self.names[context, pending] = len(self.states)
            self.states.append((context, pending, lasts))
        return name, tuple(written)

    def _first(self, lasts: tuple[int, ...], end: int) -> int:
        token = -1
        while end > 0:
            token = lasts[end - 1]
            end -= len(self.tokens[token])
        return token

    def _end(self, state: int) -> tuple[int, ...]:
        _, pending, lasts = self.states[state]
        out, end = [], len(pending)
        while end > 0:
            out.append(lasts[end - 1])
            end -= len(self.tokens[out[-1]])
        return tuple(reversed(out))

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        if len(self.states) > MOST_STATES:
            self.reset()
        state, out, moves = 0, [], self.moves
        for byte in data:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._step(state, byte)
            state, written = move
            if written:
                out.extend(written)
        end = self.ends.get(state)
        if end is None:
            end = self.ends[state] = self._end(state)
        out.extend(end)
        return tuple(out)


class Pieces(dict):
    """Pieces already encoded."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.transducer.encode_piece(piece.encode())
        if len(piece) <= 40:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = Transducer(ranks)
        self.pieces = Pieces(self.transducer)
        self.split = regex.compile(PIECES)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        get = self.pieces.__getitem__
        if len(text) < 1 << 20:
            return list(chain.from_iterable(map(get, self.split.findall(text))))
        return list(chain.from_iterable(get(m.group()) for m in self.split.finditer(text)))

    def decode(self, ids: Iterable[int]) -> str:
        d = Utf8()
        return "".join(chain((d.feed(self.transducer.tokens[i]) for i in ids), [d.close()]))


class Utf8:
    """Incremental UTF-8 decoding: the state is how many bytes are owed, the value so far, and the bounds of the next byte."""

    def __init__(self) -> None:
        self.owed, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.owed:
                if self.low <= b <= self.high:
                    self.value = self.value << 6 | b & 0x3F
                    self.owed, self.low, self.high = self.owed - 1, 0x80, 0xBF
                    if not self.owed:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.owed, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.owed, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.owed, self.value = 2, b & 0x0F
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.owed, self.value = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        owed, self.owed = self.owed, 0
        return "�" if owed else ""


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder a worker and vocabulary; a file that changed is read anew."""
    key = (vocabulary, os.stat(vocabulary).st_mtime_ns)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _encoded(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, 256):
                lists = [own.encode(t.as_py()) for t in texts[i : i + 256]]
                ends = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                flat = np.fromiter(chain.from_iterable(lists), np.int32, ends[-1])
                yield pa.record_batch([keys[i : i + 256], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k", "ids"])

    return run


def encode_corpus(documents: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids) of each row, ids being the list of token ids; no row is dropped, whatever its id or text."""
    ship_package(documents.sparkSession)
    rows = documents.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(_encoded(vocabulary), f"k {kind}, ids array<int>").withColumnRenamed("k", id_col)


def decode_corpus(encoded: DataFrame, id_col: str, ids_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text) of lists of token ids; a null list gives a null text."""
    ship_package(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).alias("k"), F.col(ids_col).alias("ids"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return rows.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", id_col)
