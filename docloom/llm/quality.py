"""Per-document text quality statistics, and which documents are not natural prose.

The statistics are SQL expressions (statistics()). To tell prose from lists, tables and junk, texts are looked at in
windows of WINDOW tokens, too. features() computes, in Arrow batches and for all texts of a batch at once, the same
statistics (with words told apart as there) and those of windows: how their neighbouring words fit together, by the pair
counts of the whole corpus, how many words are known, what the lines look like that they stand in, and whether these
repeat.

Both what makes a window bad and what makes a document bad is learned: ordered lists of rules are induced from labelled
documents by incremental reduced-error pruning. A rule grows on two thirds of the examples by information gain, loses its
last conditions as long as that makes it better on the other third, and covered examples are put aside. First, rules are
induced for the windows of labelled documents, each window bearing its document's label, for each kind against prose;
then for documents, whose features are the statistics and the shares of the text in windows that the first rules name. The rules for documents become
one SQL CASE expression, which is applied to all documents.

Defined results
* Null ids, null texts and blank texts are left out. Rows of one id are judged one by one.
* Without usable labels there are no rules, and no document is called anything but prose.
* Words of word_count and mean_word_length are runs of characters that are not white space; elsewhere, runs of letters
  and digits.
* Texts longer than PIECE characters are looked at piece by piece, so repeated lines are counted within a piece; the
  features of the whole text are put together from its pieces.
* Word tables take each language's words by their place in that language (languages of at least LEAST_SHARE of the
  documents; the others together count as one), so a small language is known like a large one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import SPACE_CLASS as _SPACE
from docloom.llm.splitting import WHITE_SPACE
from docloom.runtime import materialize, ship_package

KINDS = ["list", "table", "junk"]
#: Labelled documents, and windows of them, that rules are learned from, at most.
LABELLED_ROWS, LABELLED_WINDOWS = 20_000, 60_000
#: Sizes of the word tables, which are broadcast: common words, words with pair counts, known words.
COMMON, PAIRED, KNOWN = 100, 1_000, 12_000
LEAST_SHARE = 0.001
#: Tokens of a window; characters of a piece, and of the texts that are looked at together.
WINDOW, PIECE, TOGETHER = 24, 4_000_000, 1_500_000
_KEEP = r"[\p{L}\p{N}" + _SPACE[1:]


def letters(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_counts(documents: DataFrame, text_col: str) -> DataFrame:
    """(w, n) over all documents."""
    return documents.select(F.explode(letters(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def statistics(documents: DataFrame, id_col: str, text_col: str, common: int = COMMON) -> DataFrame:
    """(id, word_count, mean_word_length, symbol_ratio, line_end_ratio, common_ratio) of each non-blank document."""
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("t"))
    top = word_counts(rows, "t").orderBy(F.desc("n"), "w").limit(common).select("w").collect()
    table = F.array(*[F.lit(r.w) for r in top]) if top else F.array().cast("array<string>")
    words = F.filter(F.split("t", f"{_SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split("t", r"\r\n|\n|\r"), lambda s: F.length(F.regexp_replace(s, _SPACE, "")) > 0)
    own = letters(F.col("t"))
    rows = rows.where(F.col(id_col).isNotNull() & F.col("t").isNotNull()).where(F.col("t").rlike(f"[^{_SPACE[1:]}"))
    ended = F.filter(lines, lambda s: s.rlike(rf"[.!?…:;]{_SPACE}*$"))
    return rows.select(
        id_col,
        F.size(words).alias("word_count"),
        F.round(F.length(F.regexp_replace("t", _SPACE, "")) / F.size(words), 6).alias("mean_word_length"),
        F.round(F.length(F.regexp_replace("t", _KEEP, "")) / F.length("t"), 6).alias("symbol_ratio"),
        F.round(F.size(ended) / F.size(lines), 6).alias("line_end_ratio"),
        F.round(F.size(F.filter(own, lambda w: F.array_contains(table, w))) / F.greatest(F.size(own), F.lit(1)), 6).alias("common_ratio"),
    )


# Classes of characters: white space, letters and numbers; all others are symbols.
_SYMBOL, _WHITE, _LETTER, _NUMBER = range(4)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its class, its lower case, and whether it is a capital."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    capital = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        k = unicodedata.category(c)
        if k[0] == "L":
            kind[i] = _LETTER
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
            capital[i] = k in ("Lu", "Lt")
        elif k[0] == "N":
            kind[i] = _NUMBER
    kind[WHITE_SPACE] = _WHITE
    return kind, lower, capital


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _prefix(points: np.ndarray, power: np.ndarray) -> np.ndarray:
    terms = points.astype(np.uint64)
    terms += np.uint64(1)
    terms *= power[: len(points)]
    return np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]


def _run_ends(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.r_[False, flag, False].view(np.int8)))
    return edges[::2], edges[1::2]


class _Texts:
    """Some texts as one array of code points, each followed by a line feed, with their tokens: words, and symbols one by one."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, lowers, capitals = _characters()
        self.kind, self.lower = kinds[self.points], lowers[self.points]
        ends = np.flatnonzero(self.points == 10) if self.n == 1 else np.cumsum([len(t) + 1 for t in texts]) - 1
        self.last = ends if self.n > 1 else ends[-1:]
        self.first = np.r_[0, self.last[:-1] + 1]
        word = self.kind >= _LETTER
        starts, stops = _run_ends(word)
        symbols = np.flatnonzero(self.kind == _SYMBOL)
        order = np.argsort(np.r_[starts, symbols], kind="stable")
        self.start, self.stop = np.r_[starts, symbols][order], np.r_[stops, symbols + 1][order]
        self.is_word = (np.arange(len(order)) < len(starts)) if not len(symbols) else order < len(starts)
        self.text = np.searchsorted(self.first, self.start, "right") - 1
        self.solid_start, self.solid_stop = _run_ends(self.kind != _WHITE)
        power, self._inverse = _powers(len(self.lower) + 1)
        self._prefix = _prefix(self.lower, power)
        self.hash = self.slices(self.start, self.stop)
        self.number = self.kind[self.start] == _NUMBER
        self.capital = capitals[self.points[self.start]]

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Numbers of the slices start..stop, equal for slices that are equal but for case."""
        return _mix((self._prefix[stop] - self._prefix[start]) * self._inverse[start]).view(np.int64)

    def trimmed(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slices without white space at their ends (start, start for blank ones); no slice may cut a run of other characters."""
        a, b = np.searchsorted(self.solid_start, start), np.searchsorted(self.solid_start, stop) - 1
        blank = a > b
        if not len(self.solid_start):
            return start, start
        low = np.where(blank, start, self.solid_start[np.minimum(a, len(self.solid_start) - 1)])
        return low, np.where(blank, start, self.solid_stop[np.maximum(b, 0)])

    @cached_property
    def lines(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return _lines(self)


@dataclass
class Words:
    """Word tables by the words' numbers, sorted; code is a word's own class from 8 on, or 0."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    code: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def look(self, t: _Texts) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token (its own for frequent words, else one of the shapes 0..7), and whether it is a known word."""
        known, own = np.zeros(len(t.hash), bool), np.zeros(len(t.hash), np.int32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, t.hash), len(self.known) - 1)
            known = (self.known[at] == t.hash) & t.is_word
            own = np.where(known, self.code[at], 0)
        first = t.points[t.start]
        symbol = np.where(np.isin(first, np.array([ord(c) for c in ".!?"])), 6, np.where(np.isin(first, np.array([ord(c) for c in ",;:"])), 7, 0))
        word = np.where(t.number, 5, np.where(known, 1, 2) + np.where(t.capital, 2, 0))
        return np.where(own > 0, own, np.where(t.is_word, word, symbol)).astype(np.int32), known


def _groups_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, _Texts]]:
    """The texts of a batch by groups of bounded size, long ones cut into pieces: rows of the pieces, and the pieces."""
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for row, text in enumerate(batch.column(column).to_pylist()):
        for a in range(0, len(text), PIECE):
            piece = text[a : a + PIECE]
            if held and size + len(piece) > TOGETHER:
                yield np.array(rows), _Texts(held)
                rows, held, size = [], [], 0
            rows.append(row)
            held.append(piece)
            size += len(piece)
    if held:
        yield np.array(rows), _Texts(held)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, h, n): how often each word that is no number occurs."""
    for batch in batches:
        langs, code = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
        for rows, t in _groups_of(batch, 1):
            pick = t.is_word & ~t.number
            lang, h = code[rows[t.text[pick]]], t.hash[pick]
            order = np.lexsort((h, lang))
            lang, h = lang[order], h[order]
            new = np.flatnonzero(np.r_[True, (np.diff(lang) != 0) | (np.diff(h) != 0)][: len(h)])
            n = np.diff(np.r_[new, len(h)])
            yield pa.record_batch([pa.array(langs[lang[new]], pa.string()), pa.array(h[new]), pa.array(n)], names=["lang", "h", "n"])


def _pairs(shared):
    """(text) to (pair, n): how often classes of tokens follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = shared.value
        for batch in batches:
            for _, t in _groups_of(batch, 0):
                code, _ = words.look(t)
                key = (code[:-1].astype(np.int64) << 20 | code[1:])[t.text[:-1] == t.text[1:]]
                key, n = np.unique(key, return_counts=True)
                yield pa.record_batch([pa.array(key), pa.array(n)], names=["pair", "n"])

    return run


WINDOWED = ["fit", "known", "letters", "digits", "symbols", "capitals", "word_len", "unbroken", "line_words", "line_ended", "marked", "cells", "named", "again", "same_sentence", "sentence_words"]
FEATURES = ["word_count", "mean_word_length", "symbol_ratio", "line_end_ratio", "common_ratio", "odd", "listed", "tabled", "junked", "windows"] + WINDOWED


def _lines(t: _Texts) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The line of each token, and of each line: its text and marks."""
    points, n = t.points, len(t.points)
    brk = (points == 10) | (points == 13)
    start = np.r_[0, np.flatnonzero(brk) + 1]
    start, stop = start[start < n], np.r_[start[1:][start[1:] < n], n]
    low, high = t.trimmed(start, stop)
    blank = low == high
    text = np.searchsorted(t.first, start, "right") - 1
    near = lambda at: np.minimum(at, n - 1)
    char = [points[near(low + k)] for k in range(4)]
    space = [t.kind[near(low + k)] == _WHITE for k in range(5)]
    small = np.isin(char[0], _points("-*•+–")) & space[1]
    box = (char[0] == 91) & (((char[1] == 93) & space[2]) | ((char[2] == 93) & np.isin(char[1], _points(" xX")) & space[3]))
    letter = (char[0] >= 97) & (char[0] <= 122) & (char[1] == 41) & space[2]
    digit = [(c >= 48) & (c <= 57) for c in char]
    closed = [np.isin(char[k], _points(".)")) & space[k + 1] for k in range(4)]
    counted = digit[0] & (closed[1] | (digit[1] & (closed[2] | (digit[2] & closed[3]))))
    # Separators of cells: marks, and runs of three or more white characters or four or more dots.
    gap = t.solid_start[1:] - t.solid_stop[:-1] >= 3
    a, b = _run_ends(points == 46)
    marks = np.r_[np.flatnonzero((points == 124) | (points == 9) | (points == 59) | (points == 44)), t.solid_stop[:-1][gap], a[b - a >= 4]]
    owner = np.searchsorted(start, marks, "right") - 1
    inside = marks < high[owner]
    cells = np.bincount(owner[inside], minlength=len(start)) * 30 > np.maximum(high - low, 1)
    # A name, a colon or an equals sign, and at most one value.
    a, b = _run_ends((t.kind >= _LETTER) | (points == 95))
    at = np.searchsorted(a, low)
    name = np.r_[a, -1][at] == low
    end = np.where(name, np.r_[b, 0][at], low)
    sign = np.where(t.kind[near(end)] == _WHITE, np.r_[t.solid_start, n - 1][np.searchsorted(t.solid_start, end)], end)
    is_sign = name & (sign < high) & np.isin(points[near(sign)], _points(":="))
    bare = sign + 1 >= high  # nothing behind the sign
    runs = np.searchsorted(t.solid_start, high) - np.searchsorted(t.solid_start, sign + 1)  # words behind the sign's own
    glued = ~bare & (t.kind[near(sign + 1)] != _WHITE)
    single = bare | (glued & (runs == 0)) | (~glued & (runs == 1))
    label = (sign == end) & (points[near(sign)] == 58) & (t.kind[near(sign + 1)] == _WHITE)
    named = is_sign & (high - low < 60) & (single | label)
    ended = ~blank & np.isin(points[np.maximum(high - 1, 0)], _points(".!?…:;"))
    times = _repeats(text, t.slices(low, high), ~blank)
    line = np.searchsorted(start, t.start, "right") - 1
    return line, {"text": text, "blank": blank, "ended": ended, "marked": (small | box | letter | counted) & ~blank, "cells": cells & ~blank, "named": named & ~blank, "times": times}


def _points(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], np.uint32)


def _repeats(text: np.ndarray, h: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """How often each (text, number) occurs, 0 where not valid."""
    order = np.lexsort((h, text))
    a, b = text[order], h[order]
    new = np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)][: len(a)]
    group = np.cumsum(new) - 1
    n = np.bincount(group, weights=valid[order])
    out = np.zeros(len(text), np.int64)
    out[order] = n[group]
    return np.where(valid, out, 0)


def _sentences(t: _Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentence of each token, and of each sentence how often it occurs in its text, and its tokens."""
    points, n = t.points, len(t.points)
    stop = (points == 46) | (points == 33) | (points == 63)
    cut = (points == 10) | (points == 13)
    cut[1:] |= stop[:-1] & (t.kind[1:] == _WHITE)
    start = np.r_[0, np.flatnonzero(cut) + 1]
    start = start[start < n]
    low, high = t.trimmed(start, np.r_[start[1:], n])
    text = np.searchsorted(t.first, start, "right") - 1
    times = _repeats(text, t.slices(low, high), low < high)
    sentence = np.searchsorted(start, t.start, "right") - 1
    return sentence, times, np.bincount(sentence, minlength=len(start))


def windows_of(t: _Texts, words: Words, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, weight (characters) and WINDOWED features of the windows of some texts."""
    m = len(t.start)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(WINDOWED)))
    code, known = words.look(t)
    same = t.text[:-1] == t.text[1:]
    fit = np.r_[np.where(same, fits[code[:-1], code[1:]], 0.0), 0.0]
    pairs = np.r_[same, False].astype(np.float64)
    first = np.searchsorted(t.text, np.arange(t.n))
    count = np.bincount(t.text, minlength=t.n)
    many = np.maximum(1, (count + WINDOW // 2) // WINDOW)
    base = np.cumsum(many) - many
    window = base[t.text] + np.minimum((np.arange(m) - first[t.text]) // WINDOW, many[t.text] - 1)
    own, lines = t.lines
    sentence, times, sentence_tokens = _sentences(t)
    line_tokens = np.bincount(own, minlength=len(lines["text"]))
    width = t.stop - t.start
    run = np.searchsorted(t.solid_start, t.start, "right") - 1
    unbroken = (t.solid_stop - t.solid_start >= 29)[run]
    alpha = t.is_word & ~t.number
    total = lambda v: np.bincount(window, weights=v, minlength=int(many.sum()))
    n = np.maximum(total(np.ones(m)), 1)
    letters_in = np.maximum(total(alpha.astype(float)), 1)
    spans = np.diff(np.r_[t.start, len(t.points)])
    spans = np.where(np.r_[t.text[1:] != t.text[:-1], True], t.last[t.text] - t.start, spans)
    weight = total(spans.astype(float))
    cols = [
        total(fit) / np.maximum(total(pairs), 1), total((known & alpha).astype(float)) / letters_in, total(alpha.astype(float)) / n, total((t.is_word & t.number).astype(float)) / n,
        total((~t.is_word).astype(float)) / n, total((t.capital & alpha).astype(float)) / letters_in, total(np.where(alpha, width, 0).astype(float)) / letters_in, total((unbroken * width).astype(float)) / np.maximum(total(width.astype(float)), 1),
        total(line_tokens[own].astype(float)) / n, total(lines["ended"][own].astype(float)) / n, total(lines["marked"][own].astype(float)) / n, total(lines["cells"][own].astype(float)) / n,
        total(lines["named"][own].astype(float)) / n, total(np.log2(np.maximum(lines["times"][own], 1))) / n, total(np.log2(np.maximum(times[sentence], 1))) / n, total(sentence_tokens[sentence].astype(float)) / n,
    ]
    filled = np.flatnonzero(total(np.ones(m)) > 0)
    x = np.stack(cols, 1).astype(np.float32).astype(np.float64)
    return np.repeat(np.arange(t.n), many)[filled], weight[filled], x[filled]


def _statistics_of(t: _Texts, words: Words) -> np.ndarray:
    """Of each text the sums behind the statistics: words without white space, their characters, symbols, characters,
    lines, lines that end in punctuation, words of letters and digits, common ones."""
    by = lambda at, w=None: np.bincount(np.searchsorted(t.first, at, "right") - 1, weights=w, minlength=t.n)[: t.n]
    a, b = t.solid_start, t.solid_stop
    _, lines = t.lines
    keep = ~lines["blank"]
    line = lambda w: np.bincount(lines["text"][keep], weights=w, minlength=t.n)[: t.n]
    common = np.isin(t.hash, words.common) & t.is_word
    token = lambda w: np.bincount(t.text, weights=w, minlength=t.n)
    return np.stack([by(a), by(a, (b - a).astype(float)), token(~t.is_word), t.last - t.first, line(np.ones(keep.sum())), line(lines["ended"][keep].astype(float)), token(t.is_word), token(common)], 1)


def _windowed(shared, share: float):
    """(id, kind, text) of labelled documents to a share of their windows, drawn by number: (kind, *WINDOWED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fits = shared.value
        for batch in batches:
            ids, kinds = np.asarray(batch.column(0)), np.array(batch.column(1).to_pylist(), object)
            for rows, t in _groups_of(batch, 2):
                text, _, x = windows_of(t, words, fits)
                draw = _mix(ids[rows[text]].view(np.uint64) * np.uint64(1_000_003) + np.arange(len(text), dtype=np.uint64)) >> np.uint64(40)
                pick = draw < share * (1 << 24)
                yield pa.record_batch([pa.array(kinds[rows[text[pick]]], pa.string()), *(pa.array(x[pick, j]) for j in range(len(WINDOWED)))], names=["kind", *WINDOWED])

    return run


def _featured(shared):
    """(id, text) to (id, *FEATURES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fits, rules = shared.value
        for batch in batches:
            n, k = batch.num_rows, len(WINDOWED)
            sums, held, odd, weights, windows = np.zeros((n, 8)), np.zeros((n, k)), np.zeros((n, 1 + len(KINDS))), np.zeros(n), np.zeros(n)
            for rows, t in _groups_of(batch, 1):
                np.add.at(sums, rows, _statistics_of(t, words))
                text, weight, x = windows_of(t, words, fits)
                row = rows[text]
                bad = np.zeros((len(x), 1 + len(KINDS)), bool)
                for kind, rule in rules:
                    bad[:, 1 + kind] |= _covers(rule, x)
                bad[:, 0] = bad.any(1)
                np.add.at(held, row, x * weight[:, None])
                np.add.at(odd, row, bad * weight[:, None])
                weights += np.bincount(row, weights=weight, minlength=n)
                windows += np.bincount(row, minlength=n)
            w = np.maximum(weights, 1)
            solid, chars, symbols, length, lines, ended, own, common = sums.T
            cols = [solid, chars / np.maximum(solid, 1), symbols / np.maximum(length, 1), ended / np.maximum(lines, 1), common / np.maximum(own, 1), *(odd / w[:, None]).T, windows, *(held / w[:, None]).T]
            yield pa.record_batch([batch.column(0), *(pa.array(c) for c in cols)], names=["id", *FEATURES])

    return run


def word_tables(rows: DataFrame) -> Words:
    """Word tables of documents (lang, t), each language's words by their place in it."""
    total = rows.groupBy("lang").agg(F.count("*").alias("n"))
    size = rows.count()
    named = [r.lang for r in total.where(F.col("n") >= LEAST_SHARE * size).collect()]
    lang = F.when(F.col("lang").isin(named), F.col("lang")).otherwise("") if named else F.lit("")
    counts = rows.select(lang.alias("lang"), "t").mapInArrow(_counted, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))
    best = counts.withColumn("place", place).where(F.col("place") <= KNOWN).groupBy("h").agg(F.min("place").alias("place"), F.sum("n").alias("n"))
    top = best.orderBy("place", F.desc("n"), "h").limit(KNOWN).toPandas()
    h = top["h"].to_numpy(np.int64)
    order = np.argsort(h)
    code = np.where(np.arange(len(h)) < PAIRED, np.arange(len(h)) + 8, 0).astype(np.int32)
    common = counts.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).toPandas()["h"].to_numpy(np.int64)
    return Words(h[order], code[order], np.sort(common))


def pair_fits(rows: DataFrame, words: Words) -> np.ndarray:
    """How much more often than by chance each class of tokens follows each other, as a bounded logarithm."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    pairs = rows.select("t").mapInArrow(_pairs(shared), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    size = PAIRED + 8
    count = np.zeros((size, size))
    key = pairs["pair"].to_numpy(np.int64)
    count[key >> 20, key & 0xFFFFF] = pairs["n"]
    total = max(1.0, count.sum())
    expected = np.outer(count.sum(1), count.sum(0)) / total
    return np.clip(np.log((count + 0.5 * expected / (expected + 1) + 1e-3) / (expected + 1e-2)), -3, 3).astype(np.float32)


Rule = list[tuple[int, bool, float]]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, limit in rule:
        out &= (x[:, j] > limit) if above else (x[:, j] <= limit)
    return out


def _grow(x: np.ndarray, y: np.ndarray, most: int = 4) -> Rule:
    """Add the condition of the greatest gain until no negative is left or nothing is gained."""
    rule: Rule = []
    inside = np.arange(len(x))
    while len(rule) < most and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for j in range(x.shape[1]):
            values = x[inside, j]
            limits = np.unique(np.quantile(values, np.linspace(0.002, 0.998, 997 if len(values) < LABELLED_ROWS else 249), method="nearest").astype(np.float32))
            slot = np.searchsorted(limits, values, "left")  # how many limits lie below a value
            p, n = np.bincount(slot[y[inside]], minlength=len(limits) + 1), np.bincount(slot, minlength=len(limits) + 1)
            p, n = np.cumsum(p)[:-1], np.cumsum(n)[:-1]  # at or below each limit
            for above, pos, every in ((True, p0 - p, p0 + n0 - n), (False, p, n)):
                ok = pos >= 2
                if ok.any():
                    gain = np.where(ok, pos * (np.log2(np.maximum(pos, 1) / np.maximum(every, 1)) - base), 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (j, above, float(limits[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = inside[_covers([best[1]], x[inside])]
    return rule


def induce(x: np.ndarray, y: np.ndarray, seed: int = 5, most_rules: int = 24, least_right: float = 0.675) -> list[Rule]:
    """Ordered rules for y by incremental reduced-error pruning. A rule must be right in least_right of the examples that
    it is pruned on."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    missed = 0
    while y[left].sum() >= 3 and len(rules) < most_rules and missed < 3:
        rows = rng.permutation(np.flatnonzero(left))
        third = rng.random(len(rows)) < 1 / 3
        grow, prune = rows[~third], rows[third]
        if not y[grow].any():
            missed += 1
            continue
        rule = _grow(x[grow], y[grow])
        # Pruned by the examples of the other third that a rule gets right: those it covers and is right about, and
        # those of the other side that it leaves alone.
        covered = [_covers(rule[:k], x[prune]) for k in range(1, len(rule) + 1)]
        score = [(int((c & y[prune]).sum()), int((c & ~y[prune]).sum())) for c in covered]
        if not score:
            missed += 1
            continue
        k = max(range(len(score)), key=lambda i: (score[i][0] - score[i][1], -i))
        p, n = score[k]
        if p + 0.5 < least_right * (p + n + 1.0):
            missed += 1
            continue
        rule = rule[: k + 1]
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def case_expression(rules: list[Rule], names: list[str] = FEATURES) -> str:
    """The rules as SQL: the number of the first that holds, else 0."""
    if not rules:
        return "0"
    whens = (" AND ".join(f"{names[j]} {'>' if above else '<='} {limit!r}D" for j, above, limit in rule) for rule in rules)
    return "CASE " + " ".join(f"WHEN {w} THEN {i}" for i, w in enumerate(whens, 1)) + " ELSE 0 END"


def judge(documents: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label: str, lang_col: str | None = None) -> DataFrame:
    """(id, rule, *FEATURES): the number of the rule by which a document is not prose, 0 for prose."""
    spark = documents.sparkSession
    ship_package(spark)
    lang = F.lower(F.substring(F.coalesce(F.col(lang_col).cast("string"), F.lit("")), 1, 2)) if lang_col else F.lit("")
    rows = documents.select(F.col(id_col).cast("long").alias("id"), lang.alias("lang"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where("id is not null and t is not null").where(F.col("t").rlike(f"[^{_SPACE[1:]}"))
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label).alias("kind")).where("id is not null and kind in ('prose', 'list', 'table', 'junk')")
    known = materialize(known.distinct().orderBy(F.xxhash64("id", "kind"), "id", "kind").limit(LABELLED_ROWS).select("id", "kind"), "labelled")
    words = word_tables(rows)
    fits = pair_fits(rows, words)
    marked = rows.join(F.broadcast(known), "id").select("id", "kind", "t")
    marked = materialize(marked, "labelled-texts")
    size = (marked.agg(F.sum(F.length("t"))).first()[0] or 0) / (5 * WINDOW)
    shared = spark.sparkContext.broadcast((words, fits))
    windows = marked.mapInArrow(_windowed(shared, min(1.0, LABELLED_WINDOWS / max(1.0, size))), "kind string, " + ", ".join(f"{f} double" for f in WINDOWED)).toPandas()
    window_rules = []
    for number, kind in enumerate(KINDS):
        some = windows[windows["kind"].isin(["prose", kind])]
        window_rules += [(number, rule) for rule in induce(some[WINDOWED].to_numpy(np.float64), (some["kind"] == kind).to_numpy())] if len(some) else []
    shared = spark.sparkContext.broadcast((words, fits, window_rules))
    kinds = "id long, " + ", ".join(f"{f} double" for f in FEATURES)
    feats = rows.select("id", "t").mapInArrow(_featured(shared), kinds)
    sample = marked.select("id", "t").mapInArrow(_featured(shared), kinds).join(F.broadcast(known), "id").orderBy(F.xxhash64("id", "kind"), "id", "kind").toPandas()
    rules = induce(sample[FEATURES].to_numpy(np.float64), (sample["kind"] != "prose").to_numpy()) if len(sample) else []
    return feats.withColumn("rule", F.expr(case_expression(rules)))
