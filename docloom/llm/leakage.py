"""Evaluation texts leaking into training text: an FM-index of each shard of the corpus, searched for the phrases.

build_index() cuts the corpus into shards of a bounded number of words of whole documents (a long document is cut with
an overlap of OVERLAP words) and gives one row a shard: its vocabulary and the FM-index of all its words (wavelet matrix of the
Burrows-Wheeler transform, sampled suffix positions). Written once, it serves any evaluation set, without the texts.

search_index() makes every run of ``size`` words of an evaluation text a phrase and searches each shard backward for all
phrases at once; occurrences are located by walking to sampled positions, and neighbouring ones of an item merge into spans.
Items are taken in passes of bounded size, each of which is broadcast.

Defined results
* Words are maximal runs of letters and digits, without case and accents, compatibility characters resolved; a word
  divided by a hyphen between two letters at a line end is one.
* Null ids and null texts are in no result; an item of fewer than size words is found nowhere.
* Rows of one id count as parts of one record; spans are given by word numbers from 0, last included.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize, ship_package

SHARD_WORDS = 1 << 18
SAMPLE_EVERY = 16
#: Words that the parts of a long document share, so that no phrase of at most one more is cut.
OVERLAP = 63
#: Characters of evaluation text that one pass takes (about 50 MB of phrases); larger sets are searched in several passes.
PASS_CHARS = 4_000_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_BREAK = regex.compile(r"(?<=\p{L}\p{M}*)[-‐‑­][^\S\n\r]*(?:\r\n|\n|\r)\s*(?=\p{L})")
_MARKS = regex.compile(r"\p{M}+")
_SIMPLE = regex.compile(r"[a-z0-9]+")


def normal_words(text: str) -> list[str]:
    """The words of a text in the form in which they are compared."""
    if "\n" in text or "\r" in text:
        text = _BREAK.sub("", text)
    if text.isascii():
        return _SIMPLE.findall(text.lower())
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _WORD.findall(_MARKS.sub("", text))


class Phrases:
    """The phrases of evaluation items as rows of word numbers, with the items that hold each."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.size = size
        numbers: dict[str, int] = {}
        rows, owners = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in normal_words(text)], np.int32)
            if len(ids) >= size:
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, size))
                owners.append(np.full(len(rows[-1]), item, np.int64))
        self.words = list(numbers)
        every, owner = np.ascontiguousarray(np.concatenate(rows)), np.concatenate(owners)
        _, first, phrase = np.unique(every.view(np.dtype((np.void, 4 * size))).ravel(), return_index=True, return_inverse=True)
        self.rows = every[first].astype(np.int64)
        order = np.lexsort((owner, phrase))
        phrase, owner = phrase[order], owner[order]
        new = np.r_[True, (np.diff(phrase) != 0) | (np.diff(owner) != 0)][: len(phrase)]
        self.items = owner[new]
        self.first = np.searchsorted(phrase[new], np.arange(len(self.rows) + 1))


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit of the symbols."""

    def __init__(self, levels: list[np.ndarray], n: int):
        self.packed, self.n, self.bits = levels, n, len(levels)
        plain = [np.unpackbits(level, count=n) for level in levels]
        self.ones = [np.r_[np.int32(0), np.cumsum(bit, dtype=np.int32)] for bit in plain]
        self.zeros = [n - int(ones[-1]) for ones in self.ones]

    @classmethod
    def of(cls, seq: np.ndarray, bits: int) -> WaveletMatrix:
        levels = []
        for b in range(bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            levels.append(np.packbits(bit))
            seq = np.concatenate([seq[~bit], seq[bit]])
        return cls(levels, len(seq))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is before each place."""
        start = np.zeros_like(at)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            a, s = ones[at], ones[start]
            at = np.where(bit, zeros + a, at - a)
            start = np.where(bit, zeros + s, start - s)
        return at - start

    def symbols(self, at: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            a = ones[at]
            bit = ones[at + 1] - a
            out = out << 1 | bit
            at = np.where(bit, zeros + a, at - a)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By doubling the compared length; only suffixes that still equal another are sorted again. The last symbol must be
    the only least one."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    sorted_seq = seq[order]
    new = np.r_[True, sorted_seq[1:] != sorted_seq[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    todo, width = np.flatnonzero(~(new & np.r_[new[1:], True])), 1
    while len(todo):
        part = order[todo]
        key = rank[part] * (n + 1) + rank[np.minimum(part + width, n - 1)]
        by = np.argsort(key, kind="stable")
        part, key = part[by], key[by]
        order[todo] = part
        new = np.r_[True, key[1:] != key[:-1]]
        rank[part] = todo[np.flatnonzero(new)][np.cumsum(new) - 1]
        todo, width = todo[~(new & np.r_[new[1:], True])], 2 * width
    return order


class FMIndex:
    """Of a sequence of symbols from 0 (which ends it, and occurs once) on."""

    def __init__(self, before: np.ndarray, ranks: WaveletMatrix, sampled: np.ndarray, samples: np.ndarray):
        self.before, self.ranks, self.samples = before, ranks, samples
        self.top, self.n = len(before) - 1, ranks.n
        self.packed = sampled
        self.sampled = np.unpackbits(sampled, count=self.n).astype(bool)
        self.places = np.r_[0, np.cumsum(self.sampled)]

    @classmethod
    def of(cls, seq: np.ndarray) -> FMIndex:
        sa = suffix_array(seq)
        top = int(seq.max()) + 1
        before = np.r_[0, np.cumsum(np.bincount(seq, minlength=top))].astype(np.int64)
        sampled = sa % SAMPLE_EVERY == 0
        return cls(before, WaveletMatrix.of(seq[sa - 1], max(1, (top - 1).bit_length())), np.packbits(sampled), sa[sampled])

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows found (symbols that the sequence lacks are nowhere): their numbers, and the bounds of their suffixes."""
        live = np.flatnonzero(((rows >= 0) & (rows < self.top)).all(1))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in range(rows.shape[1] - 1, -1, -1):
            c = rows[live, j]
            lo, hi = self.before[c] + self.ranks.rank(c, lo), self.before[c] + self.ranks.rank(c, hi)
            ok = lo < hi
            live, lo, hi = live[ok], lo[ok], hi[ok]
        return live, lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking backward to the next sampled one."""
        out, steps, todo = np.empty(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        at = at.copy()
        while len(todo):
            hit = self.sampled[at[todo]]
            done = todo[hit]
            out[done] = self.samples[self.places[at[done]]] + steps[done]
            todo = todo[~hit]
            c = self.ranks.symbols(at[todo])
            at[todo] = self.before[c] + self.ranks.rank(c, at[todo])
            steps[todo] += 1
        return out


SHARD = "words string, counts binary, levels array<binary>, n int, sampled binary, samples binary, docs binary, starts binary, firsts binary"
SPANS = "doc_id long, item_id long, first_word long, last_word long"
_KINDS = [pa.string(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


class _Shard:
    """Documents on their way into an index: symbol 0 ends all, 1 each document, words follow."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.docs: list[int] = []
        self.starts: list[int] = []
        self.firsts: list[int] = []
        self.n = 0

    def add(self, doc: int, words: list[str], first: int) -> None:
        put, numbers = self.numbers.setdefault, self.numbers
        ids = np.array([put(w, len(numbers) + 2) for w in words] + [1], np.int64)
        self.parts.append(ids)
        self.docs.append(doc)
        self.starts.append(self.n)
        self.firsts.append(first)
        self.n += len(ids)

    def row(self) -> pa.RecordBatch:
        index = FMIndex.of(np.concatenate([*self.parts, np.zeros(1, np.int64)]))
        longs = lambda x: np.asarray(x, np.int64).tobytes()
        values = [" ".join(self.numbers), np.diff(index.before).astype(np.int32).tobytes(), [level.tobytes() for level in index.ranks.packed], index.n, index.packed.tobytes(),
                  index.samples.astype(np.int32).tobytes(), longs(self.docs), longs(self.starts), longs(self.firsts)]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, _KINDS)], names=[c.split()[0] for c in SHARD.split(", ")])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = _Shard()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = normal_words(text.as_py())
            for a in range(0, max(1, len(words) - OVERLAP), SHARD_WORDS):
                shard.add(doc, words[a : a + SHARD_WORDS + OVERLAP], a)
                if shard.n >= SHARD_WORDS:
                    yield shard.row()
                    shard = _Shard()
    if shard.n:
        yield shard.row()


def build_index(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a shard: the FM-index of all words of its documents. Write it once, search it often."""
    ship_package(corpus.sparkSession)
    docs = corpus.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return docs.mapInArrow(_indexed, SHARD)


def _spans_of(row: dict, p: Phrases) -> pa.RecordBatch | None:
    """The spans of the phrases in one shard."""
    numbers = {w: i for i, w in enumerate(row["words"].split(), 2)}
    known = np.array([numbers.get(w, -1) for w in p.words], np.int64)
    wanted = known[p.rows]
    some = np.flatnonzero((wanted >= 0).all(1))
    if not len(some):
        return None
    before = np.r_[0, np.cumsum(np.frombuffer(row["counts"], np.int32))].astype(np.int64)
    ranks = WaveletMatrix([np.frombuffer(level, np.uint8) for level in row["levels"]], row["n"])
    index = FMIndex(before, ranks, np.frombuffer(row["sampled"], np.uint8), np.frombuffer(row["samples"], np.int32))
    docs, starts, firsts = (np.frombuffer(row[c], np.int64) for c in ("docs", "starts", "firsts"))
    found, lo, hi = index.search(wanted[some])
    rows, n = some[found], hi - lo
    at = index.locate(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    rows = np.repeat(rows, n)
    part = np.searchsorted(starts, at, side="right") - 1
    first = firsts[part] + at - starts[part]
    own = p.first[rows + 1] - p.first[rows]
    item = p.items[np.repeat(p.first[rows], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
    doc, first = np.repeat(docs[part], own), np.repeat(first, own)
    if not len(doc):
        return None
    order = np.lexsort((first, item, doc))
    doc, item, first = doc[order], item[order], first[order]
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(first) > p.size)]
    at = np.flatnonzero(new)
    last = first[np.r_[at[1:], len(first)] - 1] + p.size - 1
    return pa.record_batch([pa.array(doc[at]), pa.array(item[at]), pa.array(first[at]), pa.array(last)], names=["doc_id", "item_id", "first_word", "last_word"])


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        if not len(phrases.rows):
            return
        for batch in batches:
            for i in range(batch.num_rows):
                if (out := _spans_of(batch.slice(i, 1).to_pylist()[0], phrases)) is not None:
                    yield out

    return run


def search_index(index: DataFrame, items: DataFrame, item_col: str, item_text: str, size: int = 12) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): the stretches of each document to remove, merged per item."""
    if not 1 <= size <= OVERLAP + 1:
        raise ValueError(f"size must be at most {OVERLAP + 1}")
    spark = index.sparkSession
    ship_package(spark)
    texts = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    passes = -(-int(texts.agg(F.sum(F.length("t"))).first()[0] or 0) // PASS_CHARS)
    found = spark.createDataFrame([], SPANS)
    for k in range(passes):
        part = texts.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()
        shared = spark.sparkContext.broadcast(Phrases([(r.i, r.t) for r in part], size))
        spans = index.mapInArrow(_searched(shared), SPANS)
        if passes > 1:
            spans = materialize(spans, "spans")
            shared.destroy()
        found = found.unionByName(spans) if k else spans
    by = Window.partitionBy("doc_id", "item_id").orderBy("first_word", "last_word")
    reach = F.max("last_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.distinct().withColumn("new", (reach.isNull() | (F.col("first_word") > reach + 1)).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(by))
    return marked.groupBy("doc_id", "item_id", "island").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")).drop("island")


def leaked_spans(corpus: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text: str, size: int = 12) -> DataFrame:
    """search_index() of an index that is built, and written, for this call."""
    return search_index(materialize(build_index(corpus, id_col, text_col), "fm-index"), items, item_col, item_text, size)
