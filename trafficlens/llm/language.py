"""Operator 5: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The likelihood of a word sums over all
its segmentations into pieces (forward algorithm), and that of a text multiplies those of its words.  The probabilities
are learnt by expectation maximisation over the same sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialise, table
from .tokens import byte_pieces, default_path

#: Documents of a language that the probabilities are fitted on, about (chosen by hash), and rounds of the fit.
FIT_DOCS, ROUNDS = 1_500, 3
#: Words of more bytes are summed by logarithms, since their likelihoods could underflow (a piece has 1e-9 at least).
LINEAR = 32
#: Words of more bytes are summed one by one, BLOCK positions at a time.
LONG, BLOCK = 256, 8192
#: Characters that a task scores at once.
CHARS_AT_ONCE = 8_000_000
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 18
_SHIFT = np.uint64(64 - 18)
#: Words whose likelihoods a worker keeps, some 60 MB.
CACHE = 300_000


def words_of(text: str) -> list[str]:
    """Runs of letters; number signs such as a superscript or a fraction make no word by themselves."""
    return [w for w in _NO_LETTERS.sub(" ", text.lower()).split() if w.isalpha() or any(map(str.isalpha, w))]


class Vocabulary:
    """The pieces of a byte-level BPE file that can occur in words, found by a rolling hash in an open table."""

    def __init__(self, path: str):
        # Words are lower-case letters after a space: no other byte of ASCII can occur in them.
        able = re.compile(rb" ?[a-z\x80-\xff]+| ")
        self.pieces = [p for p in sorted(byte_pieces(path)[0]) if able.fullmatch(p)]
        self.size, self.longest = len(self.pieces), max(map(len, self.pieces))
        self.lengths = set(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], np.uint64)
        self.key, self.value = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, self.size, np.int32)
        self.depth = 1
        for i, h in enumerate(hashes):
            at, d = int(self._slot(h)), 1
            while self.value[at] != self.size:
                at, d = (at + 1) % _SLOTS, d + 1
            self.key[at], self.value[at], self.depth = h, i, max(self.depth, d)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) % (1 << 64)
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> _SHIFT

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indices of pieces; `size` where there is none."""
        at = self._slot(h).astype(np.int64)
        out = np.where(self.key[at] == h, self.value[at], self.size)
        left = np.flatnonzero((out == self.size) & (self.value[at] != self.size))
        for _ in range(1, self.depth):
            at[left] = (at[left] + 1) % _SLOTS
            hit = self.key[at[left]] == h[left]
            out[left[hit]] = self.value[at[left[hit]]]
            left = left[~hit & (self.value[at[left]] != self.size)]
        return out

    def spans(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Words of up to LONG bytes by length: (which words, length n, index [n + 1, longest + 1, words] of the piece of
        each length that ends at each place)."""
        raw = [b" " + w.encode("utf-8", "replace") if len(w) < LONG else b"" for w in words]
        size = np.array([len(r) or LONG + 1 for r in raw], np.int64)
        for n in np.unique(size[size <= LONG]):
            which = np.flatnonzero(size == n)
            most = min(self.longest, int(n))
            for some in np.array_split(which, -(-len(which) * int(n) * most // 4_000_000)):
                b = np.frombuffer(b"".join(raw[i] for i in some), np.uint8).reshape(-1, n).T.astype(np.uint64)
                h = np.zeros((n + 1, len(some)), np.uint64)
                for i in range(n):
                    h[i + 1] = h[i] * _BASE + b[i] + np.uint64(1)
                index = np.full((n + 1, most + 1, len(some)), self.size, np.int32)
                power = np.uint64(1)
                for length in range(1, most + 1):
                    power = power * _BASE
                    span = h[length:] - h[: n + 1 - length] * power
                    index[length:, length] = self.find(span.ravel()).reshape(span.shape)
                yield some, int(n), index


    def hits(self, word: bytes, begin: int, end: int) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(bounds, length, piece) of the pieces that end at the places begin + 1 .. end of a word; those of place
        begin + 1 + k lie at bounds[k] .. bounds[k + 1].  Memory grows with end - begin, not with the word."""
        low = max(0, begin - self.longest + 1)
        b = np.frombuffer(word, np.uint8, end - low, low).astype(np.uint64) + np.uint64(1)
        h, at, lengths, pieces = np.zeros(len(b) + 1, np.uint64), [], [], []
        for length in range(1, min(self.longest, end) + 1):
            # h[k]: hash of the span of this length that starts at low + k.
            h = h[: len(b) - length + 1] * _BASE + b[length - 1 :]
            if length not in self.lengths:
                continue
            skip = max(0, begin + 1 - low - length)
            index = self.find(h[skip:])
            some = np.flatnonzero(index != self.size)
            at.append(some + (skip + low + length))
            lengths.append(np.full(len(some), length, np.int32))
            pieces.append(index[some])
        place = np.concatenate(at)
        order = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[order], np.arange(begin + 1, end + 2)).tolist()
        return bounds, np.concatenate(lengths)[order], np.concatenate(pieces)[order]


@cache
def vocabulary(path: str | None = None) -> Vocabulary:
    """Without a path the default vocabulary, found where this runs."""
    with np.errstate(over="ignore"):
        return Vocabulary(path or default_path())


def ends(index: np.ndarray, nothing: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, length, words that have a piece of this length that ends at i), in the order of i."""
    for i, length in np.argwhere((index != nothing).any(2)).tolist():
        yield i, length, np.flatnonzero(index[i, length] != nothing)


def forward(index: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
    """[n + 1, words, languages]: probability of each beginning, summed over its segmentations.  p: pieces + 1 rows, the
    last one zero."""
    a = np.zeros((n + 1, index.shape[2], p.shape[1]))
    a[0] = 1
    for i, length, some in ends(index, len(p) - 1):
        a[i, some] += a[i - length, some] * p[index[i, length, some]]
    return a


def forward_log(index: np.ndarray, n: int, log_p: np.ndarray) -> np.ndarray:
    """The logarithm of `forward`, for words of any length."""
    a = np.full((n + 1, index.shape[2], log_p.shape[1]), -np.inf)
    a[0] = 0
    for i, length, some in ends(index, len(log_p) - 1):
        a[i, some] = np.logaddexp(a[i, some], a[i - length, some] + log_p[index[i, length, some]])
    return a


def forward_long(word: bytes, log_p: np.ndarray, voc: Vocabulary, whole: np.ndarray | None = None) -> np.ndarray:
    """[languages]: `forward_log` of one word of any length, holding a block of positions and the longest piece before it.
    `whole` [n + 1], for one language alone, takes the value at every position."""
    back, n = voc.longest, len(word)
    a = np.full((back + BLOCK + 1, log_p.shape[1]), -np.inf)
    a[back] = 0
    for begin in range(0, n, BLOCK):
        end = min(n, begin + BLOCK)
        bounds, length, piece = voc.hits(word, begin, end)
        gain = log_p[piece]
        for k in range(end - begin):
            of = slice(bounds[k], bounds[k + 1])
            i = back + k + 1
            a[i] = np.logaddexp.reduce(a[i - length[of]] + gain[of], axis=0)
        if whole is not None:
            whole[begin : end + 1] = a[back : back + end - begin + 1, 0]
        a[: back + 1] = a[end - begin : end - begin + back + 1].copy()
    return a[back]


def counts_long(word: bytes, log_p: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """Expected counts of the pieces in one word of one language: what is kept for every position is two numbers."""
    n = len(word)
    a, b, out = np.zeros(n + 1), np.full(n + 1, -np.inf), np.zeros(voc.size + 1)
    forward_long(word, log_p, voc, a)
    b[n] = 0
    for begin in reversed(range(0, n, BLOCK)):
        end = min(n, begin + BLOCK)
        bounds, length, piece = voc.hits(word, begin, end)
        gain = log_p[piece, 0]
        for k in reversed(range(end - begin)):
            of, i = slice(bounds[k], bounds[k + 1]), begin + k + 1
            start = i - length[of]
            b[start] = np.logaddexp(b[start], b[i] + gain[of])
        i = np.repeat(np.arange(begin + 1, end + 1), np.diff(bounds))
        out += np.bincount(piece, np.exp(a[i - length] + gain + b[i] - a[n]), voc.size + 1)
    return out


def long_words(words: list[str]) -> Iterator[tuple[int, bytes]]:
    """Which words have more than LONG bytes, and their bytes."""
    for i, w in enumerate(words):
        # A character has four bytes at most.
        if len(w) * 4 + 1 > LONG:
            raw = b" " + w.encode("utf-8", "replace")
            if len(raw) > LONG:
                yield i, raw


def log_likelihoods(words: list[str], p: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """[words, languages]; every byte is a piece and every piece has some probability, so no word is impossible."""
    out = np.zeros((len(words), p.shape[1]))
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    for which, n, index in voc.spans(words):
        out[which] = np.log(forward(index, n, p)[n]) if n <= LINEAR else forward_log(index, n, log_p)[n]
    for i, raw in long_words(words):
        out[i] = forward_long(raw, log_p, voc)
    return out


def expected_counts(words: list[str], times: np.ndarray, p: np.ndarray, voc: Vocabulary) -> np.ndarray:
    """How often each piece is expected in the words of one language (p: one column)."""
    weight, out = np.array(times, float), np.zeros(voc.size + 1)
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    for which, n, index in voc.spans(words):
        found = list(ends(index, voc.size))
        if n > LINEAR:
            a = forward_log(index, n, log_p)[:, :, 0]
            b = np.full_like(a, -np.inf)
            b[n] = 0
            for i, length, some in reversed(found):
                b[i - length, some] = np.logaddexp(b[i - length, some], b[i, some] + log_p[index[i, length, some], 0])
            for i, length, some in found:
                at = index[i, length, some]
                share = np.exp(a[i - length, some] + log_p[at, 0] + b[i, some] - a[n, some])
                out += np.bincount(at, share * weight[which[some]], voc.size + 1)
            continue
        a = forward(index, n, p)[:, :, 0]
        b = np.zeros_like(a)
        b[n] = 1
        for i, length, some in reversed(found):
            b[i - length, some] += b[i, some] * p[index[i, length, some], 0]
        scale = weight[which] / np.maximum(a[n], 1e-300)
        for i, length, some in found:
            at = index[i, length, some]
            out += np.bincount(at, a[i - length, some] * p[at, 0] * b[i, some] * scale[some], voc.size + 1)
    for i, raw in long_words(words):
        out += weight[i] * counts_long(raw, log_p, voc)
    return out[: voc.size]


def fit(sample: DataFrame, langs: list[str], path: str | None) -> np.ndarray:
    """Probabilities [pieces + 1, languages] by expectation maximisation; what comes to the driver is bounded by the
    vocabulary."""
    voc = vocabulary(path)
    p = np.append(np.full((voc.size, len(langs)), 1 / voc.size), np.zeros((1, len(langs))), axis=0)
    for _ in range(ROUNDS):

        def count(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
            voc, times = vocabulary(path), [{} for _ in langs]
            for batch in batches:
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    of = times[langs.index(lang)]
                    for w in words_of(text):
                        of[w] = of.get(w, 0) + 1
            for k, of in enumerate(times):
                if of:
                    with np.errstate(over="ignore"):
                        c = expected_counts(list(of), np.array(list(of.values())), p[:, k : k + 1], voc)
                    some = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(c[some])], names=["k", "piece", "c"])

        found = sample.mapInArrow(count, "k int, piece int, c double").groupBy("k", "piece").agg(F.sum("c").alias("c")).toPandas()
        c = np.zeros((voc.size, len(langs)))
        c[found["piece"], found["k"]] = found["c"]
        c += 0.05
        p[: voc.size] = c / c.sum(0)
    return p


def identify(docs: DataFrame, train: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score (the posterior probability of that language, all languages being equally likely before),
    one row per document.  `train` has doc_id, text and lang; rows without text or lang are ignored.

    A text that is null or has no letter is `und` with score 0, and so is every text if there is nothing to learn from.
    Equal likelihoods go to the first language by name.  Repeated rows are each judged, and learnt from once; empty
    tables give none; further columns are not read, whatever their names.  Long texts are read whole, words of any length
    are summed over all their segmentations, and only the words of a batch are held at once.
    """
    path = tokenizer
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if not langs:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    share = F.element_at(F.create_map(*(F.lit(x) for lang in langs for x in (lang, FIT_DOCS / counts[lang]))), F.col("lang"))
    sample = materialise(train.where((F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1_000_003)) / 1_000_003.0) < share).dropDuplicates().repartition(8))
    p = fit(sample.select("text", "lang"), langs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, known = vocabulary(path), {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < CHARS_AT_ONCE):
                    chars += len(texts[to] or "")
                    to += 1
                of = [words_of(t or "") for t in texts[at:to]]
                place: dict[str, int] = {}
                flat = np.array([place.setdefault(w, len(place)) for ws in of for w in ws], np.int64)
                unseen = [w for w in place if w not in known]
                sizes = np.array(list(map(len, of)))
                total = np.zeros((len(of), len(langs)))
                if len(flat):
                    with np.errstate(over="ignore"):
                        found = log_likelihoods(unseen, p, voc)
                    known.update(zip(unseen, found, strict=True))
                    each = np.array([known[w] for w in place])
                    full = len(known) > CACHE
                    for w in unseen:
                        if full or len(w) > LONG:
                            del known[w]
                    some = np.flatnonzero(sizes)
                    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[some]
                    for k in range(len(langs)):
                        total[some, k] = np.add.reduceat(each[flat, k], starts)
                best = total.argmax(1)
                odds = np.exp(total - total.max(1, keepdims=True))
                score = np.where(sizes > 0, odds.max(1) / odds.sum(1), 0.0)
                lang = [langs[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])
                at = to

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    return identify(docs, docs.where(~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
