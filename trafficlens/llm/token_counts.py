"""Operator 13: token counts by prefix dynamic programming.

For every prefix of a piece of text, the last token of its encoding is the one token ending there that may follow the last
token of what lies before it (a pair may follow each other if encoding their joined bytes gives the pair back).  So one
pass over a piece gives the exact token count at each of its prefixes.  Pieces are what the pre-tokeniser cuts; a text's
table is put together from its pieces' tables, and answers questions on budgets and truncation without encoding again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import table
from .tokens import byte_pieces, default_path

#: Tables of pieces, and pairs of tokens, that a worker keeps (some 100 MB each); beyond them both start anew.
PIECES, PAIRS = 400_000, 1_000_000
#: Pieces of fewer characters are kept.
KEPT_CHARS = 64
#: Characters of the texts of one batch that a task hands on.
BATCH_CHARS = 2_000_000
#: What stands before the first token of a piece.
BEGIN = -2
#: Stand-ins for characters that the tokeniser's library and this module's patterns put into different classes.
LETTER, NUMBER, SPACE, OTHER = "a", "1", "\t", "!"


class PrefixCounter:
    """Token counts of all prefixes (in characters) of a text, by a byte-level BPE file of the `tokenizers` library."""

    def __init__(self, path: str):
        self.ranks, special = byte_pieces(path)
        if any(a != b and a in b for a in special for b in special):
            raise ValueError("added tokens that hold each other")
        self.bytes_of = {i: piece for piece, i in self.ranks.items()}
        self.bpe = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.ends = ahocorasick.Automaton()
        for piece, i in self.ranks.items():
            if b"\xff" not in piece:
                self.ends.add_word(piece.decode("latin-1"), (len(piece), i))
        self.ends.make_automaton()
        self.cut = re.compile(f"({'|'.join(map(re.escape, special))})") if special else None
        self.pretokens = regex.compile(public_tokenizers.PATTERN)
        self.runs = regex.compile(r"\s{2,}(?=\S)")
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.agreed, self.stand_in = set(map(chr, range(128))), {}
        self.follows: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _may_follow(self, last: int, token: int) -> bool:
        return self.bpe._encode_single_piece(self.bytes_of[last] + self.bytes_of[token]) == [last, token]

    def _programme(self, pieces: list[str]) -> np.ndarray:
        """One piece after the other, the counts at its characters' ends, as if each of its prefixes were a piece."""
        raw = b"\xff".join(p.encode() for p in pieces)  # that byte is in no text
        n = len(raw)
        short = n < 1 << 16
        count = [0] * (n + 1) if short else array("i", bytes(4 * n + 4))
        last = [-1] * (n + 1) if short else array("i", [-1]) * (n + 1)
        held = np.frombuffer(raw, np.uint8)
        last[0] = BEGIN
        for at in np.flatnonzero(held == 0xFF).tolist():
            last[at + 1] = BEGIN
        follows = self.follows
        if len(follows) >= PAIRS:
            follows.clear()
        for end, (size, token) in self.ends.iter(raw.decode("latin-1")):  # at each end, longer tokens come first
            end += 1
            if last[end] == -1:
                before = last[end - size]
                if before < 0:
                    fits = before == BEGIN
                else:
                    fits = follows.get(before << 32 | token)
                    if fits is None:
                        fits = follows[before << 32 | token] = self._may_follow(before, token)
                if fits:
                    count[end], last[end] = count[end - size] + 1, token
        closes = np.ones(n, bool)  # the last byte of a character
        closes[:-1] = (held[1:] & 0xC0) != 0x80
        found = np.array(count[1:], np.int32)[closes & (held != 0xFF)]
        if not found.all():
            raise ValueError("a vocabulary without single bytes")
        return found

    def _learn(self, new: list[str]) -> dict[str, np.ndarray]:
        """Makes pre-tokens known; the long ones are known as zeros and returned.  The first two characters of a contraction
        such as 'll are two pre-tokens themselves."""
        long, at, tables = {}, 0, self._programme(new)
        small = np.minimum(tables, 255).astype(np.uint8).tobytes()  # short pieces have at most four tokens a character
        for p in new:
            end = at + len(p)
            if len(p) == 3 and p[0] == "'" and p.isascii() and p[1:].isalpha():
                self.known[p] = bytes((small[at], 2, small[at + 2]))
            elif len(p) < KEPT_CHARS:
                self.known[p] = small[at:end]
            else:
                self.known[p], long[p] = bytes(len(p)), tables[at:end]
            at = end
        return long

    def _classed(self, text: str) -> str:
        """The text with stand-ins: as long, and cut by `pretokens` where the library cuts the text."""
        new = set(text) - self.agreed
        for c in new - self.stand_in.keys():
            cuts = {kind: len(self.library.pre_tokenize_str(kind + c)) for kind in (LETTER, NUMBER, OTHER)}
            kind = next((kind for kind, n in cuts.items() if n == 1), SPACE)
            ours = next((kind for kind in cuts if self.pretokens.fullmatch(kind + c)), SPACE)
            if kind == ours:
                self.agreed.add(c)
            else:
                self.stand_in[c] = kind
        odd = new & self.stand_in.keys()
        return text.translate({ord(c): self.stand_in[c] for c in odd}) if odd else text

    def _plain(self, text: str) -> np.ndarray:
        """Counts at the prefixes of a text without added tokens."""
        classed = self._classed(text)
        pieces = self.pretokens.findall(classed)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        if classed is not text:
            pieces = [text[a:b] for a, b in zip(ends - lengths, ends, strict=True)]
        if len(self.known) >= PIECES:
            self.known.clear()
        new = list(set(pieces).difference(self.known))
        long = self._learn(new) if new else {}
        counts = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint8).astype(np.int32)
        if long:
            for p, end in zip(pieces, ends, strict=True):
                if p in long:
                    counts[end - len(p) : end] = long[p]
            for p in long:
                del self.known[p]
        totals = counts[ends - 1]
        counts += np.repeat(np.cumsum(totals) - totals, lengths).astype(np.int32)
        # The last of several white spaces belongs to what follows it, but to the others where a prefix ends with it.
        for run in self.runs.finditer(classed):
            before = counts[run.start() - 1] if run.start() else 0
            counts[run.end() - 1] = before + self._programme([text[run.start() : run.end()]])[-1]
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Token counts of text[:1], text[:2], ... up to the whole text.  An added token counts as one; a prefix that ends
        inside of its string has no such token."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text) if text else np.zeros(0, np.int32)
        parts, tables, base = self.cut.split(text), [], 0
        for plain, token in zip(parts[::2], [*parts[1::2], ""], strict=True):
            if held := plain + token[:-1]:
                tables.append(self._plain(held) + base)
                base = int(tables[-1][len(plain) - 1]) if plain else base
            if token:
                base += 1
                tables.append([base])
        return np.concatenate(tables).astype(np.int32)


@cache
def counter(path: str | None = None) -> PrefixCounter:
    """Without a path the default vocabulary, found where this runs."""
    return PrefixCounter(path or default_path())


def token_prefixes(docs: DataFrame, text: str = "text", path: str | None = None, into: str = "prefix_tokens") -> DataFrame:
    """docs with one more column `into`: array<int>, at position i the tokens of the text's first i characters.

    Null and empty texts have an empty table.  Texts of any length are one row's table (four bytes a character) and are
    counted whole: a word of n bytes takes time and memory in proportion to n.  Repeated rows and ties are counted each by
    itself; an empty table of documents gives an empty one.  Other columns pass unread, whatever their names; a column that
    is called like `into` already is replaced.
    """
    docs = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).counts
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            begin, size, tables = 0, 0, []
            for i, t in enumerate(texts):
                tables.append(count(t.as_py() or ""))
                size += len(tables[-1])
                if size >= BATCH_CHARS or i + 1 == len(texts):
                    offsets = np.cumsum([0, *map(len, tables)]).astype(np.int32)
                    part = batch.slice(begin, len(tables))
                    found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tables).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, into])
                    begin, size, tables = i + 1, 0, []

    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, `{into}` array<int>")


def tokens_within(prefixes: Column, chars: Column | int) -> Column:
    """Tokens of the text's first `chars` characters, all of them if the text is shorter."""
    n = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(prefixes))
    return F.when(n > 0, F.try_element_at(prefixes, n)).otherwise(0)


def chars_within(prefixes: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens.  One more character can need fewer tokens, so it may lie
    beyond a prefix that is over the budget."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.aggregate(prefixes, F.struct(F.lit(0).alias("at"), F.lit(0).alias("best")), lambda a, n: F.struct((a["at"] + 1).alias("at"), F.when(n <= budget, a["at"] + 1).otherwise(a["best"]).alias("best")), lambda a: a["best"])
    return F.when(F.size(prefixes) > 0, fits).otherwise(0)


#: Tokens beyond which op13 calls a text too long.
LIMIT = 512


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document: the last entry of its prefix table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = tokens_within(F.col("prefix_tokens"), F.size("prefix_tokens")).cast("long")
    counted = token_prefixes(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
