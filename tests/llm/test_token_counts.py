"""Token counts at every prefix, against the tokeniser's own library."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trafficlens.llm.token_counts import LIMIT, chars_within, counter, op13_token_counts, token_prefixes, tokens_within
from trafficlens.llm.tokens import default_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def encoded(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", " ", "a", "I'll don't we're they've it's 'rest 'l 'r !'ll 's", "two  spaces   three \n\n\n  x\t\t y \n \nz \xa0\xa0 q", "trailing   ", "  leading",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c<|endof", "it'<|endoftext|>s  <|endoftext|>  x",
    "naïve café ÀÉÎ 日本語のテキスト한국어 العربية हिन्दी \U0001f600\U0001f468‍\U0001f469 é", "12345 678.90 3rd ٣٤ ½²", "՘֋࢏₏ x꟎b 1౜\U00010940!\U00010941 \U00010942\U00010943",
    "\x1c\x1d\x85  a　b ​﻿", "=" * 300 + "-" * 77 + " " * 130 + "x" + "ÃÂ" * 90, "supercalifragilisticexpialidocious" * 5,
]


def test_every_prefix(library):
    rng = random.Random(5)
    pool = "aeiou tnrs  \n'slmdtrev.,!?-_19 é日՘\xa0"
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(150)]
    for text in texts:
        prefixes = [text[:i] for i in range(1, len(text) + 1)]
        assert counter().counts(text).tolist() == (encoded(library, prefixes) if prefixes else []), repr(text)


def test_classes_of_all_characters(library):
    """Where patterns and library disagree on a character, its stand-in has the library's class."""
    own = counter()
    for base in [*range(0, 0x3000, 64), *range(0xA640, 0xAC00, 64), *range(0xFB00, 0x11000, 64), *range(0x1E000, 0x20000, 256)]:
        text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}{chr(c)}b" for c in range(base, base + 64) if not 0xD800 <= c < 0xE000)
        assert own.counts(text)[-1] == encoded(library, [text])[0], hex(base)


def test_long_words(library):
    rng = random.Random(1)
    word = "".join(rng.choice("etaoinshrdluacgt") for _ in range(1_000_000))
    counter()
    tracemalloc.start()
    counts = counter().counts(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert counts[-1] == encoded(library, [word])[0] and counts[1999] == encoded(library, [word[:2000]])[0]


def test_operator(spark, library):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(ODD)] + [(1, " ", "again"), (None, "no id", None), (99, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, prefix_tokens string")
    counted = token_prefixes(docs.withColumn("n_tokens", F.lit("x")))
    assert counted.columns == ["doc_id", "text", "n_tokens", "prefix_tokens"]
    got = counted.select("text", "prefix_tokens", tokens_within(F.col("prefix_tokens"), 7).alias("head"), chars_within(F.col("prefix_tokens"), 5).alias("fits")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        assert len(r.prefix_tokens) == len(text)
        assert r.head == encoded(library, [text[:7]])[0]
        assert r.fits == max(i for i, n in enumerate([0, *r.prefix_tokens]) if n <= 5)
    assert token_prefixes(docs.limit(0)).collect() == []


def test_query(spark, library):
    for sf in ("sf0.001", "sf0.01"):
        d = f"/root/testdata/{sf}"
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        want = dict(zip(texts, encoded(library, list(texts.values())), strict=True))
        got = op13_token_counts(spark, d).collect()
        assert len(got) == len(texts)
        assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), want[r.doc_id], want[r.doc_id] > LIMIT) for r in got)
