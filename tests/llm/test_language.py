import itertools
import math
import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest

from trafficlens.llm import language
from trafficlens.llm.language import Vocabulary, default_path, expected_counts, identify, log_likelihoods, vocabulary

SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def voc():
    return vocabulary(default_path())


def by_hand(word, p, voc):
    """Sum over all ways of cutting the word."""
    raw, total = b" " + word.encode(), 0.0
    at = {x: i for i, x in enumerate(voc.pieces)}
    for cuts in itertools.product([0, 1], repeat=len(raw) - 1):
        parts, last = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(raw[last:i])
                last = i
        if all(x in at for x in parts):
            total += math.prod(p[at[x], 0] for x in parts)
    return math.log(total)


def test_forward_sums_all_segmentations(voc):
    p = np.random.default_rng(3).random((voc.size + 1, 1))
    p[-1] = 0
    p /= p.sum(0)
    words = ["the", "tion", "éa", "zq", "a", "nighttime"]
    with np.errstate(over="ignore"):
        got = log_likelihoods(words, p, voc)[:, 0]
        counts = expected_counts(words, np.ones(len(words)), p, voc)
    assert got == pytest.approx([by_hand(w, p, voc) for w in words])
    # The expected pieces cover every byte once.
    assert (counts * [len(x) for x in voc.pieces]).sum() == pytest.approx(sum(len(w.encode()) + 1 for w in words))


def by_table(word, p, voc):
    """Sum over all ways of cutting a word of any length, by exact fractions."""
    raw, at = b" " + word.encode(), {x: i for i, x in enumerate(voc.pieces)}
    ways = [Fraction(1)] + [Fraction(0)] * len(raw)
    for i in range(1, len(raw) + 1):
        for j in range(i):
            if raw[j:i] in at:
                ways[i] += ways[j] * Fraction(p[at[raw[j:i]], 0])
    return math.log(ways[-1].numerator) - math.log(ways[-1].denominator)


def test_long_words_and_long_pieces(voc):
    """Words over any cut in bytes, in an alphabet of three bytes a letter, too long for a double, and of long pieces."""
    p = np.random.default_rng(4).random((voc.size + 1, 1))
    p[-1] = 0
    p /= p.sum(0)
    long_piece = max((x for x in voc.pieces if x.isascii() and x.strip().isalpha()), key=len)
    assert len(long_piece) > 10 and voc.longest >= len(long_piece)
    words = [long_piece.decode().strip(), long_piece.decode().strip() * 2, "internationalisation" * 2, "日本語の行です" * 12, "the" * 400]
    with np.errstate(over="ignore"):
        got = log_likelihoods(words, p, voc)[:, 0]
        counts = expected_counts(words, np.ones(len(words)), p, voc)
    assert got == pytest.approx([by_table(w, p, voc) for w in words], rel=1e-9)
    assert (counts * [len(x) for x in voc.pieces]).sum() == pytest.approx(sum(len(w.encode()) + 1 for w in words))


def test_words_in_blocks(voc, monkeypatch):
    """Words that are summed block by block give what they give as a whole, at every place where a block may end."""
    rng = np.random.default_rng(5)
    p = rng.random((voc.size + 1, 3)) ** 4
    p[-1] = 0
    p /= p.sum(0)
    letters, long_piece = "abcdefghinostéü語", max(voc.pieces, key=len).decode()
    words = ["".join(random.Random(n).choices(letters, k=n)) for n in (255, 256, 300, 511, 700)] + [long_piece * 5, "the" * 150]
    monkeypatch.setattr(language, "LONG", 10**9)
    with np.errstate(over="ignore"):
        whole, counts = log_likelihoods(words, p, voc), expected_counts(words, np.arange(len(words)), p[:, :1], voc)
        monkeypatch.setattr(language, "LONG", 256)
        for block in (64, 257, 8192):
            monkeypatch.setattr(language, "BLOCK", block)
            assert log_likelihoods(words, p, voc) == pytest.approx(whole, rel=1e-10)
            assert expected_counts(words, np.arange(len(words)), p[:, :1], voc) == pytest.approx(counts, abs=1e-7)


def test_memory_of_a_very_long_word(voc):
    p = np.full((voc.size + 1, 4), 1 / voc.size)
    p[-1] = 0
    word = "".join(random.Random(1).choices("abcdefghinost", k=200_000))
    with np.errstate(over="ignore"):
        log_likelihoods(["the"], p, voc)
        tracemalloc.start()
        found = log_likelihoods([word], p, voc)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert np.isfinite(found).all() and peak < 40_000_000


def test_unlikely_words_do_not_underflow(voc):
    """The least probability that a fit can give, for every piece."""
    p = np.full((voc.size + 1, 2), 1e-9)
    p[-1] = 0
    with np.errstate(over="ignore"):
        found = log_likelihoods(["ฟ" * n for n in range(1, 40)], p, voc)
    assert np.isfinite(found).all() and (np.diff(found[:, 0]) < 0).all()


def test_vocabulary_finds_its_pieces(voc):
    with np.errstate(over="ignore"):
        h = np.array([Vocabulary._hash(x) for x in voc.pieces], np.uint64)
        assert (voc.find(h) == np.arange(voc.size)).all()
        # No neighbour in the alphabet: h + 1 would be the piece whose last byte is the next.
        assert (voc.find(h ^ np.uint64(1 << 40)) == voc.size).all()


def test_identify(spark):
    en = "the house and the garden with some other people walking there"
    de = "das haus und der garten mit einigen anderen leuten die dort gehen"
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "x") for i in range(40)]
    odd = [(100, None, None, "x"), (101, "", None, "x"), (102, "123 ...", None, "x"), (105, "½ ①", None, "x"), (106, "½ ①²", None, "x"), (103, "THE PEOPLE " * 20_000, None, "x"), (104, "der garten", None, "x"), (104, "der garten", None, "x"), (None, "die leuten", None, "x")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    got = identify(docs, docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102, 105, 106, 103, 104)] == ["und"] * 5 + ["en", "de"]
    assert all(0 <= r.score <= 1 for r in got) and by[100].score == 0
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    empty = spark.createDataFrame([], SCHEMA)
    assert identify(empty, docs).collect() == []
    assert {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from trafficlens.llm.language import op5_language_id

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    held = op5_language_id(spark, d).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
