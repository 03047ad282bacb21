import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trafficlens.llm.packing import SEQUENCE, Plan, pack
from trafficlens.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int"


def plain(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, rows, sequence=2048):
    """Every id lies in one piece; sequences have no gaps; only lengths that are powers of two fall short."""
    ids = {d: plain(t) for d, t, *_ in docs}
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(ids)
    for d, ps in got.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == sequence or at < sequence and at & (at - 1) == 0


def test_round_trip(spark):
    texts = ["", None, "one two  three", " lead", "tail ", "a \n b\n\nc\t d", "é ß 日本語 text <|endoftext|> x", "don't we'll", "word " * 6000, "a  b   c    ", "\n", " <|endoftext|>a <|endoftext|><|endoftext|>  b "]
    docs = [(i, t, "en", s, 1, 2) for i, (t, s) in enumerate(zip(texts, ["a", None, "b"] * 4, strict=True))]
    check(docs, pack(spark.createDataFrame(docs, SCHEMA)).collect())


def test_repeated_rows_and_empty_table(spark):
    docs = [(1, "same text", "en", "a", 9, 0)] * 3
    rows = pack(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sum(r.length for r in rows) == 3 * len(plain("same text"))
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


def runs(plan, windows):
    w = np.arange(windows)
    return plan.served(w + 1) - plan.served(w)


def test_mixture_of_each_window():
    plan = Plan((70_000, 20_000, 10_000), (7, 2, 1), window=1000, sequence=64)
    assert (np.abs(runs(plan, 99) - np.array([700, 200, 100])) <= 1).all()
    # Queues that run dry leave their shares to the others by weight, and no window but those of the change falls short.
    plan = Plan((50_000, 3_000, 0, 9_000), (3, 1, 2, 2), window=96, sequence=64)
    got = runs(plan, 700)
    assert (got.sum(0) == plan.lengths).all()
    assert (np.abs(got[:80] - [48, 16, 0, 32]) <= 1).all()
    short = np.flatnonzero(got[: 62_000 // 96 - 3].sum(1) < 94)
    assert len(short) <= 3
    assert (np.abs(got[short[0] + 1 : short[0] + 20, [0, 3]].sum(1) - 96) <= 2).all()


def test_pieces_cover_the_stream():
    """All queues' documents, at random places: every place of the stream is taken once, in the order of the windows."""
    rng = np.random.default_rng(3)
    for lengths, weights, window, sequence in (((5_000, 300, 0), (1, 1, 1), 90, 64), ((900, 4_100, 77, 2_000), (5, 1, 9, 2), 128, 128), ((10,), (3,), 2048, 2048)):
        plan = Plan(lengths, weights, window, sequence)
        seen = np.zeros(sum(lengths), int)
        for s, n in enumerate(lengths):
            cuts = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 30)]))
            at, size = cuts[:-1], np.diff(cuts)
            if not len(at):
                continue
            row, start, length, seq, offset = plan.pieces(np.full(len(at), s), at, size)
            assert (np.bincount(row, length, len(at)) == size).all() and (length > 0).all() and (offset + length <= sequence).all()
            for r in range(len(at)):
                mine = row == r
                assert (start[mine] == np.cumsum(length[mine]) - length[mine]).all()
            for g, k in zip(plan.starts_of(seq) + offset, length, strict=True):
                seen[g : g + k] += 1
        assert (seen == 1).all()


def test_targets_of_the_sequences(spark):
    """Weights that aren't the sources' own shares: full sequences keep them until a queue runs dry."""
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(map(str, rng.integers(0, 999, int(rng.integers(20, 900))))), "en", ["a", "b", None][i % 3], 1, 2) for i in range(150)]
    rows = pack(spark.createDataFrame(docs, SCHEMA), {"a": 3, "b": 1, None: 2}).collect()
    check(docs, rows)
    share = defaultdict(lambda: defaultdict(int))
    for r in rows:
        share[r.sequence_id][r.source] += r.length
    for seq in range(10):
        for source, w in (("a", 3), ("b", 1), (None, 2)):
            assert abs(share[seq][source] - SEQUENCE * w / 6) <= 1


def test_cache_limit_does_not_change_ids(monkeypatch):
    monkeypatch.setattr("trafficlens.llm.tokens.CACHE", 3)
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["many different words come here", "and more different words come there"] * 2
    assert [list(np.frombuffer(x, "<u2")) for x in enc.encode(texts)] == [plain(t)[:-1] for t in texts]
