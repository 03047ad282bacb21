"""Operator 10: mixture-controlled packing.

Deficit round-robin over one queue of tokens per source: in each window (one sequence) every source is due its weight's
share of the window; what rounding leaves unserved is carried to the next window.  With the queues' lengths known, what
a source has been served after w windows has a closed form between the windows in which a queue runs dry, so every task
places its documents by itself and the deficits run on across windows and partitions without a pass over the data in
order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import materialise, table
from .tokens import encoder

SEQUENCE = 2048
END = 1
#: Characters that a task encodes at once.
CHARS_AT_ONCE = 4_000_000
#: Largest weight: weights times tokens stay within 64 bits up to 2**46 tokens.
MOST_WEIGHT = 1 << 16
#: Weights of the registered query by source (code points, null last), repeating.
TARGETS = (3, 1, 2)


def tokenise(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, source, part, start (in the queue that this part has of the source), n, ids (16-bit), in file order."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["source"], *T._parse_datatype_string("part int, start long, n long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, lengths = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            texts, sources = batch.column("text").to_pylist(), batch.column("source").to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < CHARS_AT_ONCE):
                    chars += len(texts[to] or "")
                    to += 1
                ids = [x + END.to_bytes(2, "little") for x in enc.encode([t or "" for t in texts[at:to]])]
                starts = []
                for s, x in zip(sources[at:to], ids, strict=True):
                    starts.append(lengths.get(s, 0))
                    lengths[s] = starts[-1] + len(x) // 2
                cut = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("source"), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=schema.names,
                )
                at = to

    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Plan:
    """Queues in round-robin order.  `lengths`: tokens of each queue; `weights`: integers of 1 to MOST_WEIGHT, their
    shares of a window.  A queue that runs dry leaves its share to the others by their weights."""

    lengths: tuple[int, ...]
    weights: tuple[int, ...]
    window: int = SEQUENCE
    sequence: int = SEQUENCE

    @cached_property
    def phases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Between two windows in which a queue runs dry: the first window, what each queue has been served before it,
        and the weights of the queues that still hold tokens, added up.  There are at most as many as queues."""
        w, served, out = 0, [0] * len(self.lengths), []
        while True:
            active = [s for s, n in enumerate(self.lengths) if served[s] < n]
            total = max(1, sum(self.weights[s] for s in active))
            out.append((w, tuple(served), total))
            if not active:
                break
            windows = min(-(-(self.lengths[s] - served[s]) * total // (self.window * self.weights[s])) for s in active)
            w += windows
            served = [min(n, served[s] + windows * self.window * self.weights[s] // total) for s, n in enumerate(self.lengths)]
        first, base, totals = zip(*out, strict=True)
        return np.array(first, np.int64), np.array(base, np.int64).reshape(len(out), -1), np.array(totals, np.int64)

    def served(self, w: np.ndarray) -> np.ndarray:
        """[windows, queues]: tokens that each queue has been served before each window."""
        first, base, totals = self.phases
        p = np.searchsorted(first, w, "right") - 1
        due = (w - first[p])[:, None] * self.window * np.array(self.weights, np.int64) // totals[p][:, None]
        return np.minimum(np.array(self.lengths, np.int64), base[p] + due)

    def window_of(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window that serves token `at` of queue s."""
        first, base, totals = self.phases
        row = np.arange(len(s))
        p = (base.T[s] <= at[:, None]).sum(1) - 1
        w = first[p] + (at - base[p, s]) * totals[p] // (self.window * np.array(self.weights, np.int64)[s])
        while True:
            late = self.served(w)[row, s] > at
            early = self.served(w + 1)[row, s] <= at
            if not (late.any() or early.any()):
                return w
            w = w - late + early

    @cached_property
    def tail(self) -> np.ndarray:
        """Where the sequences after the last full one begin: lengths that are powers of two need no padding."""
        total = sum(self.lengths)
        at, left = total - total % self.sequence, total % self.sequence
        starts = []
        while left:
            size = 1 << (left.bit_length() - 1)
            starts.append(at)
            at, left = at + size, left - size
        return np.array(starts, np.int64)

    def sequence_of(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence that holds place g of the whole stream, and the last sequence's index before the tail."""
        full = sum(self.lengths) // self.sequence
        in_tail = full + np.searchsorted(self.tail, g, "right") - 1
        return np.where(g < full * self.sequence, g // self.sequence, in_tail)

    def starts_of(self, sequence: np.ndarray) -> np.ndarray:
        full = sum(self.lengths) // self.sequence
        tail = np.append(self.tail, sum(self.lengths))
        return np.where(sequence < full, sequence * self.sequence, tail[np.clip(sequence - full, 0, len(tail) - 1)])

    def pieces(self, s: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, length, sequence, offset) of the pieces of documents whose tokens are at .. at + n of queue s."""
        w, last = self.window_of(s, at), self.window_of(s, at + n - 1)
        row = np.repeat(np.arange(len(s)), last - w + 1)
        w = w[row] + _inner(last - w + 1)
        q = s[row]
        before, after = self.served(w), self.served(w + 1)
        first, stop = before[np.arange(len(q)), q], after[np.arange(len(q)), q]
        earlier = np.where(np.arange(len(self.lengths)) < q[:, None], after, before).sum(1)
        low, high = np.maximum(at[row], first), np.minimum((at + n)[row], stop)
        some = high > low
        row, low, high, place = row[some], low[some], high[some], (earlier - first + low)[some]
        # A run is cut where sequences end.
        seq, end = self.sequence_of(place), self.sequence_of(place + high - low - 1)
        cut = np.repeat(np.arange(len(row)), end - seq + 1)
        seq = seq[cut] + _inner(end - seq + 1)
        begin = np.maximum(place[cut], self.starts_of(seq))
        stop = np.minimum((place + high - low)[cut], self.starts_of(seq + 1))
        return row[cut], (low - at[row])[cut] + begin - place[cut], stop - begin, seq, begin - self.starts_of(seq)


def _inner(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def pack(docs: DataFrame, weights: dict[str | None, int] | None = None, tokenizer: str | None = None, window: int = SEQUENCE, sequence: int = SEQUENCE) -> DataFrame:
    """Packs every token of every document into sequences; one row per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and the source.

    `weights`: integer shares of a window by source (1 to 65536); by default the sources' own shares, so that all queues
    last to the end.  A source without a weight gets 1.  When a queue runs dry the others go on in proportion to each
    other.  All sequences are full but the last few, whose lengths are powers of two.

    A null or empty text is a document of the end id alone; a null source is a source; a repeated row is a document of
    its own; a very long text is cut over as many sequences as it needs; an empty table gives an empty result; further
    columns of docs are not read, whatever their names.  Ids and places follow the order of the files' rows.
    One number per source is held by the driver and each task: sources are the components of a mixture, not hosts.
    """
    rows = materialise(tokenise(docs, tokenizer))
    parts = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = materialise(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    lengths = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    queues = sorted(lengths, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(queues)}
    total = max(1, sum(lengths.values()))
    share = [lengths[s] * MOST_WEIGHT // total if weights is None else weights.get(s, 1) for s in queues]
    plan = Plan(tuple(lengths[s] for s in queues), tuple(min(MOST_WEIGHT, max(1, x)) for x in share), window, sequence)
    schema = T.StructType([docs.schema["doc_id"], docs.schema["source"], *T._parse_datatype_string("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queue = np.array([place[s] for s in batch.column("source").to_pylist()], np.int64)
            at, n = (np.array(batch.column(c)) for c in ("at", "n"))
            row, start, length, seq, offset = plan.pieces(queue, at, n)
            ids = [np.frombuffer(raw.as_buffer(), "<u2").astype("<u4").tobytes() for raw in batch.column("ids")]
            crc = [zlib.crc32(ids[r][4 * a : 4 * b]) for r, a, b in zip(row.tolist(), start.tolist(), (start + length).tolist(), strict=True)]
            # Only the small columns: the ids of a long document would come once per piece.
            took = batch.select(["doc_id", "source"]).take(pa.array(row))
            columns = [pa.array(c, pa.int64()) for c in (start, length, crc, n[row], seq, offset)]
            yield pa.RecordBatch.from_arrays([took.column("doc_id"), took.column("source"), *columns], names=schema.names)

    # parts is a written table: Spark sends it to all executors if its size allows, else both sides are shuffled.
    bases = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "base")
    placed = rows.join(bases, (rows["part"] == bases["p"]) & rows["source"].eqNullSafe(bases["s"]))
    return placed.select("doc_id", "source", (F.col("base") + F.col("start")).alias("at"), "n", "ids").mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # One name per source, as many as the mixture has components.
    sources = sorted((r["source"] for r in docs.select("source").distinct().collect()), key=lambda s: (s is None, s or ""))
    return pack(docs, {s: TARGETS[i % len(TARGETS)] for i, s in enumerate(sources)})
