"""Whether a client is the crawler that it claims to be."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as fixed
from ..functions import match
from ..shared import materialise, sized


@F.pandas_udf(T.StructType([T.StructField("version", T.IntegerType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType())]))
def ip_words(ips: pd.Series) -> pd.DataFrame:
    """An address as version and 128 bits in two words, those of IPv4 on top; null for what is no address."""

    def words(text: str | None) -> tuple[int | None, int | None, int | None]:
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None, None, None
        bits = int(address) << (96 if address.version == 4 else 0)
        signed = lambda w: w - (1 << 64) if w >> 63 else w
        return address.version, signed(bits >> 64), signed(bits & ((1 << 64) - 1))

    return pd.DataFrame([words(t) for t in ips], columns=["version", "high", "low"]).astype({"version": "Int32", "high": "Int64", "low": "Int64"})


def _leading(word: Column, bits: Column) -> Column:
    """The word's first `bits` bits (0 to 64, fewer and more count as those); the others are 0."""
    rest = F.lit(64) - bits
    return F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, word).otherwise(F.call_function("shiftleft", F.call_function("shiftright", word, rest), rest))


def _network(word: str, size: Column) -> tuple[Column, Column]:
    return _leading(F.col(f"{word}.high"), size).alias("high"), _leading(F.col(f"{word}.low"), size - 64).alias("low")


def match_range(claims: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ip, operator) -> ip, operator, cidr: the first block of the operator that holds the address.

    A block is keyed by its operator, length and leading bits.  An address asks once for each length that its operator's
    blocks of its version have (129 at most), so the join is one of equal keys, whatever the number of blocks.
    """
    asked = claims.select("ip", "operator").distinct().withColumn("w", ip_words("ip")).where("w.version is not null")
    blocks = ranges.select("operator", "idx", "cidr", F.substring_index("cidr", "/", -1).cast("int").alias("size"), ip_words(F.substring_index("cidr", "/", 1)).alias("w"))
    blocks = blocks.select("operator", F.col("w.version").alias("version"), "size", *_network("w", F.col("size")), "idx", "cidr")
    # Written, as parsing is the costly part and the lengths are asked for first.
    blocks = materialise(blocks.groupBy("operator", "version", "size", "high", "low").agg(F.min("idx").alias("idx"), F.min_by("cidr", "idx").alias("cidr")))
    sizes = blocks.groupBy("operator", "version").agg(F.collect_set("size").alias("sizes"))
    asked = asked.select("ip", "operator", "w", F.col("w.version").alias("version")).join(sizes, ["operator", "version"]).select("ip", "operator", "version", "w", F.explode("sizes").alias("size"))
    asked = asked.select("ip", "operator", "version", "size", *_network("w", F.col("size")))
    inside = asked.join(sized(blocks, "cidr"), ["operator", "version", "size", "high", "low"])
    return inside.groupBy("ip", "operator").agg(F.min_by("cidr", "idx").alias("cidr"))


def verdicts(claims: DataFrame, ranges: DataFrame, dns: DataFrame) -> DataFrame:
    """claims (ip, ua), ranges (sources.log), dns (ip, ptr, forward) -> ip, ua, claimed, operator, verdict, method,
    detail, rdns, matched_range, one row per distinct claim."""
    asked = claims.select("ip", "ua").distinct().withColumn("c", match.crawler(F.col("ua")))
    asked = asked.select("ip", "ua", F.col("c.name").alias("claimed"), F.col("c.operator").alias("operator"), F.col("c.method").alias("method"))
    loaded = ranges.select("operator").distinct().withColumn("loaded", F.lit(True))
    hit = match_range(asked.where("method = 'cidr'"), ranges).withColumnRenamed("cidr", "matched")
    all_in = asked.join(loaded, "operator", "left").join(hit, ["ip", "operator"], "left").join(dns, "ip", "left")
    name = F.rtrim(F.lower("ptr"), F.lit("."))
    suffix = match.first((F.col("operator") == op, F.greatest(F.lit(False), *(name.endswith(s) for s in ends))) for op, ends in fixed.RDNS_SUFFIXES.items())
    say = lambda verdict, method, detail: F.struct(F.lit(verdict).alias("verdict"), F.lit(method).alias("method"), detail.alias("detail"))
    cidr, rdns = F.col("method") == "cidr", F.col("method") == "rdns"
    known = F.coalesce("loaded", F.lit(False))
    confirmed = F.coalesce(F.array_contains("forward", F.col("ip")), F.lit(False))
    v = match.first(
        (
            (F.col("claimed").isNull(), say("undeclared", "none", F.lit("no declared crawler in user agent"))),
            (F.col("operator") == "library", say("undeclared", "none", F.lit("generic HTTP library"))),
            (cidr & ~known, say("unverifiable", "cidr", F.concat(F.lit("no published ranges loaded for "), "operator"))),
            (cidr & F.col("matched").isNotNull(), say("verified", "cidr", F.concat(F.lit("in "), "operator", F.lit(" range")))),
            (cidr, say("impersonating", "cidr", F.concat(F.lit("claims "), "claimed", F.lit(" but address is outside all published "), "operator", F.lit(" ranges")))),
            (rdns & F.col("ptr").isNull(), say("unverifiable", "rdns", F.lit("no PTR record"))),
            (rdns & ~confirmed, say("impersonating", "rdns", F.lit("PTR does not forward-confirm to the same address"))),
            (rdns & ~F.coalesce(suffix, F.lit(True)), say("impersonating", "rdns", F.concat(F.lit("forward-confirmed as "), "ptr", F.lit(", not a "), "operator", F.lit(" domain")))),
            (rdns, say("verified", "rdns", F.concat(F.lit("forward-confirmed "), "ptr"))),
            (F.lit(True), say("unverifiable", "none", F.concat("operator", F.lit(" publishes no verification mechanism")))),
        )
    )
    out = all_in.withColumn("v", v)
    return out.select("ip", "ua", "claimed", "operator", "v.*", F.when(rdns, F.col("ptr")).alias("rdns"), F.when(F.col("v.verdict") == "verified", F.col("matched")).alias("matched_range"))


def _keep_spaced(ttl: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (ip, claim, ts) in order -> those that are the first of their key or at least `ttl` microseconds behind the last
    one kept.  The key and time of that one are all that is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            ips, claims = batch.column("ip"), batch.column("claim")
            times = batch.column("ts").cast(pa.timestamp("us", batch.schema.field("ts").type.tz)).cast(pa.int64()).to_numpy()
            n = len(times)
            new = np.ones(n, bool)
            if n > 1:
                equal = lambda c: pc.or_(pc.fill_null(pc.equal(c[1:], c[:-1]), False), pc.and_(c[1:].is_null(), c[:-1].is_null()))
                new[1:] = ~pc.and_(equal(ips), equal(claims)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            kept = []
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                own = (ips[a].as_py(), claims[a].as_py())
                at = a
                if own == key:  # the batch before ended with this key
                    at = a + int(np.searchsorted(times[a:b], last + ttl))
                while at < b:
                    kept.append(at)
                    last = int(times[at])
                    at += 1 + int(np.searchsorted(times[at + 1 : b], last + ttl))
                key = own
            if kept:
                yield batch.take(pa.array(kept))

    return run


def dedupe_claims(claims: DataFrame, ttl: float | None = None) -> DataFrame:
    """(ip, claim, ts) -> the claims to verify: each (ip, claim) once, or again when `ttl` seconds have passed since the
    last verification; hits do not refresh it.  Rows without a time say nothing; null ips and claims are keys like others.

    With a ttl the claims of a key are sorted in one task, on disk if need be, and folded in constant memory.  Equal times
    of a key are one before the shuffle.
    """
    if ttl is None:
        return claims.groupBy("ip", "claim").agg(F.min("ts").alias("ts"))
    times = claims.select("ip", "claim", "ts").where("ts is not null").groupBy("ip", "claim", "ts").agg(F.lit(1)).select("ip", "claim", "ts")
    ordered = times.repartition("ip", "claim").sortWithinPartitions("ip", "claim", "ts")
    return ordered.mapInArrow(_keep_spaced(int(ttl * 1e6)), ordered.schema)
