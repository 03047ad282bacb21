"""Fetches of trap paths and replays of planted credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules as fixed
from ..functions import keyed, match
from ..functions.decode import latin1, url_layers
from . import robots


def token_registry(candidates: DataFrame, key: bytes) -> DataFrame:
    """(token) -> token, standard, minted_at, ip_hash, ua_hash: the distinct candidates that were minted."""
    checked = candidates.select("token").where("token is not null").distinct().withColumn("t", keyed.verify_trap(key)("token"))
    return checked.where("t.standard is not null").select("token", "t.*")


def trap_hits(requests: DataFrame, key: bytes, rules: DataFrame) -> DataFrame:
    """Requests (ts, ip, ua, path, ...) of trap paths: standard, minted_at, delay_seconds, same_ip, same_ua,
    split_fleet, disallowed."""
    asked = requests.withColumn("token", match.trap_token(F.col("path"))).where("token is not null")
    hits = asked.join(token_registry(asked, key), "token")
    verdict = robots.disallowed(hits, rules)
    hits = hits.join(verdict, ["ua", "path"], "left")
    same_ip = keyed.short_hash("ip") == F.col("ip_hash")
    delay = F.unix_micros("ts") / 1e6 - F.col("minted_at")
    out = hits.withColumns({"delay_seconds": delay, "same_ip": same_ip, "same_ua": keyed.short_hash(F.coalesce("ua", F.lit(""))) == F.col("ua_hash")})
    return out.withColumn("split_fleet", ~F.col("same_ip")).drop("ip_hash", "ua_hash")


def stable_traps(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests of the two fixed trap paths; they have no token, and what it would tell is null."""
    hits = requests.withColumn("standard", match.stable_trap(F.col("path"))).where("standard is not null")
    hits = hits.join(robots.disallowed(hits, rules), ["ua", "path"], "left")
    return hits.withColumns({"token": F.lit(None).cast("string"), "same_ip": F.lit(None).cast("boolean"), "split_fleet": F.lit(None).cast("boolean")})


def planted_candidates(texts: DataFrame) -> DataFrame:
    """(..., text) -> (..., payload) of what looks like a planted credential in any decoded layer."""
    layers = texts.withColumn("layer", F.explode(url_layers(F.substring("text", 1, fixed.VIEW)))).drop("text")
    shapes = F.concat(*(F.regexp_extract_all("layer", F.lit(p), F.lit(1)) for p in fixed.PLANTED))
    return layers.withColumn("payload", F.explode(shapes)).drop("layer").withColumn("payload", F.upper(F.replace("payload", F.lit("-"), F.lit("")))).distinct()


def honeytoken_hits(log: DataFrame, key: bytes) -> DataFrame:
    """rid, kind, location, minted_at, age_s, same_ip, token: replays in requests (rid, ts, ip, path, raw_query, headers,
    body), also inside Basic values; each (kind, location, token) once."""
    value = lambda h: F.trim(F.substr(h[1], F.lit(7)))
    heads = F.transform("headers", lambda h: F.struct(F.concat(F.lit("header:"), h[0]).alias("location"), h[1].alias("text")))
    basic = F.transform(F.filter("headers", lambda h: (F.lower(h[0]) == "authorization") & F.lower(h[1]).startswith("basic ")), lambda h: F.struct(F.concat(F.lit("header:"), h[0]).alias("location"), latin1(F.try_to_binary(value(h), F.lit("base64"))).alias("text")))
    part = lambda name, c: F.struct(F.lit(name).alias("location"), c.alias("text"))
    body = latin1(F.substring(match.body_bytes(F.col("body"), F.col("body_encoding")), 1, fixed.BODY))
    empty = F.array().cast("array<struct<location string, text string>>")
    parts = F.concat(F.array(part("path", F.col("path")), part("query", F.col("raw_query"))), F.coalesce(heads, empty), F.coalesce(basic, empty), F.array(part("body", body)))
    each = log.select("rid", "ts", "ip", F.explode(parts).alias("p")).select("rid", "ts", "ip", "p.*").where("text <> ''")
    found = planted_candidates(each)
    known = found.select("payload").distinct().withColumn("t", keyed.verify_planted(key)("payload")).where("t.kind is not null").select("payload", "t.*")
    hits = found.join(known, "payload").dropDuplicates(["rid", "kind", "location", "payload"])
    age = F.greatest(F.lit(0.0), F.unix_micros("ts") / 1e6 - F.col("minted_at"))
    return hits.select("rid", "kind", "location", "minted_at", age.alias("age_s"), (keyed.address_bits("ip") == F.col("ip_hash")).alias("same_ip"), F.col("payload").alias("token"))
