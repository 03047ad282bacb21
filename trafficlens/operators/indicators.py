"""Indicators in payloads: wallets, pools, URLs, miners, downloaders, JNDI strings and exploit marks, through all layers
of percent and base64 encoding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as fixed
from ..functions import match
from ..functions.decode import deobfuscate_all, url_layers, valid_text
from ..shared import materialise, sized

#: Lists of findings; none is cut.
LISTS = ("pools", "urls", "miners", "downloaders", "jndi")
#: Characters of a decoded text that is worth a look.
BLOB_TEXT = 8

# The alphabets and constants of Bitcoin addresses.
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_CHECKS = {"v0": 1, "later": 0x2BC830A3}


def _base58_ok(address: str) -> bool:
    if not all(c in _BASE58 for c in address):
        return False
    n = 0
    for c in address:
        n = n * 58 + _BASE58.index(c)
    zeros = len(address) - len(address.lstrip("1"))
    raw = bytes(zeros) + n.to_bytes(-(-n.bit_length() // 8), "big")
    check = hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4]
    return len(raw) == 25 and raw[0] in (0, 5) and check == raw[-4:]


def _bech32_ok(address: str) -> bool:
    if address not in (address.lower(), address.upper()):
        return False
    data = [_BECH32.find(c) for c in address.lower()[3:]]
    if len(data) < 7 or -1 in data or not address.lower().startswith("bc1"):
        return False
    check = 1
    for value in (3, 3, 0, 2, 3, *data):  # the prefix "bc" as the checksum sees it
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ value
        for bit, generator in enumerate(_GENERATORS):
            check ^= generator if top >> bit & 1 else 0
    version, payload = data[0], data[1:-6]
    left = len(payload) * 5 % 8
    spare = int("".join(f"{v:05b}" for v in payload)[-left:] or "0", 2) if left else 0
    size = len(payload) * 5 // 8
    return version <= 16 and check == _CHECKS["later" if version else "v0"] and left < 5 and not spare and 2 <= size <= 40 and (version > 0 or size in (20, 32))


@F.pandas_udf(T.BooleanType())
def valid_bitcoin(addresses: pd.Series) -> pd.Series:
    return addresses.map(lambda a: _bech32_ok(a) if a.lower().startswith("bc1") else _base58_ok(a), na_action="ignore")


def valid_wallets(candidates: DataFrame) -> DataFrame:
    """(chain, address) -> those that can be one: Bitcoin addresses must hold their checksum.  Distinct ones only."""
    each = candidates.select("chain", "address").distinct()
    return each.where((F.col("chain") != "bitcoin") | valid_bitcoin(F.when(F.col("chain") == "bitcoin", F.col("address"))))


def _every(layers: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.flatten(F.transform(layers, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(group)))))


def _any(layers: Column, pattern: str) -> Column:
    return F.exists(layers, lambda t: t.rlike(pattern))


def pools(layers: Column) -> Column:
    hosts = F.flatten(F.transform(layers, lambda t: F.filter(F.array(*map(F.lit, fixed.POOL_HOSTS)), lambda h: F.lower(t).contains(h))))
    return F.array_distinct(F.concat(_every(layers, fixed.STRATUM), hosts))


def urls(layers: Column) -> Column:
    return _every(layers, fixed.PAYLOAD_URL)


def miners(layers: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(layers, lambda t: F.filter(F.array(*map(F.lit, fixed.MINERS)), lambda m: F.lower(t).contains(m)))))


def downloaders(layers: Column) -> Column:
    return _every(layers, fixed.DOWNLOADER)


def wallets(layers: Column) -> Column:
    """array<struct<chain, address>>, before the check of Bitcoin's sums."""
    table = (("monero", fixed.MONERO), ("bitcoin", fixed.BITCOIN), ("ethereum", fixed.ETHEREUM))


    def named(chain: str) -> Callable[[Column], Column]:
        return lambda a: F.struct(F.lit(chain).alias("chain"), a.alias("address"))

    return F.concat(*(F.transform(_every(layers, p), named(chain)) for chain, p in table))


def shellshock(layers: Column) -> Column:
    return _any(layers, fixed.SHELLSHOCK)


def metadata_ssrf(layers: Column) -> Column:
    return _any(layers, fixed.METADATA)


def base64_texts(layers: Column) -> Column:
    """Texts of the base64 blobs of a level: decodable ones of at least eight characters."""
    blobs = _every(layers, fixed.BASE64)
    pad = lambda b: F.rpad(b, F.ceil(F.length(b) / 4) * 4, F.lit("="))
    texts = F.transform(blobs, lambda b: F.replace(valid_text(F.try_to_binary(pad(F.rtrim(b, F.lit("="))), F.lit("base64"))), F.lit("�"), F.lit("")))
    return F.filter(texts, lambda t: F.length(t) >= BLOB_TEXT)


def parts(log: DataFrame) -> DataFrame:
    """rid, pos, location, text, urls: the parts of a request; urls says whether a URL there is a payload."""
    body = valid_text(match.body_bytes(F.col("body"), F.col("body_encoding")))
    path = F.coalesce("raw_path", "path")
    part = lambda location, text, ok: F.struct(location.alias("location"), text.alias("text"), ok.alias("urls"))
    heads = F.transform("headers", lambda h: part(F.concat(F.lit("header:"), h[0]), h[1], ~F.lower(h[0]).isin(*fixed.URL_FREE_HEADERS)))
    whole = F.concat(F.array(part(F.lit("path"), path, path.startswith("/")), part(F.lit("query"), F.col("raw_query"), F.lit(True))), F.coalesce(heads, F.array().cast("array<struct<location string, text string, urls boolean>>")), F.array(part(F.lit("body"), body, F.lit(True))))
    return log.select("rid", F.posexplode(whole).alias("pos", "p")).select("rid", "pos", "p.*").where("text <> ''")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sound(addresses: pd.Series) -> pd.Series:
    """Of each list of Bitcoin addresses those that hold their checksum."""
    return addresses.map(lambda xs: [a for a in xs if (_bech32_ok(a) if a.lower().startswith("bc1") else _base58_ok(a))], na_action="ignore")


def scan_texts(texts: DataFrame, own_host: str | None = None) -> DataFrame:
    """(text, urls), each once -> text, urls, b1, b2, depth, outer and the findings: a row for each level of a text (itself,
    and the texts in base64 inside, two levels deep) in which something is found; `outer` counts the whole text's layers."""
    level = texts.select(F.struct("text", "urls").alias("of"), "text", F.lit(0).alias("b1"), F.lit(0).alias("b2")).withColumn("layers", url_layers(F.col("text"))).withColumn("outer", F.size("layers") - 1)
    one = level.select("of", "outer", F.posexplode(base64_texts(F.col("layers"))).alias("b1", "text")).withColumns({"b1": F.col("b1") + 1, "b2": F.lit(0)}).withColumn("layers", url_layers(F.col("text")))
    two = one.select("of", "outer", "b1", F.posexplode(base64_texts(F.col("layers"))).alias("b2", "text")).withColumn("b2", F.col("b2") + 1).withColumn("layers", url_layers(F.col("text")))
    every = level.unionByName(one).unionByName(two)
    layers = F.col("layers")
    every = every.withColumn("clear", deobfuscate_all(layers))
    plain, found = _every(layers, fixed.JNDI), _every(F.col("clear"), fixed.JNDI)
    links = F.when(F.col("of.urls"), urls(layers)).otherwise(F.array().cast("array<string>"))
    if own_host:
        links = F.filter(links, lambda u: F.coalesce(F.try_parse_url(u, F.lit("HOST")), F.lit("")) != own_host)
    every = every.select(
        F.col("of.text").alias("text"), F.col("of.urls").alias("may_link"), "b1", "b2", F.when(F.col("b2") > 0, 2).when(F.col("b1") > 0, 1).otherwise(0).alias("depth"),
        "outer", wallets(layers).alias("candidates"), pools(layers).alias("pools"), links.alias("urls"), miners(layers).alias("miners"),
        downloaders(layers).alias("downloaders"), found.alias("jndi"), ((F.size(found) > 0) & (F.size(plain) == 0)).alias("jndi_obfuscated"),
        shellshock(layers).alias("shellshock"), metadata_ssrf(layers).alias("metadata_ssrf"),
    )
    # The scan is the costly part: it is written before its columns are asked for more than once.
    every = materialise(every)
    some = lambda c: F.size(c) > 0
    hit = some("pools") | some("urls") | some("miners") | some("downloaders") | some("jndi") | F.col("shellshock") | F.col("metadata_ssrf")
    bitcoin = F.transform(F.filter("candidates", lambda w: w["chain"] == "bitcoin"), lambda w: w["address"])
    checked = every.where(hit | some("candidates")).withColumn("sound", _sound(bitcoin))
    coins = F.filter("candidates", lambda w: (w["chain"] != "bitcoin") | F.array_contains(F.col("sound"), w["address"]))
    return checked.withColumn("coins", coins).where(hit | some("coins")).drop("candidates", "sound")


def scan(parts: DataFrame, own_host: str | None = None) -> DataFrame:
    """(rid, pos, location, text, urls) -> one row per request with findings: rid, indicators' fields, locations.

    Texts inside base64 are scanned like the part that holds them, two levels deep.  Lists are merged in the order of
    parts, then levels, each value once.  Each distinct text is scanned once, and only those with findings
    meet the requests again; of these all is put together by one grouping.
    """
    parts = parts.select("rid", "pos", "location", "text", F.coalesce("urls", F.lit(False)).alias("may_link"))
    found = materialise(scan_texts(parts.select("text", F.col("may_link").alias("urls")).distinct(), own_host))
    hits = parts.join(sized(found, "text"), ["text", "may_link"]).withColumn("key", F.struct("pos", "b1", "b2"))
    # The arrays of one request: its parts, each with a few levels.
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("key", c))), lambda x: x[c]))
    merged = lambda c: F.array_distinct(in_order(c))
    out = hits.groupBy("rid").agg(
        F.max("depth").alias("decoded_layers"), F.max("outer").alias("url_decoded_layers"), F.array_sort(F.collect_set(F.struct("pos", "location"))).alias("l"),
        *(merged(c).alias(c) for c in LISTS), *(F.bool_or(c).alias(c) for c in ("jndi_obfuscated", "shellshock", "metadata_ssrf")), in_order("coins").alias("coins"),
    )
    of = lambda chain: F.array_distinct(F.transform(F.filter("coins", lambda w: w["chain"] == chain), lambda w: w["address"]))
    chains = F.filter(F.array(*(F.struct(F.lit(c).alias("chain"), of(c).alias("found")) for c in ("bitcoin", "ethereum", "monero"))), lambda e: F.size(e["found"]) > 0)
    return out.select("rid", "decoded_layers", "url_decoded_layers", F.transform("l", lambda x: x["location"]).alias("indicator_locations"), *LISTS, "jndi_obfuscated", "shellshock", "metadata_ssrf", F.map_from_entries(chains).alias("wallets"))


def scan_requests(log: DataFrame, own_host: str | None = None) -> DataFrame:
    return scan(parts(log), own_host)


def exploit_flags(jndi: Column, shell: Column, metadata: Column) -> Column:
    return F.filter(F.array(F.when(F.size(jndi) > 0, "log4shell"), F.when(shell, "shellshock"), F.when(metadata, "metadata_ssrf")), lambda e: e.isNotNull())
