"""What the headers of one request say about its client, and JA4 of a TLS hello."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from .match import claims_browser


def header_order(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.lower(h[0]))


@F.pandas_udf(T.StringType())
def _blake2s8(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: hashlib.blake2s(t.encode(), digest_size=8).hexdigest(), na_action="ignore")


def header_order_hash(order: Column) -> Column:
    return _blake2s8(F.array_join(order, "|"))


def browser_score(order: Column) -> Column:
    return F.size(F.array_intersect(order, F.array(*map(F.lit, rules.BROWSER_HEADERS))))


def signals(ua: Column, order: Column, http_version: Column) -> Column:
    browser = claims_browser(ua)
    cases = (
        (browser & (browser_score(order) <= 1), "browser_claim_thin_headers"),
        (browser & (http_version == "1.0"), "browser_claim_http10"),
        (F.coalesce(ua, F.lit("")) == "", "no_user_agent"),
        (F.array_contains(order, "from"), "sets_from_header"),
        (~F.array_contains(order, "accept-encoding"), "no_accept_encoding"),
    )
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in cases)), lambda s: s.isNotNull())


def header_flags(order: Column) -> Column:
    has = lambda name: F.array_contains(order, name)
    return F.struct(has("accept-encoding").alias("accepts_encoding"), has("accept-language").alias("sends_accept_language"), has("referer").alias("has_referer"), (has("if-none-match") | has("if-modified-since")).alias("conditional"))


def actor_id(key: bytes, ip: Column, ja4: Column, order_hash: Column) -> tuple[Column, Column]:
    """(actor, basis): a keyed hash of the address and the strongest fingerprint.  The key stays in the function, as a
    literal would show in plans."""

    @F.pandas_udf(T.StringType())
    def keyed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest()[:16], na_action="ignore")

    strong = F.coalesce(ja4, F.lit("")) != ""
    basis = F.when(strong, F.lit("ja4")).otherwise(F.lit("header_order"))
    return keyed(F.concat_ws("|", ip, basis, F.when(strong, ja4).otherwise(order_hash))), basis


def ja4(ciphers: Column, extensions: Column, sig_algs: Column, alpn: Column, sni: Column, versions: Column, legacy: Column, protocol: str = "t") -> Column:
    """JA4 from the parsed lists of a hello (arrays of numbers)."""
    real = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<int>")), lambda v: ~((v.bitwiseAND(0x0F0F) == 0x0A0A) & (F.shiftright(v, 8).bitwiseAND(0xFF) == v.bitwiseAND(0xFF))))
    hexes = lambda xs: F.array_join(F.transform(xs, lambda v: F.lower(F.lpad(F.hex(v), 4, "0"))), ",")
    short = lambda text: F.when(text == "", "0" * 12).otherwise(F.substring(F.sha2(text, 256), 1, 12))
    count = lambda xs: F.lpad(F.least(F.size(xs), F.lit(99)).cast("string"), 2, "0")
    c, e, s = real(ciphers), real(extensions), real(sig_algs)
    best = F.coalesce(F.array_max(real(versions)), legacy)
    # Short names of protocol versions.
    names = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2"}
    version = F.coalesce(*(F.when(best == k, F.lit(v)) for k, v in names.items()), F.lit("00"))
    one = F.try_element_at(alpn, F.lit(1))
    first = F.when(F.length(one) >= 2, F.concat(F.substring(one, 1, 1), F.substring(one, -1, 1))).otherwise("00")
    head = F.concat(F.lit(protocol), version, F.when(F.coalesce(sni, F.lit("")) != "", "d").otherwise("i"), count(c), count(e), F.coalesce(first, F.lit("00")))
    kept = F.array_sort(F.filter(e, lambda v: ~v.isin(0, 16)))
    tail = F.concat(hexes(kept), F.when(F.size(s) > 0, F.concat(F.lit("_"), hexes(s))).otherwise(""))
    return F.concat_ws("_", head, short(hexes(F.array_sort(c))), short(tail))
