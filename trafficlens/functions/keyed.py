"""Tokens that the sensor planted, and how to tell them from look-alikes.  Keys stay inside the functions: as literals
they would show in plans."""

from __future__ import annotations

import base64
import binascii
import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import STANDARD_CODES

# The layout of the tokens.  Times count from 2025-01-01.
EPOCH = 1_735_689_600
KINDS = {1: "aws_access_key", 2: "api_key", 3: "db_password", 4: "git_credentials"}

TRAP = T.StructType([T.StructField("standard", T.StringType()), T.StructField("minted_at", T.DoubleType()), T.StructField("ip_hash", T.BinaryType()), T.StructField("ua_hash", T.BinaryType())])
PLANTED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("minted_at", T.DoubleType()), T.StructField("ip_hash", T.LongType()), T.StructField("secret", T.StringType())])


def _trap(key: bytes, token: str) -> tuple | None:
    """4 bytes of time, 1 of standard, 4 of address and 4 of agent, then 6 bytes of a keyed hash; one spelling only."""
    try:
        raw = base64.urlsafe_b64decode(token + "==")
    except (binascii.Error, ValueError):
        return None
    if len(raw) != 19 or base64.urlsafe_b64encode(raw).decode().rstrip("=") != token:
        return None
    standard = {v: k for k, v in STANDARD_CODES.items()}.get(raw[4])
    if standard is None or not hmac.compare_digest(hmac.new(key, raw[:13], hashlib.blake2s).digest()[:6], raw[13:]):
        return None
    return standard, float(int.from_bytes(raw[:4], "big") + EPOCH), raw[5:9], raw[9:13]


def verify_trap(key: bytes) -> Callable[[Column], Column]:
    """Token -> struct<standard, minted_at, ip_hash, ua_hash>, of nulls unless it was minted under the key."""

    @F.pandas_udf(TRAP)
    def verify(tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(_trap(key, t) if t else None) or (None,) * 4 for t in tokens], columns=TRAP.names)

    return verify


@F.pandas_udf(T.BinaryType())
def short_hash(texts: pd.Series) -> pd.Series:
    """The four bytes by which a trap token remembers an address or agent."""
    return texts.map(lambda t: hashlib.blake2s(t.encode("utf-8", "replace"), digest_size=4).digest(), na_action="ignore")


@F.pandas_udf(T.LongType())
def address_bits(ips: pd.Series) -> pd.Series:
    """The 20 bits by which a planted credential remembers an address."""
    return ips.map(lambda t: int.from_bytes(hashlib.blake2s(t.encode("utf-8", "replace"), digest_size=3).digest(), "big") >> 4, na_action="ignore")


def _own(key: bytes) -> bytes:
    return hashlib.blake2b(key, person=b"honeytoken", digest_size=32).digest()


def _planted(key: bytes, payload: str) -> tuple | None:
    """Ten bytes in base 32: 4 bits of kind, 16 of hours, 20 of address, 40 of a keyed hash."""
    text = payload.replace("-", "").upper()
    try:
        raw = base64.b32decode(text)
    except (binascii.Error, ValueError):
        return None
    own = _own(key)
    if len(raw) != 10 or not hmac.compare_digest(hmac.new(own, raw[:5], hashlib.blake2s).digest()[:5], raw[5:]):
        return None
    head = int.from_bytes(raw[:5], "big")
    kind = KINDS.get(head >> 36)
    if kind is None:
        return None
    pair = base64.b64encode(hmac.new(own, f"aws-secret:{text}".encode(), hashlib.blake2b).digest()[:30]).decode() if kind == KINDS[1] else None
    return kind, float((head >> 20 & 0xFFFF) * 3600 + EPOCH), head & 0xFFFFF, pair


def verify_planted(key: bytes) -> Callable[[Column], Column]:
    """Payload -> struct<kind, minted_at, ip_hash, secret>; secret is what was served beside an access-key id."""

    @F.pandas_udf(PLANTED)
    def verify(payloads: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([(_planted(key, t) if t else None) or (None,) * 4 for t in payloads], columns=PLANTED.names)
        return out.astype({"ip_hash": "Int64"})

    return verify


def address_pseudonym(salt: str) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def pseudonym(ips: pd.Series) -> pd.Series:
        return ips.map(lambda ip: "anon_" + hmac.new(salt.encode(), ip.encode(), hashlib.sha256).hexdigest()[:16], na_action="ignore")

    return pseudonym
