"""Credentials that a request tries: authorization headers, key headers, and login fields of forms, JSON and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as fixed
from ..functions import match
from ..functions.decode import latin1, unquote, valid_text
from .attacks import header

ENTRY = "struct<scheme string, source string, user string, password string>"


def _entry(scheme: Column, source: Column, user: Column, password: Column) -> Column:
    return F.struct(scheme.alias("scheme"), source.alias("source"), user.cast("string").alias("user"), password.alias("password"))


def _field(pairs: Column, names: tuple[str, ...]) -> Column:
    """The first non-empty value of a map under one of the names, whatever their case."""
    return F.coalesce(*(F.nullif(F.try_element_at(pairs, F.lit(n)), F.lit("")) for n in names))


def _pairs(raw: Column) -> Column:
    pieces = F.filter(F.split(F.coalesce(raw, F.lit("")), "&"), lambda p: p.contains("="))
    spaced = lambda t: unquote(F.translate(t, "+", " "))
    entries = F.transform(pieces, lambda p: F.struct(F.lower(spaced(F.substring_index(p, "=", 1))).alias("k"), spaced(F.substr(p, F.locate("=", p) + 1)).alias("v")))
    # The first of repeated names counts.
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(e["k"]), F.array(e["v"])))))


def credentials(log: DataFrame) -> DataFrame:
    """rid, scheme, source, user, password.  A user without a password is no credential; a malformed Basic value is kept
    as the password."""
    body = match.body_bytes(F.col("body"), F.col("body_encoding"))
    log = log.select("rid", "headers", "raw_query", body.alias("b"), F.lower(F.coalesce(header(F.col("headers"), "content-type"), F.lit(""))).alias("ct"))
    auth = F.coalesce(header(F.col("headers"), "authorization"), F.lit(""))
    scheme, value = F.lower(F.substring_index(auth, " ", 1)), F.trim(F.substr(auth, F.locate(" ", auth) + 1))
    plain = latin1(F.try_to_binary(value, F.lit("base64")))
    split = F.coalesce(plain.contains(":"), F.lit(False))
    basic = F.when(scheme == "basic", _entry(F.lit("basic"), F.lit("authorization"), F.when(split, F.substring_index(plain, ":", 1)), F.when(split, F.substr(plain, F.locate(":", plain) + 1)).otherwise(value)))
    bearer = F.when(scheme == "bearer", _entry(F.lit("bearer"), F.lit("authorization"), F.lit(None), value))
    keys = F.transform(F.filter("headers", lambda h: F.lower(h[0]).isin(*fixed.KEY_HEADERS)), lambda h: _entry(F.lit("api_key"), F.concat(F.lit("header:"), h[0]), F.lit(None), h[1]))
    form = F.when(F.col("ct").contains("x-www-form-urlencoded"), _pairs(latin1(F.col("b"))))
    doc = F.from_json(F.when(F.col("ct").contains("json"), valid_text(F.col("b"))), "map<string,string>")
    low = F.when(doc.isNotNull(), F.transform_keys(doc, lambda k, v: F.lower(k)))

    def login(pairs: Column, source: str) -> Column:
        password = _field(pairs, fixed.PASSWORD_FIELDS)
        return F.when(password.isNotNull(), _entry(F.lit("form"), F.lit(source), _field(pairs, fixed.USER_FIELDS), password))

    every = F.concat(F.array(basic, bearer), F.coalesce(keys, F.array().cast(f"array<{ENTRY}>")), F.array(login(form, "body"), login(low, "json"), login(_pairs(F.col("raw_query")), "query")))
    return log.select("rid", F.explode(F.filter(every, lambda e: e.isNotNull())).alias("e")).select("rid", "e.*")
