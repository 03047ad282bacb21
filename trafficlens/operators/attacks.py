"""Attack classification: requests are cut into units, each unit's decoded views run through the rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as fixed
from ..functions import match
from ..functions.decode import deobfuscate_all, latin1, unquote, url_layers, valid_text
from .contents import with_found
from .rulesets import RuleSet, attack_rules, with_rules

UNIT = "struct<location string, param string, text string>"


def header(headers: Column, name: str) -> Column:
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h[0]) == name), F.lit(1))[1]


def _unit(kind: str, name: Column, text: Column) -> Column:
    """A named field is its own location if its name is an identifier."""
    named = F.coalesce(name.rlike(fixed.IDENTIFIER), F.lit(False))
    location = F.when(named, F.concat(F.lit(f"{kind}:"), name)).otherwise(F.lit(kind))
    return F.struct(location.alias("location"), F.when(named, name).alias("param"), text.alias("text"))


def pair_units(raw: Column, kind: str) -> Column:
    """Units of the `&`-pieces of a query or form; `+` is a space there."""
    pieces = F.filter(F.split(raw, "&"), lambda p: p != "")
    spaced = lambda t: F.translate(t, "+", " ")

    def unit(piece: Column) -> Column:
        name = F.when(piece.contains("="), unquote(spaced(F.substring_index(piece, "=", 1))))
        named = F.coalesce(name.rlike(fixed.IDENTIFIER), F.lit(False))
        return _unit(kind, name, spaced(F.when(named, F.substr(piece, F.locate("=", piece) + 1)).otherwise(piece)))

    return F.transform(pieces, unit)


def _leaves(value: object) -> Iterator[str]:
    """Strings and keys of a JSON value, however deep, in its order."""
    left = [value]
    while left:
        value = left.pop()
        if isinstance(value, str):
            yield value
        elif isinstance(value, dict):
            left.extend(x for k, v in reversed(value.items()) for x in (v, k))
        elif isinstance(value, list):
            left.extend(reversed(value))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])))
def _json_fields(bodies: pd.Series) -> pd.Series:
    def fields(body: str | None) -> list[dict] | None:
        try:
            doc = json.loads(body) if body else None
        except (ValueError, RecursionError):  # nested beyond what Python parses: the body is one unit
            return None
        if doc is None:
            return None
        top = list(doc.items()) if isinstance(doc, dict) else [(None, doc)]
        return [{"name": k, "text": leaf} for k, v in top for leaf in _leaves(v)]

    return bodies.map(fields)


def json_units(body: Column, applies: Column) -> Column:
    """Units of a JSON body: the top-level key is the location.  Only JSON bodies go through Python."""
    return F.transform(_json_fields(F.when(applies, body)), lambda f: _unit("body", f["name"], f["text"]))


def multipart_units(body: Column, content_type: Column) -> Column:
    boundary = F.regexp_extract(content_type, '(?i)boundary="?([^";]+)', 1)
    parts = F.split(body, F.concat(F.lit(r"\Q--"), boundary, F.lit(r"\E")))
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    closing = F.coalesce(F.array_position(F.transform(parts, lambda p: p.startswith("--")), True), F.lit(0)).cast("int")
    parts = F.when(closing > 0, F.slice(parts, F.lit(1), F.greatest(closing - 1, F.lit(0)))).otherwise(parts)

    def unit(part: Column) -> Column:
        part = F.regexp_replace(part, r"^[\r\n]+", "")
        end = F.regexp_instr(part, F.lit(r"\r?\n\r?\n"))
        head = F.when(end > 0, F.substring(part, F.lit(1), end)).otherwise(part)
        name = F.when(head.rlike('name="[^"]*"'), F.regexp_extract(head, 'name="([^"]*)"', 1))
        value = F.when(end > 0, F.regexp_replace(F.substr(part, end), r"^\r?\n\r?\n|[\r\n]+$", "")).otherwise(F.lit(""))
        return _unit("body", name, value)

    return F.transform(parts, unit)


def attack_units(log: DataFrame) -> DataFrame:
    """rid, kind, idx, location, param, text of every part of a request in which a rule may fire."""
    body = match.body_bytes(F.col("body"), F.col("body_encoding"))
    ctype = F.coalesce(header(F.col("headers"), "content-type"), F.lit(""))
    log = log.select("rid", "headers", F.coalesce("raw_path", "path").alias("raw_path"), "raw_query", body.alias("b"), ctype.alias("ct"))
    log = log.withColumns({"low": F.lower("ct"), "text": valid_text(F.col("b")), "raw": latin1(F.col("b"))})
    is_json = F.col("low").contains("json") & ~F.col("low").contains("multipart/form-data") & F.col("b").isNotNull()
    log = log.withColumn("json", json_units(F.col("text"), is_json))
    whole = F.array(F.struct(F.lit("body").alias("location"), F.lit(None).cast("string").alias("param"), F.col("raw").alias("text")))
    multipart = F.col("low").contains("multipart/form-data") & F.col("low").contains("boundary=")
    form = F.col("low").contains("x-www-form-urlencoded") & ~F.col("low").contains("json")
    content = F.when(F.col("b").isNull() | (F.length("b") == 0), F.array().cast(f"array<{UNIT}>")).when(multipart, multipart_units(F.col("text"), F.col("ct"))).when(is_json, F.coalesce("json", whole)).when(form, pair_units(F.col("raw"), "body")).otherwise(whole)
    path = F.filter(F.array(F.struct(F.lit("path").alias("location"), F.lit(None).cast("string").alias("param"), F.col("raw_path").alias("text"))), lambda u: F.coalesce(u["text"], F.lit("")) != "")
    query = F.coalesce(pair_units(F.col("raw_query"), "query"), F.array().cast(f"array<{UNIT}>"))
    heads = F.coalesce(F.transform("headers", lambda h: F.struct(F.concat(F.lit("header:"), h[0]).alias("location"), F.lit(None).cast("string").alias("param"), h[1].alias("text"))), F.array().cast(f"array<{UNIT}>"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("g"), u.cast(f"array<{UNIT}>").alias("units")) for i, (k, u) in enumerate((("path", path), ("query", query), ("body", content), ("header", heads)))]
    each = log.select("rid", F.explode(F.array(*kinds)).alias("k")).select("rid", "k.kind", "k.g", F.posexplode("k.units").alias("i", "u"))
    return each.select("rid", "kind", F.struct("g", "i").alias("idx"), "u.location", "u.param", "u.text")


def with_views(units: DataFrame) -> DataFrame:
    """Adds views: array<struct<text, decoded>>, raw text first, then decoded layers, then collapsed lookups."""
    layers = units.withColumn("layers", url_layers(F.col("text")))
    plain = F.when(F.exists("layers", lambda t: t.contains("${")), F.array_except(deobfuscate_all(F.col("layers")), F.col("layers"))).otherwise(F.array().cast("array<string>"))
    texts = layers.withColumn("texts", F.concat("layers", plain))
    return texts.withColumn("views", F.transform("texts", lambda t, i: F.struct(t.alias("text"), (i > 0).alias("decoded")))).drop("layers", "texts")


def classify(units: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """rid, cls, location, evidence, decoded, sig, cve, first: one label per request, class and location, by the fixed rules
    or by those of with_rules()."""
    return (rules or with_rules(attack_rules(units.sparkSession))).classify(with_views(units))


def attacks_of(log: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """rid, attacks (array in the order of discovery) for the requests that carry any."""
    found = classify(attack_units(log), rules)
    nested = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("first", "cls", "location", "evidence", "decoded", "sig", "cve"))).alias("a"))
    return nested.select("rid", F.transform("a", lambda x: x.dropFields("first")).alias("attacks"))


def request_texts(log: DataFrame) -> DataFrame:
    """rid, pos, text: path, query, headers and body of a request."""
    body = match.body_bytes(F.col("body"), F.col("body_encoding"))
    texts = F.concat(F.array(F.coalesce("raw_path", "path"), F.col("raw_query")), F.coalesce(F.transform("headers", lambda h: h[1]), F.array().cast("array<string>")), F.array(latin1(body)))
    return log.select("rid", F.posexplode(texts).alias("pos", "text")).where("text <> ''")


def oast_domains(log: DataFrame) -> DataFrame:
    """rid, oast: callback domains in the fully decoded parts, in order, each once."""
    flat = request_texts(log).withColumn("last", F.element_at(url_layers(F.col("text")), -1)).withColumn("t", deobfuscate_all(F.array("last"))[0])
    found = flat.select("rid", "pos", F.transform(F.regexp_extract_all("t", F.lit(fixed.CALLBACK), F.lit(1)), F.lower).alias("d")).where(F.size("d") > 0)
    merged = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("x"))
    return merged.select("rid", F.array_distinct(F.flatten(F.transform("x", lambda e: e["d"]))).alias("oast"))


def tools_of(log: DataFrame) -> DataFrame:
    body = match.body_bytes(F.col("body"), F.col("body_encoding"))
    found = match.tools(F.coalesce(header(F.col("headers"), "user-agent"), F.lit("")), header(F.col("headers"), "content-type"), latin1(body))
    return log.select("rid", found.alias("tools")).where(F.size("tools") > 0)


def backfill(log: DataFrame, missing: Column) -> DataFrame:
    """Gives the requests for which `missing` holds their attacks, tools and oast; all others are left alone.

    Whether a logged line had the field at all is not visible in the parsed column: see sources.log.lacks().
    """
    fill = F.coalesce((F.col("kind") == "request") & missing, F.lit(False))
    find = lambda old: attacks_of(old).join(tools_of(old), "rid", "full").join(oast_domains(old), "rid", "full").select("rid", F.col("attacks").alias("__a"), F.col("tools").alias("__t"), F.col("oast").alias("__o"))
    both = with_found(log.withColumn("__fill", fill), F.col("__fill"), find)
    pick = lambda name, c: F.when(F.col("__fill"), F.col(c)).otherwise(F.col(name))
    return both.withColumns({"attacks": pick("attacks", "__a"), "tools": pick("tools", "__t"), "oast": pick("oast", "__o")}).drop("__a", "__t", "__o", "__fill")
