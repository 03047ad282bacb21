"""Percent decoding and Log4j lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, LOOKUP_ROUNDS = 3, 10


def unquote(text: Column) -> Column:
    """Percent-decodes once: `+` stays, a malformed `%` stays."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def url_layers(text: Column) -> Column:
    """The text and its successive decodings, up to three, as long as they change something."""
    one = unquote(text)
    two = unquote(one)
    three = unquote(two)
    plain = F.array(text)
    return F.when(text.isNull(), F.array().cast("array<string>")).when(~text.contains("%"), plain).otherwise(F.array_distinct(F.array(text, one, two, three)))


#: An innermost lookup, of any kind.
LOOKUP = r"\$\{[^{}$]*\}"


def _resolved(lookup: Column) -> Column:
    """What an innermost lookup stands for, if that is a literal: `lower:` and `upper:` change case, a quoted date format
    is itself, and `:-` begins a default.  Any other lookup stays."""
    inner = lambda first, last: F.substr(lookup, F.lit(first), F.length(lookup) - F.lit(first + last - 1))
    low, at = F.lower(lookup), F.instr(lookup, ":-")
    return (
        F.when(low.startswith("${lower:"), F.lower(inner(9, 1)))
        .when(low.startswith("${upper:"), F.upper(inner(9, 1)))
        .when(low.rlike(r"(?s)^\$\{date:'[^']*'\}$"), inner(9, 2))
        .when(at > 0, F.substr(lookup, at + 2, F.length(lookup) - at - 2))
        .otherwise(lookup)
    )


def _one_round(text: Column) -> Column:
    """All innermost lookups of the text resolved: what lies between them, and they, put together again."""
    between, lookups = F.split(text, LOOKUP, -1), F.regexp_extract_all(text, F.lit(LOOKUP), F.lit(0))
    pairs = F.arrays_zip(between.alias("gap"), F.transform(lookups, _resolved).alias("value"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], F.coalesce(p["value"], F.lit("")))), "")


def deobfuscate(text: Column) -> Column:
    """Resolves literal lookups from the inside out, up to LOOKUP_ROUNDS deep."""
    deep = F.aggregate(F.sequence(F.lit(1), F.lit(LOOKUP_ROUNDS)), text, lambda t, _: F.when(t.contains("${"), _one_round(t)).otherwise(t))
    return F.when(text.contains("${"), deep).otherwise(text)


def deobfuscate_all(texts: Column) -> Column:
    """Each text of an array with its lookups resolved."""
    return F.transform(texts, deobfuscate)


def valid_text(data: Column) -> Column:
    """Bytes as UTF-8 text; what is not valid becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def latin1(data: Column) -> Column:
    """Bytes as text of one character each, so that no byte is lost."""
    return F.decode(data, "ISO-8859-1")
