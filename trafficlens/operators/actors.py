"""Actor records, their indicators in canonical form, and entities that share strong ones."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as fixed
from ..shared import components

CHAINS = ("monero", "bitcoin", "ethereum")
LABEL = r"(?!-)[a-z0-9-]{1,63}(?<!-)"


@F.pandas_udf(T.StringType())
def _address(texts: pd.Series) -> pd.Series:
    def canonical(text: str) -> str | None:
        try:
            ip = ipaddress.ip_address(text.strip().strip("[]"))
        except ValueError:
            return None
        return str(getattr(ip, "ipv4_mapped", None) or ip)

    return texts.map(canonical, na_action="ignore")


@F.pandas_udf(T.StringType())
def _idna(texts: pd.Series) -> pd.Series:
    def ascii_of(text: str) -> str | None:
        try:
            return text.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return texts.map(ascii_of, na_action="ignore")


def address(raw: Column) -> Column:
    return _address(raw)


def domain(raw: Column) -> Column:
    """Lower case, no final dots, at least two valid labels; only names outside ASCII go through Python."""
    low = F.lower(F.rtrim(F.trim(raw), F.lit(".")))
    plain = F.when(low.rlike(r"^\p{ASCII}*$"), low).otherwise(_idna(F.when(~low.rlike(r"^\p{ASCII}*$"), low)))
    return F.when(plain.rlike(rf"^{LABEL}(?:\.{LABEL})+$"), plain)


def url(raw: Column) -> Column:
    """http or https; canonical host, no default port, no fragment; path and query as they are."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)"
    text = F.trim(raw)
    scheme, host, port, rest = F.lower(F.regexp_extract(text, parts, 1)), F.regexp_extract(text, parts, 2), F.regexp_extract(text, parts, 3), F.regexp_extract(text, parts, 4)
    good = F.coalesce(address(F.nullif(host, F.lit(""))), domain(F.nullif(host, F.lit(""))))
    good = F.when(good.contains(":"), F.concat(F.lit("["), good, F.lit("]"))).otherwise(good)
    default = F.when(scheme == "http", "80").otherwise("443")
    shown = F.when((port == "") | (port == default), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    valid_port = (port == "") | (F.try_to_number(F.nullif(port, F.lit("")), F.lit("99999")) <= 65535)
    return F.when(scheme.isin("http", "https") & valid_port & rest.rlike("^(?:[/?]|$)"), F.concat(scheme, F.lit("://"), good, shown, rest))


def wallet(raw: Column) -> Column:
    chain, found = F.lower(F.substring_index(raw, ":", 1)), F.substr(raw, F.locate(":", raw) + 1)
    fold = (chain == "ethereum") | F.lower(found).startswith("bc1")
    return F.when(raw.contains(":") & chain.isin(*CHAINS) & (found != ""), F.concat(chain, F.lit(":"), F.when(fold, F.lower(found)).otherwise(found)))


def normalize(kind: Column, raw: Column) -> Column:
    """The canonical text of an indicator, or null if it is none.  A credential's raw is a compact JSON pair."""
    low = F.nullif(F.lower(F.trim(raw)), F.lit(""))
    of = lambda *kinds: kind.isin(*kinds)
    only = lambda f, *kinds: f(F.when(of(*kinds), raw))
    return (
        F.when(of("ip", "infra_ip"), only(address, "ip", "infra_ip"))
        .when(of("domain"), only(domain, "domain"))
        .when(of("url"), only(url, "url"))
        .when(of("wallet"), wallet(raw))
        .when(of("pool", "miner", "tool"), low)
        .when(of("sha256"), F.when(low.rlike("^[0-9a-f]{64}$"), low))
        .when(of("cve"), F.when(F.upper(F.trim(raw)).rlike(r"^CVE-\d{4}-\d{4,}$"), F.upper(F.trim(raw))))
        .when(of("honeytoken"), F.nullif(F.trim(raw), F.lit("")))
        .when(of("credential"), raw)
    )


def indicators(sessions: DataFrame, pairs: DataFrame) -> DataFrame:
    """actor, type, value, strength, each once.  `pairs`: sessions.credential_pairs().  The host of a payload URL is
    infrastructure: infra_ip or domain."""
    of = lambda kind, c: sessions.select("actor", F.lit(kind).alias("type"), F.explode(c).alias("raw"))
    urls = of("url", "payload_urls")
    host = F.regexp_extract("raw", r"://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    hosts = urls.select("actor", F.when(address(host).isNotNull(), "infra_ip").otherwise("domain").alias("type"), host.alias("raw"))
    coins = sessions.select("actor", F.explode("wallets").alias("chain", "found")).select("actor", F.lit("wallet").alias("type"), F.explode("found").alias("a"), "chain").select("actor", "type", F.concat_ws(":", "chain", "a").alias("raw"))
    tried = pairs.select("actor", F.lit("credential").alias("type"), F.to_json(F.array("user", "password")).alias("raw"))
    every = urls
    for part in (hosts, coins, tried, of("ip", "ips"), of("domain", "oast"), of("pool", "pools"), of("sha256", "attack_body_hashes"), of("honeytoken", "honeytoken_tokens"), of("miner", "miners"), of("cve", "cves"), of("tool", "tools")):
        every = every.unionByName(part)
    each = every.distinct()
    values = each.select("type", "raw").distinct().withColumn("value", normalize(F.col("type"), F.col("raw")))
    strength = F.coalesce(*(F.when(F.col("type") == k, F.lit(v)) for k, v in fixed.STRENGTHS.items()))
    return each.join(values.where("value is not null").hint("merge"), ["type", "raw"]).select("actor", "type", "value", strength.alias("strength")).distinct()


def actor_records(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """One row per actor with the fixed keys of a record; `found`: indicators()."""
    nested = found.groupBy("actor").agg(F.array_sort(F.collect_list(F.struct("type", "value", "strength"))).alias("indicators"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    prints = lambda kind, c: F.transform(c, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    detail = F.struct(F.col("stage_reached").alias("stage"), "faces", F.slice("user_agents", 1, 10).alias("user_agents"), "families", "attack_classes", "honeytokens_issued", "honeytokens_used", "credential_attempts", F.col("request_count").alias("requests"))
    return sessions.join(nested.hint("merge"), "actor", "left").select(
        F.lit("actor/1").alias("schema"),
        F.struct(F.lit("http").alias("type"), F.coalesce(F.array_min("sensors"), F.lit("unknown")).alias("id")).alias("sensor"),
        "actor",
        "actor_basis",
        stamp("first_seen").alias("first_seen"),
        stamp("last_seen").alias("last_seen"),
        F.col("event_count").alias("events"),
        F.col("has_payload").alias("reached_payload"),
        F.array_sort(F.concat(prints("ja4", "ja4s"), prints("header_order", "header_orders"))).alias("fingerprints"),
        F.coalesce("indicators", F.array().cast("array<struct<type string, value string, strength string>>")).alias("indicators"),
        "mitre",
        detail.alias("detail"),
    )


def join_keys(found: DataFrame) -> DataFrame:
    return found.where("strength = 'strong'").select("actor", "type", "value").distinct()


def actor_links(found: DataFrame, deny: DataFrame | None = None) -> DataFrame:
    """a, b: each actor beside the smallest actor of every strong key that it shares: a star per key, as a key may have
    thousands of actors.  `deny` (type, value) leaves keys out."""
    keys = join_keys(found)
    if deny is not None:
        keys = keys.join(deny, ["type", "value"], "left_anti")
    first = keys.groupBy("type", "value").agg(F.min("actor").alias("a"))
    return keys.join(first, ["type", "value"]).where("actor <> a").select("a", F.col("actor").alias("b")).distinct()


def entities(found: DataFrame, deny: DataFrame | None = None) -> DataFrame:
    """actor, entity: the smallest actor that is reached over shared strong keys; an actor without any is its own."""
    roots = components(actor_links(found, deny)).select(F.col("node").alias("actor"), "root")
    return found.select("actor").distinct().join(roots, "actor", "left").select("actor", F.coalesce("root", "actor").alias("entity"))
