"""One row per client: what it read, fetched, ignored, repeated and sent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as fixed
from ..functions import match
from . import robots

KEY = ["client_ua", "client_claimed"]


def with_client(log: DataFrame) -> DataFrame:
    """Adds the key of the client: (user agent or '-', claimed crawler or '-').

    Identity events name the claim `claimed`.  Credential events carry no claim, so they fall on (user agent, '-').
    """
    claim = F.col("claimed_crawler")
    if "claimed" in log.columns:
        claim = F.when(F.col("kind") == "identity", F.col("claimed")).otherwise(claim)
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    return log.withColumns({"client_ua": dash(F.col("ua")), "client_claimed": dash(claim)})


def _sets(value: Column, when: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(when, value)))


def disallowed_fetches(log: DataFrame, rules: DataFrame) -> DataFrame:
    """client, path, defied: fetches of judged resources that the rules forbid to that user agent; defied if one of them
    came after the client first read a robots file, in log order."""
    judged = log.where((F.col("kind") == "request") & (F.col("status") == 200) & match.is_judged(F.col("resource")))
    judged = judged.withColumn("agent", F.coalesce("ua", F.lit(""))).select(*KEY, "agent", "path", "seq")
    verdicts = robots.disallowed(judged.select(F.col("agent").alias("ua"), "path"), rules).where("disallowed")
    broken = judged.join(verdicts.select(F.col("ua").alias("agent"), "path"), ["agent", "path"])
    # The set of files read only grows, so the first read decides for every later fetch.
    reads = log.where(F.col("kind").isin("policy_read", "trap_hit") & F.col("standard").isin(*fixed.ROBOTS_STANDARDS))
    first = reads.groupBy(*KEY).agg(F.min("seq").alias("first_read"))
    return broken.join(first, KEY, "left").groupBy(*KEY, "path").agg(F.coalesce(F.bool_or(F.col("seq") > F.col("first_read")), F.lit(False)).alias("defied"))


def refetches(log: DataFrame) -> DataFrame:
    """client, path: repeats, wasteful repeats, conditional requests.  The first fetch is no repeat."""
    pages = log.where((F.col("kind") == "request") & match.is_page(F.col("status"), F.col("resource")))
    plain = ~F.coalesce("conditional", F.lit(False))
    by_path = pages.groupBy(*KEY, "path").agg(F.count("*").alias("n"), F.count_if(plain).alias("plain"), F.min_by(plain, "seq").alias("first_plain"), F.count_if(~plain).alias("conditional"))
    return by_path.select(*KEY, "path", (F.col("n") - 1).alias("repeat"), (F.col("plain") - F.col("first_plain").cast("int")).alias("wasteful"), "conditional")


def duplicates(log: DataFrame) -> DataFrame:
    """client: fetches whose content hash the client had seen before, whatever their status."""
    hashed = log.where((F.col("kind") == "request") & (F.coalesce("content_hash", F.lit("")) != ""))
    by_hash = hashed.groupBy(*KEY, "content_hash").agg((F.count("*") - 1).alias("n"))
    return by_hash.groupBy(*KEY).agg(F.sum("n").alias("duplicate_content_fetches"))


def state(p: str = "") -> Column:
    some = lambda c: F.size(f"{p}{c}") > 0
    return F.when(some("standards_mined"), "miner").when(some("defied"), "defiant").when(some("disallowed_fetched"), "ignorant").when(some("standards_read"), "compliant").otherwise("indeterminate")


def profiles(log: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per client.  The log needs seq, kind, ua, claimed_crawler and the fields of its kinds; what a log lacks
    counts as null.  Sets come sorted; hot clients combine before each shuffle, and the lists per path, address and hash
    (`disallowed_fetches`, `refetches`, ...) exist as long tables too."""
    log = with_client(log)
    for name, kind in (("conditional", "boolean"), ("content_hash", "string")):
        if name not in log.columns:
            log = log.withColumn(name, F.lit(None).cast(kind))
    has = set(log.columns)
    col = lambda name, kind="string": F.col(name) if name in has else F.lit(None).cast(kind)
    kind = F.col("kind")
    request, trap, hunt = kind == "request", kind == "trap_hit", kind == "hunt"
    what = match.standard_kind(col("standard"))
    read = (kind == "policy_read") | trap & what.isin("prohibition", "invitation")
    flag = lambda standard: F.coalesce(F.bool_or(trap & (col("standard") == standard)), F.lit(False))
    base = log.groupBy(*KEY).agg(
        F.count_if(request).alias("requests"),
        F.coalesce(F.sum(F.when(request, col("bytes", "bigint"))), F.lit(0)).alias("bytes_served"),
        _sets(F.coalesce(col("ip"), F.lit("-")), kind.isin("request", "policy_read", "trap_hit", "hunt")).alias("addresses"),
        _sets(col("standard"), read).alias("standards_read"),
        _sets(col("standard"), trap & (what == "prohibition")).alias("standards_mined"),
        *(flag(s).alias(name) for s, name in fixed.CAPABILITIES.items()),
        flag("control_allow").alias("respects_specificity"),
        F.count_if(trap & col("split_fleet", "boolean")).alias("split_fleet_hits"),
        F.coalesce(F.max(F.when(trap, col("delay_seconds", "double"))), F.lit(0.0)).alias("max_read_to_fetch_delay"),
        F.min_by(F.nullif(col("operator"), F.lit("")), F.when(kind.isin("request", "identity") & (F.coalesce(col("operator"), F.lit("")) != ""), F.col("seq"))).alias("operator"),
        F.max_by(F.struct(col("verdict").alias("verdict"), col("detail").alias("detail")), F.when(kind == "identity", F.col("seq"))).alias("identity"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(request, col("signals", "array<string>")))))).alias("signals"),
        _sets(F.nullif(col("ja4"), F.lit("")), kind.isin("request", "hunt")).alias("ja4"),
        F.count_if(hunt).alias("hunt_probes"),
        _sets(F.coalesce(col("family"), F.lit("?")), hunt).alias("hunt_families"),
        _sets(F.coalesce(col("category"), F.lit("?")), hunt).alias("hunt_categories"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hunt, col("mitre", "array<string>")))))).alias("mitre"),
        F.count_if(kind == "credential").alias("credential_attempts"),
    )
    broken = disallowed_fetches(log, rules).groupBy(*KEY).agg(F.array_sort(F.collect_set("path")).alias("disallowed_fetched"), _sets(F.col("path"), F.col("defied")).alias("defied"))
    again = refetches(log).groupBy(*KEY).agg(F.sum("repeat").alias("repeat_fetches"), F.sum("wasteful").alias("wasteful_refetches"), F.sum("conditional").alias("conditional_requests"))
    out = reduce(lambda a, b: a.join(b, KEY, "left"), (broken, again, duplicates(log)), base)
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("repeat_fetches", "wasteful_refetches", "conditional_requests", "duplicate_content_fetches")}
    empty = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("disallowed_fetched", "defied")}
    out = out.withColumns(zero | empty)
    ratio = F.when(F.col("repeat_fetches") > 0, F.col("wasteful_refetches") / F.col("repeat_fetches")).otherwise(F.lit(0.0))
    return out.withColumns({"state": state(), "waste_ratio": ratio, "fleet_size": F.size("addresses"), "is_hunter": F.col("hunt_probes") > 0, "identity_verdict": F.col("identity.verdict"), "identity_detail": F.col("identity.detail")}).drop("identity")


def payloads(log: DataFrame) -> DataFrame:
    """One row per client of what its requests carried: indicators, exploits, attack classes, locations, tools.

    Counts per class are of requests, counts per location of labels.  Of a tool's kinds the last in log order counts.
    """
    requests = with_client(log).where("kind = 'request'")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    flags = F.filter(F.array(F.when(truthy("indicators.jndi"), "log4shell"), F.when(F.col("indicators.shellshock"), "shellshock"), F.when(F.col("indicators.metadata_ssrf"), "metadata_ssrf")), lambda e: e.isNotNull())
    base = requests.groupBy(*KEY).agg(
        every("indicators.pools").alias("pools"),
        every("indicators.urls").alias("payload_urls"),
        every("indicators.miners").alias("miners"),
        every(flags).alias("exploits"),
        F.count_if(F.exists("attacks", lambda a: a["decoded"])).alias("attacks_decoded"),
        every(F.filter(F.transform("attacks", lambda a: a["cve"]), lambda c: c.isNotNull())).alias("cves"),
        every("oast").alias("oast"),
    )
    wallets = requests.select(*KEY, F.explode("indicators.wallets").alias("chain", "found")).groupBy(*KEY, "chain").agg(every("found").alias("found"))
    wallets = wallets.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chain", "found")))).alias("wallets"))
    classes = requests.select(*KEY, F.explode(F.array_distinct(F.transform("attacks", lambda a: a["cls"]))).alias("k"))
    places = requests.select(*KEY, F.explode("attacks").alias("a")).select(*KEY, match.location_kind(F.col("a.location")).alias("k"))
    tools = requests.select(*KEY, "seq", F.explode("tools").alias("t")).groupBy(*KEY, F.col("t.name").alias("k")).agg(F.max_by("t.kind", "seq").alias("n"))
    as_map = lambda df, name: df.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    counted = lambda df: df.groupBy(*KEY, "k").agg(F.count("*").alias("n"))
    parts = (wallets, as_map(counted(classes), "attack_classes"), as_map(counted(places), "attack_locations"), as_map(tools, "tools"))
    return reduce(lambda a, b: a.join(b, KEY, "left"), parts, base)


def truthy(name: str) -> Column:
    """Whether a field that older logs hold as true and newer ones as a list says anything."""
    text = F.to_json(name)
    return F.coalesce(~text.isin("false", "[]", "null", "0", '""', "{}"), F.lit(False))


def standard_matrix(profiles: DataFrame) -> DataFrame:
    """client name, standard, profiles: how many clients of a name read a standard that forbids or invites."""
    name = F.coalesce(F.nullif("client_claimed", F.lit("-")), F.substring("client_ua", 1, 40))
    read = profiles.select(name.alias("client"), F.explode("standards_read").alias("standard"))
    return read.where(match.standard_kind(F.col("standard")).isin("prohibition", "invitation")).groupBy("client", "standard").agg(F.count("*").alias("profiles"))


def profiles_json(profiles: DataFrame) -> DataFrame:
    """One JSON document per profile; ratios rounded to three places, delays to one."""
    rounded = profiles.withColumns({"waste_ratio": F.round("waste_ratio", 3), "max_read_to_fetch_delay": F.round("max_read_to_fetch_delay", 1)})
    return rounded.select(*KEY, F.to_json(F.struct(*rounded.columns), {"ignoreNullFields": "false"}).alias("json"))
