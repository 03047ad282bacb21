"""The report: each section a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import rules as fixed
from ..functions import match
from ..operators.profiles import KEY, standard_matrix


def name_of(n: int) -> Column:
    return match.display_name(F.nullif(F.col("client_claimed"), F.lit("-")), F.col("client_ua"), n)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def totals(log: DataFrame, profiles: DataFrame) -> DataFrame:
    events = log.agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "policy_read").alias("policy_reads"), F.count_if(F.col("kind") == "trap_hit").alias("trap_hits"))
    return events.crossJoin(profiles.agg(F.count("*").alias("clients")))


def kinds(log: DataFrame) -> DataFrame:
    return log.groupBy("kind").agg(F.count("*").alias("events"))


def compliance(profiles: DataFrame) -> DataFrame:
    """place, state, clients, share: all states in their fixed order."""
    states = profiles.sparkSession.createDataFrame(list(enumerate(fixed.STATES)), "place int, state string")
    counted = states.join(profiles.groupBy("state").agg(F.count("*").alias("n")), "state", "left")
    n = F.coalesce("n", F.lit(0))
    return counted.select("place", "state", n.alias("clients"), (n / F.greatest(F.sum(n).over(W.partitionBy()), F.lit(1))).alias("share"))


def standards(profiles: DataFrame) -> DataFrame:
    """client, one column per standard (0 if never read), total; most read first."""
    names = [s for s, kind in fixed.STANDARD_KINDS.items() if kind in ("prohibition", "invitation")]
    wide = standard_matrix(profiles).groupBy("client").pivot("standard", names).agg(F.sum("profiles")).fillna(0)
    return wide.withColumn("total", sum((F.col(n) for n in names), F.lit(0))).orderBy(F.col("total").desc(), "client")


def identity(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy(F.coalesce("identity_verdict", F.lit("unchecked")).alias("verdict")).agg(F.count("*").alias("clients"))


def impersonators(profiles: DataFrame) -> DataFrame:
    return profiles.where("identity_verdict = 'impersonating'").select("client_claimed", F.slice("addresses", 1, 3).alias("addresses"), "identity_detail")


def split_fleets(profiles: DataFrame) -> DataFrame:
    found = profiles.where("split_fleet_hits > 0").select(name_of(44).alias("client"), "split_fleet_hits", "fleet_size")
    return found.orderBy(F.col("split_fleet_hits").desc(), "client")


def waste(profiles: DataFrame) -> DataFrame:
    found = profiles.where("repeat_fetches > 0").select(name_of(40).alias("client"), "repeat_fetches", "wasteful_refetches", "waste_ratio", "duplicate_content_fetches")
    return top(found, 15, F.col("wasteful_refetches").desc(), F.col("client"))


def capability(profiles: DataFrame) -> DataFrame:
    found = profiles.select(name_of(40).alias("client"), "requests", *fixed.CAPABILITIES.values())
    return top(found, 20, F.col("requests").desc(), F.col("client"))


def hunt_totals(profiles: DataFrame) -> DataFrame:
    return profiles.where("is_hunter").agg(F.count("*").alias("hunters"), F.coalesce(F.sum("hunt_probes"), F.lit(0)).alias("probes"))


def hunt_categories(profiles: DataFrame) -> DataFrame:
    return profiles.select(F.explode("hunt_categories").alias("category")).groupBy("category").agg(F.count("*").alias("clients"))


def hunt_families(log: DataFrame) -> DataFrame:
    return top(log.where("kind = 'hunt'").groupBy("family").agg(F.count("*").alias("probes")), 10, F.col("probes").desc(), F.col("family"))


def hunters(profiles: DataFrame) -> DataFrame:
    found = profiles.where("is_hunter").select(name_of(32).alias("client"), "hunt_probes", F.array_join("hunt_categories", ",").alias("categories"))
    return top(found, 12, F.col("hunt_probes").desc(), F.col("client"))


def indicators(payloads: DataFrame) -> DataFrame:
    """client, type, value; five payload URLs a client."""
    long = lambda c, kind: payloads.select(*KEY, F.lit(kind).alias("type"), F.explode(c).alias("value"))
    wallets = payloads.select(*KEY, F.explode("wallets").alias("chain", "found")).select(*KEY, F.concat_ws(":", F.lit("wallet"), "chain").alias("type"), F.explode("found").alias("value"))
    urls = payloads.select(*KEY, F.lit("url").alias("type"), F.explode(F.slice("payload_urls", 1, 5)).alias("value"))
    return wallets.unionByName(long("pools", "pool")).unionByName(long("miners", "miner")).unionByName(urls)


def credential_totals(log: DataFrame) -> DataFrame:
    return log.where("kind = 'credential'").agg(F.count("*").alias("attempts"), F.countDistinct("ip").alias("addresses"))


def credential_personas(log: DataFrame) -> DataFrame:
    found = log.where("kind = 'credential'").groupBy(F.coalesce("persona", F.lit("-")).alias("persona")).agg(F.count("*").alias("attempts"))
    return top(found, 8, F.col("attempts").desc(), F.col("persona"))


def credential_top(log: DataFrame) -> DataFrame:
    found = log.where("kind = 'credential'").groupBy("scheme", "user", "password").agg(F.count("*").alias("attempts"))
    return top(found, 10, F.col("attempts").desc(), *map(F.col, ("scheme", "user", "password")))


def exploits(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.explode("exploits").alias("exploit")).groupBy("exploit").agg(F.count("*").alias("clients"))


def attack_totals(log: DataFrame) -> DataFrame:
    hit = log.where((F.col("kind") == "request") & (F.size("attacks") > 0))
    return hit.agg(F.count("*").alias("requests"), F.countDistinct("ip").alias("addresses"), F.count_if(F.exists("attacks", lambda a: a["decoded"])).alias("decoded"))


def attack_classes(payloads: DataFrame) -> DataFrame:
    each = payloads.select(F.explode("attack_classes").alias("cls", "n"))
    return each.groupBy("cls").agg(F.sum("n").alias("requests"), F.count("*").alias("clients"))


def attack_locations(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.explode("attack_locations").alias("location", "n")).groupBy("location").agg(F.sum("n").alias("labels"))


def cves(payloads: DataFrame) -> DataFrame:
    return top(payloads.select(F.explode("cves").alias("cve")).groupBy("cve").agg(F.count("*").alias("clients")), 12, F.col("clients").desc(), F.col("cve"))


def tools(payloads: DataFrame) -> DataFrame:
    found = payloads.select(F.explode("tools").alias("name", "kind")).groupBy("kind", "name").agg(F.count("*").alias("clients"))
    return found.orderBy("kind", F.col("clients").desc(), "name")


def callbacks(payloads: DataFrame) -> DataFrame:
    return top(payloads.select(F.explode("oast").alias("domain")).distinct(), 12, F.col("domain"))


def ja4(profiles: DataFrame) -> DataFrame:
    """fingerprint, clients, claimants (six at most, only if several), shared: one TLS stack under several names."""
    each = profiles.select(F.explode("ja4").alias("fingerprint"), name_of(30).alias("name"))
    found = each.groupBy("fingerprint").agg(F.count("*").alias("clients"), F.array_sort(F.collect_set("name")).alias("names"))
    shared = F.size("names") > 1
    found = found.select("fingerprint", "clients", shared.alias("shared"), F.when(shared, F.slice("names", 1, 6)).otherwise(F.array().cast("array<string>")).alias("claimants"))
    return top(found, 12, F.col("clients").desc(), F.col("fingerprint"))


def top_clients(profiles: DataFrame) -> DataFrame:
    found = profiles.select(name_of(36).alias("client"), "requests", "state", "fleet_size", "is_hunter")
    return top(found, 15, F.col("requests").desc(), F.col("client"))
