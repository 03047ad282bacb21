"""First-match rule tables as generated expressions, and the plain field functions of the log."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def like(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """`.` and `$` know only \\n as a line end."""
    return text.rlike(f"(?{'id' if ignore_case else 'd'}){pattern}")


def first(cases: Iterable[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, else null; later conditions are not evaluated."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def choose(text: Column, table: dict[str, str]) -> Column:
    return first((text == k, F.lit(v)) for k, v in table.items())


def crawler(ua: Column, table: tuple[rules.Crawler, ...] = rules.CRAWLERS) -> Column:
    """struct<name, operator, method> of the declared crawler of a user agent, else null."""
    fields = lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(r.operator).alias("operator"), F.lit(r.method).alias("method"))
    return first((like(ua, r.pattern), fields(r)) for r in table)


def claims_browser(ua: Column) -> Column:
    return F.coalesce(like(ua, rules.BROWSER) & crawler(ua).isNull(), F.lit(False))


def admits_headless(ua: Column) -> Column:
    return F.coalesce(like(ua, rules.HEADLESS), F.lit(False))


def probe(path: Column, families: tuple[str, ...] | None = None) -> Column:
    """struct<family, target, category, intent, mitre, has_decoy> of the first probe that fits; `families` narrows the
    table to those of one persona."""
    table = [p for p in rules.PROBES if families is None or p.family in families]
    if not table:
        return F.lit(None).cast("struct<family string, target string, category string, intent string, mitre array<string>, has_decoy boolean>")

    def fields(p: rules.Probe) -> Column:
        mitre = F.array(*map(F.lit, p.mitre))
        return F.struct(F.lit(p.family).alias("family"), F.lit(p.target).alias("target"), F.lit(p.category).alias("category"), F.lit(p.intent).alias("intent"), mitre.alias("mitre"), F.lit(p.decoy).alias("has_decoy"))

    return first((like(path, p.pattern), fields(p)) for p in table)


def probe_scoped(path: Column, persona: Column) -> Column:
    """The probe that a persona's own families know."""
    return first((persona == name, probe(path, families)) for name, families in rules.PERSONAS.items())


def stage_step(method: Column, path: Column, persona: Column) -> Column:
    """struct<family, step> of a step of a multi-stage interaction with a persona, else null."""
    fields = lambda family, step: F.struct(F.lit(family).alias("family"), F.lit(step).alias("step"))
    return first(((persona == who) & (method == verb) & like(path, pattern, False), fields(who, step)) for who, verb, pattern, step in rules.STAGE_STEPS)


def policy_standard(path: Column) -> Column:
    return choose(path, rules.POLICY_PATHS)


def standard_kind(standard: Column) -> Column:
    return choose(standard, rules.STANDARD_KINDS)


def stable_trap(path: Column) -> Column:
    return choose(path, {rules.STABLE_DISALLOW: "stable_disallow_unlinked", rules.STABLE_ALLOW: "stable_allow_unlinked"})


def trap_token(path: Column) -> Column:
    """The path's first segment of 26 URL-safe characters, else null: a candidate, to be verified."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda s: s.rlike("^[A-Za-z0-9_-]{26}$")), F.lit(1))


def is_judged(resource: Column) -> Column:
    return F.coalesce(resource.isin(*rules.JUDGED) | resource.startswith("trap:"), F.lit(False))


def is_page(status: Column, resource: Column) -> Column:
    return F.coalesce(status.isin(200, 304) & resource.isin(*rules.PAGES), F.lit(False))


def face(host: Column, docs_hosts: list[str]) -> Column:
    """`docs` for a host of the site, else `attack`; a port and the brackets of an IPv6 address don't count."""
    name = F.lower(F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)", 1)).otherwise(F.regexp_extract(host, "^([^:]*)", 1)))
    return F.when(F.coalesce(name.isin(*[h.lower() for h in docs_hosts]), F.lit(False)), "docs").otherwise("attack")


def split_target(raw: Column) -> tuple[Column, Column]:
    """Path and query of a raw target; the query is null without a `?`."""
    at = F.locate("?", raw)
    return F.when(at > 0, F.substring_index(raw, "?", 1)).otherwise(raw), F.when(at > 0, F.substr(raw, at + 1))


def body_bytes(body: Column, encoding: Column) -> Column:
    plain = F.encode(body, "UTF-8")
    return F.when(encoding == "base64", F.coalesce(F.try_to_binary(body, F.lit("base64")), plain)).otherwise(plain)


def display_name(claimed: Column, ua: Column, n: int) -> Column:
    return F.substring(F.coalesce(F.nullif(claimed, F.lit("")), ua), 1, n)


def persona(given: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(given, F.lit("")), probe(path)["family"], F.lit("site"))


def location_kind(location: Column) -> Column:
    return F.substring_index(location, ":", 1)


def tag(web_attack: Column, standard: Column, family: Column, resource: Column, scheme: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (web_attack, standard, family, resource, scheme)))


def tools(ua: Column, content_type: Column, body: Column) -> Column:
    """array<struct<name, kind>> of the tools that a request names."""
    text = F.concat_ws("\n", F.coalesce(content_type, F.lit("")), F.coalesce(body, F.lit("")))
    cases = [(ua, r) for r in rules.UA_TOOLS] + [(text, r) for r in rules.BODY_TOOLS]
    found = F.array(*(F.when(like(c, p), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))) for c, (p, name, kind) in cases))
    return F.filter(found, lambda t: t.isNotNull())
