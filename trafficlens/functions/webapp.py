"""The shape of a request to a web application."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .decode import deobfuscate, url_layers
from .match import first, like


def views(text: Column) -> Column:
    """Every decoded layer of a text, and its last layer with lookups collapsed."""
    layers = url_layers(text)
    return F.when(text.contains("${"), F.array_union(layers, F.array(deobfuscate(F.element_at(layers, -1))))).otherwise(layers)


def names_planted_file(layers: Column) -> Column:
    """Some suffix of the target of a traversal is a file whose decoy plants a credential."""
    targets = F.flatten(F.transform(layers, lambda t: F.regexp_extract_all(t, F.lit(rules.WEB_AFTER_TRAVERSAL), F.lit(1))))
    parts = F.transform(targets, lambda t: F.split(F.translate(t, "\\", "/"), "/"))
    tails = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(p, i, F.size(p)), "/")))))
    # The first probe that fits a suffix decides whether that suffix plants.
    plants = lambda path: F.coalesce(first((like(path, p.pattern), F.lit(p.plants)) for p in rules.PROBES), F.lit(False))
    return F.exists(tails, plants)


def web_shape(method: Column, path: Column, query: Column, content_type: Column, body: Column) -> Column:
    """struct<kind, mitre>: the first shape that fits a request to a PHP site."""
    pq = F.concat(views(F.coalesce(path, F.lit(""))), views(F.coalesce(query, F.lit(""))))
    content = views(F.coalesce(body, F.lit("")))
    any_of = lambda layers, pattern: F.exists(layers, lambda t: like(t, pattern))
    upload = (method == "POST") & F.lower(F.coalesce(content_type, F.lit(""))).contains("multipart/form-data") & like(path, rules.WEB_PHP_PATH)
    cases = (
        ((any_of(pq, rules.WEB_TRAVERSAL) | any_of(pq, rules.WEB_AFTER_TRAVERSAL)) & names_planted_file(pq), "path_traversal", "planted"),
        (any_of(pq, rules.WEB_TRAVERSAL), "path_traversal", "path_traversal"),
        (any_of(pq, rules.WEB_SQLI) | any_of(content, rules.WEB_SQLI), "sqli", "sqli"),
        (any_of(content, rules.WEB_PHP_BODY) | any_of(pq, rules.WEB_PHP_WRAPPER) | any_of(content, rules.WEB_PHP_WRAPPER) | upload, "php_rce_attempt", "php_rce_attempt"),
        (any_of(pq, rules.WEB_PHPINFO), "info_disclosure", "info_disclosure"),
        (any_of(pq, rules.WEB_CMS), "cms_probe", "cms_probe"),
        (F.lit(True), "browse", "browse"),
    )
    mitre = lambda k: F.array(*map(F.lit, rules.WEB_MITRE[k])).cast("array<string>")
    return first((c, F.struct(F.lit(kind).alias("kind"), mitre(m).alias("mitre"))) for c, kind, m in cases)
