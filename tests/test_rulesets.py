"""Rules as tables, and the automaton that picks which patterns run."""

import random
import re

import pytest

from trafficlens import rules as fixed
from trafficlens.functions.matcher import FLAGS, Matcher, needed_literals
from trafficlens.operators import attacks, rulesets

OWN = [r"union\s+select", r"(?:cat|ls)\s+/etc", r"a{2,}b", r"x*y?", r"[<>]script", r"(?:foo|b.r)baz", r"(ab)\1", r"^/api/(?:v1|v2)/?$", r"É+t", r"(?!no)yes", r"\d+", r"[A-Z]{3}k", "İstanbul", "straße"]


def test_needed_literals():
    assert needed_literals(r"union\s+select") == {"select"}
    assert needed_literals(r"(?:cat|ls)\s+/etc") == {"/etc"}
    assert needed_literals(r"^/api/(?:tags|version)$") == {"/api/"}
    assert needed_literals(r"(?:GPT|Claude)Bot") in ({"gpt", "claude"}, {"bot"})
    assert needed_literals(r"x*y?") is None and needed_literals(r"\d+|abc") is None and needed_literals(r"(?:abc)?") is None
    assert sum(needed_literals(r.pattern) is None for r in fixed.ATTACKS) == 1  # the rule of one parameter, whatever its value


def test_gate_loses_nothing():
    patterns = tuple([r.pattern for r in fixed.ATTACKS] + [r.pattern for r in fixed.PROBES] + [r.pattern for r in fixed.CRAWLERS] + OWN)
    m = Matcher(patterns)
    rng = random.Random(7)
    parts = [x for p in patterns for x in (needed_literals(p) or ())] + list(" \n;|&(){}<>=/.'\"") + ["union all select", "İSTANBUL", "STRASSE", "straße", "ÉÉT", "kK", "K", "ſ", "1=1", "${jndi:", "../../", "\xac\xed\x00\x05", "AAAb", "abab"]
    found = 0
    for _ in range(4000):
        text = "".join(rng.choice((str, str.upper, str.title))(rng.choice(parts)) for _ in range(rng.randrange(1, 7)))
        want = [i for i, p in enumerate(patterns) if re.search(p, text, FLAGS)]
        assert m.all(text) == want and m.first(text) == (want[0] if want else None), text
        found += len(want)
    assert found > 4000 and m.all("") == [i for i, p in enumerate(patterns) if re.search(p, "", FLAGS)]
    assert Matcher(()).all("x") == [] and Matcher(("a*",)).first("") == 0


def test_first_and_all(spark):
    table = spark.createDataFrame([(5, "late", "b", "z"), (1, "early", "a+", "y"), (1, "also", "a", None), (7, "number", r"\d", "x")], "rank int, name string, pattern string, kind string")
    texts = spark.createDataFrame([("xAAb", 1), ("b", 2), ("9b", 3), ("none? no: c", 4), (None, 5), ("", 6), ("xAAb", 7)], "t string, rule int")
    rules = rulesets.with_rules(table)
    got = {r.rule: r for r in rules.all(rules.first(texts, "t", "hit"), "t").collect()}
    assert {k: r.hit and r.hit.name for k, r in got.items()} == {1: "also", 2: "late", 3: "late", 4: None, 5: None, 6: None, 7: "also"}
    assert {k: r.rules for k, r in got.items()} == {1: [0, 1, 2], 2: [2], 3: [2, 3], 4: [], 5: None, 6: [], 7: [0, 1, 2]}
    assert rules.first(texts.limit(0), "t").collect() == [] and rulesets.with_rules(table.limit(0)).first(texts, "t").where("rule is not null").collect() == []
    with pytest.raises(ValueError, match="rule bad"):
        rulesets.with_rules(spark.createDataFrame([(0, "bad", "(")], "rank int, name string, pattern string"))
    with pytest.raises(ValueError, match="without a pattern"):
        rulesets.with_rules(spark.createDataFrame([(0, "none", None)], "rank int, name string, pattern string"))


def test_tables_are_the_fixed_rules(spark):
    """Every table gives what the fixed expressions give."""
    from pyspark.sql import functions as F

    from trafficlens.functions import match

    agents = spark.createDataFrame([(f"Mozilla/5.0 (compatible; {r.name}/1.0)",) for r in fixed.CRAWLERS] + [("curl/8",), ("Mozilla/5.0",), ("",)], "ua string")
    both = rulesets.with_rules(rulesets.crawler_rules(spark)).first(agents, "ua").select(F.col("rule.name").eqNullSafe(match.crawler(F.col("ua"))["name"]).alias("same"))
    assert {r.same for r in both.collect()} == {True}
    paths = spark.createDataFrame([(x,) for p in fixed.PROBES for x in (needed_literals(p.pattern) or ())] + [("/api/tags",), ("/v1/models",), ("/",)], "path string")
    fields = ("family", "target", "category", "intent", "mitre", "has_decoy")
    both = rulesets.with_rules(rulesets.probe_rules(spark)).first(paths, "path").select(F.struct(*(F.col(f"rule.{f}") for f in fields)).alias("a"), match.probe(F.col("path")).alias("b"))
    assert all((r.b is None and r.a.family is None) or r.a == r.b for r in both.collect())


def test_own_attack_rules(spark):
    """Own rules stand beside the fixed ones; kinds, parameters, hints and ranks hold for them."""
    units = spark.createDataFrame([
        ("r1", "query", (1, 0), "query:q", "q", "say%20xyzzy"), ("r2", "body", (2, 0), "body", None, "say xyzzy"), ("r3", "query", (1, 0), "query:Q", "Q", "plugh"), ("r4", "query", (1, 0), "query:z", "z", "plugh"),
        ("r5", "query", (1, 0), "query:id", "id", "1 union select 2"), ("r6", "query", (1, 0), "query:page", "page", "http://x.test/"), ("r7", "query", (1, 0), "query:q", "q", None), ("r8", "query", (1, 0), "query:p", "p", "%78yzzy http://y"),
    ], "rid string, kind string, idx struct<g int, i int>, location string, param string, text string")
    own = spark.createDataFrame([
        (-1, "word", "xyzzy", "magic", "query", False, None, None, None, None), (100, "decoded-word", "xyzzy", "magic", "query", False, None, "%78", "sig", "CVE-0"),
        (101, "param", "plugh", "magic", "query body", None, "Q", None, None, None), (102, "include", "^http", "own_rfi", "query", True, None, None, None, None),
    ], rulesets.ATTACKS)
    rules = rulesets.with_rules(rulesets.attack_rules(spark).unionByName(own))
    got = {(r.rid, r.cls): r for r in attacks.classify(units, rules).collect()}
    assert set(got) == {("r1", "magic"), ("r3", "magic"), ("r5", "sqli"), ("r6", "rfi"), ("r6", "own_rfi"), ("r8", "magic")}
    assert not got["r1", "magic"].decoded and got["r1", "magic"].evidence == "say%20xyzzy" and got["r1", "magic"].cve is None
    assert (got["r8", "magic"].cve, got["r8", "magic"].sig) == ("CVE-0", "sig")  # a rule that names one counts before others
    assert attacks.classify(units.limit(0), rules).collect() == []
