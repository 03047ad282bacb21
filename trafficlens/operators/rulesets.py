"""Rules as data: a table of rules in place of the fixed ones, for crawlers, probes, tools and attacks.

    rules = rulesets.attack_rules(spark).unionByName(own_rules)
    attacks.classify(attacks.attack_units(log), rulesets.with_rules(rules))

A table of rules is read once by the driver (its size is checked), compiled there so that a faulty pattern is told with its
name, and sent to the tasks.  Texts meet the rules in Arrow batches: see functions.matcher for which patterns are run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules as fixed
from ..functions.matcher import matcher

#: Rules of one table at most: they are configuration, and travel to every task.
MOST_RULES = 50_000
NAMED = "rank int, name string, pattern string"
ATTACKS = NAMED + ", cls string, where string, include_only boolean, param string, hint string, sig string, cve string"


def crawler_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, r.name, r.pattern, r.operator, r.method) for i, r in enumerate(fixed.CRAWLERS)]
    return spark.createDataFrame(rows, NAMED + ", operator string, method string")


def probe_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, r.target, r.pattern, r.family, r.target, r.category, r.intent, list(r.mitre), r.decoy) for i, r in enumerate(fixed.PROBES)]
    return spark.createDataFrame(rows, NAMED + ", family string, target string, category string, intent string, mitre array<string>, has_decoy boolean")


def tool_rules(spark: SparkSession) -> DataFrame:
    """Tools that a user agent names."""
    return spark.createDataFrame([(i, name, p, kind) for i, (p, name, kind) in enumerate(fixed.UA_TOOLS)], NAMED + ", kind string")


def attack_rows(table: tuple[fixed.AttackRule, ...]) -> list[tuple]:
    return [(i, r.name, r.pattern, r.cls, r.where, r.include_only, r.param, r.hint, r.sig, r.cve) for i, r in enumerate(table)]


def attack_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(attack_rows(fixed.ATTACKS), ATTACKS)


@dataclass(frozen=True)
class Attack:
    """What a task needs of a rule besides its pattern."""

    kinds: frozenset[str]
    include_only: bool
    param: str | None
    hint: int | None
    plain: bool


def _evidence(text: str, start: int, end: int) -> str:
    """The match with 20 characters on either side."""
    a = max(start - 20, 0)
    return text[a : min(end + 20, a + fixed.EVIDENCE)]


class RuleSet:
    """A compiled table of rules.  Ranks order them: the lowest is tried first, and names break ties."""

    def __init__(self, rules: DataFrame):
        rows = rules.select("*").limit(MOST_RULES + 1).collect()
        if len(rows) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        if faulty := [r for r in rows if r.pattern is None or r.rank is None]:
            raise ValueError(f"rules without a pattern or rank: {[r.name for r in faulty][:5]}")
        self.rows = sorted(rows, key=lambda r: (r.rank, r.name or "", r.pattern))
        self.patterns = tuple(r.pattern for r in self.rows)
        for r in self.rows:
            try:
                matcher((r.pattern,))
            except Exception as e:
                raise ValueError(f"rule {r.name}: {e}") from e
        spark = rules.sparkSession
        kept = T.StructType([T.StructField("rule", T.IntegerType()), *rules.schema.fields])
        #: The rules, numbered in their order; of checked size.
        self.table = spark.createDataFrame([(i, *r) for i, r in enumerate(self.rows)], kept)

    def _found(self, text: Column, first: bool) -> Column:
        patterns = self.patterns

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def found(texts: pd.Series) -> pd.Series:
            m = matcher(patterns)
            return texts.map(lambda t: None if t is None else list(islice((i for i in m.candidates(t) if m.compiled[i].search(t)), 1 if first else None)), na_action=None)

        return found(text)

    def first(self, df: DataFrame, text: str, into: str = "rule") -> DataFrame:
        """df with the struct `into` (in place of a column of that name) of the first rule that its column `text` matches, null
        where none does.  Each distinct text is matched once."""
        each = df.select(F.col(text).alias("__text")).where("__text is not null").distinct()
        hits = each.select("__text", F.get(self._found(F.col("__text"), True), F.lit(0)).alias("__rule")).where("__rule is not null")
        names = [c for c in self.table.columns if c != "rule"]
        rules = F.broadcast(self.table.select(F.col("rule").alias("__rule"), F.struct(*names).alias(into)))
        found = hits.join(rules, "__rule").select("__text", into)
        return df.drop(into).join(found, F.col(text) == F.col("__text"), "left").drop("__text")

    def all(self, df: DataFrame, text: str, into: str = "rules") -> DataFrame:
        """df with the array `into` of the numbers of all rules that its column `text` matches, in order."""
        return df.withColumn(into, self._found(F.col(text), False))

    def _attacks(self) -> tuple[tuple[str, ...], list[Attack]]:
        """All patterns that a task runs (hints behind the rules' own) and the rules' conditions."""
        hints = sorted({r.hint for r in self.rows if r.hint})
        at = {h: len(self.rows) + i for i, h in enumerate(hints)}
        known = [Attack(frozenset(r["where"].split()), bool(r.include_only), r.param.lower() if r.param else None, at.get(r.hint), r.sig is None and r.cve is None) for r in self.rows]
        return (*self.patterns, *hints, fixed.INCLUDE_PARAMS), known

    def labels(self, units: DataFrame) -> DataFrame:
        """units with views (attacks.with_views) -> rid, idx, location, rule, plain, decoded, evidence: every rule that fires
        in a unit, with the first view that fits."""
        patterns, known = self._attacks()
        hit = T.ArrayType(T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("plain", T.BooleanType()), T.StructField("decoded", T.BooleanType()), T.StructField("evidence", T.StringType())]))

        def one(kind: str, param: str | None, views: list[str]) -> list[dict] | None:
            m = matcher(patterns)
            per_view = [m.candidates(v) for v in views]
            if not any(per_view):
                return None
            found: dict[int, dict] = {}
            for at, rules in enumerate(per_view):
                for i in rules:
                    if i >= len(known):
                        break
                    k = known[i]
                    if i in found or kind not in k.kinds or (k.param and k.param != (param or "").lower()):
                        continue
                    if k.include_only and not (param is not None and m.search(len(patterns) - 1, param)):
                        continue
                    if k.hint is not None and not m.search(k.hint, views[0]):
                        continue
                    if h := m.search(i, views[at]):
                        found[i] = {"rule": i, "plain": k.plain, "decoded": at > 0, "evidence": _evidence(views[at], h.start, h.end)}
            return [found[i] for i in sorted(found)] or None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, params, views = (batch.column(c).to_pylist() for c in ("kind", "param", "views"))
                hits = pa.array([one(k, p, v) for k, p, v in zip(kinds, params, views, strict=True)], pa.list_(pa.struct([("rule", pa.int32()), ("plain", pa.bool_()), ("decoded", pa.bool_()), ("evidence", pa.string())])))
                some = hits.is_valid()
                kept = [c for c in batch.schema.names if c in ("rid", "idx", "location")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(some) for c in kept), hits.filter(some)], names=[*kept, "hits"])

        asked = units.select("rid", "idx", "location", "kind", "param", F.col("views.text").alias("views"))
        out = T.StructType([*(asked.schema[c] for c in ("rid", "idx", "location")), T.StructField("hits", hit)])
        return asked.mapInArrow(run, out).select("rid", "idx", "location", F.explode("hits").alias("h")).select("rid", "idx", "location", "h.*")

    def classify(self, units: DataFrame) -> DataFrame:
        """units with views -> rid, cls, location, evidence, decoded, sig, cve, first: one label per request, class
        and location.  The first rule that names a CVE or a signature counts, else the first rule."""
        found = self.labels(units).join(F.broadcast(self.table.select("rule", "cls")), "rule")
        order = F.struct("plain", "idx", "rule")
        best = found.groupBy("rid", "cls", "location").agg(F.min_by(F.struct("evidence", "decoded", "rule"), order).alias("l"), F.min(F.struct("idx", "rule")).alias("first"))
        best = best.select("rid", "cls", "location", "l.*", "first").join(F.broadcast(self.table.select("rule", "sig", "cve")), "rule")
        return best.select("rid", "cls", "location", "evidence", "decoded", "sig", "cve", "first")


def with_rules(rules: DataFrame) -> RuleSet:
    """rules: rank int, name, pattern and further columns; for attacks those of attack_rules().  Patterns are Python's, with
    ASCII classes and case ignored.  Rows that repeat are rules that repeat: the first counts."""
    return RuleSet(rules)
