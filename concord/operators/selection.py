"""Selection rules: three-valued matchers, last match wins, overrides first, datasets inherit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import check_glob, glob_matches, glob_regex

SEGMENTS = {"object": 2, "dataset": 3}


@dataclass(frozen=True)
class Rule:
    """A rule of a scope; ordinal: later rules win. kind: glob, tag or owner."""

    rule_id: str
    ordinal: int
    scope: str
    decision: str
    kind: str
    pattern: str


def check_rules(rules: list[Rule]) -> list[Rule]:
    """Rules in order of scope and ordinal, or ValueError for doubled ids or ordinals, or malformed patterns."""
    for what in ([r.rule_id for r in rules], [(r.scope, r.ordinal) for r in rules]):
        if len(set(what)) < len(what):
            raise ValueError("rule ids and ordinals of a scope must differ")
    for r in rules:
        if r.kind == "glob":
            check_glob(r.pattern, SEGMENTS[r.scope])
        elif not r.pattern.strip() or r.kind == "tag" and r.pattern.startswith("="):
            raise ValueError(f"{r.pattern!r} is no {r.kind} pattern")
    return sorted(rules, key=lambda r: (r.scope, r.ordinal))


def rules_from_patterns(patterns: list[str], prefix: str = "pattern") -> list[Rule]:
    return [Rule(f"{prefix}-{i}", i, "object", "include", "glob", p) for i, p in enumerate(patterns)]


def patterns_from_rules(rules: list[Rule]) -> list[str]:
    """Include patterns of object rules, first seen first: what excludes or looks at tags and owners is lost."""
    return list(dict.fromkeys(r.pattern for r in check_rules(rules) if (r.scope, r.decision, r.kind) == ("object", "include", "glob")))


def match(rule: Rule, name: Column, tags: Column, owners: Column) -> Column:
    """match, no_match, or unavailable where the fact is unknown (null). tags: array of key, value; owners: array of e-mail addresses."""
    if rule.kind == "glob":
        fact, hit = name, glob_matches(name, rule.pattern)
    elif rule.kind == "tag":
        key, eq, value = rule.pattern.partition("=")
        fact, hit = tags, F.exists(tags, lambda t: (t["key"] == key) & (F.coalesce(t["value"] == value, F.lit(False)) if eq else F.lit(True)))
    else:
        fact, hit = owners, F.exists(owners, lambda o: F.coalesce(o.rlike(glob_regex(rule.pattern.strip().lower())), F.lit(False)))
    return F.when(fact.isNull(), "unavailable").when(hit, "match").otherwise("no_match")


def overridden(candidates: DataFrame, overrides: DataFrame | None, *, scope: str, name: Column, id_col: str) -> DataFrame:
    """Add _over: the decision of an override for the candidate's id, else for its name; null if there is none."""
    if overrides is None:
        return candidates.withColumn("_over", F.lit(None).cast("string"))
    keyed = overrides.where(F.col("scope") == scope).select(F.col("key").alias("_key"), F.col("decision").alias("_o"))
    by_id = keyed.select(F.col("_key").alias("_k1"), F.col("_o").alias("_o1"))
    by_name = keyed.select(F.col("_key").alias("_k2"), F.col("_o").alias("_o2"))
    found = candidates.withColumn("_name", name).join(by_id, F.col(id_col).cast("string") == F.col("_k1"), "left").join(by_name, F.col("_name") == F.col("_k2"), "left")
    return found.withColumn("_over", F.coalesce("_o1", "_o2")).drop("_name", "_k1", "_k2", "_o1", "_o2")


def decide(candidates: DataFrame, rules: list[Rule], *, scope: str, name: Column, tags: Column, owners: Column, overrides: DataFrame | None = None, id_col: str = "object_id") -> DataFrame:
    """Add decision, decided_by (override, rule, default), rule_id and undetermined (ids of rules whose fact is unknown, in order) to candidates of a scope.

    Rules are a short list, compiled to one expression, so nothing is joined or
    shuffled for them.  overrides: key (an id, or a qualified name), decision, one row a key; the id is looked up first.
    """
    own = [r for r in check_rules(rules) if r.scope == scope]
    found = overridden(candidates, overrides, scope=scope, name=name, id_col=id_col)
    results = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.decision).alias("decision"), match(r, name, tags, owners).alias("result")) for r in own]) if own else None
    if results is None:
        hit, unknown = F.lit(None).cast("struct<rule_id:string,decision:string,result:string>"), F.array().cast("array<string>")
    else:
        found = found.withColumn("_results", results)
        matched = F.filter("_results", lambda x: x["result"] == "match")
        hit = F.try_element_at(matched, F.lit(-1))
        unknown = F.transform(F.filter("_results", lambda x: x["result"] == "unavailable"), lambda x: x["rule_id"])
    found = found.withColumn("_hit", hit)
    out = found.withColumns({
        "decision": F.coalesce("_over", "_hit.decision", F.lit("exclude")),
        "decided_by": F.when(F.col("_over").isNotNull(), "override").when(F.col("_hit").isNotNull(), "rule").otherwise("default"),
        "rule_id": F.when(F.col("_over").isNull(), F.col("_hit.rule_id")),
        "undetermined": F.when(F.col("_over").isNull(), unknown).otherwise(F.array().cast("array<string>")),
    })
    return out.drop("_over", "_results", "_hit")


def compose(datasets: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """Add selected and via to decided datasets: an excluded (or unknown) parent excludes; else the dataset's own override or rule; else it inherits."""
    p = parents.select(F.col(parent_key).alias("_p"), F.col("decision").alias("_pd"))
    out = datasets.join(p, F.col(parent_key) == F.col("_p"), "left").withColumn("_pd", F.coalesce("_pd", F.lit("exclude")))
    selected = F.when(F.col("_pd") == "exclude", F.lit(False)).when(F.col("decided_by") != "default", F.col("decision") == "include").otherwise(F.lit(True))
    via = F.when(F.col("_pd") == "exclude", "parent").when(F.col("decided_by") != "default", F.col("decided_by")).otherwise("inherited")
    return out.withColumns({"selected": selected, "via": via}).drop("_p", "_pd")


def tally(decided: DataFrame, scope: Column, included: Column) -> DataFrame:
    """total, included, excluded and undetermined (which overlaps them) for each scope."""
    return decided.groupBy(scope.alias("scope")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(included).alias("included"), F.count_if(~included).alias("excluded"), F.count_if(F.size("undetermined") > 0).alias("n_undetermined")
    )


def owner_emails(parties: Column) -> Column:
    """Normal e-mail addresses of parties whose role is owner; null parties: unknown."""
    return F.filter(F.transform(F.filter(parties, lambda p: p["role"] == "owner"), lambda p: p["email"]), lambda e: e.isNotNull())


__all__ = ["Rule", "check_rules", "compose", "decide", "match", "owner_emails", "patterns_from_rules", "rules_from_patterns", "tally"]
