"""Selection rules as a table: thousands of rules meet all objects by index joins, and the last match wins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import glob_regex, strip
from . import ranks, spread
from .selection import SEGMENTS, overridden

RULES = "rule_id string, ordinal int, scope string, decision string, kind string, pattern string"
#: Lengths at which the ends of names are indexed: a pattern is filed under the longest that its own literal end has.
WIDTHS = (32, 16, 8, 4, 2, 1)
_RUN = 3  # letters of a literal run inside a pattern
_TEXTS = 20_000  # texts whose keys one task makes and looks up
_SALTS = 32  # tasks that may share the texts of one key, at most
_LIST = 10_000  # ordinals whose rules are listed at once


@F.pandas_udf(ArrayType(StringType()))
def _regexes(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else [glob_regex(s) for s in p.split(".")])


def faults(rules: DataFrame) -> DataFrame:
    """rule_id, fault for rules that can't be used: duplicate_id, duplicate_ordinal (of a scope), unknown_scope, unknown_kind, malformed_pattern. A rule with several has a row for each."""
    segments = F.coalesce(*[F.when(F.col("scope") == s, n) for s, n in SEGMENTS.items()])
    parts = F.split("pattern", r"\.", -1)
    glob = (F.size(parts) == segments) & F.forall(parts, lambda p: p.rlike(r"\A[A-Za-z0-9_*?\[\]!]+\z"))
    fine = F.when(F.col("kind") == "glob", glob).otherwise((strip(F.col("pattern")) != "") & ~((F.col("kind") == "tag") & F.col("pattern").startswith("=")))
    ids = rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rule_id", F.lit("duplicate_id").alias("fault"))
    twice = rules.groupBy("scope", "ordinal").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(rules, ["scope", "ordinal"]).select("rule_id", F.lit("duplicate_ordinal").alias("fault"))
    own = F.array_compact(F.array(
        F.when(segments.isNull(), "unknown_scope"), F.when(~F.coalesce(F.col("kind").isin("glob", "tag", "owner"), F.lit(False)), "unknown_kind"),
        F.when(F.coalesce(segments, F.lit(0)) > 0, F.when(~F.coalesce(fine, F.lit(False)), "malformed_pattern")),
    ))
    return ids.unionAll(twice).unionAll(rules.select("rule_id", F.explode(own).alias("fault")))


def rules_from_patterns(patterns: DataFrame, order: str, prefix: str = "pattern") -> DataFrame:
    """RULES of include patterns (order, pattern): ids and ordinals are their places in order, from 0."""
    placed = ranks.ranked(patterns, [order], place="_n").withColumn("_n", F.col("_n") - 1)
    return placed.select(F.concat(F.lit(f"{prefix}-"), F.col("_n").cast("string")).alias("rule_id"), F.col("_n").cast("int").alias("ordinal"), F.lit("object").alias("scope"), F.lit("include").alias("decision"), F.lit("glob").alias("kind"), "pattern")


def patterns_from_rules(rules: DataFrame) -> DataFrame:
    """pattern, ordinal (of its first rule) of include globs of objects, each once: what excludes or looks at tags and owners is lost."""
    return rules.where((F.col("scope") == "object") & (F.col("decision") == "include") & (F.col("kind") == "glob")).groupBy("pattern").agg(F.min("ordinal").alias("ordinal"))


def _filed(rules: DataFrame) -> DataFrame:
    """Add the literal start, end and longest run of glob rules' patterns, and place and key: the longest literal end, else three letters of the run, else none."""
    prefix, suffix = F.regexp_extract("pattern", r"\A[^*?\[]*", 0), F.regexp_extract("pattern", r"[^*?\[\]]*\z", 0)
    runs = F.split(F.regexp_replace("pattern", r"\[!?\]?[^\]]*\]", "*"), r"[*?\[\]]+")
    run = F.coalesce(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"], F.lit(""))
    cut = lambda text, end: F.coalesce(*[F.when(F.length(text) >= w, end(text, F.lit(w))) for w in WIDTHS], F.lit(""))
    size = F.greatest(F.length(prefix), F.length(suffix), F.when(F.length(run) >= _RUN, _RUN).otherwise(0))
    place = F.when(size == 0, "any").when(F.length(prefix) == size, "start").when(F.length(suffix) == size, "end").otherwise("run")
    key = F.when(size == 0, "").when(F.length(prefix) == size, cut(prefix, F.left)).when(F.length(suffix) == size, cut(suffix, F.right)).otherwise(F.left(run, F.lit(_RUN)))
    return rules.withColumns({"place": place, "key": key, "_start": prefix, "_end": suffix, "_run": run})


def glob_hits(facts: DataFrame, rules: DataFrame, segments: int, m: int = 0) -> DataFrame:
    """id, rule for every fact (id, text) that a glob rule (pattern, rule) of so many segments matches.

    Each text is looked up under its own ends of WIDTHS letters and its runs of three, so a
    rule is tried only on texts that share its key; only those that have its whole literal start,
    end and longest run meet the regular expression.  Patterns with no literal letter at either end and no run of three are tried on
    all texts: of those there are few, as equal patterns come once.  Tasks follow the number of texts, and
    texts with a frequent key are shared out among several, each of which gets that key's rules.
    Facts that lie in m partitions by id already aren't counted and dealt again.
    """
    if not m:
        m = spread.parts(facts, rows=_TEXTS)
        facts = spread.dealt(facts, m, ["id"])
    salts = min(m, _SALTS)
    text, n = F.col("text"), F.length("text")
    at = lambda place, key: F.struct(F.lit(place).alias("place"), key.alias("key"))
    ends = F.array_compact(F.array(at("any", F.lit("")), *[F.when(n >= w, at(place, end(text, F.lit(w)))) for w in WIDTHS for place, end in (("start", F.left), ("end", F.right))]))
    runs = F.when(n >= _RUN, F.transform(F.sequence(F.lit(1), n - (_RUN - 1)), lambda i: at("run", F.substring(text, i, F.lit(_RUN)))))
    keys = F.array_distinct(F.concat(ends, F.coalesce(runs, F.array().cast("array<struct<place:string,key:string>>"))))
    parts = F.split("text", r"\.", -1)
    asked = facts.where(F.size(parts) == segments).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).select("id", "text", "_salt", F.explode(keys).alias("_k")).select("id", "text", "_salt", "_k.*")
    filed = _filed(rules).select("place", "key", "_start", "_end", "_run", "rule", _regexes("pattern").alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    fits = F.startswith("text", "_start") & F.endswith("text", "_end") & F.contains("text", "_run")
    for i in range(segments):
        fits &= F.coalesce(F.regexp_like(F.get(parts, F.lit(i)), F.get("_r", F.lit(i))), F.lit(False))
    on = ["place", "key", "_salt"]
    return spread.dealt(asked, m, on).join(spread.dealt(filed, m, on), on).where(fits).select("id", "rule")


def decide_by_table(candidates: DataFrame, rules: DataFrame, *, scope: str, name: Column, tags: Column, owners: Column, overrides: DataFrame | None = None, id_col: str = "object_id", told: Callable[[Column], Column] | None = None) -> DataFrame:
    """selection.decide for rules that are rows (see RULES) instead of a short list: adds decision, decided_by, rule_id and undetermined to candidates of a scope.

    Ids are unique.  Of rules with the same kind and pattern only the last can win, so the others are
    not looked up.  Names meet glob rules by glob_hits, owners' addresses the same way, each distinct address
    once; tags meet their rules by key, and by key and value.  The winner of an object is the
    hit of the highest ordinal: an aggregate, combined before the shuffle.  undetermined lists, in
    order, all rules whose fact isn't known; it depends on which facts are unknown only, so eight lists serve all objects.
    Such a list is as long as the table of rules: where there are many, `told` (say, a digest) makes of each of the eight, once,
    what objects get in its place.
    Rules are assumed to have no faults().
    """
    own = rules.where(F.col("scope") == scope)
    rule = F.struct("ordinal", "rule_id", "decision")
    last = own.groupBy("kind", "pattern").agg(F.max(rule).alias("rule"))
    m = spread.parts(candidates, rows=_TEXTS)
    facts = spread.dealt(candidates.select(F.col(id_col).alias("id"), name.alias("name"), tags.alias("tags"), owners.alias("owners")), m, ["id"])
    by_name = glob_hits(facts.where(F.col("name").isNotNull()).select("id", F.col("name").alias("text")), last.where(F.col("kind") == "glob"), SEGMENTS[scope], m)

    tagged = facts.select("id", F.explode("tags").alias("t")).select("id", F.col("t.key").alias("k"), F.explode(F.array_compact(F.array(F.lit("any").alias("v"), F.concat(F.lit("="), "t.value")))).alias("v"))
    eq = F.instr("pattern", "=")
    by_tag = last.where(F.col("kind") == "tag").select(F.when(eq > 0, F.left("pattern", eq - 1)).otherwise(F.col("pattern")).alias("k"), F.when(eq > 0, F.substring(F.col("pattern"), eq, F.length("pattern"))).otherwise("any").alias("v"), "rule")
    by_tag = tagged.join(by_tag, ["k", "v"]).select("id", "rule")

    addresses = facts.select("id", F.explode("owners").alias("address")).where(F.col("address").isNotNull())
    dotless = F.translate("address", ".", "\x1f")  # an address is one segment
    patterns = last.where(F.col("kind") == "owner").select(F.translate(F.lower(strip(F.col("pattern"))), ".", "\x1f").alias("pattern"), "rule")
    owned = glob_hits(addresses.select(dotless.alias("id"), dotless.alias("text")).distinct(), patterns, 1).groupBy("id").agg(F.max("rule").alias("rule")).withColumnRenamed("id", "address")
    by_owner = addresses.select("id", dotless.alias("address")).join(owned, "address").select("id", "rule")

    best = by_name.unionAll(by_tag).unionAll(by_owner).groupBy("id").agg(F.max("rule").alias("_hit")).withColumnRenamed("id", "_id")
    # which kinds of facts are unknown, as bits
    bit = F.when(F.col("kind") == "glob", 1).when(F.col("kind") == "tag", 2).otherwise(4)
    lists = own.withColumn("_mask", F.explode(F.sequence(F.lit(1), F.lit(7)))).where(F.col("_mask").bitwiseAND(bit) > 0)
    ordered = lambda by, what: F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what])
    lists = lists.groupBy("_mask", F.floor(F.col("ordinal") / _LIST).alias("_at")).agg(ordered("ordinal", "rule_id").alias("_some"))
    lists = lists.groupBy("_mask").agg(F.flatten(ordered("_at", "_some")).alias("_unknown"))
    lists = rules.sparkSession.range(8).select(F.col("id").cast("int").alias("_mask")).join(lists, "_mask", "left").select("_mask", F.coalesce("_unknown", F.array().cast("array<string>")).alias("_unknown"))
    if told is not None:
        lists = lists.select("_mask", told(F.col("_unknown")).alias("_unknown"))
    mask = name.isNull().cast("int") + tags.isNull().cast("int") * 2 + owners.isNull().cast("int") * 4
    found = overridden(candidates, overrides, scope=scope, name=name, id_col=id_col)
    free = F.col("_over").isNull()
    found = found.withColumn("_mask", F.when(free, mask).otherwise(0))
    found = found.join(best, F.col(id_col) == F.col("_id"), "left").join(F.broadcast(lists), "_mask")  # eight rows
    out = found.withColumns({
        "decision": F.coalesce("_over", "_hit.decision", F.lit("exclude")),
        "decided_by": F.when(~free, "override").when(F.col("_hit").isNotNull(), "rule").otherwise("default"),
        "rule_id": F.when(free, F.col("_hit.rule_id")),
        "undetermined": F.col("_unknown"),
    })
    return out.drop("_over", "_hit", "_id", "_mask", "_unknown")
