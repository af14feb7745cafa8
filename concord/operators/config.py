"""Configuration as tables: endpoints, pairs of them, and their rules; small, but checked and compared like all else."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

from .selection import rules_from_patterns


def load_config(path: str | None, environment: Mapping[str, str], overrides: Mapping[str, object], prefix: str = "CONCORD_") -> dict:
    """Settings from a JSON file, then from variables that begin with prefix (two underscores part levels), then overrides; later ones win, mappings are merged."""

    def merge(a: dict, b: Mapping) -> dict:
        out = dict(a)
        for k, v in b.items():
            out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
        return out

    out: dict = {}
    if path is not None:
        with open(path, encoding="utf-8") as f:
            out = json.load(f)
        if not isinstance(out, dict):
            raise ValueError(f"{path} holds no mapping")
    for name in sorted(environment):
        if name.startswith(prefix):
            *parents, last = name.removeprefix(prefix).lower().split("__")
            value: object = {last: environment[name]}
            for p in reversed(parents):
                value = {p: value}
            out = merge(out, value)
    return merge(out, overrides)


def first_import(generation: int, endpoints: DataFrame, pairs: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, rules, failures) of a first start: what is created, one include rule for each pattern of a created pair, and what failed and why.

    Nothing is imported where generation isn't 0.  Items fail one by one: an endpoint without a connector or of a
    doubled name, a pair whose endpoints weren't created or are the same.  endpoints: name, connector; pairs: name, source, target;
    patterns: pair, pos, pattern.  All arrive enabled.
    """
    if generation != 0:
        endpoints, pairs, patterns = endpoints.limit(0), pairs.limit(0), patterns.limit(0)
    of = lambda key: F.count(F.lit(1)).over(Window.partitionBy(key))
    e = endpoints.withColumn("_n", of("name"))
    e = e.withColumn("reason", F.when(F.col("_n") > 1, "doubled_name").when(F.coalesce(strip(F.col("connector")), F.lit("")) == "", "no_connector"))
    fine = e.where(F.col("reason").isNull()).select("name")
    side = lambda c: fine.select(F.col("name").alias(c), F.lit(True).alias(f"_{c}"))
    p = pairs.withColumn("_n", of("name")).join(side("source"), "source", "left").join(side("target"), "target", "left")
    reason = F.when(F.col("_n") > 1, "doubled_name").when(F.col("source") == F.col("target"), "same_endpoint").when(F.col("_source").isNull(), "no_source").when(F.col("_target").isNull(), "no_target")
    p = p.withColumn("reason", reason)
    kinds = [(e, "endpoint"), (p, "pair")]
    told = [df.select(F.lit(kind).alias("kind"), F.col("name").alias("key"), "reason") for df, kind in kinds]
    both = told[0].unionByName(told[1])
    made = p.where(F.col("reason").isNull()).select(F.col("name").alias("pair"))
    ordinal = F.row_number().over(Window.partitionBy("pair").orderBy("pos")) - 1
    rules = patterns.join(made, "pair", "left_semi").select("pair", ordinal.alias("ordinal"), F.lit("object").alias("scope"), F.lit("include").alias("decision"), F.lit("glob").alias("matcher_kind"), "pattern")
    return both.where(F.col("reason").isNull()).select("kind", "key", F.lit(True).alias("enabled")), rules, both.where(F.col("reason").isNotNull())


def next_ordinal(rules: DataFrame, by: list[str]) -> DataFrame:
    """by, next_ordinal: after the highest there is. A pair without rules begins at 0 (it has no row here)."""
    return rules.groupBy(*by).agg((F.max("ordinal") + 1).alias("next_ordinal"))


def reordered(rules: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Rules with ordinals 0 to N - 1 in the order wanted (by, rule_id, pos); rules that aren't named follow in their old order. One pass: numbers never collide."""
    place = wanted.select(*by, "rule_id", "pos")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("pos").isNull(), "pos", "ordinal", "rule_id"))
    return rules.join(place, [*by, "rule_id"], "left").withColumn("ordinal", (rank - 1).cast("int")).drop("pos")


def moved(rules: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """Rules with one of each group moved (by, from, to: places in the order of ordinal and id); a place that isn't there moves nothing."""
    w = Window.partitionBy(*by)
    placed = rules.withColumn("_at", F.row_number().over(w.orderBy("ordinal", "rule_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    m = placed.join(moves.select(*by, F.col("from").alias("_f"), F.col("to").alias("_t")), by, "left")
    fits = (F.col("_f") >= 0) & (F.col("_t") >= 0) & (F.col("_f") < F.col("_n")) & (F.col("_t") < F.col("_n"))
    at, f, t = F.col("_at"), F.col("_f"), F.col("_t")
    new = F.when(at == f, t).when((f < t) & (at > f) & (at <= t), at - 1).when((t < f) & (at >= t) & (at < f), at + 1).otherwise(at)
    return m.withColumn("ordinal", F.when(F.coalesce(fits, F.lit(False)), new).otherwise(at).cast("int")).drop("_at", "_n", "_f", "_t")


_CONTENT = ("decision", "matcher_kind", "pattern")


def dirty(draft: DataFrame, stored: DataFrame, scope: str) -> DataFrame:
    """scope, dirty: whether the draft (scope, pos, rule_id, content) differs from what is stored (scope, ordinal, rule_id, content) in number, order, ids or content."""
    at = F.row_number().over(Window.partitionBy(scope).orderBy("ordinal", "rule_id")) - 1
    a = draft.select(scope, F.col("pos").cast("int").alias("pos"), F.struct("rule_id", *_CONTENT).alias("_a"))
    b = stored.select(scope, at.alias("pos"), F.struct("rule_id", *_CONTENT).alias("_b"))
    return a.join(b, [scope, "pos"], "full_outer").groupBy(scope).agg(F.bool_or(~F.col("_a").eqNullSafe(F.col("_b"))).alias("dirty"))


def save_plan(draft: DataFrame, stored: DataFrame) -> DataFrame:
    """scope, rule_id, key, action (create, update, delete) to bring stored rules to the draft; a draft rule whose id is gone is created again."""
    a = draft.select("scope", "key", F.col("rule_id").alias("_id"), F.struct(*_CONTENT).alias("_a"))
    b = stored.select("scope", "rule_id", F.struct(*_CONTENT).alias("_b"))
    both = a.join(b, (a["scope"] == b["scope"]) & (a["_id"] == b["rule_id"]), "full_outer")
    action = F.when(b["rule_id"].isNull(), "create").when(a["key"].isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return both.select(F.coalesce(a["scope"], b["scope"]).alias("scope"), b["rule_id"].alias("rule_id"), a["key"].alias("key"), action.alias("action")).where("action is not null")


def section_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """section, name, change (added, removed, changed) of two documents as rows section, name, content."""
    a = old.select("section", "name", F.struct("content").alias("_a"))
    b = new.select("section", "name", F.struct("content").alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, ["section", "name"], "full_outer").withColumn("change", change).where("change is not null").select("section", "name", "change")


def in_use(endpoints: DataFrame, pairs: DataFrame) -> DataFrame:
    """Endpoints (name) that a pair names as its source or its target, and so can't be deleted."""
    used = pairs.select(F.col("source").alias("name")).unionAll(pairs.select(F.col("target").alias("name")))
    return endpoints.join(used, "name", "left_semi")


def schedulable(pairs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Pairs (pair, source, target, enabled) that are enabled and whose endpoints (name, enabled) are both there and enabled."""
    on = endpoints.where("enabled").select("name")
    return pairs.where("enabled").join(on.withColumnRenamed("name", "source"), "source", "left_semi").join(on.withColumnRenamed("name", "target"), "target", "left_semi")


def type_overlap(pairs: DataFrame, requested: Sequence[str]) -> DataFrame:
    """pair, entity_types: those requested that the pair has, in the order requested."""
    return pairs.select("pair", F.array_intersect(F.array(*[F.lit(t) for t in requested]), F.col("entity_types")).alias("entity_types"))


def inline_secrets(settings: DataFrame, secret_fields: DataFrame) -> DataFrame:
    """endpoint, fields: settings that the connector keeps as secrets and so must not be given inline. settings: endpoint, connector, names; secret_fields: connector, secrets."""
    both = settings.join(secret_fields, "connector").select("endpoint", F.array_sort(F.array_intersect("names", "secrets")).alias("fields"))
    return both.where(F.size("fields") > 0)


def ordered_subset(ids, wanted):
    """Those of ids that are wanted, in the order of ids, each once."""
    return F.array_distinct(F.filter(ids, lambda x: F.array_contains(wanted, x)))


def task_problems(tasks: DataFrame) -> DataFrame:
    """id, problem, other: ids that occur more than once, and dependencies that no task has."""
    doubled = tasks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("problem"), F.lit(None).cast("string").alias("other"))
    needs = tasks.select("id", F.explode("deps").alias("dep")).distinct()
    known = tasks.select(F.col("id").alias("dep")).distinct()
    unknown = needs.join(known, "dep", "left_anti").select("id", F.lit("unknown_dependency").alias("problem"), F.col("dep").cast("string").alias("other"))
    return doubled.unionByName(unknown)


def assumptions(registry: DataFrame, *, component: str | None = None, status: str | None = None, with_probe: bool = False, must_verify: bool = False) -> DataFrame:
    """Assumptions (assumption_id, component, status, probe, severity) by component and status; with_probe: those that can be tried; must_verify: unverified ones of high severity."""
    out = registry
    if component is not None:
        out = out.where(F.col("component") == component)
    if status is not None:
        out = out.where(F.col("status") == status)
    if with_probe:
        out = out.where(strip(F.col("probe")) != "")
    return out.where((F.col("status") == "unverified") & (F.col("severity") == "high")) if must_verify else out


def audited(generation: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log rows, new generation) of changes (entity_kind, entity_id, action, field, was, now, actor, at).

    Updates that change nothing leave no row, and without rows the generation stays; else it is one more, and all rows carry it.
    """
    real = changes.where((F.col("action") != "update") | ~F.col("was").eqNullSafe(F.col("now")))
    now = generation.agg(F.coalesce(F.max("generation"), F.lit(0)).cast("long").alias("g"))
    after = now.join(real.agg(F.count(F.lit(1)).alias("n"))).select((F.col("g") + (F.col("n") > 0).cast("long")).alias("generation"))  # two rows of one
    return real.join(after), after


def rule_rows(patterns: list[str]) -> list[tuple]:
    """Include rules of patterns as tuples of rule_id, ordinal, scope, decision, kind, pattern."""
    return [(r.rule_id, r.ordinal, r.scope, r.decision, r.kind, r.pattern) for r in rules_from_patterns(patterns)]


REVIEW_KIND, REVIEW_VERSION = "identity-review", 1


def load_review(path: str) -> list[dict]:
    """Proposals of a review file, or ValueError if it is of another kind or version, or an id occurs twice."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if not isinstance(raw, dict) or (raw.get("kind"), raw.get("version")) != (REVIEW_KIND, REVIEW_VERSION) or not isinstance(raw.get("proposals"), list):
        raise ValueError(f"{path} is no review of version {REVIEW_VERSION}")
    ids = [p.get("proposal_id") if isinstance(p, dict) else None for p in raw["proposals"]]
    if None in ids or len(set(ids)) < len(ids):
        raise ValueError("proposals need ids that differ")
    return raw["proposals"]


def save_review(path: str, proposals: list[dict]) -> str:
    """Write a review file in order of id; readers see the old file or the new one. Reviews are read by people, so they are small."""
    body = {"kind": REVIEW_KIND, "version": REVIEW_VERSION, "proposals": sorted(proposals, key=lambda p: p["proposal_id"])}
    temporary = f"{path}.{os.getpid()}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        json.dump(body, f, ensure_ascii=False, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
    return path


def write_plan(records: DataFrame, writes: DataFrame, folder: str) -> None:
    """A dry run's plan as JSON lines: records and writes, each in a folder of its own."""
    records.write.mode("overwrite").json(f"{folder}/records")
    writes.write.mode("overwrite").json(f"{folder}/writes")
