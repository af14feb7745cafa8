"""Patterns, owners, tags and other small conversions as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Forms of owners, and keys whose values are secrets.
EMAIL = r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"
UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
VIEWS = ("VIEW", "MATERIALIZED_VIEW")
TABLES = ("MANAGED", "EXTERNAL", "FOREIGN", "STREAMING_TABLE", "MANAGED_SHALLOW_CLONE", "EXTERNAL_SHALLOW_CLONE")
_GLOB = re.compile(r"[A-Za-z0-9_*?\[\]!]+")
#: What makes a key secret, and how its value is shown; fixed values.
SECRET_KEY = r"token|password|passwd|secret|api[_-]?key|authorization|private[_-]?key|credential|access[_-]?key|refresh[_-]?token"
REDACTED = "***REDACTED***"
#: White space of all of Unicode, for a class; and values of secret keys, and credentials, in a syntax that Java and RE2 share.
WHITE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_QUOTED = r""""[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'"""
#: A key may go on with a plural s, digits, or what a dash or underscore joins; a bracketed list is one value.
KEYED = rf"""(?is)((?:{SECRET_KEY})(?:s|[0-9]+|[_-][A-Za-z0-9_-]*)?["']?[{WHITE}]*[=:][{WHITE}]*)(?:\[[^\]]*\]|{_QUOTED}|(?:(?:bearer|basic)[{WHITE}]+)?[^{WHITE},;]+)"""
CREDENTIAL = rf"(?i)(^|[^A-Za-z0-9_])(bearer|basic)[{WHITE}]+[^{WHITE}]+"


def strip(text: Column) -> Column:
    """Without white space of any kind of Unicode's at the ends."""
    return F.regexp_replace(text, rf"(?s)\A[{WHITE}]+|[{WHITE}]+\z", "")


def glob_regex(pattern: str) -> str:
    """A shell pattern for one segment of a name as a Java regular expression for the whole segment, letters' case kept apart."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + (pattern[i : i + 1] == "!") + 1)
            if end < 0:
                out.append(r"\[")
                continue
            body = pattern[i:end]
            negated, body = body.startswith("!"), body.removeprefix("!")
            out.append(f"[{'^' * negated}{re.sub(r'([\\^\[\]&])', r'\\\1', body)}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return f"(?s)\\A{''.join(out)}\\z"


def check_glob(pattern: str, segments: int) -> str:
    """The pattern, or ValueError if it hasn't so many non-empty segments of allowed characters."""
    parts = pattern.split(".")
    if len(parts) != segments or not all(_GLOB.fullmatch(p) for p in parts):
        raise ValueError(f"{pattern!r} is no pattern of {segments} segments")
    return pattern


def glob_matches(name: Column, pattern: str) -> Column:
    """Whether every dot-separated segment of name matches the pattern's; a name of another number of segments doesn't. Null: null."""
    parts = pattern.split(".")
    segments = F.split(name, r"\.")
    fits = F.size(segments) == len(parts)
    for i, p in enumerate(parts):
        fits &= F.coalesce(F.get(segments, F.lit(i)).rlike(glob_regex(p)), F.lit(False))
    return F.when(name.isNotNull(), fits)


def literal_catalogs(patterns: list[str]) -> list[str]:
    """Catalog segments without wildcards, in first-seen order."""
    return list(dict.fromkeys(p.split(".")[0] for p in patterns if not set("*?[") & set(p.split(".")[0])))


def shaped(name: Column, segments: int) -> Column:
    """name if it has so many non-empty segments, else null: unknown."""
    parts = F.split(name, r"\.")
    return F.when((F.size(parts) == segments) & F.forall(parts, lambda p: strip(p) != ""), name)


def qualified_name(full_name: Column, native_key: Column, segments: int) -> Column:
    return F.coalesce(shaped(full_name, segments), shaped(native_key, segments))


def owner_party(owner: Column, role: str = "owner") -> Column:
    """An owner's text as party_id, display_name, email, role: an address, an id or a name. Blank: null."""
    t = strip(owner)
    email, uid = t.rlike(EMAIL), t.rlike(UUID)
    return F.when(
        t != "",
        F.struct(F.when(uid & ~email, t).alias("party_id"), F.when(~email & ~uid, t).alias("display_name"), F.when(email, t).alias("email"), F.lit(role).alias("role")),
    )


def asset_type(table_type: Column) -> Column:
    return F.when(table_type.isin(*VIEWS), "view").when(table_type.isin(*TABLES), "table").otherwise("other")


def party_role(role: Column) -> Column:
    r = F.lower(strip(role))
    return F.when(r.contains("owner"), "owner").when(r.contains("steward"), "steward").when(r.contains("contact"), "contact").otherwise("other")


def tag_values(tags: Column) -> Column:
    """key or key=value, first-seen order, each once."""
    return F.array_distinct(F.transform(tags, lambda t: F.concat(t["key"], F.coalesce(F.concat(F.lit("="), t["value"]), F.lit("")))))


def redacted(text: Column) -> Column:
    """Text without values of secret keys (key=value, key: value, "key": "value") and without what follows bearer or basic.

    A value in quotes goes up to its closing quote, any other up to white space, a comma or a semicolon.
    """
    return redacted_text(F.regexp_replace(text, KEYED, f"$1{REDACTED}"))


def redacted_map(values: Column) -> Column:
    """A map of texts: values of secret keys replaced, credentials in other values too."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(f"(?i){SECRET_KEY}"), F.lit(REDACTED)).otherwise(redacted_text(v)))


def redacted_text(text: Column) -> Column:
    """Text without what follows bearer or basic; keys don't count."""
    return F.regexp_replace(text, CREDENTIAL, f"$1$2 {REDACTED}")


def redacted_json_text(text: str | None) -> str | None:
    """JSON text with every secret key's value replaced, of whatever type and at any depth, and credentials in all other strings."""

    def walk(value):
        if isinstance(value, str):
            return re.sub(r"(?i)\b(bearer|basic)\s+\S+", rf"\1 {REDACTED}", value)
        if isinstance(value, dict):
            return {k: REDACTED if re.search(SECRET_KEY, k, re.IGNORECASE) else walk(v) for k, v in value.items()}
        return [walk(v) for v in value] if isinstance(value, list) else value

    return None if text is None else json.dumps(walk(json.loads(text)), ensure_ascii=False, separators=(",", ":"))


def redacted_json(text: Column) -> Column:
    """See redacted_json_text; text that isn't JSON raises."""

    @F.pandas_udf(StringType())
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(redacted_json_text)

    return redact(text)


def email_domain(email: Column) -> Column:
    return F.when(email.contains("@"), F.substring_index(email, "@", -1))


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])([A-Z])", "_$1"))


def slug(name: Column, fallback: str = "item", most: int = 80) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one dash, at most `most` characters; nothing left: the fallback."""
    text = F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.rtrim(F.substring(text, 1, most), F.lit("-")), F.lit("")), F.lit(fallback))


def endpoint_key(endpoint: Column) -> Column:
    """An endpoint's name as part of a setting's name: upper case, other characters as underscores. Nothing left raises."""
    text = F.upper(F.trim(F.regexp_replace(strip(endpoint), r"[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.when(text == "", F.raise_error(F.lit("an endpoint needs a letter or digit")).cast("string")).otherwise(text)


def jitter(cadence_s: Column) -> Column:
    """The most by which a start may be delayed: a tenth of the cadence, 60 seconds at most."""
    return F.least(cadence_s * 0.1, F.lit(60.0))


def cursor(at: Column, key: Column) -> Column:
    """A page cursor: URL-safe base64 of instant|key."""
    raw = F.base64(F.encode(F.concat_ws("|", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), key.cast("string")), "UTF-8"))
    return F.translate(raw, "+/", "-_")


def cursor_parts(text: Column) -> Column:
    """A cursor's instant and key as a struct, null if it can't be read."""
    raw = F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))
    plain = F.decode(raw, "UTF-8")
    at = F.try_to_timestamp(F.substring_index(plain, "|", 1))
    key = F.regexp_extract(plain, r"(?s)\A[^|]*\|(.+)\z", 1)
    return F.when(at.isNotNull() & (key != ""), F.struct(at.alias("at"), key.alias("key")))


def merged(first: Column, *others: Column) -> Column:
    """Maps merged; of a key that several have the first map's value counts. Null maps are empty."""
    out = F.coalesce(first, F.create_map().cast("map<string,string>"))
    for m in others:
        out = _first_wins(out, F.coalesce(m, F.create_map().cast("map<string,string>")))
    return out


def _first_wins(a: Column, b: Column) -> Column:
    return F.map_concat(a, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))


def secondary_keys(keys: Column) -> Column:
    """A map of keys without those that are null or blank."""
    return F.map_filter(keys, lambda k, v: v.isNotNull() & (strip(v) != ""))


def some_of(items: Column, most: int = 5) -> Column:
    """At most `most` items, then how many more."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
