"""Canonical text: values that mean the same get the same text, and so the same checksum.

Everything stays in built-in expressions, except Unicode composition, case folding
and free-form JSON: for these an Arrow UDF gets only the rows that need it (the
others reach it as nulls).
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import strip

_NOT_ASCII = r"[^\x00-\x7F]"
_EDGES = r"(?s)\A[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+\z"
#: A whole instant with an offset, in one grammar for columns (Java) and for JSON (Python, fullmatch).
_INSTANT = r"([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)(?:[Zz]|([+-])([0-9]{2}):?([0-9]{2}))"
_WHITE = " \t\n\r\f\v"
MAX_DEPTH = 64
#: Why a JSON text has no canonical form; see json_projections.
FAULTS = ("not_json", "number_too_long", "not_finite", "too_deep", "keys_collide", "not_unicode")
#: Fields whose arrays are sets; fixed values. All others keep their order.
UNORDERED = ("asset_links", "classifications", "dataset_refs", "glossary_term_refs", "owners", "stewards", "tags", "term_relations")


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t).casefold())


def nfc(text: Column) -> Column:
    return F.coalesce(_composed(F.when(text.rlike(_NOT_ASCII), text)), text)


def stripped(text: Column) -> Column:
    """Without ASCII white space at the ends; other white space, such as U+00A0, stays."""
    return F.regexp_replace(text, _EDGES, "")


def casefolded(text: Column) -> Column:
    return F.coalesce(_folded(F.when(text.rlike(_NOT_ASCII), text)), F.lower(text))


def normal_name(name: Column) -> Column:
    """For comparing names: composed, stripped, case folded."""
    return casefolded(strip(nfc(name)))


def normal_email(email: Column) -> Column:
    """Stripped and case folded; blank is null."""
    return F.nullif(casefolded(strip(email)), F.lit(""))


def instant_text(ts: Column) -> Column:
    """UTC with milliseconds, cut, not rounded; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def canonical_string(text: Column) -> Column:
    """Composed, LF line ends, stripped; instants with an offset as UTC milliseconds. Null stays null, and is not the empty text."""
    plain = stripped(F.regexp_replace(nfc(text), "\r\n?", "\n"))
    return F.coalesce(instant_text(instant_of(plain)), plain)


def instant_of(text: Column) -> Column:
    """The instant that the whole text says, with its offset (Z, +02:00 or +0200); null for any other text, and for local times."""
    part = lambda i: F.regexp_extract(text, rf"\A{_INSTANT}\z", i)
    local = F.try_to_timestamp(F.concat(part(1), F.lit("T"), part(2), F.lit("Z")))
    hours, minutes = part(4).try_cast("int"), part(5).try_cast("int")
    offset = F.coalesce(F.when(part(3) == "-", -1).otherwise(1) * (hours * 60 + minutes), F.lit(0))
    fits = text.rlike(rf"\A{_INSTANT}\z") & F.coalesce(hours * 60 + minutes < 24 * 60, F.lit(True))
    return F.when(fits, F.timestamp_micros(F.unix_micros(local) - offset.cast("long") * 60_000_000))


def instant_of_millis(millis: Column) -> Column:
    """An instant from milliseconds since 1970."""
    return F.timestamp_millis(millis.cast("long"))


def checksum(canonical: Column) -> Column:
    """sha256: and the digest of canonical text; null text has the digest of the JSON null."""
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(canonical, F.lit("null")), 256))


def sorted_multiset(items: Column) -> Column:
    """Items (canonical texts, made before they are collected) in order; how often each occurs is kept. Null stays null."""
    return F.array_sort(items)


@F.pandas_udf(StringType())
def _numbered(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda x: None if pd.isna(x) else _dump(int(x) if x.is_integer() else x))


def number_text(x: Column) -> Column:
    """A double as canonical JSON has it: whole ones as integers with all their digits, no negative zero, others with the fewest digits that tell them apart.

    Whole numbers below 2**53, and others from 0.0001 of at most 15 digits, which no
    other double has, are built-in expressions; an Arrow UDF gets the rest.  NaN and infinities raise.
    """
    x = x.cast("double")
    size = F.abs(x)
    whole = (size < 2.0**53) & (x == F.floor(x))
    plain = F.regexp_replace(F.when((size >= 1e-4) & (size < 2.0**53), x).try_cast("decimal(38,21)").cast("string"), r"\.?0+\z", "")
    short = F.length(F.regexp_replace(plain, r"\A-?0?\.?0*|\.", "")) <= 15
    bad = F.isnan(x) | (size == float("inf"))
    text = F.when(bad, F.raise_error(F.lit("not a finite number")).cast("string"))
    text = text.when(whole, x.try_cast("long").cast("string")).when(short, plain)
    return text.otherwise(_numbered(F.when(~bad & ~whole & ~F.coalesce(short, F.lit(False)), x)))


def ordered(field: Column) -> Column:
    """Whether the order of a field's arrays counts; names may be in camel case."""
    return ~F.lower(F.regexp_replace(field, r"(?<!\A)(?=[A-Z])", "_")).isin(*UNORDERED)


class Refused(ValueError):
    """A JSON text without a canonical form; reason is one of FAULTS."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


def _read(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise Refused("not_json", str(e)) from None
    except ValueError as e:  # integers beyond the digits that Python converts
        raise Refused("number_too_long", str(e)) from None
    except RecursionError:
        raise Refused("too_deep", "nested too deeply") from None


def _walk(value, sort: bool, depth: int, canonical: bool = True):
    if depth > MAX_DEPTH:
        raise Refused("too_deep", "nested too deeply")
    if isinstance(value, str):
        if not canonical:
            return value
        text = unicodedata.normalize("NFC", value).replace("\r\n", "\n").replace("\r", "\n").strip(_WHITE)
        return _instant(text) or text
    if isinstance(value, float):
        if not math.isfinite(value):
            raise Refused("not_finite", "not a finite number")
        return int(value) if canonical and value.is_integer() else value
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            name = unicodedata.normalize("NFC", k).strip(_WHITE) if canonical else k
            if name in out:
                raise Refused("keys_collide", f"two keys become {name!r}")
            out[name] = _walk(v, sort, depth + 1, canonical)
        return out
    if isinstance(value, list):
        items = [_walk(v, sort, depth + 1, canonical) for v in value]
        return sorted(items, key=_dump) if sort and canonical else items
    return value


def _instant(text: str) -> str | None:
    if not re.fullmatch(_INSTANT, text):
        return None
    try:
        at = datetime.fromisoformat(text.upper())
        return f"{(at := at.astimezone(UTC)).year:04d}-{at:%m-%dT%H:%M:%S}.{at.microsecond // 1000:03d}Z"
    except (ValueError, OverflowError):
        return None


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _faithful(value) -> str:
    return json.dumps(_walk(value, False, 0, canonical=False), ensure_ascii=False, separators=(",", ":"))


def faithful_json_text(text: str | None) -> str | None:
    """JSON text as it is to be written: compact, everything else untouched; what canonical_json refuses is refused, but for keys that only become equal."""
    return None if text is None else _faithful(_read(text))


def canonical_json_text(text: str | None, sort_arrays: bool = False) -> str | None:
    """One JSON text in canonical form; see canonical_json."""
    return None if text is None else _dump(_walk(_read(text), sort_arrays, 0))


def projected_json(text: str | None, sort_arrays: bool = False) -> tuple[str | None, str | None, str | None]:
    """(faithful, canonical, fault) of one JSON text; see json_projections."""
    if text is None:
        return None, None, None
    try:
        value = _read(text)
        both = _faithful(value), _dump(_walk(value, sort_arrays, 0))
        for t in both:
            t.encode()
        return *both, None
    except Refused as e:
        return None, None, e.reason
    except UnicodeEncodeError:  # half of a surrogate pair, which JSON can escape and UTF-8 can't hold
        return None, None, "not_unicode"


def faithful_json(text: Column) -> Column:
    """JSON text as it is to be written, beside canonical_json, which is only compared; see faithful_json_text."""

    @F.pandas_udf(StringType())
    def faithful(texts: pd.Series) -> pd.Series:
        return texts.map(faithful_json_text)

    return faithful(text)


def canonical_json(text: Column, *, sort_arrays: bool = False) -> Column:
    """Free-form JSON text in canonical form: keys sorted, strings canonical, whole numbers as integers.

    sort_arrays: arrays are multisets, at every depth.  Keys that become equal, numbers
    that are not finite and nesting beyond MAX_DEPTH raise.
    """

    @F.pandas_udf(StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical_json_text(t, sort_arrays))

    return canonical(text)


def json_projections(text: Column, *, sort_arrays: bool = False) -> Column:
    """A struct of faithful and canonical JSON, read once, and of fault: why there are none, one of FAULTS, where the other functions raise.

    Null text has three nulls.  One faulty text so costs its own row, not the whole query.
    """

    @F.pandas_udf("faithful string, canonical string, fault string")
    def projections(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([projected_json(t, sort_arrays) for t in texts], columns=["faithful", "canonical", "fault"], dtype=object)

    return projections(text)
