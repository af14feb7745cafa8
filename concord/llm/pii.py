"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
_ORDER = {k: i for i, k in enumerate(KINDS)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What the base patterns don't have: addresses spelt out, numbers without a plus, and quoted or assigned keys.
_SPELT = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,63}){1,3}(?!\w)")
_NUMBER = re.compile(r"(?<![\w+.(-])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\w-])")
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,128}(?![A-Za-z0-9+/_-])")
#: How keys of some well-known services begin; fixed values.
_ISSUED = re.compile(r"gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_live_|rk_live_|xox[abprs]-|AKIA|ASIA|AIza|ya29|eyJ|hf_|npm_|dop_v1_")
#: Gazetteers, fixed values: endings of mail domains, card issuers' first digits, countries' dialling codes, words that go with each kind.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro io co ai app dev cloud tech online site shop blog xyz me tv cc example test "
    "ac ad ae ar at au be bg br by ca ch cl cn cy cz de dk ee eg es eu fi fr gr hk hr hu id ie il in ir is it jp ke kr li lt lu lv ma mt mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us uy ve vn za".split()
)
ISSUERS = ("34", "37", "36", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "64", "65", "35", "22", "23", "24", "25", "26", "27")
DIALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split())
CUES = {
    "email": ("mail", "contact", "write", "reach", "send", "from", "to:", "schreib", "correo", "courriel", "@"),
    "ip": ("ip", "host", "server", "address", "addr", "ssh", "ping", "client", "peer", "node", "login"),
    "card": ("card", "visa", "master", "amex", "credit", "debit", "iban", "pay", "karte", "tarjeta", "carte", "number", "no."),
    "phone": ("call", "phone", "tel", "fax", "mobile", "ruf", "cell", "sms", "text me", "whatsapp", "handy", "móvil", "portable"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "session", "cookie", "sign", "clave", "schlüssel", "clé"),
}
_COMMON = ("rev", "commit", "sha", "md5", "digest", "version", "checksum", "hash")
N_LABELERS = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str, has_digit: bool = True) -> list[tuple[int, int, str]]:
    """Spans of the four base patterns, leftmost and not overlapping within a kind; what fails its condition is dropped."""
    out = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            at = start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                out.append((start, end, "email"))
    if has_digit:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[2]]))


def further_spans(text: str, has_digit: bool, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates beside the base spans; none overlaps those."""
    found = []
    if " at " in text or "[at]" in text or "(at)" in text:
        found += [(m.start(), m.end(), "email") for m in _SPELT.finditer(text)]
    if has_digit:
        found += [(m.start(), m.end(), "phone") for m in _NUMBER.finditer(text)]
        found += [(m.start(), m.end(), "secret") for m in _KEY.finditer(text) if any("0" <= c <= "9" for c in m[0]) and any(c.isalpha() for c in m[0])]
    # base spans come by start; of those that begin before a span's end the one that goes furthest decides
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, b, _ in base), max))
    before = ((s, bisect_left(starts, s[1])) for s in found)
    return [s for s, n in before if not n or reach[n - 1] <= s[0]]


def entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def votes(text: str, start: int, end: int, kind: str, is_base: bool) -> tuple[int, ...]:
    """Five labelers: pattern, gazetteer, cue words before, form of the span, surroundings. 1: personal, -1: not, 0: no opinion."""
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = "".join(c for c in span if "0" <= c <= "9")
    # a hexadecimal key looks like any digest, so its pattern says nothing
    pattern = 1 if is_base else {"secret": 1 if _ISSUED.match(span) else 0, "phone": 1, "email": 0}[kind]
    if kind == "email":
        listed = 1 if re.split(r"[^a-z0-9-]+", span.lower())[-1] in TOP_DOMAINS else -1
        form = 1 if is_base else -1 if re.search(r"[A-Za-z] at [A-Za-z]", span) and not re.search(r" dot |[\[(]", span) else 0
    elif kind == "ip":
        listed = -1 if digits.startswith("0") or span.startswith(("0.", "255.")) else 0
        form = -1 if re.search(r"(version|v|section|§)\W*$", before) else 1
    elif kind == "card":
        listed = 1 if digits.startswith(ISSUERS) else -1
        form = 1 if len(digits) in (15, 16) else -1
    elif kind == "phone":
        listed = 1 if not span.startswith("+") or any(digits[:n] in DIALLING for n in (1, 2, 3)) else -1
        form = 1 if re.search(r"[ ().-]", span) else 0
    else:
        listed = -1 if any(w in before[-16:] for w in _COMMON) else 0
        form = 0 if entropy(span) >= 3.2 and len(digits) >= 4 else -1
    cue = 1 if any(w in before[-24:] for w in CUES[kind]) else 0
    after = text[end : end + 1]
    clean = (start == 0 or not text[start - 1].isalnum()) and (not after or not after.isalnum())
    quoted = kind == "secret" and start > 0 and text[start - 1] in "\"'`=:" and (not after or after in "\"'`;,\n")
    around = 1 if quoted or (clean and kind != "secret") else -1 if not clean else 0
    return pattern, listed, cue, form, around


def features(kind: str, vote: tuple[int, ...], length: int, is_base: bool) -> np.ndarray:
    """Votes for and against, kind, and the span's length, for the span classifier."""
    x = np.zeros(2 * N_LABELERS + len(KINDS) + 3)
    for i, v in enumerate(vote):
        x[2 * i + (v < 0)] = abs(v)
    x[2 * N_LABELERS + _ORDER[kind]] = 1
    x[-3:] = min(length, 64) / 64, is_base, 1
    return x


def reliabilities(patterns: list[tuple], counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of each vote pattern being personal data, by expectation-maximisation over labelers' confusion rates, kind by kind.

    patterns: (kind, votes, length, is_base).  Starts from the majority of votes; priors that smooth the
    rates hold labelers to be better than chance.
    """
    post = np.array([1 / (1 + math.exp(-1.5 * sum(v))) for _, v, _, _ in patterns])
    for kind in KINDS:
        own = [i for i, p in enumerate(patterns) if p[0] == kind]
        if not own:
            continue
        vote = np.array([patterns[i][1] for i in own])
        n, p = counts[own].astype(float), post[own]
        for _ in range(rounds):
            share = np.clip((n @ p + 2) / (n.sum() + 4), 0.02, 0.98)
            log = np.tile(np.log([share, 1 - share]), (len(own), 1))
            for j in range(N_LABELERS):
                for c, weight in enumerate((p, 1 - p)):
                    # pseudo-counts: right votes 4, wrong votes 1, no opinion 2
                    rate = {v: (n @ (weight * (vote[:, j] == v)) + (4 if v == 1 - 2 * c else 1 if v else 2)) for v in (-1, 0, 1)}
                    total = sum(rate.values())
                    log[:, c] += np.log([rate[int(v)] / total for v in vote[:, j]])
            new = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
            if np.abs(new - p).max() < 1e-6:
                break
            p = new
        post[own] = p
    return post


def span_classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Logistic regression on posteriors, by Newton steps; a pattern weighs the logarithm of how often it occurs."""
    weight, w = np.log1p(counts), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (target - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _digits(texts: list[str]) -> list[bool]:
    return [bool(_DIGIT.search(t)) for t in texts]


_DIGIT = re.compile("[0-9]")


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.8) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 of the base spans, spans (base and added), n_added, n_spans (all), for every row.

    Candidates are the base spans and further ones: addresses spelt out, numbers
    without a plus, keys.  Five labelers vote on each from its pattern, gazetteers,
    cue words before it, its form and its surroundings.  All documents' candidates are
    counted by kind, votes and length step; from these counts (a few thousand rows at
    most, as votes have 3 values) expectation-maximisation estimates how reliable each
    labeler is for each kind, and a logistic span classifier is trained on the
    posteriors.  It decides on further candidates; base spans always stay.
    Whole texts are read twice, and nothing but the counts is shuffled.

    Offsets are code points, ends exclusive; spans are written kind:start:end, by start,
    then kind, with commas between.  Null and empty texts have no spans (sha256 of nothing).
    Repeated rows are reported one by one; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for text, digit in zip(texts, _digits(texts), strict=True):
                base = base_spans(text, digit)
                for spans, is_base in ((base, True), (further_spans(text, digit, base), False)):
                    for a, b, kind in spans:
                        seen[(kind, votes(text, a, b, kind, is_base), min((b - a) // 8 * 8, 64), is_base)] += 1
        rows = list(seen)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([r[0] for r in rows], pa.string()), "votes": pa.array([list(r[1]) for r in rows], pa.list_(pa.int32())),
            "length": pa.array([r[2] for r in rows], pa.int32()), "base": pa.array([r[3] for r in rows], pa.bool_()), "n": pa.array([seen[r] for r in rows], pa.int64()),
        })

    counted = slim.select("_text").mapInArrow(count, "kind string, votes array<int>, length int, base boolean, n long")
    table = sorted(((r["kind"], tuple(r["votes"]), r["length"], r["base"]), r["n"]) for r in counted.groupBy("kind", "votes", "length", "base").agg(F.sum("n").alias("n")).collect())
    weights = None
    if table:
        patterns, n = [p for p, _ in table], np.array([c for _, c in table])
        weights = span_classifier(np.array([features(*p) for p in patterns]), reliabilities(patterns, n), n)

    def write(spans):
        return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _ORDER[s[2]], s[1])))

    def find(batches):
        known: dict[tuple, bool] = {}
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            out = {k: [] for k in ("email", "ip", "card", "phone", "sha", "spans", "added", "all")}
            for text, digit in zip(texts, _digits(texts), strict=True):
                base = base_spans(text, digit)
                added = []
                for a, b, kind in further_spans(text, digit, base):
                    p = (kind, votes(text, a, b, kind, False), min((b - a) // 8 * 8, 64), False)
                    if p not in known:
                        known[p] = weights is not None and 1 / (1 + math.exp(-float(features(*p) @ weights))) >= accept
                    if known[p]:
                        added.append((a, b, kind))
                for k in ("email", "ip", "card", "phone"):
                    out[k].append(sum(s[2] == k for s in base))
                out["sha"].append(hashlib.sha256(write(base).encode()).hexdigest())
                out["spans"].append(write(base + added))
                out["added"].append(len(added))
                out["all"].append(len(base) + len(added))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *(pa.array(out[k], pa.int64()) for k in ("email", "ip", "card", "phone")), pa.array(out["sha"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["added"], pa.int64()), pa.array(out["all"], pa.int64())],
                [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"],
            )

    return slim.mapInArrow(find, f"{id_col} {dict(slim.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")
