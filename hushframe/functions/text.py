"""String and hash functions as columns, and Arrow functions for what the JVM lacks."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: How deep nested metadata is kept.
METADATA_DEPTH = 8


def clean(value: Column) -> Column:
    """White space collapsed, outer separators taken off."""
    return F.btrim(F.regexp_replace(value, r"(?U)\s+", " "), F.lit(" ,;:/"))


def compact(value: Column) -> Column:
    """Without white space and separators, in lower case."""
    return F.lower(F.regexp_replace(value, r"(?U)[\s,;:/·.\-()\[\]]+", ""))


def plain_dashes(value: Column) -> Column:
    """Dashes of all kinds as hyphens, without white space and zero-width characters."""
    dashes = "‐‑‒–—―−－"
    return F.regexp_replace(F.translate(value, dashes, "-" * len(dashes)), "(?U)[\\s​‌‍﻿]+", "")


def inside_token(text: Column, start: Column, end: Column) -> Column:
    """Whether a span (0-based) lies inside a larger run of letters and digits."""
    before, after = F.substr(text, start, F.lit(1)), F.substr(text, end + 1, F.lit(1))
    return ((start > 0) & before.rlike(r"(?U)^[\p{L}\p{Nd}]$")) | after.rlike(r"(?U)^[\p{L}\p{Nd}]$")


def quoted(text: Column, start: Column, end: Column, radius: int = 80) -> Column:
    """Whether an opened quote before a span closes after it, within ``radius`` characters on each side."""
    before = F.substr(text, F.greatest(start - radius, F.lit(0)) + 1, F.least(start, F.lit(radius)))
    after = F.substr(text, end + 1, F.lit(radius))
    found = F.lit(False)
    for opening, closing in ("“”", "‘’", "「」", "『』", '""'):
        last_open = F.length(before) - F.coalesce(F.instr(F.reverse(before), opening), F.lit(0))
        has = F.instr(before, opening) > 0
        reopened = F.lit(False) if opening == closing else F.instr(F.substr(before, last_open + 2), closing) > 0
        odd = F.pmod(F.length(before) - F.length(F.replace(before, F.lit(opening), F.lit(""))), F.lit(2)) == 1 if opening == closing else F.lit(True)
        found = found | (has & ~reopened & odd & (F.instr(after, closing) > 0))
    return found


def page_number(text: Column) -> Column:
    """The page number that a footer line consists of: 3, - 3 -, 3/10, 3쪽."""
    n = F.regexp_extract(F.trim(text), r"^[-–—]?\s*(\d{1,4})\s*(?:[-–—]|쪽|/\s*\d{1,4})?$", 1)
    return F.when(n != "", n.cast("int"))


def canonical_hash(*parts: Column) -> Column:
    """Hash of a JSON array of the parts, for identities."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 256)


def yes_or_no(answer: Column) -> Column:
    """A model's verdict: the first line that gives one, else the first word that does; null without any."""
    upper = F.upper(F.coalesce(answer, F.lit("")))
    line = F.regexp_extract(upper, r"(?m)^[ \t]*(?:FINAL\s+ANSWER|ANSWER|RESULT|DECISION|판정|결론)?\s*[:\-]?\s*(YES|NO)\b", 1)
    word = F.regexp_extract(upper, r"\b(YES|NO)\b", 1)
    verdict = F.when(line != "", line).otherwise(word)
    return F.when(verdict != "", verdict == "YES")


def evidence(code: Column, kinds: dict[str, str]) -> Column:
    """The first kind whose prefix a code has."""
    found = F.lit(None).cast("string")
    for prefix, kind in reversed(kinds.items()):
        found = F.when(code.startswith(prefix), F.lit(kind)).otherwise(found)
    return found


def safe_codes(codes: Column, allowed: list[str], most: int = 16) -> Column:
    """Known codes, once each, at most so many."""
    return F.slice(F.array_distinct(F.array_intersect(codes, F.array(*(F.lit(a) for a in allowed)))), 1, most)


def without_values(line: Column) -> Column:
    """A log line with what follows a key hidden."""
    return F.regexp_replace(line, r"(?U)(\b(?:value|text|preview|name|content)\s*[:=]\s*)\S.*$", "$1[REDACTED]")


def nfkc_fold(value: Column) -> Column:
    """NFKC and case folding; in Arrow batches, as the JVM has neither."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(value)


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Keyed hash of a value, natively: two nested hashes over padded keys, as HMAC is defined."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in block)) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def hmac_reference(value: str, key: bytes) -> str:
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()


def bounded(value: Column, otherwise: int, least: int) -> Column:
    """An option that must not be under a least value: what stands in for it if it is, or is null."""
    return F.when(value >= least, value).otherwise(F.lit(otherwise))


def _canonical(value: object, depth: int = 0) -> object:
    if depth > METADATA_DEPTH:
        return None
    if isinstance(value, dict):
        return {k: _canonical(v, depth + 1) for k, v in sorted(value.items())}
    if isinstance(value, list):
        return [_canonical(v, depth + 1) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def canonical_metadata(document: Column) -> Column:
    """Nested metadata, as JSON text, with keys in order, no spaces, nulls for numbers that are not finite and for what lies deeper than
    ``METADATA_DEPTH``; null for what is no JSON.  In Arrow batches, as the JVM has no type for it."""

    def run(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                out.append(None if v is None else json.dumps(_canonical(json.loads(v)), separators=(",", ":"), ensure_ascii=False, sort_keys=True))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(document)


def aligned(text: Column) -> Column:
    """(text, offsets): white space as single spaces, none at either end, and the place in the source of each character."""
    letters = F.filter(
        F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.cast("int").alias("i"))), lambda x: x["c"] != ""
    )
    blank = lambda c: c.rlike(r"(?U)^\s$")
    kept = F.filter(F.transform(letters, lambda x, i: F.struct(x["c"].alias("c"), x["i"].alias("i"), F.get(letters, i - 1)["c"].alias("b"))), lambda x: ~blank(x["c"]) | ~F.coalesce(blank(x["b"]), F.lit(True)))
    n = F.size(kept)
    ends = F.coalesce(blank(F.get(kept, n - 1)["c"]), F.lit(False))
    kept = F.slice(kept, 1, F.when(ends, n - 1).otherwise(n))
    plain = F.array_join(F.transform(kept, lambda x: F.when(blank(x["c"]), " ").otherwise(x["c"])), "")
    return F.struct(plain.alias("text"), F.transform(kept, lambda x: x["i"]).alias("offsets"))
