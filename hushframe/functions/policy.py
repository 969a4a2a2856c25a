"""De-identification of single values: partial masks as columns, pseudonyms by a stable hash."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V

POLICIES = ("token", "partial", "pseudonym")


def token(tag: Column) -> Column:
    return F.concat(F.lit("["), tag, F.lit("]"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D+", "")


def partial(tag: Column, value: Column) -> Column:
    """The value with most of it hidden; too short a value becomes its token."""
    number, whole = digits(value), F.regexp_replace(value, r"(?U)\s+", "")
    local, domain = F.substring_index(value, "@", 1), F.expr("1")
    at = F.instr(value, "@")
    domain = F.substr(value, at + 1)
    region = F.regexp_extract(value, "(?Ud)" + V.ADDRESS_HEAD, 1)
    last = lambda n: F.right(number, F.lit(n))
    return (
        F.when((tag == "PHONE") & (F.length(number) >= 10), F.concat(F.left(number, F.lit(3)), F.lit("-****-"), last(4)))
        .when((tag == "EMAIL") & (at > 1) & (domain != ""), F.concat(F.left(local, F.lit(1)), F.lit("***@"), domain))
        .when(tag.isin(*V.PERSON_TAGS) & (whole != ""), F.concat(F.left(whole, F.lit(1)), F.lit("OO")))
        .when(tag.isin(*V.PERSON_TAGS), F.lit("[NAME]"))
        .when(tag.isin("ADDRESS", "REGION") & (region != ""), F.concat(region, F.lit(" ["), tag, F.lit("_DETAIL]")))
        .when((tag == "BUSINESS_REG_NO") & (F.length(number) >= 5), F.concat(F.lit("***-**-"), last(5)))
        .when((tag == "CARD") & (F.length(number) >= 4), F.concat(F.lit("****-****-****-"), last(4)))
        .when(tag.isin("COMPANY", "LAW_FIRM", "COURT") & (F.length(whole) >= 2), F.concat(F.left(whole, F.lit(1)), F.lit("**")))
        .otherwise(token(tag))
    )


def stable_index(tag: Column, value: Column, modulo: int) -> Column:
    """The first 8 bytes of the hash of tag, NUL and value, modulo a number."""
    digest = F.sha2(F.concat(tag, F.lit("\0"), value), 256)
    return F.pmod(F.conv(F.left(digest, F.lit(16)), 16, 10).cast("decimal(20,0)"), F.lit(modulo).cast("decimal(20,0)")).cast("int")


def stateless_pseudonym(tag: Column, value: Column) -> Column:
    """The first choice of ``Pseudonyms`` for a value, which needs no state but may repeat for two values."""
    n = stable_index(tag, value, 9000)
    name = F.array(*(F.lit(x) for x in V.NAME_POOL))[stable_index(tag, value, len(V.NAME_POOL))]
    firm = F.array(*(F.lit(x) for x in V.FIRM_POOL))[stable_index(tag, value, len(V.FIRM_POOL))]
    text = lambda c: c.cast("string")
    return (
        F.when(tag.isin(*V.PERSON_TAGS), name)
        .when(tag == "LAW_FIRM", firm)
        .when(tag == "PHONE", F.concat(F.lit("010-0000-"), text(n + 1000)))
        .when(tag == "EMAIL", F.concat(F.lit("user"), text(n + 1000), F.lit("@example.invalid")))
        .when(tag.isin("ADDRESS", "REGION"), F.concat(F.lit("서울특별시 중구 샘플로 "), text((n + 1000) % 300 + 1)))
        .when(tag == "COMPANY", F.concat(F.lit("주식회사 샘플"), text((n + 1000) % 100)))
        .otherwise(F.concat(F.lit("["), tag, F.lit("_"), text(n + 1000), F.lit("]")))
    )


def identity(value: str) -> str:
    """What makes two values the same for a reader."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", value).casefold())


def _index(tag: str, value: str, modulo: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{tag}\0{value}".encode()).digest()[:8], "big") % modulo


class Pseudonyms:
    """Pseudonyms of one run: a value keeps its own, no two values of a kind share one, none is its value."""

    def __init__(self) -> None:
        self.given: dict[tuple[str, str], str] = {}
        self.used: dict[str, set[str]] = {}

    def of(self, tag: str, value: str) -> str:
        kind = "PERSON" if tag in V.PERSON_TAGS else tag
        if (kind, value) not in self.given:
            used = self.used.setdefault(kind, set())
            taken = used | {identity(value)}
            choice = next(c for c in self._choices(tag, value) if identity(c) not in taken)
            self.given[kind, value] = choice
            used.add(identity(choice))
        return self.given[kind, value]

    def _choices(self, tag: str, value: str) -> Iterator[str]:
        n = _index(tag, value, 9000)
        if tag in V.PERSON_TAGS or tag == "LAW_FIRM":
            pool = V.FIRM_POOL if tag == "LAW_FIRM" else V.NAME_POOL
            first = _index(tag, value, len(pool))
            turned = [*pool[first:], *pool[:first]]
            yield from turned
            yield from _numbered(lambda i: f"{turned[i % len(pool)]}{2 + i // len(pool)}")
        elif tag == "PHONE":
            yield from _numbered(lambda i: f"010-{(n + i) // 9000:04d}-{(n + i) % 9000 + 1000:04d}")
        elif tag == "EMAIL":
            yield from _numbered(lambda i: f"user{n + 1000 + i}@example.invalid")
        elif tag in ("ADDRESS", "REGION"):
            yield from _numbered(lambda i: f"서울특별시 중구 샘플로 {(n + 1000) % 300 + 1 + i}")
        elif tag == "COMPANY":
            yield from _numbered(lambda i: f"주식회사 샘플{(n + 1000) % 100 + i}")
        else:
            yield from _numbered(lambda i: f"[{tag}_{n + 1000 + i}]")


def _numbered(make: Callable[[int], str]) -> Iterator[str]:
    i = 0
    while True:
        yield make(i)
        i += 1


def apply_policy(masked: str, hits: list[tuple[str, str]], policy: str, korean_tokens: bool = False, state: Pseudonyms | None = None) -> str:
    """Put the n-th value of each tag, transformed, in place of the tag's n-th token.

    ``hits`` are (tag, value) in the order found; unknown policies leave the tokens."""
    if policy not in POLICIES[1:]:
        return masked
    if korean_tokens:
        raise ValueError("korean_tokens requires token policy")
    left: dict[str, list[str]] = {}
    for tag, value in reversed(hits):
        left.setdefault(tag, []).append(value)
    state = state or Pseudonyms()

    def put(m: re.Match[str]) -> str:
        values = left.get(m[1])
        if not values:
            return m[0]
        return partial_value(m[1], values.pop()) if policy == "partial" else state.of(m[1], values.pop())

    return re.sub(r"\[([A-Z_]+)\]", put, masked)


def partial_value(tag: str, value: str) -> str:
    """``partial`` for one Python value."""
    number, whole = re.sub(r"\D+", "", value), "".join(value.split())
    local, _, domain = value.partition("@")
    if tag == "PHONE" and len(number) >= 10:
        return f"{number[:3]}-****-{number[-4:]}"
    if tag == "EMAIL" and local and domain:
        return f"{local[0]}***@{domain}"
    if tag in V.PERSON_TAGS:
        return whole[0] + "OO" if whole else "[NAME]"
    if tag in ("ADDRESS", "REGION") and (m := re.search(V.ADDRESS_HEAD, value)):
        return f"{m[1]} [{tag}_DETAIL]"
    if tag == "BUSINESS_REG_NO" and len(number) >= 5:
        return "***-**-" + number[-5:]
    if tag == "CARD" and len(number) >= 4:
        return "****-****-****-" + number[-4:]
    if tag in ("COMPANY", "LAW_FIRM", "COURT") and len(whole) >= 2:
        return whole[0] + "**"
    return f"[{tag}]"
