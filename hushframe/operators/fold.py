"""The recogniser cascade: rules rewrite a text one after another; every hit knows where it came from.

``Tape`` is the working text with the stretches of it that are the source's own and those that stand for a place in it.  A rule proposes edits
on the working text; the tape applies them and keeps the positions, so later rules see earlier tokens while
hits stay in source coordinates.  ``mask`` runs the cascade per document in Arrow batches: documents are
independent, so there is no shuffle, and whole documents are processed, so chunk seams cannot cut a value.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as V
from ..functions import validators as ok
from .rules import CITED_COURT, CITED_DOCKET, IN_ROW, PHONE, Rule, rules

OPTION_NAMES = (
    "rrn phone business_reg name address place legal_party company court case_title case_number law_firm attorney approval_line region_context doc_meta email"
).split()
HEADER_CHARS = 1200
_PARTICLE = "|".join(V.PARTICLES)


@dataclass(frozen=True)
class Options:
    """What to look for.  ``off`` names rule groups that are switched off."""

    profile: str = "mixed"
    off: frozenset[str] = frozenset()
    keywords: str | tuple[str, ...] = ""
    regions: str | tuple[str, ...] = ""
    korean_tokens: bool = False
    #: Also run the approval-line recognisers in public profiles; their hits are for review and stay visible.
    approvals: bool = False

    def __post_init__(self) -> None:
        if self.profile not in V.PROFILES:
            raise ValueError("MASKING_PROFILE_UNSUPPORTED")
        if unknown := self.off - set(OPTION_NAMES):
            raise ValueError(f"unknown rule groups: {sorted(unknown)}")


@dataclass(frozen=True)
class Hit:
    tag: str
    value: str
    start: int
    end: int
    action: str
    source: str


def action_of(tag: str) -> str:
    return "review" if tag in V.REVIEW_TAGS else "mask"


def source_of(tag: str) -> str:
    return V.TAGS.get(tag, ("", "regex"))[1]


def parse_terms(raw: str | Iterable[str] | None) -> list[str]:
    """User terms: parted by line, comma or semicolon; of two letters or more; once each; longest first."""
    parts = re.split(r"[\n,;]+", raw) if isinstance(raw, str) else list(raw or ())
    terms: dict[str, str] = {}
    for part in parts:
        term = " ".join(str(part).split())
        if len(term) > 1 and term[0] != "[" and term[-1] != "]":
            terms.setdefault(term.casefold(), term)
    return sorted(terms.values(), key=len, reverse=True)


class Places:
    """Where working positions come from: stretches of the text that are the source's own, or stand for a place in it.

    Each stretch is (working start, source start, own); it ends where the next one starts.  A stretch that is not the
    source's own stands, with every character, for the source position that it starts at."""

    def __init__(self, size: int) -> None:
        self.size, self.end = size, size
        self.starts, self.sources, self.own = ([0], [0], [True]) if size else ([], [], [])

    def at(self, i: int) -> int:
        """The source position of the boundary before working position ``i``."""
        if i >= self.size:
            return self.end
        k = bisect_right(self.starts, i) - 1
        return self.sources[k] + (i - self.starts[k] if self.own[k] else 0)

    def find(self, source: int) -> int | None:
        """The first boundary that stands for a source position."""
        k = bisect_left(self.sources, source)
        if k < len(self.sources) and self.sources[k] == source:
            return self.starts[k]
        if source == self.end:
            return self.size
        stop = self.starts[k] if k < len(self.starts) else self.size
        i = self.starts[k - 1] + source - self.sources[k - 1] if k else -1
        return i if k and self.own[k - 1] and i <= stop and self.at(i) == source else None

    def changed(self, parts: list[tuple[int, int, int, int, bool]], size: int) -> Places:
        """These places with stretches (start, end, new length, source, own) in place of start to end, in order; ``size``: the new one."""
        out, done, now = Places(0), 0, 0
        out.size, out.end = size, self.end
        for start, end, length, source, own in [*parts, (self.size, self.size, 0, self.end, True)]:
            now = out._copy(self, done, start, now)
            if length:
                out._add(now, source, own)
            now, done = now + length, end
        return out

    def _add(self, start: int, source: int, own: bool) -> None:
        goes_on = own and self.own and self.own[-1] and source - self.sources[-1] == start - self.starts[-1]
        if not goes_on:
            self.starts.append(start)
            self.sources.append(source)
            self.own.append(own)

    def _copy(self, old: Places, start: int, end: int, now: int) -> int:
        """Take over the old stretches from start to end; the working position after them."""
        k = max(bisect_right(old.starts, start) - 1, 0)
        while start < end:
            stop = min(end, old.starts[k + 1] if k + 1 < len(old.starts) else old.size)
            self._add(now, old.at(start), old.own[k])
            now, start, k = now + stop - start, stop, k + 1
        return now


@dataclass
class Tape:
    """A text under rewriting, and where its characters come from."""

    source: str
    text: str = ""
    hits: list[Hit] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.text, self.places = self.source, Places(len(self.source))

    @property
    def at(self) -> list[int]:
        """The source position of the boundary before each working position, and of the end."""
        return [self.places.at(i) for i in range(len(self.text) + 1)]

    def note(self, tag: str, start: int, end: int) -> None:
        """Count a value at a working span, and keep it as a hit if its source is worth one."""
        self.counts[tag] = self.counts.get(tag, 0) + 1
        start, end = self.places.at(start), self.places.at(end)
        value = ok.clean(self.source[start:end])
        if len(value) > 1 and value[0] != "[" and value[-1] != "]":
            self.hits.append(Hit(tag, value, start, end, action_of(tag), source_of(tag)))

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace working spans (in order, apart) by strings; what old and new share at either end stays put."""
        if not edits:
            return
        text, parts, done = [], [], 0
        for start, end, new in edits:
            old = self.text[start:end]
            if old == new:
                continue
            shared = min(len(old), len(new))
            head = next((i for i in range(shared) if old[i] != new[i]), shared)
            tail = next((i for i in range(shared - head) if old[-1 - i] != new[-1 - i]), shared - head)
            start, end, new = start + head, end - tail, new[head : len(new) - tail]
            text += [self.text[done:start], new]
            parts.append((start, end, len(new), self.places.at(start), False))
            done = end
        self.text = "".join([*text, self.text[done:]])
        self.places = self.places.changed(parts, len(self.text))


def _spans(pattern: re.Pattern[str], text: str) -> list[tuple[int, int]]:
    return [m.span("kept") for m in pattern.finditer(text)]


def _apply(tape: Tape, rule: Rule) -> None:
    if rule.kind == "parties":
        _spread_parties(tape)
        return
    if any(p is not None and p.search(tape.text) is None for p in (rule.needs, rule.near)):
        return
    token, edits = f"[{rule.tag}]", []
    has_value = "value" in rule.pattern.groupindex
    cited = _spans(CITED_COURT, tape.text) if rule.kind == "court" else _spans(CITED_DOCKET, tape.text) if rule.kind == "docket" else []
    # a header rule sees the text as if it ended there
    for m in rule.pattern.finditer(tape.text[:HEADER_CHARS] if rule.kind == "header" else tape.text):
        start, end = m.span("value") if has_value else m.span()
        value = tape.text[start:end]
        if any(s < end and start < e for s, e in cited):
            continue
        if rule.guard is not None and (ok.has_token(value) or not rule.guard(value)):
            continue
        if rule.kind == "court" and not ok.verdict("court", value, tape.text, start, end):
            continue
        if rule.kind == "signers":
            names = [(start + n.start("value"), start + n.end("value")) for n in IN_ROW.finditer(value)]
            for s, e in names:
                if ok.verdict("name_in_text", tape.text[s:e], tape.text, s, e):
                    tape.note(rule.tag, s, e)
                    edits.append((s, e, token))
            continue
        if rule.kind in ("signer", "below") and not ok.verdict("name_in_text", value, tape.text, start, end):
            continue
        if rule.kind == "phones":
            numbers = list(PHONE.finditer(value))
            for n in numbers:
                tape.note(rule.tag, start + n.start(), start + n.end())
            if numbers:
                edits.append((m.start(), m.end(), m["label"] + token * len(numbers)))
            continue
        tape.note(rule.tag, start, end)
        if rule.kind == "whole" or rule.kind == "court":
            edits.append((m.start(), m.end(), token))
        elif rule.kind == "titled":
            edits.append((m.start(), m.end(), f"{m['label']} {token}"))
        elif rule.kind in ("signer", "below"):
            edits.append((start, end, token))
        elif rule.kind != "noted":
            edits.append((m.start(), m.end(), m["label"] + token))
    tape.edit(edits)


def _spread_parties(tape: Tape) -> None:
    """Mask the party names found so far wherever they stand; two-letter names only at word borders."""
    names = {h.value for h in tape.hits if h.tag == "LEGAL_PARTY"}
    for name in sorted(names, key=lambda n: (-len(n), n)):
        body = re.escape(name)
        if len(name) < 3:
            body = rf"(?<![가-힣]){body}(?=(?:{_PARTICLE})(?![가-힣])|[^가-힣]|$)"
        edits = []
        for m in re.finditer(body, tape.text):
            tape.note("LEGAL_PARTY", *m.span())
            edits.append((*m.span(), "[LEGAL_PARTY]"))
        tape.edit(edits)


def _terms(tape: Tape, terms: list[str], tag: str, token: str) -> None:
    """Mask literal terms, longest first, but not inside tokens.

    Tokens are known before the first term; what one term puts in, a later one may meet again."""
    if not terms:
        return
    plain, done = [], 0
    for m in [*ok.TOKEN.finditer(tape.text), None]:
        end = m.start() if m else len(tape.text)
        if end > done:
            plain.append([done, end])
        done = m.end() if m else end
    for term in terms:
        edits, shift = [], 0
        for stretch in plain:
            begin, end = stretch
            found = [m.span() for m in re.finditer(re.escape(term), tape.text[begin:end])]
            stretch[0] += shift
            for s, e in found:
                tape.note(tag, begin + s, begin + e)
                edits.append((begin + s, begin + e, token))
                shift += len(token) - (e - s)
            stretch[1] += shift
        tape.edit(edits)


def _restore(tape: Tape, hits: list[Hit]) -> None:
    """Put source text back for hits that are not masked; hits that overlap are put back together.

    The text is made anew once."""
    text, parts, done, reach = [], [], 0, -1
    for h in sorted(hits, key=lambda h: (h.start, -h.end)):
        if h.end <= h.start:
            raise ValueError("source_boundary_invalid")
        if h.end <= reach:
            continue
        # one that goes on from the hit before begins where that one ended
        first, start = (reach, done) if h.start < reach else (h.start, tape.places.find(h.start))
        end = tape.places.find(h.end)
        if start is None or end is None:
            raise ValueError("source_boundary_missing")
        text += [tape.text[done:start], tape.source[first : h.end]]
        parts.append((start, end, h.end - first, first, True))
        done, reach = end, h.end
    tape.text = "".join([*text, tape.text[done:]])
    tape.places = tape.places.changed(parts, len(tape.text))


def cascade(text: str, options: Options = Options()) -> Tape:
    """All rules of the profile over a text, before any restoring."""
    tape = Tape(text)
    for rule in rules():
        if options.profile in rule.profiles and rule.option not in options.off and (options.approvals or rule.option != "approval_line"):
            _apply(tape, rule)
    return tape


def mask_text(text: str, options: Options = Options()) -> Tape:
    """The cascade, user terms, and in public profiles the source text of hits that are for review."""
    tape = cascade(text, options)
    names = V.KOREAN if options.korean_tokens else {}
    if names:
        for tag, name in names.items():
            tape.edit([(*m.span(), f"[{name}]") for m in re.finditer(re.escape(f"[{tag}]"), tape.text)])
    _terms(tape, parse_terms(options.keywords), "KEYWORD", f"[{names.get('KEYWORD', 'KEYWORD')}]")
    _terms(tape, parse_terms(options.regions), "REGION", f"[{names.get('REGION', 'REGION')}]")
    if options.profile == "legal":
        tape.hits = [Hit(h.tag, h.value, h.start, h.end, "mask", h.source) for h in tape.hits]
    # what signs is authorised by its place on the page, never by text alone
    tape.hits = [replace(h, action="review") if h.tag in ("APPROVAL_LINE", "APPROVAL_FLOW") else h for h in tape.hits]
    _restore(tape, [h for h in tape.hits if h.action != "mask"])
    return tape


HIT = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("action", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
_ARROW_HIT = pa.struct([("tag", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("action", pa.string()), ("source", pa.string())])
_ARROW_COUNT = pa.map_(pa.string(), pa.int64())


def _masker(options: Options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, counts, hits = [], [], []
                for t in part.column(0).to_pylist():  # a tape is let go before the next one is made
                    tape = mask_text(t, options) if t else Tape("")
                    texts.append(tape.text)
                    counts.append(list(tape.counts.items()))
                    hits.append([h.__dict__ for h in sorted(tape.hits, key=lambda h: (h.start, h.end, h.tag, h.value))])
                columns = [pa.array(texts, pa.string()), pa.array(counts, _ARROW_COUNT), pa.array(hits, pa.list_(_ARROW_HIT))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*part.schema.names[1:], "masked", "counts", "hits"])

    return run


def mask(docs: DataFrame, options: Options = Options(), text: str = "text") -> DataFrame:
    """The input's other columns with ``masked``, ``counts`` (by tag) and ``hits`` in order of place.

    A null text is the empty text.  Columns of those three names are replaced."""
    keep = [c for c in docs.columns if c not in (text, "masked", "counts", "hits")]
    rows = docs.select(F.col(text).alias("_text"), *keep)
    added = [
        T.StructField("masked", T.StringType()),
        T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("hits", T.ArrayType(HIT)),
    ]
    return rows.mapInArrow(_masker(options), T.StructType([*(rows.schema[c] for c in keep), *added]))


def matches(masked: DataFrame, *keys: str) -> DataFrame:
    """One row per hit, with the key columns."""
    return masked.select(*keys, F.inline("hits"))


def counts_by_tag(masked: DataFrame, *keys: str) -> DataFrame:
    """Counts by tag and the key columns."""
    return masked.select(*keys, F.explode("counts").alias("tag", "n")).groupBy(*keys, "tag").agg(F.sum("n").alias("n"))
