"""Every query gives DuckDB's rows on the smallest tables or, without SQL, those of plain Python."""

import hashlib
import itertools
import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from hushframe.functions import policy
from hushframe.operators import fold
from hushframe.plans import cases, catalogue, page_cases, small_cases
from tests.compare import same_rows
from tests.conftest import TABLES

ROOT = Path(__file__).resolve().parent.parent


ALL = catalogue.SQL | cases.SQL | small_cases.SQL | page_cases.SQL
QUERIES = catalogue.QUERIES | cases.QUERIES | small_cases.QUERIES | page_cases.QUERIES


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_sql(spark, name):
    same_rows(spark, QUERIES[name], ALL[name])


def test_merged_spans_equal_sql_with_nulls_fractions_empty_spans_and_ties(spark, tmp_path):
    rows = itertools.product((1, 2, None), ("A", None, "A", "R"), (10, 60, 13, None), (2.5, 0.0, 0.0, 3.5, 1.0, 1.0, None))
    schema = "l_orderkey long, l_returnflag string, l_partkey long, l_quantity double, l_linenumber int"
    table = spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], schema).toPandas().astype({"l_orderkey": "Int64", "l_partkey": "Int64", "l_linenumber": "int32"})
    table.to_parquet(tmp_path / "lineitem.parquet")
    for name in ("merged_spans", "spans_without_overlap"):
        same_rows(spark, QUERIES[name], ALL[name], str(tmp_path))


def test_mail_addresses_equal_sql_beside_numbers_labels_and_odd_spaces(spark, tmp_path):
    texts = [
        "Card 4598658187051326 fcotl.53@mail5.example.com, 010-1234-5678 a@b.com", "Contact x@y.org; e-mail u.v@w.net", "a@b.c_d@e.f@g.h.i@j.k", "a@b.c" + ".d" * 20_000,
        "x\vy@b.c", "x y@b.c", "x　@ b\t.\nc", "one two  three \r\n @ four . five", "[a@b.c]", "a@b@c.d", "a@b.c a@b.c\ta  @b.c", "._%+-@-.-", "é@b.c ß", "", None,
        *("".join(p) for p in itertools.product("a .@", repeat=6)),
    ]
    table = spark.createDataFrame([(i // 2, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").toPandas()
    table.to_parquet(tmp_path / "documents.parquet")
    same_rows(spark, QUERIES["pii_email_partial"], ALL["pii_email_partial"], str(tmp_path))


def test_queries_without_sql_are_the_ones_tested_below():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"pii_counts_by_tag", "masked_text_all_rules", "masked_text_pseudonyms", "keyword_masking", "masking_chunks", "matched_occurrences", "routed_segments"}
    assert set(cases.QUERIES) == set(cases.SQL) and set(small_cases.QUERIES) == set(small_cases.SQL) and set(page_cases.QUERIES) == set(page_cases.SQL)


#: The rules that can match a text without Hangul, restated without look-arounds on rewritten text: in order, each on what the
#: ones before left.
_GAP = "(?:[ \t\n\r\f\v]*[-‐‑‒–—―−－.][ \t\n\r\f\v]*|[ \t\n\r\f\v]+)?"
_SIX = r"\d(?:\s*\d){5}"
_SEP = "[-‐‑‒–—―−－.\\s]?"
PLAIN_RULES = [
    ("CARD", rf"(?<!\d)(?:\d{{4}}{_GAP}){{3}}\d{{4}}(?!\d)"),
    ("RRN", rf"(?<!\d){_SIX}{_GAP}[1-4](?:\s*\d){{6}}(?!\d)"),
    ("FOREIGN_REG", rf"(?<!\d){_SIX}{_GAP}[5-8](?:\s*\d){{6}}(?!\d)"),
    ("BUSINESS_REG_NO", rf"(?<!\d)\d{{3}}{_GAP}\d{{2}}{_GAP}\d{{5}}(?!\d)"),
    ("PHONE", rf"(?<![\d‐‑‒–—―−－-])(?:\+?82{_SEP})?0?1[016789]{_SEP}\d{{3,4}}{_SEP}\d{{4}}(?![\d‐‑‒–—―−－-])"),
    ("PHONE", rf"(?<![\d‐‑‒–—―−－-])\(?0(?:2|[3-6][1-5]|70|50\d)\)?{_SEP}\d{{3,4}}{_SEP}\d{{4}}(?![\d‐‑‒–—―−－-])"),
    ("PHONE", rf"(?<![\d‐‑‒–—―−－-])1[5-8]\d{{2}}{_SEP}\d{{4}}(?![\d‐‑‒–—―−－-])"),
    ("PASSPORT", r"(?<![A-Za-z0-9])(?:[MSRODmsrod]\d{8}|[A-Za-z]{2}\d{7})(?![A-Za-z0-9])"),
    ("EMAIL", r"(?<![A-Za-z0-9])(?!(?:[Ee]-?mail|[Cc]ontact)\s)[A-Za-z0-9._%+-]+(?:\s+[A-Za-z0-9._%+-]+)?\s*@\s*[A-Za-z0-9-]+(?:\s*\.\s*[A-Za-z0-9-]+)+"),
]


def brute_mask(text):
    """(masked text, [(tag, value)]) of a text without Hangul and without FAX labels."""
    hits = []
    for tag, pattern in PLAIN_RULES:
        def found(m, tag=tag):
            hits.append((tag, " ".join(m[0].split()).strip(" ,;:/")))
            return f"[{tag}]"

        text = re.sub(pattern, found, text)
    return text, hits


def plain_texts(spark):
    rows = {r.doc_id: r["text"] or "" for r in catalogue.docs(spark, TABLES).collect()}
    assert not any(re.search("[가-힣]|FAX", t, re.I) for t in rows.values())
    return rows


def test_masked_texts_and_counts_equal_plain_python(spark):
    texts = plain_texts(spark)
    brute = {i: brute_mask(t) for i, t in texts.items()}
    got = {r.doc_id: (r.masked_sha256, r.n_hits) for r in catalogue.QUERIES["masked_text_all_rules"](spark, TABLES).collect()}
    assert got == {i: (digest(masked), len(hits)) for i, (masked, hits) in brute.items()} and any(n for _, n in got.values())
    tags = Counter(tag for _, hits in brute.values() for tag, _ in hits)
    assert {r.tag: r.n for r in catalogue.QUERIES["pii_counts_by_tag"](spark, TABLES).collect()} == tags
    pseudonyms = Counter((r.doc_id, r.tag, r.pseudonym) for r in catalogue.QUERIES["masked_text_pseudonyms"](spark, TABLES).collect())
    assert pseudonyms == Counter((i, tag, policy.Pseudonyms().of(tag, value)) for i, (_, hits) in brute.items() for tag, value in hits)


def test_chunks_equal_plain_python(spark):
    expected = set()
    for i, text in plain_texts(spark).items():
        held, start, at, n = "", 0, 0, 0
        pieces = [line[k : k + 4000] for line in text.splitlines(keepends=True) for k in range(0, len(line), 4000)] if len(text) > 4000 else [text]
        lines = [len(line) for line in text.splitlines(keepends=True) for _ in range(0, len(line), 4000)] if len(text) > 4000 else [0]
        for piece, size in zip(pieces, lines, strict=True):
            if held and (size > 4000 or len(held) + len(piece) > 4000):
                expected.add((i, n, start, len(held)))
                held, start, n = "", at, n + 1
            held += piece
            at += len(piece)
            if size > 4000:
                expected.add((i, n, start, len(held)))
                held, start, n = "", at, n + 1
        if held or not text:
            expected.add((i, n, start, len(held)))
    assert {tuple(r) for r in catalogue.QUERIES["masking_chunks"](spark, TABLES).collect()} == expected


def test_matched_occurrences_equal_plain_python(spark):
    pages = defaultdict(lambda: ([], []))
    for r in catalogue.words(spark, TABLES).collect():
        pages[r.doc_id][r.flag != "N"].append((r.word_index, tuple(r.rect)))  # a number may be there twice: it is one thing

    def area(r):
        return max(0, r[2] - r[0]) * max(0, r[3] - r[1])

    def shared(a, b):
        return area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))

    expected = {}
    for doc, (gold, found) in pages.items():
        fits = defaultdict(set)
        for (g, a), (c, b) in itertools.product(gold, found):
            if shared(a, b) and (shared(a, b) / (area(a) + area(b) - shared(a, b)) >= 0.1 or shared(a, b) / area(a) >= 0.8):
                fits[g].add(c)
        holder = {}

        def place(g, seen):
            for c in fits[g]:
                if c not in seen:
                    seen.add(c)
                    if c not in holder or place(holder[c], seen):
                        holder[c] = g
                        return True
            return False

        matched = sum(place(g, set()) for g in list(fits))
        expected[doc] = (matched, len(found) - matched, len(gold) - matched, matched / len(gold) if gold else None)
    got = {r.doc_id: (r.tp, r.fp, r.fn, r.recall) for r in catalogue.QUERIES["matched_occurrences"](spark, TABLES).collect()}
    assert got == expected


def test_routed_segments_equal_plain_python(spark):
    """Without titles: a signal begins a document; a page with a number sequence goes on; one without evidence goes on
    where the next page with any is a sequence and the page before belonged; otherwise something unknown begins."""
    files = defaultdict(dict)
    for r in catalogue._pages(spark, TABLES).collect():
        files[str(r.doc_id)][r.page_index] = "A" if "approval" in r.start_signals else "R" if r.start_signals else "." if r.continuity_signals else " "
    expected = Counter()
    for doc, pages in files.items():
        marks = "".join(pages[i] for i in range(len(pages)))
        cuts, kind, sure, anchored = [], None, False, False
        for i, mark in enumerate(marks):
            if mark in "AR":
                kind, sure, anchored = ("internal_review" if mark == "A" else "official_dispatch"), True, True
                cuts.append((i, kind, "confirmed"))
            elif i and sure and (mark == "." or (anchored and marks[i + 1 :].lstrip(" ")[:1] == ".")):
                anchored = True
            elif not i or sure:
                kind, sure, anchored = "unknown", False, False
                cuts.append((i, kind, "review_required"))
        for (start, name, state), end in zip(cuts, [*(c[0] for c in cuts[1:]), len(marks)], strict=True):
            expected[doc, name, state, start, end - 1] += 1
    got = Counter((r.doc_id, r.kind, r.state, r.page_start, r.page_end) for r in catalogue.QUERIES["routed_segments"](spark, TABLES).collect())
    assert got == expected


TEXTS = {
    1: ("and then there, pour it", "[KEYWORD] then [KEYWORD], [KEYWORD] it"),
    2: ("and: a.b@c.org is there", "[KEYWORD]: [EMAIL] is [KEYWORD]"),
    3: ("pour 1234-5678-9012-3456 and 7 sand", "[KEYWORD] [CARD] [KEYWORD] 7 s[KEYWORD]"),
    4: ("and@there.org for 5", "[EMAIL] for 5"),
    5: ("", ""),
    6: (None, ""),
    7: ("plain, 1 @ all", "plain, 1 @ all"),
}


@pytest.fixture
def texts(spark, tmp_path):
    rows = [(i, t, "en", "x") for i, (t, _) in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_keyword_masking_of_all_documents(spark, texts):
    got = {r.doc_id: r.masked_sha256 for r in catalogue.QUERIES["keyword_masking"](spark, texts).collect()}
    assert got == {i: digest(masked) for i, (_, masked) in TEXTS.items()}


def test_keyword_masking_of_the_tables(spark):
    def brute(text):
        parts = re.split(r"(\[[A-Z_]+\])", fold.mask_text(text).text)
        return "".join(x if k % 2 else re.sub("there|pour|and", "[KEYWORD]", x) for k, x in enumerate(parts))

    rows = catalogue.docs(spark, TABLES).collect()
    got = {r.doc_id: r.masked_sha256 for r in catalogue.QUERIES["keyword_masking"](spark, TABLES).collect()}
    assert got == {r.doc_id: digest(brute(r["text"])) for r in rows} and len(got) == len(rows)
    assert any(re.search("[0-9@]", r["text"]) for r in rows)


MAIL = r"[A-Za-z0-9._%+-]+(?:\s+[A-Za-z0-9._%+-]+)?\s*@\s*[A-Za-z0-9-]+(?:\s*\.\s*[A-Za-z0-9-]+)+"


def test_masked_email_text_of_all_documents(spark, texts):
    rows = {r.doc_id: r.masked for r in catalogue.QUERIES["masked_email_text"](spark, texts).collect()}
    assert rows == {i: re.sub(MAIL, "[EMAIL]", t or "") for i, (t, _) in TEXTS.items()}
    assert rows[1] == TEXTS[1][0] and rows[2] == "and: [EMAIL] is there"
    tables = {r.doc_id: r["text"] for r in catalogue.docs(spark, TABLES).collect()}
    got = {r.doc_id: r.masked for r in catalogue.QUERIES["masked_email_text"](spark, TABLES).collect()}
    assert got == {i: re.sub(MAIL, "[EMAIL]", t or "") for i, t in tables.items()}


def test_pii_counts_of_all_tags(spark, texts):
    phone = [(8, "call 010-1234-5678 or 010-8765-4321", "en", "x")]
    spark.createDataFrame(phone, "doc_id long, text string, lang string, source string").write.mode("append").parquet(f"{texts}/documents.parquet")
    assert {r.tag: r.n for r in catalogue.QUERIES["pii_counts_by_tag"](spark, texts).collect()} == {"EMAIL": 2, "CARD": 1, "PHONE": 2}


def test_flagship(spark):
    assert catalogue.flagship(spark, TABLES).count() > 0


def test_entry_without_the_subpackage(tmp_path):
    """The entry point works when the training-data subpackage and the pipeline are not installed."""
    shutil.copytree(ROOT / "hushframe", tmp_path / "hushframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(x.startswith('op1_') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
