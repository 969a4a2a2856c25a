"""Every query of the subpackage gives the rows of its SQL, or of plain Python, on the smallest tables."""

import hashlib
import html
import re
import zlib

import pytest

from hushframe.llm import html_text, pieces, queries, shards, url_rules
from tests.compare import same_rows
from tests.conftest import TABLES


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    same_rows(spark, queries.QUERIES[name], queries.SQL[name])


def rows(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{TABLES}/{name}.parquet").collect()]


def test_url_query(spark):
    """Host, path and fixed rule of every page by plain string work; the method's verdict follows the mined rule."""
    fixed = sorted(((r.host, r.path, r.verdict) for r in url_rules.FIXED), key=lambda r: -len(r[0] + r[1]))
    pages = {p["page_id"]: p["url"] for p in rows(spark, "pages")}
    got = url_rules.op1_url_rules(spark, TABLES).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        rest = (pages[r.page_id] or "").partition("://")[2]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].partition("?")[0].partition("#")[0]
        rule = next(((h + p, v) for h, p, v in fixed if (host == h or host.endswith("." + h)) and path.startswith(p)), None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == (rule[1] if rule else "block" if r.mined_rule else "allow")


def test_pieces_query(spark):
    sp = pieces.processor(pieces.default_model())
    texts = {d["doc_id"]: d["text"] or "" for d in rows(spark, "documents")}
    got = pieces.op4_sentencepiece(spark, TABLES).collect()
    assert len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_html_query(spark):
    """The tables' pages have one article of headings and paragraphs, some never closed."""
    pages = {p["page_id"]: p for p in rows(spark, "pages")}
    got = html_text.op6_html_text(spark, TABLES).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", pages[r.page_id]["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r["text"]) and r.url == pages[r.page_id]["url"]


def test_sharding_query(spark):
    texts = {d["doc_id"]: d["text"] for d in rows(spark, "documents")}
    got = shards.op7_sharding(spark, TABLES).collect()
    assert len(got) == len(texts) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    where = {}
    for r in got:
        body = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        assert where.setdefault(texts[r.doc_id], r["shard"]) == r["shard"]
    total = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(total) - min(total) <= 64
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
