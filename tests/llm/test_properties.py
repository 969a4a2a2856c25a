"""Properties over generated inputs: words, hashes, chunks, pages, partitions."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.llm import html_text, pieces, shards, substring, tokens, warc

TEXT = st.text(alphabet=st.sampled_from("ab\t \n\r\x0b\x0c\x00\x1c é한😀A▁"), max_size=60)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
@settings(max_examples=150, deadline=None)
def test_words_and_shingles(texts):
    data, at = tokens.binary(pa.array(texts, pa.string()))
    w = tokens.words(data, at)
    expected = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    got = [[w.data[a:b].tobytes() for a, b in zip(w.start[f:e], w.end[f:e], strict=True)] for f, e in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == expected
    same = {}
    for own, h in zip([x for row in expected for x in row], w.hash.tolist(), strict=True):
        assert same.setdefault(own, h) == h
    assert len(set(same.values())) == len(same)
    text, _ = tokens.shingles(w, 3)
    sets = [{tuple(x[i : i + 3]) for i in range(len(x) - 2)} if len(x) > 2 else {tuple(x)} - {()} for x in expected]
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(s) for s in sets]


@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=50), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_pieces_of_paths_cover_every_window_once(texts):
    w = tokens.words(*tokens.binary(pa.array([" ".join(t) for t in texts])))
    p = substring.pieces(w)
    starts = Counter(s + i for s, n in zip(p.start.tolist(), p.count.tolist(), strict=True) for i in range(n))
    windows = [f + i for f, n in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True) for i in range(n - 12)]
    assert starts == Counter(windows)


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_chunks_equal_the_library(text):
    table = pieces.ChunkTable(pieces.default_model())
    ids, ends = table.encode([text, "", text])
    assert ids.tolist() == table.sp.encode(text) * 2 and ends.tolist() == [len(ids) // 2, len(ids) // 2, len(ids)]


TAGS = st.sampled_from(["<p>", "</p>", "<div class='x'>", "</div>", "<b>", "</b>", "<br>", "<ul><li>", "</ul>", "<nav>", "</nav>", "<article>", "</article>", "<a href=\"x", "<!-- ", "-->", "<script>", "</script>", "<td>", "&amp;", "&#x41;", "<", ">", "\"", "text ", "more words ", "<p hidden>", "<img/>", "<svg/>", "<title>t</title>"])


@given(st.lists(TAGS, max_size=40))
@settings(max_examples=400, deadline=None)
def test_any_page_has_a_text(parts):
    text = html_text.main_text("".join(parts))
    assert all(b == b.strip() and b and "  " not in b for b in text.split("\n\n") if text)


@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_partitions_hold_every_group_once(sizes):
    sums, went = shards.difference([shards._single(s, 4) for s in sizes])
    assert sorted(sums) == sorted(sum(s for s, w in zip(sizes, went, strict=True) if w[-1] == k) for k in range(4))
    assert max(sums) - min(sums) <= max(sizes)


@given(st.binary(max_size=400), st.one_of(st.none(), st.text(max_size=20)), st.one_of(st.none(), st.integers(0, 9)))
@settings(max_examples=100, deadline=None)
def test_records_round_trip(payload, url, refers):
    import hashlib
    import zlib

    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    member = gz.compress(warc._record(7, url, payload, hashlib.sha1(payload).hexdigest(), len(payload), refers)) + gz.flush()
    got = warc.read_record(member)
    assert (got["page_id"], got["payload_bytes"], got["refers_to"]) == (7, len(payload), refers)
    assert got["payload"] == (payload if refers is None else None)
