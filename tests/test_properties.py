"""Properties of rewriting, chunking and pseudonyms over generated inputs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from hushframe.functions import policy
from hushframe.operators import chunks
from hushframe.operators.fold import Options, Tape, cascade, mask_text

PARTS = st.sampled_from(["원고: 홍길동 ", "피고 김철수 ", "a.b@c.kr ", "010-1234-5678 ", "1234 5678 9012 3456", "주소: 서울시 중구 ", "대법원 ", "시행 총무과-12\n", "회사명: ", "\n", " ", "번지", "12", "[PHONE]", "목동 ", "x"])


@given(st.lists(PARTS, max_size=14).map("".join), st.sampled_from(["mixed", "legal"]))
@settings(max_examples=250, deadline=None)
def test_hits_point_at_their_source(text, profile):
    for tape in (cascade(text, Options(profile=profile)), mask_text(text, Options(profile=profile, keywords="x,12"))):
        assert len(tape.at) == len(tape.text) + 1 and tape.at[0] == 0 and tape.at[-1] == len(text)
        assert tape.at == sorted(tape.at)
        assert all(0 <= h.start < h.end <= len(text) for h in tape.hits)
        assert sum(tape.counts.values()) >= len(tape.hits)


@given(st.text(alphabet="abc", max_size=30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 5), st.text(alphabet="abXY", max_size=6)), max_size=4))
@settings(max_examples=200, deadline=None)
def test_edits_keep_positions(text, edits):
    tape, done, plain = Tape(text), [], []
    for start, size, new in sorted(edits):
        if start >= (done[-1][1] if done else 0) and start + size <= len(text) and size:
            done.append((start, start + size, new))
    at = 0
    for start, end, new in done:
        plain += [text[at:start], new]
        at = end
    tape.edit(done)
    assert tape.text == "".join([*plain, text[at:]]) and len(tape.at) == len(tape.text) + 1 and tape.at == sorted(tape.at)


@given(st.text(alphabet="ab \n.", max_size=200), st.integers(1, 50), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_chunks_cover(text, size, overlap):
    cut = chunks.by_lines(text, size)
    assert "".join(t for t, _ in cut) == text
    assert all(text[s : s + len(t)] == t for t, s in chunks.by_lines(text, size, overlap))
    seen = "".join(text[c["start"] : c["end"]] for c in chunks.context(text, max(size, 40), 0))
    assert re.sub(r"\s", "", seen) == re.sub(r"\s", "", text)


@given(st.lists(st.tuples(st.sampled_from(["NAME", "PHONE", "EMAIL", "COMPANY", "X"]), st.text(min_size=1, max_size=6)), max_size=40))
@settings(max_examples=60, deadline=None)
def test_pseudonyms_are_stable_and_distinct(values):
    names, given_ = policy.Pseudonyms(), {}
    for tag, value in values:
        given_[tag, value] = names.of(tag, value)
    for (tag, value), name in given_.items():
        assert names.of(tag, value) == name and policy.identity(name) != policy.identity(value)
    for tag in {t for t, _ in given_}:
        own = [policy.identity(n) for (t, _), n in given_.items() if t == tag]
        assert len(own) == len(set(own))
