"""Operators on documents against brute force: edge cases, ties, repeats, clashing names, planted copies."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from hushframe.llm import containment, lines, near_dup, pieces, quality, shards, substring

SCHEMA = "doc_id long, text string, lang string, n_words long, kept string, removed string, _id long, _key string, text_hash string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=1):
    """Small documents: copies, near copies, shared passages and lines, junk, empty and null texts, one long one."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "É", "한국", "a"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, lines3 = say(40), "\n".join(say(9) for _ in range(3))
    base = say(80).split()
    texts = [None, "", "  \n\t ", "one", "One  two\tthree", "one two three four five", say(12), say(13), say(13)]
    texts += [passage, passage.upper(), passage + " " + say(20), say(7) + " " + passage, lines3, lines3 + "\n" + say(5), say(4) + "\n\n" + lines3.replace("\n", "\n\n", 1)]
    texts += [" ".join(base)] * 3
    for _ in range(12):
        copy = list(base)
        for _ in range(r.choice([1, 1, 2, 5, 14])):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [say(r.randrange(1, 60)) for _ in range(30)] + ["x " * 300, "y\n" * 50, say(6000) + " " + passage, "### $$ ** word " * 10]
    ids = list(range(0, 2 * len(texts), 2))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, "k", "r", 5, "x", "h") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


# --- quality ---

def brute_metrics(text):
    text = text or ""
    w = words(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = defaultdict(list)
    for i, x in enumerate(wins):
        seen[x].append(i)
    covered = {j for x in seen.values() if len(x) > 1 for i in x for j in range(i, i + 5)}
    full = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


def test_quality_metrics(docs):
    for row in quality.judge(docs).collect():
        n = brute_metrics(row["text"])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == n
        assert row.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert row.kept == (row.broken == "") and row["removed"] == "r"


def test_quality_keeps_columns_and_empty_tables(docs):
    assert quality.accept(docs).columns == docs.columns
    assert quality.accept(docs.limit(0)).count() == 0


# --- line dedup ---

def brute_lines(rows):
    order = sorted(((i if i is not None else 1 << 63, k), t) for k, (i, t) in enumerate(rows))
    seen, out = set(), {}
    where = {}
    for (i, k), t in order:
        if t is None:
            out[k] = None
            continue
        all_lines = t.split("\n")
        full = [j for j, x in enumerate(all_lines) if words(x)]
        gone = set()
        for j in range(len(full) - 2):
            window = tuple(all_lines[x] for x in full[j : j + 3])
            if window in seen:
                gone.update(full[j : j + 3])
            seen.add(window)
        out[k] = "\n".join(x for j, x in enumerate(all_lines) if j not in gone)
        where[k] = i
    return out


def test_line_dedup(spark):
    rows = corpus()
    expected = brute_lines(rows)
    got = {r.doc_id: r["text"] for r in lines.clean(frame(spark, rows)).collect()}
    assert got == {i: expected[k] for k, (i, _) in enumerate(rows)}
    assert any(expected[k] != t for k, (_, t) in enumerate(rows))


def test_line_dedup_edges(spark):
    text = "a b\nc d\ne f"
    rows = [(None, text), (3, text), (3, text), (9, text + "\ng h"), (1, None)]
    got = sorted(((r.doc_id, r["text"]) for r in lines.clean(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, ""), (3, text), (3, text), (9, "g h"), (1, None)], key=str)
    cleaned = lines.clean(frame(spark, rows))
    assert cleaned.columns == frame(spark, rows).columns and lines.clean(frame(spark, []).limit(0)).count() == 0


# --- substring dedup ---

def brute_substring(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for j in range(len(w) - 12):
                k = tuple(w[j : j + 13])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {x for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for x in range(j, j + 13)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_dedup(spark, seed):
    rows = corpus(seed)
    got = substring.dedup(frame(spark, rows)).collect()
    expected = brute_substring(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == expected
    assert sum(n for _, _, n, _ in expected) > 100 and got[0]["removed"] == "r"


def test_substring_dedup_edges(spark):
    r = random.Random(5)
    long = " ".join(str(r.randrange(1000)) for _ in range(40))
    rows = [(None, long), (4, long), (4, long), (4, "z " + long), (6, long + " tail"), (2, " ".join(long.split()[5:18])), (1, None), (0, "")]
    got = substring.dedup(frame(spark, rows)).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got), key=str) == brute_substring(rows)
    assert substring.dedup(frame(spark, []).limit(0)).count() == 0


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_long_words_that_fool_polynomials_stay_apart(spark):
    a, b = thue_morse(10)
    rest = " ".join(f"w{i}" for i in range(12))
    got = {x.doc_id: x.n_removed for x in substring.dedup(frame(spark, [(0, f"{a} {rest}"), (1, f"{b} {rest}")])).collect()}
    assert got == {0: 0, 1: 0}
    rows = [(0, f"{a} w0 w1 w2 w3"), (1, f"{b} w0 w1 w2 w3")]
    assert {x.component_id for x in near_dup.near_duplicates(frame(spark, rows)).collect()} == {0, 1}
    # words in the same order of two kinds
    rows = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(b)[2:])]
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in substring.dedup(frame(spark, rows)).collect()), key=str) == brute_substring(rows)


def test_many_texts_of_one_id(spark):
    r = random.Random(3)
    say = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    passage = say(20)
    rows = [(0, passage), *((5, say(3) + " " + passage) for _ in range(3)), *((5, say(20)) for _ in range(300)), (6, say(30) + " " + passage)]
    got = substring.dedup(frame(spark, rows)).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got), key=str) == brute_substring(rows)


def test_spans_that_only_hashes_hold_equal_are_found_out(spark, monkeypatch):
    """With 8 bits for a window, nearly all spans are wrong; the check sees it, and the wide key puts it right."""
    rows = corpus(4)
    docs = frame(spark, rows)
    plain = substring._node_keys

    def narrow(w, start, wide):
        return plain(w, start, wide) if wide else [plain(w, start, wide)[0] & np.uint64(255)]

    monkeypatch.setattr(substring, "_node_keys", narrow)
    assert not substring.unverified(substring._removals(docs, "doc_id", "text", False)).isEmpty()
    got = substring.dedup(docs).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got), key=str) == brute_substring(rows)


# --- near duplicates ---

def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("seed", [1, 4])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r["_id"], r["n"], r["component_id"]) for r in got), key=str) == brute_components(rows)
    assert all(r["kept"] == (r["_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (8, text + " x"), (5, "other words here now yes"), (7, ""), (3, None), (2, "a b"), (1, "A b")]
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert sorted(((r["_id"], r["n"], r["component_id"]) for r in got), key=str) == brute_components(rows)
    kept = near_dup.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {(r.doc_id, r["text"]) for r in kept.collect()} == {(5, text), (5, rows[4][1]), (7, ""), (3, None), (1, "A b")}
    assert near_dup.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_documents_of_one_template_are_told_apart(spark):
    """Two thirds of each is the template: they share buckets, but only the planted copies are linked."""
    r = random.Random(2)
    template = [f"t{i}" for i in range(80)]
    own = lambda n: [str(r.randrange(10**9)) for _ in range(n)]
    rows = [(k, " ".join(template + own(20))) for k in range(20_000)]
    for k in range(20):
        copy = rows[100 * k][1].split()
        copy[95] = "changed"
        rows.append((50_000 + k, " ".join(copy)))
    got = {x["_id"]: x["component_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: 100 * (i - 50_000) if i >= 50_000 else i for i, _ in rows}


def test_links_are_confirmed_on_words(monkeypatch):
    """Texts without a common word stay apart when all hashes are equal."""
    import pyarrow as pa

    plain = near_dup.tokens.mix
    monkeypatch.setattr(near_dup.tokens, "mix", lambda h, seed=0: plain(h, seed) & np.uint64(3))
    a = pa.array(["a b c d e f g h i j", "a b c d e f g h", "x y", "same", None, "A b c d e f g h i j k"])
    b = pa.array(["q r s t u v w x y z", "a B c d e f g h", "x z", "same", None, "a b c d e f g h i j l"])
    assert near_dup.linked(a, b).tolist() == [1, 3, 5]


def test_hyperminhash_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        b = np.concatenate([a[: int(2000 * share / (1 + share))], rng.integers(0, 2**63, 1000 - int(2000 * share / (1 + share)), dtype=np.uint64)])
        ra, rb = (near_dup.registers(x, np.array([0])) for x in (a, b))
        assert abs(near_dup.estimate(ra, rb, np.array([1000]), np.array([1000]))[0] - share) < 0.15


# --- decontamination ---

def test_decontamination(spark):
    rows = corpus()
    r = random.Random(9)
    texts = [t for _, t in rows if t and len(words(t)) > 30]
    items = [(k, " ".join(words(r.choice(texts))[: r.randrange(5, 40)])) for k in range(12)] + [(50, None), (51, ""), (52, "one two"), (53, "ONE two three"), (53, "ONE two three"), (None, words(texts[0])[0])]
    expected = {}
    for i, t in rows:
        own = shingles(t)
        expected[i] = sorted({k for k, x in items if shingles(x) and k is not None and 100 * len(shingles(x) & own) >= 75 * len(shingles(x))})
    frame_items = spark.createDataFrame(items, "item_id long, text string")
    got = containment.mark(frame(spark, rows), frame_items)
    assert {x.doc_id: sorted(x["__hf_items"] or []) for x in got.collect()} == expected
    assert any(expected.values())
    clean = containment.clean(frame(spark, rows), frame_items)
    assert clean.columns == frame(spark, rows).columns and {x.doc_id for x in clean.collect()} == {i for i, v in expected.items() if not v}
    assert containment.clean(frame(spark, rows), frame_items.limit(0)).count() == len(rows)


@pytest.mark.parametrize("most", [0, 200_000])
def test_decontamination_with_many_items_in_one_document(spark, monkeypatch, most):
    """Both ways to join the index; one document holds all items, one id has two texts, one item has no id."""
    monkeypatch.setattr(containment, "BROADCAST_ROWS", most)
    r = random.Random(7)
    say = lambda n: " ".join(f"v{r.randrange(5000)}" for _ in range(n))
    items = [(k, say(8)) for k in range(2000)] + [(3, say(9)), (None, say(9))]
    rows = [(1, " ".join(t for _, t in items)), (1, " ".join(t for _, t in items)), (2, items[5][1] + " " + say(50)), (3, say(300)), (None, items[-1][1]), (4, items[7][1].rsplit(" ", 2)[0])]
    got = [(x.doc_id, x["__hf_n_items"], tuple(x["__hf_items"] or ())) for x in containment.mark(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    all_ids = tuple(sorted(k for k, _ in items if k is not None))
    assert sorted(got, key=str) == sorted([(1, 2002, all_ids), (1, 2002, all_ids), (2, 1, (5,)), (3, None, ()), (None, 1, ()), (4, None, ())], key=str)


# --- pieces ---

def test_pieces_equal_the_library(spark):
    model = pieces.default_model()
    sp = pieces.processor(model)
    odd = [" lead", "trail ", "a  b", "▁mark▁", "\x00\x01", "é é ﬁ 한국어 😀", "<s> </s> <unk>", "a\u3000b\u00a0c", "x" * 5000, " " * 40]
    rows = corpus() + [(1000 + k, t) for k, t in enumerate(odd)]
    got = pieces.encode(frame(spark, rows), model)
    assert pieces.chunked(model) and "n_words" in got.columns
    for row in got.collect():
        assert list(row.ids) == sp.encode(row["text"] or "") and row.decoded == sp.decode(list(row.ids))
    digest = {r.doc_id: r for r in pieces.digests(pieces.encode(frame(spark, rows), model, keep=["doc_id"])).collect()}
    for i, t in rows:
        ids = sp.encode(t or "")
        assert digest[i].n_tokens == len(ids) and digest[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_chunk_table_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 50)
    t = pieces.ChunkTable(pieces.default_model())
    texts = [" ".join(f"k{i}{j}" for j in range(30)) for i in range(20)]
    for x in texts:
        ids, ends = t.encode([x, ""])
        assert ids.tolist() == t.sp.encode(x) and ends.tolist() == [len(ids)] * 2


# --- shards ---

def test_sharding(spark):
    rows = corpus() + [(900 + k, "copy of one text") for k in range(40)] + [(None, None), (7001, None)]
    got = shards.shard(frame(spark, rows)).collect()
    sizes, where = defaultdict(int), defaultdict(set)
    text = dict(rows)
    for r in got:
        sizes[r["shard"]] += r["size"]
        where[text[r.doc_id]].add(r["shard"])
    assert len(got) == len(rows) and all(len(v) == 1 for v in where.values())
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert shards.shard(frame(spark, []).limit(0)).count() == 0


def test_differencing_in_levels(spark):
    groups = spark.createDataFrame([(f"g{i}", (i * 7919) % 1000 + 1) for i in range(600)], "id string, size long")
    placed = shards.assign(groups, 8, bucket=20, top=3).join(groups, "id").groupBy("shard").sum("size").collect()
    totals = [r[1] for r in placed]
    assert len(totals) == 8 and max(totals) - min(totals) < 50


def test_difference_against_all_splits():
    from itertools import product

    sizes = [8, 7, 6, 5, 4]
    sums, went = shards.difference([[0, s] for s in sizes])
    assert sorted(sums) == sorted([sum(s for s, w in zip(sizes, went, strict=True) if w[1] == k) for k in (0, 1)])
    best = min(abs(sum(s if b else -s for s, b in zip(sizes, bits, strict=True))) for bits in product([0, 1], repeat=5))
    assert best <= abs(sums[0] - sums[1]) <= best + 2
