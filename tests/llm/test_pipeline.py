"""The pipeline, stage by stage and as a whole, against brute force on a small corpus."""

import hashlib
import random

import corpus_pipeline
from hushframe.llm import pieces, quality

from .test_documents import brute_components, brute_lines, shingles, words


def corpus():
    r = random.Random(11)
    vocabulary = ["the", "of", "and", "to", "in"] * 8 + [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    doc = lambda n: "\n".join(say(r.randrange(6, 12)) for _ in range(n))
    texts = [doc(r.randrange(2, 9)) for _ in range(40)]
    shared = doc(3)
    texts += [shared + "\n" + doc(2), doc(2) + "\n" + shared, shared]
    flat = [say(90) for _ in range(4)]
    for f in flat:
        for _ in range(3):
            w = f.split()
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [flat[0], flat[0], say(40).upper() + " #### $$$$ %%%%", "few words", "", "same " * 60]
    items = [(0, " ".join(words(texts[3])[2:14])), (1, " ".join(words(flat[2])[5:30])), (2, say(20))]
    return [(3 * i, t) for i, t in enumerate(texts)], items


def brute(rows, items, metrics):
    rows = [(i, t) for i, t in rows if metrics[i]]
    after = brute_lines(rows)
    rows = [(i, after[k]) for k, (i, _) in enumerate(rows) if words(after[k])]
    sets = {i for i, _, c in brute_components(rows) if i == c}
    rows = [(i, t) for i, t in rows if i in sets]
    leaks = lambda t: any(100 * len(shingles(x) & shingles(t)) >= 75 * len(shingles(x)) for _, x in items)
    return [(i, t) for i, t in rows if not leaks(t)]


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    expected = brute(rows, items, kept)
    assert 10 < len(expected) < len(rows) - 10
    sp = pieces.processor(pieces.default_model())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in expected}
    for i, t in expected:
        ids = sp.encode(t)
        assert got[i].n_tokens == len(ids) and got[i].n_chars == len(t)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(0, "a b c d e f g"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, "the of and to in " * 400, "en", "s", 9, "x"), (2, "the of and to in " * 400, "en", "s", 9, "x")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, _h string")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "tokens"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "tokens" or out.columns == docs.columns
        assert out.count() <= len(odd) and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
