"""Operators on pages, spans, reviews and measurements, on literals and against brute force."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from hushframe.functions import geometry as G
from hushframe.functions import scoring
from hushframe.operators import evaluation, layout, native, regions, review, routing, spans
from hushframe.operators.fold import cascade
from hushframe.operators.routing import Page
from hushframe.sources import files
from hushframe.streaming import batches

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*v):
    return G.rect(*(F.lit(float(x)) for x in v))


def test_geometry(spark):
    a, b = box(0, 0, 10, 10), box(5, 5, 15, 15)
    assert one(spark, G.iou(a, b)) == pytest.approx(25 / 175)
    assert one(spark, G.coverage(a, F.array(box(0, 0, 5, 10), box(4, 0, 10, 10)), 0.0)) == 1.0
    assert one(spark, G.coverage(a, F.array(box(0, 0, 5, 10), box(0, 0, 3, 10)), 0.0)) == 0.5
    assert one(spark, G.coverage(a, F.array(box(0.4, 0.4, 9.6, 9.6)), 0.5)) == 1.0
    assert one(spark, G.coverage(a, F.array(b, box(0, 0, 2, 2)), 0.0)) == pytest.approx(0.29)
    assert one(spark, G.faults(F.array(a), F.array(b), F.array(box(12, 12, 20, 20)))) == ["incomplete_coverage", "protected_neighbor_intrusion"]
    assert one(spark, G.faults(F.array().cast(f"array<{RECT}>"), F.array(b), F.array(a))) == ["missing_geometry"]
    assert one(spark, G.distance(a, box(13, 14, 20, 20))) == 5.0 and one(spark, G.gap(a, box(13, 14, 20, 20))) == 3.0
    assert one(spark, G.valid(a)) and not one(spark, G.valid(box(0, 0, 0, 1))) and not one(spark, G.valid(box(float("nan"), 0, 1, 1)))
    assert one(spark, G.fingerprint(F.array(a, b))) == one(spark, G.fingerprint(F.array(b, a))) != one(spark, G.fingerprint(F.array(a)))
    assert tuple(one(spark, G.part_of(a, F.lit(2), F.lit(4), F.lit(5)))) == (4.0, 0.0, 8.0, 10.0)


def test_scoring(spark):
    t, f = F.lit(True), F.lit(False)
    s = one(spark, scoring.body_name(f, t, t, F.lit(3), t, F.lit("confirmed")))
    assert (s.score, s.action) == (0.95, "auto_mask") and s.reasons == ["approval_role", "label_boundary", "label_distance", "page_position", "confirmed_region"]
    assert one(spark, scoring.body_name(f, f, t, F.lit(None).cast("int"), f, F.lit("unconfirmed"))).action == "preserve"
    assert one(spark, scoring.region_value(t, t, t, f)).action == "auto_mask" and one(spark, scoring.region_value(t, t, t, t)).action == "review"
    assert one(spark, scoring.institution_value(t, t, t, t, f)).score == 0.95 and one(spark, scoring.institution_address(t, t, t, t)).action == "review"
    full = one(spark, scoring.region_evidence(t, t, t, F.lit(50.0), t, F.lit(0.9)))
    assert (full.score, full.state, full.missing) == (10, "confirmed", [])
    none = one(spark, scoring.region_evidence(f, t, f, F.lit(None).cast("double"), f, F.lit(None).cast("double")))
    assert (none.score, none.state) == (3, "unconfirmed") and len(none.missing) == 5
    with pytest.raises(ValueError):
        scoring.body_name(t, t, t, F.lit(1), t, F.lit(""), auto=0.3, review=0.5)


def test_lines(spark):
    words = [(1, i, (float(x), float(y), x + 5.0, y + 10.0)) for i, (x, y) in enumerate([(0, 0), (10, 3), (20, 1), (0, 20), (8, 22), (0, 60)])]
    df = spark.createDataFrame(words, f"doc_id int, word_index int, rect {RECT}").withColumn("text", F.col("word_index").cast("string"))
    lined = layout.lines(df, ["doc_id"])
    assert {r.line: r.text for r in layout.reading_text(lined, ["doc_id"]).collect()} == {0: "0 1 2", 1: "3 4", 2: "5"}
    labels = lined.filter("word_index = 0").select("doc_id", F.lit(9).alias("label_id"), "rect")
    near = layout.label_values(labels, lined.withColumn("is_label", F.col("word_index") == 1), ["doc_id"])
    assert [(r.word_index, r["rank"]) for r in near.collect()] == [(2, 2)]


def test_clusters_against_brute_force(spark):
    r = random.Random(7)
    rects = [(p, i, (x := r.uniform(0, 60), y := r.uniform(0, 60), x + r.uniform(1, 14), y + r.uniform(1, 14))) for p in range(4) for i in range(25)]
    df = spark.createDataFrame(rects, f"page int, id int, rect {RECT}")
    got = {(x.page, x.id): x.cluster for x in layout.clusters(df, ["page"]).collect()}
    for p in range(4):
        own = {i: b for q, i, b in rects if q == p}
        label = {i: i for i in own}
        for _ in own:
            for i, a in own.items():
                for j, b in own.items():
                    if max(a[0], b[0]) < min(a[2], b[2]) and max(a[1], b[1]) < min(a[3], b[3]):
                        label[i] = label[j] = min(label[i], label[j])
        assert {i: got[p, i] for i in own} == label


def test_merge_looks_at_the_last_span_only(spark):
    rows = [(1, "a", 0, 5), (1, "a", 3, 8), (1, "b", 6, 7), (1, "a", 7, 9), (1, "a", 20, 21), (2, "a", 0, 1), (2, "a", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id int, label string, start int, end int")
    got = sorted((r.doc_id, r.label, r.start, r.end, r.n) for r in spans.merge(df, ["doc_id"]).collect())
    assert got == [(1, "a", 0, 8, 2), (1, "a", 7, 9, 1), (1, "a", 20, 21, 1), (1, "b", 6, 7, 1), (2, "a", 0, 1, 1), (2, "a", 1, 2, 1)]


def test_unite_and_words(spark):
    schema = "doc_id int, start int, end int, tag string, value string, action string, source string"
    a = spark.createDataFrame([(1, 0, 3, "NAME", "x", "review", "rule")], schema)
    b = spark.createDataFrame([(1, 0, 3, "NAME", "x", "mask", "other"), (1, 5, 6, "NAME", "y", "review", "other")], schema)
    got = {r.start: (r.action, r.sources) for r in spans.unite(a, b, "doc_id").collect()}
    assert got == {0: ("mask", ["rule", "other"]), 5: ("review", ["other"])}
    words = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 8), (1, 2, 9, 12)], "doc_id int, word_index int, start int, end int")
    found = spark.createDataFrame([(1, 7, 4, 12), (1, 8, 4, 10)], "doc_id int, span_id int, start int, end int")
    assert [(r.span_id, r.first_word, r.last_word) for r in spans.on_words(found, words, ["doc_id"]).collect()] == [(7, 1, 2)]


def test_carried_needs_one_match_each_way(spark):
    schema = f"id string, page int, tag string, rect {RECT}"
    prior = spark.createDataFrame([("a", 1, "X", (0.0, 0.0, 10.0, 10.0)), ("b", 1, "X", (50.0, 0.0, 60.0, 10.0)), ("c", 2, "X", (0.0, 0.0, 10.0, 10.0))], schema)
    after = spark.createDataFrame([("p", 1, "X", (0.4, 0.0, 10.0, 10.0)), ("q", 1, "X", (50.1, 0.0, 60.0, 10.0)), ("r", 1, "X", (50.2, 0.0, 60.0, 10.0)), ("s", 2, "Y", (0.0, 0.0, 10.0, 10.0))], schema)
    assert [(r.prior_id, r.after_id) for r in spans.carried(prior, after, ["page", "tag"]).collect()] == [("a", "p")]


def test_matching_is_largest(spark):
    r = random.Random(3)
    rows = [(d, f"g{g}", f"c{c}", r.random()) for d in range(30) for g in range(5) for c in range(5) if r.random() < 0.35]
    df = spark.createDataFrame(rows, "doc_id int, gold_id string, cand_id string, score double")
    got = {}
    for x in evaluation.one_to_one(df).collect():
        got.setdefault(x.doc_id, []).append((x.gold_id, x.cand_id))
    for d in {x[0] for x in rows}:
        edges = {(g, c) for q, g, c, _ in rows if q == d}
        best = max(sum((f"g{g}", f"c{c}") in edges for g, c in enumerate(p)) for p in permutations(range(5)))
        assert len(got[d]) == best and set(got[d]) <= edges and len({c for _, c in got[d]}) == best


def test_folds(spark):
    import hashlib

    ids = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(100)]
    ranked = sorted(ids, key=lambda h: (hashlib.sha256(f"public-document-pilot-v1:{h}".encode()).hexdigest(), h))
    got = {r.h: r.fold for r in evaluation.folds(spark.createDataFrame([(h,) for h in ids], "h string"), "h").collect()}
    assert got == {h: k % 5 for k, h in enumerate(ranked)}


def page(i, starts=(), goes_on=(), titles=(), kind=None, boundary=0.9):
    return Page(i, frozenset(starts), frozenset(goes_on), tuple(titles), kind, 0.9, boundary)


GOES_ON = ("no_start_signal", "page_number_sequence")


@pytest.mark.parametrize(
    ("pages", "expected"),
    [
        ([page(0, ["approval"]), page(1, (), GOES_ON), page(2, ["recipient"])], [("internal_review", 0, 1, False), ("official_dispatch", 2, 2, False)]),
        ([page(0), page(1, ["approval"])], [("unknown", 0, 0, True), ("internal_review", 1, 1, False)]),
        ([page(0, ["approval"]), page(1), page(2, (), GOES_ON)], [("internal_review", 0, 2, False)]),
        ([page(0, ["approval"]), page(1), page(2)], [("internal_review", 0, 0, False), ("unknown", 1, 2, True)]),
        ([page(0, ["approval", "recipient"])], [("unknown", 0, 0, True)]),
        ([page(0, ["prereview", "recipient"], boundary=0.5), page(1)], [("internal_review", 0, 1, True)]),
        ([page(0, ["approval"], titles=["도로 정비 계획"]), page(1, titles=["도로정비 계획"]), page(2, titles=["다른 제목 하나"], kind="official_dispatch")], [("internal_review", 0, 1, False), ("official_dispatch", 2, 2, False)]),
        ([page(0, ["common_document_header"])], [("unknown", 0, 0, True)]),
    ],
)
def test_routing(pages, expected):
    got = routing.segments(pages, "d")
    assert [(s["kind"], s["page_start"], s["page_end"], s["common_only"]) for s in got] == expected
    assert all(s["segment_id"].startswith("seg_") for s in got)


def test_routing_profiles_and_corrections(spark):
    only = routing.segments([page(0), page(1)], "d", "internal_review")
    assert only[0]["state"] == "review_required" and routing.segments([page(0)], "d", "legal")[0]["state"] == "confirmed"
    with pytest.raises(ValueError):
        routing.segments([page(1)], "d")
    schema = "doc_id string, kind string, state string, page_start int, page_end int"
    found = spark.createDataFrame([("d", "a", "confirmed", 0, 5), ("d", "b", "confirmed", 6, 9)], schema)
    fixed = routing.corrected(found, spark.createDataFrame([("d", 4, 7, "c")], "doc_id string, page_start int, page_end int, kind string"))
    assert sorted((r.page_start, r.page_end, r.kind) for r in fixed.collect()) == [(0, 3, "a"), (4, 7, "c"), (8, 9, "b")]
    assert routing.gaps(fixed).count() == 0 and routing.gaps(found.filter("kind = 'b'")).count() == 1


def test_region_dictionary(spark):
    rows = [
        ("1100000000", "서울특별시", "존재"),
        ("1114000000", "서울특별시 중구", "존재"),
        ("1114010300", "서울특별시 중구 태평동", "존재"),
        ("3600000000", "세종특별자치시", "존재"),
        ("3611010100", "세종특별자치시 반곡동", ""),
        ("4100000000", "경기도", "존재"),
        ("4146000000", "경기도 용인시 처인구", "존재"),
        ("4146025021", "경기도 용인시 처인구 남사읍 봉명리", "존재"),
        ("4146025022", "경기도 용인시 처인구 남사읍 폐지리", "폐지"),
    ]
    got = {}
    for r in regions.dictionary(spark.createDataFrame(rows, "code string, name string, status string")).collect():
        got.setdefault(r.kind, set()).add(r.term)
    assert got == {
        "sido": {"서울특별시", "세종특별자치시", "경기도"},
        "sigungu": {"중구", "용인시 처인구", "처인구"},
        "eupmyeondong": {"태평동", "반곡동"},
        "single_tier_sido": {"세종특별자치시"},
        "ri": {"봉명리"},
        "weak_place_names": {"태평동", "반곡동", "봉명리"},
    }


def test_native_equals_cascade(spark):
    texts = ["카드 1234-5678-9012-3456, 010-1234-5678 a.b@c.kr", "1111222233334444 5555666677778888", "none", None, "주민 900101-1234567 여권 M12345678 (02)123-4567", "😀 a@b.c 😀 x@y.zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in native.detect(df).collect():
        expected = [(h.tag, h.start, h.end) for h in sorted(cascade(texts[r.doc_id] or "").hits, key=lambda h: h.start)]
        assert [(h.tag, h.start, h.end) for h in r.hits] == expected
        assert len(r.work) == len(texts[r.doc_id] or "")


def test_reviews(spark):
    acts = spark.createDataFrame([(1, 0, k, (0.0, 0.0, 1.0, 1.0), a) for k, a in enumerate(["mask", "mask", "restore", "mask"])], f"doc_id int, page int, idx int, rect {RECT}, action string")
    got = review.effective_boxes(acts).first()
    assert (got.action, got.changes, got.repeats) == ("mask", 3, 1)
    occ = spark.createDataFrame([(1, f"o{k}", 0, [(float(k), 0.0, k + 1.0, 1.0)], "mask", "rule") for k in range(4)], f"doc_id int, occurrence_id string, page int, rects array<{RECT}>, action string, source string")
    man = spark.createDataFrame([(1, "o1", 0, [(9.0, 0.0, 10.0, 1.0)], "restore"), (1, None, 0, [(2.0, 0.0, 3.0, 1.0)], "restore"), (1, None, 0, [(5.0, 5.0, 6.0, 6.0)], "mask")], f"doc_id int, occurrence_id string, page int, rects array<{RECT}>, action string")
    n = review.mask_counts(occ, man).first()
    assert (n.automatic, n.restored, n.manual, n.effective) == (4, 2, 1, 3)
    gate = review.save_gate(
        spark.createDataFrame([(1, "boundary", "pending"), (2, "x", "resolved")], "doc_id int, kind string, status string"),
        spark.createDataFrame([(1, "approval", "indeterminate"), (2, "approval", "present")], "doc_id int, kind string, state string"),
        spark.createDataFrame([(1, True), (2, True), (3, False)], "doc_id int, sound boolean"),
    )
    assert {r.doc_id: (r.gate, r.reasons) for r in gate.collect()} == {1: ("advisory", ["coverage_approval", "review_boundary"]), 2: ("eligible", []), 3: ("blocked", [])}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("한글".encode("cp949"))
    (tmp_path / "b.md").write_bytes("plain".encode())
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.bin").write_bytes(b"\xff")
    found = files.binary_files(spark, f"file://{tmp_path}")
    got = {r.path.rpartition("/")[2]: (r.text, r.engine, r.failures) for r in files.text_documents(found).collect()}
    assert got["a.txt"] == ("한글", "text:cp949", []) and got["b.md"][0] == "plain" and got["c.pdf"][2] == ["PDF_CONNECTOR_MISSING"] and got["d.bin"][2] == ["UNSUPPORTED_SUFFIX"]

    def broken(_):
        raise KeyError

    out = files.with_engines(found.filter("kind = 'pdf'"), {"one": broken, "two": lambda b: b.decode()}).first()
    assert (out.text, out.engine, out.failures) == ("%PDF", "two", ["one:KeyError"])
    (tmp_path / "r.json").write_text('{"sido": ["가도", " "], "n": 1}')
    assert [(r.kind, r.term) for r in files.read_regions(spark, f"file://{tmp_path}/r.json").collect()] == [("sido", "가도")]


def test_mask_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.kr"), (2, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = batches.documents(spark, f"{tmp_path}/in", "doc_id long, text string")
    query = batches.mask_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination()
    assert {r.doc_id: r.masked for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "[EMAIL]", 2: "none"}


def test_sessions(spark, tmp_path):
    rows = [("r", 1, "create", None), ("r", 2, "revise", 2), ("r", 3, "revise", 2), ("r", 4, "finalize", 1), ("r", 5, "finalize", 2), ("r", 6, "complete", None), ("r", 7, "create", None), ("s", 1, "finalize", None)]
    df = spark.createDataFrame(rows, "run_id string, seq long, event string, revision long")
    got = {(r.run_id, r.seq): (r.state, r.accepted, r.reason) for r in batches.session_states(df).collect()}
    assert got["r", 2][1] and got["r", 3] == ("ready", False, "stale_revision") and got["r", 4][2] == "stale_revision" and got["r", 6] == ("completed", True, "") and got["r", 7][2] == "replayed"
    assert got["s", 1] == ("new", False, "illegal_transition")
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = batches.session_stream(stream).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.run_id, r.seq): (r.state, r.accepted, r.reason) for r in spark.table("sessions").collect()} == got


def test_retries(spark, tmp_path):
    calls = []

    def work(items):
        calls.append(items.count())
        # an outcome that differs each time it is worked out
        return items.select("path", ((F.lit(len(calls) > 1) & (F.rand() >= 0)) | (F.col("path") == "a")).alias("ok"))

    status = batches.with_retries(spark.createDataFrame([("a",), ("b",)], "path string"), work, f"file://{tmp_path}/rounds")
    assert {r.path: (r.status, r.attempts) for r in status.collect()} == {"a": ("done", 1), "b": ("done", 2)} and calls == [2, 1]
    assert batches.summary(status).first().done == 2
