"""Ruled tables, approval boxes, token alignment and review counts."""

from pyspark.sql import functions as F

from hushframe.operators import approval, review, spans, tables

RECT = tables.RECT
GRID = [(0.0, y, 100.0, y + 0.5) for y in (0.0, 20.0, 40.0)] + [(x, 0.0, x + 0.5, 40.5) for x in (0.0, 50.0, 99.5)]


def test_cells_and_rows():
    got = tables.cells(GRID)
    assert len(got) == 4 and got[0] == (0.25, 0.25, 50.25, 20.25)
    assert len(tables.rows([(0.0, 0.0, 60.0, 0.5), (58.0, 0.0, 100.0, 0.5), *GRID[1:]])) == 2
    assert tables.cells(GRID[:3]) == [] and tables.rules([(0.0, 0.0, 1.0, 1.0)]) == ([], [])


def test_words_are_split_at_cells():
    letters = [(c, (40.0 + 5 * i, 5.0, 44.0 + 5 * i, 12.0)) for i, c in enumerate("abcd")]
    words = [("x", (200.0, 5.0, 205.0, 12.0)), ("abcd", (40.0, 5.0, 59.0, 12.0))]
    assert [t for t, _ in tables.split_words(words, GRID, letters)] == ["x", "ab", "cd"]
    assert tables.split_words(words, GRID, letters[:3]) == words and tables.split_words(words, [], letters) == words


def test_page_cells(spark):
    df = spark.createDataFrame([("d", 0, b) for b in GRID], f"doc_id string, page_index int, rect {RECT}")
    assert tables.page_cells(df).count() == 4


def test_signers(spark):
    words = [("과장", (5.0, 5.0, 25.0, 12.0)), ("김철수", (5.0, 25.0, 30.0, 32.0)), ("팀장", (55.0, 5.0, 75.0, 12.0)), ("박영희", (55.0, 25.0, 80.0, 32.0)), ("시행:총무과-12", (200.0, 500.0, 270.0, 507.0)), ("검토결과", (5.0, 700.0, 30.0, 707.0))]
    got = approval.signers(words, GRID, 800.0)
    assert [(f["kind"], f["value"], f["in_box"]) for f in got] == [("header_meta", "총무과-12", False), ("approval_staff", "김철수", True), ("approval_staff", "박영희", True)]
    low = [(t, (b[0], b[1] + 600, b[2], b[3] + 600)) for t, b in words[:2]]
    assert approval.signers(low, [], 800.0) == []
    assert [f["value"] for f in approval.signers([("주무관오나래", (5.0, 700.0, 65.0, 707.0))], [], 800.0)] == ["오나래"]
    w = spark.createDataFrame([("d", 0, t, b, 800.0) for t, b in words], f"doc_id string, page_index int, text string, rect {RECT}, page_height double")
    d = spark.createDataFrame([("d", 0, b) for b in GRID], f"doc_id string, page_index int, rect {RECT}")
    assert {r.value for r in approval.approvals(w, d).collect()} == {"총무과-12", "김철수", "박영희"}


def test_tokens_take_values(spark):
    masked = spark.createDataFrame([(1, "[A] [B] [A] [A]")], "doc_id int, masked string")
    hits = spark.createDataFrame([(1, "A", 9, "y"), (1, "A", 0, "x"), (1, "B", 4, "z")], "doc_id int, tag string, start int, value string")
    got = spans.token_values(masked, hits, "doc_id").collect()
    assert sorted((r["at"], r.value) for r in got if r.value) == [(0, "x"), (1, "z"), (2, "y")] and len(got) == 4


def test_page_continuity(spark):
    rows = [(1, 0, 1, ["h"]), (1, 1, 2, ["x"]), (1, 2, 9, ["x", "y"]), (1, 3, None, [])]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, page_number int, signatures array<string>")
    assert [r.signals for r in spans.page_continuity(df).orderBy("page_index").collect()] == [[], ["page_number_sequence"], ["repeated_header_footer"], []]


def test_review_counts(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    occ = spark.createDataFrame([(1, "a", 0, [box], "mask", "r"), (1, "b", 2, [box], "mask", "r"), (1, "c", 1, [box], "review", "r")], f"doc_id int, occurrence_id string, page int, rects array<{RECT}>, action string, source string")
    man = spark.createDataFrame([(1, None, 0, [box], "mask", box), (1, "b", 2, [box], "restore", box), (1, None, 5, [box], "restore", box)], f"doc_id int, occurrence_id string, page int, rects array<{RECT}>, action string, rect {RECT}")
    assert {(r.page, r.automatic, r.manual) for r in review.page_masks(occ, man).collect()} == {(0, 1, 1), (2, 1, 0)}
    assert review.first_mask(occ, man, occ).first().page == 0
    e = review.expected_masks(occ, man, occ.filter("action = 'mask'")).first()
    assert (e.expected, e.applied, e.complete) == (2, 2, True)
    assert [r.page for r in review.restores_on_masks(man, occ).collect()] == [2]
    reviews = spark.createDataFrame([(1, "x", "pending"), (1, "y", "resolved")], "doc_id int, kind string, status string")
    cover = spark.createDataFrame([(1, "x", "indeterminate"), (1, "y", "indeterminate"), (1, "z", "present")], "doc_id int, kind string, state string")
    assert {(r.kind, r.why) for r in review.save_warnings(reviews, cover).collect()} == {("x", "review_pending"), ("y", "coverage_indeterminate")}
    t = review.review_totals(reviews).first()
    assert (t.pending, t.resolved, t.total) == (1, 1, 2)
    ex = spark.createDataFrame([(1, 0, box, ["r"]), (1, 9, box, [])], f"doc_id int, page int, rect {RECT}, reasons array<string>")
    got = {r.page: (r.reasons, r.effective) for r in review.kept_exclusions(ex, man.select("doc_id", "page", "rect")).collect()}
    assert got == {0: (["r", "mask_overlaps_exclusion"], False), 9: ([], True)}
    ids = review.anonymised(reviews, ["kind"], "s").collect()
    assert len({r.kind for r in ids}) == 2 and all(r.kind.startswith("id_") for r in ids)
    rng = review.coverage_range(spark.createDataFrame([(1, "k", 3)], "doc_id int, kind string, page int"), spark.createDataFrame([(1, "k", 0, 9), (1, "m", 2, 4)], "doc_id int, kind string, page_start int, page_end int"))
    assert {(r.kind, r.page_start, r.page_end) for r in rng.collect()} == {("k", 3, 3), ("m", 2, 4)}


def test_blocked_documents(spark):
    df = spark.createDataFrame([(1, ["a"]), (1, []), (2, [])], "doc_id int, faults array<string>")
    assert {r.doc_id: (r.reasons, r.blocked) for r in review.blocked(df).collect()} == {1: (["a"], True), 2: ([], False)}
    assert df.select(F.lit(1)).count() == 3


def test_model_candidates(spark):
    df = spark.createDataFrame([(1, "원고 홍길동 피고 [LEGAL_PARTY] 원고 홍길동\n회사명: 푸른 들\n팀장 오나래"), (2, "none")], "doc_id int, masked string")
    got = [(r.tag, r.value, r.n, r["first"], r.score) for r in review.candidates_for_model(df).orderBy("rank").collect()]
    assert got == [("LEGAL_PARTY", "홍길동", 2, 0, 142), ("APPROVAL_LINE", "오나래", 1, 41, 110), ("COMPANY", "푸른 들", 1, 31, 86)]
    assert review.candidates_for_model(df, most=1).count() == 1
