"""The geometry analysis end to end, and the search for values and their context."""

from hushframe.operators import chunks, layout
from hushframe.operators.tables import RECT
from hushframe.plans import manifest


def words(pages):
    out = []
    for doc, index, rows in pages:
        text, own = "", []
        for y, x0, line in rows:
            x = float(x0)
            for word in line.split():
                text += " " if text else ""
                own.append((len(text), len(text) + len(word), word, (x, float(y), x + 6.0 * len(word), y + 8.0)))
                text += word
                x += 6.0 * len(word) + 4
        out += [(doc, index, text, 800.0, *w) for w in own]
    return out


SCHEMA = f"doc_id string, page_index int, page_text string, page_height double, start int, end int, text string, rect {RECT}"


def test_analysis(spark):
    pages = [
        ("a", 0, [(10, 0, "결재 과장 팀장"), (40, 28, "김철수"), (40, 66, "박영희"), (300, 0, "기관명 한빛진흥원 에서 알림"), (780, 300, "1")]),
        ("a", 1, [(300, 0, "본문 a.b@c.kr 끝"), (780, 300, "2")]),
        ("a", 2, [(10, 0, "수신 가나 귀중"), (760, 0, "시행 총무과-77"), (780, 300, "9")]),
        ("b", 0, [(300, 0, "그냥 글")]),
    ]
    grid = [(20.0, y, 120.0, y + 0.5) for y in (5.0, 30.0, 60.0)] + [(x, 5.0, x + 0.5, 60.5) for x in (20.0, 62.0, 119.5)]
    drawings = spark.createDataFrame([("a", 0, g) for g in grid], f"doc_id string, page_index int, rect {RECT}")
    m = manifest.analyse(spark.createDataFrame(words(pages), SCHEMA), drawings)
    segments = sorted((r.doc_id, r.kind, r.page_start, r.page_end, r.state) for r in m.segments.collect())
    assert segments == [("a", "internal_review", 0, 1, "confirmed"), ("a", "official_dispatch", 2, 2, "confirmed"), ("b", "unknown", 0, 0, "review_required")]
    found = m.occurrences.collect()
    assert {(r.page_index, r.tag, r.action) for r in found} >= {(0, "APPROVAL_LINE", "mask"), (1, "EMAIL", "mask"), (2, "DOC_META", "mask"), (0, "INSTITUTION_VALUE", "mask")}
    assert "value" not in m.occurrences.columns and len({r.occurrence_id for r in found}) == len(found)
    assert {(r.doc_id, r.kind): r.state for r in m.coverage.collect()} == {
        ("a", "approval"): "present",
        ("a", "approval_staff"): "present",
        ("a", "header_meta"): "absent",
        ("a", "dispatch_metadata"): "absent",
    }
    assert {(r.doc_id, r.kind) for r in m.reviews.collect()} >= {("b", "boundary")}
    assert manifest.table_cells(drawings).count() == 4


def test_located(spark):
    docs = spark.createDataFrame([(1, "ab cd ab  cd ab"), (2, None)], "doc_id int, text string")
    values = spark.createDataFrame([(1, 0, "ab"), (1, 1, "ab cd"), (1, 2, "ab cd"), (1, 3, "ab"), (1, 4, "zz"), (2, 0, "ab")], "doc_id int, ordinal long, value string")
    got = {(r.doc_id, r.ordinal): (r.start, r.end) for r in chunks.located(docs, values).collect()}
    assert got == {(1, 0): (0, 2), (1, 1): (0, 5), (1, 2): (6, 12), (1, 3): (6, 8), (1, 4): (-1, -1), (2, 0): (-1, -1)}


def test_matching_context(spark):
    c = spark.createDataFrame([(1, 0, "other words"), (1, 1, "Hong Gil-dong came"), (1, 2, "hong gildong")], "doc_id int, chunk_index int, text string")
    v = spark.createDataFrame([(1, "Hong Gil-dong"), (1, "HONG GILDONG"), (1, "absent")], "doc_id int, value string")
    got = {r.value: (r.chunk_index, r.score) for r in chunks.matching_context(v, c).collect()}
    assert got == {"Hong Gil-dong": (1, 100), "HONG GILDONG": (1, 90)}


def test_merged_evidence(spark):
    rows = [(1, 1, (0.0, 0.0, 5.0, 5.0), 3), (1, 2, (4.0, 4.0, 9.0, 9.0), 7), (1, 3, (20.0, 20.0, 25.0, 25.0), 1), (1, 4, (20.0, 20.0, 25.0, 25.0), 2)]
    df = spark.createDataFrame(rows, f"page int, id int, rect {RECT}, score int")
    assert sorted((r.id, tuple(r.rect)) for r in layout.merged_evidence(df, ["page"]).collect()) == [(2, (0.0, 0.0, 9.0, 9.0)), (3, rows[2][2]), (4, rows[3][2])]
