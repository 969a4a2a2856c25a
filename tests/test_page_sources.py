"""Page evidence, canonical texts and redaction plans."""

from pyspark.sql import functions as F

from hushframe.operators import routing
from hushframe.sources import pages as P

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_ocr_words(spark):
    rows = [(1, 0, "a", [[0.0, 1.0], [4.0, 0.0], [4.0, 3.0], [0.0, 3.0]], 0.9), (1, 0, "b", [[0.0, 1.0]], 0.9), (1, 0, "c", [[0.0, 1.0]] * 3 + [[float("nan"), 1.0]], 0.5), (1, 0, "d", [[0.0, 0.0], [1.0, 1.0]] * 2, float("inf"))]
    got = {r.text: r for r in P.ocr_words(spark.createDataFrame(rows, "doc_id int, page_index int, text string, polygon array<array<double>>, confidence double")).collect()}
    assert tuple(got["a"].rect) == (0.0, 0.0, 4.0, 3.0) and got["a"].fault is None
    assert got["b"].fault == got["c"].fault == "OCR_GEOMETRY_INVALID" and got["d"].fault == "OCR_CONFIDENCE_INVALID"


def test_pages(spark):
    p = spark.createDataFrame([(1, 0, "a b", "ocr"), (1, 1, "x", "ocr"), (1, 2, "t", "text"), (2, 0, "", "text")], "doc_id int, page_index int, text string, source string")
    e = spark.createDataFrame([(1, 0, "ab", ["ab"]), (1, 1, "y", ["y"]), (1, 2, "u", ["u"])], "doc_id int, page_index int, text string, words array<string>")
    got = {(r.doc_id, r.page_index): (r.text, r.evidence_status) for r in P.enriched(p, e).collect()}
    assert got == {(1, 0): ("ab", "aligned"), (1, 1): ("x", "gap"), (1, 2): ("u", "aligned"), (2, 0): ("", "missing")}
    texts, places = P.canonical(p)
    assert {r.doc_id: r.text for r in texts.collect()} == {1: "a b\nx\nt", 2: ""}
    assert {(r.doc_id, r.page_index): (r.start, r.end) for r in places.collect()} == {(1, 0): (0, 3), (1, 1): (4, 5), (1, 2): (6, 7), (2, 0): (0, 0)}
    w = spark.createDataFrame([(1, 0, 0, "a", 0, 1), (1, 0, 1, "b", 2, 3), (1, 1, 0, "z", 0, 1)], "doc_id int, page_index int, word_index int, text string, start int, end int")
    assert [tuple(r) for r in P.misaligned_pages(w, p).collect()] == [(1, 1)]


def test_plan_and_scans(spark):
    box = (0.0, 0.0, 1.0, 1.0)
    occ = spark.createDataFrame([(1, "a", 0, [box], "mask", "NAME"), (1, "b", 0, [box], "review", "NAME"), (1, "c", 1, [box, box], "mask", "CARD")], f"doc_id int, occurrence_id string, page int, rects array<{RECT}>, action string, tag string")
    man = spark.createDataFrame([(1, 2, [box], "mask")], f"doc_id int, page int, rects array<{RECT}>, action string")
    out = spark.createDataFrame([(1, "a")], "doc_id int, occurrence_id string")
    assert {(r.page, r.tag, r.source) for r in P.redaction_plan(occ, man, out).collect()} == {(1, "CARD", "automatic"), (2, "MANUAL", "manual")}
    assert P.redaction_plan(occ, man, out).count() == 2
    seg = spark.createDataFrame([("d", "s", "k", 0, 5)], "doc_id string, segment_id string, kind string, page_start int, page_end int")
    scans = spark.createDataFrame([("d", 2), ("d", 3)], "doc_id string, page int")
    assert sorted((r.page_start, r.page_end, r.is_scan) for r in routing.split_at_scans(seg, scans).collect()) == [(0, 1, False), (2, 3, True), (4, 5, False)]
    words = spark.createDataFrame([(1, 0, "a", box), (1, 0, "b", (2.0, 0.0, 3.0, 1.0))], f"doc_id int, page_index int, text string, rect {RECT}")
    assert P.word_hash(words).first().hash == P.word_hash(words.orderBy("text", ascending=False)).first().hash
    assert spark.createDataFrame([("x/y.z.pdf",)], "p string").select(P.output_name(F.col("p"), "masked", "1").alias("n")).first().n == "y.z_masked_1"
