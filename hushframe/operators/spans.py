"""Span algebra: labels, identities, merging, union with other detectors, joins with words and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import geometry as G


def tag_table(spark: SparkSession) -> DataFrame:
    """(tag, label, source, action, confidence, korean): one row per tag; small and fixed."""
    rows = []
    for tag in sorted({*V.TAGS, *V.KOREAN}):
        label, source = V.TAGS.get(tag, (tag.lower(), "regex"))
        review = tag in V.REVIEW_TAGS
        rows.append((tag, label, source, "review" if review else "mask", V.REVIEW_CONFIDENCE if review else V.MASK_CONFIDENCE, V.KOREAN.get(tag)))
    return spark.createDataFrame(rows, "tag string, label string, source string, action string, confidence double, korean string")


def clean(value: Column) -> Column:
    """White space collapsed, outer separators taken off."""
    return F.btrim(F.regexp_replace(value, r"(?U)\s+", " "), F.lit(" ,;:/"))


def occurrence_id(
    document_hash: Column, revision: Column, page: Column, rects: Column, tag: Column, category: Column, value_hash: Column, source: Column,
    policy: Column, action: Column, segment: Column | None = None, region: Column | None = None,
) -> Column:
    """Identity of an occurrence: a digest of its canonical JSON; null where a part is not what it must be.

    The JSON has its keys in order, no spaces, rects in order in millionths, and segment and region only with a segment."""
    hex64 = lambda c: F.lower(c).rlike(r"\A[0-9a-f]{64}\z")
    parts = {
        "analysisRevision": revision.cast("long"), "category": category, "documentHash": F.lower(document_hash), "page": page.cast("long"), "policy": policy,
        "proposedAction": action, "rects": F.array_sort(F.transform(rects, lambda r: F.array(*(G.micro(r[c]) for c in ("x0", "y0", "x1", "y1"))))),
        "source": source, "tag": tag, "valueHash": F.lower(value_hash),
    }
    valid = hex64(document_hash) & hex64(value_hash) & (revision >= 1) & (page >= 0) & action.isin("mask", "review", "exclude")
    for text in (tag, category, source, policy):
        valid &= F.coalesce(text != "", F.lit(False))
    valid &= (F.size(rects) > 0) & F.forall(rects, G.valid)
    material = F.to_json(F.struct(*(c.alias(n) for n, c in sorted(parts.items()))))
    if segment is not None:
        within = parts | {"segmentId": segment, "regionId": F.lit(None).cast("string") if region is None else region}
        whole = F.to_json(F.struct(*(c.alias(n) for n, c in sorted(within.items()))), {"ignoreNullFields": "false"})
        material = F.when(segment.isNotNull(), whole).otherwise(material)
    return F.when(valid, F.concat(F.lit("occ_"), F.left(F.sha2(material, 256), F.lit(24))))


def merge(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", label: str = "label") -> DataFrame:
    """Spans of one label that overlap without another label's span between them, as one.

    In the order of start and end, a span joins the one before it if both have the same label and it starts
    before the merged end.  A span of another label in between breaks the chain, as only the last merged span
    is looked at.  Gaps and islands: a break is a change of label, or a start at or after the running end
    of the current run of equal labels.  As in SQL, nulls come last and a null label equals none."""
    by = [F.col(c).asc_nulls_last() for c in (start, end, label)]
    order = Window.partitionBy(*keys).orderBy(*by)
    runs = spans.withColumn("_new", F.when(F.lag(label).over(order) == F.col(label), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "_run").orderBy(*by)
    reach = F.max(end).over(within.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("_break", F.coalesce(F.col(start) >= reach, F.lit(False)).cast("int"))
    islands = islands.withColumn("_island", F.sum("_break").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    out = islands.groupBy(*keys, "_run", "_island", label).agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))
    return out.drop("_run", "_island")


def unite(rule_hits: DataFrame, detector_hits: DataFrame, key: str) -> DataFrame:
    """Rule hits and detector hits on (key, start, end, tag, value): equal ones become one with both sources, and
    a mask wins over a review."""
    on = [key, "start", "end", "tag", "value"]
    both = rule_hits.select(*on, "action", "source", F.lit(0).alias("_o")).unionByName(detector_hits.select(*on, "action", "source", F.lit(1).alias("_o")))
    grouped = both.groupBy(*on).agg(
        F.array_sort(F.collect_set(F.struct("_o", "source"))).alias("_s"), F.max((F.col("action") == "mask").cast("int")).alias("_m")
    )
    return grouped.select(*on, F.when(F.col("_m") == 1, "mask").otherwise("review").alias("action"), F.array_distinct(F.col("_s.source")).alias("sources"))


def without_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left spans that overlap no right span of the same keys."""
    renamed = right.select(*(F.col(k).alias("_r" + k) for k in keys), F.col("start").alias("_rs"), F.col("end").alias("_re"))
    on = (F.col("start") < F.col("_re")) & (F.col("_rs") < F.col("end"))
    for k in keys:
        on = on & (F.col(k) == F.col("_r" + k))
    return left.join(renamed, on, "left_anti")


def on_words(spans: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Spans whose words begin and end exactly with them: (keys, span_id, n_words, first_word, last_word).

    ``words``: keys, word_index, start, end.  Both sides share the keys, so the interval test stays within a page."""
    w = words.select(*(F.col(k).alias("_w" + k) for k in keys), "word_index", F.col("start").alias("_ws"), F.col("end").alias("_we"))
    on = (F.col("_ws") < F.col("end")) & (F.col("start") < F.col("_we"))
    for k in keys:
        on = on & (F.col(k) == F.col("_w" + k))
    joined = spans.join(w, on).groupBy(*keys, "span_id", "start", "end")
    found = joined.agg(
        F.count(F.lit(1)).alias("n_words"), F.min("word_index").alias("first_word"), F.max("word_index").alias("last_word"), F.min("_ws").alias("_s"), F.max("_we").alias("_e")
    )
    return found.filter((F.col("_s") == F.col("start")) & (F.col("_e") == F.col("end"))).drop("_s", "_e")


def at_or_before(points: DataFrame, markers: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each point with the value of the last marker at or before it in its key."""
    both = points.withColumns({value: F.lit(None).cast(markers.schema[value].dataType), "_point": F.lit(1)}).unionByName(
        markers.select(key, at, value).withColumn("_point", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_point = 1").drop("_point")


def carried(prior: DataFrame, after: DataFrame, keys: list[str], share: float = 0.1, most: float = 0.5) -> DataFrame:
    """(prior_id, after_id): occurrences of two revisions that match each other and no others.

    Equal keys, and rects alike within a tenth of the shortest side, 0.5 at most."""
    a = prior.select(F.col("id").alias("prior_id"), F.col("rect").alias("_a"), *(F.col(k).alias("_a" + k) for k in keys))
    b = after.select(F.col("id").alias("after_id"), F.col("rect").alias("_b"), *(F.col(k).alias("_b" + k) for k in keys))
    sides = [F.col(r)[hi] - F.col(r)[lo] for r in ("_a", "_b") for lo, hi in (("x0", "x1"), ("y0", "y1"))]
    tolerance = F.least(F.least(*sides) * share, F.lit(most)) + 1e-9
    on = F.least(*sides) > 0
    for c in ("x0", "y0", "x1", "y1"):
        on = on & (F.abs(F.col("_a")[c] - F.col("_b")[c]) <= tolerance)
    for k in keys:
        on = on & (F.col("_a" + k) == F.col("_b" + k))
    pairs = a.join(b, on).select("prior_id", "after_id")
    pairs = pairs.withColumns({"_p": F.count(F.lit(1)).over(Window.partitionBy("prior_id")), "_q": F.count(F.lit(1)).over(Window.partitionBy("after_id"))})
    return pairs.filter("_p = 1 AND _q = 1").drop("_p", "_q")


def token_values(masked: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Each token of the masked texts (key, masked) with the value it stands for: (key, tag, nth, at, value).

    The n-th token of a tag takes the n-th masked value (key, tag, start, value) of that tag; left over tokens have none."""
    pattern = r"\[[A-Z_]+\]"
    found = F.regexp_extract_all("masked", F.lit(pattern), F.lit(0))
    tokens = masked.select(key, F.posexplode(found).alias("at", "token")).withColumn("tag", F.expr("substr(token, 2, length(token) - 2)"))
    nth = F.row_number().over(Window.partitionBy(key, "tag").orderBy("at"))
    values = hits.withColumn("_n", F.row_number().over(Window.partitionBy(key, "tag").orderBy("start", "value")))
    values = values.select(F.col(key).alias("_k"), F.col("tag").alias("_t"), "_n", "value")
    joined = tokens.withColumn("nth", nth).join(values, (F.col(key) == F.col("_k")) & (F.col("tag") == F.col("_t")) & (F.col("nth") == F.col("_n")), "left")
    return joined.select(key, "tag", "nth", "at", "value")


def page_continuity(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_index, page_number, signatures) with ``signals``: the number follows the page before, or a header
    or footer line is shared with it."""
    w = Window.partitionBy("doc_id").orderBy("page_index")
    follows = F.col("page_number") == F.lag("page_number").over(w) + 1
    shared = F.arrays_overlap("signatures", F.lag("signatures").over(w))
    signals = F.array_compact(F.array(F.when(follows, F.lit("page_number_sequence")), F.when(shared, F.lit("repeated_header_footer"))))
    return pages.withColumn("signals", signals)
