"""Page geometry: lines, label values, containment, anti-overlap, clusters, boxes, ruled cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from .grouped import Rows, per_group

HEADER, FOOTER = 0.35, 0.65


def lines(words: DataFrame, keys: list[str], order: str = "word_index") -> DataFrame:
    """``words`` (keys, word_index, rect) with ``line``: in the order of y0, x0 and index, a word whose centre is further
    from the previous word's than the larger half height (3 at least) begins a line."""
    w = Window.partitionBy(*keys).orderBy(F.col("rect.y0"), F.col("rect.x0"), order)
    before = F.lag("rect").over(w)
    fresh = F.when(before.isNull(), 0).otherwise((~G.same_row(before, F.col("rect"))).cast("int"))
    return words.withColumn("_new", fresh).withColumn("line", F.sum("_new").over(w).cast("int")).drop("_new")


def line_boxes(lined: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, rect, n_words): the box around each line."""
    box = G.rect(F.min("rect.x0"), F.min("rect.y0"), F.max("rect.x1"), F.max("rect.y1"))
    return lined.groupBy(*keys, "line").agg(box.alias("rect"), F.count(F.lit(1)).alias("n_words"))


def band(r: Column, height: Column) -> Column:
    """header, footer or body, by a line's centre."""
    centre = (r["y0"] + r["y1"]) / 2 / height
    return F.when(centre >= FOOTER, "footer").when(centre <= HEADER, "header").otherwise("body")


def reading_text(lined: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line, text): the words of each line, joined from left to right."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rect.x0").alias("x"), F.col("word_index").alias("i"), F.col(text).alias("t"))))
    return lined.groupBy(*keys, "line").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"))


def label_values(labels: DataFrame, words: DataFrame, keys: list[str], reach: float = 96.0, most: int = 3) -> DataFrame:
    """The words right of a label on its row, at most ``reach`` away: the first ``most`` of them, then without labels.

    labels: keys, label_id, rect.  words: keys, word_index, rect, is_label."""
    w = words.select(*(F.col(k).alias("_w" + k) for k in keys), "word_index", F.col("rect").alias("word"), "is_label")
    on = G.same_row(F.col("rect"), F.col("word")) & (F.col("word")["x0"] >= F.col("rect")["x1"]) & (G.gap(F.col("rect"), F.col("word")) <= reach)
    for k in keys:
        on = on & (F.col(k) == F.col("_w" + k))
    near = labels.join(w, on)
    rank = F.row_number().over(Window.partitionBy(*keys, "label_id").orderBy(F.col("word")["x0"], "word_index"))
    return near.withColumn("rank", rank).filter((F.col("rank") <= most) & ~F.col("is_label")).select(*keys, "label_id", "word_index", "rank")


def containing(inner: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Each inner rect (keys, id, rect) with the region (keys, region_id, rect, state) around it: a confirmed one, else the first."""
    r = regions.select(*(F.col(k).alias("_r" + k) for k in keys), "region_id", F.col("rect").alias("_box"), "state")
    on = G.contains(F.col("_box"), F.col("rect"))
    for k in keys:
        on = on & (F.col(k) == F.col("_r" + k))
    best = F.min_by("region_id", F.struct((F.col("state") != "confirmed").cast("int"), "region_id"))
    return inner.join(r, on).groupBy(*keys, "id").agg(best.alias("region_id"), F.count(F.lit(1)).alias("n_regions"))


def apart_from(candidates: DataFrame, fixed: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (keys, rect) that overlap no fixed rect of the same keys."""
    f = fixed.select(*(F.col(k).alias("_f" + k) for k in keys), F.col("rect").alias("_fixed"))
    on = G.overlaps(F.col("rect"), F.col("_fixed"))
    for k in keys:
        on = on & (F.col(k) == F.col("_f" + k))
    return candidates.join(f, on, "left_anti")


def _cluster(key: dict, rows: Rows) -> Rows:
    """Numbers sets of rects that overlap, directly or through others, by their smallest id (union by sweep over x)."""
    rows = sorted(rows, key=lambda r: r["id"])
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    live: list[int] = []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i]["rect"]["x0"], i)):
        r = rows[i]["rect"]
        live = [j for j in live if rows[j]["rect"]["x1"] > r["x0"]]
        for j in live:
            o = rows[j]["rect"]
            if o["y0"] < r["y1"] and r["y0"] < o["y1"] and r["x0"] < r["x1"]:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        live.append(i)
    return [{**key, "id": r["id"], "cluster": rows[find(i)]["id"]} for i, r in enumerate(rows)]


def clusters(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, cluster): rects (keys, id, rect) of one page that overlap transitively; a page is one group."""
    kept = rects.select(*keys, "id", "rect")
    fields = [kept.schema[k] for k in keys] + [T.StructField(c, kept.schema["id"].dataType) for c in ("id", "cluster")]
    return per_group(kept, keys, _cluster, T.StructType(fields))


def boxes(clustered: DataFrame, rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster, rect, n): the box around each cluster."""
    joined = clustered.join(rects.select(*keys, "id", "rect"), [*keys, "id"])
    box = G.rect(F.min("rect.x0"), F.min("rect.y0"), F.max("rect.x1"), F.max("rect.y1"))
    return joined.groupBy(*keys, "cluster").agg(box.alias("rect"), F.count(F.lit(1)).alias("n"))


def collinear(rules: DataFrame, keys: list[str], axis: str, start: str, end: str, tolerance: float = 1.5) -> DataFrame:
    """Rules on one axis position that touch, as one: (keys, axis, start, end, n)."""
    w = Window.partitionBy(*keys).orderBy(axis, start, end)
    rows = rules.withColumn("_a", F.sum(F.when(F.col(axis) - F.lag(axis).over(w) <= tolerance, 0).otherwise(1)).over(w))
    v = Window.partitionBy(*keys, "_a").orderBy(start, end)
    reach = F.max(end).over(v.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_i", F.sum(F.when(F.col(start) <= reach + tolerance, 0).otherwise(1)).over(v))
    return rows.groupBy(*keys, "_a", "_i").agg(F.min(axis).alias(axis), F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_a", "_i")


def protected(masks: DataFrame, neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """Masks that cover some area of a protected neighbour: these block."""
    n = neighbours.select(*(F.col(k).alias("_n" + k) for k in keys), F.col("rect").alias("_near"))
    on = G.intersection(F.col("rect"), F.col("_near")) > 0
    for k in keys:
        on = on & (F.col(k) == F.col("_n" + k))
    return masks.join(n, on, "left_semi")


def merged_evidence(evidence: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Evidence rows (keys, id, rect, score) that overlap transitively as one: the best row, with the box around all.

    Rows that all have one and the same rect stay apart."""
    grouped = clusters(evidence, keys)
    joined = evidence.join(grouped, [*keys, "id"])
    box = G.rect(F.min("rect.x0"), F.min("rect.y0"), F.max("rect.x1"), F.max("rect.y1"))
    per = joined.groupBy(*keys, "cluster").agg(
        F.count_distinct("rect").alias("_kinds"), F.max_by("id", F.struct(F.col(score), -F.col("id"))).alias("_best"), box.alias("_box")
    )
    out = joined.join(per, [*keys, "cluster"]).filter((F.col("_kinds") == 1) | (F.col("id") == F.col("_best")))
    return out.withColumn("rect", F.when(F.col("_kinds") == 1, F.col("rect")).otherwise(F.col("_box"))).drop("_kinds", "_best", "_box", "cluster")
