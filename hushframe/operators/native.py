"""Number-like recognisers as JVM expressions: hits with offsets and occluded text without leaving Catalyst.

A hit is replaced in the working text by a run of one private character of equal length, so offsets stay source
offsets through all rules.  Only the rules whose values are numbers or addresses of mail take part; they need no
guard.  The Python cascade in ``fold`` is the reference for all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import rules

#: The recognisers that need no more than their pattern, in order.
NATIVE_TAGS = ("CARD", "RRN", "FOREIGN_REG", "BUSINESS_REG_NO", "PHONE", "PASSPORT", "EMAIL")
HIT = "array<struct<tag:string,start:int,end:int,value:string>>"


def _java(pattern: str) -> str:
    return "(?Ud)" + pattern.replace("(?P<", "(?<")


def found(text: Column, pattern: str, tag: str) -> Column:
    """Array of hits of a pattern: matches, each preceded by the text between it and the one before."""
    java = _java(pattern)
    values, between = F.regexp_extract_all(text, F.lit(java), F.lit(0)), F.split(text, java, -1)

    def place(value: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x))
        before = before + F.aggregate(F.slice(values, 1, i), F.lit(0), lambda a, x: a + F.length(x))
        return F.struct(F.lit(tag).alias("tag"), before.alias("start"), (before + F.length(value)).alias("end"), value.alias("value"))

    return F.transform(values, place)


def occluded(text: Column, hits: Column, mark: str) -> Column:
    """The text with each hit as a run of ``mark``."""

    def step(acc: Column, h: Column) -> Column:
        text = F.concat(acc["text"], F.substr(acc["rest"], F.lit(1), h["start"] - acc["at"]), F.repeat(F.lit(mark), h["end"] - h["start"]))
        return F.struct(text.alias("text"), F.substr(acc["rest"], h["end"] - acc["at"] + 1).alias("rest"), h["end"].alias("at"))

    start = F.struct(F.lit("").alias("text"), text.alias("rest"), F.lit(0).alias("at"))
    return F.when(F.size(hits) == 0, text).otherwise(F.aggregate(hits, start, step, lambda a: F.concat(a["text"], a["rest"])))


def detect(docs: DataFrame, text: str = "text", tags: tuple[str, ...] = NATIVE_TAGS) -> DataFrame:
    """The input with ``work`` (occluded text) and ``hits``; a null text is the empty text."""
    out = docs.withColumns({"work": F.coalesce(F.col(text), F.lit("")), "hits": F.array().cast(HIT)})
    for i, rule in enumerate(r for r in rules() if r.tag in tags and r.kind == "whole"):
        needs = r"\p{Nd}" if rule.needs.pattern == r"\d" else rule.needs.pattern
        own = F.when(F.col("work").rlike(needs), found(F.col("work"), rule.pattern.pattern, rule.tag)).otherwise(F.array().cast(HIT))
        out = out.withColumn("_own", own)
        out = out.withColumns({"work": occluded(F.col("work"), F.col("_own"), chr(0xE000 + i)), "hits": F.concat("hits", "_own")})
    return out.drop("_own").withColumn("hits", F.array_sort("hits", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)))


def rendered(text: Column, hits: Column, replacement) -> Column:
    """The text with each hit (apart, in order) replaced by ``replacement(hit)``."""

    def step(acc: Column, h: Column) -> Column:
        text = F.concat(acc["text"], F.substr(acc["rest"], F.lit(1), h["start"] - acc["at"]), replacement(h))
        return F.struct(text.alias("text"), F.substr(acc["rest"], h["end"] - acc["at"] + 1).alias("rest"), h["end"].alias("at"))

    start = F.struct(F.lit("").alias("text"), text.alias("rest"), F.lit(0).alias("at"))
    return F.when(F.size(hits) == 0, text).otherwise(F.aggregate(hits, start, step, lambda a: F.concat(a["text"], a["rest"])))
