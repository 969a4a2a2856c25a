"""Region dictionary from the official table of administrative names, as long rows (kind, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V

# What marks a row as in force, a province's endings, and short names kept however rare.
IN_FORCE = ("", "존재", "현존", "0", "n", "no", "false", "active")
PROVINCE_ENDINGS = ("특별시", "광역시", "특별자치시", "특별자치도", "자치도", "도")
KEPT_SHORT_NAMES = tuple(V.WEAK_PLACES)


def level(code: Column) -> Column:
    """Which level of region a ten-digit code stands for, by its trailing zeros."""
    d = F.regexp_replace(code, r"(?U)\D+", "")
    return (
        F.when(F.length(d) < 10, "unknown")
        .when(F.substr(d, F.lit(3)) == "00000000", "sido")
        .when(F.substr(d, F.lit(6)) == "00000", "sigungu")
        .when(F.substr(d, F.lit(9)) == "00", "eupmyeondong")
        .otherwise("ri")
    )


def in_force(status: Column) -> Column:
    return F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*IN_FORCE)


def dictionary(rows: DataFrame, keep_disused: bool = False) -> DataFrame:
    """(kind, term) from rows (code, name, status): provinces, districts, neighbourhoods, villages, provinces
    without districts, and weak names (names that stand for a place only by themselves)."""
    spaced = F.regexp_replace(F.trim(F.coalesce("name", F.lit(""))), r"(?U)\s+", " ")
    current = rows if keep_disused else rows.filter(in_force(F.col("status")))
    named = current.select(spaced.alias("name"), level(F.col("code")).alias("level")).filter("name <> ''")
    ending = F.lit(False)
    for e in PROVINCE_ENDINGS:
        ending = ending | F.col("name").endswith(e)
    sido = named.filter((F.col("level") == "sido") | (ending & ~F.col("name").contains(" "))).select(F.col("name").alias("sido")).distinct()
    # a name's province is its longest leading part that is one; provinces are single words, or two at most
    heads = F.array(F.substring_index("name", " ", 1), F.substring_index("name", " ", 2))
    owned = named.withColumn("head", F.explode(F.array_distinct(heads))).join(sido, F.col("head") == F.col("sido"))
    owner = owned.groupBy("name").agg(F.max_by("sido", F.length("sido")).alias("owner")).withColumnRenamed("name", "_n")
    tail = F.trim(F.when(F.col("owner").isNull(), F.col("name")).otherwise(F.substr(F.col("name"), F.length("owner") + 1)))
    parts = named.join(owner, F.col("name") == F.col("_n"), "left").withColumn("tail", tail).withColumn("last", F.substring_index("tail", " ", -1))
    has = F.col("tail") != ""
    at = lambda k: (F.col("level") == k) & has
    term = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.col(value).alias("term"))
    terms = F.array(
        F.when(at("sigungu"), term("sigungu", "tail")),
        F.when(at("sigungu"), term("sigungu", "last")),
        F.when(at("eupmyeondong"), term("eupmyeondong", "last")),
        F.when(at("eupmyeondong") & ~F.col("tail").contains(" ") & F.col("owner").isNotNull(), term("single_tier_sido", "owner")),
        F.when(at("ri"), term("ri", "last")),
    )
    found = parts.select(F.explode(F.array_compact(terms)).alias("t")).select("t.kind", "t.term")
    counted = parts.filter(has & F.col("level").isin("eupmyeondong", "ri")).groupBy(F.col("last").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    place = (F.col("term").endswith("동")) | (F.col("term").endswith("리"))
    weak = (F.length("term") == 3) | ((F.length("term") == 2) & ((F.col("n") > 1) | F.col("term").isin(*KEPT_SHORT_NAMES)))
    all_ = found.unionByName(sido.select(F.lit("sido").alias("kind"), F.col("sido").alias("term")))
    return all_.unionByName(counted.filter(place & weak).select(F.lit("weak_place_names").alias("kind"), "term")).distinct()


def seed(spark: SparkSession) -> DataFrame:
    """The built-in dictionary."""
    kinds = {"sido": V.SIDO, "sigungu": V.SIGUNGU, "eupmyeondong": V.EUPMYEONDONG, "weak_place_names": V.WEAK_PLACES}
    return spark.createDataFrame([(k, t) for k, terms in kinds.items() for t in terms], "kind string, term string")
