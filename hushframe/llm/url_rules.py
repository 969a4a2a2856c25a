"""URL filters: fixed host and path rules, and rules mined from labels by FP-growth.

A URL's tokens are its host's labels, domain, path segments (numbers as one shape), file ending, query keys
and fragment.  ``mine`` finds the token combinations that imply a bad label with enough support and confidence, and of
which no part does: first the single tokens; then Spark's FP-growth over what is left of the labelled URLs, together with the
label.  What is left are the frequent tokens that are no rule themselves (a longer rule with such a one would be redundant),
and of tokens that lie in the very same URLs only the first (by two 64-bit sums over the URLs), so that a deep path is one item
and not two to the power of its segments.  A rule's token then stands for any of those it was found with.  ``match`` finds the rules
by an inverted index: each rule is listed under its rarest token, a URL's tokens look up that list, and the rule's other
tokens are then compared.

Scale: distinct URLs are tokenised and matched once, by joins on token and URL whose hot partitions
adaptive execution may split; all labelled rows are mined, in Spark's own distributed FP-growth.  Its cost grows with the
number of frequent combinations: many tokens that nearly, but not quite, share their URLs remain dear.  The fixed
rules are a short list given by the caller, compiled into one expression.

Edge cases: a null URL, or one without ``://``, has empty host and path, no tokens and no fixed rule, and is
allowed.  Repeated rows are judged alike, and count as often as they are there in mining.  Empty tables mine no rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash, table

#: Support in labelled URLs (a share, and a number at least) and confidence that a mined rule needs.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.0005, 20, 0.8
_BAD = "label=bad"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
FIXED = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _AZ, _az)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits; null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    labels = F.split(host_of(url), r"\.")
    domain = F.concat(F.lit("domain="), F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."))
    sub = F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0)))
    sub = F.flatten(F.transform(sub, lambda x: F.array_distinct(F.concat(F.array(x), F.split(x, "-")))))
    segments = F.array_remove(F.split(path_of(url), "/"), "")
    ending = F.regexp_extract(F.element_at(F.concat(F.array(F.lit("")), segments), -1), r"(\.[A-Za-z]{1,5})$", 1)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.array_remove(F.split(query, "&"), ""), lambda x: F.concat(F.lit("query="), F.split(x, "=")[0]))
    shape = lambda x: F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z]{1,5}$", ""), r"[0-9]+", "0")
    parts = [
        F.array(domain),
        F.transform(sub, lambda x: F.concat(F.lit("host="), x)),
        F.transform(segments, lambda x: F.concat(F.lit("path="), shape(x))),
        F.when(ending != "", F.array(F.concat(F.lit("ending="), ending))).otherwise(F.array().cast("array<string>")),
        keys,
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.when(F.coalesce(host_of(url), F.lit("")) != "", F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


_RULES = "tokens array<array<string>>, confidence double, support double, anchor array<string>"


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, confidence, support, anchor) from labelled URLs (url, bad: boolean); tokens: for each token of the rule, all
    that lie in the very same URLs."""
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    baskets = labelled.filter("bad IS NOT NULL").select("bad", tokens(F.col("url")).alias("_t")).filter(F.size("_t") > 0)
    baskets = stash(baskets.withColumn("b", F.monotonically_increasing_id()), "baskets")
    n = baskets.count()
    if not n or min_count > n:
        return spark.createDataFrame([], _RULES)
    least = max(ceil(min_support * n), min_count)
    seen = baskets.select("b", "bad", F.explode("_t").alias("token"))
    where = [F.bit_xor(F.xxhash64(F.lit(i), "b")).alias(f"s{i}") for i in (1, 2)]
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), *where).filter(F.col("bad") >= least)
    groups = counts.groupBy("n", "bad", "s1", "s2").agg(F.array_sort(F.collect_list("token")).alias("any"))
    groups = stash(groups.select("any", F.col("any")[0].alias("first"), "n", "bad", (F.col("bad") >= min_confidence * F.col("n")).alias("alone")), "tokens")
    rules = groups.filter("alone").select(F.array("first").alias("firsts"), (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / n).alias("support"))

    # a token of every URL adds no evidence beside others
    rest = groups.filter(~F.col("alone") & (F.col("n") < n)).select("first")
    reduced = seen.join(rest, F.col("token") == F.col("first")).groupBy("b", "bad").agg(F.collect_list("token").alias("_t"))
    items = F.concat("_t", F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>")))
    reduced = stash(reduced.select(items.alias("items")), "reduced")
    m = reduced.count()
    if m >= least:
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / m, minConfidence=min_confidence).fit(reduced)
        found = model.associationRules.filter((F.col("consequent")[0] == _BAD) & (F.size("antecedent") > 1))
        found = stash(found.select(F.array_sort("antecedent").alias("firsts"), "confidence", (F.col("support") * m / n).alias("support")), "rules")
        rules = rules.unionByName(_least(found, groups))
    described = rules.select("firsts", F.explode("firsts").alias("f")).join(groups.select("first", "any", "n"), F.col("f") == F.col("first"))
    described = described.groupBy("firsts").agg(F.array_sort(F.collect_list("any")).alias("tokens"), F.min(F.struct("n", "any")).alias("a"))
    described = described.select(F.col("firsts").alias("_k"), "tokens", F.col("a.any").alias("anchor"))
    return stash(rules.join(described, F.col("firsts") == F.col("_k")).select("tokens", "confidence", "support", "anchor"), "pruned-rules")


def _least(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """The rules (firsts, ...) of whose tokens no other rule has a part; parts are looked up by their rarest token."""
    listed = rules.select("firsts", F.explode("firsts").alias("t")).join(groups.select("first", "n"), F.col("t") == F.col("first"))
    part = listed.groupBy("firsts").agg(F.min(F.struct("n", "t")).alias("a")).select(F.col("firsts").alias("pt"), F.col("a.t").alias("pa"))
    wide = listed.select("firsts", "t").join(part, F.col("t") == F.col("pa"))
    wide = wide.filter((F.size("pt") < F.size("firsts")) & (F.size(F.array_except("pt", "firsts")) == 0)).select(F.col("firsts").alias("_w")).distinct()
    return rules.join(wide, F.col("firsts") == F.col("_w"), "left_anti")


def match(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(__hf_url, mined_rule): each distinct URL that a mined rule matches, with its most confident one."""
    seen = urls.select(F.col(url).alias("__hf_url")).filter("__hf_url IS NOT NULL").distinct().withColumn("_t", tokens(F.col("__hf_url")))
    index = rules.select(F.explode("anchor").alias("anchor"), F.col("tokens").alias("_rt"), "confidence")
    hits = seen.withColumn("_a", F.explode("_t")).join(index, F.col("_a") == F.col("anchor"))
    hits = hits.filter(F.forall("_rt", lambda any_: F.arrays_overlap(any_, F.col("_t"))))
    name = F.array_join(F.transform("_rt", lambda any_: any_[0]), "&")
    best = hits.groupBy("__hf_url").agg(F.max(F.struct("confidence", name.alias("r"))).alias("b"))
    return best.select("__hf_url", F.col("b.r").alias("mined_rule"))


def judge(pages: DataFrame, mined: DataFrame, rules: Sequence[Rule] = FIXED, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, mined_rule and verdict (which replace columns of those names)."""
    names = ("host", "path", "rule", "mined_rule", "verdict")
    keep = [c for c in pages.columns if c not in names]
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("__hf_f", fixed_rule(F.col("host"), F.col("path"), rules))
    if mined.isEmpty():
        rows = rows.withColumn("mined_rule", F.lit(None).cast("string"))
    else:
        found = stash(match(pages, mined, url), "matched")
        rows = rows.join(found, F.col(url) == F.col("__hf_url"), "left")
    method = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(*keep, "host", "path", F.col("__hf_f.rule").alias("rule"), "mined_rule", F.coalesce(F.col("__hf_f.verdict"), method).alias("verdict"))


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", "bad")
    return judge(pages, mine(labelled)).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


QUERIES = {"op1_url_rules": op1_url_rules}
SQL: dict[str, str] = {}
