"""Quality rules: a threshold table compiled into one Spark projection.

``METRICS`` are native expressions over a text, ``RULES`` a table of integer ratio bounds on them.
``judge`` adds all metrics and verdicts in one projection without user functions, so the work
streams through the scan: no shuffle, no state, any lost task is simply rerun.

Edge cases: a null or empty text has no words, fails the base rule and is rejected.  Repeated rows
are judged one by one.  Columns of the input that clash with the metrics' names are replaced in
``judge``'s result; ``accept`` returns the input's own columns unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Characters that count as symbols, and what separates words.
SYMBOLS = "#*$%&|<>"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WINDOW = 5
#: Very common words of the languages the corpus is in.
STOP_WORDS = tuple(
    "the of and to a in is that it for was on with as by this be are at from "
    "de la le et en les des un du une que pour est qui dans par au sur avec pas "
    "der die und den von das zu sich mit auf nicht ist dem im eine ein als "
    "el y los las se del por con su no".split()
)


@dataclass(frozen=True)
class Rule:
    """low <= 100 * part / whole <= high, for texts of at least ``from_words`` words."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0

    def broken(self, col: Callable[[str], Column]) -> Column:
        part, whole = F.lit(100) * col(self.part), col(self.whole)
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (part < self.low * whole)
        if self.high is not None:
            bad = bad | (part > self.high * whole)
        return bad & (col("n_words") >= self.from_words)

    def sql(self) -> str:
        bounds = [f"100 * {self.part} < {self.low} * {self.whole}"] * (self.low is not None)
        bounds += [f"100 * {self.part} > {self.high} * {self.whole}"] * (self.high is not None)
        return f"(({' OR '.join(bounds)}) AND n_words >= {self.from_words})"


#: Judged first; a text that fails one is ``base_failed``.
BASE_RULES = (
    Rule("few_words", "n_words", "one", low=1000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=20),
)
#: The rest of the threshold table, in percent.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=2, from_words=30),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=60),
    Rule("list_lines", "n_list_lines", "n_lines", high=90),
    Rule("cut_lines", "n_cut_lines", "n_lines", high=50),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, inside one projection."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def windows_of(words: Column, k: int) -> Column:
    """The k-word windows of an array of words, as strings."""
    n = F.size(words) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(
        F.array().cast("array<string>")
    )


def repeated_cover(words: Column, k: int) -> Column:
    """How many words lie in a k-word window that the text holds twice or more.

    Most texts hold each window once, which distinct hashes prove; only the others are sorted,
    by the words themselves.
    """

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

        def places(s: Column) -> Column:
            def twice(x: Column, j: Column) -> Column:
                same = x["w"].eqNullSafe(F.get(s, j - 1)["w"]) | x["w"].eqNullSafe(F.get(s, j + 1)["w"])
                return F.when(same, x["p"])

            return F.array_sort(F.filter(F.transform(s, twice), lambda p: p.isNotNull()))

        def add(acc: Column, p: Column) -> Column:
            return F.struct((p + k).alias("end"), (acc["n"] + F.least(F.lit(k), p + k - acc["end"])).alias("n"))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(let(ordered, places), start, add, lambda acc: acc["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    once = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) <= k, F.lit(0)).when(once, F.lit(0)).otherwise(let(windows_of(words, k), covered))


def metrics(text: Column) -> Column:
    """A struct of every metric of a text (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))
    has_word = lambda line: F.length(F.trim(F.translate(line, "\t\x0b\x0c\r", "    "))) > 0

    def of(words: Column, lines: Column, text: Column) -> Column:
        full = F.filter(lines, has_word)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
            let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
            repeated_cover(words, WINDOW).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(full).cast("long").alias("n_lines"),
            F.size(F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* "))).cast("long").alias("n_list_lines"),
            F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_cut_lines"),
            F.lit(1).cast("long").alias("one"),
        )

    return let(text, lambda t: let(words_of(t), lambda w: let(F.split(t, "\n"), lambda x: of(w, x, t))))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> Column:
    """Names of the rules that a struct of metrics breaks, base rules first."""
    names = [F.when(r.broken(lambda c: m[c]), F.lit(r.name)) for r in (*base, *rules)]
    return F.concat_ws(",", *names)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every metric, ``broken`` (names of broken rules), ``base_failed`` and ``kept``."""
    base = [r.broken(lambda c: F.col("__hf_m")[c]) for r in BASE_RULES]
    failed = base[0]
    for b in base[1:]:
        failed = failed | b
    names = [c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_list_lines", "n_cut_lines")]
    out = docs.withColumn("__hf_m", metrics(F.col(text)))
    out = out.withColumn("__hf_broken", verdict(F.col("__hf_m"), rules))
    return (
        out.withColumns({n: F.col("__hf_m")[n] for n in names} | {"base_failed": failed, "broken": F.col("__hf_broken"), "kept": F.col("__hf_broken") == ""})
        .drop("__hf_m", "__hf_broken")
    )


def accept(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that break no rule, with their own columns."""
    return docs.filter(let(metrics(F.col(text)), lambda m: verdict(m, rules)) == "")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "broken")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    named = [f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in (*BASE_RULES, *RULES)]
    base = " OR ".join(r.sql() for r in BASE_RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents
), win AS (
  SELECT rid, i AS p, array_to_string(w[i:i + 4], ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
         len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
         len(list_filter(l, lambda x: x LIKE '- %' OR x LIKE '* %')) AS n_list_lines,
         len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_cut_lines,
         1 AS one
  FROM d LEFT JOIN covered USING (rid)
), v AS (SELECT *, concat_ws(',', {", ".join(named)}) AS broken, ({base}) AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, broken = '' AS kept, n_stop_words::BIGINT AS n_stop_words,
       n_lines::BIGINT AS n_lines, broken
FROM v"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL = {"op2_quality_rules": _sql()}
