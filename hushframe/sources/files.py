"""Documents from files: text in several encodings, content identity, connectors, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes read as text, and encodings in the order they are tried.
TEXT_SUFFIXES = ("txt", "md", "csv", "log")
ENCODINGS = ("utf-8", "cp949", "euc-kr")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind(path: Column) -> Column:
    return F.when(suffix(path).isin(*TEXT_SUFFIXES), "text").when(suffix(path) == "pdf", "pdf").otherwise("unsupported")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, length, kind, content) of all files under a folder, by Spark's reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", kind(F.col("path")).alias("kind"), "content")


def _decode(content: bytes | None) -> tuple[str | None, str | None]:
    for encoding in ENCODINGS if content is not None else ():
        try:
            return content.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return None, None


def decoded(content: Column) -> Column:
    """The text in the first encoding that fits, and which (text, encoding); nulls if none does."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decode(c) for c in values], columns=["text", "encoding"])

    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "text string, encoding string")(content)


def text_documents(files: DataFrame) -> DataFrame:
    """(path, sha256, text, engine, failures): text files as documents; others and unreadable ones with a reason."""
    rows = files.withColumn("_d", F.when(F.col("kind") == "text", decoded(F.col("content"))))
    failure = F.when(F.col("kind") == "unsupported", "UNSUPPORTED_SUFFIX").when(F.col("kind") == "pdf", "PDF_CONNECTOR_MISSING").when(F.col("_d.text").isNull(), "ENCODING_UNSUPPORTED")
    engine = F.when(F.col("_d.text").isNotNull(), F.concat(F.lit("text:"), F.col("_d.encoding")))
    return rows.select("path", "sha256", F.col("_d.text").alias("text"), engine.alias("engine"), F.array_compact(F.array(failure)).alias("failures"))


Engine = Callable[[bytes], str]


def with_engines(files: DataFrame, engines: dict[str, Engine]) -> DataFrame:
    """PDF texts by the first engine that succeeds, the failures of those before it kept as codes.

    ``engines`` are Python callables given by the caller, in order of preference; none is built in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                text, used, failed = None, None, []
                for name, engine in engines.items():
                    try:
                        text, used = engine(bytes(content)), name
                        break
                    except Exception as e:  # an engine's failure is data: it is recorded and the next one tried
                        failed.append(f"{name}:{type(e).__name__}")
                out.append((text, used, failed if text is not None else [*failed, "EXTRACTION_FAILED"]))
            yield pd.concat([batch[["path", "sha256"]].reset_index(drop=True), pd.DataFrame(out, columns=["text", "engine", "failures"])], axis=1)

    return files.select("path", "sha256", "content").mapInPandas(run, "path string, sha256 string, text string, engine string, failures array<string>")


def corpus(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (sha256, name) with their path; ``n_files`` other than 1 is a broken corpus."""
    n = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return manifest.join(n, "sha256", "left").select("sha256", "name", "path", F.coalesce("n", F.lit(0)).cast("long").alias("n_files"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, same): whether each file still has the content it had."""
    b, a = before.select("path", F.col("sha256").alias("_b")), after.select("path", F.col("sha256").alias("_a"))
    return b.join(a, "path", "full_outer").select("path", F.col("_b").eqNullSafe(F.col("_a")).alias("same"))


def write_masked(masked: DataFrame, path: str) -> None:
    """Masked texts, as Parquet; refuses to overwrite."""
    masked.write.mode("errorifexists").parquet(path)


def write_texts(masked: DataFrame, folder: str, key: str = "doc_id", text: str = "masked") -> None:
    """Every masked text as a UTF-8 file of its own, ``folder``/``key``=value/part-*.txt, ended by a line break; refuses to overwrite."""
    rows = masked.select(F.col(key), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", "").alias("value"))
    rows.write.mode("errorifexists").partitionBy(key).text(folder)


def write_report(report: DataFrame, path: str) -> None:
    """A count-only report as JSON lines; refuses to overwrite."""
    report.write.mode("errorifexists").json(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(kind, term) from a dictionary file: one JSON object of string arrays."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, string>").alias("m"))
    rows = raw.select(F.explode("m").alias("kind", "v"))
    terms = rows.select("kind", F.explode(F.from_json("v", "array<string>")).alias("term"))
    return terms.filter(F.trim("term") != "").select("kind", F.trim("term").alias("term")).distinct()


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Predictions, one JSON object a line; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
