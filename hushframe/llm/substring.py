"""Substring dedup: long repeated word spans found by de Bruijn compaction.

The graph: an edge is a k-mer of ``K + 1`` words, and joins two nodes, the windows of its first and its last ``K`` words.
A window that also starts in a document with a smaller doc_id is a repeat there, and the words it covers are
removed; every window is judged on the input.  Only the repeated part of the graph is ever made rows:

  copies    Of documents equal in their whole text (by 128 bits of SHA-256) only the first takes part; the others are repeats
            throughout.
  anchors   A window's anchor is the smallest-hashing ``M``-word run in it.  Equal windows have equal anchors, so only
            windows whose anchor another document has as well can be repeated; all others leave after one count by anchor.
  nodes     What is left is grouped to nodes.  A node keeps the place where it first starts, its source coordinate, and
            whether more than one word goes before it or follows it: its in- and out-degree.
  paths     A path goes on from a node to the next one in its source where neither branches on the side of the edge between
            them.  So its nodes lie side by side in one document, and no rounds of pointer doubling are needed to number
            them: their places do.
  spans     The windows of all later documents, joined with the nodes, are compacted to spans of such paths.
  verify    A span's words are read at its own place and at its source coordinates, and 128 bits of their SHA-256 must agree.
            Nodes are told apart by 64 bits of a hash; should a span ever fail, all is done again with 128 bits.

Scale: every step is a shuffle of narrow rows by a hash key, with map-side partial aggregation or a join that
adaptive execution may split where a node, anchor or source is hot; no step gathers more than what one document
has.  Documents are numbered in the order of their ids first, so that a number and a place make one 64-bit value.
The texts are dealt by document, compressed, in one exchange which all steps that need them reuse.  The result
is written to the shared folder with the digests that the check compares.

Edge cases: null and empty texts have no words; texts of fewer than ``K`` words lose none.  Rows without a
doc_id have no place in the order: they lose no words and remove none.  Rows of equal doc_id do
not remove from each other; repeated rows are treated alike.  ``dedup`` keeps the input's columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import stash, table

K, M = 13, 6
_U = np.uint64


@dataclass
class Pieces:
    """Runs of ``count`` windows from word ``start`` on that share an anchor; words are numbered over a chunk of texts."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray


def pieces(w: tokens.Words) -> Pieces:
    left = w.first[1:][w.text_of()] - np.arange(len(w.start))
    windows = np.flatnonzero(left >= K)
    if not len(windows):
        return Pieces(windows, windows, np.zeros(0, _U))
    grams = w.runs(M)
    # the smallest hash wins, then the leftmost place
    least, place, width, span = grams, np.arange(len(grams)), K - M + 1, 1

    def smaller(by: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(least) - by
        later = least[by:] < least[:n]
        return np.where(later, least[by:], least[:n]), np.where(later, place[by:], place[:n])

    while 2 * span <= width:
        least, place = smaller(span)
        span *= 2
    if span < width:
        least, place = smaller(width - span)
    place = place[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    return Pieces(windows[at], np.diff(np.append(at, len(windows))), grams[place[at]])


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _h, text) to (_id, _h, z): texts travel compressed, which the block codec does less well."""
    codec = pa.Codec("zstd", 6)
    for batch in batches:
        z = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["_id", "_h", "z"])


def _texts(batch: pa.RecordBatch, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of the texts packed in column z, as ``tokens.chunks`` gives them; rows without one are empty."""
    codec, lo, held, size, limit = pa.Codec("zstd"), 0, [], 0, limit or tokens.CHUNK_BYTES
    packed = batch.column("z")
    for row in range(batch.num_rows + 1):
        if held and (row == batch.num_rows or size > limit):
            at = np.concatenate([[0], np.cumsum([len(t) for t in held])])
            yield lo, row, np.frombuffer(b"".join(held), np.uint8), at
            lo, held, size = row, [], 0
        if row < batch.num_rows:
            z = packed[row].as_buffer() if packed[row].is_valid else None
            held.append(codec.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True) if z is not None else b"")
            size += len(held[-1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their partition and their place in it."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(at, at + batch.num_rows))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "i"])
        at += batch.num_rows


def _numbered(texts: DataFrame) -> DataFrame:
    """(_id, _h, o): the distinct rows numbered in their order, without gaps."""
    dealt = texts.select("_id", "_h").distinct().repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h")
    dealt = stash(dealt.mapInArrow(_count, "_id long, _h long, part int, i long"), "numbered")
    sizes = dealt.groupBy("part").agg((F.max("i") + 1).alias("n")).orderBy("part").collect()  # a row for each task
    ends = np.cumsum([r["n"] for r in sizes]).tolist()
    starts = [(r["part"], end - r["n"]) for r, end in zip(sizes, ends, strict=True)]
    starts = texts.sparkSession.createDataFrame(starts, "p int, start long")
    return dealt.join(F.broadcast(starts), F.col("part") == F.col("p")).select("_id", "_h", (F.col("i") + F.col("start")).alias("o"))


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(o, z, copy) to (a, o): the distinct anchors, ``width`` bits of each, of every row that has a number and is no copy."""
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("o").is_valid(), pc.is_null(batch.column("copy"))))
            for lo, _, data, at in _texts(batch):
                w = tokens.words(data, at)
                p = pieces(w)
                doc, anchor = tokens.distinct_by_text(w.text_of()[p.start], p.anchor >> _U(64 - width))
                yield pa.RecordBatch.from_arrays([_signed(anchor), batch.column("o").take(pa.array(lo + doc))], ["a", "o"])

    return run


def _keys(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return tokens.mix(anchor.astype(_U) ^ tokens.mix(doc.astype(_U), 6))


def _lists(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, pa.Array]:
    """Row numbers (from 0) and values of the lists in rows lo to hi."""
    part = column.slice(lo, hi - lo)
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(part).to_pylist()], np.int64)
    return np.repeat(np.arange(hi - lo), sizes), part.flatten()


def _node_keys(w: tokens.Words, start: np.ndarray, wide: bool) -> list[np.ndarray]:
    """The key of the window at each word: 64 bits, and as many again if ``wide``."""
    return [w.runs(K)[start], *([w.runs(K, second=True)[start]] if wide else [])]


def _beside_words(w: tokens.Words, start: np.ndarray) -> np.ndarray:
    """5 bits of the word before each window and of the word behind it (none where the text begins or ends), in the upper
    half as they are and in the lower half inverted: where a bit is set in both after an "or", windows differ."""
    text = w.text_of()[start]
    word = (tokens.mix(w.hash, 3) & _U(0x1F)).astype(np.int32)
    before, behind = np.maximum(start - 1, 0), np.minimum(start + K, len(word) - 1)
    both = np.where(start > w.first[text], word[before], 0) << 5 | np.where(start + K < w.first[text + 1], word[behind], 0)
    return both << 10 | (both ^ 0x3FF)


def _windows(bits: int, width: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(o, z, anchors) to (e, (f,) x, b): the windows with the listed anchors (31 bits of each), their key, number and place,
        and the words beside them."""
        for batch in batches:
            for lo, hi, data, at in _texts(batch):
                doc, listed = _lists(batch.column("anchors"), lo, hi)
                if not len(doc):
                    continue
                w = tokens.words(data, at)
                p = pieces(w)
                own = w.text_of()[p.start]
                i = np.flatnonzero(np.isin(_keys(own, p.anchor >> _U(64 - width) & _U(0x7FFFFFFF)), _keys(doc, listed.to_numpy())))
                count = p.count[i]
                start = np.repeat(p.start[i] - np.cumsum(count) + count, count) + np.arange(count.sum())
                doc = np.repeat(own[i], count)
                number = batch.column("o").slice(lo, hi - lo).fill_null(0).to_numpy()
                columns = [_signed(key) for key in _node_keys(w, start, wide)]
                columns += [pa.array((number[doc] << bits) + start - w.first[doc]), pa.array(_beside_words(w, start))]
                yield pa.RecordBatch.from_arrays(columns, ["e", *(["f"] if wide else []), "x", "b"])

    return run


def _places(column: pa.Array, lo: int, hi: int, *fields: str) -> tuple[np.ndarray, ...]:
    """Row numbers, and the fields of the structs listed in rows lo to hi."""
    doc, found = _lists(column, lo, hi)
    return doc, *(found.field(f).to_numpy(zero_copy_only=False).astype(np.int64) if len(doc) else np.zeros(0, np.int64) for f in fields)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _h, z, copy, spans, sources) to (..., n_words, n_removed, kept, spans, sources): spans and sources with the digests
    of their words."""
    for batch in batches:
        for lo, hi, data, at in _texts(batch, 1 << 20):
            w = tokens.words(data, at)
            n = w.counts
            listed = [_places(batch.column(c), lo, hi, "p", "n", "m") for c in ("spans", "sources")]
            doc, p, count, _ = listed[0]
            step = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(step, w.first[doc] + p, 1)
            np.add.at(step, w.first[doc] + p + count + K - 1, -1)
            copy = batch.column("copy").slice(lo, hi - lo).is_valid().to_numpy(zero_copy_only=False) & (n >= K)
            keep = (np.cumsum(step[:-1]) == 0) & ~np.repeat(copy, n)
            sums = np.concatenate([[0], np.cumsum(~keep)])
            gone = sums[w.first[1:]] - sums[w.first[:-1]]
            raw, texts, digests = data.tobytes(), [], [[], []]
            ends = [np.searchsorted(rows, np.arange(hi - lo + 1)).tolist() for rows, *_ in listed]
            for i, (b, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = raw[b:e].split()
                texts.append(b" ".join(compress(own, keep[w.first[i] : w.first[i + 1]].tolist()) if gone[i] else own))
                for out, end, (_, start, size, _) in zip(digests, ends, listed, strict=True):
                    mine = slice(end[i], end[i + 1])
                    for s, k in zip(start[mine].tolist(), size[mine].tolist(), strict=True):
                        out.append(hashlib.sha256(b" ".join(own[s : s + k + K - 1])).digest()[:16])
            columns = [batch.column("_id").slice(lo, hi - lo), batch.column("_h").slice(lo, hi - lo), pa.array(n), pa.array(gone)]
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            for (_, _, size, m), sha, end in zip(listed, digests, ends, strict=True):
                structs = pa.StructArray.from_arrays([pa.array(m), pa.array(size), pa.array(sha, pa.binary())], ["m", "n", "sha"])
                columns.append(pa.ListArray.from_arrays(pa.array(end, pa.int32()), structs))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_h", "n_words", "n_removed", "kept", "spans", "sources"])


_SHA = "array<struct<m:long,n:long,sha:binary>>"
_CUT = f"_id long, _h long, n_words long, n_removed long, kept string, spans {_SHA}, sources {_SHA}"


def _beside(packed: DataFrame, lists: DataFrame, *names: str) -> DataFrame:
    """Every packed text with what ``lists`` (_id, _h, names) has for it, if anything.  Always a left join on
    the same columns, so that the exchange of the texts is planned once and reused."""
    lists = lists.select(F.col("_id").alias("_lid"), F.col("_h").alias("_lh"), *names)
    return packed.join(lists, (F.col("_id") == F.col("_lid")) & (F.col("_h") == F.col("_lh")), "left").drop("_lid", "_lh")


def _again(*columns: str) -> list[Column]:
    """Columns under new names, as expressions: a join on them deals this side in an exchange of its own, which
    adaptive execution may split where a key is hot."""
    return [F.col(c).bitwiseXOR(F.lit(0)).alias("_" + c) for c in columns]


def graph(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The repeated nodes (keys, m, branches): where each first starts, and on which sides it branches (1: after, 2: before)."""
    nodes = windows.groupBy(*keys).agg(F.min("x").alias("m"), F.count(F.lit(1)).alias("n"), F.bit_or("b").alias("b"))
    differs = F.shiftright("b", 10).bitwiseAND(F.col("b"))
    branches = F.when(differs.bitwiseAND(F.lit(0x1F)) != 0, 1).otherwise(0) + F.when(differs.bitwiseAND(F.lit(0x3E0)) != 0, 2).otherwise(0)
    return nodes.filter("n > 1").select(*keys, "m", branches.alias("branches"))


def spans(windows: DataFrame, nodes: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(o, p, n, m): runs of n windows of document o from word p on that are a path's nodes from its source's place m on.

    A path goes on from a node to the next in its source where neither branches on the side of the edge between them."""
    same = [F.col(k) == F.col("_" + k) for k in keys]
    rows = windows.select(*keys, "x").join(nodes.select(*_again(*keys), "m", "branches"), same)
    rows = rows.select(F.shiftright("x", bits).alias("o"), F.col("x").bitwiseAND(F.lit((1 << bits) - 1)).alias("p"), "m", "branches")
    rows = rows.filter(F.col("o") > F.shiftright("m", bits))
    order = Window.partitionBy("o").orderBy("p")
    open_ = (F.lag("branches").over(order).bitwiseAND(F.lit(1)) == 0) & (F.col("branches").bitwiseAND(F.lit(2)) == 0)
    goes_on = (F.lag("p").over(order) == F.col("p") - 1) & (F.lag("m").over(order) == F.col("m") - 1) & open_
    rows = rows.select("o", "p", "m", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1).alias("new"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("o", "run").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"), F.min("m").alias("m")).select("o", "p", "n", "m")


def _widths(texts: DataFrame) -> tuple[int, int]:
    """Bits for the place of a word in the longest text, which with those for the number of a text must fit into 63; and
    bits of an anchor: 2**9 times as many as there can be words, so that few are equal by chance."""
    most, chars, rows = texts.agg(F.coalesce(F.max("chars"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(int(most) // 2 + 1, 1).bit_length()
    if bits + int(rows).bit_length() > 63:
        raise ValueError("too many texts beside one so long: number and place of a word do not fit into 63 bits")
    return bits, min(max((int(chars) // 2).bit_length() + 7, 32), 63)


def _removals(docs: DataFrame, doc_id: str, text: str, wide: bool) -> DataFrame:
    """(_id, _h, n_words, n_removed, kept, spans, sources) for every row, not yet verified."""
    source = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("text"))
    packed = source.mapInArrow(_pack, "_id long, _h long, z binary")
    texts = source.filter("_id IS NOT NULL AND text IS NOT NULL")
    equal = stash(texts.select("_id", "_h", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("sha"), F.length("text").alias("chars")), "texts")
    bits, width = _widths(equal)
    firsts = equal.groupBy("sha").agg(F.min("_id").alias("least"), F.max("_id").alias("last")).filter("least < last")
    copies = equal.join(firsts.select(F.concat("sha", F.lit(b"")).alias("_sha"), "least"), F.col("sha") == F.col("_sha"))
    copies = copies.filter("_id > least").select("_id", "_h").distinct().withColumn("copy", F.lit(True))
    numbers = _numbered(equal)

    # what the rows without a list have no part in is left to the workers: a filter would part the exchange of the texts
    marked = _beside(_beside(packed, numbers, "o"), copies, "copy")
    anchors = marked.select("o", "z", "copy").mapInArrow(_anchors(width), "a long not null, o long")
    shared = anchors.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*_again("a"))
    hits = anchors.join(shared, F.col("a") == F.col("_a"), "left_semi").groupBy("o").agg(F.collect_list(F.col("a").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("anchors"))
    placed = lambda lists: lists.withColumnRenamed("o", "_o").join(numbers, F.col("_o") == F.col("o")).drop("_o")
    listed = _beside(packed, placed(hits), "o", "anchors").select("o", "z", "anchors")
    keys = ["e", "f"] if wide else ["e"]
    windows = listed.mapInArrow(_windows(bits, width, wide), "".join(f"{k} long not null, " for k in keys) + "x long not null, b int not null")
    found = spans(windows, graph(windows, keys), keys, bits)
    # the texts of one doc_id do not remove from each other
    first = numbers.groupBy("_id").agg(F.min("o").alias("first"), F.max("o").alias("last")).filter("first < last").select(F.col("_id").alias("fid"), "first")
    several = numbers.join(first, F.col("_id") == F.col("fid")).select(F.col("o").alias("so"), "first")
    found = found.join(several, F.col("o") == F.col("so"), "left").filter(F.shiftright("m", bits) < F.coalesce("first", "o"))
    none = F.lit(None).cast("struct<p:long,n:long,m:long>")
    told = found.select("o", F.struct("p", "n", "m").alias("span"), none.alias("source"))
    wanted = found.select("m", "n").distinct()
    wanted = wanted.select(F.shiftright("m", bits).alias("o"), none.alias("span"), F.struct(F.col("m").bitwiseAND(F.lit((1 << bits) - 1)).alias("p"), "n", "m").alias("source"))
    told = placed(told).unionByName(placed(wanted)).groupBy("_id", "_h").agg(F.collect_list("span").alias("spans"), F.collect_list("source").alias("sources"))
    return _beside(_beside(packed, told, "spans", "sources"), copies, "copy").mapInArrow(_cut, _CUT)


def unverified(cut: DataFrame) -> DataFrame:
    """The spans (m, n, sha) whose words are not those at their source coordinates."""
    mine = cut.select(F.inline("spans"))
    theirs = cut.select(F.inline("sources")).select(F.col("m").alias("sm"), F.col("n").alias("sn"), F.col("sha").alias("source_sha"))
    both = mine.join(theirs, (F.col("m") == F.col("sm")) & (F.col("n") == F.col("sn")), "left")
    return both.filter(~F.col("sha").eqNullSafe(F.col("source_sha")))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kept: Column | None = None) -> DataFrame:
    """(_id, _h, n_words, n_removed, kept) for every row; _h: the text's hash; kept: what to keep of the kept text."""
    for wide in (False, True):
        rows = _removals(docs, doc_id, text, wide)
        cut = stash(rows if kept is None else rows.withColumn("kept", kept), "cut")
        if unverified(cut).isEmpty():
            return cut.drop("spans", "sources")
    raise RuntimeError("two different windows have the same 128-bit hash")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's rows with ``n_words``, ``n_removed`` and ``kept`` (the kept words joined by one space), which
    replace columns of those names.  Columns besides id and text are joined back by id and text."""
    added = ["n_words", "n_removed", "kept"]
    cut = removals(docs, doc_id, text).dropDuplicates(["_id", "_h"]).withColumnsRenamed({"_id": "__hf_cid", "_h": "__hf_ch"})
    others = [c for c in docs.columns if c not in added]
    keyed = docs.select(*others, F.xxhash64(F.col(text)).alias("__hf_h"))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__hf_cid")) & (F.col("__hf_h") == F.col("__hf_ch"))
    return keyed.join(cut, same).select(*others, *added)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = removals(table(spark, sf_dir, "documents"), kept=F.unhex(F.sha2("kept", 256)))
    return cut.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i AS p, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM later),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op3_substring_dedup": op3_substring_dedup}
SQL = {"op3_substring_dedup": _SQL}
