"""Near-duplicate documents by HyperMinHash, with every link confirmed on the full shingle sets.

A document is the set of its distinct five-word shingles (A-Z lower-cased; fewer words: the whole
sequence).  Documents with the same sequence of words (by 128 bits of BLAKE2) form a class, handled once.  Two classes are linked when
100 * |intersection| >= 75 * |union|; components follow the links.

Sketch: ``REGISTERS`` buckets, each with a hash function of its own over all shingles (so that no
bucket of a small set is empty), each storing the minimum as leading-zero count (6 bits) and the
``MANTISSA`` bits after the leading one.  Banding: ``BANDS`` keys of ``ROWS`` registers each; a pair at the
threshold shares none of them with probability (1 - 0.75**5)**40 = 2e-5, at 0.8 with 1e-7.

Candidates, without all pairs of a bucket:
  1. every member of a bucket against the bucket's leader, the member that shares most buckets with others;
  2. in buckets that still hold several components, every member outside the leader's component
     against a leader that each band draws anew;
  3. the members of buckets that are still mixed by prefixes of their sets: in one order of all shingles, rarest first, the
     smallest shingle that a linked pair shares is among the first n - 6n/7 + 1 of the smaller set and the
     first n - 3n/4 + 1 of the larger, and from it on both have what they must share.  Pairs of different components that share
     such a shingle, not both in the largest component of all their buckets, have their sketches compared; the texts are
     fetched for what passes.  Documents of one template have their own shingles first, so they do not meet.
A candidate is dropped if its collision-corrected Jaccard estimate is ``MARGIN`` (five standard deviations)
below the threshold; all others are verified on the full sets of their texts, where shingles are compared by their words.
So no list is capped: a hot bucket costs its size times the number of leaders, and its unsettled members the
shingles they have.

Scale: the sketch (400 bytes) and 40 band keys per class are shuffled; the texts only of classes that
share a band with another.  All intermediates lie in the shared folder.

Edge cases: null or empty texts have an empty set and are never linked.  Repeated rows, and rows
of one doc_id with several texts, are each listed.  A component's id is its smallest doc_id; rows without
a doc_id never name a component unless it has no other (then null, and kept).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .shared import stash, table

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, MANTISSA = 40, 5, 10
REGISTERS = BANDS * ROWS
MARGIN = 0.16
#: How often labels are handed on between rounds.
LABEL_ROUNDS = 3
#: Bytes of texts that are compared at a time, besides one pair of any size.
PAIR_BYTES = 1 << 20
_U = np.uint64
_draw = np.random.Generator(np.random.PCG64(20240229))
_XOR = _draw.integers(0, 2**63, REGISTERS, dtype=_U) * _U(2) + _draw.integers(0, 2, REGISTERS, dtype=_U)
_MUL = _draw.integers(0, 2**63, REGISTERS, dtype=_U) * _U(2) + _U(1)


def registers(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (sets x REGISTERS, 16 bits) of the hash sets that begin at ``starts``.

    A 64-bit float holds a leading-bit position and the bits after it; both are read off its top."""
    least = np.empty((REGISTERS, len(starts)), _U)
    for k in range(REGISTERS):
        least[k] = np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], starts)
    as_float = np.maximum(least & ~_U(0x7FF), _U(1)).astype(np.float64).view(_U)
    exponent_and_bits = (as_float >> _U(52 - MANTISSA)) - _U(1023 << MANTISSA)
    zeros = _U(63) - (exponent_and_bits >> _U(MANTISSA))
    return np.ascontiguousarray((zeros << _U(MANTISSA) | exponent_and_bits & _U((1 << MANTISSA) - 1)).astype(np.uint16).T)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from registers, less the registers expected to be equal by chance."""
    ratio = n / m
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / 2**MANTISSA
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _h, text) to (_id, _h, n, cls, sig)."""
    for batch in batches:
        for lo, hi, data, at in tokens.chunks(batch.column(2)):
            text, h = tokens.shingles(tokens.words(data, at, lower=True), SHINGLE)
            n = np.bincount(text, minlength=hi - lo)
            cls, sig = [None] * (hi - lo), [None] * (hi - lo)
            if len(h):
                present = np.flatnonzero(n)
                regs, raw = registers(h, np.searchsorted(text, present)), data.tobytes()
                for i, r in zip(present.tolist(), regs, strict=True):
                    words = b" ".join(raw[at[i] : at[i + 1]].lower().split())
                    cls[i], sig[i] = hashlib.blake2b(words, digest_size=16).hexdigest(), r.tobytes()
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.string()), pa.array(sig, pa.binary())],
                ["_id", "_h", "n", "cls", "sig"],
            )


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _h, n, cls, sig) per row: id and text hash, set size, class and registers (null for empty sets)."""
    source = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("text"))
    return source.mapInArrow(_sketch, "_id long, _h long, n long, cls string, sig binary")


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ka, kb, n_a, sig_a, n_b, sig_b) to the (ka, kb) that may be linked by size and estimate."""
    for batch in batches:
        if batch.num_rows:
            out = pa.array(_may_link(*batch.columns[2:]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(out), batch.column(1).take(out)], ["ka", "kb"])


def _may_link(n_a: pa.Array, sig_a: pa.Array, n_b: pa.Array, sig_b: pa.Array) -> np.ndarray:
    n, m = n_a.to_numpy(), n_b.to_numpy()
    a, b = (np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(-1, REGISTERS) for sig in (sig_a, sig_b))
    return np.flatnonzero((estimate(a, b, n, m) >= PERCENT / 100 - MARGIN) & (np.minimum(n, m) * 100 >= PERCENT * np.maximum(n, m)))


def linked(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The rows whose texts in both columns have sets that are alike enough; shingles are compared by their words."""
    _, from_a = tokens.binary(a)
    _, from_b = tokens.binary(b)
    size, out, lo = from_a + from_b - from_a[0] - from_b[0], [np.zeros(0, np.int64)], 0
    while lo < len(a):
        rows = max(int(np.searchsorted(size, size[lo] + PAIR_BYTES, side="right")) - 1 - lo, 1)
        some = pa.concat_arrays([a.slice(lo, rows), b.slice(lo, rows)])
        text, shingle = tokens.exact_shingles(tokens.words(*tokens.binary(some), lower=True), SHINGLE)
        n, pair = np.bincount(text, minlength=2 * rows), text % rows
        order = np.lexsort((shingle, pair))
        pair, shingle = pair[order], shingle[order]
        both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1])], minlength=rows)
        union = n[:rows] + n[rows:] - both
        out.append(lo + np.flatnonzero((union > 0) & (both * 100 >= PERCENT * union)))
        lo += rows
    return np.concatenate(out)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls_a, n_a, sig_a, text_a, cls_b, n_b, sig_b, text_b) to the linked (u, v)."""
    for batch in batches:
        if batch.num_rows:
            rows = pa.array(_may_link(*(batch.column(i) for i in (1, 2, 5, 6))))
            cls_a, text_a, cls_b, text_b = (batch.column(i).take(rows) for i in (0, 3, 4, 7))
            out = pa.array(linked(text_a, text_b))
            yield pa.RecordBatch.from_arrays([cls_a.take(out), cls_b.take(out)], ["u", "v"])


def _links(pairs: DataFrame, cand: DataFrame, name: str) -> DataFrame:
    """The verified links (u, v) among candidate pairs (ka, kb), written to the shared folder."""
    a = cand.select(*(F.col(c).alias(f"{c}_a") for c in ("k", "cls", "n", "sig", "text")))
    b = cand.select(*(F.col(c).alias(f"{c}_b") for c in ("k", "cls", "n", "sig", "text")))
    rows = pairs.join(a, F.col("ka") == F.col("k_a")).join(b, F.col("kb") == F.col("k_b"))
    columns = [f"{c}_{s}" for s in "ab" for c in ("cls", "n", "sig", "text")]
    return stash(rows.select(*columns).mapInArrow(_verify, "u string, v string"), name)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., text) to (..., s): the shingle hashes of each text."""
    for batch in batches:
        for lo, hi, data, at in tokens.chunks(batch.column("text")):
            text, h = tokens.shingles(tokens.words(data, at, lower=True), SHINGLE)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], lists], [*batch.schema.names[:-1], "s"])


def _prefix_pairs(unsettled: DataFrame, cand: DataFrame) -> DataFrame:
    """Pairs (ka, kb) of unsettled members (k, c, rest) of different components, at least one of them ``rest``, that may be linked
    by the prefixes of their sets."""
    info = unsettled.withColumnRenamed("k", "uk")
    texts = cand.join(info, F.col("k") == F.col("uk")).select("k", "c", "rest", "text")
    sets = stash(texts.mapInArrow(_shingle_sets, "k long, c long, rest boolean, s array<long>"), "sets")
    met = sets.select("c", "rest", F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("rest").alias("rest"))
    # other shingles are in no pair that is looked for; they come first in the order
    met = met.filter("lo <> hi AND rest").select(F.col("s").bitwiseXOR(F.lit(0)).alias("ms"), "m")
    of_each = sets.select("k", "c", "rest", F.size("s").alias("n"), F.explode("s").alias("s")).join(met, F.col("s") == F.col("ms"))
    order = of_each.groupBy("k", "c", "rest", "n").agg(F.array_sort(F.collect_list(F.struct("m", "s"))).alias("met"))
    first = lambda least: F.size("met") - least + 1
    index = first(F.ceil(F.col("n") * (2 * PERCENT) / (100 + PERCENT)).cast("int"))
    probe = first(F.ceil(F.col("n") * PERCENT / 100).cast("int"))
    listed = F.posexplode(F.transform(F.slice("met", 1, probe), lambda x: x["s"])).alias("i", "s")
    prefix = order.filter(probe > 0).select("k", "c", "rest", "n", F.size("met").alias("all"), index.alias("index"), listed)
    prefix = stash(prefix.select("k", "c", "rest", "n", "s", (F.col("i") < F.col("index")).alias("indexed"), (F.col("all") - F.col("i")).alias("left")), "prefixes")
    small, large = (prefix.select(*(F.col(x).alias(f"{x}_{side}") for x in prefix.columns)) for side in "ab")
    meets = (F.col("s_a") == F.col("s_b")) & (F.col("c_a") != F.col("c_b")) & (F.col("rest_a") | F.col("rest_b"))
    fits = (F.struct("n_a", "k_a") < F.struct("n_b", "k_b")) & (F.col("n_a") * 100 >= F.col("n_b") * PERCENT)
    # from their first shared shingle on, both have enough left to share
    fits &= F.least("left_a", "left_b") * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT
    pairs = small.filter("indexed_a").join(large, meets & fits).select(F.col("k_a").alias("ka"), F.col("k_b").alias("kb")).distinct()
    a, b = (cand.select(F.col("k").alias(f"k_{x}"), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    both = pairs.join(a, F.col("ka") == F.col("k_a")).join(b, F.col("kb") == F.col("k_b")).select("ka", "kb", "n_a", "sig_a", "n_b", "sig_b")
    return stash(both.mapInArrow(_likely, "ka long, kb long"), "likely")


def _labels(found: DataFrame, name: str) -> DataFrame:
    """(vk, vc): a label for every linked class, that most classes of a component share.

    The smallest label around a class, then that label's own label, a few times over; what this leaves apart is only
    compared once more."""
    both = found.select(F.xxhash64("u").alias("k"), F.xxhash64("v").alias("o"))
    both = stash(both.unionByName(both.select(F.col("o").alias("k"), F.col("k").alias("o"))).distinct(), name)
    out = both.groupBy("k").agg(F.min("o").alias("o")).select(F.col("k").alias("vk"), F.least("k", "o").alias("vc"))
    for _ in range(LABEL_ROUNDS):
        out = stash(out, name)
        around = both.join(out, F.col("o") == F.col("vk")).groupBy("k").agg(F.min("vc").alias("least"))
        here = out.join(around, F.col("vk") == F.col("k")).select("vk", F.least("vc", "least").alias("vc"))
        on = here.select(F.col("vk").alias("from"), F.col("vc").alias("to"))
        out = here.join(on, F.col("vc") == F.col("from")).select("vk", F.col("to").alias("vc"))
    return out


def _placed(members: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Members of all shared buckets with their label c."""
    labels = _labels(found, name)
    placed = members.join(labels, F.col("k") == F.col("vk"), "left").select("b", "band", "k", F.coalesce("vc", "k").alias("c"))
    return stash(placed, name + "-placed")


def links(docs: DataFrame, sketched: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified links (u, v) between classes that connect every component."""
    rows = sketched.filter("n > 0").withColumn("k", F.xxhash64("cls"))
    classes = rows.groupBy("cls", "k").agg(F.min(F.struct("_id", "_h")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)))
    bands = classes.select("k", F.posexplode(keys).alias("b", "band"))
    shared = bands.groupBy("band").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    shared = shared.select(F.col("band").bitwiseXOR(F.lit(0)).alias("sband"), "size")
    members = stash(bands.join(shared, F.col("band") == F.col("sband")).select("b", "band", "k", "size"), "members")
    # a bucket's leader is the member with most company over all its buckets: it is alike to most
    company = members.groupBy(F.col("k").bitwiseXOR(F.lit(0)).alias("ck")).agg(F.sum("size").alias("company"))
    leads = members.join(company, F.col("k") == F.col("ck")).groupBy("band").agg(F.max(F.struct("company", "k")).alias("l"))
    leads = leads.select(F.col("band").bitwiseXOR(F.lit(0)).alias("lband"), F.col("l.k").alias("lead"))

    wanted = members.select(F.col("k").alias("wk")).distinct()
    reps = classes.join(wanted, F.col("k") == F.col("wk")).select("k", "cls", "n", "sig", F.col("rep._id").alias("rid"), F.col("rep._h").alias("rh"))
    source = docs.select(F.col(doc_id).cast("long").alias("sid"), F.xxhash64(F.col(text)).alias("sh"), F.col(text).alias("text"))
    cand = source.join(reps, F.col("sid").eqNullSafe(F.col("rid")) & (F.col("sh") == F.col("rh")))
    cand = stash(cand.select("k", "cls", "n", "sig", "text").dropDuplicates(["cls"]), "candidates")

    led = members.join(leads, F.col("band") == F.col("lband")).filter("k <> lead")
    tried = led.select(F.col("k").alias("ka"), F.col("lead").alias("kb")).distinct()
    found = _links(tried, cand, "links-1")

    members = members.select("b", "band", "k")
    placed = _placed(members, found, "round-1")
    # a leader drawn anew in each band; hashing the band and the member makes the draw repeatable
    order = F.struct(F.xxhash64("band", "k", F.lit(2)).alias("o"), "k", "c")
    drawn = placed.groupBy("band").agg(F.min(order).alias("d"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"))
    drawn = drawn.filter("lo <> hi AND size > 2")
    drawn = drawn.select(F.col("band").bitwiseXOR(F.lit(0)).alias("dband"), F.col("d.k").alias("kb"), F.col("d.c").alias("cb"))
    again = placed.join(drawn, (F.col("band") == F.col("dband")) & (F.col("c") != F.col("cb"))).select(F.col("k").alias("ka"), "kb").distinct()
    found = found.unionByName(_links(again, cand, "links-2"))

    placed = _placed(members, found, "round-2")
    sizes = placed.groupBy("band", "c").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("all"), F.count(F.lit(1)).alias("labels"))
    largest = largest.filter("labels > 1 AND all > 2").select(F.col("band").bitwiseXOR(F.lit(0)).alias("tband"), F.col("top.c").alias("tc"))
    mixed = placed.join(largest, F.col("band") == F.col("tband"))
    unsettled = mixed.groupBy("k").agg(F.min("c").alias("c"), F.max(F.col("c") != F.col("tc")).alias("rest"))
    pairs = _prefix_pairs(stash(unsettled, "unsettled"), cand)
    return found.unionByName(_links(pairs, cand, "links-3"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _h, n, component, component_id, kept) for each row of ``docs``; component: a label, null for empty sets."""
    sketched = stash(sketches(docs, doc_id, text), "sketches")
    found = components(links(docs, sketched, doc_id, text), "final")
    rows = sketched.select("_id", "_h", "n", "cls")
    lone = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("_id").alias("least"))
    placed = lone.join(found, F.col("cls") == F.col("vertex"), "left").select("cls", F.coalesce("component", "cls").alias("component"), "least")
    named = placed.groupBy("component").agg(F.min("least").alias("cid")).select(F.concat("component", F.lit("")).alias("pc"), "cid")
    names = stash(placed.join(named, F.col("component") == F.col("pc")).select(F.col("cls").alias("ncls"), "component", "cid"), "names")
    out = rows.join(names, F.col("cls") == F.col("ncls"), "left")
    cid = F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("cid"))
    return out.select("_id", "_h", "n", "component", cid.alias("component_id"), F.col("_id").eqNullSafe(cid).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the rows of its smallest doc_id (among several texts of
    that id, those of the smallest text hash)."""
    marked = near_duplicates(docs, doc_id, text).filter("kept")
    empty = marked.filter("n = 0").select("_id", "_h")
    full = marked.filter("n > 0").groupBy("_id", "component").agg(F.min("_h").alias("_h")).select("_id", "_h")
    keep = stash(empty.unionByName(full).distinct(), "kept").withColumnsRenamed({"_id": "__hf_kid", "_h": "__hf_kh"})
    keyed = docs.withColumn("__hf_key", F.xxhash64(F.col(text)))
    return keyed.join(keep, keyed[doc_id].eqNullSafe(F.col("__hf_kid")) & (F.col("__hf_key") == F.col("__hf_kh")), "left_semi").select(*docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "kept")


_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') || CASE WHEN len(w) < 5 THEN ' ' ELSE '' END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM reach r JOIN p ON p.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""

QUERIES = {"op8_near_dedup": op8_near_dedup}
SQL = {"op8_near_dedup": _SQL}
