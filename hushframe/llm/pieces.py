"""SentencePiece encoding and decoding by a distinct-chunk table.

Where no piece of the vocabulary holds a whitespace marker after another character, a piece cannot
reach into the next marked word: cutting the marked text before every marker that follows a
non-marker leaves chunks that segment independently.  Each task keeps a table of the distinct chunks it
has met; a new chunk is segmented once by the library, and a text's ids are the table rows of its
chunks, joined back by position.  The table lives in the task, as distinct chunks repeat so often that
shuffling every word to build one global table would cost more than segmenting again per task; it
starts anew when it holds ``TABLE_CHUNKS`` chunks, so memory is bounded.  There is no shuffle.

``chunked`` tells whether a model allows this (identity normalisation, dummy prefix, no crossing piece);
for other models every text is encoded whole, with the same results.

Edge cases: null counts as the empty text, which has no ids and decodes to the empty text.  Markers and
runs of spaces in a text, invalid-looking and unknown characters (byte pieces) all go through the
library.  The input's rows and columns are kept; ``ids`` and ``decoded`` replace columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

MARK = "▁"
#: Chunks, and characters of chunks, that a task remembers before it starts anew.
TABLE_CHUNKS, TABLE_CHARS = 500_000, 20_000_000
#: Code points worked on at a time.
BLOCK = 1 << 20
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")


@cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def chunked(path: str) -> bool:
    """Whether the model marks spaces, makes no other change, and has no piece that crosses a marker."""
    sp = processor(path)
    if any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size())):
        return False
    probe = "  a ﬁ Å Å\tＡ  b "
    return sp.normalize(probe) == MARK + probe.replace(" ", MARK) and sp.decode(sp.encode(probe)) == probe


class ChunkTable:
    """Distinct chunks, numbered as they come, with the ids of each."""

    def __init__(self, path: str) -> None:
        self.sp = processor(path)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.end = np.zeros(1 << 14, np.int64)

    def add(self, chunks: list[str]) -> None:
        """Segment new chunks; the library puts the leading marker itself."""
        first = len(self.number)
        for start in range(0, len(chunks), 4096):
            part = chunks[start : start + 4096]
            segmented = self.sp.encode([c[1:].replace(MARK, " ") if len(c) > 1 else "" for c in part], num_threads=1)
            segmented = [s if len(c) > 1 else self.lone for c, s in zip(part, segmented, strict=True)]
            flat = np.fromiter((i for s in segmented for i in s), np.int32)
            ends = self.used + np.cumsum([len(s) for s in segmented])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while first + len(part) > len(self.end):
                self.end = np.concatenate([self.end, np.zeros_like(self.end)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.end[first : first + len(part)] = ends
            for c in part:
                self.number[c] = len(self.number)
                self.chars += len(c)
            first, self.used = first + len(part), self.used + len(flat)

    @property
    def lone(self) -> list[int]:
        """Ids of a marker at the very end: those of a final space without the ids before it."""
        before = self.sp.encode("a")
        return self.sp.encode("a ")[len(before) :]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's end."""
        chunks: list[str] = []
        counts = []
        for t in texts:
            own = _CUT.split(MARK + t.replace(" ", MARK)) if t else []
            counts.append(len(own))
            chunks += own
        if len(self.number) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.clear()
        self.add([c for c in dict.fromkeys(chunks) if c not in self.number])
        rows = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        end = self.end[rows]
        start = np.where(rows > 0, self.end[rows - 1], 0)
        length = end - start
        at = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(start - at[:-1], length) + np.arange(at[-1])]
        return ids, at[np.cumsum(counts)] if counts else np.zeros(0, np.int64)


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, names = processor(path), ["ids", "decoded"]
        chunks = ChunkTable(path) if chunked(path) else None
        for batch in batches:
            texts = batch.column(0).fill_null("")
            sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                before = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + BLOCK, side="right")))
                part = texts.slice(lo, hi - lo).to_pylist()
                if chunks is not None:
                    ids, ends = chunks.encode(part)
                else:
                    lists = sp.encode(part, num_threads=1)
                    ends = np.cumsum([len(x) for x in lists])
                    ids = np.fromiter((i for x in lists for i in x), np.int32)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                decoded = sp.decode([x.tolist() for x in np.split(ids, ends[:-1])], num_threads=1) if len(part) else []
                decoded = [d if t else "" for t, d in zip(part, decoded, strict=True)]
                rest = batch.slice(lo, hi - lo).columns[1:]
                yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(decoded, pa.string())], names=[*batch.schema.names[1:], *names])
                lo = hi

    return encode


def encode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``ids`` and ``decoded`` by default) with ``ids`` (array of int) and ``decoded`` (string)."""
    keep = [c for c in docs.columns if c not in ("ids", "decoded")] if keep is None else keep
    rows = docs.select(F.col(text).alias("__hf_text"), *keep)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_encoder(model), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the digests of ids and decoded text in place of both."""
    return encoded.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("ids", "decoded")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, model or default_model(), keep=["doc_id"]))


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
SQL: dict[str, str] = {}
