"""Token counts of whole texts with a sentence-piece model; huge texts are encoded in overlapping chunks.

A chunk reaches ``overlap`` characters past both its ends. Where two neighbours both produce the same token at the
same place, the two encodings are spliced: a BPE merge run that leaves a token's borders uncrossed on either side
would cross them in the whole text only by a merge that one of the two runs would also have made, so a common token
is a proven boundary. A text one of whose overlaps has no common token is cut anew with wider chunks and overlaps, in
the end as one chunk. Chunks are rows, so the chunks of one text are encoded by many tasks.

Defined results: a null text is empty and counts 0; rows are counted one by one, repeated rows and null keys
included; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tastegrid.llm.common import joined, slices
from tastegrid.operators.staging import stage

HUGE = 65_536  # characters from which a text is cut
CHUNK = 32_768
OVERLAP = 512
GROWTH = 8  # widening of chunk and overlap from round to round

_models: dict[str, tuple] = {}


def _model(path: str):
    """The worker's model and the UTF-8 length of each of its pieces."""
    if path not in _models:
        from sentencepiece import SentencePieceProcessor

        tool = SentencePieceProcessor(model_file=path)
        size = [1 if tool.IsByte(i) else len(tool.IdToPiece(i).replace("▁", " ").encode()) for i in range(tool.GetPieceSize())]
        _models[path] = tool, np.array(size, np.int64)
    return _models[path]


def _count_small(path: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, _ = _model(path)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = [len(x) for x in tool.encode(texts, num_threads=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    return run


def _cut(key: str, chunk: int, overlap: int):
    """Rows ``(key, _text, i, last, base, piece)``; ``base`` is the byte where the piece begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value, mark in zip(*(batch.column(c) for c in range(3))):
                text = value.as_py().replace("▁", " ")  # the model reads both alike
                at, base, last = 0, 0, max(0, -(-len(text) // chunk) - 1)
                for i in range(last + 1):
                    begin = max(0, i * chunk - overlap)
                    base += len(text[at:begin].encode())
                    at = begin
                    end = len(text) if i == last else (i + 1) * chunk + overlap
                    edges = [base + len(text[begin : i * chunk + overlap].encode()) if i else base, base + len(text[begin : (i + 1) * chunk - overlap].encode())]
                    row = [mark.as_py(), i, i == last, base, *edges, text[begin:end]]
                    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()], batch.column(0).type), *(pa.array([x], t) for x, t in zip(row, kinds))],
                        names=[key, "_text", "i", "last", "base", "left_end", "right_begin", "piece"],
                    )

    return run


_ZONE = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("id", pa.int64()), ("k", pa.int64())]))


def _encode(path: str, key: str):
    """Rows ``(key, _text, i, last, n, left, right)``: token count, and the tokens ``(s, e, id, k)`` of both overlaps."""

    def zone(ends: np.ndarray, ids: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> list[dict]:
        at = np.flatnonzero(chosen)
        return [
            {"s": e - z, "e": e, "id": t, "k": k}
            for e, z, t, k in zip(ends[at].tolist(), size[at].tolist(), ids[at].tolist(), (at + 1).tolist())
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, sizes = _model(path)
        for batch in batches:
            for r in range(batch.num_rows):
                k, mark, i, last, base, left_end, right_begin, piece = (batch.column(c)[r] for c in range(8))
                ids = np.array(tool.encode(piece.as_py(), num_threads=1), np.int64)
                size = sizes[ids]
                ends = base.as_py() - 1 + np.cumsum(size)  # the model puts one space before the text
                left = zone(ends, ids, size, ends <= left_end.as_py()) if i.as_py() else []
                right = [] if last.as_py() else zone(ends, ids, size, ends - size >= right_begin.as_py())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k.as_py()], batch.column(0).type),
                        *(pa.array([x.as_py()], x.type) for x in (mark, i, last)),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([left], _ZONE),
                        pa.array([right], _ZONE),
                    ],
                    names=[key, "_text", "i", "last", "n", "left", "right"],
                )

    return run


def _spliced(encoded: DataFrame, key: str) -> DataFrame:
    """``(key, _text, n_tokens)``; null where an overlap has no common token."""
    doc = [key, "_text"]
    left = encoded.where("i > 0").select(*doc, (F.col("i") - 1).alias("j"), F.inline("left")).withColumnRenamed("k", "k_left")
    right = encoded.where("not last").select(*doc, F.col("i").alias("j"), F.inline("right")).withColumnRenamed("k", "k_right")
    common = joined(right, left, [*doc, "j", "s", "e", "id"], "inner")
    cuts = (
        common.groupBy(*doc, "j")
        .agg(F.min(F.struct("s", "k_right", "k_left")).alias("c"))
        .groupBy(*doc)
        .agg(F.count(F.lit(1)).alias("met"), F.sum(F.col("c.k_right") - F.col("c.k_left")).alias("shift"))
    )
    whole = encoded.where("last").select(*doc, "n", F.col("i").alias("junctions"))
    out = joined(whole, cuts, doc, "left")
    n = F.when(F.coalesce("met", F.lit(0)) == F.col("junctions"), F.col("n") + F.coalesce("shift", F.lit(0)))
    return out.select(*doc, n.alias("n_tokens"))


def count(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096,
    huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every whole text. ``chunk`` must exceed twice ``overlap``."""
    if chunk <= 2 * overlap:
        raise ValueError("chunk must exceed twice the overlap")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    # bytes decide first: characters need a pass over the text
    is_huge = F.coalesce((F.octet_length(text) > huge) & (F.length(text) > huge), F.lit(False))
    small = rows.where(~is_huge).mapInArrow(_count_small(model, key), f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")
    left = rows.where(is_huge).select(key, F.col(text).alias("text"), F.xxhash64(text).alias("_text"), "n_bytes")
    heads, open_docs, done = left.select(key, "_text", "n_bytes"), left, None
    zone = "array<struct<s:bigint,e:bigint,id:bigint,k:bigint>>"
    while True:
        pieces = open_docs.select(key, "text", "_text").mapInArrow(
            _cut(key, chunk, overlap),
            f"`{key}` {kind}, _text bigint, i bigint, last boolean, base bigint, left_end bigint, right_begin bigint, piece string",
        )
        encoded = pieces.repartition(key, "_text", "i").mapInArrow(
            _encode(model, key), f"`{key}` {kind}, _text bigint, i bigint, last boolean, n bigint, left {zone}, right {zone}"
        )
        # repeated rows give the same pieces
        result = stage(_spliced(stage(encoded.dropDuplicates([key, "_text", "i"]), "chunks"), key), "spliced")
        done = result if done is None else done.union(result)
        failed = result.where("n_tokens is null").select(key, "_text")
        if failed.isEmpty():
            break
        open_docs = joined(left, failed, [key, "_text"], "left_semi")
        chunk, overlap = chunk * GROWTH, overlap * GROWTH
    counted = joined(heads, done.where("n_tokens is not null"), [key, "_text"], "inner").select(key, "n_bytes", "n_tokens")
    return small.union(counted).select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
