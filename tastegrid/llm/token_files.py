"""Token ids in files, with Elias-Fano coded document boundaries.

Documents are sorted by key over range partitions. Each task packs its documents into segments: one id array in the
narrowest width that the vocabulary allows, and the document starts in it as an Elias-Fano sequence whose select
structure is one 32-bit pointer per 64 documents. Segments are rows of Parquet files, so any store and any
retried task will do; file order, then segment order, is ascending key order. A segment knows its start within its
file, and a reader adds the sizes of the files before it, one number per file.

Defined results: a null text is empty and still has its end id; null keys come first; repeated keys keep one entry
per row, in text order; an empty table gives empty files.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from struct import pack
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tastegrid.llm.bpe import Chunks, byte_letters
from tastegrid.llm.common import broadcast_if

SEGMENT_TOKENS = 1 << 20
SEGMENT_DOCS = 1 << 16
HELD_PIECES = 450_000  # pieces whose ids a worker keeps in each of its two stores
FILES_BROADCAST = 500_000  # most files whose starts are sent to every task; of more they are joined by shuffle
SAMPLE = 64  # ones between two pointers of the select structure


class EliasFano:
    """A non-decreasing sequence in about ``2 + log2(universe / n)`` bits an entry."""

    def __init__(self, n: int, low_bits: int, lower: bytes, upper: bytes, pointers: bytes):
        self.n, self.low_bits = n, low_bits
        self.lower, self.upper = np.frombuffer(lower, np.uint8), np.frombuffer(upper, np.uint8)
        self.pointers = np.frombuffer(pointers, "<u4")

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        lower = (values[:, None] >> np.arange(low_bits)) & 1
        ones = (values >> low_bits) + np.arange(n)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        upper[ones] = 1
        return cls(
            n,
            low_bits,
            np.packbits(lower.astype(np.uint8), bitorder="little").tobytes(),
            np.packbits(upper, bitorder="little").tobytes(),
            ones[::SAMPLE].astype("<u4").tobytes(),
        )

    def parts(self) -> tuple[int, int, bytes, bytes, bytes]:
        return self.n, self.low_bits, self.lower.tobytes(), self.upper.tobytes(), self.pointers.tobytes()

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """Entries ``first … first + count - 1``, reading only the bits between their pointers."""
        if not 0 <= first <= first + count <= self.n:
            raise IndexError(first)
        if not count:
            return np.empty(0, np.int64)
        block = first // SAMPLE
        last = (first + count - 1) // SAMPLE + 1
        start = int(self.pointers[block])
        stop = int(self.pointers[last]) if last < len(self.pointers) else len(self.upper) * 8
        bits = np.unpackbits(self.upper[start // 8 : -(-stop // 8)], bitorder="little")
        ones = np.flatnonzero(bits[start % 8 :]) + start
        skip = first - block * SAMPLE
        high = ones[skip : skip + count] - np.arange(first, first + count)
        low = np.zeros(count, np.int64)
        if self.low_bits:
            begin, end = first * self.low_bits, (first + count) * self.low_bits
            bits = np.unpackbits(self.lower[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
            low = bits[: end - begin].reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))
        return (high << self.low_bits) + low


class Packer:
    """Whole texts to packed ids with the tokenizers library and a bounded store of pieces."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.kind = "H" if self.tool.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.end = pack("<" + self.kind, end_id)
        # pieces may be encoded on their own only under a plain byte-level pre-split
        spec = json.loads(self.tool.to_str())
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not spec["normalizer"]
        self.encode = Chunks(self.library, HELD_PIECES).encode if plain else self.library
        # then letters, with or without a space before them, are one word, and the library's model takes them as they are
        self.words = plain and not any(t["content"].strip().isalpha() for t in spec["added_tokens"])
        self.model, self.letters = self.tool.model, byte_letters()

    def library(self, text: str) -> bytes:
        if self.words and text.removeprefix(" ").isalpha():
            ids = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, text.encode())))]
        else:
            ids = self.tool.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}{self.kind}", *ids)


_packers: dict[tuple[str, int], Packer] = {}


def _packer(path: str, end_id: int) -> Packer:
    if (path, end_id) not in _packers:
        _packers[path, end_id] = Packer(path, end_id)
    return _packers[path, end_id]


def write(docs: DataFrame, vocabulary: str, target: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encode every whole text and write the segments to the folder ``target``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _packer(vocabulary, end_id)
        width = 4 if tool.kind == "I" else 2
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        keys, parts, starts, at = [], [], [0], 0

        def flush() -> pa.RecordBatch:
            n, low_bits, lower, upper, pointers = EliasFano.build(np.array(starts)).parts()
            row = [part, segment, before, at, width, b"".join(parts), n, low_bits, lower, upper, pointers]
            arrays = [pa.array([x], pa.binary() if isinstance(x, bytes) else pa.int64()) for x in row]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([keys], pa.list_(key_type))], names=[*NAMES, "keys"])

        for batch in batches:
            key_type = batch.column(0).type
            for k, value in zip(batch.column(0), batch.column(1)):
                ids = tool.encode(value.as_py() or "") + tool.end
                keys.append(k.as_py())
                parts.append(ids)
                at += len(ids) // width
                starts.append(at)
                if at >= SEGMENT_TOKENS or len(keys) >= SEGMENT_DOCS:
                    yield flush()
                    segment, before = segment + 1, before + at
                    keys, parts, starts, at = [], [], [0], 0
        if keys:
            yield flush()

    fields = ", ".join(f"{n} {'binary' if n in BINARY else 'bigint'}" for n in NAMES)
    ordered = docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key, text)
    ordered.mapInArrow(run, f"{fields}, keys array<{kind}>").write.option("compression", "zstd").parquet(target)


NAMES = ["part", "segment", "before", "tokens", "width", "ids", "n", "low_bits", "lower", "upper", "pointers"]
BINARY = {"ids", "lower", "upper", "pointers"}


def read(spark: SparkSession, source: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document in the files; ``start`` counts the ids before it."""
    segments = spark.read.parquet(source)
    kind = segments.schema["keys"].dataType.elementType.simpleString()
    # one row per file
    files = segments.groupBy("part").agg(F.sum("tokens").alias("_size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("base"))
    placed = segments.join(broadcast_if(files, files.count(), FILES_BROADCAST), "part").select((F.col("base") + F.col("before")).alias("base"), *NAMES[4:], "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base, width, ids, n, low_bits, lower, upper, pointers = (batch.column(c)[i].as_py() for c in range(8))
                bounds = EliasFano(n, low_bits, lower, upper, pointers).select(0, n)
                data = np.frombuffer(ids, "<u4" if width == 4 else "<u2")
                sums = [crc32(data[b:e].astype("<u4")) for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(8)[i].values, pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                    names=[key, "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
