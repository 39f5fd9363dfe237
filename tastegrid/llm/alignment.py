"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Both encode every text; byte offsets where tokens of both end cut the tokens into groups. An array made once gives the
B id with the same bytes for each A id, so a group of one token each needs no pair: its A id names the link. Such
links are counted in vectors over A's vocabulary, one per task. Only the other links, from irregular groups, are
pairs that Spark counts by shuffle; a pair equal to its A id's identity counts in the vector wherever it occurs.

A side is byte-level BPE (a JSON vocabulary whose ids follow its merges), B side a sentence-piece model that puts a space
before the text. A group of many tokens is counted by its distinct ids, so it never yields the square of its length.
Defined results: texts that are null, empty or not kept byte for byte by both sides have no tokens and zeros; rows are
counted one by one, repeated rows and null keys included; an empty table gives no rows. Memory is that of one text
or of a few megabytes of shorter ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tastegrid.llm.bpe import SPLIT, byte_letters
from tastegrid.llm.common import broadcast_if, slices
from tastegrid.operators.staging import stage

PAIRS_BROADCAST = 1_500_000  # most counted pairs that are sent to every task; more are joined by shuffle
LARGE = 4096  # links of a group beyond which its distinct ids are counted first


class Sides:
    """Both tokenizers, the bytes of their tokens, and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        spec = json.load(open(a_path, encoding="utf-8"))
        model, back = spec["model"], {c: b for b, c in enumerate(byte_letters())}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        pre = spec["pre_tokenizer"] or {}
        plain = (pre.get("type"), pre.get("add_prefix_space"), model["type"], spec["normalizer"]) == ("ByteLevel", False, "BPE", None)
        if not plain or any(model["vocab"][t] != i for i, t in enumerate(merges, 256)):
            raise ValueError(f"not a plain byte-level BPE vocabulary with ids in merge order: {a_path}")
        pattern = SPLIT.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S")
        # special strings are plain text to it, as it knows none
        self._a = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._b = SentencePieceProcessor(model_file=b_path)
        n_a, self.n_b = max(ranks.values()) + 1, self._b.GetPieceSize()
        pieces = [self._b.IdToPiece(i) for i in range(self.n_b)]
        single = [self._b.IsByte(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if s else p.replace("▁", " ").encode() for p, s in zip(pieces, single)]
        self.a_sizes, self.b_sizes = np.zeros(n_a, np.int64), np.array(list(map(len, self.b_bytes)), np.int64)
        # of several pieces with the same bytes, one that isn't a byte escape
        same = {p: i for i, p in enumerate(self.b_bytes) if single[i]} | {p: i for i, p in enumerate(self.b_bytes) if not single[i]}
        self.same = np.full(n_a, -1, np.int64)
        for t, i in ranks.items():
            self.a_sizes[i], self.same[i] = len(t), same.get(t, -1)
        # ids as text, each with the mark that follows it
        self.names = [f"{i}{end}" for n, ends in ((n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides per text; empty where B's bytes are not those of a space and the text."""
        none, out = np.empty(0, np.int64), []
        for text, b in zip(texts, self._b.encode(texts, num_threads=1)):
            if not text or b"".join(map(self.b_bytes.__getitem__, b)) != b" " + text.encode():
                out.append((none, none))
            else:
                out.append((self._a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64), np.array(b, np.int64)))
        return out


_sides: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    """The worker's tokenizers."""
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their counts."""
    every, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.diff(every, prepend=-1))
    return every[first], np.add.reduceat(n[order], first) if len(first) else n


def _lists(keys: np.ndarray, times: np.ndarray, docs: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Keys ``document << 32 | value`` as one list of values, and one of counts, per document."""
    offsets = pa.array(np.searchsorted(keys, np.arange(docs + 1) << 32), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(keys & 0xFFFFFFFF)), pa.ListArray.from_arrays(offsets, pa.array(times))


def align(tool: Sides, texts: list[str]) -> tuple[list[np.ndarray], list[str], pa.ListArray, pa.ListArray, pa.ListArray, pa.ListArray]:
    """Per text: the numbers of tokens of A and B, of groups and of links, the digest of the groups, identity links by A
    id with their counts, and other links by ``A id * B's size + B id`` with theirs."""
    found = tool.encode(texts)
    docs = len(found)
    n_a, n_b = (np.array([len(x[s]) for x in found], np.int64) for s in (0, 1))
    a, b = (np.concatenate([x[s] for x in found]) for s in (0, 1))
    # both sides run over the same bytes, so all texts are aligned in one line
    a_ends, b_ends = np.cumsum(tool.a_sizes[a]), np.cumsum(tool.b_sizes[b])
    cut = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, bool)
    cut[a_ends] = True
    b_last = cut[b_ends] if len(b) else np.zeros(0, bool)
    cut[:] = False
    cut[b_ends] = True
    a_last = cut[a_ends] if len(a) else np.zeros(0, bool)
    # groups: where the last tokens of both lie
    a_stop, b_stop = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
    a_size, b_size = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    doc_ends = np.cumsum(n_a)
    doc = np.searchsorted(doc_ends, a_stop - 1, side="right")
    n_groups = np.bincount(doc, minlength=docs)
    n_links = np.zeros(docs, np.int64)
    np.add.at(n_links, doc, a_size * b_size)

    # the fast path: one token each, with the same bytes
    one_a, one_b = a[a_stop - 1], b[b_stop - 1]
    regular = (a_size == 1) & (b_size == 1) & (tool.same[one_a] == one_b)
    even = [(doc[regular] << 32) | one_a[regular]]
    even_n = [np.ones(len(even[0]), np.int64)]
    odd, odd_n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def take(d: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        identity = tool.same[x] == y
        even.append((d[identity] << 32) | x[identity])
        even_n.append(n[identity])
        odd.append((d[~identity] << 32) | (x[~identity] * tool.n_b + y[~identity]))
        odd_n.append(n[~identity])

    links = a_size * b_size
    rest = np.flatnonzero(~regular & (links <= LARGE))
    sizes = links[rest]
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place within the group's links
    width = np.repeat(b_size[rest], sizes)
    x = a[np.repeat((a_stop - a_size)[rest], sizes) + at // width]
    y = b[np.repeat((b_stop - b_size)[rest], sizes) + at % width]
    take(np.repeat(doc[rest], sizes), x, y, np.ones(len(x), np.int64))
    for g in np.flatnonzero(~regular & (links > LARGE)).tolist():
        xs, x_n = np.unique(a[a_stop[g] - a_size[g] : a_stop[g]], return_counts=True)
        ys, y_n = np.unique(b[b_stop[g] - b_size[g] : b_stop[g]], return_counts=True)
        for k in range(len(xs)):
            take(np.full(len(ys), doc[g]), np.full(len(ys), xs[k]), ys, x_n[k] * y_n)

    # the groups as text: all A ids of a group, then its B ids
    line = np.empty(len(a) + len(b), np.int64)
    a_group = np.cumsum(a_last) - a_last
    b_group = np.cumsum(b_last) - b_last
    line[np.arange(len(a)) + (b_stop - b_size)[a_group]] = a + a_last * len(tool.a_sizes)
    line[np.arange(len(b)) + a_stop[b_group]] = b + 2 * len(tool.a_sizes) + b_last * tool.n_b
    marks, stop = [], 0
    for size in (n_a + n_b).tolist():
        text = "".join(map(tool.names.__getitem__, line[stop : stop + size].tolist()))
        marks.append(sha256(text[:-1].encode()).hexdigest() if size else "")
        stop += size
    return [n_a, n_b, n_groups, n_links], marks, *_lists(*_summed(even, even_n), docs), *_lists(*_summed(odd, odd_n), docs)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, row, n_a, n_b, n_groups, n_links, groups_sha256, even, even_n, odd, odd_n)``; ``row`` names the row while the
    result is not computed anew, so stage it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, row = sides(a_path, b_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, 2 << 20):
                counts, marks, *lists = align(tool, [t or "" for t in part.column(1).to_pylist()])
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), rows, *map(pa.array, counts), pa.array(marks, pa.string()), *lists],
                    names=[key, "row", *COUNTS, "groups_sha256", "even", "even_n", "odd", "odd_n"],
                )

    kind = docs.schema[key].dataType.simpleString()
    lists = ", ".join(f"{c} array<bigint>" for c in ("even", "even_n", "odd", "odd_n"))
    numbers = ", ".join(f"{c} bigint" for c in ("row", *COUNTS))
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {numbers}, groups_sha256 string, {lists}")


def identity_counts(rows: DataFrame) -> DataFrame:
    """``(a, c)``: in how many rows A id ``a`` is linked to the B id with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(ids) and ids.max() >= len(vector):
                vector = np.pad(vector, (0, int(ids.max()) + 1 - len(vector)))
            vector += np.bincount(ids, minlength=len(vector))
        met = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(vector[met])], names=["a", "c"])

    return rows.select("even").mapInArrow(run, "a bigint, c bigint").groupBy("a").agg(F.sum("c").alias("c"))


def links(rows: DataFrame, n_b: int) -> tuple[DataFrame, DataFrame]:
    """Identity links ``(a, c, best)`` and others ``(odd, c, best)``: in how many rows each occurs, and whether no other
    link of its A id occurs in more."""
    even = stage(identity_counts(rows), "identity-links")
    odd = rows.select(F.explode("odd").alias("odd")).groupBy("odd").agg(F.count(F.lit(1)).alias("c"))
    odd = stage(odd.withColumn("a", F.expr(f"odd div {n_b}")), "other-links")
    # one row per A id, so at most the vocabulary
    top = F.broadcast(stage(even.union(odd.select("a", "c")).groupBy("a").agg(F.max("c").alias("top")), "best-links"))
    judged = lambda df, of: df.join(top, "a").select(of, "c", (F.col("c") == F.col("top")).alias("best"))
    return judged(even, "a"), judged(odd, "odd")


def measure(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs``."""
    rows = stage(aligned(docs, a_path, b_path, key, text), "aligned")
    even, odd = links(rows, sides(a_path, b_path).n_b)
    n_odd = odd.count()

    def sums(of: str, counted: DataFrame) -> DataFrame:
        met = rows.select("row", F.inline(F.arrays_zip(of, f"{of}_n"))).toDF("row", of, "n").join(counted, of)
        return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("c")).alias("count_sum"))

    even = F.broadcast(even.withColumnRenamed("a", "even"))  # at most the vocabulary
    both = sums("even", even).union(sums("odd", broadcast_if(odd, n_odd, PAIRS_BROADCAST)))
    total = both.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    out = rows.select(key, "row", *COUNTS, "groups_sha256").join(total, "row", "left")
    return out.select(key, *COUNTS, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
