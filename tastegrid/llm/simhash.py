"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into ``segments`` runs of bits. Two fingerprints within ``distance`` bits differ in at most
``distance // segments`` bits in one of the runs at least, so each fingerprint is stored once per segment in a
table, asks the tables for every value in that small Hamming ball around its own segment, and the matches are
verified on all 64 bits. Of the two sides of a pair only the one with a 0 in the highest flipped bit asks,
and a pair counts only in the first segment that finds it, so every link is produced exactly once.

Equal fingerprints are one row before the search, so groups of copies cost nothing. Defined results: a null or
wordless text has fingerprint 0 and links like any other; rows sharing an id are one node of the link graph; a null
id is reported with its fingerprint and joins no component unless it is alone on it, where the component is null;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.llm.common import broadcast_if, joined, without
from tastegrid.llm.graph import components
from tastegrid.operators.staging import stage

SEED = 42
MOST_ASKS = 4096  # values that a fingerprint may ask for; they are part of the plan


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(whole[i:j], SEED) for i, j in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype=">u8"
    )
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory on very long texts
        set_bits += np.unpackbits(hashes[at : at + 8192].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str, text: str, words_per_shingle: int = 4) -> DataFrame:
    """``(key, fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1)]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def _hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(n: int) -> list[list[int]]:
    """Bit positions of each segment, as even as 64 bits allow."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [list(range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]


def _asks(segments: int, distance: int) -> int:
    """Values that a fingerprint asks for, over all segments."""
    widths, radius = map(len, _segments(segments)), distance // segments
    return sum(comb(w, r) for w in widths for r in range(min(radius, w) + 1))


def cheapest_segments(fingerprints: int, distance: int) -> int:
    """The number of segments with the least work: asked values, and stored fingerprints met by each of them.

    A fingerprint never asks for more than ``MOST_ASKS`` values; with one segment more than ``distance`` it asks once each.
    """
    if not 0 <= distance < 64:
        raise ValueError(f"the distance of 64-bit fingerprints lies between 0 and 63: {distance}")
    stored = max(1, fingerprints)

    def work(n: int) -> float:
        return _asks(n, distance) * (1 + 0.1 * stored / 2.0 ** (64 // n))

    possible = [n for n in range(1, distance + 2) if _asks(n, distance) <= MOST_ASKS]
    # narrow segments meet too much, the more so as their values are not even
    usable = [n for n in possible if stored <= 16 * 2.0 ** (64 // n)]
    return min(usable or possible[:1], key=work)


def links(found: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Pairs ``(a, b)`` of representatives of ``found (rep, fp)`` whose fingerprints differ in 1 to ``distance`` bits.

    ``found`` holds each fingerprint once, a representative possibly several times; its fingerprints do not link.
    """
    if _asks(segments, distance) > MOST_ASKS:
        raise ValueError(f"{segments} segments are too few for a distance of {distance}")
    runs, radius = _segments(segments), distance // segments
    masks = [_signed(sum(1 << b for b in bits)) for bits in runs]
    balls = [
        (s, _signed(sum(1 << b for b in flip)), _signed(1 << max(flip)) if flip else 0)
        for s, bits in enumerate(runs)
        for r in range(radius + 1)
        for flip in combinations(bits, r)
    ]
    whole = F.array(*(F.struct(F.lit(s).alias("seg"), F.lit(m).cast("long").alias("mask")) for s, m in enumerate(masks)))
    stored = found.select("rep", "fp", F.inline(whole)).select(
        F.col("rep").alias("b"), F.col("fp").alias("fp_b"), "seg", F.col("fp").bitwiseAND(F.col("mask")).alias("at")
    )
    asks = F.array(
        *(
            F.struct(
                F.lit(s).alias("seg"),
                F.lit(masks[s]).cast("long").alias("mask"),
                F.lit(flip).cast("long").alias("flip"),
                F.lit(top).cast("long").alias("top"),
            )
            for s, flip, top in balls
        )
    )
    asked = (
        found.select("rep", "fp", F.inline(asks))
        .where(F.col("fp").bitwiseAND(F.col("top")) == 0)
        .select(
            F.col("rep").alias("a"), F.col("fp").alias("fp_a"), "seg", F.col("flip") == 0,
            F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("at"),
        )
        .toDF("a", "fp_a", "seg", "same", "at")
    )
    # Spark sizes both sides by the file of ``found``, not by the rows that ``inline`` makes of it, and would send them whole to the driver
    stored = stored.hint("merge")
    apart = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    first = reduce(
        lambda x, y: x & y,
        (
            (F.col("l.seg") <= s) | (F.bit_count(apart.bitwiseAND(F.lit(m).cast("long"))) > radius)
            for s, m in enumerate(masks[:-1])
        ),
        F.lit(True),
    )
    once = ~F.col("same") | (F.col("fp_a") < F.col("fp_b"))
    return (
        asked.alias("l")
        .join(
            stored.alias("r"),
            (F.col("l.seg") == F.col("r.seg")) & (F.col("l.at") == F.col("r.at"))
            & (F.bit_count(apart) <= distance) & once & first & (F.col("a") != F.col("b")),
        )
        .select("a", "b")
    )


def _classes(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, component_id)`` of ``found (rep, fp)`` joined up by ``edges`` of representatives."""
    roots = components(edges)
    joined_up = found.join(roots.hint("merge"), found["rep"] == roots["node"], "left")  # compressed ids are sized too low
    return joined_up.select("fp", F.coalesce("root", "rep").alias("component_id"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 4, distance: int = 4,
    segments: int | None = 3, ring: int | None = None,
) -> DataFrame:
    """``(key, fingerprint, component_id)``: hex fingerprint and the smallest id reachable over links.

    With ``ring``, links within that many bits are contracted first, and the full distance is searched between what is
    left. That gives the same components with fewer links: only those within the ring are as many as its pairs.
    Without ``segments`` their number follows from the count of fingerprints; it doesn't change the result.
    """
    marks = stage(fingerprints(docs, key, text, words_per_shingle), "simhash")
    # copies are one row each from here on; a null id never represents its fingerprint
    found = stage(marks.groupBy("fp").agg(F.min(key).alias("rep")), "simhash-distinct")
    usable = found.where(F.col("rep").isNotNull())
    same_id = marks.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    # an id that occurs with several fingerprints ties them together
    ties = (
        marks.join(same_id.where("lo < hi").select(key), key)
        .join(usable, "fp")
        .select(F.col(key).alias("a"), F.col("rep").alias("b"))
    )
    n = usable.count()
    if not n:  # no fingerprint with an id: nothing links
        return marks.select(key, _hex(F.col("fp")).alias("fingerprint"), F.lit(None).cast(docs.schema[key].dataType).alias("component_id"))
    cut = lambda d: segments or cheapest_segments(n, d)
    first = distance if ring is None else min(ring, distance)
    classes = _classes(found, links(usable, first, cut(first)).union(ties))
    if first < distance:
        classes = stage(classes, "simhash-ring")
        left = classes.where("component_id is not null").withColumnRenamed("component_id", "rep")
        classes = _classes(classes.withColumnRenamed("component_id", "rep"), links(left, distance, cut(distance)))
    return marks.join(classes.hint("merge"), "fp").select(
        key, _hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options: int | None) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, with all columns of ``docs``.

    Of several rows with that id one stays. Rows without an id can't be told apart and all stay. The options are those
    of :func:`near_duplicates`.
    """
    found = near_duplicates(docs, key, text, **options)
    gone = stage(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), "near-duplicates")
    left = without(docs, gone, [key])
    repeated = stage(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated-ids")
    n = repeated.count()
    if not n:
        return left
    again = joined(left, broadcast_if(repeated, n, 500_000), [key], "left_semi").dropDuplicates([key])
    return without(left, repeated, [key]).union(again)
