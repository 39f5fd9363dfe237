"""Phrase collocations by stripes.

A prefix of one or two words keys a stripe: an associative counter of the words that come next, with an empty word for
the end of a piece. Tasks count stripes over runs of tokens, and stripes of a prefix are merged elementwise. Everything
comes from them: an entry counts a phrase, the total of a stripe counts its prefix, the greatest entries of the stripe of
two words and of the stripes that lead into them say whether a longer phrase covers them.

Two-word prefixes are counted after one-word ones: a phrase is frequent only if both pairs in it are, so places
whose pairs are not both in a bitmap of frequent pairs are skipped. The bitmap has a fixed size; what it lets through by chance
falls out when counts are compared, and a crowded bitmap only prunes less.

A prefix whose partial stripes hold more than ``HOT`` entries is merged entry by entry, keyed by prefix and next word, so no
task gets the stripe of a very frequent word. Defined results: a null text is empty, a null label counts as ``und``;
repeated rows count again; texts of any length are read in blocks of a megabyte; ties are settled to the end by the
phrase; labels without candidates give no rows, and neither does an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.llm.common import broadcast_if, joined
from tastegrid.operators.staging import stage

# Marks that end a piece, and white space between words.
MARKS = b".,;:!?\n\x0b\x0c\r"
_TO = bytes.maketrans(bytes(range(65, 91)) + MARKS + b"\t", bytes(range(97, 123)) + b"!" * len(MARKS) + b" ")
ID_BITS = 21  # of a word in a run; three of them fit a long
RUN_TOKENS = 1_500_000  # tokens that a task counts at a time
BLOCK = 1 << 20  # bytes of text that are cut into words at a time
BITMAP_BITS = 27  # the bitmap of frequent pairs has 2^27 bits, 16 MB
HOT = 4_000_000  # entries of partial stripes beyond which a prefix is merged entry by entry
WORDS_BROADCAST = 300_000  # most word totals that are sent to every task


class Runs:
    """Word ids of one label, counted when enough are held."""

    def __init__(self, order: int, bitmap: np.ndarray | None):
        self.order, self.bitmap = order, bitmap
        self._clear([])

    def _clear(self, carried: list[bytes]) -> None:
        self.vocab: defaultdict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.vocab[b"!"]  # id 0 ends a piece
        self.parts = [self._ids(carried)]
        self.held = len(carried)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.__getitem__, words), np.int64, len(words))

    def add(self, text: bytes) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """Take a whole text; yields counted stripes whenever a run is full."""
        text = text.translate(_TO)
        at = 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                cut = max(text.rfind(b" ", at, end), text.rfind(b"!", at, end))
                while cut < at and end < len(text):  # a word longer than a block
                    end += BLOCK
                    cut = max(text.rfind(b" ", at, end), text.rfind(b"!", at, end))
                end = cut + 1 if cut >= at and end < len(text) else len(text)
            words = text[at:end].replace(b"!", b" ! ").split()
            if end >= len(text):
                words.append(b"!")
            self.parts.append(self._ids(words))
            self.held += len(words)
            at = end
            if self.held >= RUN_TOKENS:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """Arrow arrays (prefix, next words, counts) of the run; its last ``order`` words begin the next one."""
        ids = np.concatenate(self.parts)
        names = list(self.vocab)
        n = len(ids) - self.order
        if n > 0:
            yield from self._stripes(ids, names, n)
        self._clear([names[i] for i in ids[max(n, 0) :].tolist()])

    def _stripes(self, ids: np.ndarray, names: list[bytes], n: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        first, second = ids[:n], ids[1 : n + 1]
        if self.order == 1:
            keys = (first << ID_BITS | second)[first > 0]
        else:
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in names], np.uint64)
            pair = _slot(hashes[ids[:-1]], hashes[ids[1:]])
            known = (self.bitmap[pair >> np.uint64(3)] >> (pair & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            known &= (ids[:-1] > 0) & (ids[1:] > 0)
            keep = known[:-1] & known[1:]
            keys = (first << 2 * ID_BITS | second << ID_BITS | ids[2:])[keep]
        found, counts = np.unique(keys, return_counts=True)
        prefix, last = found >> ID_BITS, found & (1 << ID_BITS) - 1
        begins = np.flatnonzero(np.diff(prefix, prepend=-1))
        words = pa.array([b"", *names[1:]], pa.binary()).cast(pa.string())
        for lo in range(0, len(begins), 50_000):
            heads = begins[lo : lo + 50_000]
            stop = begins[lo + 50_000] if lo + 50_000 < len(begins) else len(found)
            at = prefix[heads]
            key = words.take(pa.array(at & (1 << ID_BITS) - 1))
            if self.order == 2:
                key = pc.binary_join_element_wise(words.take(pa.array(at >> ID_BITS)), key, " ")
            offsets = pa.array(np.append(heads, stop) - heads[0], pa.int32())
            nexts = pa.ListArray.from_arrays(offsets, words.take(pa.array(last[heads[0] : stop])))
            yield key, nexts, pa.ListArray.from_arrays(offsets, pa.array(counts[heads[0] : stop]))


def _slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The bit of a pair of word hashes."""
    return (first >> np.uint64(20) ^ second) & np.uint64((1 << BITMAP_BITS) - 1)


def stripes(docs: DataFrame, text: str, label: Column, order: int, bitmap=None) -> DataFrame:
    """Partial stripes ``(lang, prefix, nexts, counts)``, several of a prefix; ``bitmap`` is a broadcast variable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap else None
        labels: dict[str, Runs] = {}

        def rows(lang: str, found) -> Iterator[pa.RecordBatch]:
            for arrays in found:
                langs = pa.array([lang]).take(pa.array(np.zeros(len(arrays[0]), np.int64)))
                yield pa.RecordBatch.from_arrays([langs, *arrays], names=["lang", "prefix", "nexts", "counts"])

        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = value.as_py()
                if not words:
                    continue
                if lang not in labels:
                    labels[lang] = Runs(order, bits)
                yield from rows(lang, labels[lang].add(words))
            if sum(r.held for r in labels.values()) > 2 * RUN_TOKENS:
                for lang, r in labels.items():
                    yield from rows(lang, r.flush())
                labels = {}
        for lang, r in labels.items():
            yield from rows(lang, r.flush())

    return docs.select(label.alias("lang"), text).mapInArrow(run, "lang string, prefix string, nexts array<string>, counts array<bigint>")


def merged(partial: DataFrame, hot_entries: int) -> DataFrame:
    """``(lang, prefix, next, c)``: the stripes of each prefix added up elementwise."""
    of = ["lang", "prefix"]
    hot = partial.groupBy(*of).agg(F.sum(F.size("nexts")).alias("entries")).where(F.col("entries") > hot_entries).select(*of)
    hot = stage(hot, "hot-prefixes")
    n_hot = hot.count()  # at most all entries / hot_entries
    entries = lambda df: df.select(*of, F.inline(F.arrays_zip("nexts", "counts"))).toDF(*of, "next", "c")
    add = lambda df: df.groupBy(*of, "next").agg(F.sum("c").alias("c"))
    if not n_hot:
        return add(entries(partial.repartition(*of)))
    hot = broadcast_if(hot, n_hot, 100_000)
    whole = partial.join(hot, of, "left_anti").repartition(*of)
    return add(entries(whole)).union(add(entries(partial.join(hot, of, "left_semi"))))


def frequent_pairs(spark, pairs: DataFrame):
    """Broadcast bitmap of the pairs ``(prefix, next)``, built by Spark in pieces of 4 KB."""
    first, second = F.xxhash64("prefix"), F.xxhash64("next")
    slot = F.shiftrightunsigned(first, 20).bitwiseXOR(second).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    # Spark counts the bits of a bitmap from 1
    pieces = pairs.select((slot + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )
    bitmap = bytearray(1 << (BITMAP_BITS - 3))
    for piece, bits in pieces.collect():  # 4,096 pieces at most
        start = (piece - 1) * len(bits)
        bitmap[start : start + len(bits)] = bits
    return spark.sparkContext.broadcast(bytes(bitmap))


def _per_label(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each label; first those of 64 parts of it, so the last task of a label has few to order."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for of in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(64))], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(*order)).cast("long"))
        found = found.where(F.col("rank") <= most)
    return found


def _score(a: str, l: str, r: str) -> Column:
    """Exact: the products have at most 38 digits for counts up to ten trillion."""
    return F.expr(
        f"(1000000BD * cast({a} as decimal(16, 0)) * cast({a} as decimal(16, 0))) div (cast({l} as decimal(16, 0)) * cast({r} as decimal(16, 0)))"
    )


def mine(
    docs: DataFrame, text: str = "text", label: str = "lang", least: int = 10, covered: int = 50, most: int = 2000, hot_entries: int = HOT,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``most`` best phrases of two or three words of each label.

    A phrase occurs at least ``least`` times; one that lies in a longer such phrase with ``covered`` percent of its own
    count or more is dropped.
    """
    name = F.coalesce(F.col(label).cast("string"), F.lit("und"))
    ones = stage(stripes(docs, text, name, 1), "stripes-1")
    totals = ones.groupBy("lang", F.col("prefix").alias("word")).agg(F.sum(F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).alias("f"))
    totals = stage(totals, "word-totals")
    n_of = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    totals = totals.where(F.col("f") >= least)
    pairs = stage(merged(ones, hot_entries).where((F.col("c") >= least) & (F.col("next") != "")), "pairs")
    bitmap = frequent_pairs(docs.sparkSession, pairs)
    twos = stage(stripes(docs, text, name, 2, bitmap), "stripes-2")
    triples = stage(merged(twos, hot_entries).where(F.col("c") >= least), "triples")

    small = broadcast_if(totals, totals.count(), WORDS_BROADCAST)
    word = lambda w, f: small.select("lang", F.col("word").alias(w), F.col("f").alias(f))
    two = pairs.select("lang", F.col("prefix").alias("w1"), F.col("next").alias("w2"), F.col("c").alias("a"))
    three = triples.select(
        "lang", F.substring_index("prefix", " ", 1).alias("w1"), F.substring_index("prefix", " ", -1).alias("w2"),
        F.col("next").alias("w3"), F.col("c").alias("a"),
    )
    # the greatest entries of a pair's own stripe and of the stripes that lead into it
    longer = three.select("lang", "w1", "w2", "a").union(three.select("lang", "w2", "w3", "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest"))
    kept = (
        two.join(longer, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longest") < covered * F.col("a"), F.lit(True)))
        .join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
        .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    )
    halves = (
        three.join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
        .join(two.withColumnRenamed("a", "l2"), ["lang", "w1", "w2"])
        .join(two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1")), ["lang", "w2", "w3"])
    )
    cut = F.least(
        *(F.struct(_score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2))
    )
    long = halves.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut.alias("cut"))
    long = long.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = joined(_per_label(kept.union(long), most), n_of, ["lang"], "inner")
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
