"""Approximate nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled by the longest one and get a last coordinate that makes them unit vectors; queries are unit vectors
with a 0 there. Distance then falls as the inner product grows. A table hashes a vector by ``axes`` Gaussian
projections (2-stable, made orthogonal), each cut into slots of one width: its cell. A query visits cells in order of
their squared distance from its own projections, added up over the axes, which is the order of estimated success, and
meets the rows of the cells it visits in any table; all of them are ranked by the exact product on the original vectors.

Width, axes and the number of visited cells are fitted on bounded samples (``SAMPLE`` rows, ``ASKERS`` queries): the
true neighbours of the sampled queries among all rows tell how far down the order they lie, and as many cells are
visited as find ``target`` of them. Where even the longest visit finds fewer, an axis is dropped; without axes there is
one cell and the search is exact. Every row is indexed.

Rows of a cell are packed into blocks and the queries that visit it into chunks, joined by cell; a task multiplies one
block by one chunk, so memory is bounded however full a cell is, and no row of a full cell is left out. Equal vectors are
one class with its ``k + 1`` smallest ids. Defined results: vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do rows without an id; vectors of different lengths never meet; lengths
beyond the ``LENGTHS`` most frequent are searched exactly; rows that share an id are candidates each, and only a query's
own row is left out; equal rows of a query give one list; a query that finds fewer than ``k`` rows is compared with all; ties
go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tastegrid.llm.common import broadcast_if
from tastegrid.operators.staging import stage

SAMPLE = 4096  # rows on which slot widths are fitted, per length
ASKERS = 128  # queries whose true neighbours are looked up for the fit, per length
LENGTHS = 8  # vector lengths that get tables of their own
LONGEST_VISIT = 2048  # cells of a table
BLOCK, CHUNK = 512, 256  # rows in a block, queries in a chunk
HELD = 400_000  # found classes that a task holds before it drops what is not among the best
CELLS_BROADCAST = 300_000  # most cell sizes that are sent to every task


@dataclass
class Tables:
    """Hash tables for unit vectors of one length."""

    scale: float  # length of the longest vector
    axes: np.ndarray  # (tables, length + 1, axes)
    width: np.ndarray  # (tables, axes)
    shift: np.ndarray
    low: np.ndarray  # least and greatest slot met, per table and axis
    high: np.ndarray
    visits: int = LONGEST_VISIT

    @classmethod
    def fit(cls, sample: np.ndarray, scale: float, tables: int, axes: int, slot: float, seed: int) -> Tables:
        rng = np.random.default_rng([seed, sample.shape[1], axes])
        made = [np.linalg.qr(rng.normal(size=(sample.shape[1] + 1, max(axes, 1))))[0][:, :axes] for _ in range(tables)]
        out = cls(scale, np.stack(made), *(np.ones((tables, axes)) for _ in range(4)))
        x = out.project(out.rows(sample))
        out.width = np.maximum(slot * x.std(1), 1e-9)
        out.shift = rng.random((tables, axes)) * out.width
        slots = out.slots(x)
        out.low, out.high = slots.min(1) - 1, slots.max(1) + 1  # rows beyond them go to the outermost slots
        return out

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]])

    @staticmethod
    def queries(x: np.ndarray) -> np.ndarray:
        return np.hstack([x / np.sqrt((x * x).sum(1))[:, None], np.zeros((len(x), 1))])

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tda->tna", x, self.axes)

    def slots(self, x: np.ndarray) -> np.ndarray:
        return np.floor((x + self.shift[:, None]) / self.width[:, None]).astype(np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell names ``(tables, n)`` of rows."""
        slots = np.clip(self.slots(self.project(self.rows(x))), self.low[:, None], self.high[:, None])
        return _name((slots - self.low[:, None]).transpose(2, 0, 1), (self.high - self.low + 1).T[:, :, None])

    def visited(self, x: np.ndarray, table: int) -> np.ndarray:
        """Cell names ``(n, visits)`` of queries in the order of their visit.

        Axes are added one by one. A cell among the nearest has its part on fewer axes among the nearest there, so keeping
        the ``visits`` nearest parts loses nothing.
        """
        at = (self.project(self.queries(x)) + self.shift[:, None])[table]
        cost, name = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
        for a in range(self.axes.shape[2]):
            slots = np.arange(self.low[table, a], self.high[table, a] + 1)
            width = self.width[table, a]
            below, above = slots * width, (slots + 1) * width
            below[0], above[-1] = -np.inf, np.inf
            gap = np.maximum(np.maximum(below - at[:, a, None], at[:, a, None] - above), 0) ** 2
            cost = (cost[:, :, None] + gap[:, None]).reshape(len(x), -1)
            name = (name[:, :, None] * len(slots) + np.arange(len(slots))).reshape(len(x), -1)
            order = np.argsort(cost, axis=1, kind="stable")[:, : self.visits]
            cost, name = np.take_along_axis(cost, order, 1), np.take_along_axis(name, order, 1)
        return name


def _name(slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slots of all axes as one number; it may wrap, which at worst gives two cells one name."""
    out = np.zeros(slots.shape[1:], np.int64)
    for s, n in zip(slots, sizes):
        out = out * n + s
    return out


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 1)


def _dims(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of a batch by the length in a column."""
    dims = batch.column(column).to_numpy(zero_copy_only=False)
    for d in np.unique(dims).tolist():
        yield d, batch.take(pa.array(np.flatnonzero(dims == d)))


def _best(score: np.ndarray, n: int, floor: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``n`` greatest entries of each row, all ties with the last of them and a hair more."""
    if score.shape[1] > n:
        last = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
        floor = np.maximum(floor, last)
    floor = np.broadcast_to(floor, len(score))
    return np.nonzero(score >= (floor - 1e-12 * np.abs(np.where(np.isfinite(floor), floor, 0)))[:, None])


OF_CLASS = ["h1", "h2"]


def _named(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(rep, vec, h1, h2)`` of usable rows; the hashes name the class of equal vectors. Floats stay floats."""
    kind = vectors.schema[vector].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("rep"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    sound = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.where(F.col("rep").isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.select("rep", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2"))


def classes(vectors: DataFrame, key: str, vector: str, ids: int) -> DataFrame:
    """``(rep, dim, vec, ids, h1, h2)``: distinct usable vectors with their smallest ids."""
    first = Window.partitionBy(*OF_CLASS).orderBy("rep")
    few = _named(vectors, key, vector).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= ids)
    out = few.groupBy(*OF_CLASS).agg(F.min_by("vec", "_rn").alias("vec"), F.array_sort(F.collect_list("rep")).alias("ids"))
    return out.select(F.col("ids")[0].alias("rep"), F.size("vec").cast("long").alias("dim"), "vec", "ids", *OF_CLASS)


def _nearest_of_sample(rows: DataFrame, found: dict[int, tuple[np.ndarray, Tables]], k: int) -> dict[int, np.ndarray]:
    """Per length, how far down the visits of the sampled queries their true ``k`` neighbours lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {
            d: [[{c: i for i, c in reversed(list(enumerate(row)))} for row in t.visited(q, n).tolist()] for n in range(len(t.axes))]
            for d, (q, t) in found.items()
        }
        for batch in batches:
            for d, part in _dims(batch, 1):
                q, t = found[d]
                x = _matrix(part.column(2))
                score, cells = q @ x.T, t.cells(x)
                j, i = _best(score, k + 1)
                place = [min(p[a].get(c, LONGEST_VISIT) for p, c in zip(places[d], cs)) for a, cs in zip(j.tolist(), cells[:, i].T.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), d)), pa.array(j), pa.array(score[j, i]), pa.array(place, pa.int64())],
                    names=["dim", "q", "score", "place"],
                )

    known = rows.where(F.col("dim").isin(list(found))).select("rep", "dim", "vec").mapInArrow(run, "dim bigint, q bigint, score double, place bigint")
    order = Window.partitionBy("dim", "q").orderBy(F.col("score").desc(), "place")
    # the first is the query itself, or its equal
    top = known.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > 1) & (F.col("rank") <= k + 1))
    out: dict[int, list[int]] = {}
    for d, place in top.select("dim", "place").collect():  # lengths * askers * k rows
        out.setdefault(d, []).append(place)
    return {d: np.array(p) for d, p in out.items()}


def fit(
    rows: DataFrame, queries: DataFrame, k: int, tables: int, slot: float, rows_per_cell: int, target: float, seed: int
) -> dict[int, Tables]:
    """Tables for the most frequent lengths."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("scale")).orderBy(F.col("n").desc(), "dim").limit(LENGTHS)
    known = {d: (n, s) for d, n, s in sizes.collect()}
    if not known:
        return {}

    def few(df: DataFrame, n: int) -> dict[int, np.ndarray]:
        first = Window.partitionBy("dim").orderBy(F.xxhash64("rep"), "h1", "h2")
        chosen = df.where(F.col("dim").isin(list(known))).withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n)
        out: dict[int, list] = {}
        for d, v in chosen.select("dim", "vec").collect():
            out.setdefault(d, []).append(v)
        return {d: np.array(v, np.float64) for d, v in out.items()}

    sample, askers = few(rows, SAMPLE), few(queries, ASKERS)
    axes = {d: max(0, round(np.log(known[d][0] / rows_per_cell) / np.log(max(4.13 / slot, 1.5)))) for d in askers}
    done: dict[int, Tables] = {}
    while axes:
        trial = {d: (askers[d], Tables.fit(sample[d], known[d][1], tables if a else 1, a, slot, seed)) for d, a in axes.items()}
        places = _nearest_of_sample(rows, trial, k)
        for d, (_, t) in trial.items():
            place = np.sort(places.get(d, np.zeros(1, np.int64)))
            t.visits = int(place[min(len(place) - 1, int(np.ceil(target * len(place))) - 1)]) + 1
            if t.visits <= LONGEST_VISIT:
                done[d] = t
                del axes[d]
            else:
                axes[d] -= 1
    return done


def _hashed(rows: DataFrame, fitted: dict[int, Tables], asked: bool) -> DataFrame:
    """``(dim, tbl, cell, rep, h1, vec)``: a row per table, or per visited cell of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _dims(batch, 1):
                x = _matrix(part.column(3))
                t = fitted.get(d)
                for n in range(len(t.axes) if t else 1):
                    step = max(1, 20_000 // t.visits) if t and asked else 4096
                    for lo in range(0, len(x), step):
                        some = x[lo : lo + step]
                        if not t:
                            cells = np.zeros((len(some), 1), np.int64)
                        else:
                            cells = t.visited(some, n) if asked else t.cells(some)[n][:, None]
                        at = pa.array(np.repeat(np.arange(lo, lo + len(some)), cells.shape[1]))
                        yield pa.RecordBatch.from_arrays(
                            [*(part.column(c).take(at) for c in (1, 0, 2, 3)), pa.array(np.full(len(at), n)), pa.array(cells.ravel())],
                            names=["dim", "rep", "h1", "vec", "tbl", "cell"],
                        )

    kind = rows.schema["rep"].dataType.simpleString()
    return rows.select("rep", "dim", "h1", "vec").mapInArrow(run, f"dim bigint, rep {kind}, h1 bigint, vec {rows.schema['vec'].dataType.simpleString()}, tbl bigint, cell bigint")


OF = ["dim", "tbl", "cell"]


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``(dim, tbl, cell, name)``: about ``size`` rows of a cell in one list, a full cell in several."""
    rows = stage(rows, name)
    counts = rows.groupBy(*OF).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_parts"))
    counts = stage(counts.where("_parts > 1"), f"{name}-full")
    dealt = rows.join(broadcast_if(counts, counts.count(), CELLS_BROADCAST), OF, "left")
    salt = F.coalesce(F.pmod(F.xxhash64("rep", "h1"), F.col("_parts")), F.lit(0)).alias("_salt")
    return dealt.select(*OF, salt, "rep", "h1", "vec").groupBy(*OF, "_salt").agg(F.collect_list(F.struct("rep", "h1", "vec")).alias(name))


class Best:
    """The best ``n`` classes of each query that a task meets, and ties with the last of them."""

    def __init__(self, n: int):
        self.n = n
        self._clear()

    def _clear(self) -> None:
        self.names: dict[tuple, int] = {}
        self.floor = np.empty(0)  # the n-th best score of a query so far
        self.q, self.rep, self.h1, self.score, self.held = [], [], [], [], 0

    def numbered(self, names: list[tuple]) -> np.ndarray:
        found = np.array([self.names.setdefault(q, len(self.names)) for q in names])
        self.floor = np.pad(self.floor, (0, len(self.names) - len(self.floor)), constant_values=-np.inf)
        return found

    def add(self, q: np.ndarray, rep: pa.Array, h1: pa.Array, score: np.ndarray) -> None:
        for column, values in zip((self.q, self.rep, self.h1, self.score), (q, rep, h1, score)):
            column.append(values)
        self.held += len(q)

    def prune(self) -> None:
        if not self.held:
            return
        q, score = np.concatenate(self.q), np.concatenate(self.score)
        rep, h1 = pa.concat_arrays(self.rep), pa.concat_arrays(self.h1)
        order = np.lexsort((h1.to_numpy(), -score, q))
        q, score, rep, h1 = q[order], score[order], rep.take(pa.array(order)), h1.take(pa.array(order))
        # a class that several tables found follows itself
        again = (np.diff(q) == 0) & (np.diff(score) == 0)
        again &= pc.and_(pc.equal(rep[1:], rep[:-1]), pc.equal(h1[1:], h1[:-1])).to_numpy(zero_copy_only=False).astype(bool)
        fresh = np.append(True, ~again)
        place = np.cumsum(fresh)
        begins = np.flatnonzero(np.diff(q, prepend=-1))
        rank = place - np.repeat(place[begins], np.diff(np.append(begins, len(q))))
        nth = fresh & (rank == self.n - 1)
        self.floor[q[nth]] = score[nth]
        keep = np.flatnonzero(fresh & (score >= self.floor[q]))
        at = pa.array(keep)
        self.q, self.rep, self.h1, self.score, self.held = [q[keep]], [rep.take(at)], [h1.take(at)], [score[keep]], len(keep)

    def rows(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """What is held; then everything is forgotten."""
        names = list(self.names)
        reps, hashes = pa.array([r for r, _ in names], kind), pa.array([h for _, h in names], pa.int64())
        for q, rep, h1, score in zip(self.q, self.rep, self.h1, self.score):
            at = pa.array(q)
            yield pa.RecordBatch.from_arrays([reps.take(at), hashes.take(at), rep, h1, pa.array(score)], names=["q", "qh", "rep", "h1", "score"])
        self._clear()


def _met(rows: DataFrame, queries: DataFrame, fitted: dict[int, Tables], n: int) -> DataFrame:
    """``(q, qh, rep, h1, score)``: of the classes that a query meets in a task, the best ``n`` and perhaps more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n)
        for batch in batches:
            for block, chunk in zip(batch.column(0), batch.column(1)):
                left, right = block.values, chunk.values
                x, y = _matrix(left.field("vec")), _matrix(right.field("vec"))
                asked = best.numbered(list(zip(right.field("rep").to_pylist(), right.field("h1").to_pylist())))
                j, i = _best(y @ x.T, n, best.floor[asked])
                exact = (x[i] * y[j]).cumsum(1)[:, -1]  # added in one order, so each table gives the same
                at = pa.array(i)
                best.add(asked[j], left.field("rep").take(at), left.field("h1").take(at), exact)
                if best.held >= HELD:
                    best.prune()
                    if best.held >= HELD // 2:
                        yield from best.rows(kind)
        best.prune()
        yield from best.rows(kind)

    blocks = _packed(_hashed(rows, fitted, asked=False), BLOCK, "block")
    chunks = _packed(_hashed(queries, fitted, asked=True), CHUNK, "chunk")
    kind, name = to_arrow_type(rows.schema["rep"].dataType), rows.schema["rep"].dataType.simpleString()
    joined = blocks.drop("_salt").join(chunks.drop("_salt"), OF).select("block", "chunk")
    return joined.mapInArrow(run, f"q {name}, qh bigint, rep {name}, h1 bigint, score double")


def _first(met: DataFrame, n: int) -> DataFrame:
    """The ``n`` best classes of each query, each once; a class that several tables found ties with itself."""
    order = [F.col("score").desc(), "rep", "h1"]
    each = F.dense_rank().over(Window.partitionBy("q", "qh").orderBy(*order))
    return met.withColumn("_n", each).where(F.col("_n") <= n).drop("_n").distinct()


def search(
    vectors: DataFrame, query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = 2, slot: float = 1.5,
    rows_per_cell: int = 2048, target: float = 0.97, seed: int = 5,
) -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` nearest rows that each row with ``query`` finds; ``query`` is a condition
    on the key."""
    rows = stage(classes(vectors, key, vector, k + 1), "vector-classes")
    asking = _named(vectors.where(query), key, vector).select(F.col("rep").alias("id"), *OF_CLASS).distinct()
    asking = stage(asking.join(rows.select(*OF_CLASS, "rep"), OF_CLASS), "queries")
    queries = stage(rows.join(asking.select(*OF_CLASS).distinct(), OF_CLASS, "left_semi"), "query-classes")
    fitted = fit(rows, queries, k, tables, slot, rows_per_cell, target, seed)
    found = stage(_first(_met(rows, queries, fitted, k + 1), k + 1), "found")
    # queries that found too few are compared with all rows of their length
    sizes = rows.select("rep", "h1", F.size("ids").alias("size"))
    total = found.join(sizes, ["rep", "h1"]).groupBy("q", "qh").agg(F.sum("size").alias("size"))
    full = total.where(F.col("size") > k).select(F.col("q").alias("rep"), F.col("qh").alias("h1"))
    short = queries.where(F.col("dim").isin([d for d, t in fitted.items() if t.axes.shape[2]])).join(full, ["rep", "h1"], "left_anti")
    short = stage(short, "short-queries")
    if not short.isEmpty():
        again = _first(_met(rows.join(short.select("dim").distinct(), "dim", "left_semi"), short, {}, k + 1), k + 1)
        kept = found.join(short.select(F.col("rep").alias("q"), F.col("h1").alias("qh")), ["q", "qh"], "left_anti")
        found = stage(kept.unionByName(again), "found")

    # the k + 1 first rows of each class of queries, then each query's own row goes
    each = found.join(rows.select("rep", "h1", "ids"), ["rep", "h1"])
    each = each.select("q", "qh", "score", (F.col("h1") == F.col("qh")).alias("own"), "ids", F.posexplode("ids").alias("_i", key))
    order = [F.col("score").desc(), key, "_i"]
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("q", "qh").orderBy(*order))).where(F.col("_n") <= k + 1)
    each = asking.select(F.col("id").alias("query_id"), F.col("rep").alias("q"), F.col("h1").alias("qh")).join(each, ["q", "qh"])
    itself = F.col("own") & (F.array_position("ids", F.col("query_id")) == F.col("_i") + 1)
    each = each.where(~F.coalesce(itself, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("query_id", "q", "qh").orderBy(*order)).cast("int")
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
