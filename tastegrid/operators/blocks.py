"""Exact top-n over products of two long-form matrices.

``left`` holds rows ``(l, col, w…)`` and ``right`` holds ``(r, col, w…)``. Each wanted score of a pair
``(l, r)`` is built from sums over the shared columns, ``Σ w·w``. A plain join on ``col`` would emit
every pair that shares a column, so a column used by a third of all rows would explode. Here rows are
dealt into blocks by hash and the entries of one block and column are packed into one record (at most
``rows_per_block`` entries). Spark joins the records of both sides on the column, so a record only meets
blocks that hold its column, and groups what met by (left block, right block). A record is written once per block
of the other side that holds its column, so blocks are large. The product of such a pair of blocks is a NumPy kernel:
where few pairs share a column, the products of a few left rows are sorted by pair and added up, else dense tiles of
2,048 rows a side take turns. Only the best n of each pair of blocks leave it. Memory is bounded by such a tile and
the entries of two blocks; no candidate is ever dropped early.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tastegrid.config import DEFAULTS
from tastegrid.operators.ranking import global_rank, top_n
from tastegrid.operators.skew import split_join
from tastegrid.operators.staging import stage

_STEP_PRODUCTS = 2_000_000  # products expanded per step for rare columns
_DENSE_COLUMNS = 256        # frequent columns multiplied per matrix product
_DENSE_SHARE = 400          # a column is frequent when its products exceed tile area / this
_CACHED_CELLS = 1 << 18    # tile cells ranked at a time
_MIN_BLOCKS = 4
_ENTRIES_PER_BLOCK = 2_000_000
_RECORDS_PER_SPLIT = 256    # records of a column beyond which the join deals them over several tasks
_SHARED_ROWS = 131_072      # rows of a block of sparse rows
_SHARED_ENTRIES = 4_000_000 # and its entries
_SHARED_SPREAD = 8          # blocks of sparse rows that smaller inputs still get, or as many pairs of blocks
_SPREAD_ROWS = 512          # and rows of a block below which none is cut for that
_SPARSE_SHARE = 4           # products are sorted by pair when there are fewer than pairs / this
_SORTED_PRODUCTS = 1 << 18  # products sorted at a time
_MERGED_ROWS = 1 << 20      # rows of several tiles that are cut to the best at a time
_DENSE_ROWS = 131_072       # right rows of a tile of dense rows; twice as many as left ones
_DENSE_SPREAD = 32          # left blocks of dense rows that smaller inputs still get
_BOUNDED_COLUMNS = 2_048    # right rows of a dense tile that share one bound
_PROFILE_BLOCKS = 16        # left blocks of profiles that smaller inputs still get
_PROFILE_ROWS = 256         # profiles of a tile that are scored at a time
TILES_PER_TASK = 2
MOST_TASKS = 20_000
NOISE = 1e-12  # a sum of products counts as positive above this: rounding leaves about 1e-16, ratings differ by far more

Finish = Callable[[list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]
_OUT = "l long, r long, score double"


def finish_dot(acc: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain product; only positive scores count."""
    return acc[0], acc[0] > NOISE


def finish_weighted_mean(acc: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bias + Σ weighted deviations / Σ weights``; a third sum, if sent, marks the candidates."""
    ok = acc[1] > 0
    if len(acc) > 2:
        ok &= acc[2] > 0
    return bias[None, :] + acc[0] / np.where(acc[1] > 0, acc[1], 1.0), ok


def finish_all(acc: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair counts."""
    return acc[0], np.ones(acc[0].shape, bool)


def finish_biased(acc: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bias + Σ``; every right row that has a bias is a candidate, shared columns or not."""
    return bias[None, :] + acc[0], np.broadcast_to(~np.isnan(bias)[None, :], acc[0].shape)


def finish_overlap_bias(acc: list[np.ndarray], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score is the bias alone; the sum only tells whether any column is shared."""
    return np.broadcast_to(bias[None, :], acc[0].shape), (acc[0] > 0) & ~np.isnan(bias)[None, :]


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    scale = 10.0**digits
    return np.sign(values) * np.floor(np.abs(values) * scale + 0.5) / scale


def best_of_tile(
    score: np.ndarray, valid: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, n: int, digits: int
) -> pa.RecordBatch:
    """Top ``n`` per tile row by rounded score, then right id; ties at the edge are settled by id."""
    if n < score.shape[1] and np.count_nonzero(valid) * 8 > valid.size:
        # anything that can still tie with the n-th value after rounding stays in
        raw = np.where(valid, score, -np.inf)
        edge = np.partition(raw, raw.shape[1] - n, axis=1)[:, raw.shape[1] - n] - 10.0**-digits
        valid = valid & (raw >= edge[:, None])
    rows, cols = np.nonzero(valid)
    values, ids = score[rows, cols], right_ids[cols]
    order = np.lexsort((ids, -half_up(values, digits), rows))
    rows, values, ids = rows[order], values[order], ids[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < n
    return pa.RecordBatch.from_pydict({"l": left_ids[rows[keep]], "r": ids[keep], "score": values[keep]})


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, … within each run of the given lengths."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


# --- records as bytes -------------------------------------------------------------------------------

# Two bytes tell how the entries of a record are written: whether ids are short, and two bits for each weight.
_AS_IT_IS, _ONES, _AS_FIRST, _SHORT = range(4)


def _layout(head: int, weights: int) -> tuple[np.dtype, list[int]]:
    kinds = [head >> 1 + 2 * i & 3 for i in range(weights)]
    kept = [(f"w{i}", "<f4" if k == _SHORT else "<f8") for i, k in enumerate(kinds) if k in (_AS_IT_IS, _SHORT)]
    return np.dtype([("id", "<i4" if head & 1 else "<i8"), *kept]), kinds


def _bytes(lists: pa.ListArray, fields: list[str]) -> pa.Array:
    """Lists of entries ``(id, weights…)`` as bytes: short ids and weights where no digit is lost, weights of 1 and repeated ones left out."""
    inner, counts = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if not len(lists):
        return pa.array([], pa.binary())
    ids, w = inner.field("id").to_numpy(zero_copy_only=False), [inner.field(f).to_numpy(zero_copy_only=False) for f in fields]
    head = int(len(ids) > 0 and ids.min() >= -(1 << 31) and ids.max() < 1 << 31)
    for i, x in enumerate(w):
        if (x == 1.0).all():
            kind = _ONES
        elif i and (x == w[0]).all():
            kind = _AS_FIRST
        else:
            with np.errstate(over="ignore"):
                kind = _SHORT if (x.astype("<f4") == x).all() else _AS_IT_IS
        head |= kind << 1 + 2 * i
    kind, _ = _layout(head, len(w))
    body = np.empty(len(ids), kind)
    body["id"] = ids
    for name in kind.names[1:]:
        body[name] = w[int(name[1:])]
    ends = np.cumsum(counts * kind.itemsize + 2)
    starts = np.append(0, ends)[:-1]
    out, heads = np.empty(ends[-1], np.uint8), np.zeros(ends[-1], bool)
    heads[starts] = heads[starts + 1] = True
    out[starts], out[starts + 1] = head & 255, head >> 8
    out[~heads] = body.view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(out)])


def _entries(records: pa.BinaryArray, weights: int) -> list[np.ndarray]:
    """Number of entries of each record, and the ids and weights of all, as :func:`_bytes` got them."""
    at = np.frombuffer(records.buffers()[1], np.int32)[records.offset : records.offset + len(records) + 1].astype(np.int64)
    data = np.frombuffer(records.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    starts, length = at[:-1], np.diff(at)
    heads = data[starts].astype(np.int64) | data[starts + 1].astype(np.int64) << 8
    body = np.ones(len(data), bool)
    body[starts] = body[starts + 1] = False
    size = np.zeros(len(records), np.int64)
    kinds = np.unique(heads).tolist()
    for head in kinds:
        size[heads == head] = (length[heads == head] - 2) // _layout(head, weights)[0].itemsize
    total = int(size.sum())
    ids, w = np.empty(total, np.int64), [np.ones(total) for _ in range(weights)]
    for head in kinds:
        kind, how = _layout(head, weights)
        whole = len(kinds) == 1
        part = data[body if whole else body & np.repeat(heads == head, length)].view(kind)
        mine = slice(None) if whole else np.repeat(heads == head, size)
        ids[mine] = part["id"]
        for i, k in enumerate(how):
            if k in (_AS_IT_IS, _SHORT):
                w[i][mine] = part[f"w{i}"]
            elif k == _AS_FIRST:
                w[i][mine] = w[0][mine]
    return [size, ids, *w]


# --- one tile -------------------------------------------------------------------------------------


class _Side:
    """The entries of one side of a tile's records, in the order of the records."""

    def __init__(self, lists: pa.ChunkedArray, weights: list[str]):
        if pa.types.is_binary(lists.type):
            chunks = [_entries(chunk, len(weights)) for chunk in lists.chunks if len(chunk)]
            self.size, ids, *self.w = (np.concatenate(parts) for parts in zip(*chunks))
        else:
            lists = lists.combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            self.size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            inner = lists.flatten()
            ids = inner.field("id").to_numpy(zero_copy_only=False)
            self.w = [inner.field(w).to_numpy(zero_copy_only=False) for w in weights]
        self.ids, self.at = np.unique(ids, return_inverse=True)
        self.record = np.repeat(np.arange(len(self.size)), self.size)


def _sums(left: _Side | _Rows, right: _Side | _Rows) -> list[np.ndarray]:
    """Per weight, the products of matching records added up in a dense tile."""
    nl, nr = len(left.ids), len(right.ids)
    acc = [np.zeros((nl, nr)) for _ in left.w]
    frequent = left.size * right.size * _DENSE_SHARE > nl * nr
    _add_frequent(acc, np.flatnonzero(frequent), left, right)
    rare = ~frequent[left.record]
    counts = right.size[left.record[rare]]
    begin = (np.cumsum(right.size) - right.size)[left.record[rare]]
    _add_rare(acc, counts, begin, left.at[rare], [w[rare] for w in left.w], right)
    return acc


def _add_frequent(acc: list[np.ndarray], records: np.ndarray, left: _Side, right: _Side) -> None:
    slot = np.full(len(left.size), -1)
    for lo in range(0, len(records), _DENSE_COLUMNS):
        part = records[lo : lo + _DENSE_COLUMNS]
        slot[:] = -1
        slot[part] = np.arange(len(part))
        li, ri = np.flatnonzero(slot[left.record] >= 0), np.flatnonzero(slot[right.record] >= 0)
        for total, lw, rw in zip(acc, left.w, right.w):
            a, b = np.zeros((len(left.ids), len(part))), np.zeros((len(right.ids), len(part)))
            a[left.at[li], slot[left.record[li]]] = lw[li]
            b[right.at[ri], slot[right.record[ri]]] = rw[ri]
            total += a @ b.T


def _add_rare(acc, counts, begin, l_at, l_w, right: _Side) -> None:
    ends = np.cumsum(counts)
    width = acc[0].shape[1]
    lo = 0
    while lo < len(l_at):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + _STEP_PRODUCTS, side="right")))
        c = counts[lo:hi]
        li = np.repeat(np.arange(lo, hi), c)
        ri = np.repeat(begin[lo:hi], c) + runs(c)
        cells = l_at[li] * width + right.at[ri]
        for total, lw, rw in zip(acc, l_w, right.w):
            np.add.at(total.reshape(-1), cells, lw[li] * rw[ri])
        lo = hi


def _places(ids: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of ``asked`` among the sorted ``ids``; -1 for others."""
    if not len(ids):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
    return np.where(ids[at] == asked, at, -1)


def _forbidden(left_ids: np.ndarray, right_ids: np.ndarray, pairs: pa.Table | None, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column places of pairs that may not be returned, sorted by row."""
    li, ri = [], []
    if pairs is not None and pairs.num_rows:
        li.append(_places(left_ids, pairs["l"].to_numpy()))
        ri.append(_places(right_ids, pairs["r"].to_numpy()))
    if not same:
        li.append(np.arange(len(left_ids)))
        ri.append(_places(right_ids, left_ids))
    if not li:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    li, ri = np.concatenate(li), np.concatenate(ri)
    both = (li >= 0) & (ri >= 0)
    order = np.argsort(li[both], kind="stable")
    return li[both][order], ri[both][order]


def _winners(
    acc: list[np.ndarray], bias: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray, gone: tuple[np.ndarray, np.ndarray],
    n: int | None, digits: int, finish: Finish, shift: np.ndarray | None = None,
) -> Iterator[pa.RecordBatch]:
    """Best of a few rows at a time, so that temporaries stay in the cache; ``gone`` are the places of pairs that may not be
    returned, by row; ``shift`` is added to a row's scores."""
    if not len(left_ids) or not len(right_ids):
        return
    li, ri = gone
    step = max(1, _CACHED_CELLS // len(right_ids))
    for lo in range(0, len(left_ids), step):
        hi = min(lo + step, len(left_ids))
        score, valid = finish([a[lo:hi] for a in acc], bias)
        if shift is not None:
            score = score + shift[lo:hi, None]
        first, last = np.searchsorted(li, [lo, hi])
        if first < last:
            valid = np.array(valid)
            valid[li[first:last] - lo, ri[first:last]] = False
        yield best_of_tile(score, valid, left_ids[lo:hi], right_ids, n or len(right_ids), digits)


def _table(found: Iterator[pa.RecordBatch]) -> pa.Table:
    batches = list(found)
    if batches:
        return pa.Table.from_batches(batches)
    return pa.table({"l": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


class _Rows:
    """The entries of a run of a side's rows, in the order of the records."""

    def __init__(self, side: _Side, lo: int, hi: int, mine: np.ndarray):
        self.ids, self.at = side.ids[lo:hi], side.at[mine] - lo
        self.w, self.record = [w[mine] for w in side.w], side.record[mine]
        self.size = np.bincount(self.record, minlength=len(side.size))


def _cut(side: _Side, edge: int) -> list[_Rows]:
    """The side in runs of ``edge`` rows."""
    part = side.at // edge
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(-(-len(side.ids) // edge) + 1))
    return [_Rows(side, i * edge, (i + 1) * edge, order[lo:hi]) for i, (lo, hi) in enumerate(zip(ends, ends[1:]))]


def _cut_to_best(found: list[pa.RecordBatch], n: int, digits: int) -> list[pa.RecordBatch]:
    """Best ``n`` per row of what several tiles found."""
    if len(found) < 2:
        return found
    rows, ids, values = (np.concatenate([f[c].to_numpy() for f in found]) for c in ("l", "r", "score"))
    order = np.lexsort((ids, -half_up(values, digits), rows))
    rows, ids, values = rows[order], ids[order], values[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < n
    return [pa.RecordBatch.from_pydict({"l": rows[keep], "r": ids[keep], "score": values[keep]})]


def _tiled(
    left: _Side, right: _Side, bias: np.ndarray, gone: tuple[np.ndarray, np.ndarray], shift: np.ndarray | None,
    n: int | None, digits: int, finish: Finish, mirrored: bool,
) -> Iterator[pa.RecordBatch]:
    """Dense tiles in turn; ``mirrored`` also returns the best of the right rows."""
    edge = DEFAULTS.rows_per_block
    rights = _cut(right, edge)
    turned: list[list[pa.RecordBatch]] = [[] for _ in rights]
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i, a in enumerate(_cut(left, edge)):
        first, last = np.searchsorted(gone[0], [i * edge, (i + 1) * edge])
        gone_l, gone_r = gone[0][first:last] - i * edge, gone[1][first:last]
        add = None if shift is None else shift[i * edge : (i + 1) * edge]
        best: list[pa.RecordBatch] = []
        for j, b in enumerate(rights):
            acc = _sums(a, b)
            mine = (gone_r >= j * edge) & (gone_r < (j + 1) * edge)
            here = gone_l[mine], gone_r[mine] - j * edge
            more = [*_winners(acc, bias[j * edge : (j + 1) * edge], a.ids, b.ids, here, n, digits, finish, add)]
            back = []
            if mirrored:
                flipped = [np.ascontiguousarray(x.T) for x in acc]
                back = [*_winners(flipped, np.zeros(len(a.ids)), b.ids, a.ids, nothing, n, digits, finish)]
            if n is None:
                yield from more
                yield from back
                continue
            best += more
            if sum(f.num_rows for f in best) > _MERGED_ROWS:
                best = _cut_to_best(best, n, digits)
            turned[j] = _cut_to_best(turned[j] + back, n, digits)
        yield from best if n is None else _cut_to_best(best, n, digits)
    for found in turned:
        yield from found


def _row_edges(rows: np.ndarray, score: np.ndarray, n_rows: int, n: int) -> np.ndarray:
    """A value that at least ``n`` scores of a row reach: its candidates are cut into groups, of whose greatest scores it is the
    n-th. Rows of few candidates get none."""
    groups = 4 * n
    starts = np.searchsorted(rows, np.arange(n_rows + 1))
    size = np.diff(starts)
    many = np.flatnonzero(size >= 2 * groups)
    edges = np.full(n_rows, -np.inf)
    step = max(1, _CACHED_CELLS // groups)
    for part in (many[i : i + step] for i in range(0, len(many), step)):
        cuts = starts[part][:, None] + size[part][:, None] * np.arange(groups + 1) // groups
        # every other result is that of a group, the last of a row runs from its end to the next row and is left out
        flat = np.minimum(cuts, len(score) - 1).reshape(-1)
        greatest = np.maximum.reduceat(score, flat).reshape(len(part), groups + 1)[:, :groups]
        edges[part] = np.partition(greatest, groups - n, axis=1)[:, groups - n]
    return edges


def _sorted_products(
    left: _Side, right: _Side, bias: np.ndarray, gone: tuple[np.ndarray, np.ndarray], shift: np.ndarray | None,
    n: int | None, digits: int, finish: Finish,
) -> Iterator[pa.RecordBatch]:
    """The same for pairs that share a column only: the products of a few left rows at a time, sorted by pair."""
    width = len(right.ids)
    order = np.argsort(left.at, kind="stable")
    l_at, record, l_w = left.at[order], left.record[order], [w[order] for w in left.w]
    counts = right.size[record]
    begin = (np.cumsum(right.size) - right.size)[record]
    starts = np.searchsorted(l_at, np.arange(len(left.ids) + 1))  # entries of a row
    ends = np.append(0, np.cumsum(counts))[starts]                # products before a row
    lo = 0
    while lo < len(left.ids):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _SORTED_PRODUCTS, side="right")) - 1)
        mine = slice(starts[lo], starts[hi])
        c = counts[mine]
        li, ri = np.repeat(np.arange(starts[lo], starts[hi]), c), np.repeat(begin[mine], c) + runs(c)
        cells = (l_at[li] - lo) * width + right.at[ri]
        by = np.argsort(cells)
        cells = cells[by]
        new = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, np.int64)
        acc = [np.add.reduceat((lw[li] * rw[ri])[by], new)[None, :] if len(new) else np.zeros((1, 0)) for lw, rw in zip(l_w, right.w)]
        cells = cells[new]
        rows, cols = cells // width + lo, cells % width
        score, valid = (np.array(x)[0] for x in finish(acc, bias[cols]))
        if shift is not None:
            score = score + shift[rows]
        first, last = np.searchsorted(gone[0], [lo, hi])
        if first < last and len(cells):
            out = (gone[0][first:last] - lo) * width + gone[1][first:last]
            place = np.minimum(np.searchsorted(cells, out), len(cells) - 1)
            valid[place[cells[place] == out]] = False
        rows, cols, score = rows[valid], cols[valid], score[valid]
        if n is not None:
            fit = score >= _row_edges(rows - lo, score, hi - lo, n)[rows - lo] - 10.0**-digits
            rows, cols, score = rows[fit], cols[fit], score[fit]
            by = np.lexsort((-half_up(score, digits), rows))  # both sorts are stable, so ties keep the order of ids
            rows, cols, score = rows[by], cols[by], score[by]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < n
            rows, cols, score = rows[keep], cols[keep], score[keep]
        yield pa.RecordBatch.from_pydict({"l": left.ids[rows], "r": right.ids[cols], "score": score})
        lo = hi


def _turned(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch["r"], batch["l"], batch["score"]], names=["l", "r", "score"])


def _block_winners(
    left: _Side, right: _Side, bias: np.ndarray, gone: tuple[np.ndarray, np.ndarray], shift: np.ndarray | None,
    n: int | None, digits: int, finish: Finish, mirrored: bool,
) -> Iterator[pa.RecordBatch]:
    """Best of a pair of blocks by the kernel that costs less."""
    products = float(left.size.astype(float) @ right.size)
    if finish is finish_biased or products * _SPARSE_SHARE > float(len(left.ids)) * len(right.ids):
        yield from _tiled(left, right, bias, gone, shift, n, digits, finish, mirrored)
        return
    for batch in _sorted_products(left, right, bias, gone, shift, n, digits, finish):
        yield batch
        if mirrored and n is None:
            yield _turned(batch)
    if mirrored and n is not None:
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from _sorted_products(right, left, np.zeros(len(left.ids)), nothing, None, n, digits, finish)


# --- blocks and records ---------------------------------------------------------------------------


def block_count(df: DataFrame, ident: str, rows_per_block: int, least: int = _MIN_BLOCKS, most_entries: int = _ENTRIES_PER_BLOCK) -> int:
    """Number of blocks from a distinct-count sketch and the entries: sizes need not be exact.

    Two numbers reach the driver. Small inputs still get a few blocks so that their tiles use all
    cores; an empty side gets none. Callers hand in stored frames, so the count is one column scan.
    """
    n, entries = df.agg(F.approx_count_distinct(ident), F.count(F.lit(1))).first()
    return max(least, math.ceil(n / rows_per_block), math.ceil(entries / most_entries)) if n else 0


def shared_blocks(left: DataFrame, others: DataFrame | None, right: DataFrame, rows_per_block: int) -> tuple[int, int]:
    """Left and right blocks of sparse rows; ``others`` are the right rows, None where both sides are one table. Blocks are
    large, as a record is written once per block of the other side; small inputs still get some. The side with more entries
    is written fewer times."""

    def sizes(df: DataFrame, ident: str, entries: int) -> tuple[int, int]:
        n = df.agg(F.approx_count_distinct(ident)).first()[0]
        need = max(math.ceil(n / rows_per_block), math.ceil(entries / _SHARED_ENTRIES)) if n else 0
        return n, need

    def most(n: int, need: int, rows: int) -> int:
        return max(need, _MIN_BLOCKS, math.ceil(n / min(rows, rows_per_block)))

    l_entries, tiles = left.count(), _SHARED_SPREAD**2
    n, need = sizes(left, "l", l_entries)
    if others is None:
        both = need if need >= _SHARED_SPREAD or not n else max(need, min(_SHARED_SPREAD, most(n, need, DEFAULTS.rows_per_block)))
        return both, both
    r_entries = right.count()
    r_n, r_need = sizes(others, "r", r_entries)
    if not n or not r_n:
        return need, r_need
    l_most, r_most = most(n, need, _SPREAD_ROWS), most(r_n, r_need, _SPREAD_ROWS)
    pairs = [(i, max(r_need, min(r_most, -(-tiles // i)))) for i in range(need, max(need, min(l_most, tiles)) + 1)]
    return min(pairs, key=lambda p: (-min(tiles, p[0] * p[1]), l_entries * p[1] + r_entries * p[0]))


def _every(blocks: int) -> Column:
    """One copy of the record per block of the other side."""
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _block(ident: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int")


def tile_groups(df: DataFrame, tiles: int):
    """``df`` grouped by tile, a few tiles a task: their costs differ, so more would make tasks uneven."""
    return df.repartition(min(max(1, -(-tiles // TILES_PER_TASK)), MOST_TASKS), "lb", "rb").groupBy("lb", "rb")


def _no_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "l long, rank long, r long, score double")


def packed(df: DataFrame, ident: str, block: str, blocks: int, fields: list[str], entries: str = "e") -> DataFrame:
    """``(block, col, entries)``: the entries of one block and column as one record, at most as many as the block has rows."""
    entry = F.struct(F.col(ident).cast("long").alias("id"), *(F.col(f).cast("double").alias(f) for f in fields))
    records = df.withColumn(block, _block(ident, blocks)).groupBy(block, "col").agg(F.collect_list(entry).alias(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch[block], batch["col"], _bytes(batch[entries], fields)], names=[block, "col", entries])

    col = df.schema["col"].dataType.simpleString()
    return records.mapInArrow(run, f"{block} int, col {col}, {entries} binary")


def met_records(lefts: DataFrame, rights: DataFrame, mirrored: bool = False) -> DataFrame:
    """``(lb, rb, el, er)``: records of both sides that share a column.

    A column held by ``b`` left blocks is dealt over ``b / _RECORDS_PER_SPLIT`` tasks at most, so each of its records
    is written once, and those of the other side at most that often.
    """
    met = split_join(rights, lefts, "col", "lb", rows_per_split=_RECORDS_PER_SPLIT)
    return (met.where("lb <= rb") if mirrored else met).select("lb", "rb", "el", "er")


def block_top(
    left: DataFrame,
    right: DataFrame,
    *,
    n: int | None,
    sums: int = 1,
    finish: Finish = finish_dot,
    skip: DataFrame | None = None,
    bias: DataFrame | None = None,
    same: bool = True,
    mirrored: bool = False,
    rows_per_block: int = _SHARED_ROWS,
    digits: int = DEFAULTS.score_digits,
) -> DataFrame:
    """``(l, rank, r, score)``: exact best ``n`` right rows of each left row.

    ``left``: ``l, col, w0…``; ``right``: ``r, col, w0…`` with ``sums`` weight columns each and one row
    per cell; a column ``shift`` of ``left`` is added to all scores of its row; ``skip``: pairs ``l, r`` that may not be returned; ``same=False`` leaves out a row's own
    id; ``bias``: ``r, bias``. ``n=None`` returns every valid pair (rank is then left out). ``mirrored`` says that both
    sides are the same table: then half of the tiles are computed, and each serves both its blocks.
    """
    weights = [f"w{i}" for i in range(sums)]
    every = finish is finish_biased  # right rows with a bias are candidates without any shared column
    left_blocks, right_blocks = shared_blocks(left, None if mirrored else right if bias is None else bias, right, rows_per_block)
    if not left_blocks or not right_blocks:
        return _no_rows(left.sparkSession)
    shifts = left.groupBy("l").agg(F.first("shift").alias("shift")) if "shift" in left.columns else None
    kinds = {df.schema["col"].dataType for df in (left, right)}
    col = F.col("col") if len(kinds) == 1 and not every else F.col("col").cast("string")
    left, right = left.select("l", col.alias("col"), *weights), right.select("r", col.alias("col"), *weights)
    if every:  # one more column, of weight 0, that all of them share; real ones never begin with a space
        nothing = [F.lit(0.0).alias(w) for w in weights]
        mark = F.lit(" ").alias("col")
        left = left.unionByName(left.select("l").distinct().select("l", mark, *nothing))
        right = right.unionByName(bias.select("r", mark, *nothing))
    lefts = packed(left, "l", "lb", left_blocks, weights, "el")
    rights = packed(right, "r", "rb", right_blocks, weights, "er")
    met = met_records(stage(lefts, "left-records"), rights, mirrored)
    has_bias, has_shift, limit = bias is not None, shifts is not None, n

    def tile(records: pa.Table, extras: pa.Table | None) -> pa.Table:
        if not records.num_rows:
            return _table(iter(()))
        left, right = _Side(records["el"], weights), _Side(records["er"], weights)
        values, pairs = np.zeros(len(right.ids)), None
        if extras is not None:
            is_bias, is_shift = pa.compute.is_null(extras["l"]), pa.compute.is_null(extras["r"])
            pairs = extras.filter(pa.compute.invert(pa.compute.or_(is_bias, is_shift)))
        if has_bias:
            given = extras.filter(is_bias)
            at = _places(right.ids, given["r"].to_numpy())
            values[:] = np.nan
            values[at[at >= 0]] = given["bias"].to_numpy()[at >= 0]
        shift = None
        if has_shift:
            shift = np.zeros(len(left.ids))
            given = extras.filter(is_shift)
            at = _places(left.ids, given["l"].to_numpy())
            shift[at[at >= 0]] = given["bias"].to_numpy()[at >= 0]
        gone = _forbidden(left.ids, right.ids, pairs, same)
        turn = mirrored and records["lb"][0] != records["rb"][0]
        return _table(_block_winners(left, right, values, gone, shift, limit, digits, finish, turn))

    count = left_blocks * right_blocks * TILES_PER_TASK  # one pair of blocks a task: they are large
    extras = []  # pairs that may not be returned, biases and shifts, one copy for each block of the other side
    if skip is not None:
        pair = [F.col(c).cast("long").alias(c) for c in ("l", "r")]
        extras.append(skip.select(_block("l", left_blocks).alias("lb"), _block("r", right_blocks).alias("rb"), *pair, F.lit(None).cast("double").alias("bias")))
    if has_bias:
        row = [F.lit(None).cast("long").alias("l"), F.col("r").cast("long").alias("r"), F.col("bias").cast("double").alias("bias")]
        extras.append(bias.select(_every(left_blocks).alias("lb"), _block("r", right_blocks).alias("rb"), *row))
    if shifts is not None:
        row = [F.col("l").cast("long").alias("l"), F.lit(None).cast("long").alias("r"), F.col("shift").cast("double").alias("bias")]
        extras.append(shifts.select(_block("l", left_blocks).alias("lb"), _every(right_blocks).alias("rb"), *row))
    if extras:
        others = reduce(DataFrame.unionByName, extras)
        tiles = tile_groups(met, count).cogroup(tile_groups(others, count)).applyInArrow(tile, _OUT)
    else:
        tiles = tile_groups(met, count).applyInArrow(lambda records: tile(records, None), _OUT)
    return tiles if n is None else top_n(tiles, "l", "score", "r", n).select("l", "rank", "r", "score")


def chained_top(
    likes: DataFrame,
    docs: DataFrame,
    *,
    n: int,
    width: int,
    skip: DataFrame | None = None,
    rows_per_block: int = DEFAULTS.rows_per_block * 2,
    digits: int = DEFAULTS.score_digits,
) -> DataFrame:
    """``(l, rank, r, score)``: documents closest to the weighted sum of the liked documents' vectors.

    ``likes``: ``l, col, w0`` with ``col`` a document; ``docs``: ``r, col, w0`` with ``col`` a term, a number from 1 to
    ``width``. Likes of a block of left rows join the vectors of the documents, once each, and a task adds up the block's
    profiles (left rows × terms), which exist only there. It scores one block of documents, 32 times as long, for a few
    profiles at a time; profiles are long, so a document shares terms with every block. Documents are written once per
    left block and likes once per right block, which is why both are large.
    """
    left_blocks = block_count(likes, "l", rows_per_block, _PROFILE_BLOCKS)
    right_blocks = block_count(docs, "r", rows_per_block * 32, 1, 4 * _ENTRIES_PER_BLOCK)
    if not left_blocks or not right_blocks:
        return _no_rows(likes.sparkSession)
    lefts = packed(likes.select("l", F.col("col").cast("long").alias("col"), "w0"), "l", "lb", left_blocks, ["w0"], "el")
    entry = F.struct(F.col("col").cast("long").alias("id"), F.col("w0").cast("double").alias("w0"))
    vectors = stage(docs.groupBy(F.col("r").cast("long").alias("r")).agg(F.collect_list(entry).alias("er")), "vectors")  # ≤ width entries
    liked = split_join(vectors.withColumnRenamed("r", "col"), stage(lefts, "left-records"), "col", "lb", rows_per_split=_RECORDS_PER_SPLIT)
    none = F.lit(None).cast("long")
    liked = liked.select("lb", _every(right_blocks).alias("rb"), "el", "er", none.alias("l"), none.alias("r"))
    if skip is not None:
        pairs = skip.select(_block("l", left_blocks).alias("lb"), _block("r", right_blocks).alias("rb"), "l", "r")
        liked = liked.unionByName(pairs, allowMissingColumns=True)
    asked = vectors.select(_every(left_blocks).alias("lb"), _block("r", right_blocks).alias("rb"), F.col("r").alias("doc"), F.col("er").alias("terms"))

    def tile(records: pa.Table, asked: pa.Table) -> pa.Table:
        likes = records.filter(pa.compute.is_null(records["l"]))
        if not likes.num_rows or not asked.num_rows:
            return _table(iter(()))
        left, right = _Side(likes["el"], ["w0"]), _Side(likes["er"], ["w0"])
        profile = _sums(right, left)[0]  # one row per term, so that a document reads whole rows
        norm = np.sqrt(np.einsum("ij,ij->j", profile, profile))
        norm[norm == 0] = 1.0
        asked = asked.take(pa.compute.sort_indices(asked["doc"]))
        ids, terms = asked["doc"].to_numpy(), asked["terms"].combine_chunks()
        offsets, inner = terms.offsets.to_numpy().astype(np.int64), terms.flatten()
        offsets = offsets - offsets[0]
        at, w = _places(right.ids, inner.field("id").to_numpy(zero_copy_only=False)), inner.field("w0").to_numpy(zero_copy_only=False)
        pairs = records.filter(pa.compute.is_valid(records["l"]))
        known = at >= 0
        places = np.append(0, np.cumsum(known))[offsets]  # documents among the known entries
        at, w = at[known], w[known]

        def best() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(left.ids), _PROFILE_ROWS):
                some = slice(lo, lo + _PROFILE_ROWS)
                part = np.ascontiguousarray(profile[:, some])
                score = np.zeros((len(ids), part.shape[1]))
                for d in range(len(ids)):
                    mine = slice(places[d], places[d + 1])
                    score[d] = w[mine] @ part[at[mine]]
                score = np.ascontiguousarray((score / norm[some]).T)
                gone = _forbidden(left.ids[some], ids, pairs, True)
                yield from _winners([score], np.zeros(len(ids)), left.ids[some], ids, gone, n, digits, finish_dot)

        return _table(best())

    count = left_blocks * right_blocks
    count *= TILES_PER_TASK  # one tile a task: they are large
    tiles = tile_groups(liked, count).cogroup(tile_groups(asked, count)).applyInArrow(tile, _OUT)
    return top_n(tiles, "l", "score", "r", n).select("l", "rank", "r", "score")


# --- dense rows -----------------------------------------------------------------------------------


def later_tiles(lefts: DataFrame, best: DataFrame, norms: np.ndarray, first: int, n: int, digits: int) -> DataFrame:
    """``(l, rb, edge)``: the blocks from ``first`` on that may still hold one of the best ``n`` of a row, with its n-th best score.

    ``norms`` are the greatest lengths of the right blocks, in descending order. A product is at most the product of
    the lengths, so the blocks that matter to a row are those before the first whose bound is below its n-th best score.
    """
    edge = best.where(F.col("rank") == n).select("l", F.col("score").alias("edge"))
    slack = 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, shift = (batch[c].to_numpy(zero_copy_only=False) for c in ("norm", "shift"))
            edge = batch["edge"].fill_null(-np.inf).to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(norm > 0, (edge - shift - slack) / norm, np.where(edge - shift - slack > 0, np.inf, -np.inf))
            need = np.searchsorted(-norms, -least, side="right")
            more = np.maximum(need - first, 0)
            at = pa.array(np.repeat(np.arange(len(more)), more))
            blocks = pa.array((first + runs(more)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["l"].take(at), blocks, batch["edge"].take(at)], names=["l", "rb", "edge"])

    return lefts.select("l", "norm", "shift").join(edge, "l", "left").mapInArrow(run, "l long, rb int, edge double")


class _Dense:
    """The rows of one side of a tile: ids, vectors and lengths."""

    def __init__(self, rows: pa.Table, ident: str):
        self.ids, self.norm = rows[ident].to_numpy(), rows["norm"].to_numpy()
        self.vec = rows["vec"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)


def _dense_winners(
    left: _Dense, right: _Dense, shift: np.ndarray, edge: np.ndarray, pairs: pa.Table, n: int, digits: int
) -> Iterator[pa.RecordBatch]:
    """Best of a few left rows at a time. Right rows come with falling length; ``edge`` is what a row's scores must reach, and a
    row stops where the bound on the rest falls below that or below its n-th best."""
    slack = 10.0**-digits
    order = np.argsort(right.ids)
    li, ri = _forbidden(left.ids, right.ids[order], pairs, True)
    ri = order[ri]
    width = max(_BOUNDED_COLUMNS, 32 * n)
    step = max(16, _CACHED_CELLS // width)
    for lo in range(0, len(left.ids), step):
        vec, norm, add = left.vec[lo : lo + step], left.norm[lo : lo + step], shift[lo : lo + step]
        least = edge[lo : lo + step] - slack
        at, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        first, last = np.searchsorted(li, [lo, lo + len(vec)])
        gone_l, gone_r = li[first:last] - lo, ri[first:last]
        for c in range(0, len(right.ids), width):
            open_ = np.flatnonzero(~(norm * right.norm[c] + add < least))
            if not len(open_):
                break
            score = vec[open_] @ right.vec[c : c + width].T + add[open_, None]
            valid = ~(score < least[open_, None])
            place = _places(open_, gone_l)
            hit = (place >= 0) & (gone_r >= c) & (gone_r < c + width)
            valid[place[hit], gone_r[hit] - c] = False
            more = best_of_tile(score, valid, open_, right.ids[c : c + width], n, digits)
            if not more.num_rows:
                continue
            at, ids, scores = (np.concatenate([old, more[k].to_numpy()]) for old, k in ((at, "l"), (ids, "r"), (scores, "score")))
            sort = np.lexsort((ids, -half_up(scores, digits), at))
            at, ids, scores = at[sort], ids[sort], scores[sort]
            rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
            nth = rank == n - 1
            least[at[nth]] = np.maximum(least[at[nth]], scores[nth] - slack)
            at, ids, scores = at[rank < n], ids[rank < n], scores[rank < n]
        yield pa.RecordBatch.from_pydict({"l": left.ids[lo + at], "r": ids, "score": scores})


def dense_top(
    left: DataFrame,
    right: DataFrame,
    *,
    n: int,
    skip: DataFrame | None = None,
    rows_per_block: int = _DENSE_ROWS,
    digits: int = DEFAULTS.score_digits,
) -> DataFrame:
    """Exact best ``n`` of ``shift + vec·vec`` for dense factor rows, a few thousand at a time in each tile.

    ``left``: ``l, vec, shift``; ``right``: ``r, vec``; ``skip``: pairs ``l, r`` never returned. Right rows are ranged into
    blocks by length, the longest first. All left rows meet the first block; its scores tell which later blocks can still
    hold one of a row's best (:func:`later_tiles`), and only those are computed. A vector is written once for every block of the
    other side that it meets, so blocks are large: a tile holds at most ``rows_per_block`` right and half as many left
    vectors, and its scores exist for a few left rows at a time. No factor table is ever broadcast.
    """
    vec = F.col("vec").cast("array<double>").alias("vec")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")
    small = min(DEFAULTS.rows_per_block, max(1, rows_per_block // 2))
    least = block_count(left, "l", small)
    left_blocks = max(min(_DENSE_SPREAD, least), math.ceil(least * small / max(1, rows_per_block // 2)))
    lefts = left.select(F.col("l").cast("long").alias("l"), vec, F.col("shift").cast("double").alias("shift"))
    lefts = stage(lefts.select("*", length, _block("l", max(1, left_blocks)).alias("lb")), "dense-left")
    rights = right.select(F.col("r").cast("long").alias("r"), vec).select("*", length)
    ranked = global_rank(rights, [F.col("norm").desc(), F.col("r")], "place")
    rights = stage(ranked.select("r", "vec", "norm", F.floor((F.col("place") - 1) / rows_per_block).cast("int").alias("rb")), "dense-right")
    # one number per block
    norms = np.array([r["norm"] for r in rights.groupBy("rb").agg(F.max("norm").alias("norm")).orderBy("rb").collect()])
    if not left_blocks or not len(norms):
        return _no_rows(left.sparkSession)

    def tile(rows: pa.Table, others: pa.Table) -> pa.Table:
        own = rows.filter(pa.compute.is_null(rows["r"]))
        if not own.num_rows or not others.num_rows:
            return _table(iter(()))
        own = own.take(pa.compute.sort_indices(own["l"]))
        others = others.take(pa.compute.sort_indices(others, sort_keys=[("norm", "descending"), ("r", "ascending")]))
        pairs = rows.filter(pa.compute.is_valid(rows["r"])).select(["l", "r"])
        edge = own["edge"].fill_null(-np.inf).to_numpy()
        return _table(_dense_winners(_Dense(own, "l"), _Dense(others, "r"), own["shift"].to_numpy(), edge, pairs, n, digits))

    def computed(routes: DataFrame) -> DataFrame:
        """Best rows of the tiles that the routes ``(l, rb, edge)`` name."""
        own = lefts.join(routes, "l").select("lb", "rb", "l", "vec", "norm", "shift", "edge", F.lit(None).cast("long").alias("r"))
        places = stage(own.select("lb", "rb").distinct(), "tiles")
        others = rights.join(places, "rb").select("lb", "rb", F.col("r"), "vec", "norm")
        if skip is not None:
            pairs = skip.select(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), _block("l", left_blocks).alias("lb"))
            own = own.unionByName(pairs.join(rights.select("r", "rb"), "r"), allowMissingColumns=True)
        count = places.count() * TILES_PER_TASK  # one tile a task: they are large
        return tile_groups(own, count).cogroup(tile_groups(others, count)).applyInArrow(tile, _OUT)

    nothing = F.lit(None).cast("double").alias("edge")
    first = stage(top_n(computed(lefts.select("l", F.lit(0).alias("rb"), nothing)), "l", "score", "r", n), "dense-first")
    if len(norms) > 1:
        routes = stage(later_tiles(lefts, first, norms, 1, n, digits), "dense-routes")
        first = top_n(first.select("l", "r", "score").unionByName(computed(routes)), "l", "score", "r", n)
    return first.select("l", "rank", "r", "score")
