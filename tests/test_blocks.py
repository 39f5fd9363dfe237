"""Tile kernels against brute force, with blocks small enough that several tiles are needed."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from tastegrid.operators import blocks
from tastegrid.operators.blocks import block_top, chained_top, dense_top, half_up

RNG = np.random.default_rng(7)


def sparse(rows, cols, share=0.4, hot=True):
    m = np.where(RNG.random((rows, cols)) < share, RNG.normal(size=(rows, cols)).round(3), 0.0)
    if hot:
        m[:, 0] = RNG.normal(size=rows).round(3)  # a column everybody has
    return m


def long(frame, m, name, weights=("w0",), extra=None):
    out = []
    for i, j in zip(*np.nonzero(m)):
        out.append((int(i), f"c{j}", *[float(x) for x in (m[i, j], *(extra or ()))]))
    return frame(out, f"{name} long, col string, " + ", ".join(f"{w} double" for w in weights))


def best(score, valid, n):
    out = {}
    for i in range(score.shape[0]):
        ids = sorted(np.flatnonzero(valid[i]), key=lambda j: (-half_up(score[i, j], 7), j))[:n]
        for rank, j in enumerate(ids, 1):
            out[i, rank] = (j, round(score[i, j], 7))
    return out


def found(df):
    return {(r["l"], r["rank"]): (r["r"], round(r["score"], 7)) for r in df.collect()}


@pytest.mark.parametrize("dense_share", [0, 400, 10**9])
def test_dot(frame, monkeypatch, dense_share):
    """Rare-only, mixed and frequent-only column handling."""
    monkeypatch.setattr(blocks, "_DENSE_SHARE", dense_share)
    a, b = sparse(23, 12), sparse(31, 12)
    score = a @ b.T
    got = block_top(long(frame, a, "l"), long(frame, b, "r"), n=5, rows_per_block=4)
    assert found(got) == best(score, score >= 5e-8, 5)


def test_skip_and_own_id(frame):
    a = sparse(15, 9)
    score = a @ a.T
    banned = [(i, (i * 3) % 15) for i in range(15)]
    valid = score >= 5e-8
    np.fill_diagonal(valid, False)
    for i, j in banned:
        valid[i, j] = False
    got = block_top(
        long(frame, a, "l"), long(frame, a, "r"), n=4, rows_per_block=4, same=False, skip=frame(banned, "l long, r long")
    )
    assert found(got) == best(score, valid, 4)


def test_all_pairs(frame):
    a, b = sparse(9, 6), sparse(8, 6)
    score = a @ b.T
    got = block_top(long(frame, a, "l"), long(frame, b, "r"), n=None, rows_per_block=3).collect()
    assert {(r["l"], r["r"]) for r in got} == set(zip(*[x.tolist() for x in np.nonzero(score >= 5e-8)]))


def test_weighted_mean_with_candidates(frame):
    sims = np.abs(sparse(10, 8))
    dev = sparse(12, 8)
    flag = (RNG.random((12, 8)) < 0.3) * (dev != 0)
    left = frame([(int(i), int(j), float(sims[i, j]), float(sims[i, j]), 1.0) for i, j in zip(*np.nonzero(sims))],
                 "l long, col long, w0 double, w1 double, w2 double")
    right = frame([(int(i), int(j), float(dev[i, j]), 1.0, float(flag[i, j])) for i, j in zip(*np.nonzero(dev))],
                  "r long, col long, w0 double, w1 double, w2 double")
    bias = RNG.normal(size=12).round(2)
    num, den = sims @ dev.T, sims @ (dev != 0).T
    cand = (sims != 0).astype(float) @ flag.T
    score = bias[None, :] + num / np.where(den > 0, den, 1)
    got = block_top(left, right, n=3, sums=3, finish=blocks.finish_weighted_mean, rows_per_block=4,
                    bias=frame([(i, float(v)) for i, v in enumerate(bias)], "r long, bias double"))
    assert found(got) == best(score, (den > 0) & (cand > 0), 3)


def test_biased_keeps_unmatched_items(frame):
    left = frame([(1, "x", 1.0), (2, "y", 0.5)], "l long, col string, w0 double")
    right = frame([(10, "x", 1.0), (11, "y", 1.0)], "r long, col string, w0 double")
    bias = frame([(10, 1.0), (11, 2.0), (12, 1.9)], "r long, bias double")
    got = found(block_top(left, right, n=3, finish=blocks.finish_biased, bias=bias))
    assert got == {(1, 1): (10, 2.0), (1, 2): (11, 2.0), (1, 3): (12, 1.9), (2, 1): (11, 2.5), (2, 2): (12, 1.9), (2, 3): (10, 1.0)}


def test_empty_side(frame):
    left = frame([], "l long, col string, w0 double")
    right = frame([(10, "x", 1.0)], "r long, col string, w0 double")
    assert block_top(left, right, n=3).count() == 0


def test_dense(frame):
    u, v = RNG.normal(size=(13, 5)), RNG.normal(size=(17, 5))
    seen = [(i, i) for i in range(13)]
    score = u @ v.T + np.arange(13)[:, None]
    valid = np.ones(score.shape, bool)
    for i, j in seen:
        valid[i, j] = False
    got = dense_top(
        frame([(i, r.tolist(), float(i)) for i, r in enumerate(u)], "l long, vec array<double>, shift double"),
        frame([(i, r.tolist()) for i, r in enumerate(v)], "r long, vec array<double>"),
        n=4, skip=frame(seen, "l long, r long"), rows_per_block=4,
    )
    assert found(got) == best(score, valid, 4)


def test_chained(frame):
    likes = np.where(RNG.random((14, 20)) < 0.3, RNG.integers(1, 6, (14, 20)), 0).astype(float)
    likes[3, :] = 5.0  # somebody who likes everything
    likes[likes.sum(axis=1) == 0, 0] = 1.0
    docs = np.abs(sparse(20, 11))
    docs /= np.sqrt((docs**2).sum(axis=1, keepdims=True))
    profile = likes @ docs
    score = profile @ docs.T / np.sqrt((profile**2).sum(axis=1, keepdims=True))
    seen = list(zip(*[x.tolist() for x in np.nonzero(likes)]))
    got = chained_top(
        frame([(i, j, float(likes[i, j])) for i, j in seen], "l long, col long, w0 double"),
        frame([(int(i), int(j), float(docs[i, j])) for i, j in zip(*np.nonzero(docs))], "r long, col long, w0 double"),
        n=5, width=11, skip=frame(seen, "l long, r long"), rows_per_block=4,
    )
    assert found(got) == best(score, (score >= 5e-8) & (likes == 0), 5)


def test_mirrored_tiles(frame):
    """Half of the tiles, the same rows; also when every pair is asked for."""
    a = sparse(19, 11)
    score = a @ a.T
    valid = score > 1e-12
    np.fill_diagonal(valid, False)
    left, right = long(frame, a, "l"), long(frame, a, "r")
    got = block_top(left, right, n=4, rows_per_block=3, same=False, mirrored=True)
    assert found(got) == best(score, valid, 4)
    pairs = block_top(left, right, n=None, rows_per_block=3, same=False, mirrored=True).collect()
    assert len(pairs) == valid.sum() and {(r["l"], r["r"]) for r in pairs} == set(zip(*[x.tolist() for x in np.nonzero(valid)]))


def test_shift_decides_rounding(frame):
    """A row's shift is added before scores are rounded and ranked."""
    left = frame([(1, 5, 1.0, 0.5)], "l long, col long, w0 double, shift double")
    right = frame([(10, 5, 1.00000004), (11, 5, 1.00000008)], "r long, col long, w0 double")
    got = block_top(left, right, n=2).collect()
    assert [(r["rank"], r["r"], round(r["score"], 9)) for r in got] == [(1, 11, 1.50000008), (2, 10, 1.50000004)]


def test_records_go_only_where_their_column_is(frame):
    """A record meets the blocks that hold its column, so a column of b blocks is not copied to the others."""
    rows = [(i, "all", 1.0) for i in range(64)] + [(i, f"own{i}", 1.0) for i in range(64)]
    lefts = blocks.packed(frame(rows, "l long, col string, w0 double"), "l", "lb", 16, ["w0"], "el").cache()
    rights = blocks.packed(frame(rows, "r long, col string, w0 double"), "r", "rb", 16, ["w0"], "er")
    met = blocks.met_records(lefts, rights)
    held = {r["col"]: r["count"] for r in lefts.groupBy("col").count().collect()}
    assert held["all"] > 10 and met.count() == sum(b * b for b in held.values()) < 16 * len(lefts.collect())
    half = blocks.met_records(lefts, rights, mirrored=True)
    assert half.count() == sum(b * (b + 1) // 2 for b in held.values())


def test_records_keep_every_digit():
    """Entries as bytes: short where nothing is lost, weights of 1 and repeated ones left out, whatever batch wrote them."""
    rng = np.random.default_rng(2)
    odd = rng.normal(size=7)
    tables = [
        ([3, 5, 1, 9, 2, 2, 8], odd, odd, np.ones(7)),
        ([1 << 40, -5, 1, 0, 2, 2, 8], odd, odd / 3, odd * 1e300),
        ([1, 2, 3, 4, 5, 6, 7], np.arange(7) / 2, np.ones(7), np.full(7, np.nan)),
    ]
    ends, written = np.array([0, 2, 3, 7], np.int32), []
    for ids, *w in tables:
        inner = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, w)], names=["id", "w0", "w1", "w2"])
        written.append(blocks._bytes(pa.ListArray.from_arrays(pa.array(ends), inner), ["w0", "w1", "w2"]))
    assert len(written[0][2].as_py()) == 2 + 4 * 12 and len(written[1][2].as_py()) == 2 + 4 * 32
    records = pa.concat_arrays(written)  # one chunk with records of three kinds
    for part, n in ((records, 3), (records.slice(3, 3), 1)):
        size, ids, *w = blocks._entries(part, 3)
        some = tables if n == 3 else tables[1:2]
        assert size.tolist() == [2, 1, 4] * n and ids.tolist() == [i for t in some for i in t[0]]
        assert all(np.array_equal(x, np.concatenate([t[k + 1] for t in some]), equal_nan=True) for k, x in enumerate(w))


def test_the_side_with_more_entries_is_written_less(frame):
    left = frame([(i % 20, i, 1.0) for i in range(100)], "l long, col long, w0 double")
    right = frame([(i % 9000, i % 300, 1.0) for i in range(20_000)], "r long, col long, w0 double")
    assert blocks.shared_blocks(left, right, right, 131_072) == (4, 16)  # four blocks at least, eight a side before
    many = blocks.shared_blocks(left, right.selectExpr("r * 9 AS r", "col", "w0").union(right.selectExpr("r * 9 + 1", "col", "w0")), right, 131_072)
    assert many[0] < 4 and many[0] * many[1] >= 64


def test_long_rows_end_the_scan(frame):
    """Blocks of short vectors are left out where the long ones already fill the lists, and only there."""
    rng = np.random.default_rng(9)
    u, v = rng.normal(size=(40, 6)), rng.normal(size=(200, 6)) * (0.97 ** np.arange(200))[:, None]
    users = frame([(i, r.tolist(), float(i % 3)) for i, r in enumerate(u)], "l long, vec array<double>, shift double")
    items = frame([(i, r.tolist()) for i, r in enumerate(v)], "r long, vec array<double>")
    score = u @ v.T + (np.arange(40) % 3)[:, None]
    seen = [(i, j) for i in range(40) for j in range(0, 200, 7)]
    valid = np.ones(score.shape, bool)
    valid[[i for i, _ in seen], [j for _, j in seen]] = False
    got = dense_top(users, items, n=5, rows_per_block=10, skip=frame(seen, "l long, r long"))
    assert found(got) == best(score, valid, 5)
    norms = np.sort(np.sqrt((v * v).sum(1)))[::-1][::10]
    lefts = users.selectExpr("l", "sqrt(aggregate(vec, 0D, (s, x) -> s + x * x)) AS norm", "shift")
    first = frame([(i, 5, -float(np.sort(-s)[4])) for i, s in enumerate(score)], "l long, rank long, score double")
    routes = blocks.later_tiles(lefts, first, norms, 1, 5, 7).collect()
    assert 0 < len(routes) < 0.6 * 40 * (len(norms) - 1)
    short = frame([(i, 4, 0.0) for i in range(40)], "l long, rank long, score double")  # lists that are not full need every block
    assert blocks.later_tiles(lefts, short, norms, 1, 5, 7).count() == 40 * (len(norms) - 1)


def test_dense_blocks_are_large(frame, monkeypatch):
    """A vector is written once for every block of the other side, so thousands of rows are one block."""
    dealt = []
    monkeypatch.setattr(blocks, "tile_groups", lambda df, tiles, plain=blocks.tile_groups: (dealt.append(df.count()), plain(df, tiles))[1])
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(300, 3)), rng.normal(size=(9000, 3))
    users = frame([(i, r.tolist(), 0.0) for i, r in enumerate(u)], "l long, vec array<double>, shift double")
    items = frame([(i, r.tolist()) for i, r in enumerate(v)], "r long, vec array<double>")
    got = dense_top(users, items, n=3)
    assert dealt[0] == 300 and len(dealt) == 2  # every user meets one block of items, once
    score = u @ v.T
    assert found(got) == best(score, np.ones(score.shape, bool), 3)


def test_dense_tile_stops_at_the_bound(monkeypatch):
    """Inside a tile the bound leaves out what can't be among the best, whatever the cut into columns."""
    rng = np.random.default_rng(4)
    u, v = rng.normal(size=(30, 4)), rng.normal(size=(500, 4)) * (0.99 ** np.arange(500))[:, None]
    v[17] = v[3]  # a tie
    ids = rng.permutation(500)
    tables = []
    for x, name, of in ((u, "l", np.arange(30)), (v, "r", ids)):
        t = pa.table({name: of, "vec": pa.array(x.tolist(), pa.list_(pa.float64())), "norm": np.sqrt((x * x).sum(1))})
        tables.append(t if name == "l" else t.take(pa.compute.sort_indices(t, sort_keys=[("norm", "descending"), ("r", "ascending")])))
    gone = pa.table({"l": np.repeat(np.arange(30), 50), "r": np.tile(ids[:100:2], 30)})
    score = np.empty((30, 500))
    score[:, ids] = u @ v.T + 1.0
    valid = np.ones(score.shape, bool)
    valid[:, ids[:100:2]] = False
    want = best(score, valid, 6)
    monkeypatch.setattr(blocks, "_BOUNDED_COLUMNS", 8)
    products = []
    monkeypatch.setattr(blocks, "best_of_tile", lambda s, *rest, plain=blocks.best_of_tile: (products.append(s.size), plain(s, *rest))[1])
    for edge in (np.full(30, -np.inf), np.array([score[i, want[i, 6][0]] for i in range(30)])):
        sides = blocks._Dense(tables[0], "l"), blocks._Dense(tables[1], "r")
        found_ = pa.Table.from_batches(blocks._dense_winners(*sides, np.ones(30), edge, gone, 6, 7)).to_pylist()
        rows = {}
        for row in found_:
            rows.setdefault(row["l"], []).append(row)
        got = {(l, k): (x["r"], round(x["score"], 7)) for l, xs in rows.items() for k, x in enumerate(xs, 1)}
        assert got == want
    assert sum(products) < 0.8 * 2 * score.size


def test_profile_blocks_are_large(frame, monkeypatch):
    """Documents are written once per left block and likes once per right block: few blocks, few copies."""
    dealt = []
    monkeypatch.setattr(blocks, "tile_groups", lambda df, tiles, plain=blocks.tile_groups: (dealt.append(df.count()), plain(df, tiles))[1])
    likes = frame([(i, i % 50, 1.0) for i in range(20_000)], "l long, col long, w0 double")
    docs = frame([(d, d % 5 + 1, 1.0) for d in range(50)], "r long, col long, w0 double")
    got = chained_top(likes, docs, n=2, width=5)
    rows = {(r["l"], r["rank"]): (r["r"], r["score"]) for r in got.where("l < 10").collect()}
    assert rows == {(i, k): (i % 5 + 5 * (k - 1), 1.0) for i in range(10) for k in (1, 2)}
    assert dealt[1] <= 16 * 50  # twenty blocks of 1,024 before


def test_sparse_blocks_are_large(frame, monkeypatch):
    """A record is written once per block of the other side that holds its column, so thousands of rows are one block."""
    dealt = []
    monkeypatch.setattr(blocks, "tile_groups", lambda df, tiles, plain=blocks.tile_groups: (dealt.append(df.count()), plain(df, tiles))[1])
    rows = [(i, i % 60, 1.0 + i % 7) for i in range(50_000)]
    left, right = frame(rows, "l long, col long, w0 double"), frame(rows, "r long, col long, w0 double")
    got = block_top(left, right, n=1).where("l < 40").collect()
    assert {(r["l"], r["r"], r["score"]) for r in got} == {(i, next(j for j in range(i % 60, 50_000, 60) if j % 7 == 6), 7.0 * (1 + i % 7)) for i in range(40)}
    assert dealt == [60 * 8 * 8]  # 25 blocks a side of 2,048 rows before: 60 * 25 * 25


@pytest.mark.parametrize("sparse_share", [0, 10**9])
@pytest.mark.parametrize("rows_per_block", [7, 1000])
def test_both_kernels(frame, monkeypatch, sparse_share, rows_per_block):
    """Sorted products and dense tiles return the same: shifts, forbidden pairs, weighted means, mirrored blocks, all pairs."""
    monkeypatch.setattr(blocks, "_SPARSE_SHARE", sparse_share)
    monkeypatch.setattr(blocks, "_SORTED_PRODUCTS", 50)
    monkeypatch.setattr(blocks, "_MERGED_ROWS", 10)
    monkeypatch.setattr(blocks, "DEFAULTS", __import__("dataclasses").replace(blocks.DEFAULTS, rows_per_block=5))
    a, b = sparse(25, 14), sparse(90, 14)
    banned = [(i, j) for i in range(25) for j in range(90) if (i + j) % 6 == 0]
    bias = RNG.normal(size=90).round(3)
    weight = np.abs(a) @ np.abs(b).T
    score = bias[None, :] + np.divide(a @ b.T, weight, out=np.zeros(weight.shape), where=weight > 0) + np.arange(25)[:, None]
    valid = weight > 0
    valid[tuple(np.array(banned).T)] = False
    left = frame([(i, f"c{j}", float(a[i, j]), abs(float(a[i, j])), float(i)) for i, j in np.argwhere(a).tolist()], "l long, col string, w0 double, w1 double, shift double")
    right = frame([(i, f"c{j}", float(b[i, j]), abs(float(b[i, j]))) for i, j in np.argwhere(b).tolist()], "r long, col string, w0 double, w1 double")
    got = block_top(left, right, n=3, sums=2, finish=blocks.finish_weighted_mean, skip=frame(banned, "l long, r long"),
                    bias=frame([(i, float(x)) for i, x in enumerate(bias)], "r long, bias double"), rows_per_block=rows_per_block)
    assert found(got) == best(score, valid, 3)
    own = b @ b.T
    valid = own > blocks.NOISE
    np.fill_diagonal(valid, False)
    sides = long(frame, b, "l"), long(frame, b, "r")
    got = block_top(*sides, n=4, same=False, mirrored=True, rows_per_block=rows_per_block)
    assert found(got) == best(own, valid, 4)
    pairs = block_top(*sides, n=None, same=False, mirrored=True, rows_per_block=rows_per_block).collect()
    assert len(pairs) == valid.sum() and {(r["l"], r["r"]) for r in pairs} == set(zip(*map(list, np.nonzero(valid))))
