"""Latent factor models: centred SVD, implicit ALS, fold-in of users and top-n scoring."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tastegrid.config import DEFAULTS
from tastegrid.functions.numeric import hash_position, keyed_hash
from tastegrid.operators.blocks import dense_top
from tastegrid.operators.krylov import images, leading, vectors
from tastegrid.operators.neighbours import centred
from tastegrid.operators.skew import hot_from_counts, split_join
from tastegrid.operators.staging import garbage_collected, stage, stage_root


class FactorModel(NamedTuple):
    """``users``: userId, mean, vec; ``items``: movieId, vec; ``strength``: singular values; ``moved``: how far the matrix
    moves a kept vector off its line, ``max ‖AᵀAv - s²v‖ / s²``; ``rounds``: products with ``AᵀA``."""

    users: DataFrame
    items: DataFrame
    strength: list[float]
    moved: float = 0.0
    rounds: int = 0


# --- small dense algebra on distributed factor tables ---------------------------------------------


def gram(factors: DataFrame, width: int) -> np.ndarray:
    """``VᵀV`` of a factor table: partial products per task, summed by cell; width² numbers return."""

    def partial(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["vec"].to_numpy())
                total += v.T @ v
        yield pd.DataFrame({"cell": np.arange(width * width), "v": total.reshape(-1)})

    cells = factors.select("vec").mapInPandas(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(width * width)
    for row in cells.collect():
        out[row["cell"]] = row["v"]
    return out.reshape(width, width)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


# --- centred SVD ----------------------------------------------------------------------------------


def fit_svd(
    ratings: DataFrame,
    *,
    k: int = DEFAULTS.svd_components,
    oversample: int = DEFAULTS.svd_oversample,
    tolerance: float = DEFAULTS.svd_tolerance,
    max_rounds: int = DEFAULTS.svd_max_rounds,
    seed: int = DEFAULTS.seed,
) -> FactorModel:
    """Truncated SVD of the user-centred ratings (missing = 0) by a restarted block Krylov method (:mod:`krylov`).

    It goes on until every one of the ``k`` kept vectors is within ``tolerance`` of an eigenvector of ``AᵀA`` (residual over
    squared singular value; values alone settle long before vectors); a matrix that has not settled after ``max_rounds``
    products raises. Both factor sides stay distributed; only Gram matrices of the search space reach the driver.
    """
    entries = stage(centred(ratings, "userId", "movieId"), "svd-entries")
    shape = entries.agg(F.countDistinct("userId").alias("u"), F.countDistinct("movieId").alias("i")).first()
    limit = min(shape["u"], shape["i"])
    k = max(1, min(k, limit - 1))
    found = leading(
        entries, "userId", "movieId", "dev", k, extra=oversample, tolerance=tolerance, max_rounds=max_rounds, limit=limit, seed=seed
    )
    items = stage(vectors(found.columns, "c").withColumnRenamed("c", "movieId"), "svd-items")
    users = stage(vectors(images(found), "r").withColumnRenamed("r", "userId"), "svd-users")
    means = entries.groupBy("userId").agg(F.first("mean").alias("mean"))
    return FactorModel(means.join(users, "userId"), items, [float(v) for v in np.sqrt(found.values)], found.moved, found.rounds)


def predict(pairs: DataFrame, model: FactorModel, overall: float, dims: int | None = None) -> Column | DataFrame:
    """``pairs`` plus ``pred``: user mean + product, the mean alone if either side is unknown."""
    # a user's vector travels with each of the user's pairs, so it is cut before and sent short where no digit is lost
    cut = F.col("vec") if dims is None else F.slice("vec", 1, dims)
    short = F.when(F.forall(cut, lambda x: x.isNull() | (x.cast("float").cast("double") == x)), cut.cast("array<float>"))
    users = model.users.select("userId", "mean", cut.alias("_u"), short.alias("_short"))
    users = users.withColumn("_u", F.when(F.col("_short").isNull(), F.col("_u")))
    left = pairs.join(users, "userId", "left")
    both = left.join(model.items.select("movieId", cut.alias("_v")), "movieId", "left")
    both = both.withColumn("_u", F.coalesce("_u", F.col("_short").cast("array<double>"))).drop("_short")
    known = F.col("_u").isNotNull() & F.col("_v").isNotNull()
    score = F.coalesce("mean", F.lit(overall)) + F.when(known, dot("_u", "_v")).otherwise(0.0)
    return both.withColumn("pred", score).drop("mean", "_u", "_v")


def svd_grid(
    ratings: DataFrame,
    *,
    grid: tuple[int, ...] = DEFAULTS.svd_grid,
    holdout: float = 0.2,
    seed: int = DEFAULTS.seed,
    min_rows: int = DEFAULTS.min_grid_rows,
    **fit_options: float,
) -> DataFrame:
    """``(n_components, rmse, mae, best)`` on a seeded hold-out.

    Truncations of one decomposition are nested, so the widest model is fitted once and cut to each
    size. Too few ratings give an empty grid.
    """
    marked = ratings.withColumn("_val", hash_position(keyed_hash(seed, "userId", "movieId")) < holdout)
    train, held = marked.where(~F.col("_val")).drop("_val"), marked.where("_val").drop("_val")
    facts = ratings.agg(F.avg("rating").alias("m"), F.count(F.lit(1)).alias("n")).first()
    shape = train.agg(F.countDistinct("userId").alias("u"), F.countDistinct("movieId").alias("i")).first()
    sizes = [k for k in grid if k < min(shape["u"], shape["i"])] if facts["n"] >= min_rows else []
    spark = ratings.sparkSession
    if not sizes:
        return spark.createDataFrame([], "n_components long, rmse double, mae double, best boolean")
    model = fit_svd(train, k=max(sizes), seed=seed, **fit_options)
    errors = held
    for k in sizes:
        errors = predict(errors, model, facts["m"], k).withColumnRenamed("pred", f"p{k}")
    parts = [
        F.struct(
            F.lit(k).cast("long").alias("n_components"),
            F.sqrt(F.avg((F.col(f"p{k}") - F.col("rating")) ** 2)).alias("rmse"),
            F.avg(F.abs(F.col(f"p{k}") - F.col("rating"))).alias("mae"),
        ).alias(f"g{k}")
        for k in sizes
    ]
    table = errors.agg(*parts).select(F.inline(F.array(*[f"g{k}" for k in sizes])))
    first = F.row_number().over(Window.orderBy("rmse", "n_components"))  # as many rows as grid sizes
    return table.withColumn("best", first == 1)


# --- implicit ALS ---------------------------------------------------------------------------------


def fit_als(
    ratings: DataFrame,
    *,
    rank: int = DEFAULTS.als_rank,
    iterations: int = DEFAULTS.als_iterations,
    reg: float = DEFAULTS.als_reg,
    alpha: float = DEFAULTS.als_alpha,
    seed: int = DEFAULTS.seed,
) -> ALSModel:
    """Implicit-feedback ALS on the ratings as confidence weights.

    Every round sends each vector to the blocks that need it. The item factors of a round are checkpointed, so that the rounds before
    are out of reach, and the driver collects garbage every few seconds: that deletes their shuffle files.
    """
    als = ALS(
        userCol="userId", itemCol="movieId", ratingCol="rating", implicitPrefs=True, rank=rank,
        maxIter=iterations, regParam=reg, alpha=alpha, seed=seed, coldStartStrategy="drop", checkpointInterval=1,
    )
    spark = ratings.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{stage_root(spark)}/als")
    with garbage_collected(spark):
        return als.fit(ratings.select("userId", "movieId", "rating"))


def als_factors(model: ALSModel) -> FactorModel:
    vec = F.col("features").cast("array<double>").alias("vec")
    return FactorModel(
        model.userFactors.select(F.col("id").cast("long").alias("userId"), F.lit(0.0).alias("mean"), vec),
        model.itemFactors.select(F.col("id").cast("long").alias("movieId"), vec),
        [],
    )


# --- fold-in --------------------------------------------------------------------------------------


_STEP_CELLS = 1 << 21  # numbers of the equations that are worked on together
_WHOLE, _PART = "userId long, mean double, vec array<double>", "userId long, mean double, known long, a array<double>, b array<double>"


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


Equations = tuple[np.ndarray, np.ndarray, np.ndarray]  # keys of a group, its mean, and its sums: rows, upper triangle of a, b


def _row_equations(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Equations]:
    """What every rating adds to the normal equation of its user and chunk."""
    i, j = np.triu_indices(width)
    step = max(1, _STEP_CELLS // (len(i) + width + 1))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            y = _matrix(part["vec"], width)
            keys, mean, w, t = (part[c].to_numpy(zero_copy_only=False) for c in ("userId", "mean", "w", "t"))
            sums = np.hstack([np.ones((len(y), 1)), y[:, i] * y[:, j] * w[:, None], y * t[:, None]])
            yield np.stack([keys, part["_chunk"].to_numpy(), part["_heavy"].to_numpy(zero_copy_only=False)], 1), mean, sums


def _part_equations(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Equations]:
    """Partial equations as they were sent."""
    for batch in batches:
        if batch.num_rows:
            known, a, b = batch["known"].to_numpy()[:, None], _matrix(batch["a"], width * (width + 1) // 2), _matrix(batch["b"], width)
            yield batch["userId"].to_numpy()[:, None], batch["mean"].to_numpy(zero_copy_only=False), np.hstack([known, a, b])


def _added(parts: Iterator[Equations]) -> Iterator[Equations]:
    """One row per group of rows that come sorted by key; the last group of a part may go on in the next."""
    held = None
    for keys, mean, sums in parts:
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
        keys, mean, sums = keys[first], mean[first], np.add.reduceat(sums, first, axis=0)
        if held is not None:
            if (held[0][0] == keys[0]).all():
                sums[0] += held[2][0]
            else:
                keys, mean, sums = (np.concatenate(pair) for pair in zip(held, (keys, mean, sums)))
        held = keys[-1:], mean[-1:], sums[-1:]
        if len(keys) > 1:
            yield keys[:-1], mean[:-1], sums[:-1]
    if held is not None:
        yield held


def _solved(keys: np.ndarray, mean: np.ndarray, sums: np.ndarray, width: int, base: np.ndarray | None, min_items: int) -> pa.RecordBatch:
    enough = sums[:, 0] >= min_items
    keys, mean, sums = keys[enough], mean[enough], sums[enough]
    i, j = np.triu_indices(width)
    a = np.zeros((len(sums), width, width))
    a[:, i, j] = a[:, j, i] = sums[:, 1 : 1 + len(i)]
    b = sums[:, 1 + len(i) :, None]
    if base is None:  # least squares of smallest norm
        x = np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b
    else:
        x = np.linalg.solve(a + base, b)
    return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(mean), _lists(x[:, :, 0])], names=["userId", "mean", "vec"])


def _fold_in(
    ratings: DataFrame,
    items: DataFrame,
    width: int,
    *,
    weight: Column,
    target: Column,
    mean: Column,
    base: np.ndarray | None,
    min_items: int,
    chunk: int,
) -> DataFrame:
    """Solve one small system per user from its rated item factors.

    Tasks read rows sorted by user and solve the users of a few thousand rows at a time. Users with more than ``chunk``
    ratings are heavy: their rows are dealt into chunks of about that many, each chunk shrinks to one partial normal
    equation, and a second step only adds those up, so a user with millions of ratings never sits in one task.
    """
    counts = ratings.groupBy("userId").agg(F.count(F.lit(1)).alias("_rows"), F.avg("rating").alias("_user_mean"))
    counts = stage(counts, "user-counts")
    rows = split_join(counts, ratings.select("userId", "movieId", "rating"), "userId", "movieId",
                      hot=hot_from_counts(counts, "userId", "_rows"))
    rows = rows.withColumn("mean", mean).select(
        "userId", "movieId", "mean", weight.cast("double").alias("w"), target.cast("double").alias("t"), (F.col("_rows") > chunk).alias("_heavy"),
        F.pmod(F.xxhash64("movieId"), F.ceil(F.col("_rows") / chunk)).alias("_chunk"),
    )
    dealt = split_join(items.select("movieId", "vec"), rows, "movieId", "userId").drop("movieId")
    dealt = dealt.select(F.col("userId").cast("long").alias("userId"), "_chunk", "_heavy", "mean", "w", "t", F.col("vec").cast("array<double>").alias("vec"))
    dealt = dealt.repartition("userId", "_chunk").sortWithinPartitions("userId", "_chunk")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, mean, sums in _added(_row_equations(batches, width)):
            yield _solved(keys, mean, sums, width, base, min_items)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, mean, sums in _added(_row_equations(batches, width)):
            known, cells = pa.array(sums[:, 0].astype(np.int64)), sums.shape[1] - width
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(mean), known, _lists(sums[:, 1:cells]), _lists(sums[:, cells:])], names=["userId", "mean", "known", "a", "b"]
            )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, mean, sums in _added(_part_equations(batches, width)):
            yield _solved(keys, mean, sums, width, base, min_items)

    if counts.where(F.col("_rows") > chunk).isEmpty():
        return dealt.mapInArrow(whole, _WHOLE)
    light = dealt.where("not _heavy").mapInArrow(whole, _WHOLE)
    parts = dealt.where("_heavy").mapInArrow(partial, _PART).repartition("userId").sortWithinPartitions("userId")
    return light.unionByName(parts.mapInArrow(joined, _WHOLE))


def fold_in_svd(
    ratings: DataFrame,
    items: DataFrame,
    width: int,
    *,
    ridge: float | None = None,
    centre: float | None = None,
    min_items: int = 1,
    chunk: int = DEFAULTS.solve_chunk,
) -> DataFrame:
    """Virtual user factors ``(userId, mean, vec)`` for users outside the model.

    Library form: least squares on deviations from the user's own mean. Serving form: ``ridge`` set
    (0.01 per component), deviations from one ``centre``, at least two known items.
    """
    mean = F.col("_user_mean") if centre is None else F.lit(float(centre))
    return _fold_in(
        ratings, items, width, weight=F.lit(1.0), target=F.col("rating") - F.col("mean"), mean=mean,
        base=None if ridge is None else ridge * np.eye(width), min_items=min_items, chunk=chunk,
    )


def fold_in_als(
    ratings: DataFrame,
    items: DataFrame,
    width: int,
    *,
    alpha: float = DEFAULTS.als_alpha,
    reg: float = DEFAULTS.als_reg,
    observed_only: bool = False,
    chunk: int = DEFAULTS.solve_chunk,
) -> DataFrame:
    """User factors from fixed item factors, confidence ``1 + alpha · rating``.

    The training form adds the Gram matrix of all items to the observed part; ``observed_only`` uses
    the rated items alone.
    """
    confidence = 1.0 + alpha * F.col("rating")
    base = reg * np.eye(width)
    if not observed_only:
        base = base + gram(items, width)
    return _fold_in(
        ratings, items, width, weight=confidence if observed_only else confidence - 1.0, target=confidence,
        mean=F.lit(0.0), base=base, min_items=1, chunk=chunk,
    )


# --- scoring --------------------------------------------------------------------------------------


def factor_top_n(
    users: DataFrame, items: DataFrame, seen: DataFrame | None = None, *, n: int = DEFAULTS.top_n
) -> DataFrame:
    """``(userId, rank, movieId, score)``: best unseen items by mean + product."""
    skip = None
    if seen is not None:
        mine = seen.select("userId", "movieId").distinct().join(users.select("userId"), "userId", "left_semi")
        skip = mine.select(F.col("userId").alias("l"), F.col("movieId").alias("r"))
    best = dense_top(
        users.select(F.col("userId").alias("l"), "vec", F.col("mean").alias("shift")),
        items.select(F.col("movieId").alias("r"), "vec"),
        n=n,
        skip=skip,
    )
    return best.select(F.col("l").alias("userId"), "rank", F.col("r").alias("movieId"), "score")
