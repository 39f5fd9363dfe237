import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tastegrid.functions.numeric import hash_position, keyed_hash
from tastegrid.operators.ranking import average_rank, exact_quantile, global_rank, running_total
from tastegrid.operators.skew import hot_keys, numbered_per_key, split_join
from tastegrid.operators.splits import mark_user_split


def skewed(frame):
    """User 1 holds a third of all rows."""
    rows = [(1, m, float(m % 10)) for m in range(40)] + [(u, m, 1.0) for u in range(2, 10) for m in range(10)]
    return frame(rows, "userId long, movieId long, rating double")


def test_split_join_equals_plain_join(frame):
    long = skewed(frame)
    small = frame([(u, f"n{u}") for u in range(1, 9)], "userId long, name string")
    plain = small.join(long, "userId")
    salted = split_join(small, long, "userId", "movieId", rows_per_split=7)
    assert hot_keys(long, "userId", 7).count() == 9
    assert hot_keys(long, "userId", 15).collect()[0]["_splits"] == 3
    assert sorted(salted.select(plain.columns).collect()) == sorted(plain.collect())
    assert sorted(split_join(small, long, "userId", "movieId").select(plain.columns).collect()) == sorted(plain.collect())


def test_numbering_is_the_same_when_cut(frame):
    df = skewed(frame).withColumn("d", keyed_hash(1, "userId", "movieId"))
    order = [F.col("d"), F.col("movieId")]
    whole = numbered_per_key(df, "userId", order, hash_position(F.col("d")))
    cut = numbered_per_key(df, "userId", order, hash_position(F.col("d")), rows_per_split=6)
    cols = ["userId", "movieId", "_rn", "_n"]
    assert sorted(whole.select(cols).collect()) == sorted(cut.select(cols).collect())


def test_user_split(frame):
    ratings = skewed(frame).unionByName(frame([(99, m, 1.0) for m in range(4)], "userId long, movieId long, rating double"))
    marked = mark_user_split(ratings).collect()
    assert sorted(marked) == sorted(mark_user_split(ratings, rows_per_split=5).collect())
    tests = pd.DataFrame(marked, columns=["userId", "movieId", "rating", "is_test"]).groupby("userId")["is_test"].sum()
    assert 99 not in tests.index and tests[1] == 8 and (tests.drop(1) == 2).all()


def test_global_rank_and_totals(frame):
    df = frame([(i, float(i % 4)) for i in range(50)], "id long, v double")
    ranked = global_rank(df, [F.col("v").desc(), F.col("id")]).toPandas().sort_values("rank")
    want = df.toPandas().sort_values(["v", "id"], ascending=[False, True])
    assert ranked["rank"].tolist() == list(range(1, 51))
    assert ranked["id"].tolist() == want["id"].tolist()
    sums = running_total(df.withColumn("one", F.lit(2)), [F.col("id")], "one", "t").toPandas().sort_values("id")
    assert sums["t"].tolist() == [2 * i for i in range(50)]


def test_average_rank_matches_pandas(frame):
    values = [3.0, 1.0, 3.0, 2.0, 2.0, 2.0, 9.0]
    got = average_rank(frame(list(enumerate(values)), "id long, v double"), "v", "r").toPandas().sort_values("id")
    assert got["r"].tolist() == pd.Series(values).rank(ascending=False).tolist()


def test_exact_quantile(frame):
    values = np.random.default_rng(1).integers(0, 30, 101).astype(float)
    df = frame([(float(v),) for v in values] + [(None,)], "v double")
    for q in (0.0, 0.25, 0.5, 0.8, 0.9, 1.0):
        assert abs(exact_quantile(df, "v", q).first()[0] - np.quantile(values, q)) < 1e-9
