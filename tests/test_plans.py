"""Properties of physical plans that matter at scale."""

import pytest

from __spark_entry__ import queries
from conftest import SMALL

LAZY = (
    "clean_ratings user_features movie_features user_top_genres bias genre_stats bayes_popularity split_user pop_recs "
    "user_cf genre_cold_start search_titles strategy catalog_integrated implicit_weights history"
).split()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_product_joins(name, spark):
    text = plan(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(queries()["eda_histogram"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert "o_totalprice" not in text


def test_top_n_is_pruned_before_the_exchange(spark):
    text = plan(queries()["history"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 2  # partial and final


def test_blend_of_all_collaborative_signals(spark, monkeypatch):
    """The registered blend against pandas, from the lists of the single models."""
    import pandas as pd
    from conftest import SMALL
    from tastegrid.operators.staging import stage
    from tastegrid.plans import queries as q

    lists = {}

    def kept(name, make):
        def run(v, n):
            assert n == q.POOL
            lists[name] = stage(make(v, n).select("userId", "movieId", "score"), name)
            return lists[name]

        return run

    for name in ("user_cf", "item_cf", "factors", "profile"):
        monkeypatch.setattr(q, f"_{name}", kept(name, getattr(q, f"_{name}")))
    got = q.QUERIES["hybrid_all_recs"](spark, SMALL).toPandas()
    assert set(lists) == {"user_cf", "item_cf", "factors", "profile"}
    norm = []
    for name, df in lists.items():
        part = df.toPandas()
        part["score"] = part["score"].round(7)
        low, high = (part.groupby("userId")["score"].transform(f) for f in ("min", "max"))
        part["norm"] = ((part["score"] - low) / (high - low).where(high > low, 1.0)).where(high > low, 0.5)
        norm.append(part.assign(component=name))
    table = pd.concat(norm).pivot(index=["userId", "movieId"], columns="component", values="norm")
    assert (table[["user_cf", "item_cf", "factors"]].notna().sum(axis=1) == 3).any()
    want = 0.55 * table["profile"].fillna(0.0) + 0.45 * table[["user_cf", "item_cf", "factors"]].mean(axis=1).fillna(0.0)
    n_ratings = q.Views(spark, SMALL).ratings.groupBy("userId").count().toPandas().set_index("userId")["count"]
    warm = got[got["userId"].map(n_ratings) >= 3]
    assert len(warm) > 100
    pairs = pd.MultiIndex.from_frame(warm[["userId", "movieId"]])
    assert abs(want.reindex(pairs).fillna(0.0).to_numpy() - warm["score"].to_numpy()).max() < 1e-5
    best = want.groupby("userId").nlargest(10).groupby(level=0).sum()
    assert abs(warm.groupby("userId")["score"].sum() - best.reindex(warm["userId"].unique())).max() < 1e-4
