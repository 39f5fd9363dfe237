from pyspark.sql import functions as F

from tastegrid.functions import jsonish, numeric
from tastegrid.operators import catalog, cleaning, features, selection

MOVIE = "id string, title string, budget string, revenue string, runtime string, release_date string, genres string"


def test_movie_rules(frame):
    ok = "[{'id': 1, 'name': 'Drama'}]"
    rows = [
        ("1", "a", "0", "5", "30", "1900-01-01", ok),
        ("2", "b", "10", "x", "300", "2026-12-31", ok),
        ("3", "c", "1", "1", "29", "2000-01-01", ok),
        ("4", "d", "1", "1", "301", "2000-01-01", ok),
        ("5", "e", "1", "1", "100", "1899-12-31", ok),
        ("6", "f", "1", "1", "100", "2027-01-01", ok),
        ("1997-08-20", "g", "1", "1", "100", "2000-01-01", ok),
        ("8", "h", "1", "1", "100", "no date", ok),
        ("9", "i", "1", "1", None, "2000-01-01", ok),
    ]
    got = {r["id"]: r for r in cleaning.clean_movies(frame(rows, MOVIE)).collect()}
    assert set(got) == {1, 2}
    assert got[1]["budget"] is None and got[1]["revenue"] == 5.0 and got[1]["year"] == 1900
    assert got[2]["revenue"] is None and got[2]["month"] == 12 and got[2]["genre_names"] == ["Drama"]


def test_list_cells_of_every_kind(frame):
    cells = {
        '[{"id": 1, "name": "A"}]': ["A"],
        "[{'id': 1, 'name': 'B'}, {'id': 2, 'name': \"O'Neil\"}]": ["B", "O'Neil"],
        "[{'id': 1, 'name': 'It\\'s'}]": ["It's"],
        "[{'id': None, 'name': 'C', 'adult': False}]": ["C"],
        "[{'name': '\\x41b'}]": ["Ab"],
        "[]": [],
        "nope": [],
        "": [],
        "[{'name': ": [],
        None: [],
    }
    df = frame([(i, c) for i, c in enumerate(cells)], "i long, c string")
    out = df.withColumn("n", jsonish.names(jsonish.parse_items_or_empty(F.col("c")))).orderBy("i").collect()
    assert [r["n"] for r in out] == list(cells.values())
    assert tuple(cleaning.list_rejects(df, "c").first()) == (10, 3)


def test_credits(frame):
    cast = "[" + ", ".join(f"{{'name': 'n{i}'}}" for i in range(7)) + "]"
    crew = "[{'job': 'Editor', 'name': 'e'}, {'job': 'Director', 'name': 'd1'}, {'job': 'Director', 'name': 'd2'}]"
    row = cleaning.clean_credits(frame([("7", cast, crew), ("x", cast, crew)], "id string, cast string, crew string")).collect()
    assert len(row) == 1 and row[0]["cast_names"] == [f"n{i}" for i in range(5)] and row[0]["director"] == ["d1", "d2"]


def test_ratings_and_links(frame):
    rows = [(1, 1, 0.5, 0), (1, 1, 0.5, 0), (1, 2, 5.0, 0), (1, 3, 0.4, 0), (1, 4, 5.5, 0)]
    clean = cleaning.clean_ratings(frame(rows, "userId long, movieId long, rating double, timestamp long"))
    assert sorted(r["movieId"] for r in clean.collect()) == [1, 2]
    links = frame([("1", "9", "2"), ("1", "8", "3"), ("2", None, "1"), ("x", "5", "1")], "movieId string, tmdbId string, imdbId string")
    assert [tuple(r) for r in cleaning.clean_links(links).select("movieId", "tmdbId").collect()] == [(1, 8)]


def test_calendar_parts(frame):
    df = frame([(0, 0.5), (86_400 * 8, 5.0)], "timestamp long, rating double")
    out = cleaning.rating_time_features(df).orderBy("timestamp").collect()
    assert [(r["year"], r["month"], r["day_of_week"], r["rating_normalized"]) for r in out] == [(1970, 1, 0, 0.0), (1970, 1, 1, 1.0)]
    assert df.select(numeric.epoch_year("timestamp")).first()[0] == 1970


def test_integrate_dedupes_or_fans_out(frame):
    movies = frame([(1, "a"), (2, "b")], "id long, title string")
    credits = frame([(1, ["z"], ["d"]), (1, ["y"], ["d"])], "id long, cast_names array<string>, director array<string>")
    words = frame([(1, ["k"])], "id long, keyword_names array<string>")
    links = frame([(11, 1)], "movieId long, tmdbId long")
    one = {r["id"]: r for r in catalog.integrate(movies, credits, words, links).collect()}
    assert len(one) == 2 and one[1]["cast_names"] == ["y"] and one[1]["movieId"] == 11 and one[2]["movieId"] is None
    assert catalog.integrate(movies, credits, words, links, keep_fanout=True).count() == 3


def test_zscore_edges(frame):
    df = frame([(1.0, 5.0, None), (3.0, 5.0, None), (None, 5.0, None)], "a double, b double, c double")
    out = catalog.zscores(df, ["a", "b", "c", "missing"])
    assert out.columns == ["a", "b", "c", "a_normalized", "b_normalized"]
    assert [(r["a_normalized"], r["b_normalized"]) for r in out.collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_display_defaults(frame):
    schema = "movieId long, title string, genre_names array<string>, cast_names array<string>, director array<string>, keyword_names array<string>"
    row = catalog.display_rows(frame([(7, " ", None, list("abcdefg"), None, None)], schema)).first()
    assert row["title"] == "Movie 7" and row["genre_names"] == [] and row["cast_names"] == list("abcde")


def test_single_rating_features(frame):
    ratings = frame([(1, 5, 4.0, 100)], "userId long, movieId long, rating double, timestamp long")
    assert features.user_features(ratings).first()["std_rating"] is None
    row = features.movie_popularity(ratings).first()
    assert row["rating_consistency"] == 1.0 and row["popularity_rank"] == 1.0


def test_fill_and_variance(frame):
    df = frame([(1.0, None, 3.0, None), (1.0, "x", None, ["t"]), (1.0, "y", 8.0, None)], "k double, s string, v double, l array<string>")
    assert selection.low_variance_columns(df) == ["k"]
    out = selection.fill_missing(selection.drop_low_variance(df)).collect()
    assert [tuple(r) for r in out] == [("Unknown", 3.0, ["Unknown"]), ("x", 5.5, ["t"]), ("y", 8.0, ["Unknown"])]
