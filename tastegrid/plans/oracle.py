"""SQL counterparts of the registered queries, written independently for cross-checking.

The statements are plain: they favour obvious correctness over speed. Iterative models (SVD, ALS and
what is built on them) have no SQL and are checked against NumPy in the tests.
"""

from __future__ import annotations

import re

from tastegrid.functions.stopwords import ENGLISH
from tastegrid.operators.hybrid import STRATEGY_LABELS
from tastegrid.plans import queries as q
from tastegrid.sources.fixtures import with_views

ORACLE: dict[str, str] = {}


def r7(x: str) -> str:
    return f"CASE WHEN round({x}, 7) = 0 THEN 0.0::DOUBLE ELSE round({x}, 7) END"


def text(x: str) -> str:
    return f"array_to_string({x}, '|')"


def add(name: str, final: str, views: tuple[str, ...] = (), *ctes: tuple[str, str]) -> None:
    parts = [*with_views(*views), *ctes]
    head = ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in parts)
    ORACLE[name] = (f"WITH {head}\n" if head else "") + final


# --- shared steps ---------------------------------------------------------------------------------


def bayes(source: str = "ratings", name: str = "bayes") -> list[tuple[str, str]]:
    return [
        (f"{name}_stats", f"SELECT movieId, count(rating) AS n, avg(rating) AS a FROM {source} GROUP BY movieId"),
        (
            name,
            f"""SELECT movieId, n, a,
                n / (n + (SELECT quantile_cont(n, 0.9) FROM {name}_stats)) * a
                + (SELECT quantile_cont(n, 0.9) FROM {name}_stats)
                  / (n + (SELECT quantile_cont(n, 0.9) FROM {name}_stats)) * (SELECT avg(a) FROM {name}_stats) AS score
                FROM {name}_stats""",
        ),
    ]


def top(source: str, key: str, item: str, n: int, score: str = "score") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY round({score}, 7) DESC, {item}) AS rank
               FROM {source} QUALIFY rank <= {n}"""


def renamed(steps: list[tuple[str, str]], prefix: str, **tables: str) -> list[tuple[str, str]]:
    """The same steps under other names, reading other tables."""
    names = {n: prefix + n for n, _ in steps} | tables
    word = re.compile(r"(?<![\w.'])(" + "|".join(names) + r")\b(?!\s*\()")
    return [(prefix + n, word.sub(lambda m: names[m[0]], sql)) for n, sql in steps]


SPLIT = [
    (
        "marked",
        """SELECT *, row_number() OVER (PARTITION BY userId
                ORDER BY md5('42:' || userId || ':' || movieId), movieId) AS rn,
               count(*) OVER (PARTITION BY userId) AS cnt FROM ratings""",
    ),
    (
        "split",
        """SELECT userId, movieId, rating, "timestamp",
               CASE WHEN rn <= greatest(1, floor(cnt * 0.2)) THEN 1 ELSE 0 END AS is_test FROM marked WHERE cnt >= 5""",
    ),
    ("train", "SELECT * FROM split WHERE is_test = 0"),
    ("test", "SELECT * FROM split WHERE is_test = 1"),
    (
        "picked",
        """SELECT userId FROM (SELECT userId FROM test GROUP BY userId)
           WHERE userId IN (SELECT userId FROM train GROUP BY userId HAVING count(*) >= 5)
           ORDER BY md5('42:' || userId), userId LIMIT 100""",
    ),
]


def popular(source: str, seen: str, users: str, n: int, name: str) -> list[tuple[str, str]]:
    """Users times items minus seen, top n."""
    return [
        (
            f"{name}_all",
            f"""SELECT u.userId, b.movieId, b.score FROM {users} u CROSS JOIN {source} b
                WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.userId = u.userId AND s.movieId = b.movieId)""",
        ),
        (name, top(f"{name}_all", "userId", "movieId", n)),
    ]


def tag_recs(train: str, users: str, scores: str, n: int, name: str) -> list[tuple[str, str]]:
    steps = [
        (
            f"{name}_tags",
            """SELECT DISTINCT movieId, 'g' AS kind, unnest(genre_names) AS tag FROM movies
               UNION ALL SELECT DISTINCT movieId, 'k', unnest(keyword_names) FROM movies""",
        ),
        (
            f"{name}_means",
            f"""SELECT r.userId, t.kind, t.tag, avg(r.rating) AS m
                FROM {train} r JOIN {name}_tags t USING (movieId) WHERE r.userId IN (SELECT userId FROM {users})
                GROUP BY ALL""",
        ),
        (
            f"{name}_own",
            f"""SELECT userId, kind, tag FROM {name}_means
                QUALIFY row_number() OVER (PARTITION BY userId, kind ORDER BY round(m, 7) DESC, tag) <= 5""",
        ),
        (
            f"{name}_default",
            f"""SELECT kind, tag FROM (SELECT kind, tag, count(*) AS n FROM {train} JOIN {name}_tags USING (movieId)
                GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, tag) <= 5""",
        ),
        (
            f"{name}_want",
            f"""SELECT userId, kind, tag FROM {name}_own
                UNION ALL SELECT u.userId, d.kind, d.tag FROM {users} u CROSS JOIN {name}_default d
                WHERE NOT EXISTS (SELECT 1 FROM {name}_own o WHERE o.userId = u.userId AND o.kind = d.kind)""",
        ),
        (
            f"{name}_match",
            f"""SELECT w.userId, t.movieId, sum(CASE WHEN w.kind = 'g' THEN 1.0 ELSE 0.5 END)::DOUBLE AS s
                FROM {name}_want w JOIN {name}_tags t USING (kind, tag) GROUP BY ALL""",
        ),
        (
            f"{name}_all",
            f"""SELECT u.userId, m.movieId, coalesce(b.score, 0) + coalesce(x.s, 0) AS score
                FROM {users} u CROSS JOIN movies m LEFT JOIN {scores} b ON b.movieId = m.movieId
                LEFT JOIN {name}_match x ON x.userId = u.userId AND x.movieId = m.movieId
                WHERE NOT EXISTS (SELECT 1 FROM {train} s WHERE s.userId = u.userId AND s.movieId = m.movieId)""",
        ),
        (name, top(f"{name}_all", "userId", "movieId", n)),
    ]
    return steps


def active(min_users: int, min_movies: int, name: str = "act") -> tuple[str, str]:
    return (
        name,
        f"""SELECT * FROM ratings
            WHERE userId IN (SELECT userId FROM ratings GROUP BY userId HAVING count(*) >= {min_users})
              AND movieId IN (SELECT movieId FROM ratings GROUP BY movieId HAVING count(*) >= {min_movies})""",
    )


USERS = ("users", "SELECT c_custkey AS userId FROM customer")


def user_cf(n: int) -> list[tuple[str, str]]:
    return [
        active(3, 3),
        ("mu", "SELECT userId, avg(rating) AS m FROM act GROUP BY userId"),
        ("dev", "SELECT userId, movieId, rating - m AS d, m FROM act JOIN mu USING (userId)"),
        ("len", "SELECT userId, sqrt(sum(d * d)) AS z FROM dev GROUP BY userId"),
        (
            "dots",
            """SELECT a.userId AS l, b.userId AS r, sum(a.d * b.d) AS s FROM dev a JOIN dev b
               ON a.movieId = b.movieId AND a.userId <> b.userId GROUP BY ALL""",
        ),
        (
            "sims",
            """SELECT l, r, s / (x.z * y.z) AS sim FROM dots JOIN len x ON x.userId = l JOIN len y ON y.userId = r
               WHERE x.z > 0 AND y.z > 0 AND s / (x.z * y.z) > 1e-12""",
        ),
        ("near", "SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY l ORDER BY round(sim, 7) DESC, r) <= 50"),
        (
            "cf_all",
            """SELECT n.l AS userId, d.movieId, any_value(mu.m) + sum(sim * d.d) / sum(sim) AS score
               FROM near n JOIN dev d ON d.userId = n.r JOIN mu ON mu.userId = n.l
               WHERE n.l IN (SELECT userId FROM users)
                 AND NOT EXISTS (SELECT 1 FROM act s WHERE s.userId = n.l AND s.movieId = d.movieId)
               GROUP BY n.l, d.movieId""",
        ),
        ("user_cf", top("cf_all", "userId", "movieId", n)),
    ]


def item_cf(n: int) -> list[tuple[str, str]]:
    return [
        active(3, 5),
        ("mi", "SELECT movieId, avg(rating) AS m FROM act GROUP BY movieId"),
        ("dev", "SELECT userId, movieId, rating - m AS d FROM act JOIN mi USING (movieId)"),
        ("len", "SELECT movieId, sqrt(sum(d * d)) AS z FROM dev GROUP BY movieId"),
        (
            "dots",
            """SELECT a.movieId AS l, b.movieId AS r, sum(a.d * b.d) AS s FROM dev a JOIN dev b
               ON a.userId = b.userId AND a.movieId <> b.movieId GROUP BY ALL""",
        ),
        (
            "pairs",
            """SELECT l, r, s / (x.z * y.z) AS sim, row_number() OVER (PARTITION BY l ORDER BY round(s / (x.z * y.z), 7) DESC, r) AS rn
               FROM dots JOIN len x ON x.movieId = l JOIN len y ON y.movieId = r
               WHERE x.z > 0 AND y.z > 0 AND s / (x.z * y.z) > 1e-12""",
        ),
        (
            "scored",
            """SELECT d.userId, p.r AS movieId, sum(sim * d.d) / sum(sim) AS x, min(rn) AS rn FROM dev d JOIN pairs p ON p.l = d.movieId
               WHERE d.userId IN (SELECT userId FROM users) GROUP BY d.userId, p.r""",
        ),
        (
            "open",
            """SELECT userId, movieId, m + x AS score FROM scored c JOIN mi USING (movieId) WHERE rn <= 50 AND NOT EXISTS
               (SELECT 1 FROM act s WHERE s.userId = c.userId AND s.movieId = c.movieId)""",
        ),
        ("best", top("open", "userId", "movieId", n)),
    ]


_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH)

SOUP = (
    "soups",
    """SELECT movieId, array_to_string(list_filter([
            CASE WHEN len(genre_names) > 0 THEN array_to_string(genre_names, ' ') || ' ' || array_to_string(genre_names, ' ')
                 || ' ' || array_to_string(genre_names, ' ') ELSE '' END,
            coalesce(overview, ''), array_to_string(director, ' '),
            coalesce(array_to_string(cast_names[1:3], ' '), ''), array_to_string(keyword_names, ' '),
            coalesce(title, '')], lambda p: trim(p, ' ') <> ''), ' ') AS soup FROM catalog""",
)
TFIDF = [
    SOUP,
    (
        "words",
        f"""SELECT movieId, list_filter(regexp_extract_all(lower(soup), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                lambda t: t NOT IN ({_STOPS})) AS w FROM soups""",
    ),
    (
        "placed",
        """SELECT movieId, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM words""",
    ),
    (
        "grams",
        """SELECT movieId, t AS term FROM placed UNION ALL
           SELECT movieId, t || ' ' || nxt FROM (SELECT movieId, t,
               lead(t) OVER (PARTITION BY movieId ORDER BY i) AS nxt FROM placed) WHERE nxt IS NOT NULL""",
    ),
    ("tf", "SELECT movieId, term, count(*) AS tf FROM grams GROUP BY ALL"),
    ("terms", "SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term"),
    ("docs", "SELECT count(*) AS n FROM soups"),
    (
        "vocab",
        """SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM terms, docs WHERE df >= 2 AND df <= 0.8 * n
           ORDER BY total DESC, term LIMIT 10000""",
    ),
    ("rawtw", "SELECT movieId, term, tf * idf AS w FROM tf JOIN vocab USING (term)"),
    ("tw", "SELECT movieId, term, w / sqrt(sum(w * w) OVER (PARTITION BY movieId)) AS w FROM rawtw"),
]


def similar(where: str = "true", n: int = 10) -> list[tuple[str, str]]:
    return [
        (
            "cosines",
            f"""SELECT a.movieId, b.movieId AS similarId, sum(a.w * b.w) AS score FROM tw a JOIN tw b
                ON a.term = b.term AND a.movieId <> b.movieId WHERE {where} GROUP BY ALL HAVING sum(a.w * b.w) > 1e-12""",
        ),
        ("positive", top("cosines", "movieId", "similarId", n)),
        *filled("positive", "sims", "movieId", "similarId", f"SELECT DISTINCT movieId FROM tw a WHERE {where}", "SELECT movieId, movieId AS similarId FROM tw", n),
    ]


def filled(source: str, out: str, key: str, item: str, asked: str, gone: str, n: int) -> list[tuple[str, str]]:
    """Lists of fewer than ``n`` rows go on with the items of smallest id, at score 0."""
    return [
        (f"{out}_short", f"SELECT {key}, count({item}) AS have FROM ({asked}) LEFT JOIN {source} USING ({key}) GROUP BY {key} HAVING count({item}) < {n}"),
        (f"{out}_gone", f"SELECT {key}, {item} FROM {source} UNION SELECT {key}, {item} FROM ({gone})"),
        (
            f"{out}_more",
            f"""SELECT s.{key}, i.{item}, have, row_number() OVER (PARTITION BY s.{key} ORDER BY i.{item}) AS rn
                FROM {out}_short s, (SELECT DISTINCT movieId AS {item} FROM tw) i
                WHERE NOT EXISTS (SELECT 1 FROM {out}_gone g WHERE g.{key} = s.{key} AND g.{item} = i.{item})""",
        ),
        (
            out,
            f"""SELECT {key}, {item}, score, rank FROM {source} UNION ALL
                SELECT {key}, {item}, 0.0, have + rn FROM {out}_more WHERE have + rn <= {n}""",
        ),
    ]


def profile(n: int) -> list[tuple[str, str]]:
    return [
        (
            "likes",
            """SELECT userId, movieId, rating FROM ratings WHERE rating >= 3.5 UNION ALL
               SELECT userId, movieId, rating FROM (SELECT *, row_number() OVER (PARTITION BY userId
                   ORDER BY rating DESC, movieId) AS rn FROM ratings
                   WHERE userId NOT IN (SELECT userId FROM ratings WHERE rating >= 3.5)) WHERE rn <= 5""",
        ),
        ("raw_p", "SELECT userId, term, sum(rating * w) AS w FROM likes JOIN tw USING (movieId) GROUP BY ALL"),
        ("prof", "SELECT userId, term, w / sqrt(sum(w * w) OVER (PARTITION BY userId)) AS w FROM raw_p"),
        (
            "prof_all",
            """SELECT p.userId, t.movieId, sum(p.w * t.w) AS score FROM prof p JOIN tw t USING (term)
               GROUP BY p.userId, t.movieId HAVING sum(p.w * t.w) > 1e-12""",
        ),
        (
            "prof_new",
            """SELECT * FROM prof_all a WHERE NOT EXISTS
               (SELECT 1 FROM ratings s WHERE s.userId = a.userId AND s.movieId = a.movieId)""",
        ),
        ("prof_top", top("prof_new", "userId", "movieId", n)),
        *filled("prof_top", "profile", "userId", "movieId", "SELECT DISTINCT userId FROM likes JOIN tw USING (movieId)", "SELECT userId, movieId FROM ratings", n),
    ]


IMPLICIT = (
    "implicit",
    """SELECT userId, movieId, max(CASE WHEN rating >= 3.5 AND interaction_type IN ('like','watch','view','click','rate') THEN rating
            WHEN interaction_type = 'like' THEN 5.0 WHEN interaction_type = 'watch' THEN 4.0
            WHEN interaction_type = 'view' THEN 3.5 WHEN interaction_type = 'click' THEN 3.0 END)::DOUBLE AS weight
       FROM interactions WHERE movieId IS NOT NULL GROUP BY ALL HAVING weight IS NOT NULL""",
)

RECS = f"SELECT userId, rank, movieId, {r7('score')} AS score FROM "

# --- cleaning -------------------------------------------------------------------------------------

add("clean_ratings", "SELECT DISTINCT * FROM ratings_raw WHERE rating BETWEEN 0.5 AND 5", ("ratings_raw",))
add("user_item", 'SELECT userId, movieId, rating, "timestamp" FROM ratings', ("ratings",))
add(
    "ratings_temporal",
    f"""SELECT userId, movieId, CAST(floor("timestamp" / 31557600.0::DOUBLE + 1970) AS BIGINT) AS year,
        CAST(floor(("timestamp"::DOUBLE / (30.44::DOUBLE * 86400)) % 12 + 1) AS BIGINT) AS month,
        CAST(floor(("timestamp"::DOUBLE / 86400) % 7) AS BIGINT) AS day_of_week,
        {r7('(rating - 0.5) / 4.5')} AS rating_normalized FROM ratings""",
    ("ratings",),
)
add(
    "clean_catalog",
    f"""SELECT movieId AS id, title, CASE WHEN budget = 0 THEN NULL ELSE budget END AS budget,
        CASE WHEN movieId % 13 = 0 THEN NULL ELSE {r7('revenue')} END AS revenue, runtime, year, month,
        {text('genre_names')} AS genre_names FROM movies
        WHERE movieId % 97 <> 0 AND movieId % 89 <> 0 AND runtime BETWEEN 30 AND 300 AND year BETWEEN 1900 AND 2026""",
    ("movies",),
)
add(
    "json_names",
    f"""SELECT m.movieId AS id, {text('cast_names')} AS cast_names, {text('director')} AS director,
        {text('keyword_names')} AS keyword_names FROM movies m JOIN credits c ON m.movieId = c.movieId""",
    ("movies", "credits"),
)
add(
    "link_table",
    "SELECT movieId, tmdbId, imdbId FROM links WHERE tmdbId IS NOT NULL",
    ("links",),
)
add("list_cells", f"SELECT movieId, len(genre_names) AS n, {text('genre_names')} AS genre_names FROM movies", ("movies",))
add(
    "catalog_integrated",
    f"""SELECT m.movieId + 100000 AS id, title, {text('cast_names')} AS cast_names,
        CASE WHEN c.movieId IS NULL THEN NULL ELSE {text('director')} END AS director,
        {text('keyword_names')} AS keyword_names, l.movieId AS movieId, l.tmdbId AS tmdbId
        FROM movies m LEFT JOIN credits c ON m.movieId = c.movieId LEFT JOIN links l ON l.tmdbId = m.movieId + 100000""",
    ("movies", "credits", "links"),
)
add(
    "titled_ratings",
    """SELECT r.userId, r.movieId, r.rating, l.tmdbId, m.title FROM ratings r LEFT JOIN links l USING (movieId)
       LEFT JOIN movies m ON m.movieId + 100000 = l.tmdbId""",
    ("ratings", "links", "movies"),
)
add(
    "catalog_zscore",
    "SELECT movieId, "
    + ", ".join(
        r7(f"({c} - (SELECT avg({c}) FROM movies)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM movies)")
        + f" AS {c}_normalized"
        for c in q.Z_COLUMNS
    )
    + " FROM movies",
    ("movies",),
)
GENRES = ("tags", "SELECT DISTINCT movieId, unnest(genre_names) AS genre FROM movies")
KEYWORDS = ("words", "SELECT DISTINCT movieId, unnest(keyword_names) AS keyword FROM movies")
add(
    "genre_dummies",
    """SELECT m.movieId, 'genre_' || g.genre || CASE WHEN g.twin > 1 THEN '_' || g.twin ELSE '' END AS genre, CASE WHEN list_contains(genre_names, g.genre) THEN 1 ELSE 0 END::BIGINT AS flag
       FROM movies m CROSS JOIN (SELECT genre, row_number() OVER (PARTITION BY lower(genre) ORDER BY n DESC, genre) AS twin
           FROM (SELECT genre, count(*) AS n FROM tags GROUP BY genre ORDER BY n DESC, genre LIMIT 20)) g""",
    ("movies",),
    GENRES,
)
add(
    "display_rows",
    f"""SELECT movieId, coalesce(nullif(trim(title), ''), 'Movie ' || movieId) AS title, {text('genre_names')} AS genre_names,
        coalesce({text('cast_names[1:5]')}, '') AS cast_names, {text('director')} AS director,
        {text('keyword_names[1:1]')} AS keyword_names, year FROM catalog""",
    ("catalog",),
)
add("vote_popularity", f"SELECT movieId, {r7('vote_average * ln(1 + vote_count)')} AS score FROM movies", ("movies",))

# --- features -------------------------------------------------------------------------------------

add(
    "user_features",
    f"""SELECT userId, {r7('avg(rating)')} AS avg_rating, {r7('stddev_samp(rating)')} AS std_rating, count(rating) AS n_ratings,
        min("timestamp") AS first_rating, max("timestamp") AS last_rating,
        CAST(floor((max("timestamp") - min("timestamp")) / 86400) AS BIGINT) AS rating_span_days FROM ratings GROUP BY userId""",
    ("ratings",),
)
add(
    "movie_features",
    f"""SELECT movieId, {r7('avg(rating)')} AS avg_rating, {r7('stddev_samp(rating)')} AS std_rating, count(rating) AS n_ratings,
        count(DISTINCT userId) AS n_unique_users FROM ratings_raw GROUP BY movieId""",
    ("ratings_raw",),
)
add(
    "user_activity",
    f"""SELECT userId, count(rating) AS n_ratings, {r7('avg(rating)')} AS avg_rating, {r7('stddev_samp(rating)')} AS std_rating,
        min(rating) AS min_rating, max(rating) AS max_rating, count(DISTINCT movieId) AS n_unique_movies,
        max(rating) - min(rating) AS rating_diversity FROM ratings_raw GROUP BY userId""",
    ("ratings_raw",),
)
TOP_GENRES = [
    GENRES,
    ("genre_counts", "SELECT userId, genre, count(*) AS c FROM ratings JOIN tags USING (movieId) GROUP BY ALL"),
    (
        "favourites",
        """SELECT userId, string_agg(genre, '|' ORDER BY rn) AS top_genres FROM (SELECT *, row_number() OVER
           (PARTITION BY userId ORDER BY c DESC, genre) AS rn FROM genre_counts) WHERE rn <= 3 GROUP BY userId""",
    ),
]
add("user_top_genres", "SELECT * FROM favourites", ("ratings", "movies"), *TOP_GENRES)
MOVIE_RANKS = [
    (
        "stats",
        """SELECT movieId, count(rating) AS n_ratings, avg(rating) AS a, stddev_samp(rating) AS s, min(rating) AS lo,
           max(rating) AS hi, count(DISTINCT userId) AS u FROM ratings GROUP BY movieId""",
    ),
    (
        "ranked",
        """SELECT *, rank() OVER (ORDER BY n_ratings DESC) + (count(*) OVER (PARTITION BY n_ratings) - 1) / 2.0::DOUBLE AS popularity_rank,
           rank() OVER (ORDER BY round(a, 9) DESC) + (count(*) OVER (PARTITION BY round(a, 9)) - 1) / 2.0::DOUBLE AS avg_rating_rank
           FROM stats""",
    ),
]
add(
    "movie_popularity",
    f"""SELECT movieId, n_ratings, {r7('a')} AS avg_rating, {r7('s')} AS std_rating, lo AS min_rating, hi AS max_rating,
        u AS n_unique_users, {r7('1.0 / (1.0 + coalesce(s, 0))')} AS rating_consistency, popularity_rank, avg_rating_rank FROM ranked""",
    ("ratings",),
    *MOVIE_RANKS,
)
add(
    "bias",
    f"""SELECT 'user' AS side, userId AS id, {r7('avg(rating) - (SELECT avg(rating) FROM ratings)')} AS bias FROM ratings GROUP BY userId
        UNION ALL SELECT 'movie', movieId, {r7('avg(rating) - (SELECT avg(rating) FROM ratings)')} FROM ratings GROUP BY movieId""",
    ("ratings",),
)
add(
    "temporal_features",
    """SELECT movieId, year, month, (SELECT max(year) FROM movies) - year AS movie_age_years, year // 10 * 10 AS decade
       FROM movies WHERE year IS NOT NULL""",
    ("movies",),
)
add(
    "user_engineered",
    f"""SELECT userId, count(rating) AS n_ratings, {r7('avg(rating)')} AS avg_rating, max(rating) - min(rating) AS rating_diversity,
        any_value(top_genres) AS top_genres, {r7('avg(rating) - (SELECT avg(rating) FROM ratings)')} AS user_rating_bias
        FROM ratings LEFT JOIN favourites USING (userId) GROUP BY userId""",
    ("ratings", "movies"),
    *TOP_GENRES,
)
add(
    "movie_engineered",
    f"""SELECT movieId, n_ratings, {r7('a')} AS avg_rating, popularity_rank, avg_rating_rank, year,
        (SELECT max(year) FROM movies) - year AS movie_age_years, year // 10 * 10 AS decade,
        {r7('a - (SELECT avg(rating) FROM ratings)')} AS movie_rating_bias FROM ranked LEFT JOIN movies USING (movieId)""",
    ("ratings", "movies"),
    *MOVIE_RANKS,
)
PER_MOVIE = ("per_movie", "SELECT movieId, avg(rating) AS m, count(rating) AS c FROM ratings GROUP BY movieId")
add(
    "genre_stats",
    f"""SELECT genre, {r7('avg(m)')} AS avg_rating, CAST(sum(c) AS BIGINT) AS n_ratings, {r7('stddev_samp(m)')} AS std_rating,
        count(*) AS n_movies FROM tags JOIN per_movie USING (movieId) GROUP BY genre""",
    ("ratings", "movies"),
    GENRES,
    PER_MOVIE,
)
add(
    "keyword_stats",
    f"""SELECT keyword, {r7('avg(m)')} AS avg_rating, CAST(sum(c) AS BIGINT) AS n_ratings, count(*) AS n_movies
        FROM words JOIN per_movie USING (movieId) GROUP BY keyword""",
    ("ratings", "movies"),
    KEYWORDS,
    PER_MOVIE,
)
GAPPY = (
    "gappy",
    """SELECT movieId, CASE WHEN movieId % 3 <> 0 THEN revenue END AS revenue, CASE WHEN movieId % 5 <> 0 THEN runtime END AS runtime,
       CASE WHEN movieId % 4 <> 0 THEN title END AS title, CASE WHEN movieId % 6 <> 0 THEN genre_names END AS genre_names,
       1.0::DOUBLE AS constant FROM movies""",
)
add(
    "low_variance",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(round(var_samp({c}), 2), 7) AS variance, CASE WHEN var_samp({c}) < 0.01 THEN 1 ELSE 0 END::BIGINT AS dropped FROM gappy"
        for c in ("movieId", "revenue", "runtime", "constant")
    ),
    ("movies",),
    GAPPY,
)
add(
    "fill_missing",
    f"""SELECT movieId, {r7('coalesce(revenue, (SELECT median(revenue) FROM gappy))')} AS revenue,
        coalesce(runtime, (SELECT median(runtime) FROM gappy)) AS runtime, coalesce(title, 'Unknown') AS title,
        coalesce({text('genre_names')}, 'Unknown') AS genre_names FROM gappy""",
    ("movies",),
    GAPPY,
)
add(
    "select_movie_features",
    f"""SELECT movieId, n_ratings, {r7('a')} AS avg_rating, {r7('coalesce(s, (SELECT median(s) FROM ranked))')} AS std_rating,
        u AS n_unique_users, {r7('a - (SELECT avg(rating) FROM ratings)')} AS movie_rating_bias, popularity_rank, avg_rating_rank FROM ranked""",
    ("ratings",),
    *MOVIE_RANKS,
)
add(
    "select_features",
    f"""SELECT userId, count(rating) AS n_ratings, {r7('avg(rating)')} AS avg_rating, count(DISTINCT movieId) AS n_unique_movies,
        {r7('avg(rating) - (SELECT avg(rating) FROM ratings)')} AS user_rating_bias, max(rating) - min(rating) AS rating_diversity,
        any_value(top_genres) AS top_genres FROM ratings LEFT JOIN favourites USING (userId) GROUP BY userId""",
    ("ratings", "movies"),
    *TOP_GENRES,
)

# --- exploration ----------------------------------------------------------------------------------

add("eda_histogram", "SELECT rating, count(*) AS n FROM ratings_raw GROUP BY rating", ("ratings_raw",))
add(
    "eda_counts",
    """SELECT 'user' AS side, userId AS id, count(*) AS n FROM ratings_raw GROUP BY userId
       UNION ALL SELECT 'movie', movieId, count(*) FROM ratings_raw GROUP BY movieId""",
    ("ratings_raw",),
)
add("eda_top_users", "SELECT userId, count(*) AS n FROM ratings GROUP BY userId ORDER BY n DESC, userId LIMIT 10", ("ratings",))
add(
    "eda_top_movies",
    """SELECT movieId, n, title FROM (SELECT movieId, count(*) AS n FROM ratings GROUP BY movieId ORDER BY n DESC, movieId LIMIT 20)
       LEFT JOIN movies USING (movieId)""",
    ("ratings", "movies"),
)
add("genre_frequency", "SELECT genre, count(*) AS n FROM (SELECT unnest(genre_names) AS genre FROM movies) GROUP BY genre", ("movies",))
add(
    "ratings_by_year",
    'SELECT CAST(year(to_timestamp("timestamp") AT TIME ZONE \'UTC\') AS BIGINT) AS year, count(*) AS n FROM ratings_raw GROUP BY 1',
    ("ratings_raw",),
)
add(
    "year_histogram",
    """SELECT CAST(least(floor((y - (SELECT min(y) FROM ys)) / ((SELECT max(y) - min(y) FROM ys) / 30)), 29) AS BIGINT) AS bin,
       count(*) AS n FROM ys GROUP BY 1""",
    ("ratings",),
    ("ys", 'SELECT CAST(year(to_timestamp("timestamp") AT TIME ZONE \'UTC\') AS DOUBLE) AS y FROM ratings'),
)
add(
    "eda_summary",
    f"""SELECT {r7('avg(rating)')} AS mean, {r7('median(rating)')} AS median, {r7('stddev_samp(rating)')} AS std,
        min(rating) AS min, max(rating) AS max, count(*) AS n_ratings, count(DISTINCT userId) AS n_users,
        count(DISTINCT movieId) AS n_movies,
        {r7('count(*) / (count(DISTINCT userId)::DOUBLE * count(DISTINCT movieId))')} AS density,
        {r7('1.0 - count(*) / (count(DISTINCT userId)::DOUBLE * count(DISTINCT movieId))')} AS sparsity,
        {r7('count(*) / count(DISTINCT userId)')} AS ratings_per_user, {r7('count(*) / count(DISTINCT movieId)')} AS ratings_per_movie
        FROM ratings""",
    ("ratings",),
)

# --- splits ---------------------------------------------------------------------------------------

add("split_user", "SELECT userId, movieId, rating, CAST(is_test AS BIGINT) AS is_test FROM split", ("ratings",), *SPLIT[:2])
TIME_SPLIT = [
    ("cut", 'SELECT quantile_cont("timestamp"::DOUBLE, 0.8) AS c FROM ratings'),
    ("timed", 'SELECT r.*, CASE WHEN "timestamp" > c THEN 1 ELSE 0 END::BIGINT AS is_test FROM ratings r, cut'),
]
add("split_time", 'SELECT userId, movieId, "timestamp", is_test FROM timed', ("ratings",), *TIME_SPLIT)
add(
    "split_overlap",
    """SELECT 'train' AS side, userId, movieId FROM timed WHERE is_test = 0 AND userId IN (SELECT userId FROM timed WHERE is_test = 1)
       UNION ALL SELECT 'test', userId, movieId FROM timed WHERE is_test = 1 AND userId IN (SELECT userId FROM timed WHERE is_test = 0)""",
    ("ratings",),
    *TIME_SPLIT,
)
add("eval_users", "SELECT userId FROM picked", ("ratings",), *SPLIT)
add(
    "cf_subset",
    f"""SELECT userId, movieId, rating FROM train WHERE userId IN (SELECT userId FROM picked UNION ALL SELECT userId FROM (
        SELECT userId FROM train WHERE userId NOT IN (SELECT userId FROM picked) GROUP BY userId HAVING count(*) >= 3
        ORDER BY md5('42:' || userId), userId LIMIT (SELECT {q.CF_TARGET} - count(*) FROM picked)))""",
    ("ratings",),
    *SPLIT,
)
add(
    "sampled_training",
    f"""SELECT userId, movieId, rating FROM timed WHERE is_test = 0 AND userId IN (
        SELECT userId FROM timed WHERE is_test = 1 UNION ALL
        (SELECT userId FROM timed WHERE is_test = 0 GROUP BY userId HAVING count(*) >= 5
         ORDER BY md5('42:' || userId), userId LIMIT {q.SAMPLE_SIZE // 100}))""",
    ("ratings",),
    *TIME_SPLIT,
)
add(
    "sample_load",
    f"SELECT userId, movieId, rating FROM ratings ORDER BY md5('42:' || userId || ':' || movieId), userId, movieId LIMIT {q.SAMPLE_ROWS}",
    ("ratings",),
)
add("cf_filter", "SELECT userId, movieId, rating FROM act", ("ratings",), active(30, 28))

# --- recommenders ---------------------------------------------------------------------------------

add(
    "bayes_popularity",
    f"SELECT movieId, n AS n_ratings, {r7('a')} AS avg_rating, {r7('score')} AS score FROM bayes",
    ("ratings",),
    *bayes(),
)
add(
    "popularity_pages",
    f"""SELECT rank, (rank - 1) // 12 + 1 AS page, movieId, {r7('score')} AS score FROM
        (SELECT *, row_number() OVER (ORDER BY round(score, 7) DESC, movieId) AS rank FROM bayes)""",
    ("ratings",),
    *bayes(),
)
add(
    "genre_top",
    f"""SELECT row_number() OVER (ORDER BY round(score, 7) DESC, movieId) AS rank, movieId, {r7('score')} AS score FROM bayes
        WHERE movieId IN (SELECT movieId FROM movies WHERE list_has_any(genre_names, ['SMALL', 'red']))""",
    ("ratings", "movies"),
    *bayes(),
)
add("pop_recs", RECS + "pop", ("ratings",), *bayes(), USERS, *popular("bayes", "ratings", "users", 10, "pop"))
add(
    "enriched_recs",
    f"""SELECT userId, rank, movieId, {r7('score')} AS score, title, {text('genre_names')} AS genre_names
        FROM pop JOIN movies USING (movieId) WHERE movieId % 11 <> 0""",
    ("ratings", "movies"),
    *bayes(),
    USERS,
    *popular("bayes", "ratings", "users", 10, "pop"),
)
add("genre_recs", RECS + "tagged", ("ratings", "movies"), *bayes(), USERS, *tag_recs("ratings", "users", "bayes", 10, "tagged"))
add("user_cf", RECS + "user_cf", ("ratings",), USERS, *user_cf(10))
add("item_cf", RECS + "best", ("ratings",), USERS, *item_cf(10))
add(
    "factor_topn",
    RECS + "best",
    (),
    (
        "pairs",
        """SELECT u.vec_id // 2 AS userId, i.vec_id // 2 AS movieId, list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score
           FROM embeddings u, embeddings i WHERE u.vec_id % 2 = 0 AND i.vec_id % 2 = 1""",
    ),
    ("best", top("pairs", "userId", "movieId", 10)),
)
add(
    "factor_predict",
    f"""SELECT r.userId, r.movieId, {r7('''CASE WHEN u.vec_id IS NULL THEN 3.0 ELSE 2.5 END::DOUBLE + CASE WHEN u.vec_id IS NULL OR i.vec_id IS NULL
        THEN 0 ELSE list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]) END''')} AS pred
        FROM ratings r
        LEFT JOIN embeddings u ON r.userId % 7 <> 0 AND u.vec_id = 2 * (r.userId % (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0))
        LEFT JOIN embeddings i ON r.movieId % 7 <> 0 AND i.vec_id = 2 * (r.movieId % (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 1)) + 1""",
    ("ratings",),
)


def folded(target: str, weight: str, base: str, rhs: str, known: str = "true", dual: bool = False) -> tuple:
    """Normal equations ``Σ weight·v·vᵀ + base`` of each user, by Gauss-Jordan elimination; they are positive definite.

    ``dual``: users with fewer than ``FOLD_K`` distinct vectors take the combination of them that meets the mean target
    of each, which is the solution of smallest norm.
    """
    k = q.FOLD_K
    return (
        (
            "fixed",
            f"""SELECT movieId, (embedding::DOUBLE[])[1:{k}] AS v FROM movies JOIN embeddings
                ON movieId % 7 <> 0 AND vec_id = 2 * (movieId % (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 1)) + 1""",
        ),
        ("means", "SELECT userId, avg(rating) AS m FROM ratings GROUP BY userId"),
        ("obs", f"SELECT userId, v, rating, ({target})::DOUBLE AS t, ({weight})::DOUBLE AS w FROM ratings JOIN means USING (userId) JOIN fixed USING (movieId)"),
        ("sizes", f"SELECT userId, count(DISTINCT v) AS d FROM obs GROUP BY userId HAVING {known}"),
        ("ij", f"SELECT i, j FROM range(1, {k + 1}) a(i), range(1, {k + 1}) b(j)"),
        ("gram", "SELECT i, j, sum(v[i] * v[j]) AS g FROM fixed, ij GROUP BY i, j"),
        (
            "cells",
            f"""SELECT userId, i, j, sum(w * v[i] * v[j]) + {base} AS g FROM obs JOIN sizes USING (userId), ij JOIN gram USING (i, j)
                WHERE NOT {dual} OR d >= {k} GROUP BY userId, i, j, gram.g
                UNION ALL SELECT userId, i, {k + 1}, sum({rhs} * v[i]) FROM obs JOIN sizes USING (userId), range(1, {k + 1}) a(i)
                WHERE NOT {dual} OR d >= {k} GROUP BY userId, i""",
        ),
        (
            "short",
            f"""SELECT userId, v, avg(t) AS t, row_number() OVER (PARTITION BY userId ORDER BY v) AS i, d
                FROM obs JOIN sizes USING (userId) WHERE {dual} AND d < {k} GROUP BY userId, v, d""",
        ),
        (
            "short_cells",
            """SELECT a.userId, a.i, b.i AS j, list_dot_product(a.v, b.v) AS g FROM short a JOIN short b USING (userId)
               UNION ALL SELECT userId, i, d + 1, t FROM short""",
        ),
        ("start", "SELECT userId, i, list(g ORDER BY j) AS a, count(*) - 1 AS n FROM (SELECT * FROM cells UNION ALL SELECT * FROM short_cells) GROUP BY userId, i"),
    )


def folded_rows() -> str:
    k = q.FOLD_K
    x = "a[n + 1]"
    return f"""SELECT userId, place::BIGINT AS place, CASE WHEN round(x, 5) = 0 THEN 0.0::DOUBLE ELSE round(x, 5) END AS x FROM (
        SELECT userId, i AS place, {x} AS x FROM solved WHERE userId NOT IN (SELECT userId FROM short)
        UNION ALL SELECT userId, p AS place, sum({x} * v[p]) AS x FROM solved JOIN short USING (userId, i), range(1, {k + 1}) r(p) GROUP BY userId, p)"""


ELIMINATED = (
    "eliminated(userId, step, i, a, n)",
    """SELECT userId, 0, i, a, n FROM start
       UNION ALL
       SELECT userId, step + 1, i, CASE WHEN i = step + 1 THEN list_transform(a, lambda z: z / p[step + 1])
           ELSE list_transform(range(1, n + 2), lambda c: a[c] - p[c] * a[step + 1] / p[step + 1]) END, n
       FROM (SELECT *, first_value(a) OVER (PARTITION BY userId ORDER BY CASE WHEN i = step + 1 THEN 0 ELSE 1 END) AS p FROM eliminated)
       WHERE step < n""",
)


def add_fold(name: str, *equations: str, **more: object) -> None:
    parts = [*with_views("ratings", "movies"), *folded(*equations, **more)]
    head = ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in parts)
    ORACLE[name] = f"WITH RECURSIVE {head},\n{ELIMINATED[0]} AS ({ELIMINATED[1]}),\nsolved AS (SELECT * FROM eliminated WHERE step = n)\n{folded_rows()}"


_EYE = "CASE WHEN i = j THEN {} ELSE 0 END"
add_fold("fold_least_squares", "rating - m", "1", "0", "t", dual=True)
add_fold("fold_ridge", "rating - 3.0", "1", _EYE.format(0.01 * q.FOLD_K), "t", known="count(*) >= 2")
add_fold("fold_als", "1 + 40.0 * rating", "40.0 * rating", "gram.g + " + _EYE.format(0.01), "t")
add_fold("fold_als_observed", "1 + 40.0 * rating", "1 + 40.0 * rating", _EYE.format(0.01), "t")

# --- text -----------------------------------------------------------------------------------------

add("soup", "SELECT movieId, soup FROM soups", ("catalog",), SOUP)
add("tfidf", f"SELECT movieId, term, {r7('w')} AS weight FROM tw", ("catalog",), *TFIDF)
SIMS = f"SELECT movieId, rank, similarId, {r7('score')} AS score FROM sims"
add("similar_items", SIMS, ("catalog",), *TFIDF, *similar())
add(
    "similar_or_popular",
    SIMS
    + f""" UNION ALL SELECT u.movieId, b.rank, b.movieId, {r7('b.score')} FROM asked u CROSS JOIN
        (SELECT *, row_number() OVER (ORDER BY round(score, 7) DESC, movieId) AS rank FROM bayes QUALIFY rank <= 10) b
        WHERE u.movieId NOT IN (SELECT movieId FROM tw)""",
    ("catalog", "ratings", "interactions", "links"),
    *TFIDF,
    *bayes(),
    (
        "asked",
        """SELECT DISTINCT movieId FROM (SELECT movieId FROM interactions WHERE movieId IS NOT NULL
           UNION ALL SELECT tmdbId FROM links WHERE tmdbId % 40 = 1)""",
    ),
    *similar("a.movieId IN (SELECT movieId FROM asked)"),
)
add(
    "because_you_watched",
    f"""SELECT s.movieId, rank, similarId, {r7('score')} AS score, m.title AS context, 'Because you watched ' || m.title AS reason
        FROM sims s JOIN movies m ON m.movieId = s.movieId""",
    ("catalog", "interactions"),
    *TFIDF,
    *similar("a.movieId IN (SELECT movieId FROM interactions WHERE interaction_type = 'watch')"),
)
add(
    "latest_like_similar",
    f"SELECT userId, l.movieId, rank, similarId, {r7('score')} AS score FROM latest l JOIN sims s ON s.movieId = l.movieId",
    ("catalog", "interactions"),
    *TFIDF,
    (
        "latest",
        """SELECT userId, movieId FROM interactions WHERE interaction_type = 'like' AND movieId IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY userId ORDER BY created_at DESC, id DESC) = 1""",
    ),
    *similar("a.movieId IN (SELECT movieId FROM latest)"),
)
add("profile_recs", RECS + "profile", ("catalog", "ratings"), *TFIDF, *profile(10))

# --- blend and serving ----------------------------------------------------------------------------


def normed(source: str) -> str:
    return f"""SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5
               ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
               FROM {source} WINDOW w AS (PARTITION BY userId, component)"""


VOTES = ("votes", "SELECT movieId, vote_average * ln(1 + vote_count) AS score FROM movies")
add(
    "minmax",
    f"SELECT userId, component, movieId, {r7('norm')} AS norm FROM scaled",
    ("ratings", "movies"),
    *bayes(),
    USERS,
    VOTES,
    *popular("bayes", "ratings", "users", q.POOL, "pop"),
    *popular("votes", "ratings", "users", q.POOL, "voted"),
    (
        "stacked",
        """SELECT userId, 'popularity' AS component, movieId, round(score, 7) AS score FROM pop
           UNION ALL SELECT userId, 'votes', movieId, round(score, 7) FROM voted""",
    ),
    ("scaled", normed("stacked")),
)
add(
    "hybrid_recs",
    RECS + "best",
    ("catalog", "ratings"),
    USERS,
    *TFIDF,
    *profile(q.POOL),
    *bayes(),
    *popular("bayes", "ratings", "users", q.POOL, "pop"),
    *user_cf(q.POOL),
    (
        "stacked",
        """SELECT userId, 'popularity' AS component, movieId, round(score, 7) AS score FROM pop
           UNION ALL SELECT userId, 'content', movieId, round(score, 7) FROM profile
           UNION ALL SELECT userId, 'user_cf', movieId, round(score, 7) FROM user_cf""",
    ),
    ("scaled", normed("stacked")),
    (
        "merged",
        """SELECT userId, movieId, coalesce(max(norm) FILTER (component = 'content'), 0) AS c,
           coalesce(avg(norm) FILTER (component = 'user_cf'), 0) AS f, coalesce(max(norm) FILTER (component = 'popularity'), 0) AS p
           FROM scaled GROUP BY userId, movieId""",
    ),
    (
        "blended",
        f"""SELECT m.userId, movieId, CASE WHEN coalesce(n, 0) < {q.DEFAULTS.cold_start_ratings}
                THEN 0.7::DOUBLE * (0.55::DOUBLE * c + 0.45::DOUBLE * f) + 0.3::DOUBLE * p
                ELSE 0.55::DOUBLE * c + 0.45::DOUBLE * f END AS score
            FROM merged m LEFT JOIN (SELECT userId, count(*) AS n FROM ratings GROUP BY userId) h ON h.userId = m.userId""",
    ),
    ("best", top("blended", "userId", "movieId", 10)),
)
_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STRATEGY_LABELS.items())
CHOSEN = (
    USERS,
    IMPLICIT,
    (
        "facts",
        """SELECT u.userId,
             (SELECT count(*) FROM interactions i WHERE i.userId = u.userId AND rating IS NOT NULL AND movieId IS NOT NULL) AS rated,
             (SELECT count(*) FROM interactions i WHERE i.userId = u.userId AND rating IS NOT NULL
                AND movieId IN (SELECT p_partkey FROM part)) AS known,
             (SELECT count(*) FROM implicit i WHERE i.userId = u.userId) AS liked,
             coalesce((SELECT sum(len(preferred_genres)) FROM preferences p WHERE p.userId = u.userId), 0)::BIGINT AS genres
           FROM users u""",
    ),
    (
        "chosen",
        """SELECT *, CASE WHEN rated >= 3 AND known >= 2 THEN 'hybrid' WHEN liked >= 2 THEN 'content' WHEN genres > 0 THEN 'genre'
           ELSE 'popularity' END AS strategy FROM facts""",
    ),
)
_CHOSEN_VIEWS = ("interactions", "preferences")
add("strategy", f"SELECT userId, rated, liked, genres, strategy, CASE strategy {_LABELS} END AS label FROM chosen", _CHOSEN_VIEWS, *CHOSEN)
add("stream_strategy", "SELECT userId, rated, liked, genres, strategy FROM chosen", _CHOSEN_VIEWS, *CHOSEN)
add(
    "genre_cold_start",
    RECS + "best",
    ("ratings", "movies", "interactions", "preferences"),
    *bayes(),
    (
        "fits",
        """SELECT p.userId, m.movieId, b.score FROM preferences p JOIN movies m ON list_has_any(m.genre_names, p.preferred_genres)
           JOIN bayes b ON b.movieId = m.movieId WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.userId = p.userId AND i.movieId = m.movieId)""",
    ),
    ("best", top("fits", "userId", "movieId", 10)),
)
add("implicit_weights", "SELECT userId, movieId, weight FROM implicit", ("interactions",), IMPLICIT)
add("viewed_items", "SELECT DISTINCT userId, movieId FROM interactions WHERE movieId IS NOT NULL", ("interactions",))
add(
    "rated_items",
    "SELECT userId, movieId, rating FROM interactions WHERE rating IS NOT NULL AND movieId IS NOT NULL",
    ("interactions",),
)
add(
    "history",
    """SELECT userId, row_number() OVER (PARTITION BY userId ORDER BY created_at DESC, id DESC) AS rank, id, movieId, interaction_type
       FROM interactions QUALIFY rank <= 100""",
    ("interactions",),
)
add(
    "user_status",
    """SELECT u.userId, coalesce(n, 0) AS n_interactions, CASE WHEN p.userId IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS has_onboarding,
       CASE WHEN len(preferred_genres) > 0 THEN 1 ELSE 0 END::BIGINT AS has_preferences,
       CASE WHEN coalesce(n, 0) = 0 AND coalesce(len(preferred_genres), 0) = 0 THEN 1 ELSE 0 END::BIGINT AS is_empty
       FROM users u LEFT JOIN (SELECT userId, count(*) AS n FROM interactions GROUP BY userId) i ON i.userId = u.userId
       LEFT JOIN preferences p ON p.userId = u.userId""",
    ("interactions", "preferences"),
    USERS,
)

# --- search ---------------------------------------------------------------------------------------


def searched(n: int) -> list[tuple[str, str]]:
    return [
        (
            "asked",
            r"""SELECT query_id, lower(trim(q)) AS raw, trim(regexp_replace(lower(trim(q)), '[^a-z0-9\s]', '', 'g')) AS norm FROM queries""",
        ),
        (
            "items",
            r"""SELECT movieId, title, genre_names, lower(title) AS traw, trim(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g')) AS tnorm,
                lower(array_to_string(genre_names, ' ')) AS g FROM movies""",
        ),
        (
            "judged",
            r"""SELECT query_id, movieId,
                  (CASE WHEN norm <> '' AND contains(tnorm, norm) THEN 4.0 ELSE 0 END
                   + CASE WHEN norm <> '' AND starts_with(tnorm, norm) THEN 3.0 ELSE 0 END
                   + CASE WHEN contains(traw, raw) THEN 2.0 ELSE 0 END
                   + CASE WHEN len(ws) > 0 AND len(list_filter(ws, lambda w: NOT contains(tnorm, w))) = 0 THEN 1.0 ELSE 0 END
                   + CASE WHEN contains(g, raw) THEN 0.5 ELSE 0 END)::DOUBLE AS match,
                  len(list_filter(ws, lambda w: contains(tnorm, w))) > 0 AS word
                FROM (SELECT *, list_filter(regexp_split_to_array(norm, '\s+'), lambda w: len(w) > 1) AS ws FROM asked) CROSS JOIN items""",
        ),
        (
            "found",
            """SELECT query_id, movieId, match FROM judged WHERE match > 0 UNION ALL
               SELECT query_id, movieId, 0.5 FROM judged WHERE word AND query_id NOT IN (SELECT query_id FROM judged WHERE match > 0)""",
        ),
        ("scored", "SELECT query_id, f.movieId, match * 2 + coalesce(score, 0) AS score FROM found f LEFT JOIN bayes b ON b.movieId = f.movieId"),
        ("best", top("scored", "query_id", "movieId", n)),
    ]


add(
    "search_titles",
    f"SELECT query_id, rank, movieId, {r7('score')} AS score FROM best",
    ("ratings", "movies", "queries"),
    *bayes(),
    *searched(20),
)
add(
    "suggest",
    f"""SELECT query_id, rank, b.movieId, m.title, {text('m.genre_names[1:2]')} AS genres, {r7('score')} AS score
        FROM best b JOIN movies m ON m.movieId = b.movieId""",
    ("ratings", "movies", "queries"),
    *bayes(),
    *searched(6),
)
add(
    "lookup",
    f"SELECT movieId, title, {text('genre_names')} AS genre_names FROM movies WHERE movieId IN (SELECT movieId FROM interactions)",
    ("movies", "interactions"),
)

# --- evaluation -----------------------------------------------------------------------------------

_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
add(
    "eval_global",
    f"""SELECT {r7('p')} AS precision, {r7('r')} AS recall, {r7(_F1)} AS f1, {r7('h')} AS hit_rate, n AS evaluated_users,
        CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS coverage, (SELECT count(*) FROM shown)::DOUBLE AS catalog_coverage
        FROM (SELECT avg(hits / 10) AS p, avg(hits / relevant) AS r, sum(hits) / (count(*) * 10) AS h, count(*) AS n FROM per_user)""",
    ("ratings",),
    *SPLIT,
    *bayes("train"),
    ("shown", "SELECT movieId FROM bayes ORDER BY round(score, 7) DESC, movieId LIMIT 10"),
    (
        "per_user",
        """SELECT userId, count(*) FILTER (movieId IN (SELECT movieId FROM shown)) AS hits, count(*) AS relevant
           FROM test WHERE rating >= 4 GROUP BY userId""",
    ),
)
PERSONAL = [
    *SPLIT,
    *bayes("train"),
    *popular("bayes", "train", "picked", q.POOL, "pop"),
    *tag_recs("train", "picked", "bayes", 10, "tagged"),
    *renamed(user_cf(10), "uc_", ratings="train", users="picked"),
    *renamed(item_cf(10), "ic_", ratings="train", users="picked"),
    ("mine", "SELECT * FROM train WHERE userId IN (SELECT userId FROM picked)"),
    *TFIDF,
    *renamed(profile(q.POOL), "tf_", ratings="mine"),
    (
        "mf_all",
        """SELECT p.userId, m.movieId, 2.5::DOUBLE + list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score
           FROM picked p JOIN embeddings u ON p.userId % 7 <> 0 AND u.vec_id = 2 * (p.userId % (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0)),
                movies m JOIN embeddings i ON m.movieId % 7 <> 0 AND i.vec_id = 2 * (m.movieId % (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 1)) + 1
           WHERE NOT EXISTS (SELECT 1 FROM train s WHERE s.userId = p.userId AND s.movieId = m.movieId)""",
    ),
    ("mf", top("mf_all", "userId", "movieId", q.POOL)),
    (
        "stacked",
        """SELECT userId, 'popularity' AS component, movieId, round(score, 7) AS score FROM pop
           UNION ALL SELECT userId, 'content', movieId, round(score, 7) FROM tf_profile
           UNION ALL SELECT userId, 'factors', movieId, round(score, 7) FROM mf""",
    ),
    ("scaled", normed("stacked")),
    (
        "merged",
        """SELECT userId, movieId, coalesce(max(norm) FILTER (component = 'content'), 0) AS c,
           coalesce(avg(norm) FILTER (component = 'factors'), 0) AS f, coalesce(max(norm) FILTER (component = 'popularity'), 0) AS p
           FROM scaled GROUP BY userId, movieId""",
    ),
    (
        "blended",
        f"""SELECT m.userId, movieId, CASE WHEN coalesce(n, 0) < {q.DEFAULTS.cold_start_ratings}
                THEN 0.7::DOUBLE * (0.3::DOUBLE * c + 0.7::DOUBLE * f) + 0.3::DOUBLE * p
                ELSE 0.3::DOUBLE * c + 0.7::DOUBLE * f END AS score
            FROM merged m LEFT JOIN (SELECT userId, count(*) AS n FROM train GROUP BY userId) h ON h.userId = m.userId""",
    ),
    ("mixed", top("blended", "userId", "movieId", 10)),
    (
        "lists",
        """SELECT 'popularity' AS model, userId, movieId FROM pop WHERE rank <= 10 UNION ALL SELECT 'genre_content', userId, movieId FROM tagged
           UNION ALL SELECT 'user_cf', userId, movieId FROM uc_user_cf UNION ALL SELECT 'item_cf', userId, movieId FROM ic_best
           UNION ALL SELECT 'tfidf_content', userId, movieId FROM tf_profile WHERE rank <= 10
           UNION ALL SELECT 'matrix_factorization', userId, movieId FROM mf WHERE rank <= 10 UNION ALL SELECT 'hybrid', userId, movieId FROM mixed""",
    ),
    ("wanted", "SELECT userId, movieId FROM test WHERE rating >= 4"),
    (
        "hit_rows",
        """SELECT model, l.userId, count(w.movieId) AS hits, any_value(n.c) AS relevant FROM lists l
           LEFT JOIN wanted w ON w.userId = l.userId AND w.movieId = l.movieId
           LEFT JOIN (SELECT userId, count(*) AS c FROM wanted GROUP BY userId) n ON n.userId = l.userId GROUP BY model, l.userId""",
    ),
    (
        "totals",
        """SELECT model, coalesce(avg(hits / 10) FILTER (relevant IS NOT NULL), 0) AS p,
           coalesce(avg(hits / relevant) FILTER (relevant IS NOT NULL), 0) AS r,
           sum(hits) / (count(*) * 10) AS h, count(*) AS n FROM hit_rows GROUP BY model""",
    ),
    (
        "metrics",
        f"""SELECT t.model, {r7('p')} AS precision, {r7('r')} AS recall, {r7(_F1)} AS f1, {r7('h')} AS hit_rate, n AS evaluated_users,
            {r7('n / (SELECT count(*) FROM picked)')} AS coverage,
            {r7('s.c / (SELECT count(DISTINCT movieId) FROM test)')} AS catalog_coverage
            FROM totals t JOIN (SELECT model, count(DISTINCT movieId) AS c FROM lists GROUP BY model) s ON s.model = t.model""",
    ),
]
add("eval_personal", "SELECT * FROM metrics", ("ratings", "movies", "catalog"), *PERSONAL)
add(
    "compare_models",
    "SELECT row_number() OVER (ORDER BY f1 DESC, model) AS place, model, f1 FROM metrics",
    ("ratings", "movies", "catalog"),
    *PERSONAL,
)
ERRORS = (
    "errors",
    """SELECT sqrt(avg((m - rating) * (m - rating))) AS rmse, avg(abs(m - rating)) AS mae, count(*) AS n FROM test
       JOIN (SELECT userId, avg(rating) AS m FROM train GROUP BY userId) USING (userId)""",
)
add("rmse", f"SELECT {r7('rmse')} AS rmse, {r7('mae')} AS mae, n FROM errors", ("ratings",), *SPLIT, ERRORS)
add(
    "gates",
    f"""SELECT gate, {r7('value')} AS value, bound::DOUBLE AS bound,
        CASE WHEN (gate = 'rmse' AND value < bound) OR (gate <> 'rmse' AND value >= bound) THEN 1 ELSE 0 END::BIGINT AS ok FROM (
        SELECT 'overlap_users' AS gate, (SELECT count(DISTINCT userId) FROM test WHERE userId IN (SELECT userId FROM train))::DOUBLE AS value, 95.0 AS bound
        UNION ALL SELECT 'cf_rows', (SELECT count(*) FROM train), 15000.0 UNION ALL SELECT 'rmse', (SELECT rmse FROM errors), 1.0
        UNION ALL SELECT 'evaluated_users', (SELECT evaluated_users FROM metrics WHERE model = 'popularity'), 90.0
        UNION ALL SELECT 'coverage', (SELECT coverage FROM metrics WHERE model = 'popularity'), 0.98)""",
    ("ratings", "movies", "catalog"),
    *PERSONAL,
    ERRORS,
)

# --- streams: equal to their batch twins on bounded input --------------------------------------------

add("stream_weights", "SELECT userId, movieId, weight FROM implicit", ("interactions",), IMPLICIT)
add(
    "stream_counts",
    """SELECT userId, count(*) AS n_interactions, count(*) FILTER (rating IS NOT NULL AND movieId IS NOT NULL) AS n_rated,
       CASE WHEN n_rated >= 3 THEN 1 ELSE 0 END::BIGINT AS rated_enough FROM interactions GROUP BY userId""",
    ("interactions",),
)
add(
    "stream_activity",
    """SELECT CAST(floor(epoch(created_at) / 21600) * 21600 AS BIGINT) AS window_start, interaction_type, count(*) AS n
       FROM interactions GROUP BY 1, 2""",
    ("interactions",),
)
add("stream_dedupe", "SELECT id, userId, movieId, interaction_type, rating FROM interactions", ("interactions",))
