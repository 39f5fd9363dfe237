"""Hyper-parameters of the jobs, one frozen value object passed to each of them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Results depend on everything up to the own settings.
    # --- ranking -------------------------------------------------------------
    top_n: int = 10
    page_size: int = 12
    pool_size: int = 500           # candidates each component hands to the blend
    # --- splits --------------------------------------------------------------
    test_share: float = 0.2
    min_ratings_per_user: int = 5
    seed: int = 42
    # --- popularity ----------------------------------------------------------
    smoothing_quantile: float = 0.90
    # --- neighbourhood models ------------------------------------------------
    n_neighbours: int = 50
    min_ratings: int = 3
    min_user_cf_item_ratings: int = 3
    min_item_cf_item_ratings: int = 5
    # --- factors -------------------------------------------------------------
    svd_components: int = 50
    svd_grid: tuple[int, ...] = (20, 50, 100)
    min_grid_rows: int = 200
    als_rank: int = 100
    als_iterations: int = 20
    als_alpha: float = 40.0
    als_reg: float = 0.01
    # --- text ----------------------------------------------------------------
    max_terms: int = 10_000
    min_doc_freq: int = 2
    max_doc_share: float = 0.8
    genre_repeat: int = 3
    soup_cast: int = 3
    liked_rating: float = 3.5
    fallback_liked: int = 5
    # --- content -------------------------------------------------------------
    preferred_tags: int = 5
    keyword_weight: float = 0.5
    # --- blend ---------------------------------------------------------------
    content_weight: float = 0.55
    collab_weight: float = 0.45
    cold_start_ratings: int = 3
    cold_start_pop_weight: float = 0.30
    # --- evaluation ----------------------------------------------------------
    k: int = 10
    relevant_rating: float = 4.0
    eval_users: int = 100
    min_train_ratings: int = 5
    min_test_items: int = 1
    cf_target_users: int | None = None  # a number cuts the collaborative training set to that many users
    # --- serving rules -------------------------------------------------------
    min_liked: int = 2
    history_limit: int = 100
    suggestions: int = 6
    suggestion_genres: int = 2
    # --- own settings of the jobs --------------------------------------------
    score_digits: int = 7          # scores are ranked after rounding, ties go to the lower id
    svd_tolerance: float = 1e-4    # residual of a kept vector, relative to its squared singular value
    svd_max_rounds: int = 400      # products; not converged by then is an error
    svd_oversample: int = 10       # vectors that are refined beside the kept ones
    rows_per_block: int = 2_048    # edge of one score tile: memory is rows_per_block² doubles
    rows_per_split: int = 1_000_000  # a key with more rows than this is spread over several tasks
    solve_chunk: int = 4_096       # ratings of one user per partial normal equation
    light_history: int = 10_000    # users with longer histories leave the rank-list path


DEFAULTS = Params()
