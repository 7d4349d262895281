"""Default parameters of the analytics jobs."""

from __future__ import annotations

from dataclasses import dataclass


# Defaults that must equal the reference configuration.
#   embedding width 32, test period 3 months, top-k 5, minimum distinct items 5,
#   fill value 0, unknown category "Unknown", K-means seed 42 with 10 restarts,
#   elbow k = 1..20 with 500 iterations, reference date 2023-12-31,
#   streak epoch 2023-01-01, report lists of 10, dashboard lists of 5.
@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 32
    test_period_months: int = 3
    top_k: int = 5
    min_interactions: int = 5
    fill_value: int = 0
    unknown_category: str = "Unknown"
    seed: int = 42
    n_init: int = 10
    max_clusters: int = 20
    elbow_max_iter: int = 500
    fit_max_iter: int = 300
    n_clusters: int = 5
    report_n: int = 10
    dashboard_n: int = 5
    reference_date: str = "2023-12-31"
    streak_epoch: str = "2023-01-01"


DEFAULTS = Settings()
