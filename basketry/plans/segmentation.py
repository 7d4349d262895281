"""M7 + M10: end-to-end segmentation and its export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from basketry.operators import features as feat
from basketry.operators import segments as seg
from basketry.settings import DEFAULTS, Settings
from basketry.session import materialize
from basketry.sources import files


@dataclass
class Segmentation:
    features: DataFrame          # one row per customer (persisted)
    scaled: DataFrame
    assigned: DataFrame          # feature columns + cluster, distance, cluster_label
    centres: list[list[float]]
    inertia: float

    def release(self) -> None:
        self.features.unpersist()


def segment_customers(purchases: DataFrame, items: DataFrame, customers: DataFrame,
                      k: int | None = DEFAULTS.n_clusters, settings: Settings = DEFAULTS,
                      ref_date: str | None = None, epoch: str | None = None,
                      labels: dict[int, str] | None = None) -> Segmentation:
    """Features (M1) -> standardise (M2) -> best of n_init K-means fits (M4)
    -> nearest centre (M5) -> labels (P22). The feature table (one row per customer) is materialised
    once because the statistics, the fits and the assignment all read it."""
    f = feat.customer_features(purchases, items, customers,
                               ref_date=ref_date or settings.reference_date,
                               epoch=epoch or settings.streak_epoch)
    f = materialize(f).persist(StorageLevel.MEMORY_AND_DISK)
    ex = feat.standardized_exprs(f)
    s = feat.standardize(f, exprs=ex)
    cost, centres = seg.fit(s, k, seed=settings.seed, n_init=settings.n_init,
                            max_iter=settings.fit_max_iter)
    a = seg.label_clusters(seg.assign(f, centres, keep=f.columns, exprs=ex), labels)
    return Segmentation(f, s, a, centres, cost)


def export_segments(purchases: DataFrame, result: Segmentation, rows_path: str,
                    means_path: str, counts_path: str | None = None) -> DataFrame:
    """M10 + S7 + S8: features and cluster per purchase row (the J5 fan-out the
    reference exports), purchase-weighted cluster means (A22) and counts (A24).
    Returns the means frame."""
    clustered = result.assigned.drop("distance").join(purchases.select("customer_id"),
                                                      "customer_id")
    files.write_table(clustered, rows_path, "parquet")
    means = seg.profile_weighted(result.assigned).orderBy("cluster")
    files.write_table(means.coalesce(1), means_path, "csv")
    if counts_path:
        files.write_table(seg.sizes(result.assigned), counts_path, "csv")
    return means

