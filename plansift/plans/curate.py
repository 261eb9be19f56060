"""Curated training set: manifest and audit -> kept rows with their split, in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plansift.operators import datasets


def curated_splits(manifest: DataFrame, audit_counts: DataFrame, seed: int = 13, **rule) -> DataFrame:
    """Score, drop, split. No intermediate files."""
    kept = datasets.curate(manifest, datasets.score_samples(audit_counts), **rule).filter("keep")
    return datasets.assign_splits(kept.drop("keep"), seed)
