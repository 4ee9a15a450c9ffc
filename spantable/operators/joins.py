"""Joins of features with tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantable.plans.overlap import WIDTH, overlap_join


def intersect(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each row of a every row of b that overlaps or touches it, repeats kept."""
    out = overlap_join(a.select("chrom", "s", "e"), b, touching=True, width=width)
    return out.select([F.col(f"r_{c}").alias(c) for c in b.columns])


def clipped(regions: DataFrame, track: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each region the rows of the track in it, clipped to it.

    Rows of a feature track that only touch a region come with length zero.
    """
    features = "v" not in track.columns
    out = overlap_join(regions.select("chrom", "s", "e"), track, touching=features, width=width)
    rest = [F.col(f"r_{c}").alias(c) for c in track.columns if c not in ("chrom", "s", "e")]
    return out.select("chrom", F.greatest("s", "r_s").alias("s"), F.least("e", "r_e").alias("e"), *rest)
