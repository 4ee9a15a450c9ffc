"""Checks before a track is written: each lists the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantable.operators.sweep import STRIDE


class TrackError(ValueError):
    """A track breaks a rule of its format."""


def bad_order(track: DataFrame) -> DataFrame:
    """Rows that end before they start; equal ends are allowed."""
    return track.filter("s > e").withColumn("problem", F.lit("start after end"))


def bad_bounds(track: DataFrame, sizes: DataFrame) -> DataFrame:
    """Signal rows that end beyond their chromosome, or features that start there."""
    beyond = F.col("e") > F.col("length") if "v" in track.columns else F.col("s") >= F.col("length")
    return track.join(sizes.select("chrom", "length"), "chrom").filter(beyond | (F.col("s") < 0)).drop("length").withColumn("problem", F.lit("outside the chromosome"))


def bad_overlaps(signal: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Signal rows that end after the next row of their chromosome starts.

    Within strides of the axis the next row is a window's lead; the last row of
    a stride looks at the first of the next one that has rows.
    """
    rows = signal.withColumn("_b", F.floor(F.col("s") / stride).cast("long"))
    firsts = rows.groupBy("chrom", "_b").agg(F.min("s").alias("first"))
    nexts = firsts.select("chrom", "_b", F.lead("first").over(Window.partitionBy("chrom").orderBy("_b")).alias("_next"))
    inside = Window.partitionBy("chrom", "_b").orderBy("s", "e")
    out = rows.join(nexts, ["chrom", "_b"]).withColumn("_n", F.coalesce(F.lead("s").over(inside), "_next"))
    return out.filter(F.col("e") > F.col("_n")).select(*signal.columns, F.lit("overlaps the next row").alias("problem"))


def bad_chroms(track: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of chromosomes without a length."""
    return track.join(sizes.select("chrom"), "chrom", "left_anti").select(*track.columns, F.lit("unknown chromosome").alias("problem"))


def violations(track: DataFrame, sizes: DataFrame) -> DataFrame:
    """All of these; overlaps count for signals only."""
    out = bad_order(track).unionByName(bad_bounds(track, sizes)).unionByName(bad_chroms(track, sizes))
    return out.unionByName(bad_overlaps(track)) if "v" in track.columns else out


def check(track: DataFrame, sizes: DataFrame) -> DataFrame:
    """The track itself, or TrackError for an empty one and for the first violation found."""
    if not track.limit(1).count():
        raise TrackError("the track is empty")
    if bad := violations(track, sizes).limit(1).collect():
        raise TrackError(f"{bad[0]['chrom']}:{bad[0]['s']}-{bad[0]['e']}: {bad[0]['problem']}")
    return track
