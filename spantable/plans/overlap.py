"""Interval joins as equi-joins on buckets of the axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases in a bucket. Rows much longer than this are copied to many buckets.
WIDTH = 4096


def suggest_width(*tracks: DataFrame) -> int:
    """A bucket width for these tracks: the power of two above the longest 99th percentile of their lengths, 1024 at least."""
    most = 1024
    for t in tracks:
        p = t.select(F.percentile_approx(F.col("e") - F.col("s"), 0.99)).first()[0]
        most = max(most, int(p or 0))
    return 1 << (most - 1).bit_length()


def _buckets(df: DataFrame, width: int, touching: bool) -> DataFrame:
    last = F.col("e") if touching else F.greatest(F.col("e") - 1, F.col("s"))
    first = F.floor(F.col("s") / width).cast("long")
    return df.withColumn("_b", F.explode(F.sequence(first, F.greatest(F.floor(last / width).cast("long"), first))))


def overlap_join(left: DataFrame, right: DataFrame, touching: bool = False, width: int = WIDTH) -> DataFrame:
    """Inner join of rows on one chromosome that overlap; columns of right get the prefix r_.

    Strict: right.e > left.s and right.s < left.e. Touching: right.e >= left.s
    and right.s <= left.e. Both sides are copied to the buckets that they
    reach and meet by an ordinary equi-join on (chrom, bucket), which the
    planner broadcasts when a side is small and otherwise shuffles and, with
    AQE, splits where it is skewed. A pair is kept in the first bucket that
    both reach, so it comes once. Rows with s > e join nothing.
    """
    ls = left.filter("s <= e")
    rs = right.filter("s <= e").select([F.col(c).alias(f"r_{c}") for c in right.columns])
    ls = _buckets(ls, width, touching)
    rs = _buckets(rs.withColumnsRenamed({"r_s": "s", "r_e": "e"}), width, touching).withColumnsRenamed({"s": "r_s", "e": "r_e", "_b": "_rb"})
    meet: Column = (F.col("r_e") >= F.col("s")) & (F.col("r_s") <= F.col("e")) if touching else (F.col("r_e") > F.col("s")) & (F.col("r_s") < F.col("e"))
    once = F.col("_b") == F.greatest(F.floor(F.col("s") / width), F.floor(F.col("r_s") / width)).cast("long")
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("_b") == F.col("_rb")) & meet & once
    return ls.join(rs, on).drop("_b", "_rb")
