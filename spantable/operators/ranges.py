"""Range scans, projections and restrictions by chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_signal(track: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows that overlap [start, end), clipped to it."""
    hit = track.filter((F.col("chrom") == chrom) & (F.col("e") > start) & (F.col("s") < end))
    return hit.withColumns({"s": F.greatest("s", F.lit(start).cast("long")), "e": F.least("e", F.lit(end).cast("long"))})


def scan_features(track: DataFrame, chrom: str, start: int, end: int, clip: bool = False) -> DataFrame:
    """Rows that overlap or touch [start, end], as they are or clipped."""
    hit = track.filter((F.col("chrom") == chrom) & (F.col("e") >= start) & (F.col("s") <= end))
    return hit.withColumns({"s": F.greatest("s", F.lit(start).cast("long")), "e": F.least("e", F.lit(end).cast("long"))}) if clip else hit


def resolve(sizes: DataFrame, chrom: str, start: int | None = None, end: int | None = None, clamp: bool = True) -> tuple[int, int, int]:
    """start, end and length of a range; missing ends mean the chromosome's. Unknown chromosome: KeyError."""
    row = sizes.filter(F.col("chrom") == chrom).select("length").first()
    if row is None:
        raise KeyError(f"no chromosome named {chrom}")
    n = row[0]
    start, end = 0 if start is None else start, n if end is None else end
    return (min(max(start, 0), n), min(max(end, 0), n), n) if clamp else (start, end, n)


def records(track: DataFrame, sizes: DataFrame, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The scan that fits the track, over a range clamped to the chromosome; rest split into fields."""
    start, end, _ = resolve(sizes, chrom, start, end)
    if "v" in track.columns:
        return scan_signal(track, chrom, start, end)
    out = scan_features(track, chrom, start, end)
    return out.withColumn("fields", split_rest(F.col("rest"))) if "rest" in out.columns else out


def split_rest(rest: Column) -> Column:
    """Fields of rest between white space; none for an empty rest."""
    return F.filter(F.split(F.coalesce(rest, F.lit("")), r"\s+"), lambda x: x != "")


def row_name(name: int | str | None = "interval") -> Column:
    """Name of a feature: `interval` chrom:start-end, a column number (0 chrom, 1 start, 2 end, from 3 on of rest), or None for the whole row."""
    s, e = F.col("s").cast("string"), F.col("e").cast("string")
    if name == "interval":
        return F.concat("chrom", F.lit(":"), s, F.lit("-"), e)
    if name is None:
        return F.when(F.coalesce("rest", F.lit("")) == "", F.concat_ws("\t", "chrom", s, e)).otherwise(F.concat_ws("\t", "chrom", s, e, "rest"))
    if name < 3:
        return [F.col("chrom"), s, e][name]
    return F.get(F.split(F.coalesce("rest", F.lit("")), "\t"), F.lit(name - 3))


def names_or_intervals(features: DataFrame, order: list[str], first: int = 10) -> DataFrame:
    """features with name: the fourth column if it is there and unique among the first rows, else chrom:start-end."""
    head = features.orderBy(*order).limit(first).select(row_name(3).alias("n"))
    unique = head.agg((F.countDistinct("n") == F.count(F.lit(1))).alias("_ok"))
    return features.crossJoin(F.broadcast(unique)).withColumn("name", F.when(F.col("_ok"), row_name(3)).otherwise(row_name())).drop("_ok")


def chroms(sizes: DataFrame, chrom: str | None = None) -> DataFrame:
    """The chromosomes with their lengths, or one of them; unknown chromosome: KeyError."""
    if chrom is not None:
        resolve(sizes, chrom)
        return sizes.filter(F.col("chrom") == chrom)
    return sizes


def keep_known(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left whose chromosome right has."""
    return left.join(right.select("chrom").distinct(), "chrom", "left_semi")


def drop_known(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left whose chromosome right lacks."""
    return left.join(right.select("chrom").distinct(), "chrom", "left_anti")


def same_sizes(*sizes: DataFrame) -> DataFrame:
    """One table of chromosome lengths from several; lengths that differ raise."""
    every = sizes[0]
    for s in sizes[1:]:
        every = every.unionByName(s)
    both = every.groupBy("chrom").agg(F.min("length").alias("length"), F.max("length").alias("_most"))
    bad = both.filter("length <> _most").limit(1).collect()
    if bad:
        raise ValueError(f"lengths of {bad[0]['chrom']} differ: {bad[0]['length']} and {bad[0]['_most']}")
    return both.drop("_most")
