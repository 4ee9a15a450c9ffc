"""Text tracks: BED, bedGraph and chromosome lengths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("value")).filter("value <> ''")


def _position(x: Column, what: str) -> Column:
    ok = x.rlike(r"^\+?[0-9]+$") & (F.length(x) <= 11)
    n = F.when(ok, x).cast("long")
    return F.when(ok & (n < 1 << 32), n).otherwise(F.raise_error(F.concat(F.lit(f"bad {what}: "), F.coalesce(x, F.lit("missing")))).cast("long"))


def _part(parts: str, i: int) -> Column:
    return F.get(F.col(parts), F.lit(i))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, s, e, rest of tab-separated lines; rest is all after the third field, verbatim, and may be empty.

    White space at the end of a line goes. A missing or bad position raises when the row is read.
    """
    rows = _lines(spark, path).select(F.split("value", "\t", 4).alias("p"))
    return rows.select(_part("p", 0).alias("chrom"), _position(_part("p", 1), "start").alias("s"), _position(_part("p", 2), "end").alias("e"), F.coalesce(_part("p", 3), F.lit("")).alias("rest"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, s, e, v of tab-separated lines; further fields are ignored. Values are rounded to single precision. Bad fields raise."""
    rows = _lines(spark, path).select(F.split("value", "\t", 5).alias("p"))
    value = F.coalesce(_part("p", 3), F.lit("missing")).cast("float").cast("double")
    return rows.select(_part("p", 0).alias("chrom"), _position(_part("p", 1), "start").alias("s"), _position(_part("p", 2), "end").alias("e"), value.alias("v"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length of lines with a name and a length between white space."""
    rows = _lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    return rows.select(_part("p", 0).alias("chrom"), _position(_part("p", 1), "length").alias("length"))


def from_rows(spark: SparkSession, rows: Iterable[tuple], kind: str = "signal") -> DataFrame:
    """A track of (chrom, start, end, value) or (chrom, start, end[, rest]) tuples."""
    if kind == "signal":
        return spark.createDataFrame([(c, int(s), int(e), float(v)) for c, s, e, v in rows], "chrom string, s long, e long, v double")
    return spark.createDataFrame([(r[0], int(r[1]), int(r[2]), r[3] if len(r) > 3 else "") for r in rows], "chrom string, s long, e long, rest string")


def number_text(v: Column) -> Column:
    """A value as text: the shortest that gives the same single-precision number back, whole numbers without a fraction."""
    return F.regexp_replace(v.cast("float").cast("string"), r"\.0$", "")


def _ordered(track: DataFrame) -> DataFrame:
    return track.repartitionByRange("chrom", "s", "e").sortWithinPartitions("chrom", "s", "e")


def bedgraph_lines(signal: DataFrame) -> DataFrame:
    """One column, value: lines of a bedGraph file."""
    return signal.select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), number_text(F.col("v"))).alias("value"))


def bed_lines(features: DataFrame) -> DataFrame:
    """One column, value: lines of a BED file; no fourth field where rest is empty."""
    return features.select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string"), F.when(F.col("rest") != "", F.col("rest"))).alias("value"))


def zoom_lines(zoom: DataFrame) -> DataFrame:
    """One column, value: lines with nine fields of zoom records."""
    return zoom.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("chrom", "s", "e", "items", "bases", "min", "max", "sum", "sum_squares")]).alias("value"))


def write_bedgraph(signal: DataFrame, path: str) -> None:
    """Write sorted bedGraph files; the files in the order of their names are sorted as a whole."""
    bedgraph_lines(_ordered(signal)).write.mode("overwrite").text(path)


def write_bed(features: DataFrame, path: str) -> None:
    """Write sorted BED files."""
    bed_lines(_ordered(features)).write.mode("overwrite").text(path)


def write_table(track: DataFrame, path: str) -> None:
    """Write a track as Parquet, by chromosome and sorted, so that range scans skip files and row groups."""
    _ordered(track).write.mode("overwrite").partitionBy("chrom").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
