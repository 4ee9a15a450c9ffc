"""Rasters: a track's values per base or per bin of one range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantable.operators.ranges import resolve
from spantable.operators.sweep import coverage
from spantable.operators.zoom import best_zoom

SUMMARIES = ("mean", "std", "min", "max", "sum", "sum_squares", "bases_covered", "bin_covered")
NAN = float("nan")


def values(
    track: DataFrame, sizes: DataFrame, chrom: str, start: int | None = None, end: int | None = None, bins: int | None = None, summary: str = "mean", exact: bool = False,
    uncovered: float | None = None, oob: float = NAN, fillna: float | None = None, zooms: dict[int, DataFrame] | None = None,
) -> DataFrame:
    """Rows (pos, value) per base, or (bin, s, e, value) per bin.

    A base's value is the sum of what covers it, of features the number of
    them. Bins are ranges of (end - start) / bins bases, cut off to whole bases
    and at least one base wide; a bin summarises the bases in it. Feature
    tracks are summarised by depth. `uncovered` is the value of bases without
    data (None or NaN: they do not count), `fillna` replaces what is still NaN,
    and `oob` is put wherever a base or part of a bin lies beyond the
    chromosome; that order holds. zooms, tables by reduction level, stand in
    for the track when the bins are wide enough, unless exact.
    """
    if summary not in SUMMARIES:
        raise ValueError(f"no summary named {summary}")
    start, end, length = resolve(sizes, chrom, start, end, clamp=False)
    if end < start or bins is not None and bins < 1:
        raise ValueError("a range ends before it starts, or has no bins")
    uncovered = None if uncovered is None or math.isnan(uncovered) else float(uncovered)
    rows = track.filter((F.col("chrom") == chrom) & (F.col("e") > start) & (F.col("s") < end))
    if bins is None:
        out = _bases(rows, start, end, uncovered)
        outside = (F.col("pos") < 0) | (F.col("pos") >= length)
    else:
        level = None if exact or not zooms else best_zoom(list(zooms), start, end, bins)
        if level:
            z = zooms[level]
            rows = z.filter((F.col("chrom") == chrom) & (F.col("e") > start) & (F.col("s") < end))
        elif "v" not in track.columns:
            rows = coverage(rows).withColumnRenamed("depth", "v")
        out = _binned(rows, start, end, bins, summary, uncovered, bool(level))
        outside = (F.col("s") < 0) | (F.col("_hi") > length)
    value = F.col("value")
    if fillna is not None:
        value = F.nanvl(value, F.lit(float(fillna)))
    out = out.withColumn("value", F.when(outside, F.lit(float(oob))).otherwise(value))
    return out.drop("_hi")


def _bases(rows: DataFrame, start: int, end: int, uncovered: float | None) -> DataFrame:
    """Rows are laid out base by base, features as runs of depth; only the range asked for is."""
    runs = rows if "v" in rows.columns else coverage(rows).select("s", "e", F.col("depth").cast("double").alias("v"))
    first, last = F.greatest("s", F.lit(start).cast("long")), F.least("e", F.lit(end).cast("long"))
    runs = runs.select(first.alias("s"), last.alias("e"), F.col("v").cast("double").alias("v")).filter("s < e")
    at = runs.select(F.explode(F.sequence("s", F.col("e") - 1)).alias("pos"), "v").groupBy("pos").agg(F.sum("v").alias("v"))
    every = rows.sparkSession.range(start, end).withColumnRenamed("id", "pos")
    return every.join(at, "pos", "left").select("pos", F.coalesce("v", F.lit(NAN if uncovered is None else uncovered)).alias("value"))


def bin_bounds(i: Column, start: int, width: float) -> tuple[Column, Column, Column]:
    """First base of bin i, its end, and its end before it is widened to one base."""
    lo = F.lit(start) + (i * F.lit(width)).cast("long")
    hi = F.lit(start) + ((i + 1) * F.lit(width)).cast("long")
    return lo, F.greatest(hi, lo + 1), hi


def _binned(rows: DataFrame, start: int, end: int, bins: int, summary: str, uncovered: float | None, zoomed: bool) -> DataFrame:
    width = (end - start) / bins
    spark = rows.sparkSession
    every = spark.range(bins).withColumnRenamed("id", "bin")
    lo, hi, raw = bin_bounds(F.col("bin"), start, width)
    every = every.select("bin", lo.alias("s"), hi.alias("e"), raw.alias("_hi"))
    step = width or 1.0
    first = F.greatest(F.floor((F.greatest("s", F.lit(start)) - start) / step).cast("long") - 1, F.lit(0))
    last = F.least(F.floor((F.least("e", F.lit(end)) - start) / step).cast("long") + 1, F.lit(bins - 1))
    hit = rows.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
    blo, bhi, _ = bin_bounds(F.col("bin"), start, width)
    hit = hit.withColumn("_o", F.least("e", bhi) - F.greatest("s", blo)).filter("_o > 0")
    if zoomed:
        f = F.col("_o") / (F.col("e") - F.col("s"))
        sums = (F.sum(F.col("sum") * f), F.sum(F.col("sum_squares") * f), F.min("min"), F.max("max"), F.sum(F.col("bases") * f))
    else:
        o, v = F.col("_o"), F.col("v")
        real = F.when(~F.isnan(v), v)
        sums = (F.sum(v * o), F.sum(v * v * o), F.min(real), F.max(real), F.sum(o).cast("double"))
    agg = hit.groupBy("bin").agg(*[x.alias(n) for x, n in zip(sums, ("_t", "_q", "_lo", "_up", "_c"))])
    out = every.join(agg, "bin", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_t", "_q", "_c")})
    if zoomed:
        scale = F.when(F.col("_c") > 0, F.ceil("_c") / F.when(F.col("_c") > 0, F.col("_c"))).otherwise(1.0)
        out = out.withColumns({"_t": F.col("_t") * scale, "_q": F.col("_q") * scale, "_c": F.ceil("_c").cast("double")})
    n, t, q, low, up = (F.col(c) for c in ("_c", "_t", "_q", "_lo", "_up"))
    if uncovered is not None:
        size = (F.col("e") - F.col("s")).cast("double")
        rest = size - n
        u = F.lit(uncovered)
        low, up = (F.when(rest > 0, f(F.coalesce(x, u), u)).otherwise(x) for f, x in ((F.least, low), (F.greatest, up)))
        t, q, n = t + u * rest, q + u * u * rest, size
    nan = F.lit(NAN)
    some = F.when(n > 0, n)
    var = F.greatest((q - t * t / some) / F.when(n > 1, n - 1).otherwise(1.0), F.lit(0.0))
    value = {
        "mean": F.when(n > 0, t / some), "std": F.when(n >= 1, F.sqrt(var)), "min": low, "max": up, "sum": F.when(n > 0, t), "sum_squares": F.when(n > 0, q),
        "bases_covered": F.col("_c"), "bin_covered": F.col("_c") / F.lit(float(step)),
    }[summary]
    return out.select("bin", "s", "e", "_hi", F.coalesce(value, nan).alias("value"))


def to_array(raster: DataFrame):
    """The values of one raster as a numpy array, in order. For ranges that fit the driver."""
    import numpy as np

    order = "pos" if "pos" in raster.columns else "bin"
    return np.array([r["value"] for r in raster.orderBy(order).toLocalIterator()], float)
