"""Statistics of regions over a signal, and of whole tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantable.operators.sweep import coverage
from spantable.plans.overlap import WIDTH, overlap_join

STATS = ("size", "bases", "sum", "mean0", "mean", "min", "max")
NAN = float("nan")


def _ratio(a: Column, b: Column, other: Column) -> Column:
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(other)


def average_over_bed(regions: DataFrame, signal: DataFrame, stats: str | list[str] | None = "all", width: int = WIDTH) -> DataFrame:
    """Each region with size, bases, sum, mean0, mean, min and max of the signal in it.

    Bases without data count for size only. A region without data has mean,
    min and max NaN, as has an unknown chromosome; one of size 0 also mean0.
    `stats` picks one, several, all or, with None, the mean. Regions are told
    apart by id. The signal is summed per region before the left join, so
    regions without data stay regions without data.
    """
    wanted = list(STATS) if stats == "all" else ["mean"] if stats is None else [stats] if isinstance(stats, str) else list(stats)
    if bad := [x for x in wanted if x not in STATS]:
        raise ValueError(f"no statistic named {bad[0]}")
    o = F.least("e", "r_e") - F.greatest("s", "r_s")
    inner = overlap_join(regions.select("id", "chrom", "s", "e"), signal.select("chrom", "s", "e", "v"), width=width)
    sums = inner.groupBy("id").agg(F.sum(o).alias("_b"), F.sum(o * F.col("r_v")).alias("_t"), F.min("r_v").alias("_lo"), F.max("r_v").alias("_hi"))
    out = regions.join(sums, "id", "left").withColumns({"size": F.col("e") - F.col("s"), "bases": F.coalesce("_b", F.lit(0)).cast("long"), "sum": F.coalesce("_t", F.lit(0.0))})
    nan = F.lit(NAN)
    out = out.withColumns({"mean0": _ratio(F.col("sum"), F.col("size"), nan), "mean": _ratio(F.col("sum"), F.col("bases"), nan), "min": F.coalesce("_lo", nan), "max": F.coalesce("_hi", nan)})
    return out.select(*regions.columns, *wanted)


def values_over_bed(regions: DataFrame, signal: DataFrame, fill: float = 0.0, width: int = WIDTH) -> DataFrame:
    """Each region with `values`, the signal's value at each of its bases, `fill` where there is none.

    A region's own rows are gathered, not its bases; the bases are laid out in
    the array of that region. A region must fit in memory.
    """
    inner = overlap_join(regions.select("id", "chrom", "s", "e"), signal.select("chrom", "s", "e", "v"), width=width)
    parts = inner.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.greatest("s", "r_s").alias("a"), F.least("e", "r_e").alias("b"), F.col("r_v").alias("v")))).alias("_p"))
    joined = regions.join(parts, "id", "left").withColumn("_p", F.coalesce("_p", F.array().cast("array<struct<a:bigint,b:bigint,v:double>>")))

    def lay(p, i):
        """What fills the bases from the row before to this one, and this one's; rows of a signal do not overlap."""
        at = F.when(i == 0, F.col("s")).otherwise(F.element_at("_p", F.greatest(i, F.lit(1)).cast("int")).b)
        return F.concat(F.array_repeat(F.lit(fill), (p.a - at).cast("int")), F.array_repeat(p.v, (p.b - p.a).cast("int")))

    done = F.when(F.size("_p") > 0, F.element_at("_p", -1).b).otherwise(F.col("s"))
    tail = F.array_repeat(F.lit(fill), F.greatest(F.col("e") - done, F.lit(0)).cast("int"))
    return joined.withColumn("values", F.concat(F.flatten(F.transform("_p", lay)), tail)).select(*regions.columns, "values")


def values_text(regions: DataFrame, signal: DataFrame, delimiter: str = ",") -> DataFrame:
    """values_over_bed() with the values joined by a delimiter."""
    return values_over_bed(regions, signal).withColumn("values", F.array_join(F.transform("values", lambda x: x.cast("string")), delimiter))


def track_summary(track: DataFrame, by_chrom: bool = False) -> DataFrame:
    """items, bases, min, max, sum and sum_squares of a signal, or of a feature track's depth.

    Features count as items as they are; all else is over their coverage. An
    empty track has zeros.
    """
    keys = ["chrom"] if by_chrom else []
    depth = "v" not in track.columns
    rows = coverage(track).select("chrom", "s", "e", F.col("depth").cast("double").alias("v")) if depth else track
    n = F.col("e") - F.col("s")
    zero = F.lit(0.0)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("bases"), F.coalesce(F.min("v"), zero).alias("min"), F.coalesce(F.max("v"), zero).alias("max"),
        F.coalesce(F.sum(n * F.col("v")), zero).alias("sum"), F.coalesce(F.sum(n * F.col("v") * F.col("v")), zero).alias("sum_squares"),
    )
    if depth:
        items = track.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"))
        out = out.drop("items")
        out = out.join(items, "chrom") if by_chrom else out.crossJoin(items)
    return out


def track_info(track: DataFrame) -> DataFrame:
    """track_summary() with mean, variance and std over covered bases."""
    s = track_summary(track)
    b = F.col("bases")
    var = F.when(b > 1, (F.col("sum_squares") - F.col("sum") * F.col("sum") / F.when(b > 1, b)) / F.when(b > 1, b - 1)).otherwise(F.lit(0.0))
    return s.withColumns({"mean": _ratio(F.col("sum"), b, F.lit(0.0)), "variance": var}).withColumn("std", F.sqrt("variance"))


def with_commas(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)
