"""Sweeps along chromosomes: coverage depth and merged tracks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases that one window partition of a sweep holds.
STRIDE = 1 << 16
#: Tracks that one merge step has columns for.
TRACKS = 8


def sweep(events: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Running sums of events(chrom, pos, d, n), whole numbers: rows chrom, s, e, v and k, the sums of d and n from s to e.

    A prefix sum in two levels. Events are netted by position; the sums of
    strides of the axis are summed along each chromosome, a few thousand rows
    each; within a stride a window adds what came before. No task holds a
    chromosome.
    """
    net = events.groupBy("chrom", "pos").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).filter("d <> 0 or n <> 0")
    net = net.withColumn("_b", F.floor(F.col("pos") / stride).cast("long"))
    along = Window.partitionBy("chrom").orderBy("_b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sums = net.groupBy("chrom", "_b").agg(F.sum("d").alias("d"), F.sum("n").alias("n"), F.min("pos").alias("first"))
    strides = sums.select(
        "chrom", "_b", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("_d"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"), F.lead("first").over(along).alias("_next")
    )
    inside = Window.partitionBy("chrom", "_b").orderBy("pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return net.join(strides, ["chrom", "_b"]).select(
        "chrom", F.col("pos").alias("s"), F.coalesce(F.lead("pos").over(inside), "_next").alias("e"), (F.sum("d").over(upto) + F.col("_d")).alias("v"), (F.sum("n").over(upto) + F.col("_n")).alias("k")
    )


def _events(track: DataFrame, value=None) -> DataFrame:
    """Each row's start, which adds value (0) and a row, and its end, which takes both away; value must be whole, for sums to cancel."""
    value = F.lit(0) if value is None else value
    rows = track.filter("s < e")
    ends = F.array(F.struct(F.col("s").alias("pos"), value.alias("d"), F.lit(1).alias("n")), F.struct(F.col("e").alias("pos"), (-value).alias("d"), F.lit(-1).alias("n")))
    return rows.select("chrom", F.explode(ends).alias("x")).select("chrom", "x.pos", "x.d", "x.n")


def coverage(features: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Maximal runs of equal depth above 0: chrom, s, e, depth. Rows with s >= e count for nothing."""
    out = sweep(_events(features, F.lit(1)), stride)
    return out.filter("v > 0").select("chrom", "s", "e", F.col("v").cast("long").alias("depth"))


def _runs(tracks: list[DataFrame], how: str, value: Callable[[Column], Column], stride: int) -> DataFrame:
    """Maximal runs (chrom, s, e, v) of value(x) where it is not null; x is the sum or max, in the order of tracks, of those that have data there.

    At a cut each track has the value that its last event left, found by a
    window within a stride and, for its begin, by one along the strides. So a
    value counts exactly where its row lies, whatever stands elsewhere. Only
    cuts where the value changes are kept, NaN being equal to NaN; a run ends at
    the next of them. All windows look back or one row ahead, so work grows with
    the rows of a stride, not with their square; events move once, to their
    strides.
    """
    rows = reduce(DataFrame.union, [t.filter("s < e and v is not null").select("chrom", "s", "e", F.col("v").cast("double").alias("v"), F.lit(i).alias("t")) for i, t in enumerate(tracks)])
    ends = F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("on"), "v"), F.struct(F.col("e").alias("pos"), F.lit(0).alias("on"), F.lit(None).cast("double").alias("v")))
    events = rows.select("chrom", "t", F.explode(ends).alias("c")).select("chrom", F.floor(F.col("c.pos") / stride).cast("long").alias("_b"), "t", "c.pos", "c.on", "c.v")
    # where a row ends and the next one of its track begins, the begin counts
    state = [f"{x}{i}" for i in range(len(tracks)) for x in ("on", "v")]
    of = [F.max(F.when(F.col("t") == i, F.col(x))).alias(f"{x}{i}") for i in range(len(tracks)) for x in ("on", "v")]
    cuts = events.repartition("chrom", "_b").groupBy("chrom", "_b", "pos").agg(*of)
    along, inside = Window.partitionBy("chrom").orderBy("_b"), Window.partitionBy("chrom", "_b").orderBy("pos")
    strides = cuts.groupBy("chrom", "_b").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("pos"))).alias(n) for n in state])
    strides = strides.select("chrom", "_b", *[F.last(n, True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{n}") for n in state])

    def now(names: dict[str, Column]) -> Column:
        xs = [F.when(names[f"on{i}"] == 1, names[f"v{i}"]) for i in range(len(tracks))]
        if len(xs) == 1:
            return value(xs[0])
        x = F.greatest(*xs) if how == "max" else reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs])
        return value(F.when(F.coalesce(*xs).isNotNull(), x))

    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = cuts.select("chrom", "_b", "pos", *[F.last(n, True).over(upto).alias(n) for n in state]).join(strides, ["chrom", "_b"])
    pieces = left.select("chrom", "_b", "pos", now({n: F.coalesce(n, f"_{n}") for n in state}).alias("v"), now({n: F.col(f"_{n}") for n in state}).alias("_v"))
    before = F.when(F.lag(F.lit(1)).over(inside).isNull(), F.col("_v")).otherwise(F.lag("v").over(inside))
    changes = pieces.select("chrom", "_b", "pos", "v", before.alias("_v")).filter(~F.col("v").eqNullSafe(F.col("_v"))).drop("_v")
    firsts = changes.groupBy("chrom", "_b").agg(F.min("pos").alias("first")).select("chrom", "_b", F.lead("first").over(along).alias("_next"))
    runs = changes.select("chrom", "_b", F.col("pos").alias("s"), F.lead("pos").over(inside).alias("e"), "v").join(firsts, ["chrom", "_b"])
    return runs.filter("v is not null").select("chrom", "s", F.coalesce("e", "_next").alias("e"), "v")


def merge(*tracks: DataFrame, how: str = "sum", clip: float | None = None, adjust: float = 0.0, threshold: float | None = 0.0, stride: int = STRIDE) -> DataFrame:
    """One signal from several: where any has data, the sum (or max) of those that have.

    Then clip (values above it become it), adjust (added) and threshold (kept
    if above it), each once. Sums of 0 are dropped before that. Runs are
    maximal. Rows of one track must not overlap; where they do, one of them
    counts. Infinite and NaN values count where their rows lie: a sum with NaN
    is NaN, NaN is the greatest value and stays above any threshold. Null
    values count as no data. More than TRACKS tracks are combined in groups.
    """
    if how not in ("sum", "max"):
        raise ValueError("how is sum or max")
    left = [t.select("chrom", "s", "e", "v") for t in tracks]
    while len(left) > TRACKS:
        left = [_runs(left[i : i + TRACKS], how, lambda v: v, stride) for i in range(0, len(left), TRACKS)]

    def kept(v: Column) -> Column:
        out = (F.least(v, F.lit(float(clip))) if clip is not None else v) + F.lit(float(adjust))
        return F.when((v != 0) & (F.lit(True) if threshold is None else out > threshold), out)

    # where one track ends as another of the same value begins, the sum goes on
    return _runs(left, how, kept, stride)


def fill_gaps(track: DataFrame, start: int = 0, end: int | None = None, stride: int = STRIDE) -> DataFrame:
    """The track with rows of value 0 where it has none, from start on and, if end is given, up to it.

    Without end nothing follows the last row of a chromosome. Chromosomes of
    the track only; rows must not overlap. Inner gaps are the pieces of a
    sweep that no row covers, so no task holds a chromosome.
    """
    rows = track.select("chrom", "s", "e", "v").filter("s < e")
    inner = sweep(_events(rows), stride).filter("k = 0 and e is not null").select("chrom", "s", "e")
    ends = rows.groupBy("chrom").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    outer = ends.select("chrom", F.lit(start).cast("long").alias("s"), F.col("lo").alias("e"))
    if end is not None:
        outer = outer.union(ends.select("chrom", F.greatest("hi", F.lit(start).cast("long")), F.lit(end).cast("long")))
    return rows.union(inner.union(outer).filter("s < e").withColumn("v", F.lit(0.0)))
