"""Zoom levels: summaries of a track at several resolutions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantable.cluster import ship
from spantable.operators.sweep import STRIDE, coverage

RECORD_BYTES = 32


def _signal(track: DataFrame) -> DataFrame:
    return track if "v" in track.columns else coverage(track).withColumnRenamed("depth", "v")


def zoom_grid(track: DataFrame, size: int) -> DataFrame:
    """Summaries of windows [k * size, (k + 1) * size) that have data. Depth, for feature tracks."""
    rows = _signal(track).filter("s < e")
    rows = rows.withColumn("_k", F.explode(F.sequence(F.floor(F.col("s") / size).cast("long"), F.floor((F.col("e") - 1) / size).cast("long"))))
    o = F.least("e", (F.col("_k") + 1) * size) - F.greatest("s", F.col("_k") * size)
    v = F.col("v")
    out = rows.groupBy("chrom", "_k").agg(
        F.count(F.lit(1)).alias("items"), F.sum(o).alias("bases"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(o * v).alias("sum"), F.sum(o * v * v).alias("sum_squares")
    )
    return out.select("chrom", (F.col("_k") * size).alias("s"), ((F.col("_k") + 1) * size).alias("e"), "items", "bases", "min", "max", "sum", "sum_squares")


def _running_max(df: DataFrame, value, name: str, stride: int) -> DataFrame:
    """df(chrom, s, _b, ...) with the greatest value at s or before on its chromosome; null values count for nothing.

    In two levels, within strides of the axis and along them.
    """
    inside, along = Window.partitionBy("chrom", "_b").orderBy("s"), Window.partitionBy("chrom").orderBy("_b")
    df = df.withColumn("_v", value)
    carried = df.groupBy("chrom", "_b").agg(F.max("_v").alias("_v")).select("chrom", "_b", F.max("_v").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    own = F.max("_v").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.join(carried, ["chrom", "_b"]).withColumn(name, F.greatest(own, "_carried")).drop("_v", "_carried")


def _gap(df: DataFrame, stride: int) -> DataFrame:
    """df(chrom, s, e, ...) with _b, the stride of s, and _gap, bases between a row and the one before it; null for the first."""
    df = df.withColumn("_b", F.floor(F.col("s") / stride).cast("long")).repartition("chrom", "_b")  # once for all that reads it
    inside, along = Window.partitionBy("chrom", "_b").orderBy("s"), Window.partitionBy("chrom").orderBy("_b")
    before = df.groupBy("chrom", "_b").agg(F.max("e").alias("_last")).select("chrom", "_b", F.lag("_last").over(along).alias("_last"))
    return df.join(before, ["chrom", "_b"]).withColumn("_gap", F.col("s") - F.coalesce(F.lag("e").over(inside), "_last")).drop("_last")


def passage(s: np.ndarray, e: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What a part of a chromosome, runs [s, e) in order, makes of where a record opens.

    After a run that ends at e, the open record ends at the one base of
    [e, e + size) that has its remainder by size. A gap changes the remainder
    only if that base lies in it, or at its end: then the next record opens with
    the next run. So a gap takes an arc of remainders to one. Returns remainders
    at which arcs begin, ascending, the last arc reaching round to the first,
    and what each becomes; -1 where it stays as it is. Arcs are no more than
    size, and what is taken to one stays one.
    """
    a, b = e[:-1], s[1:]
    a, b = a[b > a], b[b > a]
    starts = np.unique(np.concatenate([a % size, (b + 1) % size])) if len(a) else np.zeros(1, np.int64)
    parent = list(range(len(starts)))
    # what remainders have become so far, ascending, and an arc that stands for those that have become it
    now, arc, moved = starts.tolist(), list(parent), [False] * len(parent)
    for gap, lo, hi in zip((b - a).tolist(), (a % size).tolist(), (b % size).tolist()):
        if gap >= size - 1:
            taken, now, arc, at = arc, [], [], 0
        elif lo <= hi:
            at, to = bisect_left(now, lo), bisect_right(now, hi)
            taken = arc[at:to]
            del now[at:to], arc[at:to]
        else:
            at, to = bisect_left(now, lo), bisect_right(now, hi)
            taken = arc[:to] + arc[at:]
            now, arc, at = now[to:at], arc[to:at], 0
        if taken:
            for x in taken:
                parent[x] = taken[0]
            moved[taken[0]] = True
            now.insert(at, hi)
            arc.insert(at, taken[0])
    become = np.full(len(parent), -1, np.int64)
    become[arc] = np.where([moved[x] for x in arc], now, -1)
    roots = np.array(parent)
    while (roots[roots] != roots).any():
        roots = roots[roots]
    out = become[roots]
    keep = out != np.roll(out, 1)
    keep[0] |= not keep.any()
    return starts[keep], out[keep]


def zoom_anchored(track: DataFrame, size: int, stride: int = STRIDE) -> DataFrame:
    """Summaries of windows that begin where data begin: a record opens at the first base not yet summarised and ends `size` bases on, or with the data.

    Where records open depends on where those before them did, but only runs of
    touching rows matter for that: within a run records follow one another at
    steps of `size`. So rows are told their run by windows over strides of the
    axis; the ends of runs alone, two numbers each, are walked in order, stride
    by stride: first what each stride makes of any record that is open before
    it, then along the strides, one row each, which record that is, then the
    runs of each stride. Rows are cut into their records by arithmetic and
    summed. No task holds more runs than a stride's. Rows must not overlap.
    """
    ship(track.sparkSession)
    rows = _gap(_signal(track).filter("s < e").select("chrom", "s", "e", "v"), stride)
    rows = _running_max(rows, F.when(F.coalesce(F.col("_gap"), F.lit(1)) > 0, F.col("s")), "run", stride).select("chrom", "s", "e", "v", "run")
    runs = rows.groupBy("chrom", F.col("run").alias("s")).agg(F.max("e").alias("e")).withColumn("_b", F.floor(F.col("s") / stride).cast("long")).repartition("chrom", "_b")

    def through(t: pa.Table) -> pa.Table:
        """A stride's first begin and last end, and what it makes of an open record."""
        t = t.sort_by("s")
        s, e = (t[c].to_numpy() for c in ("s", "e"))
        starts, become = passage(s, e, size)
        return pa.table({"chrom": t["chrom"][:1], "_b": t["_b"][:1], "first": s[:1], "last": e[-1:], "starts": pa.array([starts], pa.list_(pa.int64())), "become": pa.array([become], pa.list_(pa.int64()))})

    def along(t: pa.Table) -> pa.Table:
        """For each stride, where the record ends that the strides before it leave; null for the first of a chromosome."""
        t = t.sort_by("_b")
        last, remainder, ends = None, 0, []
        for i, (first, end) in enumerate(zip(t["first"].to_pylist(), t["last"].to_pylist())):
            ends.append(None if last is None else last + (remainder - last) % size)
            if last is None or ends[-1] <= first:
                remainder = first % size
            starts, become = (t[c][i].values.to_numpy() for c in ("starts", "become"))
            to = int(become[np.searchsorted(starts, remainder, side="right") - 1])
            last, remainder = end, remainder if to < 0 else to
        return pa.Table.from_arrays([t["chrom"], t["_b"], pa.array(ends, pa.int64())], names=["chrom", "_b", "end"])

    def walk(t: pa.Table) -> pa.Table:
        """For each run: the record that is open where it begins, or its begin, and where in it the first record opens."""
        t = t.sort_by("s")
        end, opens, before = t["end"][0].as_py(), [], []
        for s, e in zip(t["s"].to_pylist(), t["e"].to_pylist()):
            before.append(s if end is None or end <= s else end - size)
            opens.append(s if end is None else max(s, end))
            if opens[-1] < e:
                end = opens[-1] + -(-(e - opens[-1]) // size) * size
        return pa.Table.from_arrays([t["chrom"], t["s"], pa.array(before, pa.int64()), pa.array(opens, pa.int64())], names=["chrom", "run", "before", "opens"])

    strides = runs.groupBy("chrom", "_b").applyInArrow(through, "chrom string, _b long, first long, last long, starts array<long>, become array<long>")
    open_ = strides.groupBy("chrom").applyInArrow(along, "chrom string, _b long, end long")
    state = runs.join(open_, ["chrom", "_b"]).groupBy("chrom", "_b").applyInArrow(walk, "chrom string, run long, before long, opens long")
    met = rows.join(state, ["chrom", "run"])
    # the piece that belongs to the record open before, then one piece for each record
    first = F.greatest("s", "opens")
    k = F.when(first < F.col("e"), F.sequence(F.floor((first - F.col("opens")) / size).cast("long"), F.floor((F.col("e") - 1 - F.col("opens")) / size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    head = F.when(F.col("s") < F.col("opens"), F.array("before")).otherwise(F.array().cast("array<bigint>"))
    pieces = met.withColumn("record", F.explode(F.concat(head, F.transform(k, lambda x: F.col("opens") + x * size))))
    end = F.least("e", F.col("record") + size)
    o, v = end - F.greatest("s", "record"), F.col("v").cast("double")
    out = pieces.groupBy("chrom", "record").agg(
        F.max(end).alias("e"), F.count(F.lit(1)).alias("items"), F.sum(o).alias("bases"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(o * v).alias("sum"), F.sum(o * v * v).alias("sum_squares")
    )
    return out.select("chrom", F.col("record").alias("s"), "e", "items", "bases", "min", "max", "sum", "sum_squares")


def zoom_records(zooms: dict[int, DataFrame], level: int, chrom: str, start: int, end: int) -> DataFrame:
    """Records of a level that overlap or touch the range, not clipped. Unknown level: KeyError."""
    if level not in zooms:
        raise KeyError(f"no zoom level {level}")
    return zooms[level].filter((F.col("chrom") == chrom) & (F.col("e") >= start) & (F.col("s") <= end))


def best_zoom(levels: list[int], start: int, end: int, bins: int) -> int | None:
    """The largest level not above half a bin's width, None if there is none."""
    most = int(np.float32(end - start) / np.float32(2 * bins))
    return max((x for x in levels if x <= most), default=None)


def level_counts(track: DataFrame, levels: list[int]) -> DataFrame:
    """level and records: how many windows of each level's grid have data, in one pass over the track."""
    rows = _signal(track).filter("s < e").withColumn("level", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in levels])))
    k = F.explode(F.sequence(F.floor(F.col("s") / F.col("level")).cast("long"), F.floor((F.col("e") - 1) / F.col("level")).cast("long")))
    return rows.select("level", "chrom", k.alias("k")).distinct().groupBy("level").agg(F.count(F.lit(1)).alias("records"))


def candidate_levels(longest: int, initial: int = 160, max_zooms: int = 10, manual: list[int] | None = None) -> list[int]:
    """initial * 4^k, at most max_zooms of them and none above the longest chromosome; or the manual ones."""
    if manual is not None:
        return sorted(set(manual))
    return [initial * 4**k for k in range(max_zooms) if initial * 4**k <= longest]


def choose_levels(counts: dict[int, int], data_bytes: int, max_zooms: int = 10) -> list[int]:
    """Of levels with these numbers of records: those small enough to help.

    Levels whose records take more than half of the data are passed over (at
    half their raw size, for compression); then each level must have fewer
    records than the one before.
    """
    out: list[int] = []
    for level in sorted(counts):
        if counts[level] * RECORD_BYTES / 2 > data_bytes / 2:
            continue
        if out and counts[level] >= counts[out[-1]]:
            break
        out.append(level)
    return out[:max_zooms]


def choose_single_pass(sections: dict[int, tuple[int, int]], data_bytes: int) -> list[int]:
    """Of levels with these bytes and numbers of sections as written, in one pass with the data: those that help.

    A level that takes more than half of the data's bytes, or does not have
    fewer sections than the last one kept, is dropped.
    """
    out: list[int] = []
    for level in sorted(sections):
        size, n = sections[level]
        if size <= data_bytes / 2 and (not out or n < sections[out[-1]][1]):
            out.append(level)
    return out


def build_zooms(track: DataFrame, sizes: DataFrame, manual: list[int] | None = None, data_bytes: int | None = None, initial: int = 10, max_zooms: int = 10) -> dict[int, DataFrame]:
    """Zoom tables by level, chosen by exact record counts; data_bytes counts 12 bytes a row by default."""
    longest = sizes.agg(F.max("length")).first()[0] or 0
    levels = candidate_levels(longest, initial, max_zooms, manual)
    if manual is None and levels:
        counts = {r["level"]: r["records"] for r in level_counts(track, levels).collect()}
        levels = choose_levels(counts, track.count() * 12 if data_bytes is None else data_bytes, max_zooms)
    return {x: zoom_grid(track, x) for x in levels}


