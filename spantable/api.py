"""Tracks as files: open one and ask it, and jobs from files to files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spantable.cluster import stage
from spantable.operators import joins, ranges, raster, stats, sweep
from spantable.sources import autosql, native, text

SIGNAL_NAMES, FEATURE_NAMES = (".bw", ".bigwig"), (".bb", ".bigbed")


class Track:
    """A binary track. Methods that return DataFrames are lazy; values() returns an array of the range asked for.

    path: a path, a URL of a store or of http(s), read by ranges, or an open
    binary file that can seek, which the driver reads.
    """

    def __init__(self, spark: SparkSession, path) -> None:
        if isinstance(path, str) and not path.split("?")[0].lower().endswith(SIGNAL_NAMES + FEATURE_NAMES):
            raise ValueError(f"{path}: the name ends in none of {', '.join(SIGNAL_NAMES + FEATURE_NAMES)}")
        self.spark, self.path, self.file = spark, path, native.NativeFile(path)
        self.is_signal, self.is_features = self.file.kind == "signal", self.file.kind == "features"
        self._kept: DataFrame | None = None

    def rows(self) -> DataFrame:
        return native.read_native(self.spark, self.path) if self._kept is None else self._kept

    def cached(self) -> Track:
        """This track with its rows kept by the executors once they are read; questions asked again then do not open the file."""
        self._kept = self.rows().persist()
        return self

    def release(self) -> None:
        """Give up what cached() keeps."""
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def sizes(self) -> DataFrame:
        return native.native_chroms(self.spark, self.path)

    def chroms(self, chrom: str | None = None) -> dict[str, int] | int:
        """All lengths by name, or one; unknown name: KeyError."""
        return {n: x for n, _, x in self.file.chroms} if chrom is None else self.file.length(chrom)

    def zooms(self) -> list[int]:
        return sorted(self.file.zooms)

    def info(self) -> dict:
        return self.file.info()

    def sql(self, parse: bool = False) -> str | dict:
        """The declared schema, as text or parsed."""
        return autosql.describe(self.file.declaration()) if parse else self.file.declaration()

    def item_count(self) -> int:
        return self.file.items if self.is_features else self.rows().count()

    def records(self, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
        return ranges.records(self.rows(), self.sizes(), chrom, start, end)

    def zoom_records(self, level: int, chrom: str, start: int | None = None, end: int | None = None) -> DataFrame:
        start, end, _ = ranges.resolve(self.sizes(), chrom, start, end)
        z = native.read_native(self.spark, self.path, level)
        return z.filter((F.col("chrom") == chrom) & (F.col("e") >= start) & (F.col("s") <= end))

    def values(self, chrom: str, start: int | None = None, end: int | None = None, bins: int | None = None, summary: str = "mean", exact: bool = False, uncovered: float | None = None, oob: float = float("nan"), fillna: float | None = None, arr=None):
        """One value a base or bin as a numpy array; see operators.raster. arr: a one-dimensional array of the right length to fill and return."""
        zooms = {z: native.read_native(self.spark, self.path, z) for z in self.file.zooms} if bins and not exact else None
        out = raster.to_array(raster.values(self.rows(), self.sizes(), chrom, start, end, bins, summary, exact, uncovered, oob, fillna, zooms))
        if arr is None:
            return out
        if arr.ndim != 1 or len(arr) != len(out):
            raise ValueError(f"arr has shape {arr.shape}, not ({len(out)},)")
        arr[:] = out
        return arr

    def average_over_bed(self, bed: str | DataFrame, names: int | str | bool | None = None, stats_wanted: str | list[str] | None = None) -> DataFrame:
        """name and the wanted statistics of each row of a BED file or DataFrame; names: a column number, True (the fourth), False (chrom:start-end) or "none" (the whole row)."""
        if not self.is_signal:
            raise ValueError("averages are of signal tracks")
        rows = text.read_bed(self.spark, bed) if isinstance(bed, str) else bed
        column = 3 if names is True else "interval" if names in (None, False) else None if names == "none" else names
        rows = rows.withColumns({"name": ranges.row_name(column), "id": F.monotonically_increasing_id()}).select("id", "chrom", "s", "e", "name")
        # rows meet their own statistics by id, which is given once
        out = stats.average_over_bed(stage(validate_regions(rows), "regions"), self.rows(), stats_wanted)
        return out.drop("id", "chrom", "s", "e")


def validate_regions(rows: DataFrame) -> DataFrame:
    """The rows, raising when one that ends before it starts is read."""
    return rows.withColumn("e", F.when(F.col("e") >= F.col("s"), F.col("e")).otherwise(F.raise_error(F.concat(F.lit("region ends before it starts: "), "chrom")).cast("long")))


def open_track(spark: SparkSession, path) -> Track:
    """A Track of a path, URL or open file-like object."""
    return Track(spark, path if hasattr(path, "read") else os.fspath(path))


def write_signal(spark: SparkSession, path: str, chroms: dict[str, int], rows, options: native.WriteOptions | None = None) -> None:
    """Write (chrom, start, end, value) tuples, in any order, as a binary signal track."""
    sizes = spark.createDataFrame(list(chroms.items()), "chrom string, length long")
    native.write_native(text.from_rows(spark, rows), sizes, path, options)


def write_features(spark: SparkSession, path: str, chroms: dict[str, int], rows, declaration: str | None = None, options: native.WriteOptions | None = None) -> None:
    """Write (chrom, start, end, rest) tuples, in any order, as a binary feature track."""
    sizes = spark.createDataFrame(list(chroms.items()), "chrom string, length long")
    native.write_native(text.from_rows(spark, rows, "features"), sizes, path, options, declaration)


def bedgraph_to_binary(spark: SparkSession, source: str, sizes: str, target: str, options: native.WriteOptions | None = None) -> None:
    native.write_native(text.read_bedgraph(spark, source), text.read_sizes(spark, sizes), target, options)


def bed_to_binary(spark: SparkSession, source: str, sizes: str, target: str, declaration: str | None = None, options: native.WriteOptions | None = None) -> None:
    native.write_native(text.read_bed(spark, source), text.read_sizes(spark, sizes), target, options, declaration)


def _part(t: Track, chrom: str | None, start: int | None, end: int | None, regions: str | None) -> DataFrame:
    if regions and (chrom or start is not None or end is not None):
        raise ValueError("either a range or regions")
    if chrom is None and (start is not None or end is not None):
        raise ValueError("start and end need a chromosome")
    rows = t.rows()
    if regions:
        bed = text.read_bed(t.spark, regions)
        unknown = ranges.drop_known(bed, t.sizes()).limit(1).collect()
        if unknown:
            raise KeyError(f"no chromosome named {unknown[0]['chrom']}")
        return joins.clipped(bed, rows)
    if chrom is None:
        return rows
    start, end, _ = ranges.resolve(t.sizes(), chrom, start, end)
    return ranges.scan_signal(rows, chrom, start, end) if t.is_signal else ranges.scan_features(rows, chrom, start, end)


def binary_to_bedgraph(spark: SparkSession, source: str, target: str, chrom: str | None = None, start: int | None = None, end: int | None = None, regions: str | None = None) -> None:
    """Text files of a signal track, of one range, or of what lies in the regions of a BED file."""
    text.write_bedgraph(_part(Track(spark, source), chrom, start, end, regions), target)


def binary_to_bed(spark: SparkSession, source: str, target: str, chrom: str | None = None, start: int | None = None, end: int | None = None, regions: str | None = None, zoom: int | None = None) -> None:
    """Text files of a feature track, likewise, or of a zoom level."""
    if zoom is not None:
        text.zoom_lines(native.read_native(spark, source, zoom)).write.mode("overwrite").text(target)
        return
    text.write_bed(_part(Track(spark, source), chrom, start, end, regions), target)


def average_to_text(spark: SparkSession, source: str, bed: str, target: str, names: int | str | bool | None = True, min_max: bool = False) -> None:
    """Tab-separated name, size, bases, sum, mean0, mean and, if wanted, min and max of each BED row."""
    wanted = ["size", "bases", "sum", "mean0", "mean"] + (["min", "max"] if min_max else [])
    out = Track(spark, source).average_over_bed(bed, names, wanted)
    out.select(F.concat_ws("\t", "name", *[F.col(c).cast("string") for c in wanted])).write.mode("overwrite").text(target)


def values_to_text(spark: SparkSession, source: str, bed: str, target: str, delimiter: str = "\t") -> None:
    """Name and the value of each base of each BED row."""
    # the first lines of the file decide whether the fourth column names its rows
    first = [r["value"].rstrip().split("\t") for r in spark.read.text(bed).head(10)]
    names = [x[3] if len(x) > 3 else None for x in first]
    column: int | str = 3 if None not in names and len(set(names)) == len(names) else "interval"
    rows = stage(text.read_bed(spark, bed).withColumns({"name": ranges.row_name(column), "id": F.monotonically_increasing_id()}), "regions")
    out = stats.values_text(rows, Track(spark, source).rows(), delimiter)
    out.select(F.concat_ws(delimiter, "name", "values")).write.mode("overwrite").text(target)


def merge_files(spark: SparkSession, sources: list[str], target: str, how: str = "sum", clip: float | None = None, adjust: float = 0.0, threshold: float | None = 0.0) -> None:
    """Merge binary signal tracks into one: binary if the target's name says so, else text. Lengths of chromosomes must agree."""
    opened = [Track(spark, p) for p in sources]
    sizes = ranges.same_sizes(*[t.sizes() for t in opened])
    out = sweep.merge(*[t.rows() for t in opened], how=how, clip=clip, adjust=adjust, threshold=threshold)
    if target.lower().endswith(SIGNAL_NAMES):
        native.write_native(out, sizes, target)
    else:
        text.write_bedgraph(out, target)


def intersect_files(spark: SparkSession, a: str, b: str, target: str) -> None:
    """For each row of BED file a the rows of binary feature track b that overlap or touch it."""
    text.write_bed(joins.intersect(text.read_bed(spark, a), Track(spark, b).rows()), target)


def chrom_intersect_files(spark: SparkSession, a: str, b: str, target: str) -> None:
    """Rows of BED file a on chromosomes of binary track b."""
    text.write_bed(ranges.keep_known(text.read_bed(spark, a), Track(spark, b).sizes()).select("chrom", "s", "e", "rest"), target)


def info_text(track: Track, chroms: bool = False, zooms: bool = False) -> str:
    """A description for people."""
    i = track.info()
    s = i["summary"]
    lines = [f"version: {i['version']}", f"isCompressed: {'yes' if i['compressed'] else 'no'}", f"zoomLevels: {len(i['zoom_levels'])}", f"chromCount: {i['chroms']}"]
    if track.is_features:
        lines.append(f"itemCount: {track.item_count():,}")
    if zooms:
        lines += [f"\t{z}" for z in i["zoom_levels"]]
    if chroms:
        lines += [f"\t{n} {k} {x}" for n, k, x in track.file.chroms]
    lines += [f"basesCovered: {s['bases']:,}", f"mean: {s['mean']:.6f}", f"min: {s['min']:.6f}", f"max: {s['max']:.6f}", f"std: {s['std']:.6f}"]
    return "\n".join(lines)
