"""Indexed binary tracks, bigWig and bigBed: a data source that reads them, and a writer.

A file holds compressed sections of rows in the order of (chromosome number,
start), an R-tree over their ranges, a B+ tree of chromosome names, and zoom
levels built the same way. Reading plans partitions from the R-tree, so
filters on chrom, s and e skip sections. Writing encodes sections in parallel
and then streams them into one file in a single forward pass.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from spantable.cluster import scratch, ship, stage
from spantable.operators import validate
from spantable.operators.stats import track_summary
from spantable.operators.sweep import coverage
from spantable.operators.zoom import build_zooms, candidate_levels, choose_single_pass, zoom_anchored
from spantable.sources import autosql
from spantable.sources.storage import open_file

# Fixed values of the format.
SIGNAL_MAGIC, FEATURE_MAGIC, NAMES_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0
HEADER, ZOOM_HEADER, SUMMARY = "IHHQQQHHQQIQ", "IIQQ", "Q4d"
NAMES_HEADER, INDEX_HEADER, NODE = "IIIIQQ", "IIQIIIIQII", "BBH"
SECTION = "IIIIIBBH"
PLACE = [("chrom", T.StringType()), ("s", T.LongType()), ("e", T.LongType())]
ZOOM_FIELDS = [*((c, T.LongType()) for c in ("items", "bases")), *((c, T.DoubleType()) for c in ("min", "max", "sum", "sum_squares"))]
BLOCKS_PER_PARTITION = 512


class NativeError(ValueError):
    """The file is no bigWig or bigBed, or is damaged."""


class NativeFile:
    """Header, names and indexes of one file; every method opens the file anew, so it can be sent to tasks."""

    def __init__(self, path) -> None:
        """path: a path, a URL, or an open binary file that can seek; the last is only read on this side."""
        self.path = path
        with open_file(path) as f:
            raw = f.read_at(64, 0)
            if len(raw) < 64:
                raise NativeError(f"{path}: too short")
            for order in "<>":
                magic = struct.unpack(order + "I", raw[:4])[0]
                if magic in (SIGNAL_MAGIC, FEATURE_MAGIC):
                    break
            else:
                raise NativeError(f"{path}: neither bigWig nor bigBed")
            self.order, self.kind = order, "signal" if magic == SIGNAL_MAGIC else "features"
            (_, self.version, levels, self.names_at, self.data_at, self.index_at, self.fields, self.defined, self.sql_at, self.summary_at, self.buffer, _) = struct.unpack(order + HEADER, raw)
            heads = [struct.unpack_from(order + ZOOM_HEADER, f.read_at(24 * levels, 64), 24 * i) for i in range(levels)]
            self.zooms = {h[0]: h[3] for h in heads}
            self.chroms = self._names(f)
            self.items = struct.unpack(order + "Q", f.read_at(8, self.data_at))[0] if self.kind == "features" else None

    def _names(self, f) -> list[tuple[str, int, int]]:
        """(name, number, length) in the order of the file."""
        magic, _, key, _, _, _ = struct.unpack(self.order + NAMES_HEADER, f.read_at(32, self.names_at))
        if magic != NAMES_MAGIC:
            raise NativeError(f"{self.path}: no chromosome names")
        out, todo = [], [self.names_at + 32]
        while todo:
            at = todo.pop()
            leaf, _, n = struct.unpack(self.order + NODE, f.read_at(4, at))
            raw = f.read_at(n * (key + 8), at + 4)
            for i in range(n):
                name, rest = raw[i * (key + 8) : i * (key + 8) + key], raw[i * (key + 8) + key : (i + 1) * (key + 8)]
                if leaf:
                    out.append((name.rstrip(b"\0").decode(), *struct.unpack(self.order + "II", rest)))
                else:
                    todo.append(struct.unpack(self.order + "Q", rest)[0])
        return sorted(out, key=lambda x: x[1])

    def length(self, chrom: str) -> int:
        for name, _, n in self.chroms:
            if name == chrom:
                return n
        raise KeyError(f"no chromosome named {chrom}")

    def declaration(self) -> str:
        """The declared schema; of a signal the one that all signals have."""
        if self.kind == "signal":
            # fixed value of the format: the declaration that every signal track has
            return 'table bedGraph\n"bedGraph file"\n(\n    string chrom;      "Reference sequence chromosome or scaffold"\n    uint   chromStart; "Start position in chromosome"\n    uint   chromEnd;   "End position in chromosome"\n    float  value;      "Value for a given interval"\n)\n'
        if not self.sql_at:
            return ""
        with open_file(self.path) as f:
            out = b""
            while b"\0" not in out:
                more = f.read_at(1024, self.sql_at + len(out))
                if not more:
                    break
                out += more
        return out.split(b"\0")[0].decode()

    def summary(self) -> dict:
        """bases, min, max, sum and sum_squares as the file states them; zeros where it does not."""
        names = ("bases", "min", "max", "sum", "sum_squares")
        if not self.summary_at:
            return dict.fromkeys(names, 0)
        with open_file(self.path) as f:
            return dict(zip(names, struct.unpack(self.order + SUMMARY, f.read_at(40, self.summary_at))))

    def info(self) -> dict:
        """summary() with mean, std and what the header says."""
        s = self.summary()
        b = s["bases"]
        var = (s["sum_squares"] - s["sum"] ** 2 / b) / (b - 1) if b > 1 else 0.0
        return {"version": self.version, "kind": self.kind, "chroms": len(self.chroms), "zoom_levels": sorted(self.zooms), "field_count": self.fields, "compressed": self.buffer > 0, "summary": s | {"mean": s["sum"] / b if b else 0.0, "std": max(var, 0.0) ** 0.5}}

    def blocks(self, zoom: int | None = None, hits=lambda lo, hi: True) -> list[tuple[int, int]]:
        """(offset, size) of the sections whose range, from (chrom, base) lo to hi, hits; in the order of the file."""
        if zoom is not None and zoom not in self.zooms:
            raise KeyError(f"no zoom level {zoom}")
        at = self.index_at if zoom is None else self.zooms[zoom]
        out = []
        with open_file(self.path) as f:
            if struct.unpack(self.order + "I", f.read_at(4, at))[0] != INDEX_MAGIC:
                raise NativeError(f"{self.path}: no index")
            todo = [at + 48]
            while todo:
                node = todo.pop()
                leaf, _, n = struct.unpack(self.order + NODE, f.read_at(4, node))
                form = self.order + ("IIIIQQ" if leaf else "IIIIQ")
                for a, b, c, d, *where in struct.iter_unpack(form, f.read_at(n * struct.calcsize(form), node + 4)):
                    if hits((a, b), (c, d)):
                        out.append(tuple(where)) if leaf else todo.append(where[0])
        return sorted(out)

    def read(self, blocks: list[tuple[int, int]], zoom: bool = False) -> Iterator[pa.RecordBatch]:
        """The rows of these sections, one batch each."""
        names = np.array([c[0] for c in self.chroms], object)
        number = {c[1]: i for i, c in enumerate(self.chroms)}
        with open_file(self.path) as f:
            for at, size in blocks:
                raw = f.read_at(size, at)
                if self.buffer:
                    try:
                        raw = zlib.decompress(raw)
                    except zlib.error as e:
                        raise NativeError(f"{self.path}: damaged section at {at}") from e
                yield self._zoom(raw, names, number) if zoom else self._signal(raw, names, number) if self.kind == "signal" else self._features(raw, names, number)

    def _batch(self, names, index, cols: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chrom": pa.array(names[index], pa.string())} | cols)

    def _signal(self, raw: bytes, names, number) -> pa.RecordBatch:
        o = self.order
        chrom, start, _, step, span, kind, _, n = struct.unpack_from(o + SECTION, raw)
        if kind == 1:
            x = np.frombuffer(raw, np.dtype([("s", o + "u4"), ("e", o + "u4"), ("v", o + "f4")]), n, 24)
            s, e, v = x["s"], x["e"], x["v"]
        elif kind == 2:
            x = np.frombuffer(raw, np.dtype([("s", o + "u4"), ("v", o + "f4")]), n, 24)
            s, v = x["s"], x["v"]
            e = s.astype(np.int64) + span
        elif kind == 3:
            v = np.frombuffer(raw, o + "f4", n, 24)
            s = start + step * np.arange(n, dtype=np.int64)
            e = s + span
        else:
            raise NativeError(f"{self.path}: section of kind {kind}")
        index = np.full(n, number[chrom])
        return self._batch(names, index, {"s": pa.array(s.astype(np.int64)), "e": pa.array(e.astype(np.int64)), "v": pa.array(v.astype(np.float64))})

    def _features(self, raw: bytes, names, number) -> pa.RecordBatch:
        at, index, s, e, rest = 0, [], [], [], []
        while at + 12 < len(raw):
            c, a, b = struct.unpack_from(self.order + "III", raw, at)
            if c == a == b == 0 and raw[at + 12 : at + 13] == b"\0" and not any(raw[at:]):
                raise NativeError(f"{self.path}: empty row")
            stop = raw.index(b"\0", at + 12)
            index.append(number[c])
            s.append(a)
            e.append(b)
            rest.append(raw[at + 12 : stop].decode())
            at = stop + 1
        return self._batch(names, np.array(index, int), {"s": pa.array(s, pa.int64()), "e": pa.array(e, pa.int64()), "rest": pa.array(rest, pa.string())})

    def _zoom(self, raw: bytes, names, number) -> pa.RecordBatch:
        o = self.order
        x = np.frombuffer(raw, np.dtype([(c, o + k) for c, k in (("c", "u4"), ("s", "u4"), ("e", "u4"), ("bases", "u4"), ("min", "f4"), ("max", "f4"), ("sum", "f4"), ("sum_squares", "f4"))]))
        cols = {c: pa.array(x[c].astype(np.int64)) for c in ("s", "e")} | {"items": pa.array(np.zeros(len(x), np.int64)), "bases": pa.array(x["bases"].astype(np.int64))}
        cols |= {c: pa.array(x[c].astype(np.float64)) for c in ("min", "max", "sum", "sum_squares")}
        return self._batch(names, np.array([number[c] for c in x["c"].tolist()], int), cols)


class _Reader(DataSourceReader):
    def __init__(self, path: str, zoom: int | None, per: int) -> None:
        self.path, self.zoom, self.per = path, zoom, per
        self.file = NativeFile(path)
        self.chrom: str | None = None
        self.low, self.high = -1, 1 << 62  # rows end at low or later, start at high or earlier

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters prune sections; Spark still applies each to the rows."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("chrom",):
                self.chrom = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("e",):
                self.low = max(self.low, f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("s",):
                self.high = min(self.high, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        of = {c[0]: c[1] for c in self.file.chroms}
        if self.chrom is not None and self.chrom not in of:
            return [InputPartition([])]

        def hits(lo: tuple[int, int], hi: tuple[int, int]) -> bool:
            if self.chrom is None:
                return True
            n = of[self.chrom]
            return lo <= (n, self.high) and hi >= (n, self.low)

        blocks = self.file.blocks(self.zoom, hits)
        return [InputPartition(blocks[i : i + self.per]) for i in range(0, len(blocks), self.per)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.file.read(partition.value, self.zoom is not None)


class NativeTrack(DataSource):
    """spark.read.format("native_track").load(path): a signal or feature track, or with option zoom the records of a level."""

    @classmethod
    def name(cls) -> str:
        return "native_track"

    def schema(self) -> T.StructType:
        if "zoom" in self.options:
            more = ZOOM_FIELDS
        else:
            more = [("v", T.DoubleType())] if NativeFile(self.options["path"]).kind == "signal" else [("rest", T.StringType())]
        return T.StructType([T.StructField(*x) for x in [*PLACE, *more]])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options["zoom"]) if "zoom" in self.options else None, int(self.options.get("blocksperpartition", BLOCKS_PER_PARTITION)))


def read_native(spark: SparkSession, path, zoom: int | None = None) -> DataFrame:
    """A file's rows, or the records of one of its zoom levels (unknown level: KeyError).

    Of an open file-like object the driver reads the rows and hands them to Spark.
    """
    ship(spark)
    if not isinstance(path, str):
        file = NativeFile(path)
        if zoom is not None and zoom not in file.zooms:
            raise KeyError(f"no zoom level {zoom}")
        more = ZOOM_FIELDS if zoom is not None else [("v", T.DoubleType())] if file.kind == "signal" else [("rest", T.StringType())]
        schema = T.StructType([T.StructField(*x) for x in [*PLACE, *more]])
        return spark.createDataFrame(pa.Table.from_batches(file.read(file.blocks(zoom), zoom is not None), to_arrow_schema(schema)), schema)
    spark.dataSource.register(NativeTrack)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    file = NativeFile(path)
    if zoom is not None and zoom not in file.zooms:
        raise KeyError(f"no zoom level {zoom}")
    r = spark.read.format("native_track")
    return (r if zoom is None else r.option("zoom", zoom)).load(path)


def native_chroms(spark: SparkSession, path) -> DataFrame:
    """chrom and length of a file's chromosomes."""
    return spark.createDataFrame([(n, x) for n, _, x in NativeFile(path).chroms], "chrom string, length long")


@dataclass
class WriteOptions:
    """How a file is written.

    zooms: these levels and no choice. Else levels are initial_zoom * 4^k, at
    most max_zooms. single_pass writes all of them with the data and drops those
    that do not help by what they take; otherwise records are counted first,
    from 10 bases on if initial_zoom is not given, and the chosen levels are
    written. sorted_by: "any" sorts the rows; "all" (chromosomes in the order of
    their names) and "start" (chromosomes in any order, each in one run) are
    kept for callers that have such input, and give the same file.
    """

    compress: bool = True
    items_per_slot: int = 1024
    block_size: int = 256
    max_zooms: int = 10
    zooms: list[int] | None = None
    initial_zoom: int | None = None
    single_pass: bool = False
    sorted_by: str = "any"

    def __post_init__(self) -> None:
        if self.sorted_by not in ("any", "all", "start"):
            raise ValueError("sorted_by is any, all or start")
        if min(self.items_per_slot, self.block_size - 1) < 1:
            raise ValueError("items_per_slot is 1 at least, block_size 2")


def _sections(rows: DataFrame, level: int, numbers: dict[str, int], kind: str, o: WriteOptions) -> DataFrame:
    """Encoded sections of one level, in the order of part, seq."""
    per, squeeze = o.items_per_slot, zlib.compress if o.compress else bytes
    pairs = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    rows = rows.withColumn("c", pairs[F.col("chrom")]).repartitionByRange("c", "s", "e").sortWithinPartitions("c", "s", "e")
    names = ["level", "part", "seq", "c", "s", "e", "n", "size", "payload"]

    def body(b: pa.Table, c: int) -> bytes:
        s, e = (b[x].to_numpy().astype("<u4") for x in ("s", "e"))
        if kind == "features":
            return b"".join(struct.pack("<III", c, x, y) + r.encode() + b"\0" for x, y, r in zip(s.tolist(), e.tolist(), b["rest"].to_pylist()))
        if kind == "signal":
            x = np.zeros(len(s), np.dtype([("s", "<u4"), ("e", "<u4"), ("v", "<f4")]))
            x["s"], x["e"], x["v"] = s, e, b["v"].to_numpy()
            return struct.pack("<" + SECTION, c, int(s[0]), int(e[-1]), 0, 0, 1, 0, len(s)) + x.tobytes()
        x = np.zeros(len(s), np.dtype([("c", "<u4"), ("s", "<u4"), ("e", "<u4"), ("bases", "<u4"), ("min", "<f4"), ("max", "<f4"), ("sum", "<f4"), ("sum_squares", "<f4")]))
        x["c"], x["s"], x["e"] = c, s, e
        for k in ("bases", "min", "max", "sum", "sum_squares"):
            x[k] = b[k].to_numpy()
        return x.tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, None

        def one(t: pa.Table) -> pa.RecordBatch:
            raw = body(t, t["c"][0].as_py())
            row = [level, part, seq, t["c"][0].as_py(), t["s"][0].as_py(), int(t["e"].to_numpy().max()), t.num_rows, len(raw)]
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in row), pa.array([squeeze(raw)], pa.binary())], names=names)

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows:
                c = held["c"].to_numpy()
                run = int(np.searchsorted(c, c[0], "right"))
                if run == held.num_rows and run < per:
                    break
                cut = min(run, per)
                yield one(held.slice(0, cut))
                seq, held = seq + 1, held.slice(cut)
        if held is not None and held.num_rows:
            yield one(held)

    return rows.mapInArrow(encode, "level long, part long, seq long, c long, s long, e long, n long, size long, payload binary")


def _name_tree(chroms: list[tuple[str, int]], at: int, fan: int) -> bytes:
    """B+ tree of names in order; numbers are places in that order."""
    key = max(len(n.encode()) for n, _ in chroms)
    fan = min(fan, len(chroms))
    head = struct.pack("<" + NAMES_HEADER, NAMES_MAGIC, fan, key, 8, len(chroms), 0)
    leaves = [chroms[i : i + fan] for i in range(0, len(chroms), fan)]
    levels: list[list[list]] = [[[(n, i * fan + j, x) for j, (n, x) in enumerate(leaf)] for i, leaf in enumerate(leaves)]]
    while len(levels[0]) > 1:
        firsts = [(node[0][0], i) for i, node in enumerate(levels[0])]
        levels.insert(0, [firsts[i : i + fan] for i in range(0, len(firsts), fan)])
    size = 4 + fan * (key + 8)
    begin = [at + 32 + size * sum(len(x) for x in levels[:k]) for k in range(len(levels))]
    out = [head]
    for k, level in enumerate(levels):
        leaf = k + 1 == len(levels)
        for node in level:
            items = b"".join(n.encode().ljust(key, b"\0") + (struct.pack("<II", *x) if leaf else struct.pack("<Q", begin[k + 1] + x[0] * size)) for n, *x in node)
            out.append((struct.pack("<" + NODE, leaf, 0, len(node)) + items).ljust(size, b"\0"))
    return b"".join(out)


def _range_tree(entries: list[tuple], at: int, end: int, fan: int, per: int) -> bytes:
    """R-tree of (c, s, c, e, offset, size), built from the leaves up."""

    def around(node: list[tuple]) -> tuple:
        lo, hi = min((x[0], x[1]) for x in node), max((x[2], x[3]) for x in node)
        return (*lo, *hi)

    levels: list[list[list[tuple]]] = [[entries[i : i + fan] for i in range(0, len(entries), fan)] or [[]]]
    while len(levels[0]) > 1:
        above = [(*around(node), i) for i, node in enumerate(levels[0])]
        levels.insert(0, [above[i : i + fan] for i in range(0, len(above), fan)])
    sizes = [4 + fan * (32 if k + 1 == len(levels) else 24) for k in range(len(levels))]
    begin, place = [], at + 48
    for level, size in zip(levels, sizes):
        begin.append(place)
        place += size * len(level)
    whole = around(entries) if entries else (0, 0, 0, 0)
    out = [struct.pack("<" + INDEX_HEADER, INDEX_MAGIC, fan, len(entries), *whole, end, per, 0)]
    for k, level in enumerate(levels):
        leaf = k + 1 == len(levels)
        for node in level:
            items = b"".join(struct.pack("<IIIIQQ", *x) if leaf else struct.pack("<IIIIQ", *x[:4], begin[k + 1] + x[4] * sizes[k + 1]) for x in node)
            out.append((struct.pack("<" + NODE, leaf, 0, len(node)) + items).ljust(sizes[k], b"\0"))
    return b"".join(out)


def write_native(track: DataFrame, sizes: DataFrame, path: str, options: WriteOptions | None = None, declaration: str | None = None) -> None:
    """Write a signal or feature track as one file on a path of the driver.

    Rows need no order. They are checked first (see operators.validate), and a
    chromosome without a length, or an empty track, raises. Sections of data
    and zooms are encoded by tasks and staged; the driver then holds their
    index, 48 bytes for 1024 rows, and streams them into the file.
    """
    with scratch():
        _write(track, sizes, path, options or WriteOptions(), declaration)


def _write(track: DataFrame, sizes: DataFrame, path: str, o: WriteOptions, declaration: str | None) -> None:
    ship(track.sparkSession)
    kind = "signal" if "v" in track.columns else "features"
    if kind == "features" and "rest" not in track.columns:
        track = track.withColumn("rest", F.lit(""))
    track = stage(track, "native-rows")
    validate.check(track, sizes)
    used = sizes.join(track.select("chrom").distinct(), "chrom", "left_semi")
    chroms = sorted((r["chrom"], r["length"]) for r in used.select("chrom", "length").distinct().collect())
    numbers = {n: i for i, (n, _) in enumerate(chroms)}
    # every level is of the same depth, which is made once
    depth = track if kind == "signal" else stage(coverage(track).select("chrom", "s", "e", F.col("depth").cast("double").alias("v")), "native-depth")
    if o.zooms is not None or o.single_pass:
        longest = used.agg(F.max("length")).first()[0]
        levels = candidate_levels(longest, o.initial_zoom or 160, o.max_zooms, o.zooms)
    else:
        levels = sorted(build_zooms(depth, used, initial=o.initial_zoom or 10, max_zooms=o.max_zooms, data_bytes=12 * track.count()))
    parts = _sections(track, 0, numbers, kind, o)
    for z in levels:
        parts = parts.union(_sections(zoom_anchored(depth, z), z, numbers, "zoom", o))
    sections = stage(parts, "native-sections")
    totals = {r["level"]: r for r in sections.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("payload")).alias("bytes"), F.max("size").alias("size"), F.sum("n").alias("rows")).collect()}
    levels = [z for z in levels if z in totals]
    if o.single_pass and o.zooms is None:
        levels = choose_single_pass({z: (totals[z]["bytes"], totals[z]["n"]) for z in levels}, totals[0]["bytes"])
        totals = {z: totals[z] for z in (0, *levels)}
    whole = track_summary(depth).first()
    if kind == "features":
        declaration = declaration or autosql.for_rest(track.select("rest").first()[0])
    text = b"" if kind == "signal" else declaration.encode() + b"\0"
    fields = len(autosql.parse(declaration)[-1].fields) if kind == "features" else 0
    sql_at = 64 + 24 * len(levels)
    summary_at = sql_at + len(text)
    names_at = summary_at + 40
    names = _name_tree(chroms, names_at, o.block_size)
    data_at = names_at + len(names)

    def tree_size(n: int) -> int:
        size, nodes, leaf = 48, max(1, -(-n // o.block_size)), True
        while True:
            size += nodes * (4 + o.block_size * (32 if leaf else 24))
            if nodes == 1:
                return size
            nodes, leaf = -(-nodes // o.block_size), False

    index_at = data_at + 8 + totals[0]["bytes"]
    heads, at = [], index_at + tree_size(totals[0]["n"])
    for z in levels:
        heads.append((z, 0, at, at + 4 + totals[z]["bytes"]))
        at = heads[-1][3] + tree_size(totals[z]["n"])
    buffer = max(t["size"] for t in totals.values()) if o.compress else 0
    magic = SIGNAL_MAGIC if kind == "signal" else FEATURE_MAGIC
    count = totals[0]["rows"] if kind == "features" else totals[0]["n"]
    with open(path, "wb") as f:
        f.write(struct.pack("<" + HEADER, magic, 4, len(levels), names_at, data_at, index_at, fields, min(fields, 12) and 3, sql_at if text else 0, summary_at, buffer, 0))
        for h in heads:
            f.write(struct.pack("<" + ZOOM_HEADER, *h))
        f.write(text)
        f.write(struct.pack("<" + SUMMARY, whole["bases"], whole["min"], whole["max"], whole["sum"], whole["sum_squares"]))
        f.write(names)
        for z, begin in [(0, data_at), *((h[0], h[2]) for h in heads)]:
            f.write(struct.pack("<Q", count) if z == 0 else struct.pack("<I", totals[z]["rows"]))
            entries = []
            for r in sections.filter(F.col("level") == z).orderBy("part", "seq").toLocalIterator():
                entries.append((r["c"], r["s"], r["c"], r["e"], f.tell(), len(r["payload"])))
                f.write(r["payload"])
            f.write(_range_tree(entries, f.tell(), f.tell(), o.block_size, o.items_per_slot))
        f.write(struct.pack("<I", magic))
