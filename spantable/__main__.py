"""Jobs from files to files on the command line: python -m spantable JOB ..."""

from __future__ import annotations

import argparse
import os
import shutil
import sys

from spantable import api
from spantable.sources.native import WriteOptions


def _range(p: argparse.ArgumentParser) -> None:
    p.add_argument("--chrom", help="only this chromosome")
    p.add_argument("--start", type=int, help="from this base on; needs --chrom")
    p.add_argument("--end", type=int, help="up to this base; needs --chrom")
    p.add_argument("--overlap-bed", help="only what lies in the regions of this BED file")


def _writer(p: argparse.ArgumentParser) -> None:
    p.add_argument("-u", "--uncompressed", action="store_true")
    p.add_argument("-z", "--nzooms", type=int, default=10, help="levels at most")
    p.add_argument("--zooms", help="these levels, with commas between")
    p.add_argument("--initial-zoom", type=int)
    p.add_argument("--block-size", type=int, default=256)
    p.add_argument("--items-per-slot", type=int, default=1024)
    p.add_argument("-s", "--sorted", choices=["any", "all", "start"], default="any", help="the order of the input; rows are sorted whatever it is")
    p.add_argument("--single-pass", action="store_true", help="write all levels with the data and drop those that do not help")


def _options(a: argparse.Namespace) -> WriteOptions:
    zooms = [int(x) for x in a.zooms.split(",")] if a.zooms else None
    return WriteOptions(not a.uncompressed, a.items_per_slot, a.block_size, a.nzooms, zooms, a.initial_zoom, a.single_pass, a.sorted)


def _names(text: str) -> int | str:
    return text if text in ("interval", "none") else int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("spantable", description="Interval tracks on Spark: convert, ask and merge files.")
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, help_: str, *paths: str, text: bool = True) -> argparse.ArgumentParser:
        p = jobs.add_parser(name, help=help_)
        for x in paths:
            p.add_argument(x)
        if text:
            p.add_argument("--folder", action="store_true", help="leave the text as a folder of part files")
        return p

    job("intersect", "rows of a binary feature track that overlap or touch rows of a BED file", "a", "b", "output")
    job("chromintersect", "rows of a BED file on chromosomes of a binary track", "a", "b", "output")
    _writer(job("bedgraphtobigwig", "a binary signal track from bedGraph text", "input", "chromsizes", "output", text=False))
    p = job("bedtobigbed", "a binary feature track from BED text", "input", "chromsizes", "output", text=False)
    p.add_argument("-a", "--autosql", help="file with the declaration of the columns")
    _writer(p)
    p = job("bigbedtobed", "BED text from a binary feature track", "input", "output")
    p.add_argument("--zoom", type=int, help="the records of this level instead")
    _range(p)
    _range(job("bigwigtobedgraph", "bedGraph text from a binary signal track", "input", "output"))
    p = job("bigwigaverageoverbed", "statistics of a signal over each row of a BED file", "input", "bed", "output")
    p.add_argument("-n", "--namecol", type=_names, default=4, help="column with names, from 1; interval; none")
    p.add_argument("-m", "--min-max", action="store_true")
    p = job("bigwigvaluesoverbed", "a signal's value at each base of each row of a BED file", "input", "bed", "output")
    p.add_argument("-d", "--delimiter", default="\t")
    p = job("bigwigmerge", "one signal from several", "output")
    p.add_argument("-b", "--bigwig", action="append", default=[], help="an input, once for each")
    p.add_argument("-l", "--list", help="file with inputs, one a line")
    p.add_argument("--threshold", type=float, default=0.0)
    p.add_argument("--adjust", type=float, default=0.0)
    p.add_argument("--clip", type=float)
    p.add_argument("--max", action="store_true", help="the greatest value instead of the sum")
    for name in ("bigwiginfo", "bigbedinfo"):
        p = job(name, "what a binary track says of itself", "input", text=False)
        p.add_argument("--chroms", action="store_true")
        p.add_argument("--zooms", action="store_true")
        p.add_argument("--autosql", action="store_true")
        p.add_argument("--minmax", action="store_true", help="only the least and the greatest value")
    return top


def _one_file(folder: str, target: str) -> None:
    """The part files of a local folder, in their order, as one file in its place."""
    with open(target, "wb") as out:
        for name in sorted(x for x in os.listdir(folder) if x.startswith("part-")):
            with open(os.path.join(folder, name), "rb") as f:
                shutil.copyfileobj(f, out)
    shutil.rmtree(folder)


def run(spark, argv: list[str]) -> str | None:
    """Do a job with this session; the text that it prints, if any."""
    a = parser().parse_args(argv)
    if a.job in ("bigwiginfo", "bigbedinfo"):
        track = api.open_track(spark, a.input)
        if track.is_signal != (a.job == "bigwiginfo"):
            raise ValueError(f"{a.input} is no {'signal' if a.job == 'bigwiginfo' else 'feature'} track")
        if a.autosql:
            return track.sql()
        if a.minmax:
            s = track.info()["summary"]
            return f"{s['min']:.6f} {s['max']:.6f}"
        return api.info_text(track, a.chroms, a.zooms)
    if a.job == "bedgraphtobigwig":
        return api.bedgraph_to_binary(spark, a.input, a.chromsizes, a.output, _options(a))
    if a.job == "bedtobigbed":
        declaration = None
        if a.autosql:
            with open(a.autosql, encoding="utf-8") as f:
                declaration = f.read()
        return api.bed_to_binary(spark, a.input, a.chromsizes, a.output, declaration, _options(a))
    binary = a.output.lower().endswith(api.SIGNAL_NAMES)
    target = a.output if a.folder or binary else f"{a.output}.parts"
    if a.job == "intersect":
        api.intersect_files(spark, a.a, a.b, target)
    elif a.job == "chromintersect":
        api.chrom_intersect_files(spark, a.a, a.b, target)
    elif a.job == "bigwigtobedgraph":
        api.binary_to_bedgraph(spark, a.input, target, a.chrom, a.start, a.end, a.overlap_bed)
    elif a.job == "bigbedtobed":
        api.binary_to_bed(spark, a.input, target, a.chrom, a.start, a.end, a.overlap_bed, a.zoom)
    elif a.job == "bigwigaverageoverbed":
        names = a.namecol if isinstance(a.namecol, str) else a.namecol - 1
        api.average_to_text(spark, a.input, a.bed, target, names, a.min_max)
    elif a.job == "bigwigvaluesoverbed":
        api.values_to_text(spark, a.input, a.bed, target, a.delimiter)
    else:
        inputs = list(a.bigwig)
        if a.list:
            with open(a.list, encoding="utf-8") as f:
                inputs += f.read().split()
        if not inputs:
            raise ValueError("nothing to merge: give inputs by -b or -l")
        api.merge_files(spark, inputs, target, "max" if a.max else "sum", a.clip, a.adjust, a.threshold)
    if target != a.output:
        _one_file(target, a.output)
    return None


def main() -> int:
    parser().parse_args(sys.argv[1:])  # faults of the command line before a session is made
    from pyspark.sql import SparkSession

    said = run(SparkSession.builder.appName("spantable").getOrCreate(), sys.argv[1:])
    if said:
        print(said)
    return 0


if __name__ == "__main__":
    sys.exit(main())
