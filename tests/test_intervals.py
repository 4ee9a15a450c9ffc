"""Hand-made cases and brute force for the interval operators."""

import math
import random

import numpy as np
import pytest

from spantable.operators import joins, ranges, raster, stats, sweep, validate, zoom
from spantable.plans.overlap import overlap_join, suggest_width
from spantable.sources import autosql, text

# A track of twelve bases, eight of them covered, whose values per base and per bin below are worked out by hand.
SIG = [("chr1", 1, 3, 1.0), ("chr1", 4, 8, 2.0), ("chr1", 8, 10, 3.0)]
BED = [("chr1", 1, 3), ("chr1", 4, 6), ("chr1", 4, 10), ("chr1", 6, 10), ("chr1", 8, 10)]
NAN = float("nan")


@pytest.fixture(scope="module")
def mini(spark):
    sizes = spark.createDataFrame([("chr1", 12)], "chrom string, length long")
    return text.from_rows(spark, SIG).cache(), text.from_rows(spark, BED, "bed").cache(), sizes


def same(a, b):
    assert len(a) == len(b)
    assert all(math.isnan(x) and math.isnan(y) or x == pytest.approx(y) for x, y in zip(a, b)), (list(a), b)


def test_base_values(mini):
    sig, bed, sizes = mini
    want = [NAN, 1, 1, NAN, 2, 2, 2, 2, 3, 3, NAN, NAN]
    for t in (sig, bed):
        same(raster.to_array(raster.values(t, sizes, "chr1")), want)
    same(raster.to_array(raster.values(sig, sizes, "chr1", uncovered=0)), [0, 1, 1, 0, 2, 2, 2, 2, 3, 3, 0, 0])
    same(raster.to_array(raster.values(sig, sizes, "chr1", -2, 14, oob=-1, fillna=0)), [-1, -1, 0, 1, 1, 0, 2, 2, 2, 2, 3, 3, 0, 0, -1, -1])
    same(raster.to_array(raster.values(sig, sizes, "chr1", 20, 30)), [NAN] * 10)


@pytest.mark.parametrize(("bins", "want"), [(6, [1, 1, 2, 2, 3, NAN]), (5, [1, 1, 2, 2.5, 3]), (2, [1.5, 2.5]), (1, [2])])
def test_binned_means(mini, bins, want):
    sig, bed, sizes = mini
    same(raster.to_array(raster.values(sig, sizes, "chr1", 0, 12, bins)), want)
    same(raster.to_array(raster.values(bed, sizes, "chr1", 0, 12, bins)), want)


def test_every_summary_against_bases(mini):
    sig, _, sizes = mini
    base = np.array([0, 1, 1, 0, 2, 2, 2, 2, 3, 3, 0, 0], float)
    has = np.array([0, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0, 0], bool)
    for bins in (1, 3, 4, 6):
        for uncovered in (None, 0.0):
            for name in raster.SUMMARIES:
                got = raster.to_array(raster.values(sig, sizes, "chr1", 0, 12, bins, name, uncovered=uncovered))
                want = []
                for b in range(bins):
                    part = slice(b * 12 // bins, (b + 1) * 12 // bins)
                    x = base[part] if uncovered is not None else base[part][has[part]]
                    c = int(has[part].sum())
                    of = {
                        "mean": lambda x: x.mean(), "std": lambda x: x.std(ddof=1) if len(x) > 1 else 0.0, "min": lambda x: x.min(), "max": lambda x: x.max(), "sum": lambda x: x.sum(),
                        "sum_squares": lambda x: (x * x).sum(), "bases_covered": lambda x, c=c: c, "bin_covered": lambda x, c=c, bins=bins: c / (12 / bins),
                    }[name]
                    want.append(of(x) if len(x) or name.startswith("b") else NAN)
                same(got, want)


def test_raster_edges(mini):
    sig, _, sizes = mini
    with pytest.raises(ValueError, match="median"):
        raster.values(sig, sizes, "chr1", bins=2, summary="median")
    with pytest.raises(KeyError):
        raster.values(sig, sizes, "chr9")
    covered = [raster.to_array(raster.values(sig, sizes, "chr1", 0, 12, b, "bases_covered")).sum() for b in (1, 2, 5, 7, 12)]
    assert covered == [8] * 5
    up = raster.to_array(raster.values(sig, sizes, "chr1", 0, 12, 24))
    same(up, [x for v in [NAN, 1, 1, NAN, 2, 2, 2, 2, 3, 3, NAN, NAN] for x in (v, v)])
    half = raster.to_array(raster.values(sig, sizes, "chr1", -3, 9, 4, oob=-1.0))
    same(half, [-1, 1, 2, 7 / 3])


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(10, 30), (20, 40)], [(10, 20, 1), (20, 30, 2), (30, 40, 1)]),
        ([(10, 25), (15, 35), (30, 45)], [(10, 15, 1), (15, 25, 2), (25, 30, 1), (30, 35, 2), (35, 45, 1)]),
        ([(10, 20), (20, 30), (30, 40)], [(10, 40, 1)]),
        ([(10, 20)] * 3, [(10, 20, 3)]),
        ([(20, 10)], []),
        ([(10, 10)], []),
    ],
)
@pytest.mark.parametrize("stride", [7, 1 << 16])
def test_coverage(spark, rows, want, stride):
    t = text.from_rows(spark, [("c", s, e) for s, e in rows], "bed")
    assert [tuple(r)[1:] for r in sweep.coverage(t, stride).orderBy("s").collect()] == want


def random_track(seed, n=150, most=2000):
    rng, at, out = random.Random(seed), 0, []
    for _ in range(n):
        at += rng.choice([0, 0, 1, 3, 20])
        e = at + rng.randint(1, 12)
        out.append(("c" + str(seed % 2), at, e, rng.choice([0.25, 0.5, 1.0, 2.0, -0.5])))
        at = e
    return out


def dense(rows, size=4000):
    out = {}
    for c, s, e, v in rows:
        out.setdefault(c, np.full(size, np.nan))[s:e] = v
    return out


@pytest.mark.parametrize("how", ["sum", "max"])
def test_merge_against_bases(spark, how):
    tracks = [random_track(s) for s in (2, 4, 6)]
    got = sweep.merge(*[text.from_rows(spark, t) for t in tracks], how=how, threshold=None, stride=64).orderBy("chrom", "s").collect()
    stack = np.stack([dense(t)["c0"] for t in tracks])
    with np.errstate(all="ignore"):
        want = np.where(np.isnan(stack).all(0), 0, np.nansum(stack, 0) if how == "sum" else np.nanmax(np.where(np.isnan(stack), -1e9, stack), 0))
    flat = np.zeros(4000)
    for r in got:
        flat[r["s"] : r["e"]] = r["v"]
    assert (flat == want).all()
    assert all(a["e"] < b["s"] or a["v"] != b["v"] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("how", ["sum", "max"])
def test_merge_of_values_that_no_sum_takes_back(spark, how):
    """Tenths, 1e9, infinite and NaN values, against bases; touching equal runs join over strides, NaN with NaN."""
    rng, tracks = random.Random(8), []
    for seed in (2, 4, 6):
        tracks.append([(c, s, e, rng.choice([0.1, 0.2, 0.3, 1e9, float("inf"), float("nan"), -0.1])) for c, s, e, _ in random_track(seed)])
    tracks[0] += [("z", 0, 100, float("nan")), ("z", 100, 300, float("nan")), ("z", 300, 301, 0.1)]
    frames = [text.from_rows(spark, t) for t in tracks]
    with np.errstate(all="ignore"):
        for stride in (16, 1 << 16):
            got = sweep.merge(*frames, how=how, threshold=None, stride=stride).orderBy("chrom", "s").collect()
            for chrom in ("c0", "z"):
                want = np.zeros(4000)
                any_ = np.zeros(4000, bool)
                for t in tracks:
                    for c, s, e, v in t:
                        if c == chrom:
                            want[s:e] = np.where(any_[s:e], want[s:e] + v if how == "sum" else np.where(np.isnan(want[s:e]), np.nan, np.maximum(want[s:e], v)), v)
                            any_[s:e] = True
                flat = np.zeros(4000)
                for r in got:
                    if r["chrom"] == chrom:
                        flat[r["s"] : r["e"]] = r["v"]
                assert np.array_equal(flat, np.where(any_, want, 0), equal_nan=True)
            assert all(a["chrom"] != b["chrom"] or a["e"] < b["s"] or not (a["v"] == b["v"] or a["v"] != a["v"] and b["v"] != b["v"]) for a, b in zip(got, got[1:]))
            assert [(r["s"], r["e"]) for r in got if r["chrom"] == "z"] == [(0, 300), (300, 301)]


def test_windows_of_a_merge_look_back(spark):
    """A frame up to the end of a stride is summed anew for each row, which takes the square of its rows."""
    tracks = [text.from_rows(spark, random_track(s)) for s in (2, 4, 6)]
    for how in ("sum", "max"):
        plan = sweep.merge(*tracks, how=how)._jdf.queryExecution().executedPlan().toString()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_merge_of_many_tracks(spark):
    tracks = [text.from_rows(spark, [("c", i, i + 3, 1.0)]) for i in range(20)]
    assert [tuple(r)[1:] for r in sweep.merge(*tracks).orderBy("s").collect()] == [(0, 1, 1.0), (1, 2, 2.0), (2, 20, 3.0), (20, 21, 2.0), (21, 22, 1.0)]


def test_base_values_beside_infinite_and_nan(spark):
    t = text.from_rows(spark, [("c", 0, 3, float("inf")), ("c", 3, 4, float("nan")), ("c", 4, 6, 1.0), ("c", 6, 8, 0.1)])
    sizes = spark.createDataFrame([("c", 10)], "chrom string, length long")
    got = raster.to_array(raster.values(t, sizes, "c", 0, 10))
    assert np.array_equal(got, [np.inf] * 3 + [np.nan, 1, 1, 0.1, 0.1, np.nan, np.nan], equal_nan=True)


def test_merge_options(spark):
    a, b = text.from_rows(spark, [("c", 0, 10, 1.0), ("c", 10, 20, 5.0)]), text.from_rows(spark, [("c", 5, 15, 2.0)])
    assert [tuple(r) for r in sweep.merge(a, b, clip=5.0, adjust=-2.0, threshold=0.0).orderBy("s").collect()] == [("c", 5, 10, 1.0), ("c", 10, 20, 3.0)]
    assert sweep.merge(text.from_rows(spark, [("c", 0, 4, 1.0)]), text.from_rows(spark, [("c", 0, 4, -1.0)]), threshold=None).count() == 0
    with pytest.raises(ValueError):
        sweep.merge(a, how="min")


def test_fill(spark):
    t = text.from_rows(spark, [("c", 10, 15, 0.5), ("c", 20, 30, 0.7), ("c", 30, 35, 0.9)])
    zero = lambda df: sorted((r["s"], r["e"]) for r in df.filter("v = 0").collect())
    assert zero(sweep.fill_gaps(t)) == [(0, 10), (15, 20)]
    assert zero(sweep.fill_gaps(t, 5, 50, stride=8)) == [(5, 10), (15, 20), (35, 50)]


@pytest.mark.parametrize("touching", [False, True])
@pytest.mark.parametrize("width", [5, 64, 4096])
def test_overlap_join_is_the_plain_join(spark, touching, width):
    rng = random.Random(width)
    make = lambda n: [(rng.choice("ab"), s := rng.randint(0, 200), s + rng.choice([0, 1, 5, 40, 90])) for _ in range(n)]
    a, b = make(60), make(60)
    left, right = text.from_rows(spark, a, "bed").drop("rest"), text.from_rows(spark, b, "bed").drop("rest")
    got = sorted(tuple(r) for r in overlap_join(left, right, touching, width).select("chrom", "s", "e", "r_s", "r_e").collect())
    ok = (lambda x, y: y[2] >= x[1] and y[1] <= x[2]) if touching else (lambda x, y: y[2] > x[1] and y[1] < x[2])
    assert got == sorted((x[0], x[1], x[2], y[1], y[2]) for x in a for y in b if x[0] == y[0] and ok(x, y))
    assert suggest_width(left, right) >= 1024


def test_average_and_values(spark):
    sig = text.from_rows(spark, SIG)
    reg = spark.createDataFrame([(1, "chr1", 0, 12), (2, "chr1", 5, 5), (3, "chrX", 0, 4), (4, "chr1", 100, 110)], "id long, chrom string, s long, e long")
    got = {r["id"]: r for r in stats.average_over_bed(reg, sig).collect()}
    assert (got[1]["bases"], got[1]["sum"], got[1]["mean"], got[1]["min"], got[1]["max"]) == (8, 16.0, 2.0, 1.0, 3.0)
    assert got[1]["mean0"] == pytest.approx(16 / 12)
    assert math.isnan(got[2]["mean0"]) and got[2]["size"] == 0
    assert got[3]["bases"] == 0 and math.isnan(got[3]["min"]) and got[4]["mean0"] == 0
    v = {r["id"]: r["values"] for r in stats.values_over_bed(reg, sig).collect()}
    assert v[1] == [0, 1, 1, 0, 2, 2, 2, 2, 3, 3, 0, 0] and v[2] == [] and v[3] == [0] * 4
    assert {r["id"]: r["values"] for r in stats.values_text(reg, sig, ";").collect()}[3] == "0.0;0.0;0.0;0.0"
    with pytest.raises(ValueError):
        stats.average_over_bed(reg, sig, ["all", "mean"])


def test_track_info(spark):
    i = stats.track_info(text.from_rows(spark, SIG)).first()
    x = np.array([1, 1, 2, 2, 2, 2, 3, 3], float)
    assert (i["items"], i["bases"], i["sum"], i["min"], i["max"]) == (3, 8, 16.0, 1.0, 3.0)
    assert i["std"] == pytest.approx(x.std(ddof=1)) and i["variance"] == pytest.approx(x.var(ddof=1))
    d = stats.track_summary(text.from_rows(spark, [("c", 0, 10), ("c", 5, 20)], "bed")).first()
    assert (d["items"], d["bases"], d["sum"]) == (2, 20, 25.0)
    assert stats.track_summary(text.from_rows(spark, SIG).filter("false")).first()["bases"] == 0


def test_ranges_and_names(spark, mini):
    sig, bed, sizes = mini
    assert [tuple(r)[1:] for r in ranges.records(sig, sizes, "chr1", -4, 6).orderBy("s").collect()] == [(1, 3, 1.0), (4, 6, 2.0)]
    assert ranges.scan_features(bed, "chr1", 3, 3).count() == 1  # a row that only touches
    with pytest.raises(KeyError):
        ranges.records(sig, sizes, "chr7")
    f = text.from_rows(spark, [("c", 1, 5, "n1\tx y"), ("c", 5, 9, "")], "bed")
    row = f.select(ranges.row_name(3), ranges.row_name(4), ranges.row_name(0), ranges.row_name(None), ranges.split_rest(f["rest"])).collect()
    assert tuple(row[0]) == ("n1", "x y", "c", "c\t1\t5\tn1\tx y", ["n1", "x", "y"]) and tuple(row[1]) == ("", None, "c", "c\t5\t9", [])
    with pytest.raises(ValueError):
        ranges.same_sizes(sizes, spark.createDataFrame([("chr1", 13)], "chrom string, length long"))
    assert joins.intersect(text.from_rows(spark, [("chr1", 3, 4)], "bed"), bed).count() == 3
    assert [r["e"] - r["s"] for r in joins.clipped(text.from_rows(spark, [("chr1", 3, 4)], "bed"), bed).collect()] == [0, 0, 0]


def test_zoom(spark):
    rows = random_track(8, 300)
    t = text.from_rows(spark, rows)
    total = stats.track_summary(t).first()
    for z in (zoom.zoom_anchored(t, 50), zoom.zoom_grid(t, 50)):
        got = z.orderBy("s").collect()
        assert sum(r["bases"] for r in got) == total["bases"] and sum(r["sum"] for r in got) == pytest.approx(total["sum"])
        assert all(a["e"] <= b["s"] for a, b in zip(got, got[1:])) and all(r["e"] - r["s"] <= 50 for r in got)
    gap = [tuple(r)[1:3] for r in zoom.zoom_anchored(text.from_rows(spark, [("c", 0, 5, 1.0), ("c", 20, 25, 2.0)]), 10).orderBy("s").collect()]
    assert gap == [(0, 5), (20, 25)]
    assert zoom.best_zoom([10, 40, 160], 0, 1000, 10) == 40 and zoom.best_zoom([100], 0, 1000, 10) is None
    counts = {r["level"]: r["records"] for r in zoom.level_counts(t, [10, 40]).collect()}
    assert counts[40] == zoom.zoom_grid(t, 40).count()
    assert zoom.candidate_levels(50_000) == [160, 640, 2560, 10240, 40960]
    assert zoom.choose_levels({10: 1000, 40: 300, 160: 300}, 12_000) == [40]
    with pytest.raises(KeyError):
        zoom.zoom_records({}, 10, "c", 0, 5)


def brute_records(rows, size):
    """Anchored records base by base."""
    out, covered = [], {}
    for n, (c, s, e, v) in enumerate(rows):
        covered.setdefault(c, {}).update((x, (n, v)) for x in range(s, e))
    for c, bases in covered.items():
        start = None
        for x in sorted(bases):
            if start is None or x >= start + size:
                start = x
                out.append([c, x, x, set(), []])
            out[-1][2] = x + 1
            out[-1][3].add(bases[x][0])
            out[-1][4].append(bases[x][1])
    return sorted((c, s, e, len(items), len(v), min(v), max(v), sum(v), sum(x * x for x in v)) for c, s, e, items, v in out)


@pytest.mark.parametrize(("size", "stride"), [(7, 16), (50, 64), (500, 64), (50, 1 << 16)])
def test_anchored_records_against_bases(spark, size, stride):
    """Dense runs, gaps of all sizes, records over many strides and rows longer than a record."""
    rows = random_track(8, 200) + random_track(9, 100) + [("long", 5, 1234, 0.5), ("long", 1234, 1300, 0.25), ("long", 1310, 1311, 1.0), ("long", 5000, 5001, 2.0)]
    got = zoom.zoom_anchored(text.from_rows(spark, rows), size, stride).collect()
    assert sorted(map(tuple, got)) == brute_records(rows, size)
    assert zoom.zoom_anchored(text.from_rows(spark, rows).filter("false"), size).count() == 0


def test_passage_of_open_records():
    """What runs make of each remainder of an open record, against a walk from each; arcs are at most the size, not two a run."""
    rng = random.Random(1)
    for _ in range(200):
        size, at, s, e = rng.choice([1, 2, 7, 50]), rng.randint(-30, 30), [], []
        for _ in range(rng.randint(1, 15)):
            s.append(at)
            e.append(at + rng.randint(1, rng.choice([2, 10, 120])))
            at = e[-1] + rng.choice([1, 2, 3, rng.randint(1, 60)])
        starts, become = zoom.passage(np.array(s), np.array(e), size)
        assert len(starts) <= size
        for r in range(size):
            end = s[0] + (r - s[0]) % size
            for x, y in zip(s, e):
                opens = max(x, end)
                end = opens + -(-max(y - opens, 0) // size) * size
            to = become[np.searchsorted(starts, r, side="right") - 1]
            assert (r if to < 0 else to) == end % size


def test_records_are_walked_by_strides(spark):
    """Rows without a gap as wide as a record, which were one group a chromosome, are walked in groups of a stride."""
    rows = [("c", i * 8, i * 8 + 5, 1.0) for i in range(300)]
    z = zoom.zoom_anchored(text.from_rows(spark, rows), 50, 64)
    assert sorted(map(tuple, z.collect())) == brute_records(rows, 50)
    groups = [x for x in z._jdf.queryExecution().analyzed().toString().splitlines() if "FlatMapGroupsInArrow" in x]
    assert len(groups) == 3 and all("walk" not in x and "through" not in x or "_b" in x.split("]")[0] for x in groups)


def test_levels_of_a_single_pass():
    assert zoom.choose_single_pass({160: (900, 40), 640: (400, 20), 2560: (100, 20), 10240: (30, 5)}, 1000) == [640, 10240]


def test_zoomed_bins_are_exact_on_their_grid(spark):
    t = text.from_rows(spark, random_track(8, 300))
    sizes = spark.createDataFrame([("c0", 4000)], "chrom string, length long")
    z = {100: zoom.zoom_grid(t, 100)}
    for name in ("mean", "sum", "min", "max", "bases_covered"):
        a, b = (raster.to_array(raster.values(t, sizes, "c0", 0, 4000, 10, name, exact=x, zooms=z)) for x in (True, False))
        same(a, b.tolist())


def test_validation(spark):
    sizes = spark.createDataFrame([("c", 100)], "chrom string, length long")
    t = text.from_rows(spark, [("c", 0, 10, 1.0), ("c", 8, 20, 1.0), ("c", 90, 101, 1.0), ("x", 0, 1, 1.0)])
    assert sorted((r["s"], r["problem"]) for r in validate.violations(t, sizes).collect()) == [(0, "overlaps the next row"), (0, "unknown chromosome"), (90, "outside the chromosome")]
    with pytest.raises(validate.TrackError):
        validate.check(t, sizes)
    with pytest.raises(validate.TrackError, match="empty"):
        validate.check(t.filter("false"), sizes)
    ok = text.from_rows(spark, [("c", 0, 10, 1.0), ("c", 10, 10, 1.0), ("c", 10, 100, 1.0)])
    assert validate.check(ok, sizes).count() == 3
    assert validate.bad_overlaps(t, stride=4).count() == 1


def test_text_round_trip(spark, tmp_path):
    sig, bed = text.from_rows(spark, SIG), text.from_rows(spark, [("c", 5, 9, "a\tb c"), ("c", 1, 2, "")], "bed")
    text.write_bedgraph(sig, str(tmp_path / "a"))
    text.write_bed(bed, str(tmp_path / "b"))
    text.write_table(sig, str(tmp_path / "t"))
    assert sorted(map(tuple, text.read_bedgraph(spark, str(tmp_path / "a")).collect())) == SIG
    assert sorted(map(tuple, text.read_bed(spark, str(tmp_path / "b")).collect())) == [("c", 1, 2, ""), ("c", 5, 9, "a\tb c")]
    assert text.read_table(spark, str(tmp_path / "t")).filter("chrom = 'chr1' and e > 4").count() == 2
    (tmp_path / "s").write_text("chr1 100\n\nchr2\t50\n")
    assert sorted(map(tuple, text.read_sizes(spark, str(tmp_path / "s")).collect())) == [("chr1", 100), ("chr2", 50)]
    for line in ("c\tx\t5\t1", "c\t1", "c\t1\t99999999999\t1", "c\t1\t5\tnot"):
        (tmp_path / "bad").write_text(line + "\n")
        with pytest.raises(Exception):  # noqa: B017 - Spark wraps what a row raises
            text.read_bedgraph(spark, str(tmp_path / "bad")).collect()


def test_autosql(spark):
    assert [n for n, _, _ in autosql.describe(autosql.for_columns(4))["fields"]] == ["chrom", "chromStart", "chromEnd", "name"]
    assert autosql.describe(autosql.for_rest("\t".join("x" * 15)))["fields"][-1][0] == "field18"
    many = autosql.parse('''simple pt "a point" ( int x; "x" int y; "y" )
      object face "a face" ( enum(a, b) kind; "k" set(u,v) marks; "m" int n; "n" simple pt[n] points; "p" double[3] w; "w" )
      table t "all" ( string id primary; "i" int no index[4] auto; "no" object face f; "f" lstring rest unique; "r" )''')
    s = autosql.struct(many)
    assert s["f"].dataType["points"].dataType.elementType.simpleString() == "struct<x:int,y:int>" and s["id"].metadata["index"] == "primary" and s["no"].metadata["auto"]
    for bad in ("table t", 'table t "x" ( float f "no semicolon" )', 'table t "x" ( strange f; "x" )', "nonsense"):
        with pytest.raises(autosql.SchemaError):
            autosql.parse(bad)
    f = text.from_rows(spark, [("c", 1, 2, "nm\t7\t1,2,3,")], "bed")
    assert tuple(autosql.typed(f, 'table t "x" (string chrom; "" uint chromStart; "" uint chromEnd; "" string name; "" uint score; "" int[3] l; "")').first()) == ("c", 1, 2, "nm", 7, [1, 2, 3])
