"""Opening binary tracks, and jobs from files to files."""

import math

import numpy as np
import pytest

from spantable import api

SIG = [("chr1", 1, 3, 1.0), ("chr1", 4, 8, 2.0), ("chr1", 8, 10, 3.0)]
BED = [("chr1", 4, 6, "a"), ("chr1", 1, 3, "b\tx"), ("chr1", 4, 10, "c")]


def lines(path):
    return sorted(x for p in path.iterdir() if p.name.startswith("part") for x in p.read_text().splitlines())


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tracks")
    api.write_signal(spark, str(d / "a.bw"), {"chr1": 12, "chr2": 5}, SIG)
    api.write_features(spark, str(d / "b.bb"), {"chr1": 12}, BED)
    (d / "r.bed").write_text("chr1\t0\t12\tall\nchr1\t3\t4\tgap\n")
    (d / "s.txt").write_text("chr1 12\n")
    return d


def test_open(spark, files):
    t, f = api.open_track(spark, files / "a.bw"), api.open_track(spark, files / "b.bb")
    assert t.is_signal and f.is_features and t.chroms() == {"chr1": 12} and f.item_count() == 3
    assert t.chroms("chr1") == 12 and t.info()["summary"]["bases"] == 8 and "basesCovered: 8" in api.info_text(t, True, True)
    with pytest.raises(KeyError):
        t.chroms("chr3")
    with pytest.raises(ValueError):
        api.open_track(spark, files / "r.bed")
    assert t.sql(parse=True)["name"] == "bedGraph" and len(f.sql(parse=True)["fields"]) >= 4
    out = np.zeros(6)
    assert t.values("chr1", 0, 12, 6, exact=True, fillna=0.0, arr=out) is out and out.tolist() == [1, 1, 2, 2, 3, 0]
    with pytest.raises(ValueError):
        t.values("chr1", 0, 12, 6, arr=np.zeros(5))
    assert np.nansum(f.values("chr1")) == 10
    assert [tuple(r) for r in f.records("chr1", 0, 3).select("s", "fields").collect()] == [(1, ["b", "x"])]
    got = {r["name"]: r["mean"] for r in t.average_over_bed(str(files / "r.bed"), True).collect()}
    assert got["all"] == 2.0 and math.isnan(got["gap"])
    with pytest.raises(ValueError):
        f.average_over_bed(str(files / "r.bed"))


def test_jobs(spark, files):
    d, p = files, lambda x: str(files / x)
    api.binary_to_bedgraph(spark, p("a.bw"), p("t1"), "chr1", 2, 5)
    assert lines(d / "t1") == ["chr1\t2\t3\t1", "chr1\t4\t5\t2"]
    api.binary_to_bedgraph(spark, p("a.bw"), p("all"))
    api.bedgraph_to_binary(spark, p("all"), p("s.txt"), p("again.bw"))
    assert sorted(map(tuple, api.open_track(spark, p("again.bw")).rows().collect())) == SIG
    api.binary_to_bed(spark, p("b.bb"), p("t2"), regions=p("r.bed"))
    assert "chr1\t4\t4\ta" in lines(d / "t2")
    api.bed_to_binary(spark, p("r.bed"), p("s.txt"), p("r.bb"))
    api.average_to_text(spark, p("a.bw"), p("r.bed"), p("t3"), min_max=True)
    assert lines(d / "t3")[0].split("\t")[:3] == ["all", "12", "8"]
    api.values_to_text(spark, p("a.bw"), p("r.bed"), p("t4"), ",")
    assert lines(d / "t4")[1] == "gap,0.0"
    api.merge_files(spark, [p("a.bw"), p("again.bw")], p("m.bw"))
    assert sorted(map(tuple, api.open_track(spark, p("m.bw")).rows().collect())) == [(c, s, e, 2 * v) for c, s, e, v in SIG]
    api.intersect_files(spark, p("r.bed"), p("b.bb"), p("t5"))
    assert len(lines(d / "t5")) == 6
    api.chrom_intersect_files(spark, p("r.bed"), p("b.bb"), p("t6"))
    assert len(lines(d / "t6")) == 2
    with pytest.raises(ValueError):
        api.binary_to_bed(spark, p("b.bb"), p("t7"), start=4)
