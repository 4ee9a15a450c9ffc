"""Sources other than local paths, write options, and the command line."""

import io
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from spantable import __main__ as cli
from spantable import api
from spantable.sources import native, storage

SIG = [("chr1", 1, 3, 1.0), ("chr1", 4, 8, 2.0), ("chr1", 8, 10, 3.0), ("chr2", 0, 4, 0.5)]
BED = [("chr1", 1, 3, "b\tx"), ("chr1", 4, 6, "a"), ("chr1", 4, 10, "c")]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    api.write_signal(spark, str(d / "a.bw"), {"chr1": 12, "chr2": 5}, SIG)
    api.write_features(spark, str(d / "b.bb"), {"chr1": 12}, BED)
    (d / "r.bed").write_text("chr1\t0\t12\tall\nchr1\t3\t4\tgap\n")
    (d / "s.txt").write_text("chr1 12\nchr2 5\n")
    return d


@pytest.fixture
def server(files):
    """Serves the folder, with ranges below /r/ and without below /w/."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            _, kind, name = self.path.split("?")[0].split("/")
            if not (files / name).is_file():
                self.send_error(404)
                return
            data = (files / name).read_bytes()
            asked = self.headers.get("Range") if kind == "r" else None
            if asked:
                a, b = (int(x) for x in asked.removeprefix("bytes=").split("-"))
                if a >= len(data):
                    self.send_error(416)
                    return
                data = data[a : b + 1]
            self.send_response(206 if asked else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            try:
                self.wfile.write(data)
            except BrokenPipeError:  # the reader had enough
                pass

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


@pytest.mark.parametrize("kind", ["r", "w"])
def test_tracks_over_http(spark, files, server, kind):
    t = api.open_track(spark, f"{server}/{kind}/a.bw?x=1")
    assert sorted(map(tuple, t.rows().collect())) == SIG and t.chroms() == {"chr1": 12, "chr2": 5}
    with pytest.raises(OSError):
        api.open_track(spark, f"{server}/{kind}/none.bw")
    with storage.open_file(f"{server}/{kind}/s.txt") as f:
        assert f.read_at(4, 5) == b"12\nc" and f.read_at(5, 900) == b"" and f.read_at(0, 0) == b""


def test_tracks_of_open_files(spark, files):
    with open(files / "a.bw", "rb") as f:
        t = api.open_track(spark, f)
        assert t.is_signal and sorted(map(tuple, t.rows().collect())) == SIG
        assert [tuple(r) for r in t.records("chr1", 2, 5).orderBy("s").collect()] == [("chr1", 2, 3, 1.0), ("chr1", 4, 5, 2.0)]
    b = api.open_track(spark, io.BytesIO((files / "b.bb").read_bytes()))
    assert b.is_features and sorted(map(tuple, b.rows().collect())) == BED
    with pytest.raises(native.NativeError):
        api.open_track(spark, io.BytesIO(b"nothing"))


def test_cached_rows(spark, files, tmp_path):
    path = tmp_path / "a.bw"
    path.write_bytes((files / "a.bw").read_bytes())
    t = api.open_track(spark, path).cached()
    assert t.rows().count() == 4
    path.unlink()
    assert t.rows().filter("s > 3").count() == 2
    t.release()


def test_write_options(spark, tmp_path):
    rows = [("c", i * 20, i * 20 + 15, float(i % 7)) for i in range(4000)]
    for options in (native.WriteOptions(single_pass=True, items_per_slot=64), native.WriteOptions(initial_zoom=40, max_zooms=2, sorted_by="all"), native.WriteOptions(zooms=[100, 30], compress=False)):
        path = str(tmp_path / "o.bw")
        api.write_signal(spark, path, {"c": 100_000}, rows, options)
        file = native.NativeFile(path)
        assert sorted(map(tuple, native.read_native(spark, path).collect())) == rows
        levels = sorted(file.zooms)
        assert all(native.read_native(spark, path, z).agg({"bases": "sum"}).first()[0] == 60_000 for z in levels)
        if options.zooms:
            assert levels == [30, 100]
        elif options.single_pass:
            assert levels and set(levels) <= {160 * 4**k for k in range(5)}
        else:
            assert len(levels) <= 2 and set(levels) <= {40, 160}
    with pytest.raises(ValueError):
        native.WriteOptions(sorted_by="length")


def test_command_line(spark, files, capsys):
    def p(x):
        return str(files / x)

    def do(*argv):
        return cli.run(spark, list(argv))

    do("bigwigtobedgraph", p("a.bw"), p("a.bedGraph"))
    assert (files / "a.bedGraph").read_text() == "chr1\t1\t3\t1\nchr1\t4\t8\t2\nchr1\t8\t10\t3\nchr2\t0\t4\t0.5\n"
    do("bigwigtobedgraph", p("a.bw"), p("part.bedGraph"), "--chrom", "chr1", "--start", "2", "--end", "5")
    assert (files / "part.bedGraph").read_text() == "chr1\t2\t3\t1\nchr1\t4\t5\t2\n"
    do("bedgraphtobigwig", p("a.bedGraph"), p("s.txt"), p("again.bw"), "--zooms", "4,16", "-u")
    assert sorted(map(tuple, api.open_track(spark, p("again.bw")).rows().collect())) == SIG
    assert "zoomLevels: 2" in do("bigwiginfo", p("again.bw"), "--zooms") and do("bigwiginfo", p("again.bw"), "--minmax") == "0.500000 3.000000"
    do("bigbedtobed", p("b.bb"), p("b.bed"))
    assert (files / "b.bed").read_text().splitlines() == ["chr1\t1\t3\tb\tx", "chr1\t4\t6\ta", "chr1\t4\t10\tc"]
    do("bedtobigbed", p("r.bed"), p("s.txt"), p("r.bb"))
    assert "itemCount: 2" in do("bigbedinfo", p("r.bb")) and "table" in do("bigbedinfo", p("r.bb"), "--autosql")
    with pytest.raises(ValueError):
        do("bigbedinfo", p("a.bw"))
    do("bigwigaverageoverbed", p("a.bw"), p("r.bed"), p("avg.txt"), "-m")
    assert sorted(x.split("\t")[0] for x in (files / "avg.txt").read_text().splitlines()) == ["all", "gap"]
    do("bigwigaverageoverbed", p("a.bw"), p("r.bed"), p("avg2.txt"), "-n", "interval")
    assert "chr1:0-12\t12\t8" in (files / "avg2.txt").read_text()
    do("bigwigvaluesoverbed", p("a.bw"), p("r.bed"), p("values.txt"), "-d", ",")
    assert sorted((files / "values.txt").read_text().splitlines()) == ["all,0.0,1.0,1.0,0.0,2.0,2.0,2.0,2.0,3.0,3.0,0.0,0.0", "gap,0.0"]
    do("bigwigmerge", p("sum.bw"), "-b", p("a.bw"), "-b", p("again.bw"))
    assert sorted(map(tuple, api.open_track(spark, p("sum.bw")).rows().collect())) == [(c, s, e, 2 * v) for c, s, e, v in SIG]
    (files / "list.txt").write_text(f"{p('a.bw')}\n{p('again.bw')}\n")
    do("bigwigmerge", p("max.bedGraph"), "-l", p("list.txt"), "--max", "--threshold", "1.5")
    assert (files / "max.bedGraph").read_text() == "chr1\t4\t8\t2\nchr1\t8\t10\t3\n"
    do("intersect", p("r.bed"), p("b.bb"), p("i.bed"))
    assert len((files / "i.bed").read_text().splitlines()) == 6  # touching ones too
    do("chromintersect", p("r.bed"), p("b.bb"), p("ci.bed"), "--folder")
    assert (files / "ci.bed").is_dir()
    with pytest.raises(ValueError):
        do("bigwigmerge", p("x.bw"))


def test_names_come_from_the_first_lines(spark, files):
    """Ten distinct names first decide for names, whatever follows; a repeat among them decides for places."""
    rows = [f"chr1\t{i % 10}\t{i % 10 + 1}\tn{i}" for i in range(10)] + ["chr1\t0\t1\tn0"]
    for lines, want in ((rows, "n0"), ([rows[-1], *rows], "chr1:0-1")):
        (files / "n.bed").write_text("\n".join(lines) + "\n")
        cli.run(spark, ["bigwigvaluesoverbed", str(files / "a.bw"), str(files / "n.bed"), str(files / "n.txt")])
        assert want in {x.split("\t")[0] for x in (files / "n.txt").read_text().splitlines()}
