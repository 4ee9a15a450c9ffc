"""Round trips of binary tracks, and files built byte by byte."""

import random
import struct

import pytest

from spantable.operators import stats
from spantable.sources import autosql, native, text


def track(n=3000, kind="signal"):
    rng, out = random.Random(n), []
    for c, length in (("chr1", n * 40), ("chr10", n * 20), ("chr2", n * 10)):
        at = 0
        for _ in range(length // 40):
            at += rng.choice([0, 0, 7, 30]) if kind == "signal" else 3
            e = at + rng.randint(1, 25)
            out.append((c, at, e, rng.randint(1, 400) / 8) if kind == "signal" else (c, at, e, f"n{e}\t{at % 9}"))
            at = e if kind == "signal" else at
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_signal_round_trip(spark, tmp_path, compress):
    rows = track()
    t = text.from_rows(spark, rows)
    sizes = spark.createDataFrame([("chr1", 1 << 20), ("chr10", 1 << 20), ("chr2", 1 << 20), ("chr9", 5)], "chrom string, length long")
    path = str(tmp_path / "a.bw")
    native.write_native(t, sizes, path, native.WriteOptions(compress=compress, items_per_slot=100, block_size=4))
    file = native.NativeFile(path)
    assert [(c, n) for c, _, n in file.chroms] == [("chr1", 1 << 20), ("chr10", 1 << 20), ("chr2", 1 << 20)]
    back = native.read_native(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    part = back.filter("chrom = 'chr10' and e > 1000 and s < 3000")
    assert sorted(map(tuple, part.collect())) == sorted(r for r in rows if r[0] == "chr10" and r[2] > 1000 and r[1] < 3000)
    want = stats.track_summary(t).first()
    assert {k: file.summary()[k] for k in ("bases", "min", "max", "sum")} == {k: want[k] for k in ("bases", "min", "max", "sum")}
    assert file.info()["compressed"] is compress and file.zooms
    for z in file.zooms:
        level = native.read_native(spark, path, z)
        assert level.agg({"bases": "sum"}).first()[0] == want["bases"]
    few = file.blocks(hits=lambda lo, hi: lo <= (1, 3000) and hi >= (1, 1000))
    assert 0 < len(few) < len(file.blocks())
    assert autosql.describe(file.declaration())["fields"][3][0] == "value"
    with pytest.raises(KeyError):
        native.read_native(spark, path, 7)
    with pytest.raises(KeyError):
        file.length("chr77")
    assert native.native_chroms(spark, path).count() == 3


def test_feature_round_trip(spark, tmp_path):
    rows = track(500, "bed")
    t = text.from_rows(spark, rows, "bed")
    sizes = spark.createDataFrame([(c, 1 << 20) for c in ("chr1", "chr10", "chr2")], "chrom string, length long")
    path = str(tmp_path / "a.bb")
    native.write_native(t, sizes, path, native.WriteOptions(items_per_slot=64, zooms=[100]))
    file = native.NativeFile(path)
    assert file.items == len(rows) and file.fields == 5 and sorted(file.zooms) == [100]
    assert sorted(map(tuple, native.read_native(spark, path).collect())) == sorted(rows)
    assert len(autosql.describe(file.declaration())["fields"]) == 5


def test_all_section_kinds_in_both_byte_orders(tmp_path):
    for o in "<>":
        sections = [
            struct.pack(o + native.SECTION, 0, 10, 30, 0, 0, 1, 0, 2) + struct.pack(o + "IIfIIf", 10, 20, 1.5, 20, 30, 2.5),
            struct.pack(o + native.SECTION, 0, 40, 55, 0, 5, 2, 0, 2) + struct.pack(o + "IfIf", 40, 1.0, 50, 2.0),
            struct.pack(o + native.SECTION, 0, 60, 90, 10, 4, 3, 0, 3) + struct.pack(o + "fff", 3.0, 4.0, 5.0),
        ]
        names = struct.pack(o + native.NAMES_HEADER, native.NAMES_MAGIC, 1, 4, 8, 1, 0) + struct.pack(o + "BBH", 1, 0, 1) + b"chrA" + struct.pack(o + "II", 0, 100)
        at = 64 + len(names) + 8
        entries, data = [], b""
        for s in sections:
            c, a, b = struct.unpack_from(o + "III", s)
            entries.append(struct.pack(o + "IIIIQQ", c, a, c, b, at + len(data), len(s)))
            data += s
        index = struct.pack(o + native.INDEX_HEADER, native.INDEX_MAGIC, 3, 3, 0, 10, 0, 90, 0, 3, 0) + struct.pack(o + "BBH", 1, 0, 3) + b"".join(entries)
        head = struct.pack(o + native.HEADER, native.SIGNAL_MAGIC, 3, 0, 64, at - 8, at + len(data), 0, 0, 0, 0, 0, 0)
        path = tmp_path / "x.bw"
        path.write_bytes(head + names + struct.pack(o + "Q", 3) + data + index)
        f = native.NativeFile(str(path))
        got = [tuple(r.values()) for b in f.read(f.blocks()) for r in b.to_pylist()]
        assert got == [("chrA", 10, 20, 1.5), ("chrA", 20, 30, 2.5), ("chrA", 40, 45, 1.0), ("chrA", 50, 55, 2.0), ("chrA", 60, 64, 3.0), ("chrA", 70, 74, 4.0), ("chrA", 80, 84, 5.0)]
        assert f.summary()["bases"] == 0
    (tmp_path / "y").write_bytes(b"\0" * 80)
    with pytest.raises(native.NativeError):
        native.NativeFile(str(tmp_path / "y"))
