"""A streamed signal ends up as a table, and a bad batch stops the stream."""

import pytest

from spantable.streaming import ingest


def test_append_checked(spark, tmp_path):
    sizes = spark.createDataFrame([("c", 100)], "chrom string, length long")
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bg").write_text("c\t0\t5\t1.5\nc\t5\t9\t2\n")
    ingest.append_checked(ingest.stream_bedgraph(spark, src), sizes, out, ck).awaitTermination()
    (tmp_path / "in/b.bg").write_text("c\t20\t25\t3\n")
    ingest.append_checked(ingest.stream_bedgraph(spark, src), sizes, out, ck).awaitTermination()
    got = spark.read.parquet(out).select("chrom", "s", "e", "v").collect()
    assert sorted(map(tuple, got)) == [("c", 0, 5, 1.5), ("c", 5, 9, 2.0), ("c", 20, 25, 3.0)]
    (tmp_path / "in/c.bg").write_text("c\t90\t101\t3\n")
    with pytest.raises(Exception, match="outside"):
        ingest.append_checked(ingest.stream_bedgraph(spark, src), sizes, out, ck).awaitTermination()
