"""op1, op2 and op10: DuckDB, brute force and round trips, with odd rows."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spantable.llm import mixing, tiff, topk

DOCS = "doc_id long, text string, source string, mix_size string, plan int"


def odd_docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "é", "z", None]), "x", 1) for i in range(300)]
    rows += [(None, "no id here", "a", None, None), (None, "no id here", "a", None, None), (7, "again again", "b", None, 0), (7, "again again", "b", None, 0)]
    rows += [(1000, None, "a", None, None), (1001, "", "b", None, None), (1002, "\t \n", None, None, None), (1003, "long " * 20_000, "a", None, None), (1004, None, "empty", None, None)]
    return spark.createDataFrame(rows, DOCS)


def duck(sql, **tables):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.execute(sql).fetchall()


def test_mix_matches_sql_and_targets(spark):
    docs = odd_docs(spark)
    out = mixing.mix(docs).select("doc_id", "mix_size", "mix_source_size", "mix_target", "mix_taken", "source", "plan").collect()
    got = sorted((repr(tuple(r)[:5]) for r in out))
    table = pa.table({"doc_id": pa.array([r[0] for r in docs.collect()], pa.int64()), "text": pa.array([r[1] for r in docs.collect()]), "source": pa.array([r[2] for r in docs.collect()])})
    want = duck(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})", documents=table)
    assert got == sorted(repr(tuple(r)) for r in want)
    by = {}
    for r in out:
        assert r["mix_taken"] <= 2 * r["mix_size"]
        t = by.setdefault(r["source"], [r["mix_target"], r["mix_source_size"], 0])
        t[2] += r["mix_taken"]
    total = sum(x[1] for x in by.values())
    assert sum(x[0] for x in by.values()) == pytest.approx(1.5 * total)
    longest = {name: max(r["mix_size"] for r in out if r["source"] == name) for name in by}
    assert all(abs(taken - target) <= max(1, longest[name] / 2) for name, (target, _, taken) in by.items())
    again = mixing.mix(docs.repartition(7)).select("doc_id", "mix_size", "mix_taken").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixing.mix(docs).select("doc_id", "mix_size", "mix_taken").collect())


def test_mix_empty_and_one_source(spark):
    docs = odd_docs(spark)
    assert mixing.mix(docs.filter("false")).count() == 0
    none = mixing.mix(docs.filter("source = 'empty'")).first()
    assert (none["mix_taken"], none["mix_target"]) == (0, 0.0)
    one = mixing.mix(docs.filter("source = 'b'")).agg(F.sum("mix_taken"), F.max("mix_target")).first()
    assert one[0] == pytest.approx(one[1], rel=0.02)


def test_mix_decides_equal_rows_one_by_one(spark):
    """Rows that share an id or lack one, and equal rows: the source still comes within half a document of its target."""
    docs = [(5, "w " * 50, "a")] * 40 + [(None, "w " * 50, "b")] * 40 + [(None, f"x{i} " * 50, "b") for i in range(10)] + [(9, f"y{i} " * 30, None) for i in range(40)] + [(i, "", "c") for i in range(4)] + [(7, "z", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix(df.repartition(3)).collect()
    by = {}
    for r in out:
        t = by.setdefault(r["source"], [r["mix_target"], 0])
        t[1] += r["mix_taken"]
        assert r["mix_copies"] <= 2 and r["mix_taken"] == r["mix_copies"] * r["mix_size"]
    assert len(out) == len(docs) and all(abs(t - n) <= 25 for t, n in by.values()), by
    table = pa.table({c: pa.array([r[i] for r in docs], t) for i, (c, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())))})
    want = duck(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.SQL})", documents=table)
    assert sorted(repr((r["doc_id"], r["mix_size"], r["mix_source_size"], r["mix_target"], r["mix_taken"])) for r in out) == sorted(map(repr, want))


def test_capped_sources_with_empty_documents_get_two_copies(spark):
    """A source at its clamp needs nothing beyond whole copies: an empty document is not taken a third time."""
    docs = [(i, "w " * (i % 3), "a") for i in range(12)] + [(100 + i, "w " * 200, "b") for i in range(20)]
    out = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).filter("source = 'a'").collect()
    assert {r["mix_copies"] for r in out} == {2}


def brute_top(rows, k, every, scale=64):
    ok = [(i, np.floor(scale * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, x) in enumerate(ok):
        if q % every == 0:
            best = sorted((-int(x[: len(y)] @ y[: len(x)]), i) for m, (i, y) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["spread", "copies", "few"])
def test_top_k(spark, shape):
    rng = np.random.default_rng(5)
    n = {"spread": 400, "copies": 300, "few": 6}[shape]
    x = rng.normal(0, 0.2, (n, 12)).round(3).astype(np.float32)
    if shape == "copies":
        x[: n // 2] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.1] * 11 + [None]), (1040, [float("nan")] * 12), (1060, [float("inf")] * 12), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("id", F.lit(1))
    got = topk.top_k(df, shard_rows=64, block_queries=8).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20, 20)
    assert topk.top_k(df.filter("false")).count() == 0


def test_top_k_of_zeros_and_repeats(spark):
    rows = [(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, -1.0]), (2, [1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, every=2, k=3).collect()))
    assert got == sorted([(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 2, 0), *2 * [(2, 1, 2, 128 * 64), (2, 2, 0, 0), (2, 3, 1, 0)]])


def test_top_k_takes_every_row_of_a_repeated_id(spark, tmp_path):
    """Rows of one id with different vectors, of queries too: as the SQL has it, and as brute force has it."""
    rng = np.random.default_rng(11)
    rows = [(int(i), rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in rng.integers(0, 90, 500)]
    rows += [(20, [1.0] * 6), (1, [0.5] * 6), (1, [0.875] * 6), (2, [0.25] * 6), (40, []), (60, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in topk.query(spark, str(tmp_path)).collect())
    assert got == brute_top(rows, 20, 20)
    same = [(i, v) for i, v in rows if len(v) == 6]  # the SQL wants vectors of one length
    table = pa.table({"vec_id": pa.array([i for i, _ in same]), "embedding": pa.array([v for _, v in same], pa.list_(pa.float32()))})
    want = duck(f"SELECT query_id, rank, vec_id, score FROM ({topk.SQL})", embeddings=table)
    small = spark.createDataFrame(same, "vec_id long, embedding array<float>")
    for shard, block in ((32, 3), (8192, 4096)):
        assert sorted(map(tuple, topk.top_k(small, shard_rows=shard, block_queries=block).select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_impact_index_skips_segments_on_proof():
    """Far better rows end the search before the last level, with the right result."""
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(0, 4, (400, 8)))
    rows[7], rows[9], query = 60, 55, np.full(8, 3.0)
    index = topk.ImpactIndex(rows, np.arange(400), np.arange(400))
    for i in (0, 1):
        index.segments[i] = None  # the lowest levels must not be touched
    ((at, score),) = index.search(query[None], np.array([-1]), 1)
    assert (at.tolist(), score.tolist()) == ([7], [60 * 24.0])
    sparse = [i for i, s in enumerate(index.segments) if isinstance(s, list) and s]
    assert sparse and any(isinstance(s, np.ndarray) for s in topk.ImpactIndex(rows, np.arange(400), np.arange(400)).segments)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 7, (50, 37), np.uint8), np.full((9, 64), 200, np.uint8), rng.integers(0, 60000, (33, 20, 3)).astype(np.uint16), np.arange(12000, dtype=np.uint8).reshape(100, 120)]
    for order in "<>":
        for big in (False, True):
            data = tiff.write_pages(pages, compression, predictor, tile, strip=700, order=order, big=big)
            back = list(tiff.read_pages(data))
            assert len(back) == len(pages)
            for (say, a), p in zip(back, pages):
                assert (a == (p if p.ndim == 3 else p[:, :, None])).all() and say["compression"] == compression


def test_lzw_and_packbits_edges():
    rng = random.Random(2)
    for n in (0, 1, 2, 127, 128, 129, 5000, 70_000):
        for raw in (bytes(n), bytes(rng.randrange(256) for _ in range(n)), bytes(rng.randrange(3) for _ in range(n))):
            assert tiff.unpack_lzw(tiff.pack_lzw(raw), n) == raw
            assert tiff.unpack_bits(tiff.pack_bits(raw), n) == raw


def test_tiff_columns(spark):
    texts = ["", None, "a" * 64, "b" * 65, "é\0" * 500, "long text " * 60_000, "a" * 64]
    df = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, media string, page int")
    rows = {r["doc_id"]: r for r in tiff.media_pages(tiff.text_to_media(df), ["doc_id", "n_bytes"]).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], bytes(r["samples"]), r["tail_crc32"], r["page"]) == (len(raw), full, zlib.crc32(full[-64:]), 0)
        assert r["samples_sha256"] == hashlib.sha256(full).hexdigest()
    assert rows[2]["media_sha256"] == rows[6]["media_sha256"]
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"II*\0junk")), (3, bytearray(b"nope")), (4, bytearray(tiff.write_pages([np.zeros((4, 4), np.uint8)] * 2)))], "k long, media binary")
    out = tiff.media_pages(bad, ["k"]).select("k", "page", "error").collect()
    assert sorted((r["k"], r["page"], bool(r["error"])) for r in out if r["page"] is not None) == [(4, 0, False), (4, 1, False)]
    assert sorted(r["k"] for r in out if r["page"] is None) == [1, 2, 3]
    assert tiff.media_pages(bad.filter("false"), ["k"]).count() == 0


def hand_made(pages):
    """A little-endian TIFF put together from (tags, data of its strips), as the specification has it; no writer of the package is used."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for tags, strips in pages:
        places = []
        for x in strips:
            places.append(len(out))
            out += x
        entries = [(t, 4, [v]) for t, v in tags.items()] + [(273, 4, places), (279, 4, [len(x) for x in strips])]
        raw = []
        for tag, kind, values in sorted(entries):
            body = struct.pack(f"<{len(values)}I", *values)
            if len(body) > 4:
                at = len(out)
                out += body
                body = struct.pack("<I", at)
            raw.append(struct.pack("<HHI", tag, kind, len(values)) + body)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(raw)) + b"".join(raw)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def test_tiff_of_another_encoder():
    """Strips written out by hand: the LZW example of the specification, a PackBits example, 1-bit and 4-bit rows, separate planes."""
    lzw = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    lzw = int(lzw.ljust(-(-len(lzw) // 8) * 8, "0"), 2).to_bytes(-(-len(lzw) // 8), "big")
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    unpacked = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    pages = [
        ({256: 9, 257: 1, 258: 8, 259: 5}, [lzw]),
        ({256: 24, 257: 1, 258: 8, 259: 32773}, [packed]),
        ({256: 10, 257: 3, 258: 1, 259: 1, 278: 2}, [bytes((0b10110011, 0b01000000, 0b11111111, 0b11000000)), bytes((0, 0b01000000))]),
        ({256: 3, 257: 2, 258: 4, 259: 1}, [bytes((0x1F, 0x30, 0xA2, 0xC0))]),
        ({256: 2, 257: 2, 258: 8, 259: 8, 277: 3, 284: 2}, [zlib.compress(bytes(range(i, i + 4))) for i in (0, 10, 20)]),
    ]
    got = [a for _, a in tiff.read_pages(hand_made(pages))]
    assert got[0].ravel().tolist() == [7, 7, 7, 8, 8, 7, 7, 6, 6]
    assert got[1].tobytes() == unpacked
    assert got[2][:, :, 0].tolist() == [[1, 0, 1, 1, 0, 0, 1, 1, 0, 1], [1] * 10, [0] * 9 + [1]]
    assert got[3][:, :, 0].tolist() == [[1, 15, 3], [10, 2, 12]]
    assert got[4].tolist() == [[[0, 10, 20], [1, 11, 21]], [[2, 12, 22], [3, 13, 23]]]


def test_a_bad_page_is_its_own_error(spark):
    """Pages around one that cannot be read are read, and stated sizes are not believed."""
    good, kind = ({256: 4, 257: 1, 258: 8, 259: 1}, [b"abcd"]), ({256: 4, 257: 1, 258: 8, 259: 7}, [b"jpeg"])
    huge, float_ = ({256: 1 << 31, 257: 1 << 31, 258: 8, 259: 1}, [b"abcd"]), ({256: 1, 257: 1, 258: 32, 259: 1, 339: 3}, [b"abcd"])
    far = ({256: 4096, 257: 4096, 258: 8, 259: 8}, [zlib.compress(b"little")])
    df = spark.createDataFrame([(1, bytearray(hand_made([good, kind, good, huge, float_, far, good])))], "page long, media binary")
    rows = tiff.media_pages(df.withColumnRenamed("page", "k"), ["k"]).orderBy("page").collect()
    assert [(r["page"], r["error"] is None) for r in rows] == [(0, True), (1, False), (2, True), (3, False), (4, False), (5, False), (6, True)]
    assert bytes(rows[6]["samples"]) == b"abcd"


def test_tiff_fuzz():
    """Flipped bytes give pages or TiffErrors, never anything else."""
    rng = random.Random(6)
    page = np.arange(600, dtype=np.uint8).reshape(20, 30)
    for big in (False, True):
        for compression in tiff.PACK:
            data = tiff.write_pages([page, page], compression, strip=200, big=big, tile=(16, 16) if compression == tiff.LZW else None)
            for _ in range(400):
                bad = bytearray(data)
                for _ in range(rng.randint(1, 4)):
                    bad[rng.randrange(len(bad)) if rng.random() < 0.5 else rng.randrange(len(bad) - 150, len(bad))] = rng.choice([0, 1, 255, rng.randrange(256)])
                for found in tiff.walk_pages(bytes(bad[: rng.choice([len(bad), rng.randrange(len(bad))])])):
                    assert isinstance(found, tiff.TiffError) or found[1].ndim == 3
