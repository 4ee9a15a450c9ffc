"""TIFF columns: walk image directories, decode strips and tiles, one row per page.

Classic and big TIFF in both byte orders; unsigned samples of 1, 2, 4, 8, 16 and
32 bits, together or in separate planes; compressions none, PackBits, LZW and
deflate; predictors none and horizontal difference.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructType

from spantable.cluster import ship

# Fixed values of the TIFF 6.0 specification.
NONE, LZW, DEFLATE, PACKBITS, DEFLATE_OLD = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 266, 284, 317, 322, 323, 324, 325, 339
FORMATS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}

# The most bytes that one byte of data can stand for: a PackBits run, an LZW code (12 bits for up to 3,840 bytes), a deflate match.
GROWTH = {NONE: 1, PACKBITS: 64, LZW: 2560, DEFLATE: 1032, DEFLATE_OLD: 1032}

ROW = 64
STRIP = 65536
#: Bytes of a page's samples that a reader unfolds at most; a larger page is an error of that page.
MAX_PAGE = 1 << 30


class TiffError(ValueError):
    """The bytes are no TIFF that this reader knows."""


class BrokenFile(TiffError):
    """The chain of image directories cannot be followed: no page is at fault."""


def pack_bits(raw: bytes) -> bytes:
    """PackBits: runs of 2 to 128 equal bytes, literals of 1 to 128 bytes."""
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and raw[j] == raw[i]:
            j += 1
        if j - i >= 2:
            out += bytes((257 - (j - i), raw[i]))
        else:
            while j < n and j - i < 128 and (j + 1 >= n or raw[j] != raw[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + raw[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        if i >= len(data):
            raise TiffError("PackBits data end early")
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += 2 + c
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def pack_lzw(raw: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, changing width one code early."""
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table, width, w = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, 9)
    for c in raw:
        x = w + bytes((c,))
        if x in table:
            w = x
            continue
        put(table[w], width)
        table[x] = len(table) + 2
        if table[x] == 4093:
            put(256, 12)
            table, width = {bytes((i,)): i for i in range(256)}, 9
        elif table[x] + 1 >= 1 << width:
            width += 1
        w = bytes((c,))
    if w:
        put(table[w], width)
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    out, pos, held, bits, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    while len(out) < size:
        while bits < width:
            if pos >= len(data):
                raise TiffError("LZW data end early")
            held = (held << 8 | data[pos]) & 0xFFFFFF
            pos, bits = pos + 1, bits + 8
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise TiffError("LZW data begin without a clear code")
        if code < len(table):
            x = table[code]
        elif code == len(table) and last:
            x = last + last[:1]
        else:
            raise TiffError("bad LZW code")
        out += x
        if last:
            table.append(last + x[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = x
    if len(out) < size:
        raise TiffError("LZW data end early")
    return bytes(out[:size])


PACK = {NONE: lambda b: b, PACKBITS: pack_bits, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1)}


def _unpack(data: bytes, size: int, compression: int) -> bytes:
    if compression == NONE:
        out = data[:size]
    elif compression in (DEFLATE, DEFLATE_OLD):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"bad deflate data: {e}") from e
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = unpack_lzw(data, size)
    else:
        raise TiffError(f"compression {compression} is not known")
    if len(out) < size:
        raise TiffError("a strip or tile ends early")
    return out


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, strip: int = STRIP, order: str = "<", big: bool = False) -> bytes:
    """A TIFF with one image directory for each (height, width) or (height, width, samples) array of uint8 or uint16."""
    offset = "Q" if big else "I"
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        h, w, n = page.shape
        if predictor == 2:
            page = page.copy()
            page[:, 1:] -= page[:, :-1].copy() if tile is None else 0
        rows = max(1, strip // max(1, w * n * page.itemsize))
        if tile:
            th, tw = tile
            padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw, n), page.dtype)
            padded[:h, :w] = page
            parts = [padded[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
            if predictor == 2:
                parts = [np.concatenate((p[:, :1], p[:, 1:] - p[:, :-1]), 1) for p in parts]
        else:
            parts = [page[y : y + rows] for y in range(0, h, rows)]
        packed = [PACK[compression](np.ascontiguousarray(p.astype(p.dtype.newbyteorder(order))).tobytes()) for p in parts]
        offsets, sizes = [], [len(p) for p in packed]
        for p in packed:
            offsets.append(len(out))
            out += p
        entries = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8 * page.itemsize] * n), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if n >= 3 else 1]), SAMPLES: (3, [n]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        kind = 16 if big else 4
        if tile:
            entries |= {TILE_WIDTH: (4, [tile[1]]), TILE_HEIGHT: (4, [tile[0]]), TILE_OFFSETS: (kind, offsets), TILE_BYTES: (kind, sizes)}
        else:
            entries |= {STRIP_OFFSETS: (kind, offsets), STRIP_ROWS: (4, [rows]), STRIP_BYTES: (kind, sizes)}
        encoded = []
        for tag, (t, values) in sorted(entries.items()):
            raw = struct.pack(f"{order}{len(values)}{FORMATS[t]}", *values)
            if len(raw) > (8 if big else 4):
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + offset, at)
            encoded.append(struct.pack(order + "HH" + offset, tag, t, len(values)) + raw.ljust(8 if big else 4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + struct.calcsize(offset)] = struct.pack(order + offset, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(encoded)) + b"".join(encoded)
        link = len(out)
        out += struct.pack(order + offset, 0)
    if not big and len(out) >= 1 << 32:
        raise TiffError("more than 4 GB need the big form")
    return bytes(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and tags of each image directory; raises where the chain of directories cannot be followed."""
    if data[:2] not in (b"II", b"MM") or len(data) < 8:
        raise BrokenFile("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    try:
        magic = struct.unpack_from(order + "H", data, 2)[0]
        if magic not in (42, 43):
            raise BrokenFile("no TIFF header")
        big = magic == 43
        offset, count, inline = ("Q", "Q", 8) if big else ("I", "H", 4)
        at, visited = struct.unpack_from(order + offset, data, 8 if big else 4)[0], set()
        while at:
            if at in visited:
                raise BrokenFile("the image directories form a loop")
            visited.add(at)
            n = struct.unpack_from(order + count, data, at)[0]
            at += struct.calcsize(order + count)
            entry = struct.calcsize(order + "HH" + offset) + inline
            if at + n * entry > len(data):
                raise BrokenFile("the file ends early")
            tags: dict[int, list[int]] = {}
            for _ in range(n):
                tag, kind, m = struct.unpack_from(order + "HH" + offset, data, at)
                place = at + entry - inline
                if kind in FORMATS:
                    size = m * struct.calcsize(FORMATS[kind])
                    if size > inline:
                        place = struct.unpack_from(order + offset, data, place)[0]
                    # values beyond the end are none: that spoils this page, not those after it
                    tags[tag] = list(struct.unpack_from(f"{order}{m}{FORMATS[kind]}", data, place)) if place + size <= len(data) else []
                at += entry
            yield order, tags
            at = struct.unpack_from(order + offset, data, at)[0]
    except (struct.error, OverflowError) as e:
        raise BrokenFile("the file ends early") from e


def _samples(raw: bytes, rows: int, width: int, bits: int, order: str) -> np.ndarray:
    """Rows of samples, each row filled up to whole bytes, as unsigned integers."""
    if bits >= 8:
        return np.frombuffer(raw, f"{order}u{bits // 8}").reshape(rows, width)
    each = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : width * bits].reshape(rows, width, bits)
    return np.packbits(each, axis=2)[:, :, 0] >> (8 - bits)


def _page(data: bytes, order: str, tags: dict[int, list[int]], max_page: int) -> tuple[dict, np.ndarray]:
    def one(tag: int, default: int | None = None) -> int:
        values = tags.get(tag, [] if default is None else [default])
        if not values or values[0] < 0:
            raise TiffError(f"tag {tag} is missing or has no value")
        return values[0]

    w, h, n, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) if one(SAMPLES, 1) > 1 else 1
    if not w or not h or not n:
        raise TiffError("a page has no size")
    if bits not in (1, 2, 4, 8, 16, 32) or len(set(tags.get(BITS, [1]))) > 1 or tags.get(SAMPLE_FORMAT, [1])[0] not in (1, 4):
        raise TiffError("samples of this kind are not known")
    if planar not in (1, 2) or predictor not in (1, 2) or predictor == 2 and bits < 8 or compression not in GROWTH or one(FILL_ORDER, 1) != 1:
        raise TiffError("planes, a predictor, a compression or an order of bits that is not known")
    tiled = TILE_OFFSETS in tags
    tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(h, one(STRIP_ROWS, h)))
    if not tw or not th:
        raise TiffError("strips or tiles have no size")
    planes, per = (n, 1) if planar == 2 else (1, n)
    across, down = -(-w // tw), -(-h // th)
    offsets, sizes = (tags[TILE_OFFSETS], tags.get(TILE_BYTES, [])) if tiled else (tags.get(STRIP_OFFSETS, []), tags.get(STRIP_BYTES, []))
    if len(offsets) < across * down * planes or len(sizes) < len(offsets):
        raise TiffError("strips or tiles are missing")
    offsets, sizes = offsets[: across * down * planes], sizes[: across * down * planes]
    row_bytes, wide = -(-tw * per * bits // 8), max(1, bits // 8)
    if h * w * n * wide > max_page:
        raise TiffError(f"a page of more than {max_page} bytes")
    for i, (at, size) in enumerate(zip(offsets, sizes)):
        rows = th if tiled else min(th, h - i % (across * down) // across * th)
        if at + size > len(data):
            raise TiffError("the file ends early")
        if rows * row_bytes > size * GROWTH[compression]:
            raise TiffError("a strip or tile ends early")
    out = np.zeros((h, w, n), f"=u{wide}")
    for i, (at, size) in enumerate(zip(offsets, sizes)):
        plane, place = divmod(i, across * down)
        y, x = place // across * th, place % across * tw
        rows = th if tiled else min(th, h - y)
        part = _samples(_unpack(data[at : at + size], rows * row_bytes, compression), rows, tw * per, bits, order).astype(out.dtype).reshape(rows, tw, per)
        if predictor == 2:
            part = np.cumsum(part, 1, dtype=part.dtype)
        out[y : y + rows, x : x + tw, plane : plane + per] = part[: h - y, : w - x]
    return {"compression": compression, "predictor": predictor, "parts": len(offsets), "tiled": tiled, "bits": bits}, out


def walk_pages(data: bytes, max_page: int = MAX_PAGE) -> Iterator[tuple[dict, np.ndarray] | TiffError]:
    """For each image directory: what it says and its samples as a (height, width, samples) array, or why they cannot be read.

    Whatever the bytes are, nothing else is raised, and no more memory is asked
    for than the data can fill or max_page allows. Where the chain of
    directories breaks, one error ends it.
    """
    directories = _directories(data)
    while True:
        try:
            order, tags = next(directories)
        except StopIteration:
            return
        except BrokenFile as e:
            yield e
            return
        try:
            yield _page(data, order, tags, max_page)
        except TiffError as e:
            yield e
        except (ValueError, IndexError, KeyError, OverflowError, MemoryError, struct.error) as e:
            yield TiffError(f"a page cannot be read: {type(e).__name__} {e}")


def read_pages(data: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """walk_pages() that raises at the first error."""
    for page in walk_pages(data):
        if isinstance(page, TiffError):
            raise page
        yield page


def payload(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8, and these bytes filled with zeros to a positive multiple of 64."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0")


def text_to_media(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with media: each text's payload as a one-page 8-bit gray TIFF, 64 samples wide, deflate strips, predictor 2; and n_bytes.

    Null counts as empty: a page of 64 zeros. A text of any length is one page
    of many strips. Columns named media or n_bytes are replaced.
    """
    ship(df.sparkSession)
    df = df.select([c for c in df.columns if c not in ("media", "n_bytes")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, text_col):
                out = []
                for text in b.column(text_col).to_pylist():
                    n, raw = payload(text)
                    out.append((write_pages([np.frombuffer(raw, np.uint8).reshape(-1, ROW)], big=len(raw) > 1 << 30), n))
                keep = {c: b.column(c) for c in b.schema.names}
                yield pa.RecordBatch.from_pydict(keep | {"media": pa.array([x[0] for x in out], pa.binary()), "n_bytes": pa.array([x[1] for x in out], pa.int64())})

    return df.mapInArrow(encode, StructType(list(df.schema.fields)).add("media", BinaryType()).add("n_bytes", LongType()))


def _slices(batch: pa.RecordBatch, col: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of one column at most, so that a few long values do not add up."""
    sizes = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(s)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def media_pages(df: DataFrame, key_cols: list[str], media_col: str = "media", samples: bool = True, max_page: int = MAX_PAGE) -> DataFrame:
    """One row per page of each TIFF in media_col: the key columns, and what the page holds.

    page (from 0), width, height, channels, bits, compression, predictor,
    parts, samples (binary, rows of 8-bit samples or of little-endian 16-bit
    or 32-bit ones, samples of less than 8 bits a byte each), media_bytes,
    media_sha256, error. A page that cannot be read has a row with its number
    and error; those before and after it have theirs. Null media, and bytes that
    are no TIFF or whose chain of pages breaks, have a row with error and
    without a page, after the pages before the break. `samples=False` leaves
    that column null.
    """
    ship(df.sparkSession)
    fields = "page int, width int, height int, channels int, bits int, compression int, predictor int, parts int, samples binary, samples_sha256 string, tail_crc32 long, sample_sum long, distinct int, media_bytes long, media_sha256 string, error string"
    spark_schema = StructType([df.schema[c] for c in key_cols])
    for f in StructType.fromDDL(fields):
        spark_schema.add(f)
    names = [f.name for f in StructType.fromDDL(fields)]
    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, media_col):
                at, rows = [], []
                for i, data in enumerate(b.column(media_col).to_pylist()):
                    if data is None:
                        at.append(i)
                        rows.append(dict.fromkeys(names) | {"error": "no media"})
                        continue
                    same = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                    for page, found in enumerate(walk_pages(data, max_page)):
                        at.append(i)
                        if isinstance(found, TiffError):
                            rows.append(dict.fromkeys(names) | same | {"page": None if isinstance(found, BrokenFile) else page, "error": str(found)})
                            continue
                        say, a = found
                        raw = a.astype(a.dtype.newbyteorder("<"), copy=False).tobytes()
                        values = np.count_nonzero(np.bincount(a.ravel())) if a.dtype.itemsize < 4 else len(np.unique(a))
                        rows.append(
                            same
                            | {k: say[k] for k in ("compression", "predictor", "parts", "bits")}
                            | {"page": page, "width": a.shape[1], "height": a.shape[0], "channels": a.shape[2], "samples": raw if samples else None, "error": None}
                            | {"samples_sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-64:]), "sample_sum": int(a.sum(dtype=np.int64)), "distinct": int(values)}
                        )
                keys = pa.table({c: b.column(c) for c in key_cols}).take(pa.array(at, pa.int64()))
                made = pa.Table.from_pylist(rows, schema=arrow)
                for c in names:
                    keys = keys.append_column(c, made[c])
                yield from keys.combine_chunks().to_batches()

    return df.select(*key_cols, media_col).mapInArrow(decode, spark_schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pages = media_pages(text_to_media(docs).drop("text"), ["doc_id", "n_bytes"], samples=False)
    return pages.select(
        "doc_id", "n_bytes", (F.col("width").cast("long") * F.col("height")).alias("payload_bytes"), F.col("samples_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256",
        F.format_string("%dx%d,%d parts,sum %d,%d values", "width", "height", "parts", "sample_sum", "distinct").alias("feature"),
    )
