"""Token-id output as wavelet matrices: one compressed, searchable file per shard.

File format (little-endian): the magic WMX1, u16 planes, u16 zero, u64 tokens,
u64 documents, then planes + 3 sections, each u64 length and a zstd frame:
zeros (u64 per plane), document ids (i64; the least value stands for null),
document lengths (u64), and the bit planes from the most significant one, bits
packed from the high end of each byte.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantable.cluster import scratch, shared_path, ship, stage
from spantable.llm.text import take_over
from spantable.llm.tokens import END, TOKENIZER, word_tokens
from spantable.sources import storage

MAGIC = b"WMX1"
HEAD = struct.Struct("<4sHHQQ")
#: A shard is closed before it exceeds this, unless one document alone does.
SHARD_TOKENS = 1 << 22
NULL_ID = -(1 << 63)
#: Tasks that read shards back at most.
MAX_TASKS = 10_000
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Sequence of ids below 2^planes with rank and select on succinct bit planes.

    Both use a directory of a plane, the ones before each block of 64 bytes,
    which is made when the plane is first asked.
    """

    def __init__(self, n: int, planes: Sequence[np.ndarray], zeros: list[int]) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros
        self._blocks: list[np.ndarray | None] = [None] * len(planes)

    def _directory(self, plane: int) -> np.ndarray:
        """Ones before each block of 64 bytes, and all ones."""
        if self._blocks[plane] is None:
            raw = self.planes[plane]
            per = np.add.reduceat(_ONES[raw], np.arange(0, len(raw), 64), dtype=np.int64) if len(raw) else np.zeros(0, np.int64)
            self._blocks[plane] = np.concatenate(([0], np.cumsum(per)))
        return self._blocks[plane]

    @classmethod
    def build(cls, ids: np.ndarray, planes: int) -> WaveletMatrix:
        """One stable partition a plane, from the most significant bit."""
        packed, zeros = [], []
        for k in range(planes - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << k)) != 0
            packed.append(np.packbits(ones))
            low, high = ids[~ones], ids[ones]
            zeros.append(len(low))
            ids = np.concatenate((low, high))
        return cls(len(ids), packed, zeros)

    def _rank1(self, plane: int, i: np.ndarray) -> np.ndarray:
        """Ones before position i: counts up to each block of 64 bytes, then bytes, then bits."""
        raw, ones = self.planes[plane], self._directory(plane)
        byte, block = i >> 3, i >> 9
        out = ones[block].copy()
        width = int((byte - block * 64).max(initial=0))
        at = block[:, None] * 64 + np.arange(width)
        inside = at < byte[:, None]
        out += np.where(inside, _ONES[raw[np.minimum(at, max(0, len(raw) - 1))]], 0).sum(1, dtype=np.int64) if width else 0
        rest = i & 7
        last = np.where(rest > 0, raw[np.minimum(byte, max(0, len(raw) - 1))], 0) if len(raw) else np.zeros(len(i), np.uint8)
        return out + _ONES[last & (0xFF00 >> rest).astype(np.uint8)]

    def _bit(self, plane: int, i: np.ndarray) -> np.ndarray:
        return self.planes[plane][i >> 3] >> (7 - (i & 7)).astype(np.uint8) & 1

    def access(self, positions) -> np.ndarray:
        """The ids at these positions."""
        i, out = np.asarray(positions, np.int64), np.zeros(np.shape(positions), np.int64)
        for p, z in enumerate(self.zeros):
            bit, ones = self._bit(p, i).astype(np.int64), self._rank1(p, i)
            out = out << 1 | bit
            i = np.where(bit, z + ones, i - ones)
        return out

    def rank(self, symbol: int, i: int) -> int:
        """How often symbol occurs before position i."""
        lo, hi = self._range(symbol, 0, i)
        return hi - lo

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """How often symbol occurs at positions from lo to hi - 1."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return max(0, b - a)

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        ends = np.clip(np.array([lo, hi], np.int64), 0, self.n)
        if symbol < 0 or symbol >> len(self.planes):
            return 0, 0
        for p, z in enumerate(self.zeros):
            ones = self._rank1(p, ends)
            ends = z + ones if symbol >> (len(self.planes) - 1 - p) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def select(self, symbol: int, nth) -> np.ndarray:
        """Positions of the occurrences of symbol with these numbers, from 0; beyond the last: -1."""
        nth = np.atleast_1d(np.asarray(nth, np.int64))
        lo, hi = self._range(symbol, 0, self.n)
        found = (nth >= 0) & (nth < hi - lo)
        i = np.where(found, lo + nth, 0)
        for p in range(len(self.planes) - 1, -1, -1):
            one = symbol >> (len(self.planes) - 1 - p) & 1
            i = self._select(p, i - self.zeros[p] if one else i, bool(one))
        return np.where(found, i, -1)

    def _select(self, plane: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """Places of the ones, or zeros, with these numbers: the block by the directory, the bit by counting within the block."""
        raw, before = self.planes[plane], self._directory(plane)
        if not one:
            before = np.arange(len(before)) * 512 - before
        out = np.zeros(len(nth), np.int64)
        for at in range(0, len(nth), 4096):
            some = np.clip(nth[at : at + 4096], 0, None)
            block = np.clip(np.searchsorted(before, some, side="right") - 1, 0, max(0, len(before) - 2))
            bytes_ = block[:, None] * 64 + np.arange(64)
            held = np.where(bytes_ < len(raw), raw[np.minimum(bytes_, len(raw) - 1)], 0).astype(np.uint8) if len(raw) else np.zeros(bytes_.shape, np.uint8)
            bits = np.unpackbits(held, axis=1)
            upto = np.cumsum(bits if one else 1 - bits, axis=1, dtype=np.int16)
            out[at : at + 4096] = block * 512 + np.argmax(upto > (some - before[block])[:, None], axis=1)
        return out

    def positions(self, symbol: int) -> np.ndarray:
        """All positions of symbol, ascending."""
        return self.select(symbol, np.arange(self.count(symbol)))

    def decode(self) -> np.ndarray:
        """The whole sequence: each plane's partition undone, from the least significant bit."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, z in enumerate(reversed(self.zeros)):
            ones = np.unpackbits(self.planes[len(self.zeros) - 1 - k], count=self.n).view(bool)
            before = np.empty_like(out)
            before[~ones], before[ones] = out[:z], out[z:] | out.dtype.type(1 << k)
            out = before
        return out


def write_shard(doc_ids: list[int | None], docs: list[np.ndarray], planes: int) -> bytes:
    """A shard file of these documents' ids, in this order."""
    dtype = np.uint16 if planes <= 16 else np.uint32
    ids = np.concatenate(docs).astype(dtype, copy=False) if docs else np.zeros(0, dtype)
    m = WaveletMatrix.build(ids, planes)
    pack = zstandard.ZstdCompressor(level=1).compress
    keys = np.array([NULL_ID if x is None else x for x in doc_ids], "<i8")
    parts = [np.array(m.zeros, "<u8").tobytes(), keys.tobytes(), np.array([len(d) for d in docs], "<u8").tobytes(), *(p.tobytes() for p in m.planes)]
    out = [HEAD.pack(MAGIC, planes, 0, m.n, len(docs))]
    for p in parts:
        z = pack(p)
        out += [struct.pack("<Q", len(z)), z]
    return b"".join(out)


class _Planes(Sequence):
    """Bit planes that are read and unpacked when first needed."""

    def __init__(self, load: Callable[[int], bytes], n: int) -> None:
        self.load, self.held = load, [None] * n

    def __len__(self) -> int:
        return len(self.held)

    def __getitem__(self, k: int) -> np.ndarray:
        if self.held[k] is None:
            self.held[k] = np.frombuffer(self.load(k), np.uint8)
        return self.held[k]


class Shard:
    """An open shard: document table and wavelet matrix. source: the bytes of a file, or something with read_at(n, at).

    Opening reads the header and the tables; a plane is read and unpacked when
    it is first needed.
    """

    def __init__(self, source) -> None:
        read = (lambda n, at: source[at : at + n]) if isinstance(source, bytes) else source.read_at
        head = bytes(read(HEAD.size, 0))
        if len(head) < HEAD.size or head[:4] != MAGIC:
            raise ValueError("no shard file")
        _, planes, _, n, docs = HEAD.unpack(head)
        at, places = HEAD.size, []
        for _ in range(planes + 3):
            size = struct.unpack("<Q", bytes(read(8, at)))[0]
            places.append((size, at + 8))
            at += 8 + size

        def part(k: int) -> bytes:
            size, place = places[k]
            return zstandard.ZstdDecompressor().decompress(bytes(read(size, place)), max_output_size=1 << 40) if size else b""

        self.doc_ids = np.frombuffer(part(1), "<i8")
        self.lengths = np.frombuffer(part(2), "<u8").astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:docs]
        self.tokens = WaveletMatrix(n, _Planes(lambda k: part(k + 3), planes), np.frombuffer(part(0), "<u8").astype(int).tolist())


def write_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """Write the shard files of docs(doc_id, text); returns part, shard, n_tokens, n_docs, n_bytes, path and file, one row a file.

    Tasks write the files part-shard.wmx into `folder`, which all executors
    share; by default into a new one in the shared folder, which goes with the
    application. A file is there whole or not at all, and a task that runs again
    writes the same. Where tasks cannot write, a store that only Spark reaches,
    `file` holds the bytes instead of `path`.

    Documents lie in the order of doc_id, null first, ties by the first 64 bytes
    of text and then by a hash of it, across (part, shard). Ranges of this order
    are dealt to the tasks before anything is encoded, so that rows without an
    id, with one id, and equal rows are dealt out too; texts move once and ids
    never. A null text counts as empty. A document is never split. An empty
    table gives no shards.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_path(spark, "token-files")
    to_files = storage.is_writable(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.xxhash64("text"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    names = ["part", "shard", "n_tokens", "n_docs", "n_bytes", "path", "file"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("tokens")
        enc = word_tokens(tokenizer, end)
        planes = max(1, int(max(enc.tok.get_vocab_size() - 1, end)).bit_length())
        part, shard, ids, held, total = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            data, path = write_shard(ids, held, planes), None
            if to_files:
                path = f"{folder}/{part:06d}-{shard:06d}.wmx"
                storage.write_whole(path, data)
            row = [pa.array([x], pa.int64()) for x in (part, shard, total, len(ids), len(data))]
            return pa.RecordBatch.from_arrays([*row, pa.array([path], pa.string()), pa.array([None if path else data], pa.binary())], names=names)

        for b in batches:
            texts = b.column("text")
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                t = enc.encode(texts[i].as_py())
                if held and total + len(t) > shard_tokens:
                    yield close()
                    shard, ids, held, total = shard + 1, [], [], 0
                ids.append(d)
                held.append(t)
                total += len(t)
        if held:
            yield close()

    return stage(rows.mapInArrow(encode, "part long, shard long, n_tokens long, n_docs long, n_bytes long, path string, file binary"), "token-shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """One row per document of the shard files that write_tokens() lists: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ship(shards.sparkSession)
    names = ["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with storage.open_file(row["path"]) if row["path"] else nullcontext(row["file"]) as f:
                    s = Shard(f)
                    ids = s.tokens.decode().astype("<u4")
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(s.starts.tolist(), s.lengths.tolist())]
                same = [np.full(len(crc), row[c], np.int64) for c in ("part", "shard")]
                key = pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == NULL_ID)
                yield pa.RecordBatch.from_arrays([pa.array(same[0]), pa.array(same[1]), key, pa.array(s.starts), pa.array(s.lengths), pa.array(crc, pa.int64())], names=names)

    # the list is small but each of its files is not: a task for about two of them, whatever the list's size
    dealt = shards.select("part", "shard", "path", "file").repartition(max(1, min(MAX_TASKS, -(-shards.count() // 2))), "part", "shard")
    docs = dealt.mapInArrow(decode, "part long, shard long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    # ids before each shard: sums by part, then within each part
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    with scratch() as keep:
        bases = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inner")).join(first, "part")
        bases = stage(bases.select("part", "shard", (F.col("first") + F.col("inner")).alias("base")), "token-bases")
        keep.append(bases)
    return docs.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")))
