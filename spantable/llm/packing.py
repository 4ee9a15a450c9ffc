"""Lexical retrieval packing: windows of a document and its BM25 neighbours."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spantable.cluster import BATCH_BYTES, batches_of, scratch, shared_path, ship, stage
from spantable.llm.text import take_over
from spantable.llm.tokens import END, TOKENIZER, word_tokens

WINDOW = 4096
#: What is left is packed in one index when it does not exceed these.
SHARD_TOKENS, SHARD_DOCS = 1 << 21, 4096
#: Windows that each chain fills at about.
CHAIN_WINDOWS = 6
#: Seeds that are searched for at once, documents scored at once, and terms scored by matrix products, those that most documents hold.
SEEDS, TOGETHER, DENSE = 6144, 256, 1024
#: Directions by which seeds and documents are sorted into blocks, and documents that are sorted at once.
KINDS, HELD = 8, 8192
#: Axes on which scores are estimated, every how many seeds one is shown all documents, and the share of the neighbours of these that an estimate may miss.
AXES, PROBE, MISSED = 48, 48, 0.05
#: Neighbours that all tasks together send back for a seed, about, and at most when many seeds ask for the same.
NEIGHBOURS, MOST_NEIGHBOURS = 192, 768
K1, B = 1.2, 0.75


class Bm25Shard:
    """An inverted index over one shard's documents; terms are token ids, document frequencies those of the corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        terms, tfs, owners = [], [], []
        for i, d in enumerate(docs):
            t, n = np.unique(d, return_counts=True)
            terms.append(t)
            tfs.append(n)
            owners.append(np.full(len(t), i, np.int64))
        self.n, self.begin = len(docs), np.concatenate(([0], np.cumsum([len(t) for t in terms])))
        term, tf, owner = np.concatenate(terms).astype(np.int64), np.concatenate(tfs), np.concatenate(owners)
        length = np.array([len(d) for d in docs], float)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / max(mean_length, 1.0)))
        self.term, self.weight = term, weight
        by_term = np.argsort(term.astype(np.uint16) if len(idf) <= 1 << 16 else term, kind="stable")  # 16 bits: radix sort
        self.owner, self.score = owner[by_term], weight[by_term]
        self.first = np.searchsorted(term[by_term], np.arange(len(idf) + 1))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 scores of all documents for all terms of a document."""
        spans = [slice(self.first[t], self.first[t + 1]) for t in self.term[self.begin[doc] : self.begin[doc + 1]]]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.score[s] for s in spans]), self.n)


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document, which has one at least, and how often each occurs."""
    ids = np.sort(ids, kind="stable")  # 16 bits: radix sort
    begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[begins], np.diff(begins, append=len(ids))


class Documents:
    """Some documents as the search sees them: keys, and postings of their terms with BM25 weights."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray, counts: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        self.keys, self.lengths, self.counts, self.term, self.weight = keys, lengths, counts, term, weight

    @classmethod
    def of(cls, keys: np.ndarray, lengths: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean_length: float) -> Documents:
        """Documents of these lengths, whose terms and how often each occurs lie end to end."""
        norm = np.repeat(K1 * (1 - B + B * lengths / max(mean_length, 1.0)), counts)
        return cls(keys, lengths, counts, term, (idf[term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32))

    @classmethod
    def joined(cls, some: list[Documents]) -> Documents:
        return cls(*(np.concatenate([getattr(d, c) for d in some]) for c in ("keys", "lengths", "counts", "term", "weight")))

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.keys)), self.counts)

    @cached_property
    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    def take(self, at: np.ndarray) -> Documents:
        """Those at these places."""
        n = self.counts[at]
        places = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return Documents(self.keys[at], self.lengths[at], n, self.term[places], self.weight[places])

    def dense(self, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the terms that have a column, documents by columns; and the places of the postings of all others."""
        at = column[self.term]
        x = np.zeros((len(self.keys), width), np.float32)
        some = at >= 0
        x[self.owner[some], at[some]] = self.weight[some]
        return x, np.flatnonzero(~some)


def directions(rows: np.ndarray, n: int = KINDS, rounds: int = 5) -> np.ndarray:
    """n directions about which these rows gather, by spherical k-means from rows far apart; they only order the work."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]), np.float32)
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    chosen = [0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(np.argmin((unit @ unit[chosen].T).max(1))))
    centres = unit[chosen]
    for _ in range(rounds):
        kind = (unit @ centres.T).argmax(1)
        sums = np.stack([unit[kind == k].sum(0) if (kind == k).any() else centres[k] for k in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def axes(rows: np.ndarray, n: int = AXES) -> np.ndarray:
    """The n directions, columns, that hold most of these rows; they only say where to look."""
    return np.ascontiguousarray(np.linalg.eigh(rows.T @ rows)[1][:, -n:])


class Seeds:
    """Whole documents as queries: for each the best of all documents that are shown to it, a block at a time.

    A seed is left out of a block when the greatest weights that its terms have
    in the block do not add up to what the worst of its best documents scores.
    With `estimate`, directions that hold most of what seeds ask for, a seed is
    left out already when no score in the block, estimated on these directions,
    comes near that. How near: every PROBE-th seed is shown all documents, and
    of the estimates of what these find best a share of MISSED may be lower.
    """

    def __init__(self, names: np.ndarray, terms: list[np.ndarray], idf: np.ndarray, mean_length: float, dense: np.ndarray, most: int, centres: np.ndarray | None = None, estimate: np.ndarray | None = None) -> None:
        self.idf, self.mean, self.most = idf, mean_length, most
        self.column, self.width = np.full(len(idf), -1), len(dense)
        self.column[dense] = np.arange(len(dense))
        wants = self._wants(terms, len(dense))
        self.centres = directions(wants[:: max(1, len(terms) // 1024)]) if centres is None else centres
        # seeds of a kind stand together, so that those a block concerns are mostly a slice
        self.order = order = np.argsort((wants @ self.centres.T).argmax(1), kind="stable") if len(terms) else np.zeros(0, np.int64)
        self.names, terms, self.wants = names[order], [terms[i] for i in order], wants[order]
        owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        term = np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64)
        at = self.column[term] < 0
        by_term = np.argsort(term[at], kind="stable")
        self.rare, self.rare_owner = term[at][by_term], owner[at][by_term]
        self.bar = np.full(len(terms), -1, np.float32)
        empty = np.zeros(0, np.int64)
        self._best = (empty, empty, empty, np.zeros(0, np.float32), np.zeros(0, np.float32))  # seed, key, length, score, estimate / score
        self._new: list[tuple] = []
        self._waiting = 0
        self.salt = (self.names * 0x9E3779B1 & 0xFFFFFFFF).astype(np.uint32) | np.uint32(1)
        self.axes, self.mapped = estimate, None if estimate is None else np.ascontiguousarray((self.wants @ estimate).T)
        self.probe = np.arange(len(terms)) % PROBE == 0
        self.near: float | None = None  # what an estimate must reach of a bar

    def _wants(self, terms: list[np.ndarray], width: int) -> np.ndarray:
        owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        at = self.column[np.concatenate(terms).astype(np.int64)] if terms else np.zeros(0, np.int64)
        wants = np.zeros((len(terms), width), np.float32)
        wants[owner[at >= 0], at[at >= 0]] = 1
        return wants

    @property
    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of the seed as given, key, length and score, best first for each seed."""
        if self._new:
            self._settle()
        return self.order[self._best[0]], *self._best[1:4]

    def in_turn(self, docs: Documents) -> Iterator[Documents]:
        """Blocks of documents: some that weigh most, which raise the bars, then those of a kind together, the heavier ones of each kind first."""
        kind = np.zeros(len(docs.keys), np.int64)
        for i in range(0, len(kind), 1024):
            x, _ = docs.take(np.arange(i, min(i + 1024, len(kind)))).dense(self.column, self.width)
            kind[i : i + 1024] = (x @ self.centres.T).argmax(1)
        order = np.argsort(-np.bincount(docs.owner, docs.weight, len(kind)), kind="stable")
        head, order = order[:TOGETHER], order[TOGETHER:]
        yield docs.take(head)
        by_kind = order[np.argsort(kind[order], kind="stable")]
        level = (np.arange(len(by_kind)) - np.searchsorted(kind[by_kind], kind[by_kind])) // TOGETHER
        at = np.argsort(level, kind="stable")
        group = (level * (len(self.centres) + 1) + kind[by_kind])[at]
        for some in np.split(by_kind[at], np.flatnonzero(np.diff(group)) + 1):
            if len(some):
                yield docs.take(some)

    def _concerned(self, docs: Documents, x: np.ndarray, rest: np.ndarray, guess: np.ndarray | None) -> slice | np.ndarray:
        """The seeds for which a document of this block may be among the best."""
        if guess is not None and self.near is not None:
            live = np.flatnonzero((guess.max(0) >= self.bar * self.near) | self.probe | (self.bar < 0))
        else:
            most = np.zeros(len(self.idf), np.float32)
            np.maximum.at(most, docs.term[rest], docs.weight[rest])
            bound = self.wants @ x.max(0) + np.bincount(self.rare_owner, most[self.rare], len(self.names))
            live = np.flatnonzero(bound * (1 + 1e-4) >= self.bar)  # far more than what single precision can lose
        if not len(live):
            return live
        span = slice(int(live[0]), int(live[-1]) + 1)
        return span if 4 * (span.stop - span.start) <= 5 * len(live) else live

    def show(self, keys: np.ndarray, docs: list[np.ndarray]) -> None:
        """Show documents, each as its ids."""
        parts = [_terms(d) for d in docs]
        lengths, counts = (np.array([len(x) for x in v], np.int64) for v in (docs, [t for t, _ in parts]))
        self.show_all(Documents.of(keys, lengths, counts, *(np.concatenate(v) for v in zip(*parts)), self.idf, self.mean))

    def show_all(self, docs: Documents) -> None:
        x, rest = docs.dense(self.column, self.width)
        guess = None if self.axes is None else (x @ self.axes) @ self.mapped
        which = self._concerned(docs, x, rest, guess)
        numbers = np.arange(len(self.names))[which]
        if not len(numbers):
            return
        score = x @ self.wants[which].T
        # the other terms: every pair of a posting of these documents and a seed that wants its term
        term, owner, weight = docs.term[rest].astype(np.int64), docs.owner[rest], docs.weight[rest]
        place = np.full(len(self.names), -1)
        place[numbers] = np.arange(len(numbers))
        asks = np.flatnonzero(place[self.rare_owner] >= 0)
        rare, rare_place = self.rare[asks], place[self.rare_owner[asks]]
        lo, hi = np.searchsorted(rare, term), np.searchsorted(rare, term, side="right")
        pairs = hi - lo
        seed = rare_place[np.repeat(lo - np.cumsum(pairs) + pairs, pairs) + np.arange(pairs.sum())]
        np.add.at(score.reshape(-1), np.repeat(owner * score.shape[1], pairs) + seed, np.repeat(weight, pairs))
        n = len(docs.keys)
        bar = self.bar[numbers]
        if n > self.most:
            # only the `most` best of these can be among the best
            bar = np.maximum(bar, np.where(bar < 0, np.partition(score, n - self.most, axis=0)[n - self.most] * np.float32(1 - 2e-6), bar)) if (bar < 0).any() else bar
        doc, at = np.nonzero(score * np.float32(1 + 2e-6) >= bar)
        s, seed, key = score[doc, at], numbers[at], docs.keys[doc]
        # scores that are equal in single precision come in an order of each seed's own, so that seeds do not all ask for the same copies
        spread = (key * 0x85EBCA77 & 0xFFFFFFFF).astype(np.uint32) * self.salt[seed]
        spread ^= spread >> np.uint32(15)
        s = (s * (1 + (spread >> np.uint32(24)) * 4e-9)).astype(np.float32)
        keep = s > self.bar[seed]
        ratio = np.zeros(np.count_nonzero(keep), np.float32) if guess is None else guess[doc[keep], seed[keep]] / np.maximum(s[keep], np.float32(1e-9))
        self._new.append((seed[keep], key[keep], docs.lengths[doc[keep]], s[keep], ratio))
        self._waiting += int(np.count_nonzero(keep))
        if (self.bar[numbers] < 0).any() or self._waiting > len(self.names) * self.most // 4:
            self._settle()

    def _settle(self) -> None:
        """Take what was found since the last time into the best of each seed, and raise the bars."""
        seed, key, length, s, ratio = (np.concatenate(v) for v in zip(self._best, *self._new))
        self._new, self._waiting = [], 0
        # by seed, then the greatest score; scores are not negative, so their bits are in the order of their values
        order = np.argsort(seed.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - s.view(np.uint32)))
        order = order[np.arange(len(order)) - np.searchsorted(seed[order], np.arange(len(self.names)))[seed[order]] < self.most]
        self._best = seed[order], key[order], length[order], s[order], ratio[order]
        count = np.bincount(self._best[0], minlength=len(self.names))
        full = np.flatnonzero(count == self.most)
        self.bar[full] = self._best[3][np.cumsum(count)[full] - 1]
        if self.axes is not None and len(full):
            known = self._best[4][self.probe[self._best[0]] & (self.bar[self._best[0]] >= 0)]
            self.near = float(np.quantile(known, MISSED)) if len(known) >= 256 else None


def _best_first(score: np.ndarray, n: int, first: int = 64) -> Iterator[int]:
    """The n places of greatest score, best first, equal ones by place; the rest is only ordered when it is asked for."""
    if n > first:
        bar = np.partition(score, len(score) - first)[len(score) - first]
        top = np.flatnonzero(score > bar)
        yield from top[np.argsort(-score[top], kind="stable")].tolist()
        yield from np.argsort(-score, kind="stable")[len(top) : n].tolist()
    else:
        yield from np.argsort(-score, kind="stable")[:n].tolist()


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length).

    The rest of the document that the last window cut, or else the first unused
    document, is a window's seed. Its unused neighbours follow, best first;
    the one that does not fit whole is cut. All windows are full; what remains
    at the end is cut into sequences whose lengths are powers of two.
    """
    index = Bm25Shard(docs, idf, mean_length)
    unused = np.ones(len(docs), bool)
    fresh = 0
    now: list[tuple[int, int, int]] = []
    room = window
    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            while fresh < len(docs) and not unused[fresh]:
                fresh += 1
            if fresh == len(docs):
                break
            rest = (fresh, 0)
            unused[fresh] = False
        seed = rest[0]
        queue: Iterator[int] = iter(())
        ranked = False
        while True:
            doc, start = rest
            take = min(room, len(docs[doc]) - start)
            now.append((doc, start, take))
            room -= take
            rest = (doc, start + take) if start + take < len(docs[doc]) else None
            if not room or rest:
                break
            if not ranked:
                queue, ranked = _best_first(np.where(unused, index.scores(seed), -1.0), int(np.count_nonzero(unused))), True
            nxt = next(queue, None)
            if nxt is None:
                break
            unused[nxt] = False
            rest = (nxt, 0)
        if not room:
            yield now
            now, room = [], window
    yield from _powers(now)


def _powers(now: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces cut into sequences whose lengths are powers of two."""
    while now:
        out, now = _cut(now, 1 << (sum(n for *_, n in now).bit_length() - 1))
        yield out


def _cut(now: list[tuple[int, int, int]], size: int) -> tuple[list, list]:
    out, left, now = [], size, list(reversed(now))
    while left:
        doc, start, n = now.pop()
        take = min(left, n)
        out.append((doc, start, take))
        left -= take
        if take < n:
            now.append((doc, start + take, n - take))
    return out, now[::-1]


def _windows(now: list[tuple[int, int, int]], window: int) -> tuple[list, list]:
    """Full windows of these pieces, and the pieces that remain."""
    full = []
    for _ in range(sum(n for *_, n in now) // window):
        out, now = _cut(now, window)
        full.append(out)
    return full, now


def _encoded(docs: DataFrame, tokenizer: str, end: int) -> tuple[DataFrame, DataFrame]:
    """The documents as ids and terms, twice the same staged table: as files, and as buckets by part, the task that encoded them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("tokens")
        enc, part_ = word_tokens(tokenizer, end), TaskContext.get().partitionId()
        key = part_ << 32
        for b in batches:
            texts = b.column("text")
            for at in range(0, b.num_rows, 1024):
                part = [enc.encode(x) for x in texts.slice(at, 1024).to_pylist()]
                bags = [_terms(x) for x in part]
                cols = [pa.array([x.tobytes() for x in c], pa.binary()) for c in (part, (t for t, _ in bags), (n.astype("<u4") for _, n in bags))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), part_)), pa.array(np.arange(key, key + len(part))), b.column("doc_id").slice(at, 1024), pa.array([len(x) for x in part], pa.int64()), *cols], names=["part", "key", "doc_id", "n", "ids", "terms", "tfs"])
                key += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    spark, name = docs.sparkSession, f"packing_ids_{uuid.uuid4().hex}"
    out = rows.mapInArrow(encode, "part long, key long, doc_id long, n long, ids binary, terms binary, tfs binary")
    path = shared_path(spark, "packing-ids")
    with batches_of(spark, BATCH_BYTES):
        # a task has one part, so it writes one file
        out.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").option("path", path).saveAsTable(name)
    buckets = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: files outside the warehouse stay
    return spark.read.schema(out.schema).parquet(path), buckets


def document_frequencies(rows: DataFrame, size: int, dtype: str) -> np.ndarray:
    """Over all documents: how many hold each token id. The vocabulary bounds the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column("terms"):
                df[np.frombuffer(x.as_buffer(), dtype)] += 1
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(df[t])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def _by_chain(buckets: DataFrame, placed: DataFrame) -> DataFrame:
    """chain, at, doc_id and ids of the documents that have a place.

    The ids move once, to their chains: places go to the buckets of the parts,
    a row a part that holds the place of each of its documents by number.
    """

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, schema=pa.schema([(c, pa.int64()) for c in ("key", "chain", "at")]))
        key, chain, at = (t[c].to_numpy() for c in t.column_names)
        order = np.argsort(key)
        key, chain, at = key[order], chain[order], at[order]
        for some in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key >> 32)) + 1) if len(key) else ():
            where = key[some] & 0xFFFFFFFF
            taken = np.ones(where[-1] + 1, bool)
            taken[where] = False
            lists = []
            for v in (chain, at):
                x = np.zeros(len(taken), np.int64)
                x[where] = v[some]
                lists.append(pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), pa.array(x, mask=taken)))
            yield pa.RecordBatch.from_arrays([pa.array(key[some[:1]] >> 32), *lists], names=["part", "chains", "ats"])

    places = placed.repartition(F.shiftright("key", 32)).select("key", "chain", "at").mapInArrow(of_parts, "part long, chains array<long>, ats array<long>")
    number = "cast(key & 4294967295 as int)"
    found = buckets.join(places.hint("shuffle_hash"), "part").select(F.expr(f"get(chains, {number})").alias("chain"), F.expr(f"get(ats, {number})").alias("at"), "doc_id", "ids")
    return found.filter("chain IS NOT NULL")


class _Used:
    """A bit for each key, by the partition that made it."""

    def __init__(self) -> None:
        self.bits: dict[int, bytearray] = {}

    def add(self, keys: np.ndarray) -> None:
        for k in keys.tolist():
            bits, at = self.bits.setdefault(k >> 32, bytearray()), k & 0xFFFFFFFF
            if at >> 3 >= len(bits):
                bits.extend(bytes((at >> 3) + 1 - len(bits)))
            bits[at >> 3] |= 1 << (at & 7)

    def has(self, key: int) -> bool:
        bits, at = self.bits.get(key >> 32, b""), key & 0xFFFFFFFF
        return at >> 3 < len(bits) and bool(bits[at >> 3] >> (at & 7) & 1)

    def has_all(self, keys: np.ndarray) -> np.ndarray:
        """has() of each key."""
        out = np.zeros(len(keys), bool)
        for p in np.unique(keys >> 32).tolist():
            bits, here = np.frombuffer(bytes(self.bits.get(p, b"\0")) or b"\0", np.uint8), np.flatnonzero(keys >> 32 == p)
            at = keys[here] & 0xFFFFFFFF
            out[here] = (at >> 3 < len(bits)) & (bits[np.minimum(at >> 3, len(bits) - 1)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _flat(lists: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Arrays held as bytes: how long each is, and all of them end to end."""
    lists = lists.cast(pa.large_binary())
    ends = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    data = np.frombuffer(lists.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return np.diff(ends) // np.dtype(dtype).itemsize, data.copy().view(dtype)


def _chains(rows: DataFrame, used: _Used, all_: tuple[int, int], model: tuple, dtype: str, window: int, shard_tokens: int, shard_docs: int, exact: bool) -> DataFrame | None:
    """key, chain and at (order within the chain) of the documents that chains take, which are marked as used; None: no chains needed."""
    n, tokens = all_
    if n <= shard_docs and tokens <= shard_tokens:
        return None
    spark = rows.sparkSession
    share = min(1.0, max(1, tokens // (window * CHAIN_WINDOWS)) / n)
    first = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key", "n").toArrow()
    if not first.num_rows:
        first = rows.orderBy("key").limit(1).select("key", "n").toArrow()
    chain, length = first["key"].to_numpy(), first["n"].to_numpy().copy()
    order = np.argsort(chain)
    chain, length = chain[order], length[order]
    seed, most, at = chain.copy(), NEIGHBOURS, 0
    placed = [stage(spark.createDataFrame(pa.table({"key": chain, "chain": chain, "at": np.zeros(len(chain), np.int64)})), "packing-seeds")]
    used.add(chain)
    n, tokens = n - len(chain), tokens - int(length.sum())
    while n > shard_docs or tokens > shard_tokens:
        filled = 0
        for i in range(0, len(chain), SEEDS):
            some = slice(i, i + SEEDS)
            of, key, size, where = _draft(_lists(rows, used, chain[some], seed[some], model, dtype, most, exact), chain[some], window - length[some] % window)
            if not len(key):
                continue
            at += 1
            placed.append(stage(spark.createDataFrame(pa.table({"key": key, "chain": of, "at": (at << 20) + np.arange(len(key))})), "packing-placed"))
            used.add(key)
            n, tokens = n - len(key), tokens - int(size.sum())
            longer = length[some] + np.bincount(where, size, len(chain[some])).astype(np.int64)
            last = np.flatnonzero(np.diff(where, append=-1))
            ended = last[(longer // window > length[some] // window)[where[last]]]
            seed[i + where[ended]] = key[ended]
            length[some] = longer
            filled += len(ended)
            if n <= shard_docs and tokens <= shard_tokens:
                break
        if filled < len(chain) // 2:  # many ask for the same
            most = min(MOST_NEIGHBOURS, 2 * most)
        spark.sparkContext._jvm.System.gc()  # the driver then lets go of the shuffles of this round
    out = placed[0]
    for p in placed[1:]:
        out = out.union(p)
    return out


def _draft(claims: pa.Table, chain: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds take turns, each the best document on its list that none has taken, until their rooms are full: chain, key, length and place of the chain, by chain and in the order taken."""
    keys, sizes = [memoryview(b"").cast("q")] * len(chain), [memoryview(b"").cast("I")] * len(chain)
    for c, k, n in zip(np.searchsorted(chain, claims["chain"].to_numpy()).tolist(), claims["keys"], claims["ns"]):
        # views of what was received: lists of objects would take many times the driver's memory
        keys[c], sizes[c] = memoryview(k.as_buffer()).cast("b").cast("q"), memoryview(n.as_buffer()).cast("b").cast("I")
    next_, room, taken, mine = [0] * len(chain), room.tolist(), set(), [[] for _ in chain]
    turn = list(range(len(chain)))
    while turn:
        again = []
        for c in turn:
            at, mine_of = next_[c], keys[c]
            while at < len(mine_of) and mine_of[at] in taken:
                at += 1
            next_[c] = at + 1
            if at < len(mine_of):
                taken.add(mine_of[at])
                mine[c].append(at)
                room[c] -= sizes[c][at]
                if room[c] > 0:
                    again.append(c)
        turn = again
    where = np.repeat(np.arange(len(chain)), [len(m) for m in mine])
    key, size = (np.array([v[c][at] for c, m in enumerate(mine) for at in m], np.int64) for v in (keys, sizes))
    return chain[where], key, size, where


def _neighbours(rows: DataFrame, used: _Used, chain: np.ndarray, seed: np.ndarray, model: tuple, dtype: str, most: int, exact: bool = False) -> pa.Table:
    """chain, key and n: the lists of _lists(), a row for each neighbour."""
    t = _lists(rows, used, chain, seed, model, dtype, most, exact).combine_chunks()
    (counts, key), (_, n) = ((_flat(pa.concat_arrays(t[c].chunks), d) if len(t) else (np.zeros(0, np.int64), np.zeros(0, d))) for c, d in (("keys", "<i8"), ("ns", "<u4")))
    return pa.table({"chain": np.repeat(t["chain"].to_numpy(), counts), "key": key, "n": n})


def _lists(rows: DataFrame, used: _Used, chain: np.ndarray, seed: np.ndarray, model: tuple, dtype: str, most: int, exact: bool = False) -> pa.Table:
    """chain, keys and ns: for each seed its best neighbours among all unused documents of the corpus, best first, about `most` of them, `most` over the tasks from each task. exact: no document is passed over by an estimate."""
    spark = rows.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    most = max(2, -(-most // tasks))
    asked = F.broadcast(spark.createDataFrame(pa.table({"chain": chain, "key": seed})))
    t = rows.select("key", "terms").join(asked, "key").select("chain", "terms").toArrow()
    names, queries = t["chain"].to_numpy(), t["terms"].to_pylist()
    some = Seeds(names[: 1 << 11], [np.frombuffer(x, dtype) for x in queries[: 1 << 11]], *model, 1)
    sent = spark.sparkContext.broadcast((names, queries, used, model, some.centres, None if exact else axes(some.wants)))
    del some, t, queries

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("packing")  # what encoding remembered would be held beside the seeds' lists
        names, queries, used, (idf, mean, common), centres, estimate = sent.value
        seeds = Seeds(names, [np.frombuffer(x, dtype) for x in queries], idf, mean, common, most, centres, estimate)
        held: list[Documents] = []

        def show() -> None:
            for block in seeds.in_turn(Documents.joined(held)) if held else ():
                seeds.show_all(block)
            held.clear()

        for b in batches:
            b = b.filter(pa.array(~used.has_all(b.column("key").to_numpy())))
            if not b.num_rows:
                continue
            (counts, terms), (_, tfs) = _flat(b.column("terms"), dtype), _flat(b.column("tfs"), "<u4")
            held.append(Documents.of(b.column("key").to_numpy(), b.column("n").to_numpy(), counts, terms, tfs, idf, mean))
            if sum(len(d.keys) for d in held) >= HELD:
                show()
        show()
        seed, key, n, score = seeds.best
        ends = np.flatnonzero(np.diff(seed, append=-1)) + 1
        lists = list(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())) if len(seed) else []
        cols = [pa.array([c[i:j].tobytes() for i, j in lists], pa.binary()) for c in (key.astype("<i8"), n.astype("<u4"), score.astype("<f4"))]
        yield pa.RecordBatch.from_arrays([pa.array(names[seed[[i for i, _ in lists]]] if lists else np.zeros(0, np.int64)), *cols], names=["chain", "keys", "ns", "scores"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists of each chain as one, which are all in this task, as far as they are sure.

        A task that sent as many as it may has others that are no better than its
        last one: what is below the greatest such score is left out. What remains
        are the best of all documents, in order.
        """
        t = pa.Table.from_batches(batches, schema=pa.schema([("chain", pa.int64()), ("keys", pa.binary()), ("ns", pa.binary()), ("scores", pa.binary())]))
        key, n, score = (np.frombuffer(b"".join(t[c].to_pylist()), d) for c, d in (("keys", "<i8"), ("ns", "<u4"), ("scores", "<f4")))
        sizes = np.array([len(x) // 8 for x in t["keys"].to_pylist()], np.int64)
        chain, which = np.unique(t["chain"].to_numpy(), return_inverse=True)
        sure = np.full(len(chain), -1, np.float32)
        np.maximum.at(sure, which[sizes == most], score[np.cumsum(sizes)[sizes == most] - 1])
        at = np.repeat(which, sizes)
        order = np.lexsort((key, -score, at))
        order = order[score[order] >= sure[at[order]]]
        begins = np.flatnonzero(np.diff(at[order], prepend=-1))
        lists = list(zip(begins.tolist(), [*begins[1:].tolist(), len(order)]))
        cols = [pa.array([c[order[i:j]].tobytes() for i, j in lists], pa.binary()) for c in (key, n)]
        yield pa.RecordBatch.from_arrays([pa.array(chain[at[order[begins]]]), *cols], names=["chain", "keys", "ns"])

    found = rows.select("key", "n", "terms", "tfs").coalesce(tasks).mapInArrow(search, "chain long, keys binary, ns binary, scores binary")
    with batches_of(spark, BATCH_BYTES):
        # lists of about 16 MB to a task
        out = found.repartition(-(-len(chain) * tasks * most * 20 // (16 << 20)), "chain").mapInArrow(best, "chain long, keys binary, ns binary").toArrow()
    sent.destroy()
    return out


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS, exact: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit integers).

    Every document, null text as empty, is its ids and the end id. Chains of
    documents grow side by side: the document that the last window of a chain
    cut is the seed of its next window, and asks with all its terms for the
    best BM25 neighbours among all unused documents of the corpus. Seeds take
    turns, each the best of its list that is left; one whose window is not full
    asks again in the next round. What is left at last, no
    more than shard_docs documents and shard_tokens tokens, is packed in one
    index (see pack_shard). Chains are cut into full windows; what remains of
    them is joined and cut the same way, the end of a task into sequences whose
    lengths are powers of two. Nothing is padded. Rows that repeat a doc_id, or
    lack it, are documents of their own. Empty table: no rows. Extra columns
    are ignored.

    A seed passes over blocks of documents whose estimated scores are far from
    its best so far (see Seeds); with exact it passes over none that may hold one
    of them. The work grows with windows times documents, the share of it that
    is left to do shrinks as there are more documents. The driver holds a bit
    for each document, the chains, and the lists of a block of seeds.
    """
    spark = docs.sparkSession
    ship(spark)
    enc = word_tokens(tokenizer, end)
    size, dtype = max(enc.tok.get_vocab_size(), end + 1), enc.dtype.str
    rows, buckets = _encoded(docs, tokenizer, end)
    n, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(rows, size, dtype)
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), float(tokens / n if n else 1)
    common = np.argsort(-df, kind="stable")[:DENSE]
    used = _Used()
    placed = _chains(rows, used, (n, tokens), (idf, mean, common), dtype, window, shard_tokens, shard_docs, exact)

    def batch(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    def lay(sequences: Iterator[list[tuple[int, int, int]]], ids: list, held: list, sequence: int) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(7)]
        for pieces in sequences:
            offset = 0
            for doc, start, length in pieces:
                row = (ids[doc], start, length, len(held[doc]), sequence, offset, held[doc][start : start + length].astype("<u4").tobytes())
                for c, x in zip(cols, row):
                    c.append(x)
                offset += length
            sequence += 1
        if cols[0]:
            yield batch(cols)

    def unused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(~used.has_all(b.column("key").to_numpy())))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                ids.append(d)
                held.append(np.frombuffer(x.as_py(), dtype))
        if held:
            yield from lay(pack_shard(held, idf, mean, window), ids, held, 1 << 62)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        ends: list[tuple[int | None, int, np.ndarray]] = []  # what remains of chains: doc_id, start, ids of the document
        ids, held, chain = [], [], None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, ends
            full, left = _windows([(i, 0, len(x)) for i, x in enumerate(held)], window)
            yield from lay(full, ids, held, sequence)
            sequence += len(full)
            ends += [(ids[i], start, length, held[i]) for i, start, length in left]
            if sum(x[2] for x in ends) >= window:
                full, left = _windows([(i, x[1], x[2]) for i, x in enumerate(ends)], window)
                yield from lay(full, [x[0] for x in ends], [x[3] for x in ends], sequence)
                sequence += len(full)
                ends = [(ends[i][0], start, length, ends[i][3]) for i, start, length in left]

        for b in batches:
            for c, d, x in zip(b.column("chain").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids")):
                if c != chain:
                    yield from close()
                    ids, held, chain = [], [], c
                ids.append(d)
                held.append(np.frombuffer(x.as_py(), dtype))
        yield from close()
        yield from lay(_powers([(i, x[1], x[2]) for i, x in enumerate(ends)]), [x[0] for x in ends], [x[3] for x in ends], sequence)

    fields = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    rest = rows.select("key", "doc_id", "ids")
    if placed is not None:
        # no more than shard_docs keys
        rest = rest.join(F.broadcast(rows.select("key").mapInArrow(unused, "key long")), "key")
    rest = rest.repartition(1).sortWithinPartitions("key").mapInArrow(fill, fields)
    if placed is None:
        return rest
    chains = _by_chain(buckets, placed).repartition("chain").sortWithinPartitions("chain", "at")
    return chains.select("chain", "doc_id", "ids").mapInArrow(join, fields).union(rest)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
