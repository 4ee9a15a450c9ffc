"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model sees a text as its words, A-Z lower-cased, each closed by a space,
and an end symbol. A byte's context is the up to four bytes before it. With
running contexts, which the query has, these run over the space into the words
before; else the space before the word is included and nothing beyond it. PPM
takes the longest
context that training has seen, gives its symbols count / (total + distinct)
and the escape distinct / (total + distinct) (method C), and goes on with the
next shorter context without the symbols that the longer one has ruled out;
below order 0 all bytes left over are equally likely. There is one trie for
each of the most frequent languages that training documents state, and one for
the rest; a document's probability is the mixture of what these say.

Pretrained scoring never holds the corpus model in one place. Texts are cut
into blocks. A block asks for what it needs, the counts of its words that other
blocks have too and the probabilities of its distinct 5-grams, and gets these
by shuffles.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spantable.cluster import free, ship, stage
from spantable.llm.text import take_over, words

ORDER = 4
SPACE, END = 0x20, 0x0A
START = b"\0\0\0 "
END_GRAM = int.from_bytes(START + bytes((END,)), "big")
#: Bytes of text in a block, unless one text alone has more.
BLOCK_BYTES = 16 << 20
#: Words whose 5-grams are looked at together, and bytes of documents with running contexts.
CHUNK, CHUNK_BYTES = 1 << 15, 1 << 20
#: Languages with a trie of their own, those of most training documents.
LANGUAGES = 8


class AdaptivePpm:
    """PPM with a trie that learns from what it scores: code lengths of single documents, without a corpus."""

    def __init__(self, order: int = ORDER) -> None:
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = defaultdict(dict)

    def probability(self, context: bytes, symbol: int) -> float:
        p, out = 1.0, set()
        for k in range(min(self.order, len(context)), -1, -1):
            seen = {s: n for s, n in self.counts.get(context[len(context) - k :], {}).items() if s not in out}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return p * seen[symbol] / total
            p *= len(seen) / total
            out |= seen.keys()
        return p / (256 - len(out)) if len(out) < 256 else p

    def learn(self, context: bytes, symbol: int, n: int = 1) -> None:
        for k in range(min(self.order, len(context)) + 1):
            c = self.counts[context[len(context) - k :]]
            c[symbol] = c.get(symbol, 0) + n

    def code_length(self, text: str | None, learn: bool = True, running: bool = False) -> float:
        """log10 probability of a text, learning it byte by byte."""
        total, seen = 0.0, START
        for symbols in [*(w + b" " for w in words(text)), bytes((END,))]:
            seen = seen[-4:] if running else START
            for s in symbols:
                total += float(np.log10(self.probability(seen[-4:], s)))
                if learn:
                    self.learn(seen[-4:], s)
                seen += bytes((s,))
        return total


def _grams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-grams (four bytes of context, one symbol) of each word and its space, and which word each is of."""
    if not ws:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b"".join([b"".join((START, w, b" ")) for w in ws]), np.uint8)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    owner = np.repeat(np.arange(len(ws)), sizes)
    at = np.arange(len(owner)) + 4 * (owner + 1)
    code = np.zeros(len(at), np.int64)
    for k in range(4, -1, -1):
        code = code << 8 | data[at - k]
    return code, owner


def _text_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-grams of running texts, each with START before it, and where those of each text begin."""
    sizes = np.array([len(x) - 4 for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    code = data[:-4]
    for k in range(1, 5):
        code = code << 8 | data[k : len(data) - 4 + k]
    keep = np.ones(len(code), bool)  # without those that run from one text into the next
    ends = np.cumsum(sizes + 4)[:-1] - 4
    keep[(ends[:, None] + np.arange(4)).ravel()] = False
    return code[keep], np.concatenate(([0], np.cumsum(sizes)[:-1]))


class _Places:
    """Where 5-grams stand in an array of distinct ones that has them all: a hash table in arrays, a quarter full."""

    def __init__(self, grams: np.ndarray) -> None:
        self.bits = max(4, (4 * len(grams)).bit_length())
        h = self._hash(grams)
        self.place = np.argsort(h, kind="stable")
        self.grams = grams[self.place]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(h, minlength=1 << self.bits))))[:-1].astype(np.int32)

    def _hash(self, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        at = self.first[self._hash(grams)]
        miss = np.flatnonzero(self.grams[at] != grams)
        while len(miss):
            at[miss] += 1
            miss = miss[self.grams[at[miss]] != grams[miss]]
        return self.place[at]


def _running_text(ws: list[bytes]) -> bytes:
    """Words, a space after each, between START and the end."""
    return b"".join((START, b" ".join(ws), b" " if ws else b"", bytes((END,))))


def _running_grams(tokens: list[np.ndarray], ws: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some documents at a time, first and end: their 5-grams, and where those of each document begin. ws: the words by number."""
    first, size, texts = 0, 0, []
    for i, t in enumerate(tokens):
        texts.append(_running_text([ws[x] for x in t.tolist()]))
        size += len(texts[-1])
        if size >= CHUNK_BYTES or i + 1 == len(tokens):
            yield first, i + 1, *_text_grams(texts)
            first, size, texts = i + 1, 0, []


class _Tally:
    """5-grams of running texts with their counts by class, -1: not learned; texts are counted some at a time."""

    def __init__(self) -> None:
        self.texts: dict[int, list[bytes]] = defaultdict(list)
        self.sizes: dict[int, int] = defaultdict(int)
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, k: int, text: bytes) -> None:
        self.texts[k].append(text)
        self.sizes[k] += len(text)
        if self.sizes[k] >= CHUNK_BYTES:
            self._count(k)

    def _count(self, k: int) -> None:
        grams, n = np.unique(_text_grams(self.texts.pop(k))[0], return_counts=True)
        self.sizes[k] = 0
        if k in self.found:
            every = np.concatenate((self.found[k][0], grams))
            grams, at = np.unique(every, return_inverse=True)
            n = np.bincount(at, np.concatenate((self.found[k][1], n)), len(grams)).astype(np.int64)
        self.found[k] = grams, n

    def counts(self, classes: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """All 5-grams, and the counts of each class."""
        for k in list(self.texts):
            self._count(k)
        grams = np.unique(np.concatenate([g for g, _ in self.found.values()]))
        counts = [np.zeros(len(grams), np.int64) for _ in range(classes)]
        for k, (g, n) in self.found.items():
            if k >= 0:
                counts[k][np.searchsorted(grams, g)] = n
        return grams, counts


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(docs: DataFrame, classes: int, block_bytes: int, running: bool) -> DataFrame:
    """One row a block: its documents as numbers of its words, its words and, by class, its 5-grams with their training counts.

    docs: doc_id, text, held, class (a number below classes).
    """
    many = [(f"train_{k}", pa.list_(pa.int64())) for k in range(classes)]
    fields = [("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("word_train", pa.list_(pa.int64())), ("n_learned", pa.int64()), ("n_trained", pa.int64()), ("class_docs", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64())), *many]
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("ppm")
        block, size = TaskContext.get().partitionId() << 32, 0
        index, ids, outs, of, tokens, tally = _Index(), [], [], [], [], _Tally()

        def word_counts(ws: list[bytes], by_class: list[np.ndarray], seen: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
            # a chunk of words at a time: the 5-grams of all words at once would take most of a task's memory
            grams = np.unique(np.concatenate([np.array([END_GRAM]), *(np.unique(_grams(ws[i : i + CHUNK])[0]) for i in range(0, len(ws), CHUNK))]))
            counts = [np.where(grams == END_GRAM, n, 0) for n in seen]
            for i in range(0, len(ws), CHUNK):
                code, owner = _grams(ws[i : i + CHUNK])
                which = np.searchsorted(grams, code)
                for k in range(classes):
                    counts[k] += np.bincount(which, by_class[k][i : i + CHUNK][owner], len(grams)).astype(np.int64)
            return grams, counts

        def close() -> pa.RecordBatch:
            ws = list(index)
            seen, by_class = [], []
            for k in range(classes):
                learn = [t for t, h, c in zip(tokens, outs, of) if c == k and not h]
                by_class.append(np.bincount(np.concatenate(learn), minlength=len(ws)) if learn else np.zeros(len(ws), np.int64))
                seen.append(len(learn))
            train = sum(by_class)
            if running:
                grams, counts = tally.counts(classes)
            else:
                grams, counts = word_counts(ws, by_class, seen)
            flat = np.concatenate(tokens).astype("<i4", copy=False).tobytes() if tokens else b""
            row = [block, ids, outs, [len(t) for t in tokens], zlib.compress(flat, 1), ws, train, int(np.count_nonzero(train)), int(train.sum()), seen, grams, *counts]
            return pa.RecordBatch.from_arrays([pa.array([x], f[1]) for x, f in zip(row, fields)], schema=schema)

        for b in batches:
            texts = b.column("text")
            for i, (d, h, c) in enumerate(zip(*(b.column(x).to_pylist() for x in ("doc_id", "held", "class")))):
                w = words(texts[i].as_py())
                n = sum(map(len, w))
                if ids and size + n > block_bytes:
                    yield close()
                    block, size = block + 1, 0
                    index, ids, outs, of, tokens, tally = _Index(), [], [], [], [], _Tally()
                    pa.default_memory_pool().release_unused()
                ids.append(d)
                outs.append(h)
                of.append(c)
                tokens.append(np.fromiter(map(index.__getitem__, w), np.int32, len(w)))
                if running:
                    tally.add(-1 if h else c, _running_text(w))
                size += n
        if ids:
            yield close()

    spark_fields = "block long, docs array<long>, held array<boolean>, lengths array<long>, tokens binary, words array<binary>, word_train array<long>, n_learned long, n_trained long, class_docs array<long>, grams array<long>"
    spark_fields += "".join(f", train_{k} array<long>" for k in range(classes))
    return stage(docs.mapInArrow(cut, spark_fields), "ppm-blocks")


class LowerOrders:
    """What orders 2, 1 and 0 of one class need of the whole training text, as tables by their contexts.

    order1[a, s]: how often s follows a. total2, distinct2 and ruled1, by the
    two bytes before: symbols seen there, distinct ones, and the order-1 counts
    of those.
    """

    def __init__(self, order1: np.ndarray, total2: np.ndarray, distinct2: np.ndarray, ruled1: np.ndarray) -> None:
        self.order1, self.total2, self.distinct2, self.ruled1 = order1, total2, distinct2, ruled1
        self.total1, self.distinct1 = order1.sum(1), np.count_nonzero(order1, axis=1)
        self.order0 = order1.sum(0)
        self.ruled0 = (order1 > 0) @ self.order0
        self.unseen = max(1, 256 - np.count_nonzero(self.order0))


def gram_probabilities(gram: np.ndarray, n: np.ndarray, n2: np.ndarray, low: LowerOrders) -> np.ndarray:
    """log10 probabilities of 5-grams, all of those that share three bytes before the symbol with one of them.

    n: training counts of these 5-grams; n2: those of their last two bytes and
    symbol, over the whole training text. All symbols of a context are ruled
    out in the next shorter one, and there they have counts, so what is left
    over is a difference of sums.
    """
    p, open_ = np.zeros(len(gram)), np.ones(len(gram), bool)

    def step(count: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> None:
        """One order: count of each symbol, total and distinct symbols of its context, without those ruled out."""
        nonlocal open_
        known = open_ & (distinct > 0)
        hit, miss = known & (count > 0), known & (count == 0)
        p[hit] += np.log10(count[hit] / (total + distinct)[hit])
        p[miss] += np.log10(distinct[miss] / (total + distinct)[miss])
        open_ = open_ & ~hit

    def by_context(key: np.ndarray, count: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct key: its context's total and distinct symbols, and the shorter context's counts of these."""
        _, at = np.unique(key >> 8, return_inverse=True)
        return at, np.bincount(at, count), np.bincount(at, count > 0), np.bincount(at, np.where(count > 0, shorter, 0))

    # order 3: the 5-grams summed over the first byte
    key3, first, at3 = np.unique(gram & 0xFFFFFFFF, return_index=True, return_inverse=True)
    n3 = np.bincount(at3, n, len(key3))
    at, total, distinct, ruled = by_context(gram, n, n3[at3])
    step(n, total[at], distinct[at])
    gone_sum, gone = ruled[at], distinct[at]
    at, total, distinct, ruled = by_context(key3, n3, n2[first])
    at = at[at3]
    step(n3[at3], total[at] - gone_sum, distinct[at] - gone)
    gone_sum, gone = ruled[at], distinct[at]
    last2, last, symbol = gram >> 8 & 0xFFFF, gram >> 8 & 255, gram & 255
    step(n2, low.total2[last2] - gone_sum, low.distinct2[last2] - gone)
    step(low.order1[last, symbol], low.total1[last] - low.ruled1[last2], low.distinct1[last] - low.distinct2[last2])
    step(low.order0[symbol], low.order0.sum() - low.ruled0[last], np.count_nonzero(low.order0) - low.distinct1[last])
    p[open_] -= np.log10(low.unseen)
    return p


def _lower_orders(grams: DataFrame, trains: list[str]) -> tuple[DataFrame, list[LowerOrders]]:
    """key (two bytes and a symbol) with its counts, staged; and tables of 65,536 rows at most, for each class."""
    classes = len(trains)
    order2 = stage(grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).agg(*[F.sum(t).alias(t) for t in trains]), "ppm-order2")
    order1 = np.zeros((classes, 1 << 16), np.int64)
    t = order2.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("k")).agg(*[F.sum(t).alias(t) for t in trains]).toArrow()
    for k, c in enumerate(trains):
        order1[k, t["k"].to_numpy()] = t[c].to_numpy()

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("key").to_numpy()
            r = [np.where(b.column(c).to_numpy() > 0, order1[k, key & 0xFFFF], 0) for k, c in enumerate(trains)]
            yield pa.RecordBatch.from_arrays([pa.array(key >> 8), *(b.column(c) for c in trains), *map(pa.array, r)], names=["context", *trains, *rs])

    rs = [f"r{k}" for k in range(classes)]
    sums = [x for c, r in zip(trains, rs) for x in (F.sum(c).alias(c), F.sum((F.col(c) > 0).cast("long")).alias(f"d_{c}"), F.sum(r).alias(r))]
    t = order2.mapInArrow(ruled, ", ".join(f"{c} long" for c in ["context", *trains, *rs])).groupBy("context").agg(*sums).toArrow()
    low = []
    for k, (c, r) in enumerate(zip(trains, rs)):
        tables = np.zeros((3, 1 << 16), np.int64)
        tables[:, t["context"].to_numpy()] = [t[x].to_numpy() for x in (c, f"d_{c}", r)]
        low.append(LowerOrders(order1[k].reshape(256, 256), *tables))
    return order2, low


def _probabilities(grams: DataFrame, trains: list[str], ps: list[str]) -> tuple[DataFrame, DataFrame]:
    """gram and its log10 probability under each class; and the staged table that this reads besides grams.

    5-grams reach a task sorted by the three bytes before the symbol, of which
    65,536 5-grams at most can share one, and are cut where these change.
    """
    order2, low = _lower_orders(grams, trains)
    n2s = [f"n2_{k}" for k in range(len(trains))]
    with2 = grams.withColumn("key", F.col("gram").bitwiseAND(F.lit(0xFFFFFF))).join(order2.select("key", *[F.col(t).alias(n) for t, n in zip(trains, n2s)]), "key").drop("key")
    context = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF))
    dealt = with2.withColumn("context", context).repartition("context").sortWithinPartitions("context")

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        gram = t["gram"].to_numpy()
        p = [pa.array(gram_probabilities(gram, t[c].to_numpy(), t[n].to_numpy(), low[k])) for k, (c, n) in enumerate(zip(trains, n2s))]
        yield pa.RecordBatch.from_arrays([pa.array(gram), *p], names=["gram", *ps])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                t = pa.Table.from_batches(held)
                last = int(np.searchsorted(t["context"].to_numpy(), t["context"][-1].as_py()))
                if last:
                    yield from work(t.slice(0, last))
                held = t.slice(last).to_batches()
                n -= last
        if n:
            yield from work(pa.Table.from_batches(held))

    return dealt.mapInArrow(cut, ", ".join(["gram long", *(f"{p} double" for p in ps)])), order2


def score(docs: DataFrame, held: Column | None = None, block_bytes: int = BLOCK_BYTES, languages: int = LANGUAGES, running: bool = False) -> DataFrame:
    """docs(doc_id, text, lang) scored by a PPM model and by add-one unigrams, both trained on rows where held is not true.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens (longs),
    base_score and score (log10 probabilities). Tokens are words and one end a
    document. Every count is over all training documents: words and 5-grams are
    counted per block, and these counts are summed by shuffles, a word that many
    blocks have as a stream of one row a block. A task holds one block with its words and
    5-grams, or some 5-grams, whole contexts of three bytes at a time. The only
    tables that go to the driver have 65,536 rows and a few counts for each
    class. lang is read of training documents only. running: contexts run
    over spaces into the words before, and 5-grams are those of the whole text.

    Null text: empty, one token. Null doc_id: kept. Null lang, or no such
    column: the class of the rest. Rows that repeat an id are documents of
    their own. Empty table: no rows. Without training documents all bytes are
    equally likely. Extra columns are ignored.
    """
    ship(docs.sparkSession)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    held = F.coalesce(held, F.lit(False)) if held is not None else F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"), lang.alias("lang"))
    top = rows.filter("not held and lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    classes = len(top) + 1
    number = F.lit(classes - 1)
    for k, r in enumerate(top):
        number = F.when(F.col("lang") == r["lang"], k).otherwise(number)
    blocks = _blocks(rows.select("doc_id", "text", "held", F.coalesce(number, F.lit(classes - 1)).alias("class")), classes, block_bytes, running)
    # words: what a block counts of a word that no other block has is all there is, so only shared words are sent back
    dealt = blocks.select("block", F.posexplode(F.arrays_zip("words", "word_train")).alias("pos", "w")).select("block", "pos", F.col("w.words").alias("word"), F.col("w.word_train").alias("n")).repartition("word")
    sums = dealt.groupBy("word").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("blocks"), F.min(F.struct("block", "pos")).alias("first")).filter("blocks > 1")
    shared = dealt.join(sums.hint("shuffle_hash"), "word").select("block", "pos", "n", "c", (F.col("first") == F.struct("block", "pos")).alias("first"))
    shared = stage(shared, "ppm-words")
    own, n, *class_docs = blocks.agg(F.sum("n_learned"), F.sum("n_trained"), *[F.sum(F.col("class_docs")[k]) for k in range(classes)]).first()
    class_docs = [x or 0 for x in class_docs]
    train_docs = sum(class_docs)
    again, distinct = shared.agg(F.sum((F.col("n") > 0).cast("long")), F.sum((F.col("first") & (F.col("c") > 0)).cast("long"))).first()
    v = (own or 0) - (again or 0) + (distinct or 0) + (train_docs > 0)
    n = (n or 0) + train_docs
    # 5-grams: summed, scored, sent back to the blocks that have them
    trains, ps = [f"train_{k}" for k in range(classes)], [f"p{k}" for k in range(classes)]
    held_by = blocks.select("block", F.explode(F.arrays_zip("grams", *trains)).alias("g")).select("block", F.col("g.grams").alias("gram"), *[F.col(f"g.{t}").alias(t) for t in trains])
    grams = stage(held_by.groupBy("gram").agg(*[F.sum(t).alias(t) for t in trains]), "ppm-grams")
    probabilities, order2 = _probabilities(grams, trains, ps)
    scored = stage(probabilities, "ppm-scores")
    free(grams, order2)
    asked = blocks.select("block", F.explode("grams").alias("gram"))
    answers = shared.filter("c <> n").select("block", F.col("pos").cast("long").alias("key"), "c", *[F.lit(None).cast("double").alias(p) for p in ps])
    answers = answers.union(asked.join(scored, "gram").select("block", "gram", F.lit(None).cast("long"), *ps))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])))
    base = float(n + v + 1)
    prior = np.log10((np.array(class_docs) + 1) / (train_docs + classes))

    def finish(block: pa.Table, reply: pa.Table) -> pa.Table:
        out = []
        is_word = reply["c"].is_valid().to_numpy()
        words_of, grams_of = reply.filter(pa.array(is_word)), reply.filter(pa.array(~is_word))
        for i in range(block.num_rows):
            row = {x: block[x][i] for x in block.column_names}
            ws, lengths = row["words"].as_py(), row["lengths"].values.to_numpy()
            c = row["word_train"].values.to_numpy().astype(float)
            c[words_of["key"].to_numpy()] = words_of["c"].to_numpy()
            places = _Places(grams_of["key"].to_numpy())
            p = [grams_of[x].to_numpy() for x in ps]
            tokens = np.frombuffer(zlib.decompress(row["tokens"].as_py()), "<i4")
            each = np.split(tokens, np.cumsum(lengths)[:-1])
            by_doc = np.zeros((len(each), classes))
            if running:
                for i, j, code, begins in _running_grams(each, ws):
                    at = places.find(code)
                    for k in range(classes):
                        by_doc[i:j, k] = np.add.reduceat(p[k][at], begins)
            else:
                by_word = np.zeros((len(c), classes))
                for i in range(0, len(c), CHUNK):
                    code, owner = _grams(ws[i : i + CHUNK])
                    at = places.find(code)
                    for k in range(classes):
                        by_word[i : i + CHUNK, k] = np.bincount(owner, p[k][at])
                end = places.find(np.array([END_GRAM]))[0]
                for i, t in enumerate(each):
                    by_doc[i] = by_word[t].sum(0) + np.array([x[end] for x in p])
            unigram = np.log10((c + 1) / base)
            for d, h, m, t, y in zip(row["docs"].as_py(), row["held"].as_py(), lengths.tolist(), each, by_doc):
                x = y + prior
                mixed = x.max() + np.log10((10 ** (x - x.max())).sum())
                out.append((d, h, m + 1, int(np.count_nonzero(c[t])) + (train_docs > 0), n, float(unigram[t].sum() + np.log10((train_docs + 1) / base)), float(mixed)))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(len(names))], schema=schema)

    body = blocks.select("block", "docs", "held", "lengths", "tokens", "words", "word_train")
    found = body.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    found = stage(found, "ppm-found")
    free(blocks, shared, scored)
    return found


def query(spark, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held, running=True)
