"""Language spans: script ranges narrow the candidates, Viterbi over word scores labels the words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from spantable.cluster import scratch, ship, stage
from spantable.llm.text import take_over, words

#: Documents of each language that the fit uses, about: they are drawn by a hash at this rate.
DOCS_PER_LANGUAGE = 4000
#: Languages that a model holds at most, those of most documents: its size is BUCKETS numbers for each.
MAX_LANGUAGES = 256
BUCKETS = 1 << 16
SWITCH = 6.0
FOREIGN = 30.0
UNKNOWN = "und"
SLICE_BYTES, CHUNK = 4 << 20, 1 << 14
SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("lang", StringType()))

# Ranges of the main scripts, fixed values of the Unicode block list.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3134F),
]
NAMES = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]
_LETTER = re.compile(r"[^\W\d_]")


def script(word: bytes) -> int:
    """Number of the script of a word's first letter; -1 without letters."""
    m = _LETTER.search(word.decode("utf-8", "replace"))
    if not m:
        return -1
    c = ord(m[0])
    return next((NAMES.index(s) for s, lo, hi in SCRIPTS if lo <= c <= hi), len(NAMES) - 1)


def _buckets(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the 2-, 3- and 4-grams of bytes in each word between spaces, and of the word; and which word each is of."""
    data = np.frombuffer(b"".join([b"".join((b" ", w, b" \0\0")) for w in ws]), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    begin = np.concatenate(([0], np.cumsum(sizes + 4)))[:-1]
    owners, codes = [], []
    for n in (2, 3, 4):
        per = np.maximum(sizes + 3 - n, 0)
        owner = np.repeat(np.arange(len(ws)), per)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + begin[owner]
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | data[at + k]
        owners.append(owner)
        codes.append((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))
    owners.append(np.arange(len(ws)))
    codes.append(np.fromiter(map(zlib.crc32, ws), np.uint64, len(ws)) & np.uint64(BUCKETS - 1))
    return np.concatenate(codes).astype(np.int64) % BUCKETS, np.concatenate(owners)


@dataclass
class Model:
    """Log probabilities of buckets, (BUCKETS, languages), and which languages use which script."""

    languages: list[str]
    table: np.ndarray
    uses: np.ndarray

    def word_scores(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words, languages), and the scripts of the words."""
        scripts = np.fromiter((0 if w.isalpha() else script(w) for w in ws), np.int64, len(ws))
        if not ws:
            return np.zeros((0, len(self.languages))), scripts
        out = np.zeros((len(ws), len(self.languages)))
        for at in range(0, len(ws), CHUNK):  # their n-grams are many
            part = ws[at : at + CHUNK]
            bucket, owner = _buckets(part)
            for i in range(len(self.languages)):
                out[at : at + CHUNK, i] = np.bincount(owner, self.table[bucket, i], len(part))
        fits = self.uses[scripts]
        if self.languages:
            out -= FOREIGN * (~fits & fits.any(1, keepdims=True))
        out[scripts < 0] = 0
        return out, scripts


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of several sequences laid end to end; a change of label costs `switch`.

    All sequences go forward in step, longest first, so the number of numpy
    steps is the length of the longest.
    """
    n = scores.shape[0]
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return np.zeros(n, np.int64)
    begins, sizes = begin[order], lengths[order]
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    state = np.zeros((len(order), scores.shape[1]))
    came = np.zeros(scores.shape, np.int16)  # label before this one
    own = np.arange(scores.shape[1], dtype=np.int16)
    last = np.zeros(len(order), np.int64)
    for t, m in enumerate(live.tolist()):
        at = begins[:m] + t
        if t:
            best = state[:m].argmax(1)
            top = state[np.arange(m), best][:, None] - switch
            change = top > state[:m]
            came[at] = np.where(change, best[:, None], own)
            state[:m] = np.where(change, top, state[:m])
        state[:m] += scores[at]
        done = live[t + 1] if t + 1 < len(live) else 0
        if done < m:
            last[done:m] = state[done:m].argmax(1)
    out = np.zeros(n, np.int64)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = begins[:m] + t
        out[at] = last[:m]
        if t:
            last[:m] = came[at, last[:m]]
    return out


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, seed: int = 5, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from docs(text, lang, doc_id) with lang not null.

    Of a language with more than docs_per_language documents a hash of the id
    draws about that many; this bounds the fit. Counts of hashed n-grams are
    summed per partition and by a shuffle; the driver gets at most BUCKETS
    counts a language, of the max_languages languages that most documents have
    (ties by name). Null texts teach nothing.
    """
    ship(docs.sparkSession)
    with scratch():
        return _fit(docs, docs_per_language, seed, max_languages)


def _fit(docs: DataFrame, docs_per_language: int, seed: int, max_languages: int) -> Model:
    known = docs.filter("lang is not null and text is not null")
    rates = stage(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang", F.least(F.lit(1.0), F.lit(float(docs_per_language)) / F.col("n")).alias("rate")), "langid-rates")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    some = known.select("doc_id", "lang", "text").join(rates, "lang").filter(draw < F.col("rate")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                ws = words(text.as_py())
                if not ws:
                    continue
                if lang not in grams:
                    grams[lang], scripts[lang] = np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES) + 1, np.int64)
                for at in range(0, len(ws), 65536):
                    part = [w for w in ws[at : at + 65536] if _LETTER.search(w.decode("utf-8", "replace"))]
                    if part:
                        grams[lang] += np.bincount(_buckets(part)[0], minlength=BUCKETS)
                        scripts[lang] += np.bincount([script(w) for w in part], minlength=len(NAMES) + 1)
        for lang in grams:
            k = np.flatnonzero(grams[lang])
            s = np.flatnonzero(scripts[lang])
            keys = np.concatenate((k, -1 - s))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(np.concatenate((grams[lang][k], scripts[lang][s])))], names=["lang", "k", "n"])

    counts = some.mapInArrow(count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    grams, uses = np.zeros((BUCKETS, len(languages))), np.zeros((len(NAMES) + 1, len(languages)))
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        k, n = own["k"].to_numpy(), own["n"].to_numpy()
        grams[k[k >= 0], i], uses[-1 - k[k < 0], i] = n[k >= 0], n[k < 0]
    table = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * BUCKETS))
    # n-grams of a word overlap; half their weight comes nearer to independent evidence
    return Model(languages, 0.5 * table, uses > 0.001 * uses.sum(0))


def detect(docs: DataFrame, model: Model, switch: float = SWITCH, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_spans, an array of (start, end, lang) in words, end excluded.

    Words are runs between ASCII white space. lang_pred is the language of
    most letters-bearing words, ties to the first by name, lang_score their
    share. Text that is null or has no letter: `und`, score 0, no spans. Words
    without letters go with their neighbours. Rows, repeated ones too, keep
    their columns; columns of the three names are replaced. No shuffle.
    """
    ship(docs.sparkSession)
    new = ["lang_pred", "lang_score", "lang_spans"]
    docs = docs.select([c for c in docs.columns if c not in new])
    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("lang_score", DoubleType()).add("lang_spans", SPANS)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    names = np.array(model.languages + [UNKNOWN], object)

    def label(texts: list[list[bytes]]) -> list[tuple[str, float, list]]:
        index: dict[bytes, int] = {}
        tokens = [np.array([index.setdefault(w, len(index)) for w in ws], np.int64) for ws in texts]
        lengths = np.array([len(t) for t in tokens], np.int64)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        scores, scripts = model.word_scores(list(index))
        path = viterbi(scores[flat], lengths, switch) if model.languages else np.zeros(len(flat), np.int64)
        letters = scripts[flat] >= 0
        out, at = [], 0
        for n in lengths.tolist():
            p, own = path[at : at + n], letters[at : at + n]
            at += n
            if not own.any() or not model.languages:
                out.append((UNKNOWN, 0.0, []))
                continue
            votes = np.bincount(p[own], minlength=len(model.languages))
            best = int(votes.argmax())
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1, [n]))
            spans = [{"start": int(a), "end": int(b), "lang": names[p[a]]} for a, b in zip(cuts[:-1], cuts[1:])]
            out.append((names[best], float(votes[best] / votes.sum()), spans))
        return out

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("languages")
        for b in batches:
            out, held, size = [], [], 0
            for t in b.column(text_col):
                held.append(words(t.as_py()))
                size += sum(map(len, held[-1]))
                if size > SLICE_BYTES:
                    out += label(held)
                    held, size = [], 0
            out += label(held)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], span_type)], names=schema.names)

    return docs.mapInArrow(predict, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held))
    out = detect(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
