"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from spantable.cluster import scratch, ship, stage
from spantable.llm.text import take_over

#: Labelled rows that the fit uses at most: those of the least hashes.
MAX_TRAIN = 20_000
FEATURES, RIDGE, SEED = 256, 3.0, 11
THRESHOLD = 0.3
SUM_PARTITIONS = 8

_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_PUNCT = np.array([i for i in range(33, 127) if not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123)])
_ODD = np.frombuffer(b"#$%&*|~^_<>{}[]\\/@=+`", np.uint8)
N_STATISTICS = 24


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; None and empty texts alike."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    n = len(raw)
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, punct = (int(h[x].sum()) for x in (_UPPER, _LOWER, _DIGIT, _PUNCT))
    high = int(h[128:].sum())
    words, lines = raw.split(), raw.split(b"\n")
    w = len(words)
    counts = Counter(words)
    p = h[h > 0] / max(n, 1)
    per, per_w = 1 / max(n, 1), 1 / max(w, 1)
    stops = int(h[46] + h[33] + h[63])
    ends = Counter(x[-1:] for x in counts)
    odd_ends = sum(v for k, v in ends.items() if k and k in b"#$%&*|~^!@=+")
    return [
        np.log1p(n), np.log1p(w), n * per_w, upper / max(1, upper + lower), digits * per, punct * per,
        int(h[[9, 10, 11, 12, 13, 32]].sum()) * per, int(h[10]) * per, high * per, len(counts) * per_w,
        max(counts.values(), default=0) * per_w, sum(map(operator.eq, words, words[1:])) * per_w,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), float(-(p * np.log2(p)).sum()),
        int(h[_ODD].sum()) * per, int(h[33] + h[63]) * per, int(h[_PUNCT].max()) * per, np.log1p(w / max(1, stops)),
        odd_ends / max(1, len(counts)), len(zlib.compress(raw, 1)) / max(n, 16), int(h[124]) * per,
        len(set(zip(words, words[1:]))) * per_w, int(h[44]) / max(1, punct),
    ]


@dataclass
class Model:
    """A fitted classifier; small, and sent to the executors as it is."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.omega, self.phase) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of label 1; a trace of the raw score keeps its order within a level."""
        raw = self.raw(x)
        flat = np.interp(raw, self.knots, self.levels)
        return 0.999 * flat + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -50, 50)))


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, the standardised statistics themselves, and one."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.sqrt(2 / len(phase)) * np.cos(z @ omega + phase), z / 8, np.ones((len(z), 1))])


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: centres of the blocks and their smoothed shares of label 1, not decreasing."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of raw scores
    for r, y in zip(raw[order], label[order]):
        blocks.append([float(y), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    share = float(label.mean()) if len(label) else 0.5
    knots = np.array([b[2] / b[1] for b in blocks] or [0.0])
    levels = np.array([(b[0] + share) / (b[1] + 1) for b in blocks] or [share])
    return knots, np.maximum.accumulate(levels)


def _with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    ship(docs.sparkSession)
    schema = StructType([docs.schema[c] for c in keep]).add("x", ArrayType(DoubleType()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), x], names=[*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(measure, schema)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Fit on labelled documents: labels(doc_id, quality), docs(doc_id, text).

    At most max_train labelled ids, those with the least hashes, are used;
    three quarters of them fit the ridge scores and one quarter calibrates
    them. Means and normal equations are sums that each partition makes; what
    goes to the driver is bounded by SUM_PARTITIONS and the number of features,
    and by max_train scores for the calibration. Rows with null ids or labels
    are not used; of repeated labels of an id the least counts, and of repeated
    documents of an id the one with the least statistics. Without any labelled
    row the score is 0.5 everywhere.
    """
    with scratch():
        return _fit(docs, labels, max_train, features, ridge, seed)


def _fit(docs: DataFrame, labels: DataFrame, max_train: int, features: int, ridge: float, seed: int) -> Model:
    some = labels.filter("doc_id is not null and quality is not null").select("doc_id", "quality", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    some = some.orderBy("h", "doc_id").limit(max_train).groupBy("doc_id").agg(F.min("quality").alias("y"), F.min("h").alias("h"))
    some = stage(some, "quality-labels")
    # max_train rows at most: a bounded table
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    once = _with_statistics(rows, ["doc_id", "y", "h"]).groupBy("doc_id").agg(F.min(F.struct("x", "y", "h")).alias("r")).select("r.*")
    x = stage(once.withColumn("calibrates", F.pmod(F.shiftright("h", 8), F.lit(4)) == 0), "quality-statistics")
    m = N_STATISTICS
    sums = x.select(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(m)], *[F.stddev_pop(F.col("x")[i]) for i in range(m)]).first()
    rng = np.random.default_rng(seed)
    mean, scale = (np.array([v or 0.0 for v in sums[1 + k * m : 1 + (k + 1) * m]]) for k in (0, 1))
    scale[scale < 1e-9] = 1.0
    # kernel exp(-|a - b|^2 / (2 m)): unit-variance statistics are about sqrt(2 m) apart
    omega, phase = rng.normal(0, 1 / np.sqrt(m), (m, features)), rng.uniform(0, 2 * np.pi, features)
    size = features + m + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                phi = fourier(np.array(batch.column("x").to_pylist()), mean, scale, omega, phase)
                a += phi.T @ phi
                b += phi.T @ np.array(batch.column("y").to_pylist(), float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    a, b = np.zeros((size, size)), np.zeros(size)
    for r in x.filter("not calibrates").select("x", "y").coalesce(SUM_PARTITIONS).mapInArrow(normal, "a binary, b binary").collect():
        a += np.frombuffer(r["a"]).reshape(size, size)
        b += np.frombuffer(r["b"])
    weights = np.linalg.solve(a + ridge * np.diag([1.0] * (size - 1) + [1e-6]), b)
    model = Model(mean, scale, omega, phase, weights, np.array([0.0]), np.array([0.5]))
    rest = x.filter("calibrates").select("x", "y").toPandas()
    if len(rest):
        model.knots, model.levels = isotonic(model.raw(np.array(rest["x"].tolist())), rest["y"].to_numpy(float))
    return model


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with quality_score (0 to 1) and quality_predicted (1 if score >= threshold, else 0).

    Only the text is read. Null and empty texts are scored alike. Rows,
    repeated ones too, keep their columns; columns of the two names are
    replaced. No shuffle.
    """
    ship(docs.sparkSession)
    docs = docs.select([c for c in docs.columns if c not in ("quality_score", "quality_predicted")])
    schema = StructType(list(docs.schema.fields)).add("quality_score", DoubleType()).add("quality_predicted", IntegerType())

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality")
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(text_col)]).reshape(-1, N_STATISTICS)
            s = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return docs.mapInArrow(predict, schema)


def held_out(rest: int, of: int) -> Callable:
    """Column: whether crc32 of an id as text leaves this remainder; false for null."""
    return lambda c: F.coalesce(F.crc32(c.cast("string")) % of == rest, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = held_out(0, 5)
    model = fit(docs, labels.filter(~out(F.col("doc_id"))))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


