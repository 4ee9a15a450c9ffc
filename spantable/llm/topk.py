"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors become integers. Each dimension has two lists of postings, one for
queries that want it high, with impact value - least value, and one for queries
that want it low, with impact greatest value - value. A posting segment is the
rows of a list with the same quantised impact. The segments of one quantised
impact are processed before those of the next lower one, for a block of queries
at a time. A row's score so far is a lower bound, and each of a query's lists
not yet reached adds at most the greatest impact of the next level times its
weight. A query stops when these bounds prove that only a few rows can be among
its best k; lower segments are never touched for it. Those rows are rescored
exactly.

A level whose segments are sparse is kept as lists of postings; one that holds
more than DENSE of all postings is kept as a block, rows by lists with 0 where
a posting lies in another level, and is added by a matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spantable.cluster import scratch, ship, stage

#: Vectors in an index; queries, and components of queries, that are sent to the indexes at once.
SHARD_ROWS, BLOCK_QUERIES, BLOCK_VALUES = 8192, 4096, 1 << 22
#: Quantised impacts, queries whose scores are held at once, and the share of all postings from which a level is kept as a block.
LEVELS, TOGETHER, DENSE = 8, 256, 1 / 32


class ImpactIndex:
    """The postings of some vectors, rows of integers; ids break ties, keys tell rows apart."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, levels: int = LEVELS) -> None:
        self.rows, self.ids, self.keys = rows, ids, keys
        self.low, self.high = rows.min(0), rows.max(0)
        impact = np.hstack([rows - self.low, self.high - rows])  # rows x lists
        self.width = max(1.0, np.ceil((impact.max(initial=0) + 1) / levels))
        self.level = (impact // self.width).astype(np.int8)
        self.most = impact.max(initial=0)
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]] | np.ndarray] = []  # by level: (list, rows, impacts), or a block
        for i in range(int(self.level.max(initial=0)) + 1):
            here = self.level == i
            if np.count_nonzero(here) > DENSE * here.size:
                self.segments.append(np.where(here, impact, 0))
            else:
                lists = np.flatnonzero(here.any(0))
                self.segments.append([(j, r := np.flatnonzero(here[:, j]), impact[r, j]) for j in lists.tolist()])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query: places and scores of its k best rows, without that of key `own`; ties go to smaller ids.

        bars: for each query a score that k rows elsewhere reach; rows below it are left out.
        """
        out: list = [None] * len(queries)
        bars = np.full(len(queries), -np.inf) if bars is None else bars
        for at in range(0, len(queries), TOGETHER):
            some = slice(at, at + TOGETHER)
            for i, found in self._search(queries[some], own[some], k, bars[some]):
                out[at + i] = found
        return out

    def _search(self, queries: np.ndarray, own: np.ndarray, k: int, bars: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        n = len(self.ids)
        wanted = min(n, k + 1)  # the query's own row may be among them
        few = max(8 * wanted, n // 32)
        weights = np.hstack([np.maximum(queries, 0), np.maximum(-queries, 0)]).T
        # what each score leaves out: weights times the values at which the lists' impacts are 0
        base = np.maximum(queries, 0) @ self.low - np.maximum(-queries, 0) @ self.high
        # single precision holds whole numbers below 2^24 exactly
        exact = np.float32 if (self.most + self.width) * weights.sum(0).max(initial=0) < 1 << 24 else np.float64
        weights, bars = weights.astype(exact), bars - base
        open_, score = np.arange(len(queries)), np.zeros((n, len(queries)), exact)
        for i in range(len(self.segments) - 1, -1, -1):
            w, segments = weights[:, open_], self.segments[i]
            if isinstance(segments, np.ndarray):
                score += segments.astype(exact) @ w
            else:
                for j, rows, impacts in segments:
                    score[rows] += impacts[:, None].astype(exact) * w[j]
            # what the lists not yet reached add at most
            most, unseen = max(0.0, i * self.width - 1), (self.level < i).astype(exact)

            def possible(cols: np.ndarray) -> np.ndarray:
                seen = score[:, cols]
                least = np.maximum(np.partition(seen, n - wanted, axis=0)[n - wanted], bars[open_[cols]])
                return seen + unseen @ w[:, cols] * exact(most) >= least

            # a few queries first: where these are far from a proof, so are the others
            if i and np.count_nonzero(possible(np.arange(0, len(open_), 32)), axis=0).min() > few:
                continue
            may = possible(np.arange(len(open_)))
            proved = np.full(len(open_), True) if i == 0 else np.count_nonzero(may, axis=0) <= few
            for c in np.flatnonzero(proved):
                q = open_[c]
                yield q, self._best(np.flatnonzero(may[:, c]), queries[q], own[q], k)
            open_, score = open_[~proved], score[:, ~proved]
            if not len(open_):
                return

    def _best(self, possible: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        possible = possible[self.keys[possible] != own]
        exact = self.rows[possible] @ query
        if len(possible) > k:
            keep = np.flatnonzero(exact >= np.partition(exact, len(exact) - k)[len(exact) - k])
            possible, exact = possible[keep], exact[keep]
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return possible[best], exact[best]


def _matrix(vectors: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    flat = vectors.to_pylist()
    out = np.zeros((len(flat), max(width, max(map(len, flat), default=0))))
    for i, v in enumerate(flat):
        out[i, : len(v)] = v
    return out


def _search(queries: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch], k: int, shard_rows: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of a task for each query: query (its key), id, score."""
    own, q = queries
    if not len(own):
        return
    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(own)

    def show(shard: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(shard)
        x = _matrix(t["v"], q.shape[1])
        index = ImpactIndex(x, t["id"].to_numpy(), t["key"].to_numpy())
        wide = np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1])))
        bars = np.array([scores[-1] if len(scores) == k else -np.inf for _, scores in best])
        for i, (at, new) in enumerate(index.search(wide, own, k, bars)):
            if len(at):
                ids, scores = np.concatenate((best[i][0], index.ids[at])), np.concatenate((best[i][1], new))
                order = np.lexsort((ids, -scores))[:k]
                best[i] = ids[order], scores[order]

    shard, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, shard_rows):
            part = b.slice(at, shard_rows)
            if n + part.num_rows > shard_rows and shard:
                show(shard)
                shard, n = [], 0
            shard.append(part)
            n += part.num_rows
    if shard:
        show(shard)
    cols = np.repeat(own, [len(x) for x, _ in best]), *(np.concatenate([b[i] for b in best]) for i in range(2))
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query", "id", "score"])


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """For each row whose id is divisible by `every`: its k greatest integer inner products with other rows.

    Components x become floor(scale * x). Returns query_id, rank, vec_id, score;
    ties go to the smaller id. Vectors stay where they are, in a staged table;
    a block of queries, of at most about block_queries vectors and BLOCK_VALUES
    components, is sent to all of them, and each task answers with the k best
    of its rows. A task indexes shard_rows vectors at a time, and what it has
    found in one index is the bar for the next.

    Vectors that are null or hold null, NaN or infinite components, and null
    ids, take no part. Rows are told apart by a number, not by their id: of rows
    that repeat an id each is a candidate, and each is a query with ranks of its
    own if the id is divisible; only a query's own row is left out. A vector
    shorter than another counts as filled with zeros; an empty one has score 0.
    Scores are exact while they stay below 2^53. Empty table: no rows. Extra
    columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e")).filter(
        F.col("id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    with scratch() as keep:
        ints = good.select("id", F.transform("e", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
        rows = stage(ints.withColumn("key", F.monotonically_increasing_id()), "topk-rows")
        asked = rows.filter(F.col("id") % every == 0)
        n, dims = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        blocks = max(1, -(-n // min(block_queries, max(1, BLOCK_VALUES // max(1, dims)))))
        found = []
        for b in range(blocks):
            t = asked.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key", "v").toArrow()
            sent = spark.sparkContext.broadcast((t["key"].to_numpy(), _matrix(t["v"])))
            answers = rows.mapInArrow(lambda batches: _search(sent.value, batches, k, shard_rows), "query long, id long, score long")
            found.append(stage(answers, "topk-found"))
            sent.destroy()
        keep += [rows, *found]
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    best = reduce(DataFrame.union, found).withColumn("rank", rank).filter(F.col("rank") <= k)
    names = asked.select(F.col("key").alias("query"), F.col("id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
