"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spantable.cluster import scratch, stage
from spantable.llm.text import n_words

SEED = 17
WEIGHTS = (3.0, 1.0, 2.0)


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    """What orders the documents of a source: a seeded hash of id and text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def _ranked(df: DataFrame, by: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """df with rn, the place of each row in the order of `by` from 1, and for each new column of sums the sum of the other over all rows before.

    Rows are dealt by ranges of `by`, which must tell them apart; a window adds up
    within each range and one more over the ranges, as many rows as partitions.
    """
    dealt = stage(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), name)
    ranges = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_rn"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in ["_rn", *(f"_{n}" for n in sums)]])
    inside = Window.partitionBy("_range").orderBy(*by)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(ranges, "_range").withColumn("rn", F.row_number().over(inside) + F.col("_rn"))
    return out.withColumns({n: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.col(f"_{n}") for n, c in sums.items()}).drop("_range", "_rn", *(f"_{n}" for n in sums))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Targets for sources(source, source_size, weight): share * all sizes, split by weight.

    A source is clamped at epochs times its size; what it cannot take is split
    by weight among the rest until none is above its clamp. In the order of
    clamp / weight the clamped sources are a prefix, so the first prefix whose
    level fits all the others gives the answer without iteration. Other columns
    pass through.
    """
    size, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    clamped = sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = _ranked(clamped, [F.col("ratio"), F.col("source").asc_nulls_last()], {"caps": "cap", "weights": "weight"}, "mix-ratios")
    level = (F.lit(float(size or 0)) * F.lit(float(share)) - F.col("caps")) / (F.lit(float(weight or 0)) - F.col("weights"))
    first = ranked.withColumn("level", level).filter("level <= ratio").agg(F.min(F.struct("rn", "level")).alias("f")).first()["f"]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first["level"]) * F.col("weight"))
    return clamped.withColumn("target", target).drop("cap", "ratio")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple = WEIGHTS, epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_taken (words) and mix_copies (whole repetitions).

    Sources in code-point order, null last, weigh as `weights` repeats. Each
    source's target comes from water_fill(). A source whose target is r times
    its size gives floor(r) copies of every document and, if that falls short,
    one more copy of a seeded sample: documents in the order of a hash of their
    id and text as long as they fit, then the one further document whose size is
    nearest to what is still missing, if that helps. Copies are whole documents.

    Distributed as a two-level prefix sum: each source's hash range is cut into
    about the square root of its number of documents buckets; only the bucket
    in which the target is reached is ordered row by row. A hot source is
    therefore never in one task. Words are counted once, into a staged table.

    Null text: size 0, taken 0. Null source: a source of its own. Rows are told
    apart by a number: rows that repeat source, id and text, or lack an id, are
    decided one by one, so of equal rows just as many are taken as fit. Empty
    table: no rows. Other columns pass through; columns named mix_* are replaced.
    """
    docs = docs.select([F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if not c.lower().startswith("mix_")])
    return _mix(docs.withColumns({"mix_size": n_words(F.col("text")), "mix_key": _key(F.col("doc_id"), F.col("text"), seed)}), share, weights, epochs)


def _mix(sized: DataFrame, share: float = 1.5, weights: tuple = WEIGHTS, epochs: float = 2.0) -> DataFrame:
    """mix() of rows that have mix_size and mix_key."""
    with scratch() as keep:
        rows = stage(sized.withColumn("mix_row", F.monotonically_increasing_id()), "mix-rows")
        plan = _plan(rows.select("source", F.col("mix_size").alias("size"), F.col("mix_key").alias("key"), F.col("mix_row").alias("row")), share, weights, epochs)
        keep += [rows, plan]
    at, p = F.struct(F.col("mix_key").alias("key"), F.col("mix_row").alias("row")), F.col("mix_plan")
    bucket = _bucket(F.col("mix_key"), p.buckets)
    extra = (p.need > 0) & ((bucket < p.edge) | ((bucket == p.edge) & F.coalesce(at <= p["last"], F.lit(False))) | F.coalesce(at == p.best, F.lit(False)))
    out = rows.join(plan, F.col("source").eqNullSafe(p.source))
    out = out.withColumn("mix_copies", (p.whole + F.coalesce(extra, F.lit(False)).cast("long")).cast("long"))
    return out.withColumns({"mix_source_size": p.source_size, "mix_target": p.target, "mix_taken": F.col("mix_copies") * F.col("mix_size")}).drop("mix_plan", "mix_key", "mix_row")


def _bucket(key: Column, buckets: Column) -> Column:
    """A bucket from 0 to buckets - 1, in the order of the keys."""
    return F.floor(F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(16**12)) * buckets).cast("long")


def _plan(rows: DataFrame, share: float, weights: tuple, epochs: float) -> DataFrame:
    """mix_plan, one row a source: what decides how often each of its documents is taken. rows: source, size, key, row."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("buckets"))
    sources = _ranked(sources, [F.col("source").asc_nulls_last()], {}, "mix-sources")
    turn = ((F.col("rn") - 1) % len(weights) + 1).cast("int")
    sources = stage(sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).drop("rn"), "mix-weights")
    targets = water_fill(sources, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))).otherwise(0).cast("long")
    targets = stage(targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")

    def with_plan(p: DataFrame, *cols: str) -> DataFrame:
        """Rows of the sources that need more than whole copies."""
        p = p.filter("need > 0").select(F.col("source").alias("s"), *cols)
        return rows.join(p, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", _bucket(F.col("key"), F.col("buckets")))

    def add(p: DataFrame, more: DataFrame) -> DataFrame:
        return p.join(more, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    sums = with_plan(targets, "buckets", "need").groupBy("source", "bucket", "need").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).filter(F.col("before") <= F.col("need"))
    edge = edge.groupBy("source").agg(F.max(F.struct("bucket", "before")).alias("e")).select(F.col("source").alias("s"), F.col("e.bucket").alias("edge"), "e.before")
    targets = stage(add(targets, edge), "mix-edges")

    at = F.struct("key", "row")
    order = Window.partitionBy("source").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = with_plan(targets, "buckets", "edge", "before", "need").filter(F.col("bucket") == F.col("edge"))
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(order)).filter(F.col("upto") <= F.col("need"))
    last = last.groupBy(F.col("source").alias("s")).agg(F.max(at).alias("last"), F.max("upto").alias("filled"))
    targets = stage(add(targets, last).withColumn("gap", F.col("need") - F.coalesce("filled", "before", F.lit(0))), "mix-prefixes")

    miss = F.abs(F.col("size") - F.col("gap"))
    best = with_plan(targets, "buckets", "edge", "last", "gap").filter((F.col("bucket") > F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.col("last").isNull() | (at > F.col("last")))))
    best = best.filter(miss < F.col("gap")).groupBy(F.col("source").alias("s")).agg(F.min(F.struct(miss.alias("miss"), at.alias("at"))).alias("b")).select("s", F.col("b.at").alias("best"))
    return stage(add(targets, best).select(F.struct("source", "source_size", "target", "whole", "need", "buckets", "edge", "last", "best").alias("mix_plan")), "mix-plan")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = _mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("mix_size"), _key(F.col("doc_id"), F.col("text"), SEED).alias("mix_key")))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key,
         row_number() OVER () AS nr
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS rn,
  (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER ()
    - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r),
t AS (SELECT *, coalesce(least(cap, (SELECT arg_min(level, rn) FROM o WHERE level <= ratio) * weight), cap) AS target FROM o),
n AS (SELECT source, source_size, target,
  CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
  target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS need FROM t),
j AS (SELECT d.*, n.source_size, n.target, n.whole, n.need,
  CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, nr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
g AS (SELECT *, need - coalesce(max(CASE WHEN upto <= need THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM j),
b AS (SELECT *, CASE WHEN upto > need AND abs(size - gap) < gap THEN abs(size - gap) END AS miss FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss NULLS LAST, key, nr) AS nth FROM b)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN upto <= need OR (miss IS NOT NULL AND nth = 1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k
"""
