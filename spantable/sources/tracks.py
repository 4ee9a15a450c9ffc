"""Tracks: tables of intervals on chromosomes.

A signal track has chrom, s, e, v: [s, e) with a value, rows not overlapping. A
feature track has chrom, s, e and maybe rest, rows may overlap. Regions are
features with an id. Coordinates are 0-based longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal track made of the orders table: gaps, touching rows and values that are multiples of 1/4."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(
        "concat('chr', cast(o_orderkey % 5 + 1 as string)) as chrom",
        "cast(floor(o_orderkey / 5) * 32 as bigint) as s",
        "cast(floor(o_orderkey / 5) * 32 + 8 + o_custkey % 25 as bigint) as e",
        "cast(floor(o_totalprice / 1000) / 4 as double) as v",
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature track made of the lineitem table, several features deep; rest holds four tab-separated fields."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "concat('chr', cast(l_linenumber % 5 + 1 as string)) as chrom",
        "cast(l_partkey * 16 + l_suppkey % 16 as bigint) as s",
        "cast(l_partkey * 16 + l_suppkey % 16 + l_quantity as bigint) as e",
        "concat_ws('\t', concat('f', cast(l_orderkey as string)), l_returnflag, l_linestatus, cast(l_linenumber as string)) as rest",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query regions made of the part table, and three that no signal covers: beyond the end, on a chromosome of its own, and empty."""
    made = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey as id", "concat('chr', cast(p_partkey % 5 + 1 as string)) as chrom", "cast(p_partkey * 40 as bigint) as s", "cast(p_partkey * 40 + p_size * 20 as bigint) as e", "p_name as name"
    )
    more = spark.createDataFrame([(-1, "chr1", 10**9, 10**9 + 50, "far"), (-2, "chrX", 10, 60, "other"), (-3, "chr2", 100, 100, "empty")], "id long, chrom string, s long, e long, name string")
    return made.select("id", "chrom", "s", "e", "name").union(more)


def chrom_sizes(track: DataFrame, slack: int = 100) -> DataFrame:
    """Chromosomes of a track with a length: its last end and some slack."""
    from pyspark.sql import functions as F

    return track.groupBy("chrom").agg((F.max("e") + slack).cast("long").alias("length"))


#: The same tracks in SQL, as the beginning of a WITH clause.
SQL = """
sig AS (SELECT concat('chr', CAST(o_orderkey % 5 + 1 AS STRING)) AS chrom, CAST(floor(o_orderkey / 5) * 32 AS BIGINT) AS s,
  CAST(floor(o_orderkey / 5) * 32 + 8 + o_custkey % 25 AS BIGINT) AS e, CAST(floor(o_totalprice / 1000) / 4 AS DOUBLE) AS v FROM orders),
bed AS (SELECT concat('chr', CAST(l_linenumber % 5 + 1 AS STRING)) AS chrom, CAST(l_partkey * 16 + l_suppkey % 16 AS BIGINT) AS s,
  CAST(l_partkey * 16 + l_suppkey % 16 + l_quantity AS BIGINT) AS e,
  concat_ws(chr(9), concat('f', CAST(l_orderkey AS STRING)), l_returnflag, l_linestatus, CAST(l_linenumber AS STRING)) AS rest FROM lineitem),
reg AS (SELECT p_partkey AS id, concat('chr', CAST(p_partkey % 5 + 1 AS STRING)) AS chrom, CAST(p_partkey * 40 AS BIGINT) AS s,
  CAST(p_partkey * 40 + p_size * 20 AS BIGINT) AS e, p_name AS name FROM part
  UNION ALL SELECT -1, 'chr1', 1000000000, 1000000050, 'far' UNION ALL SELECT -2, 'chrX', 10, 60, 'other' UNION ALL SELECT -3, 'chr2', 100, 100, 'empty')
"""
