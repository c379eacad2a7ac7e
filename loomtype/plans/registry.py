"""Registered queries, and inputs that the same SQL text derives in Spark and DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f

    return register


def derive(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run ``sql`` over the named driver tables."""
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def text(sql: str, *tables: str) -> str:
    """``sql`` as Spark reads it: table names in braces stand for DataFrames."""
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return sql


# Stand-ins derived from the driver's tables; the tables hold no reads or alleles.

_NAME = ("concat(locus, '*', lpad(CAST(f1 AS STRING), 2, '0'), ':', lpad(CAST(f2 AS STRING), 2, '0'), "
         "CASE WHEN f3 > 0 THEN concat(':', lpad(CAST(f3 AS STRING), 2, '0')) ELSE '' END, "
         "CASE WHEN f4 > 0 THEN concat(':', lpad(CAST(f4 AS STRING), 2, '0')) ELSE '' END, coalesce(suffix, ''))")

NAMES = f"""
SELECT *, {_NAME} AS allele,
  CASE WHEN allele_id % 17 = 0 THEN 'Q*01' WHEN allele_id % 19 = 0 THEN 'A01:01' WHEN allele_id % 23 = 0 THEN 'A*00:01'
       WHEN allele_id % 29 = 0 THEN 'A*01:01R' WHEN allele_id % 31 = 0 THEN 'A*01*02' ELSE {_NAME} END AS raw
FROM (SELECT p_partkey AS allele_id,
  CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'DRB1' END AS locus,
  CAST(1 + p_partkey % 7 AS INT) AS f1, CAST(1 + p_partkey % 5 AS INT) AS f2, CAST(p_partkey % 3 AS INT) AS f3,
  CAST(CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 2 ELSE 0 END AS INT) AS f4,
  CASE WHEN p_partkey % 11 = 0 THEN 'N' WHEN p_partkey % 13 = 0 THEN 'Q' END AS suffix FROM part)
"""

#: Log-likelihoods are whole thousandths, so that sums are exact in any order.
SCORES = """
SELECT l_orderkey AS read_id, l_suppkey AS allele_id, max(-CAST(round(l_extendedprice) AS BIGINT)) AS llhd,
  CAST(min(l_linenumber) AS BIGINT) AS pos, CASE WHEN l_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS locus
FROM lineitem GROUP BY l_orderkey, l_suppkey
"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, text(NAMES, "part"), "part")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, text(SCORES, "lineitem"), "lineitem")
