"""Bindings of the test tables to candidates of queries: plain SELECTs that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A customer's order lines are a query's candidates; the part with the customer's number gives the query's words.
CANDIDATES = """
SELECT concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING), CAST(l.l_suppkey AS STRING), CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS STRING)) AS example_id,
  CASE WHEN o.o_custkey % 3 = 0 THEN q.p_brand || ' ' || q.p_name || ' ' || q.p_type ELSE q.p_name || ' ' || q.p_type END AS query,
  o.o_custkey AS query_id, l.l_partkey AS product_id,
  CASE WHEN s.s_nationkey % 5 = 0 THEN 'jp' ELSE 'us' END AS product_locale,
  p.p_name || ' ' || p.p_type || CASE WHEN p.p_size > 25 THEN ' xl-' || CAST(p.p_size AS STRING) ELSE '' END AS product_title,
  CASE WHEN p.p_brand = 'Brand#1' THEN NULL ELSE p.p_brand END AS product_brand,
  p.p_type || ' ' || CAST(p.p_size AS STRING) AS product_bullet_point,
  CASE WHEN l.l_returnflag = 'R' THEN 'I' WHEN l.l_returnflag = 'A' THEN 'C' WHEN l.l_linestatus = 'F' THEN 'S' ELSE 'E' END AS esci_label,
  CASE WHEN l.l_returnflag = 'R' THEN 0 WHEN l.l_returnflag = 'A' THEN 1 WHEN l.l_linestatus = 'F' THEN 2 ELSE 3 END AS relevance_gain,
  CASE WHEN l.l_quantity >= 10 THEN 1 ELSE 0 END AS small_version,
  CASE WHEN o.o_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
  JOIN part q ON q.p_partkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
"""
#: Parts as products of both locales; each 20th is absent from one.
PRODUCTS = """
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 20 = 0 THEN 'jp' ELSE 'us' END AS product_locale, p_name AS product_title, p_type AS product_description, p_brand AS product_color FROM part
"""
#: Documents as candidates of their source's benchmark text.
LONG_TEXTS = """
SELECT CAST(d.doc_id AS STRING) AS example_id, d.doc_id AS product_id, d.source AS query_id, b.text AS query, d.text AS product_title
FROM documents d JOIN benchmark b ON b.item_id = CAST(substr(d.source, 4) AS BIGINT) WHERE d.source IS NOT NULL AND d.text IS NOT NULL
"""
#: The first vector of each label as query, every other vector as candidate.
VECTORS = """
SELECT e.vec_id AS example_id, e.label AS query_id, e.vec_id AS product_id, q.embedding AS query_vector, e.embedding AS title_vector
FROM embeddings e JOIN (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label) f ON e.label = f.label JOIN embeddings q ON q.vec_id = f.first WHERE e.vec_id <> f.first
"""
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding over the tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql), **used)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, CANDIDATES)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, PRODUCTS)
