"""Code graph projected from the star-schema tables.

The tables hold no source code, so nodes and edges are derived from their keys by SQL that any
engine can run: the text below is used as is by Spark and by the SQL checks.
``@name`` marks a base table.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import sized

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
_MARK = re.compile(r"@(" + "|".join(TABLES) + r")\b")

NODES = """
SELECT concat('region:', r_regionkey) AS id, 'PROJECT' AS kind, r_name AS name,
       concat('src/core/region_', CAST(floor(r_regionkey / 20) AS BIGINT), '.py') AS file, CAST(r_regionkey % 20 * 20 AS INT) AS line,
       CAST(NULL AS DOUBLE) AS criticality FROM @region
UNION ALL
SELECT concat('nation:', n_nationkey), 'MODULE', n_name,
       concat('src/core/nation_', CAST(floor(n_nationkey / 20) AS BIGINT), '.py'), CAST(n_nationkey % 20 * 20 AS INT), CAST(NULL AS DOUBLE) FROM @nation
UNION ALL
SELECT concat('customer:', c_custkey), 'CLASS', c_name,
       concat('src/', lower(c_mktsegment), '/customer_', CAST(floor(c_custkey / 20) AS BIGINT), '.py'), CAST(c_custkey % 20 * 20 AS INT),
       CASE WHEN c_acctbal < 0 THEN 2.5 END FROM @customer
UNION ALL
SELECT concat('supplier:', s_suppkey), 'EXTERNAL_LIBRARY', s_name,
       concat('vendor/supplier_', CAST(floor(s_suppkey / 20) AS BIGINT), '.go'), CAST(s_suppkey % 20 * 20 AS INT), CAST(NULL AS DOUBLE) FROM @supplier
UNION ALL
SELECT concat('part:', p_partkey), 'FUNCTION', p_name,
       concat('src/', replace(lower(p_brand), '#', '_'), '/part_', CAST(floor(p_partkey / 20) AS BIGINT), '.py'), CAST(p_partkey % 20 * 20 AS INT),
       CASE WHEN p_size = 50 THEN 1.75 END FROM @part
UNION ALL
SELECT concat('order:', o_orderkey), CASE WHEN o_orderpriority = '1-URGENT' THEN 'ROUTE' ELSE 'METHOD' END,
       concat('order_', o_orderkey),
       CASE WHEN o_orderstatus = 'P' THEN concat('area_', CAST(floor(o_orderkey / 200) AS BIGINT), '/test_order_', CAST(floor(o_orderkey / 20) AS BIGINT), '.py')
            ELSE concat('src/orders_', lower(o_orderstatus), '/order_', CAST(floor(o_orderkey / 20) AS BIGINT), '.py') END,
       CAST(o_orderkey % 20 * 20 AS INT), CAST(NULL AS DOUBLE) FROM @orders
"""

# One row per observation; several observations may describe the same edge. ``ord`` is the list order.
EDGE_ROWS = """
SELECT concat(from_id, '__', kind, '__', to_id) AS id, kind, from_id, to_id, source, confidence, rule_id,
       status, warning, ev_text, ev_file, ev_line,
       concat(lpad(CAST(seq AS STRING), 20, '0'), '|', lpad(CAST(seq2 AS STRING), 12, '0'), '|', source, '|', rule_id) AS ord, shipped FROM (
  SELECT concat('nation:', n_nationkey) AS from_id, concat('region:', n_regionkey) AS to_id, 'CONTAINS' AS kind,
         'EXTRACTED' AS source, CAST(1.0 AS DOUBLE) AS confidence, '' AS rule_id, CAST(NULL AS STRING) AS status,
         CAST(NULL AS STRING) AS warning, 'declared in nation' AS ev_text,
         concat('src/core/nation_', CAST(floor(n_nationkey / 20) AS BIGINT), '.py') AS ev_file, CAST(n_nationkey % 20 * 20 AS INT) AS ev_line,
         CAST(n_nationkey AS BIGINT) AS seq, CAST(0 AS BIGINT) AS seq2, CAST(NULL AS DATE) AS shipped FROM @nation
  UNION ALL
  SELECT concat('customer:', c_custkey), concat('nation:', c_nationkey), 'DECLARES', 'EXTRACTED', CAST(1.0 AS DOUBLE), '',
         CAST(NULL AS STRING), CAST(NULL AS STRING), 'customer of nation',
         concat('src/', lower(c_mktsegment), '/customer_', CAST(floor(c_custkey / 20) AS BIGINT), '.py'), CAST(c_custkey % 20 * 20 AS INT),
         c_custkey, 0, CAST(NULL AS DATE) FROM @customer
  UNION ALL
  SELECT concat('supplier:', s_suppkey), concat('nation:', s_nationkey), 'DECLARES', 'EXTERNAL_TOOL', CAST(0.8 AS DOUBLE), '',
         CAST(NULL AS STRING), CAST(NULL AS STRING), 'supplier of nation',
         concat('vendor/supplier_', CAST(floor(s_suppkey / 20) AS BIGINT), '.go'), CAST(s_suppkey % 20 * 20 AS INT), s_suppkey, 0, CAST(NULL AS DATE)
         FROM @supplier
  UNION ALL
  SELECT concat('order:', o_orderkey), concat('customer:', o_custkey), 'CALLS', 'INFERRED', CAST(0.9 AS DOUBLE), 'owner',
         CAST(NULL AS STRING), CAST(NULL AS STRING), 'order of customer',
         concat('src/orders_', lower(o_orderstatus), '/order_', CAST(floor(o_orderkey / 20) AS BIGINT), '.py'), CAST(o_orderkey % 20 * 20 AS INT),
         o_orderkey, 0, CAST(o_orderdate AS DATE) FROM @orders
  UNION ALL
  SELECT concat('order:', l_orderkey),
         CASE WHEN l_quantity = 1 THEN concat('missing:', l_partkey) ELSE concat('part:', l_partkey) END,
         CASE WHEN l_tax > 0.079 THEN 'TESTS' ELSE 'CALLS' END,
         CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'SUPPORT_PACK' END,
         round(1 - 5 * l_discount, 2), concat('rule_', l_linestatus),
         CASE WHEN l_suppkey % 40 = 3 THEN 'weak' WHEN l_suppkey % 40 = 7 THEN 'rejected'
              WHEN l_suppkey % 40 = 11 THEN 'confirmed' END,
         CASE WHEN l_suppkey % 23 = 0 THEN 'ambiguous target' WHEN l_suppkey % 29 = 0 THEN 'Method Mismatch on call' END,
         CASE WHEN l_linenumber < 7 THEN concat('ships line ', l_linenumber) END,
         CASE WHEN l_linenumber < 7 THEN concat('src/lines/order_', CAST(floor(l_orderkey / 20) AS BIGINT), '.py') END,
         CASE WHEN l_linenumber < 7 THEN l_linenumber END,
         l_orderkey * 100000 + l_partkey * 10 + l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) FROM @lineitem
) e
"""

# Several observations of each part node, in list order, with clashing kinds, names and lines.
NODE_ROWS = """
SELECT concat('part:', l_partkey) AS id,
       CASE l_linestatus WHEN 'O' THEN 'METHOD' ELSE 'FUNCTION' END AS kind,
       CASE WHEN l_linenumber > 4 THEN '' ELSE concat('part_', l_partkey, '_', l_returnflag) END AS name,
       l_returnflag AS tag, l_linenumber AS line,
       concat(lpad(CAST(l_orderkey AS STRING), 18, '0'), '|', l_linenumber, '|', lpad(CAST(l_suppkey AS STRING), 12, '0'), '|',
              l_returnflag, l_linestatus) AS ord
FROM @lineitem
"""


def spark_text(sql: str, sf_dir: str) -> str:
    """Point ``@table`` at the Parquet files for Spark."""
    return _MARK.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", sql)


def duck_text(sql: str) -> str:
    """Point ``@table`` at the registered views of the checking engine."""
    return _MARK.sub(lambda m: m.group(1), sql)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return sized(spark).sql(spark_text(sql, sf_dir))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sized(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input comes in fewer pieces than there are; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, NODES)


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge observations, one row per (edge, evidence item), warnings as an array."""
    flat = spread(run(spark, sf_dir, EDGE_ROWS))
    return flat.withColumn("warnings", F.when(F.col("warning").isNotNull(), F.array("warning"))).drop("warning")


def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, NODE_ROWS)
