"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.text import STOPWORDS

STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_sql(table: str, column: str) -> str:
    """CTEs (of a WITH RECURSIVE) that end in crc_of(column, h): the crc32 of every different string, from its definition."""
    return f"""crc_bit(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bit WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bit WHERE k = 8),
crc_hex AS (SELECT {column}, hex(encode({column})) AS x FROM (SELECT DISTINCT {column} FROM {table})),
crc_of AS MATERIALIZED (SELECT {column}, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda p: ('0x' || x[p:p + 1])::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM crc_hex, crc_table)"""
