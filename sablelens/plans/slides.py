"""A slide relation derived from the driver's orders and customers.

The driver's tables hold no slides; this deterministic projection of them gives labels, names, properties and
metadata texts of all formats, one slide in five already anonymised, so that every scan has work that SQL can
check. One text serves Spark and DuckDB; they differ in how they format times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Prefixes by order key modulo 9, suffixes by order key modulo 7.
PREFIXES = ("AS", "AC", "SP", "AP", "CY", "H", "S", "CH", "MRN")
SUFFIXES = ("ndpi", "svs", "bif", "scn", "mrxs", "dcm", "TIFF")

_SQL = """
WITH base AS (
  SELECT o_orderkey AS slide_id, o_orderkey % 5 = 0 AS done, o_orderdate AS taken, c_name AS person, lpad(CAST(o_orderkey AS STRING), 6, '0') AS num,
         CASE o_orderkey % 9 {prefixes} END AS prefix, CASE o_orderkey % 7 {suffixes} END AS suffix
  FROM orders JOIN customer ON o_custkey = c_custkey),
coded AS (
  SELECT *, CASE WHEN prefix = 'CH' THEN concat(prefix, num) WHEN prefix = 'MRN' THEN concat('MRN-', num) ELSE concat(prefix, '-', {yy}, '-', num) END AS code FROM base)
SELECT slide_id, done, person, code, taken,
  concat(CASE WHEN slide_id % 3 = 0 THEN code ELSE concat('slide_', num) END, '.', suffix) AS name,
  CASE WHEN done THEN repeat('X', length(code)) ELSE concat(code, ' ', {tiff_time}) END AS label_text,
  CASE WHEN done THEN '1900:01:01 00:00:00' ELSE {tiff_time} END AS time_tag,
  concat('NDP.S/N=', CASE WHEN done THEN 'XXXXXX' ELSE num END, chr(10), 'Objective.Lens=20', chr(10), 'Created=', CASE WHEN done THEN 'XXXXXXXXXX' ELSE {slash_date} END, chr(10), 'Operator.Id= ', CASE WHEN done THEN '' ELSE person END) AS props,
  concat('Image Library v12', chr(10), '1000x800|AppMag = 40|ScanScope ID = ', CASE WHEN done THEN 'XXXXXXXX' ELSE concat('SS', num) END, '|Filename = ', CASE WHEN done THEN 'XXXX' ELSE code END,
         '|Date = ', CASE WHEN done THEN '01/01/00' ELSE {us_date} END, '|Time = ', CASE WHEN done THEN '00:00:00' ELSE {clock} END, '|User = ', CASE WHEN done THEN '' ELSE person END, '|MPP = 0.25') AS svs_text,
  concat('<xmp><iScan BarCode1="', CASE WHEN done THEN 'XXXX' ELSE code END, '" ScanDate="', CASE WHEN done THEN 'XXXXXXXXXX' ELSE {slash_date} END, '" OperatorID = "', CASE WHEN done THEN '' ELSE person END, '" Magnification="40" UniqueID=""/></xmp>') AS xmp_text,
  concat('<?xml version="1.0"?><scn><image><barcode>', CASE WHEN done THEN 'XXXX' ELSE code END, '</barcode><creationDate>', CASE WHEN done THEN 'XX' ELSE {slash_date} END, '</creationDate><device kind="', CASE WHEN done THEN 'XXXX' ELSE concat('D', num) END, '" operator="', CASE WHEN done THEN '' ELSE person END, '"/></image></scn>') AS scn_text
FROM coded
"""


def _text(times: dict[str, str]) -> str:
    cases = lambda values: " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return _SQL.format(prefixes=cases(PREFIXES), suffixes=cases(SUFFIXES), **times)


SPARK_SQL = _text({"yy": "date_format(taken, 'yy')", "tiff_time": "date_format(taken, 'yyyy:MM:dd HH:mm:ss')", "slash_date": "date_format(taken, 'yyyy/MM/dd')", "us_date": "date_format(taken, 'MM/dd/yy')", "clock": "date_format(taken, 'HH:mm:ss')"})
DUCK_SQL = _text({"yy": "strftime(taken, '%y')", "tiff_time": "strftime(taken, '%Y:%m:%d %H:%M:%S')", "slash_date": "strftime(taken, '%Y/%m/%d')", "us_date": "strftime(taken, '%m/%d/%y')", "clock": "strftime(taken, '%H:%M:%S')"})


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPARK_SQL.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
