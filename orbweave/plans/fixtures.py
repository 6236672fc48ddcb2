"""Views of the driver's tables that look like catalogs, networks, partitions and ensembles.

Each is one SQL statement that Spark and DuckDB both run; a view may use those before it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "region", "events", "orders", "customer", "lineitem", "supplier", "part")

VIEWS = {
    "fx_cells": """
SELECT CAST(n_nationkey AS BIGINT) AS cell, CAST(-60 + 30 * floor(n_nationkey / 5) AS DOUBLE) AS lat,
       CAST(-144 + 72 * (n_nationkey % 5) AS DOUBLE) AS lon, CASE WHEN r_name = 'AFRICA' THEN 'Sea' ELSE r_name END AS continent
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "fx_catalog_a": """
SELECT trackid, seq, event_id, time, k, cell, mean_ivt, regime, CAST(-180 + 3.6 * k AS DOUBLE) AS centroid_lon,
       CAST(-90 + 1.8 * ((k * 7) % 100) AS DOUBLE) AS centroid_lat, CASE WHEN k % 7 = 0 THEN CAST(-180 + 3.6 * k AS DOUBLE) END AS lf_lon,
       CASE WHEN k = 99 THEN NULL ELSE cell END AS coord_idx
FROM (SELECT user_id AS trackid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, event_id, ts AS time, k,
             CAST(floor(k / 4) AS BIGINT) AS cell, value AS mean_ivt, event_type AS regime
      FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) e) t""",
    "fx_catalog_b": """
SELECT o_custkey AS trackid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq,
       CAST(o_orderdate AS TIMESTAMP) AS time, CAST(o_orderkey % 25 AS BIGINT) AS cell, CAST(o_orderkey % 25 AS BIGINT) AS coord_idx,
       CAST(o_totalprice AS DOUBLE) AS mean_ivt, o_orderpriority AS regime
FROM orders""",
    "fx_pairs": """
SELECT trackid, seq, orig, dest, orig_ivt, dest_ivt
FROM (SELECT trackid, seq, coord_idx AS orig, mean_ivt AS orig_ivt, lead(coord_idx) OVER (PARTITION BY trackid ORDER BY seq) AS dest,
             lead(mean_ivt) OVER (PARTITION BY trackid ORDER BY seq) AS dest_ivt
      FROM fx_catalog_a WHERE coord_idx IS NOT NULL) p
WHERE dest IS NOT NULL""",
    "fx_edges": """
SELECT CAST(trackid % 2 AS BIGINT) AS net, orig, dest, CAST(count(*) AS DOUBLE) AS weight
FROM fx_pairs WHERE orig <> dest GROUP BY 1, 2, 3""",
    "fx_flow": """
SELECT orig AS src, dest AS dst, weight / (SELECT sum(weight) FROM fx_edges WHERE net = 0) AS flow FROM fx_edges WHERE net = 0""",
    "fx_index": """
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(avg(o_totalprice) AS DOUBLE) AS idx FROM orders GROUP BY 1, 2""",
    "fx_partitions": """
SELECT CAST(seed AS BIGINT) AS seed, k AS node, CAST(CASE WHEN (k * seed + floor(k / 10)) % 9 = 8 THEN -999 ELSE (k * seed + floor(k / 10)) % 9 END AS BIGINT) AS community
FROM (SELECT DISTINCT k FROM fx_catalog_a) n CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS s(seed)""",
    "fx_levels": """
SELECT CAST(level AS BIGINT) AS level, cell AS node, CAST(floor(cell / (10 - 3 * level)) + 100 * level AS BIGINT) AS community
FROM fx_cells CROSS JOIN (VALUES (0), (1), (2)) AS l(level)""",
    "fx_null": """
SELECT CAST(model AS BIGINT) AS model, CAST(realization AS BIGINT) AS realization, cell, CAST(((cell * 31 + realization * 17 + model * 7) % 100) AS DOUBLE) AS metric
FROM fx_cells CROSS JOIN (VALUES (1), (2), (3), (4)) AS m(model) CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS r(realization)""",
    # a network that grows with the data: orders, parts, suppliers and customers as nodes
    "fx_trade": """
SELECT orig, dest, CAST(sum(weight) AS DOUBLE) AS weight
FROM (SELECT CAST(l_orderkey AS BIGINT) * 4 AS orig, CAST(l_partkey AS BIGINT) * 4 + 1 AS dest, CAST(l_quantity AS DOUBLE) AS weight FROM lineitem
      UNION ALL SELECT CAST(l_orderkey AS BIGINT) * 4, CAST(l_suppkey AS BIGINT) * 4 + 2, CAST(l_quantity AS DOUBLE) FROM lineitem
      UNION ALL SELECT CAST(l_partkey AS BIGINT) * 4 + 1, CAST(l_suppkey AS BIGINT) * 4 + 2, CAST(l_quantity AS DOUBLE) FROM lineitem
      UNION ALL SELECT CAST(o_custkey AS BIGINT) * 4 + 3, CAST(o_orderkey AS BIGINT) * 4, CAST(1 AS DOUBLE) FROM orders) links
GROUP BY orig, dest""",
}


class Fixtures:
    """The tables and views over one directory, as frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            sql = VIEWS[name]
            used = {n: self.view(n) for n in VIEWS if n != name and _uses(sql, n)} | {n: self.table(n) for n in TABLES if _uses(sql, n)}
            for n in used:
                sql = _braced(sql, n)
            self._made[name] = self.spark.sql(sql, **used)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in VIEWS:
            return self.view(f"fx_{name}")
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def nodes(self) -> DataFrame:
        """fx_cells as nodes: coord_id, lat, lon, continent."""
        return self.view("fx_cells").withColumnRenamed("cell", "coord_id")


def _uses(sql: str, name: str) -> bool:
    import re

    return re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql) is not None


def _braced(sql: str, name: str) -> str:
    import re

    return re.sub(rf"((?:FROM|JOIN)\s+){name}\b", rf"\1{{{name}}}", sql)


def with_views(sql: str) -> str:
    """``sql`` after a WITH clause of all views."""
    views = ",\n".join(f"{n} AS ({s})" for n, s in VIEWS.items())
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{sql.lstrip()[len('WITH RECURSIVE'):]}"
    return f"WITH {views},\n{sql[4:].lstrip()}" if sql.lstrip().upper().startswith("WITH") else f"WITH {views}\n{sql}"
