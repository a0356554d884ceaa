"""Common table expressions of the SQL equivalents."""

from __future__ import annotations

import re

# The constants below are those of the sphere and the grid in gridloom.functions and gridloom.sources.
CTES = {
    "cells": """SELECT CAST(user_id AS INTEGER) AS "row", CAST(day(ts) - 1 AS INTEGER) AS col, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS radar,
      CAST(max(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS height, CAST(min(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS emissivity, CAST(count(*) AS BIGINT) AS slope,
      CAST(sum(CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT)) AS BIGINT) AS reflectivity FROM events WHERE day(ts) <= 30 GROUP BY 1, 2""",
    "grid": """SELECT r."row", CAST(c.col AS INTEGER) AS col, radar, height, emissivity, slope, reflectivity
      FROM (SELECT DISTINCT "row" FROM cells) r CROSS JOIN (SELECT unnest(range(30)) AS col) c LEFT JOIN cells s ON s."row" = r."row" AND s.col = c.col""",
    "clusters": """SELECT "row", col, CAST(CASE WHEN slope IS NOT NULL THEN least(slope - 1, 3) END AS INTEGER) AS cluster FROM grid""",
    "items": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, CAST(p_size AS DOUBLE) AS size
      FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "geo": """SELECT *, CAST(-180 + 12 * (col + 0.5) AS DOUBLE) AS lon, 90 - (180.0 / h) * ("row" + 0.5) AS lat,
      6051.0 * 6051.0 * radians(12.0) * abs(sin(radians(90 - (180.0 / h) * "row")) - sin(radians(90 - (180.0 / h) * ("row" + 1)))) AS area
      FROM (SELECT *, max("row") OVER () + 1 AS h FROM clusters)""",
    "counts": """SELECT o_orderpriority AS cluster, n_name AS geology, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""",
    "vec": """SELECT vec_id AS id, label, CAST(embedding[1:5] AS DOUBLE[]) AS x FROM embeddings""",
}


def complete(sql: str) -> str:
    """``sql`` with the expressions it names put in front."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name, body in CTES.items():
            if name not in wanted and re.search(rf"(?i)\b(from|join)\s+{name}\b", text):
                need(body)
                wanted.append(name)

    need(sql)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    m = re.match(r"(?is)\s*with\s+(recursive\s+)?", sql)
    if not head:
        return sql
    return f"WITH {m[1] or ''}{head}, {sql[m.end():]}" if m else f"WITH {head} {sql}"
