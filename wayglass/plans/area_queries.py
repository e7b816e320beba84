"""Queries over polygons: unions, differences, gaps of regions. Shapes are made from suppliers: rectangles without a corner, in squares of 0.01 degrees, twenty in a row, overlapping their neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayglass.operators import overlay
from wayglass.sources import adapters as src

#: Suppliers of one sheet, cell of the grid, and fixed values: square kilometres of a gap that counts, and of an overlap that is worth a listing.
SHEET, CELL = 200, 0.11
MAX_UNCOVERED_KM2, MIN_USEFUL_KM2 = 1.0, 0.5


def shapes(spark, d):
    """sheet, k, ring."""
    s = src.table(spark, d, "supplier").selectExpr("s_suppkey as k", "s_suppkey % 20 * 3 as x", "(s_suppkey div 20) * 2 % 6000 as y", "2 + s_suppkey % 5 as w", "2 + s_suppkey % 4 as h")
    x, y, w, h = (F.col(c) for c in "xywh")
    corners = [(x, y), (x + w, y), (x + w, y + h - 1), (x + w - 1, y + h - 1), (x + w - 1, y + h), (x, y + h)]
    ring = F.array(*[F.array((a / 100).cast("double"), (b / 100).cast("double")) for a, b in corners])
    return s.select((F.col("k") / SHEET).cast("long").alias("sheet"), "k", ring.alias("ring"))


def _pieces(spark, d):
    s = shapes(spark, d).select(F.col("sheet").cast("string").alias("key"), F.col("k").cast("string").alias("shape"), (F.col("k") % 7 == 0).cast("int").alias("side"), "ring")
    return overlay.cut_rings(s, CELL)


def union_areas(spark, d):
    """Of each sheet the union of its shapes, and what every seventh one leaves of the others, in squares."""
    a = overlay.areas(_pieces(spark, d), CELL).filter("shape is null")
    return a.select(F.col("key").cast("long").alias("sheet"), F.round(F.col("area") * 1e4, 3).alias("area"), F.round(F.col("beyond") * 1e4, 3).alias("beyond"))


def union_outline_length(spark, d):
    b = overlay.boundary(_pieces(spark, d), CELL)
    return b.groupBy(F.col("key").cast("long").alias("sheet")).agg(F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))) * 100, 3).alias("length"))


def region_gaps(spark, d):
    """Each sheet has a region, a box that lists every third shape. Shapes that it doesn't list and that reach into it beyond the listed ones: their gap in square kilometres."""
    s = shapes(spark, d)
    base = F.col("sheet") * 20 % 6000
    box = F.array(F.lit(0.05), (base + 3) / 100, F.lit(0.45), (base + 17) / 100)
    r = s.select(F.col("sheet").cast("string").alias("key"), F.col("k").cast("string").alias("shape"), (F.col("k") % 3 == 0).cast("int").alias("side"), "ring", box.alias("box"))
    gaps = overlay.areas(overlay.cut_rings(r, CELL), CELL).filter("shape is not null").withColumn("sheet", F.col("key").cast("long"))
    gap = overlay.km2(F.col("beyond"), (F.col("sheet") * 20 % 6000 + 10) / 100)
    return gaps.select("sheet", F.col("shape").cast("long").alias("k"), F.round(gap, 4).alias("gap_km2")).filter(F.col("gap_km2") > MAX_UNCOVERED_KM2)


QUERIES = {f.__name__: f for f in (union_areas, union_outline_length, region_gaps)}

SQUARES = f"""
    s AS (SELECT s_suppkey AS k, s_suppkey // {SHEET} AS sheet, s_suppkey % 20 * 3 AS x, s_suppkey // 20 * 2 % 6000 AS y, 2 + s_suppkey % 5 AS w, 2 + s_suppkey % 4 AS h FROM supplier),
    q AS (SELECT sheet, k, i, j FROM (SELECT *, unnest(range(x, x + w)) AS i FROM s) a, LATERAL (SELECT unnest(range(a.y, a.y + a.h)) AS j) b WHERE NOT (i = x + w - 1 AND j = y + h - 1))"""
ORACLES = {
    "union_areas": f"WITH {SQUARES}, c AS (SELECT sheet, i, j, bool_or(k % 7 <> 0) AS a, bool_or(k % 7 = 0) AS b FROM q GROUP BY ALL) SELECT sheet, CAST(count(*) FILTER (a) AS DOUBLE) AS area, CAST(count(*) FILTER (a AND NOT b) AS DOUBLE) AS beyond FROM c GROUP BY sheet",
    "union_outline_length": f"""WITH {SQUARES}, c AS (SELECT sheet, i, j FROM q GROUP BY ALL HAVING bool_or(k % 7 <> 0) AND NOT bool_or(k % 7 = 0)), n AS (SELECT c.*, unnest([1, -1, 0, 0]) AS di, unnest([0, 0, 1, -1]) AS dj FROM c)
        SELECT n.sheet, CAST(count(*) AS DOUBLE) AS length FROM n LEFT JOIN c ON c.sheet = n.sheet AND c.i = n.i + di AND c.j = n.j + dj WHERE c.i IS NULL GROUP BY n.sheet""",
    "region_gaps": f"""WITH {SQUARES}, c AS (SELECT sheet, i, j, k, bool_or(k % 3 = 0) OVER (PARTITION BY sheet, i, j) AS listed FROM q WHERE i >= 5 AND i < 45 AND j >= sheet * 20 % 6000 + 3 AND j < sheet * 20 % 6000 + 17)
        SELECT sheet, k, round(count(*) / 1e4 * 111.32 ** 2 * cos(radians((sheet * 20 % 6000 + 10) / 100.0)), 4) AS gap_km2 FROM c WHERE NOT listed GROUP BY sheet, k HAVING gap_km2 > {MAX_UNCOVERED_KM2}""",
}
