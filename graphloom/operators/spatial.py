"""Spatial relations of boxes: region connection calculus, directions and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.resolve import kind_pairs
from graphloom.sources.tables import table

TOLERANCE, DEADBAND, NEAR, FAR = 1e-4, 0.05, 0.25, 0.65


def rcc8(a: list[Column], b: list[Column], tol: float = TOLERANCE) -> Column:
    """Relation of boxes (x1, y1, x2, y2): EQ, DC, EC, TPP, NTPP, their inverses, else PO - tested in that order."""
    equal = (F.abs(a[0] - b[0]) <= tol) & (F.abs(a[1] - b[1]) <= tol) & (F.abs(a[2] - b[2]) <= tol) & (F.abs(a[3] - b[3]) <= tol)
    w, h = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inside = lambda x, y: (x[0] >= y[0] - tol) & (x[1] >= y[1] - tol) & (x[2] <= y[2] + tol) & (x[3] <= y[3] + tol)
    touches = lambda x, y: (F.abs(x[0] - y[0]) <= tol) | (F.abs(x[1] - y[1]) <= tol) | (F.abs(x[2] - y[2]) <= tol) | (F.abs(x[3] - y[3]) <= tol)
    return (
        F.when(equal, "EQ").when((w < -tol) | (h < -tol), "DC").when((w <= tol) | (h <= tol), "EC")
        .when(inside(a, b), F.when(touches(a, b), "TPP").otherwise("NTPP")).when(inside(b, a), F.when(touches(a, b), "TPPI").otherwise("NTPPI")).otherwise("PO")
    )


def direction(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where a lies from b: horizontal and vertical part outside the dead band, and near or far by the distance of centres."""
    h = F.when(ax < bx - DEADBAND, "left_of").when(ax > bx + DEADBAND, "right_of").otherwise("")
    v = F.when(ay < by - DEADBAND, "above").when(ay > by + DEADBAND, "below").otherwise("")
    d = F.round(F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)), 9)
    return F.concat_ws(",", h, v, F.when(d < NEAR, "near").when(d > FAR, "far").otherwise("middle"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, scene, x1..y2: a box for each part, from its key and size; parts of a brand and size make a scene."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("scene"))
    x, y = (F.col("id") * 37 % 8) / 10.0, (F.col("id") * 53 % 8) / 10.0
    w, h = (F.col("id") * 11 % 3 + 1) / 10.0, (F.col("id") * 7 % 3 + 1) / 10.0
    return p.select("id", "scene", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def pairs(b: DataFrame) -> DataFrame:
    """Pairs of boxes of a scene (a.id < b.id)."""
    one = lambda t: b.select("scene", *[F.col(c).alias(f"{t}_{c}") for c in ("id", "x1", "y1", "x2", "y2")])
    return one("a").join(one("b"), "scene").where("a_id < b_id")


def related(p: DataFrame) -> DataFrame:
    """p (corners of two boxes, a_x1 to b_y2) with their relation and direction."""
    c = lambda t: [F.col(f"{t}_{k}") for k in ("x1", "y1", "x2", "y2")]
    mid = lambda t: ((F.col(f"{t}_x1") + F.col(f"{t}_x2")) / 2, (F.col(f"{t}_y1") + F.col(f"{t}_y2")) / 2)
    return p.withColumns({"relation": rcc8(c("a"), c("b")), "direction": direction(*mid("a"), *mid("b"))})


def q_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a scene in pairs; boxes with the same corners are related to others alike, so each two corners are compared once."""
    return kind_pairs(boxes(spark, sf_dir), ["scene"], ["x1", "y1", "x2", "y2"], related)


QUERIES = {"rcc8_directions": q_relations}
_I = lambda p, q: " AND ".join([f"{p}.x1 >= {q}.x1 - 1e-4", f"{p}.y1 >= {q}.y1 - 1e-4", f"{p}.x2 <= {q}.x2 + 1e-4", f"{p}.y2 <= {q}.y2 + 1e-4"])
_T = " OR ".join(f"abs(a.{k} - b.{k}) <= 1e-4" for k in ("x1", "y1", "x2", "y2"))
ORACLE_SQL = {
    "rcc8_directions": f"""WITH k AS (SELECT p_partkey AS id, p_brand || '/' || p_size AS scene, CAST(p_partkey * 37 % 8 AS DOUBLE) / 10.0 AS x, CAST(p_partkey * 53 % 8 AS DOUBLE) / 10.0 AS y, CAST(p_partkey * 11 % 3 + 1 AS DOUBLE) / 10.0 AS w, CAST(p_partkey * 7 % 3 + 1 AS DOUBLE) / 10.0 AS h FROM part),
b AS (SELECT id, scene, x AS x1, y AS y1, x + w AS x2, y + h AS y2, (x + x + w) / 2 AS cx, (y + y + h) / 2 AS cy FROM k)
SELECT a.id AS a_id, b.id AS b_id, CASE WHEN {_T.replace(' OR ', ' AND ')} THEN 'EQ' WHEN least(a.x2, b.x2) - greatest(a.x1, b.x1) < -1e-4 OR least(a.y2, b.y2) - greatest(a.y1, b.y1) < -1e-4 THEN 'DC'
WHEN least(a.x2, b.x2) - greatest(a.x1, b.x1) <= 1e-4 OR least(a.y2, b.y2) - greatest(a.y1, b.y1) <= 1e-4 THEN 'EC' WHEN {_I('a', 'b')} THEN CASE WHEN {_T} THEN 'TPP' ELSE 'NTPP' END WHEN {_I('b', 'a')} THEN CASE WHEN {_T} THEN 'TPPI' ELSE 'NTPPI' END ELSE 'PO' END AS relation,
concat_ws(',', CASE WHEN a.cx < b.cx - 0.05 THEN 'left_of' WHEN a.cx > b.cx + 0.05 THEN 'right_of' ELSE '' END, CASE WHEN a.cy < b.cy - 0.05 THEN 'above' WHEN a.cy > b.cy + 0.05 THEN 'below' ELSE '' END,
CASE WHEN round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 9) < 0.25 THEN 'near' WHEN round(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), 9) > 0.65 THEN 'far' ELSE 'middle' END) AS direction
FROM b a JOIN b ON a.scene = b.scene AND a.id < b.id""",
}
