"""Small plans for tests: rooms given in metres become lattice vertices."""

from pyspark.sql import functions as F

from plangauge.operators import measures as M


def edges(spark, rooms):
    """rooms: (plan_id, room_ix, category, [(x, y), ...]) in metres."""
    rows = [(p, r, c, i, float(x), float(y)) for p, r, c, ring in rooms for i, (x, y) in enumerate(ring)]
    v = spark.createDataFrame(rows, "plan_id long, room_ix int, category string, vix int, x double, y double")
    return M.edges_of(v.select("plan_id", "room_ix", "category", "vix", M.quantise(F.col("x")).alias("ix"), M.quantise(F.col("y")).alias("iy")))


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
