"""Small literal dimensions; their sizes are fixed, so joining them by broadcast is always safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plangauge.core import constants as K


def tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.TAGS.items()), "category string, tag string")


def floors(spark: SparkSession) -> DataFrame:
    """(kind, compactness, tag, prop_req)."""
    return spark.createDataFrame([(k, K.COMPACTNESS_FLOOR[k], t, v) for k, m in K.PROPORTION_FLOOR.items() for t, v in m.items()], "kind string, compactness double, tag string, prop_req double")


def compactness_floors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.COMPACTNESS_FLOOR.items()), "kind string, compactness double")


def standards(spark: SparkSession) -> DataFrame:
    """(tag, area_req, min_width, prop_req) with the reasons of disabled cells."""
    why = lambda v, what: "" if v > 0 else f"no published clause for {what}"
    rows = [(t, a, w, 0.0, why(a, "the area"), why(w, "the width"), "proportions are disabled under standards") for t, a, w in K.STANDARDS]
    return spark.createDataFrame(rows, "tag string, area_req double, min_width double, prop_req double, area_reason string, width_reason string, prop_reason string")


def groups(spark: SparkSession) -> DataFrame:
    """(grp, place, corpus, role) in report order."""
    return spark.createDataFrame([(g, i, c, r) for i, (g, c, r) in enumerate(K.GROUPS)], "grp string, place int, corpus string, role string")


def tag_of(category: Column) -> Column:
    """The tag of a category, trimmed and lower-cased; unknown ones are Unset."""
    known = F.create_map(*[F.lit(x) for kv in K.TAGS.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(F.trim(category))), F.lit("Unset"))


def is_hallway(category: Column) -> Column:
    return tag_of(category) == "Hallway"


def source_pixel(stated: Column, source: Column) -> Column:
    """The smallest length, in metres, that a plan's source can tell apart: what the plan states, else what is known of the source, else null."""
    known = F.create_map(*[F.lit(x) for kv in K.SOURCE_PIXEL_M.items() for x in kv])
    return F.coalesce(stated.cast("double"), F.try_element_at(known, source))


def floor_kind(corpus: Column, units: Column) -> Column:
    return F.when(corpus != "msd", "rplan").when(units > 1, "msd-floor").otherwise("msd-unit")


# Checks that are off the ladder, and of what sort their refusal is.
SCOPE = (("corridorExposure", "refused"), ("demisingExposure", "refused"), ("areaProgram", "not transferable"))
SOURCES = ("dataset-p05", "standards")


def scope_notes(units: Column) -> Column:
    """Array of (name, kind): the exposure checks where a plan has fewer than two apartments, the area program always."""
    notes = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in SCOPE])
    return F.when(units < 2, notes).otherwise(F.slice(notes, 3, 1))


def is_known(what: Column, name: Column) -> Column:
    """Whether a corpus, kind, requirement source or check of that name exists."""
    known = {"corpus": ("rplan", "msd"), "kind": tuple(K.COMPACTNESS_FLOOR), "source": SOURCES, "check": K.RUNGS}
    return F.coalesce(*[F.when(what == w, name.isin(*names)) for w, names in known.items()], F.lit(False))


def tag_sql(category: str = "category") -> str:
    return f"CASE lower(trim({category})) " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in K.TAGS.items()) + " ELSE 'Unset' END"


def floors_sql() -> str:
    """The floors as a VALUES list, for SQL."""
    return "(VALUES " + ", ".join(f"('{k}', {K.COMPACTNESS_FLOOR[k]}, '{t}', {v})" for k, m in K.PROPORTION_FLOOR.items() for t, v in m.items()) + ") AS floors(kind, compactness, tag, prop_req)"
