"""Fitting the check thresholds to stated refusal rates, with held-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plangauge.core import constants as K
from plangauge.operators.outcomes import counted_values, uniform


def capped(tag: str = "tag", floor: str = "floor") -> Column:
    """A tag's floor under the bedroom cap."""
    return F.when(F.col(tag).isin(*K.BEDROOMS), F.least(F.col(floor), F.lit(K.BEDROOM_CAP))).otherwise(F.col(floor))


def plan_features(rooms: DataFrame) -> DataFrame:
    """(plan_id, pp, worst_room): the worst compactness of non-hallway rooms, six decimals, the first room at a tie."""
    worst = F.min(F.when(F.col("tag") != "Hallway", F.struct(F.round("pp", 6).alias("pp"), "room_ix"))).alias("w")
    return rooms.groupBy("plan_id").agg(worst).select("plan_id", F.col("w.pp").alias("pp"), F.col("w.room_ix").alias("worst_room"))


def room_features(rooms: DataFrame) -> DataFrame:
    """(plan_id, room_ix, tag, sq): squareness of rooms whose tag can carry a floor, six decimals."""
    return rooms.where("tag <> 'Unset'").select("plan_id", "room_ix", "tag", F.round("squareness", 6).alias("sq"))


def _picked(plans: DataFrame, value: str, want: DataFrame, *keys: str) -> DataFrame:
    """want (keys, lo, hi: ranks from 1) plus a and b, the values of those ranks among the key's rows; null where there is no such rank.

    want is a row for each key and level, so it is broadcast.
    """
    c = counted_values(plans, value, *keys).select(*keys, F.col(value).alias("v"), (F.col("upto") - F.col("n")).alias("under"), "upto")
    found = c.join(F.broadcast(want), list(keys)).withColumn("is_lo", (F.col("lo") > F.col("under")) & (F.col("lo") <= F.col("upto"))).withColumn("is_hi", (F.col("hi") > F.col("under")) & (F.col("hi") <= F.col("upto"))).where("is_lo OR is_hi")
    return found.groupBy(*want.columns).agg(F.max(F.when(F.col("is_lo"), F.col("v"))).alias("a"), F.max(F.when(F.col("is_hi"), F.col("v"))).alias("b"))


def fit_rung2(plans: DataFrame, levels: DataFrame, *keys: str) -> DataFrame:
    """keys, level, compactness: the floor that refuses `level` of the plans of each key, plans without a score passing.

    With k = level * n to the nearest even integer at a half, the floor lies midway between the kth and the next score. levels is a
    small table. Scores are counted by value before they are ranked; no iteration.
    """
    n = plans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("pp").alias("m"))
    want = n.crossJoin(F.broadcast(levels)).withColumn("k", F.bround(F.col("level") * F.col("n"), 0).cast("long"))
    want = want.withColumn("lo", F.greatest(F.least("k", "m"), F.lit(1))).withColumn("hi", F.greatest(F.least(F.col("k") + 1, F.col("m")), F.lit(1)))
    picked = _picked(plans, "pp", want, *keys)
    floor = F.when(F.col("k") <= 0, F.col("a")).when(F.col("k") >= F.col("m"), F.col("b") + 1e-9).otherwise((F.col("a") + F.col("b")) / 2)
    return picked.select(*keys, "level", floor.alias("compactness"))


def room_thresholds(rooms: DataFrame, *keys: str) -> DataFrame:
    """rooms plus p: the least knob at which the room's tag quantile passes its squareness and refuses it; null if none does.

    The quantile of a tag is piecewise linear in p, so it is inverted: with the pool v sorted, j the number of values up to
    s = sq + tolerance, p = (j - 1 + (s - v[j]) / (v[j + 1] - v[j])) / (n - 1). One window over the distinct values of a tag (six
    decimals) in place of a bisection over the rooms.
    """
    part = [*keys, "tag"]
    pool = counted_values(rooms, "sq", *part).select(*part, "sq", "upto", F.col("total").alias("n"))
    own = pool.select(*part, F.col("sq").alias("v"), F.lit(0).alias("ask"), "upto", "n", F.lit(None).cast("double").alias("sq"))
    asks = pool.select(*part, (F.col("sq") + K.ABS_TOL_M).alias("v"), F.lit(1).alias("ask"), F.lit(None).cast("long").alias("upto"), "n", "sq")
    both = own.unionByName(asks)
    upto = Window.partitionBy(*part).orderBy("v", "ask").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*part).orderBy(F.desc("v"), F.desc("ask")).rowsBetween(Window.unboundedPreceding, -1)
    is_pool = F.when(F.col("ask") == 0, F.col("v"))
    m = both.select("*", F.last("upto", ignorenulls=True).over(upto).alias("j"), F.last(is_pool, ignorenulls=True).over(upto).alias("vj"), F.last(is_pool, ignorenulls=True).over(after).alias("vn")).where("ask = 1")
    never = (F.col("j") >= F.col("n")) | (F.col("tag").isin(*K.BEDROOMS) & (F.col("v") >= K.BEDROOM_CAP))
    p = F.when(never, F.lit(None)).otherwise((F.col("j") - 1 + (F.col("v") - F.col("vj")) / (F.col("vn") - F.col("vj"))) / (F.col("n") - 1))
    return rooms.join(m.select(*part, "sq", p.alias("p")), [*part, "sq"])


def fit_rung3(plans: DataFrame, rooms: DataFrame, levels: DataFrame, *keys: str) -> DataFrame:
    """keys, level, p: the knob at which the share of refused plans comes nearest the level.

    A plan is refused at p if its least room threshold is under p; so the knob lies just above an order statistic of plan thresholds.
    """
    least = room_thresholds(rooms, *keys).groupBy(*keys, "plan_id").agg(F.min("p").alias("p"))
    all_plans = plans.select(*keys, "plan_id").join(least, [*keys, "plan_id"], "left")
    n = all_plans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("m"))
    want = n.crossJoin(F.broadcast(levels)).withColumn("k", F.least(F.bround(F.col("level") * F.col("n"), 0).cast("long"), F.col("m")))
    picked = _picked(all_plans, "p", want.withColumn("lo", F.greatest("k", F.lit(1))).withColumn("hi", F.col("k") + 1), *keys)
    knob = F.when(F.col("k") <= 0, F.coalesce("a", "b")).when(F.col("b").isNull(), F.least(F.col("a") + 1e-9, F.lit(1.0))).otherwise((F.col("a") + F.col("b")) / 2)
    return picked.select(*keys, "level", knob.alias("p"))


def tag_quantiles(rooms: DataFrame, knobs: DataFrame, *keys: str) -> DataFrame:
    """keys, level, tag, floor: each tag's quantile of squareness at the knob, linear between order statistics. knobs (keys, level, p) is a row for each key and level, so it is broadcast."""
    c = counted_values(rooms, "sq", *keys, "tag")
    at = c.join(F.broadcast(knobs), list(keys)).withColumn("at", F.col("p") * (F.col("total") - 1))
    holds = lambda rank: (rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))
    at = at.withColumn("lo", holds(F.floor("at") + 1)).withColumn("hi", holds(F.ceil("at") + 1)).where("lo OR hi")
    low, high, part = F.max(F.when(F.col("lo"), F.col("sq"))), F.max(F.when(F.col("hi"), F.col("sq"))), F.max("at") - F.floor(F.max("at"))
    return at.groupBy(*keys, "level", "tag").agg((low + part * (high - low)).alias("floor"))


def rung2_fails(pp: Column, floor: Column) -> Column:
    return F.coalesce(pp < floor, F.lit(False))


def rung3_refused(rooms: DataFrame, floors: DataFrame, on: list[str]) -> DataFrame:
    """(on but tag, plan_id) of plans with a room under its tag's capped floor by more than the tolerance. floors is small."""
    f = floors.where("floor > 0").withColumn("floor", capped())
    return rooms.join(F.broadcast(f), on).where(F.col("sq") < F.col("floor") - K.ABS_TOL_M).select(*[c for c in floors.columns if c not in ("tag", "floor")], "plan_id").distinct()


#: Cells of the unit interval by which the units of a split are counted before the middle is sought.
CELLS = 4096


def split_halves(plans: DataFrame, unit: str, splits: DataFrame, seed: int = K.SPLIT_SEED) -> DataFrame:
    """(split, unit, fitted): a random half of the units of each split (a plan, or a whole building); splits is small.

    Units have a hashed place in [0, 1). They are counted by cell of that interval; only those of the cell in which the half ends
    are ranked.
    """
    units = plans.select(unit).distinct().crossJoin(F.broadcast(splits)).withColumn("u", uniform(seed, F.col("split"), F.col(unit))).withColumn("cell", F.floor(F.col("u") * CELLS))
    w = Window.partitionBy("split")
    cells = units.groupBy("split", "cell").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.select("split", "cell", "c", F.sum("c").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(w).alias("n"))
    half = F.expr("n div 2")
    edge = cells.where((half > F.col("upto") - F.col("c")) & (half <= F.col("upto"))).select("split", F.col("cell").alias("edge"), (half - F.col("upto") + F.col("c")).alias("need"))
    placed = units.join(F.broadcast(edge), "split", "left").withColumn("edge", F.coalesce("edge", F.lit(-1)))
    ranked = placed.where("cell = edge").withColumn("rank", F.row_number().over(w.orderBy("u", unit)))
    return placed.where("cell <> edge").select("split", unit, (F.col("cell") < F.col("edge")).alias("fitted")).unionByName(ranked.select("split", unit, (F.col("rank") <= F.col("need")).alias("fitted")))


def attach_cluster(plans: DataFrame, buildings: DataFrame, plan: str, floor: str) -> DataFrame:
    """plans plus cluster: the building, or the floor itself where the key lacks it."""
    return plans.join(buildings.select(F.col("floor_id").alias(floor), "building"), floor, "left").withColumn("cluster", F.coalesce("building", F.concat(F.lit("floor:"), F.col(floor).cast("string"))))


def by_room_count(plans: DataFrame) -> DataFrame:
    """grp, bin, plans, refused: plans (grp, rooms, refused) by bins of their room count."""
    at = F.coalesce(*[F.when(F.col("rooms").between(a, b), F.lit(f"{a}-{b}")) for a, b in K.ROOM_BINS])
    return plans.withColumn("bin", at).where("bin IS NOT NULL").groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("plans"), F.count_if("refused").alias("refused"))


def overlap(plans: DataFrame) -> DataFrame:
    """grp, r2, r3, r4, plans: how often each of the eight patterns of the three checks occurs, zeros filled."""
    found = plans.groupBy("grp", "r2", "r3", "r4").agg(F.count(F.lit(1)).alias("plans"))
    flags = F.array(F.lit(False), F.lit(True))
    every = plans.select("grp").distinct().select("grp", F.explode(flags).alias("r2")).select("*", F.explode(flags).alias("r3")).select("*", F.explode(flags).alias("r4"))
    return every.join(found, ["grp", "r2", "r3", "r4"], "left").select("grp", "r2", "r3", "r4", F.coalesce("plans", F.lit(0)).alias("plans"))
