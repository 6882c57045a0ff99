"""Rates by group, their intervals and margins, stop profiles, and bootstraps with draws that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plangauge.core import constants as K
from plangauge.core.staging import stage

DENOMINATORS = ("graded", "admitted", "verdict")


def outcomes(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Per group: graded, passed (only true counts), admitted, verdict (admitted and every check ran). verdicts: admitted, passed, not_run."""
    return verdicts.groupBy(*(keys or ("grp",))).agg(
        F.count(F.lit(1)).alias("graded"), F.count_if("passed").alias("passed"), F.count_if("admitted").alias("admitted"),
        F.count_if(F.col("admitted") & F.col("not_run").isNull()).alias("verdict"),
    )


def rates(cells: DataFrame, *keys: str) -> DataFrame:
    """A row for each group and denominator: passed, total."""
    keys = keys or ("grp",)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("denominator"), F.col(d).alias("total")) for d in DENOMINATORS])).alias("x")
    return cells.select(*keys, "passed", each).select(*keys, "passed", "x.*")


def wilson(passed: Column, total: Column, z: float = K.Z95) -> tuple[Column, Column, Column]:
    """(rate, low, high) in per cent by Wilson's score; null where the total is not positive."""
    n, p = total.cast("double"), passed / total
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = lambda c: F.when(total > 0, 100 * c)
    return scale(p), scale((centre - half) / (1 + z * z / n)), scale((centre + half) / (1 + z * z / n))


def with_wilson(cells: DataFrame, passed: str = "passed", total: str = "total") -> DataFrame:
    r, lo, hi = wilson(F.col(passed), F.col(total))
    return cells.withColumns({"rate": r, "low": lo, "high": hi})


def newcombe(pa: Column, ta: Column, pb: Column, tb: Column) -> tuple[Column, Column, Column]:
    """(difference, low, high) in points by Newcombe's hybrid of two Wilson intervals."""
    (a, la, ha), (b, lb, hb) = wilson(pa, ta), wilson(pb, tb)
    return a - b, a - b - F.sqrt((a - la) * (a - la) + (hb - b) * (hb - b)), a - b + F.sqrt((ha - a) * (ha - a) + (b - lb) * (b - lb))


def margins(cells: DataFrame, roles: DataFrame, *keys: str) -> DataFrame:
    """Per denominator (and keys): the lowest truth group over the highest baseline, the margin and its interval.

    Ties go to the smaller name for the lowest and to the larger for the highest. roles (grp, role) is a small dimension. A
    denominator with an empty side has no row.
    """
    r = with_wilson(cells).where("rate IS NOT NULL").join(F.broadcast(roles.select("grp", "role")), "grp")
    low = F.min(F.when(F.col("role") == "truth", F.struct("rate", "grp", "passed", "total", "low", "high"))).alias("t")
    high = F.max(F.when(F.col("role") == "baseline", F.struct("rate", "grp", "passed", "total", "low", "high"))).alias("b")
    m = r.groupBy(*keys, "denominator").agg(low, high).where("t IS NOT NULL AND b IS NOT NULL")
    d, lo, hi = newcombe(F.col("t.passed"), F.col("t.total"), F.col("b.passed"), F.col("b.total"))
    return m.select(*keys, "denominator", F.col("t.grp").alias("truth"), F.col("b.grp").alias("baseline"), d.alias("margin"), lo.alias("low"), hi.alias("high"), (F.col("t.low") <= F.col("b.high")).alias("rates_overlap"), ((lo > 0) | (hi < 0)).alias("excludes_zero"))


def own_rates(verdicts: DataFrame, roles: DataFrame, *keys: str) -> DataFrame:
    """(keys, denominator, truth, baseline, passed, total, rate, low, high): the rates of every group with a role, and the margins.

    A group's rate stands under its own role, the other name null; a margin has both names, points for a rate and no counts. A population
    (keys) with no truth or no baseline has rates and no margin, one with neither has no row.
    """
    r = rates(outcomes(verdicts, *keys, "grp"), *keys, "grp")
    own = with_wilson(r).where("rate IS NOT NULL").join(F.broadcast(roles.select("grp", "role")), "grp")
    name = lambda role: F.when(F.col("role") == role, F.col("grp")).alias(role)
    rows = own.where(F.col("role").isin("truth", "baseline")).select(*keys, "denominator", name("truth"), name("baseline"), "passed", "total", "rate", "low", "high")
    no_count = F.lit(None).cast("long")
    return rows.unionByName(margins(r, roles, *keys).select(*keys, "denominator", "truth", "baseline", no_count.alias("passed"), no_count.alias("total"), F.col("margin").alias("rate"), "low", "high"))


def profile(classed: DataFrame, classes: list[str]) -> DataFrame:
    """Group by stop class: counts in the given order of classes, and the total."""
    p = classed.groupBy("grp").pivot("class", classes).count().na.fill(0)
    return p.withColumn("total", sum((F.col(f"`{c}`") for c in classes), F.lit(0).cast("long")))


def no_verdict(cells: DataFrame) -> DataFrame:
    """Share of graded plans without a verdict, with its interval."""
    return with_wilson(cells.select("grp", (F.col("graded") - F.col("verdict")).alias("missing"), F.col("graded").alias("total")), "missing")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the parts joined by |: the same in any engine."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Deviations on each side of the mean that the steps of a distribution span; what lies beyond weighs under 1e-30.
SPAN = 12


def binomial_draws(cells: DataFrame, draws: int, seed: int = K.DRAW_SEED) -> DataFrame:
    """(grp, draw, k): binomial draws of each group's passes by inverse distribution function.

    cells (grp, passed, total), a row for each group. The distribution's steps lie within SPAN deviations of the mean (so their
    number grows with the root of the total); their weights come from the recurrence of log probabilities and are made to sum to 1.
    Draws find their step by one sorted union, so the cost is draws + steps and not their product. Rates 0 and 1 draw themselves.
    """
    inner = cells.where("passed > 0 AND passed < total").withColumn("r", F.col("passed") / F.col("total"))
    reach = F.ceil(SPAN * F.sqrt(F.col("total") * F.col("r") * (1 - F.col("r")))) + SPAN
    inner = inner.withColumn("k0", F.greatest(F.lit(0).cast("long"), F.col("passed") - reach)).withColumn("k1", F.least("total", F.col("passed") + reach))
    steps = inner.select("grp", "total", "r", "k0", F.explode(F.sequence("k0", "k1")).alias("k"))
    term = F.when(F.col("k") == F.col("k0"), 0.0).otherwise(F.log((F.col("total") - F.col("k") + 1) / F.col("k")) + F.log(F.col("r") / (1 - F.col("r"))))
    run, whole = Window.partitionBy("grp").orderBy("k").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("grp")
    weight = steps.withColumn("lp", F.sum(term).over(run)).withColumn("w", F.exp(F.col("lp") - F.max("lp").over(whole)))
    cdf = weight.select("grp", "k", (F.sum("w").over(run) / F.sum("w").over(whole)).alias("at"), F.lit(None).cast("long").alias("draw"))
    ask = inner.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"))
    ask = ask.select("grp", F.lit(None).cast("long").alias("k"), uniform(seed, F.col("grp"), F.col("draw")).alias("at"), "draw")
    up = Window.partitionBy("grp").orderBy(F.desc("at"), F.col("draw").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = cdf.unionByName(ask).withColumn("k", F.last("k", ignorenulls=True).over(up)).where("draw IS NOT NULL")
    found = found.join(F.broadcast(inner.select("grp", "k1")), "grp").select("grp", "draw", F.coalesce("k", "k1").alias("k"))
    flat = cells.where("total > 0 AND (passed = 0 OR passed = total)").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"), F.col("passed").alias("k"))
    return found.unionByName(flat)


def bootstrap_margin(cells: DataFrame, roles: DataFrame, draws: int, seed: int = K.DRAW_SEED) -> DataFrame:
    """Percentile interval of the margin, the extreme groups chosen anew in every draw."""
    r = binomial_draws(cells, draws, seed).join(F.broadcast(cells.select("grp", "total")), "grp").join(F.broadcast(roles.select("grp", "role")), "grp").withColumn("rate", 100 * F.col("k") / F.col("total"))
    per = r.groupBy("draw").agg((F.min(F.when(F.col("role") == "truth", F.col("rate"))) - F.max(F.when(F.col("role") == "baseline", F.col("rate")))).alias("margin"))
    return per.agg(F.expr("percentile(margin, 0.025)").alias("low"), F.expr("percentile(margin, 0.975)").alias("high"))


def cluster_totals(verdicts: DataFrame) -> DataFrame:
    """(grp, cluster, graded, passed, admitted, verdict): plans summed by cluster before any resampling."""
    return outcomes(verdicts, "grp", "cluster")


def ranked_within(rows: DataFrame, group: str, *order: str, weight: str | None = None) -> DataFrame:
    """rows plus `pick`, their place (from 1) in their group's order, by range partitions instead of one task for each group.

    With a weight, `pick` is the sum of the weights up to the row.
    """
    step = F.col(weight) if weight else F.lit(1)
    part = rows.repartitionByRange(F.col(group), *map(F.col, order)).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = part.withColumn("_k", F.sum(step).over(w))
    sizes = inside.groupBy("_p", group).agg(F.sum(step).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_p", group, before.alias("_f"))  # a row for each partition and group
    return inside.join(F.broadcast(firsts), ["_p", group]).withColumn("pick", F.col("_k") + F.col("_f")).drop("_p", "_k", "_f")


#: Deviations by which the first draws of a replicate stay short of its number of clusters; more than that number has a weight under 1e-14.
SPARE = 8


def poisson_steps(means: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, k, lo, hi, slot): for each mean (column `mean`, one for each keys and n) the counts k with their part [lo, hi) of [0, 1).

    The steps lie within SPAN deviations of the mean. A step has a row for each of the `slots` equal slots of [0, 1) that its part touches,
    so that a uniform number finds it by an equality join on its slot. `means` must have come through poisson_reach().
    """
    run, whole = Window.partitionBy(*keys).orderBy("k"), Window.partitionBy(*keys)
    term = F.when(F.col("k") == F.col("k0"), 0.0).otherwise(F.log(F.col("mean") / F.col("k")))
    steps = means.select(*keys, "mean", "k0", "slots", F.explode(F.sequence("k0", F.expr("k0 + slots - 1"))).alias("k"))
    weight = steps.withColumn("lp", F.sum(term).over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("w", F.exp(F.col("lp") - F.max("lp").over(whole)))
    lo = F.coalesce(F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("w").over(whole)
    cut = weight.withColumn("lo", lo).withColumn("hi", F.coalesce(F.lead("lo").over(run), F.lit(1.0)))
    return slotted(cut).select(*keys, "k", "lo", "hi", "slot")


def poisson_reach(means: DataFrame) -> DataFrame:
    """means plus `k0`, the least count of its steps, and `slots`, how many there are."""
    reach, middle = F.ceil(SPAN * F.sqrt("mean")) + SPAN, F.floor("mean")
    out = means.withColumn("k0", F.greatest(F.lit(0).cast("long"), middle - reach))
    return out.withColumn("slots", middle + reach - F.col("k0") + 1)


def slotted(parts: DataFrame) -> DataFrame:
    """A row for each of the `slots` equal slots of [0, 1) that the part [lo, hi) touches."""
    slot = lambda c: F.least(F.floor(F.col(c) * F.col("slots")), F.col("slots") - 1)
    return parts.withColumn("slot", F.explode(F.sequence(slot("lo"), slot("hi"))))


def _four(rows: DataFrame, last: Column, *name: Column | str) -> DataFrame:
    """A row for each number from 0 to `last`, with `at`, the number, and `u`, uniform in [0, 1); one hash of the name gives four."""
    quads = rows.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / 4))))
    text = F.concat_ws("|", *[x if isinstance(x, Column) else F.lit(x) for x in name], F.col("_q").cast("string"))
    quads = quads.withColumn("_h", F.md5(text))
    parts = F.array(*[F.struct((F.col("_q") * 4 + i).alias("at"), (F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("double") / 4294967296.0).alias("u")) for i in range(4)])
    return quads.withColumn("_d", F.explode(parts)).where(F.col("_d.at") <= last).select("*", "_d.at", "_d.u").drop("_q", "_h", "_d")


def cluster_replicates(totals: DataFrame, replicates: int, seed: int = K.REPLICATE_SEED) -> DataFrame:
    """(replicate, grp, and the sums of all columns but `cluster`): whole clusters drawn with replacement, as many as the group has.

    Clusters with equal totals are one class. A replicate first draws each class's number from a Poisson law whose mean is a little under the
    class's size, so that they add up to SPARE deviations less than the group's clusters; given their sum they are a draw of that many
    clusters. What is missing to the group's number is drawn cluster by cluster. So the cost is replicates x (classes + root of
    clusters). Draws are hashes of seed, group, totals or place, and replicate: the same in any engine. A class's draws are made where the
    class is and summed there; only sums by group and replicate are shuffled. Several rules side by side in one row share a resample.
    """
    spark = totals.sparkSession
    kept = [c for c in totals.columns if c not in ("grp", "cluster")]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    classes = stage(totals.groupBy("grp", *kept).agg(F.count(F.lit(1)).alias("n")), "classes")
    sizes = classes.groupBy("grp").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("m")).withColumn("share", F.greatest(F.lit(0.0), 1 - SPARE / F.sqrt("c")))
    sizes = stage(sizes, "class_sizes")  # a row for each group
    means = poisson_reach(classes.join(F.broadcast(sizes), "grp").where("share > 0").withColumn("mean", F.col("share") * F.col("n")))
    steps = stage(poisson_steps(means.select("grp", "n", "mean", "k0", "slots").distinct(), "grp", "n"), "class_steps")
    asks = _four(means.select("grp", "n", "slots", *kept).repartition(tasks, "grp", *kept), F.lit(replicates - 1), str(seed), "first", F.col("grp"), *[F.col(c).cast("string") for c in kept])
    met = asks.withColumn("slot", F.floor(F.col("u") * F.col("slots"))).join(steps, ["grp", "n", "slot"]).where("lo <= u AND u < hi")
    first = stage(met.groupBy("grp", F.col("at").cast("int").alias("replicate")).agg(F.sum("k").alias("_drawn"), *[F.sum(F.col("k") * F.col(c)).alias(c) for c in kept]), "first_draws")

    every = sizes.select("grp", "c", "m", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    short = every.join(first.select("grp", "replicate", "_drawn"), ["grp", "replicate"], "left").withColumn("_r", F.col("c") - F.coalesce("_drawn", F.lit(0))).where("_r > 0")
    singles = _four(short.repartition(tasks, "grp", "replicate"), F.col("_r") - 1, str(seed), "rest", F.col("grp"), F.col("replicate").cast("string"))
    cut = ranked_within(classes, "grp", *kept, weight="n").join(F.broadcast(sizes), "grp")
    cut = slotted(cut.select("grp", *kept, ((F.col("pick") - F.col("n")) / F.col("c")).alias("lo"), (F.col("pick") / F.col("c")).alias("hi"), F.col("m").alias("slots"))).drop("slots")
    rest = singles.withColumn("slot", F.floor(F.col("u") * F.col("m"))).join(stage(cut, "class_parts"), ["grp", "slot"]).where("lo <= u AND u < hi")
    rest = rest.groupBy("grp", "replicate").agg(*[F.sum(c).alias(c) for c in kept])
    return first.drop("_drawn").unionByName(rest).groupBy("replicate", "grp").agg(*[F.sum(c).alias(c) for c in kept])


def replicate_margins(replicated: DataFrame, roles: DataFrame) -> DataFrame:
    """(replicate, denominator, margin): lowest truth less highest baseline in every replicate."""
    r = rates(replicated, "replicate", "grp").where("total > 0").join(F.broadcast(roles.select("grp", "role")), "grp").withColumn("rate", 100 * F.col("passed") / F.col("total"))
    side = lambda role: F.when(F.col("role") == role, F.col("rate"))
    return r.groupBy("replicate", "denominator").agg((F.min(side("truth")) - F.max(side("baseline"))).alias("margin"))


def interval(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """2.5 and 97.5 per cent points of the column, by keys; linear between order statistics."""
    return values.groupBy(*keys).agg(F.expr(f"percentile({column}, 0.025)").alias("low"), F.expr(f"percentile({column}, 0.975)").alias("high"))


def counted_values(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, n, upto, total): distinct values with how many rows have them, how many are at or under them, and how many there are.

    Rows are counted by value first, so a key's task holds its distinct values and not its rows. Nulls are left out.
    """
    w = Window.partitionBy(*keys)
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return c.select("*", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("total"))


def quantiles(counted: DataFrame, value: str, asks: list[float], *keys: str) -> DataFrame:
    """(keys, ask, q): quantiles of counted values, linear between order statistics."""
    each = counted.select("*", F.explode(F.array(*[F.lit(float(a)) for a in asks])).alias("ask"))
    at = F.round(F.col("ask") * (F.col("total") - 1), 9)
    holds = lambda rank: (rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))
    each = each.withColumn("at", at).withColumn("lo", holds(F.floor("at") + 1)).withColumn("hi", holds(F.ceil("at") + 1)).where("lo OR hi")
    low, high = F.max(F.when(F.col("lo"), F.col(value))), F.max(F.when(F.col("hi"), F.col(value)))
    return each.groupBy(*keys, "ask").agg((low + (F.max("at") - F.floor(F.max("at"))) * (high - low)).alias("q"))


def category_statistics(rooms: DataFrame, *keys: str) -> DataFrame:
    """Count and exact percentiles of area, width and aspect by tag; values are counted at nine decimals before they are ranked."""
    asks = {"area": (5, 25, 50, 75, 95), "width": (5, 25, 50), "aspect": (5, 25, 50, 75, 95)}
    each = F.array(*[F.struct(F.lit(m).alias("m"), F.round(c, 9).alias("v")) for m, c in (("area", F.col("area_m2")), ("width", F.col("short_m")), ("aspect", F.col("long_m") / F.col("short_m")))])
    c = counted_values(rooms.select(*keys, "tag", F.explode(each).alias("x")).select(*keys, "tag", "x.m", "x.v"), "v", *keys, "tag", "m")
    q = quantiles(c, "v", [p / 100 for p in asks["area"]], *keys, "tag", "m")
    names = [(m, p) for m, ps in asks.items() for p in ps]
    wide = q.groupBy(*keys, "tag").agg(*[F.max(F.when((F.col("m") == m) & (F.col("ask") == p / 100), F.col("q"))).alias(f"{m}_p{p}") for m, p in names])
    n = rooms.groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("n"))
    return n.join(wide, [*keys, "tag"])
