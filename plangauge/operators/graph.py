"""Access graphs, apartments and wall exposure."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plangauge.core import constants as K
from plangauge.core.components import components
from plangauge.core.staging import stage

HABITABLE = ("livingroom", "bedroom", "diningroom", "masterroom", "living_room", "dining")
WET = ("bathroom",)
CIRCULATION = ("corridor", "stairs")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def components_within(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(plan_id, node, label): components of links (plan_id, a, b) within each plan; label is the component's smallest node.

    A component never leaves its plan and a plan is one document, so its links are one array, folded link by link into the labels of
    its nodes: one shuffle, no rounds. nodes (plan_id, node) adds those without links; ends that it lacks are passed over.
    """
    e = links.groupBy("plan_id").agg(F.collect_set(F.struct("a", "b")).alias("links"))
    if nodes is None:
        e = e.withColumn("nodes", F.array_distinct(F.flatten(F.transform("links", lambda x: F.array(x["a"], x["b"])))))
    else:
        e = nodes.groupBy("plan_id").agg(F.collect_set("node").alias("nodes")).join(e.hint("shuffle_hash"), "plan_id", "left")
    pair = lambda n, label: F.struct(n.alias("node"), label.alias("label"))

    def step(labels: Column, link: Column) -> Column:
        of = lambda n: F.get(F.filter(labels, lambda x: x["node"] == n), F.lit(0))["label"]
        ends = _let(F.struct(of(link["a"]).alias("a"), of(link["b"]).alias("b")), lambda m: F.struct(F.least(m["a"], m["b"]).alias("lo"), F.greatest(m["a"], m["b"]).alias("hi")))
        return _let(ends, lambda m: F.when(m["lo"] < m["hi"], F.transform(labels, lambda x: pair(x["node"], F.when(x["label"] == m["hi"], m["lo"]).otherwise(x["label"])))).otherwise(labels))

    start = F.transform("nodes", lambda n: pair(n, n))
    found = e.select("plan_id", F.explode(F.aggregate(F.coalesce("links", F.array()), start, step)).alias("x"))
    return found.select("plan_id", "x.node", "x.label")


def room_components(rooms: DataFrame, access: DataFrame, through: str = "kind <> 'entrance'") -> DataFrame:
    """(plan_id, room_ix, root): rooms that reach each other over the access links that hold `through`; root is the smallest."""
    links = access.where(through).select("plan_id", "a", "b")
    return components_within(links, rooms.select("plan_id", F.col("room_ix").alias("node"))).withColumnsRenamed({"node": "room_ix", "label": "root"})


def apartments(rooms: DataFrame, roots: DataFrame) -> DataFrame:
    """(plan_id, room_ix, root, unit_ix): components with a wet and a habitable room are apartments, numbered by their smallest room; other rooms are shared (null)."""
    r = rooms.select("plan_id", "room_ix", "category").join(roots, ["plan_id", "room_ix"])
    per = r.groupBy("plan_id", "root").agg(F.bool_or(F.col("category").isin(*WET)).alias("wet"), F.bool_or(F.col("category").isin(*HABITABLE)).alias("habitable"))
    units = per.where("wet AND habitable").select("plan_id", "root", (F.dense_rank().over(Window.partitionBy("plan_id").orderBy("root")) - 1).alias("unit_ix"))
    return r.join(units, ["plan_id", "root"], "left").select("plan_id", "room_ix", "category", "root", "unit_ix")


def unit_labels(members: DataFrame) -> DataFrame:
    """(plan_id, room_ix, unit): u0, u1, ... or null."""
    return members.select("plan_id", "room_ix", F.when(F.col("unit_ix").isNotNull(), F.concat(F.lit("u"), F.col("unit_ix").cast("string"))).alias("unit"))


def entry_rooms(members: DataFrame, access: DataFrame) -> DataFrame:
    """(plan_id, unit_ix, entry_room): of the entrance links that leave the apartment the first, its a side before its b side."""
    e = access.where("kind = 'entrance'")
    sides = e.select("plan_id", "edge_ix", F.lit(0).alias("side"), F.col("a").alias("room_ix"), F.col("b").alias("to")).unionByName(e.select("plan_id", "edge_ix", F.lit(1).alias("side"), F.col("b").alias("room_ix"), F.col("a").alias("to")))
    m = members.select("plan_id", "room_ix", "unit_ix")
    s = sides.join(m.where("unit_ix IS NOT NULL"), ["plan_id", "room_ix"]).join(m.select("plan_id", F.col("room_ix").alias("to"), F.col("unit_ix").alias("to_unit")), ["plan_id", "to"])
    return s.where("to_unit IS NULL OR to_unit <> unit_ix").groupBy("plan_id", "unit_ix").agg(F.min_by("room_ix", F.struct("edge_ix", "side")).alias("entry_room"))


def unit_views(members: DataFrame, access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apartments cut out of their floor: (plan_id, unit_ix, local_ix, room_ix) and their access links by local index."""
    w = Window.partitionBy("plan_id", "unit_ix").orderBy("room_ix")
    local = members.where("unit_ix IS NOT NULL").select("plan_id", "unit_ix", (F.row_number().over(w) - 1).alias("local_ix"), "room_ix")
    a = local.select("plan_id", "unit_ix", F.col("room_ix").alias("a"), F.col("local_ix").alias("la"))
    b = local.select("plan_id", "unit_ix", F.col("room_ix").alias("b"), F.col("local_ix").alias("lb"))
    return local, access.join(a, ["plan_id", "a"]).join(b, ["plan_id", "unit_ix", "b"]).select("plan_id", "unit_ix", "la", "lb", "kind")


def exposure_context(members: DataFrame) -> DataFrame:
    """(plan_id, unit_ix, room_ix, code): what each room outside an apartment is to it: demising (another apartment's) or corridor (no apartment's)."""
    units = members.where("unit_ix IS NOT NULL").select("plan_id", "unit_ix").distinct()
    r = members.select("plan_id", "room_ix", F.col("unit_ix").alias("own"))
    out = units.join(r, "plan_id").where("own IS NULL OR own <> unit_ix")
    return out.select("plan_id", "unit_ix", "room_ix", F.when(F.col("own").isNotNull(), K.EXPOSURE["demising"]).otherwise(K.EXPOSURE["corridor"]).alias("code"))


def encode(owner: Column, circulating: Column) -> Column:
    """The exposure list of a wall from what is on its other side: a code, or a room's index with the hallway code beside it where that room is circulation."""
    return F.when((owner >= 0) & circulating, F.array(owner, F.lit(K.EXPOSURE["hallway"]))).otherwise(F.array(owner))


def code_of(exposure: Column) -> Column:
    """The one class of an exposure list: hallway, else its first code, else 0 for a room of the same apartment."""
    return F.when(F.array_contains(exposure, K.EXPOSURE["hallway"]), K.EXPOSURE["hallway"]).otherwise(F.coalesce(F.get(F.filter(exposure, lambda v: v < 0), F.lit(0)), F.lit(0)))


def unreadable(exposure: Column, tokens: Column) -> Column:
    """Whether a list is empty or holds what is neither a code nor the index of one of `tokens` rooms."""
    return (F.size(exposure) == 0) | F.exists(exposure, lambda v: (v < K.EXPOSURE["hallway"]) | (v >= tokens))


def exposure_histogram(walls: DataFrame) -> DataFrame:
    """(plan_id, class, segments, length_m) of walls (plan_id, class, length_m), a row for each of the five classes."""
    classes = ("exterior", "corridor", "demising", "hallway", "interior")
    every = walls.select("plan_id").distinct().select("plan_id", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    sums = walls.groupBy("plan_id", "class").agg(F.count(F.lit(1)).alias("segments"), F.sum("length_m").alias("length_m"))
    return every.join(sums, ["plan_id", "class"], "left").select("plan_id", "class", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("length_m", F.lit(0.0)).alias("length_m"))


#: Sets of one block, at most on average, and at least, where blocks are made to occupy the session's tasks; members of a class in one array.
MOST, LEAST, ARRAY = 1024, 32, 256


def jaccard(cells: DataFrame, key: str = "floor_id") -> DataFrame:
    """(a, b, shared, similarity) for pairs of floors that share a cell, a < b: all of them, by classes of floors with equal cells.

    cells (key, cx, cy) are made distinct first. Classes are compared once (met_classes); what they share holds for all of their members,
    which are put in place where the pair was found, so pairs are never shuffled.
    """
    own, members = tiled_classes(cells, key)
    chunks = members.groupBy("rep", F.pmod(F.xxhash64("floor"), F.ceil(F.col("m") / ARRAY)).alias("k")).agg(F.collect_list("floor").alias("floors"))
    chunks = stage(chunks, "members")
    met, sides = met_classes(own)
    for x, side in zip("ab", sides, strict=True):
        of = side(chunks.withColumnRenamed("rep", "f"), "floors").withColumnsRenamed({"f": x, "floors": f"floors{x}"})
        met = met.join(of.hint("shuffle_hash"), ["bp", x])
    across = met.select(F.explode("floorsa").alias("a"), "floorsb", "shared", "n").select("a", F.explode("floorsb").alias("b"), "shared", "n")
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "n")
    some = own.where("m > 1 AND live > 0").select(F.col("f").alias("rep"), F.col("live").alias("shared"), (2 * F.col("n")).alias("n"))
    left, right = (chunks.select("rep", F.col("k").alias(f"k{x}"), F.col("floors").alias(f"floors{x}")) for x in "ab")
    within = left.join(right, "rep").where("ka <= kb").join(some, "rep").select("ka", "kb", F.explode("floorsa").alias("a"), "floorsb", "shared", "n")
    within = within.select("ka", "kb", "a", F.explode("floorsb").alias("b"), "shared", "n").where("ka < kb OR a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", "n")
    return across.unionByName(within).select("a", "b", "shared", _similarity())


def similarity_counts(cells: DataFrame, key: str = "floor_id") -> tuple[DataFrame, DataFrame]:
    """(similarity, pairs) of jaccard(), several rows for one similarity, by classes alone; and the number of floors (n)."""
    own, _ = tiled_classes(cells, key)
    across = met_classes(own)[0].select("shared", "n", (F.col("ma") * F.col("mb")).alias("pairs"))
    within = own.where("m > 1 AND live > 0").select(F.col("live").alias("shared"), (2 * F.col("n")).alias("n"), F.expr("m * (m - 1) div 2").alias("pairs"))
    return across.unionByName(within).select(_similarity(), "pairs"), own.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


def _similarity() -> Column:
    """The similarity of two sets from what they share and their sizes' sum."""
    return (F.col("shared") / (F.col("n") - F.col("shared"))).alias("similarity")


def tiled_classes(cells: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(own, members): a row for each class of floors with equal cells, and each floor's class (floor, rep, m).

    own: f, the smallest floor; m, how many there are; tiles (tx, ty, bits), its cells as tiles of 8 x 8 with a bit for each; n, how many
    cells there are; live, how many without a null.
    """
    c = cells.select(F.col(key).alias("f"), F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy")).where("f IS NOT NULL")
    tile = F.expr("shiftleft(1L, cast(coalesce(cx & 7, 0) * 8 + coalesce(cy & 7, 0) as int))")
    tiles = c.groupBy("f", F.shiftright("cx", 3).alias("tx"), F.shiftright("cy", 3).alias("ty")).agg(F.bit_or(tile).alias("bits"))
    sets = tiles.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("tx", "ty", "bits"))).alias("tiles"))
    sets = stage(sets.withColumn("h", F.sha2(F.to_json("tiles"), 256)), "tiled_sets")
    reps = sets.groupBy("h").agg(F.min("f").alias("rep"), F.count(F.lit(1)).alias("m"))
    members = sets.select(F.col("f").alias("floor"), "h").join(reps, "h").select("floor", "rep", "m")
    size = lambda t: F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x["bits"]))
    whole = F.filter("tiles", lambda x: x["tx"].isNotNull() & x["ty"].isNotNull())
    own = sets.join(reps.select(F.col("rep").alias("f"), "m"), "f").select("f", "m", whole.alias("tiles"), size(F.col("tiles")).alias("n"), size(whole).alias("live"))
    return stage(own, "tiled"), members


def met_classes(own: DataFrame) -> tuple[DataFrame, list]:
    """(met, sides): met (bp, a, b, ma, mb, shared, n) of two classes that share a cell, each pair once, n their sizes' sum.

    Classes are dealt to blocks by a hash, and each pair of blocks `bp` is compared in one task: it joins their tiles and sums the bits that
    two sets have in common. So what is shuffled are the sets, once for each block, and no pairs; a task holds the pairs of two blocks.
    sides: two functions that give rows (f, columns) to all pairs of blocks that have f as first and as second one, partitioned like met.
    """
    spark = own.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows, tasks = own.count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = max(1, math.ceil(rows / MOST), min(math.ceil(math.sqrt(2 * tasks)), math.ceil(rows / LEAST)))
    parts = blocks * (blocks + 1) // 2
    mine = F.pmod(F.xxhash64("f"), F.lit(blocks))

    def dealt(others: Column, bp: Column):
        return lambda t, *columns: t.select("f", *columns, mine.alias("_i")).select("f", *columns, "_i", F.explode(others).alias("_j")).select(bp.alias("bp"), "f", *columns).repartition(parts, "bp")

    first = dealt(F.sequence(F.col("_i"), F.lit(blocks - 1).cast("long")), F.col("_i") * blocks + F.col("_j"))
    second = dealt(F.sequence(F.lit(0).cast("long"), F.col("_i")), F.col("_j") * blocks + F.col("_i"))
    left, right = (side(own, "m", "n", "tiles").select("bp", *[F.col(c).alias(c + x) for c in ("f", "m", "n")], F.inline("tiles").alias("tx", "ty", f"bits{x}")) for side, x in ((first, "a"), (second, "b")))
    same = F.col("bp") % (blocks + 1) == 0  # both blocks are one
    pairs = left.join(right, ["bp", "tx", "ty"]).where(~same | (F.col("fa") < F.col("fb"))).groupBy("bp", "fa", "fb", "ma", "mb", "na", "nb").agg(F.sum(F.bit_count(F.col("bitsa").bitwiseAND(F.col("bitsb")))).alias("shared")).where("shared > 0")
    return pairs.select("bp", F.col("fa").alias("a"), F.col("fb").alias("b"), "ma", "mb", "shared", (F.col("na") + F.col("nb")).alias("n")), [first, second]


def similar_sets(cells: DataFrame, threshold: float, key: str = "floor_id") -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of floors whose cells are alike: pairs (a, b, shared, similarity) of class representatives, a < b, at or over the threshold; members (floor, rep).

    Floors with equal cells are one class, which its smallest floor stands for, so copies form no pairs among each other. Cells are ranked from rare to
    common; two sets of that similarity share one of the first n - ceil(threshold n) + 1 cells of each, so only those meet, and of what meets
    only pairs whose sizes and places leave room for enough shared cells. The rest of the sets is read for such candidates alone.
    cells: key, cx, cy, integers of 32 bits; they are made distinct first.
    """
    own, members = classes(cells, key)
    prefix = stage(_prefixes(own, threshold), "cell_prefixes")
    left, right = (prefix.select("cell", *[F.col(c).alias(c + x) for c in ("f", "n", "at")]) for x in "ab")
    met = left.join(right, "cell").where((F.col("fa") < F.col("fb")) & _enough(threshold)).select(F.col("fa").alias("a"), F.col("fb").alias("b")).distinct()
    return _confirmed(met, _packed(own), threshold), members


def classes(cells: DataFrame, key: str = "floor_id") -> tuple[DataFrame, DataFrame]:
    """(own, members): the set of cells (f, s, n) of each class of floors with equal cells, by its smallest floor; and each floor's class (floor, rep)."""
    c = cells.select(F.col(key).alias("f"), F.expr("(cast(cx as bigint) << 32) | (cast(cy as bigint) & 4294967295)").alias("cell")).distinct()
    sets = c.groupBy("f").agg(F.array_sort(F.collect_list("cell")).alias("s")).withColumn("n", F.size("s"))
    sets = stage(sets.withColumn("h", F.sha2(F.concat_ws(",", F.transform("s", lambda x: x.cast("string"))), 256)), "cell_sets")
    reps = sets.groupBy("h").agg(F.min("f").alias("rep"))
    members = sets.select("f", "h").join(reps, "h").select(F.col("f").alias("floor"), "rep")
    return sets.join(reps.select(F.col("rep").alias("f")), "f", "left_semi").select("f", "s", "n"), members


def _prefixes(own: DataFrame, threshold: float) -> DataFrame:
    """(f, n, cell, at): the first n - ceil(threshold n) + 1 cells of each set, from rare to common."""
    flat = own.select("f", "n", F.explode("s").alias("cell"))
    w = Window.partitionBy("f").orderBy("rare", "cell")
    ranked = flat.join(flat.groupBy("cell").agg(F.count(F.lit(1)).alias("rare")), "cell").withColumn("at", F.row_number().over(w))
    return ranked.where(F.col("at") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).select("f", "n", "cell", "at")


def _enough(threshold: float) -> Column:
    """Whether sizes (na, nb) and places (ata, atb) of a cell that two sets share leave room for the threshold."""
    room = F.least("ata", "atb") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    return (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (room * (1 + threshold) >= threshold * (F.col("na") + F.col("nb")) - 1e-9)


def _packed(own: DataFrame) -> DataFrame:
    """(f, n, tiles) of sets (f, s, n), written: tiles of 8 x 8 cells with a bit for each, by tile."""
    flat = own.select("f", "n", F.explode("s").alias("cell")).select("f", "n", F.expr("cell >> 32").alias("cx"), F.expr("((cell & 4294967295) ^ 2147483648) - 2147483648").alias("cy"))
    bit = F.expr("shiftleft(1L, cast((cx & 7) * 8 + (cy & 7) as int))")
    tiles = flat.groupBy("f", "n", F.expr("((cx >> 3) << 32) | ((cy >> 3) & 4294967295)").alias("t")).agg(F.bit_or(bit).alias("bits"))
    return stage(tiles.groupBy("f", "n").agg(F.map_from_entries(F.collect_list(F.struct("t", "bits"))).alias("tiles")), "packed")


def _confirmed(met: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """(a, b, shared, similarity) of candidates (a, b) at or over the threshold, by their full sets, which travel as tiles of bits."""
    a, b = (packed.select(F.col("f").alias(x), F.col("n").alias(f"n{x}"), F.col("tiles").alias(f"s{x}")) for x in "ab")
    shared = F.expr("aggregate(map_entries(sa), 0L, (k, x) -> k + bit_count(x.value & coalesce(try_element_at(sb, x.key), 0L)))")
    full = met.join(a, "a").join(b, "b").select("a", "b", shared.alias("shared"), (F.col("na") + F.col("nb")).alias("n"))
    return full.select("a", "b", "shared", (F.col("shared") / (F.col("n") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold)


#: All pairs that meet and are not yet connected are compared once they are at most so many for each prefix cell, or after so many rounds.
DIRECT, ROUNDS = 20, 12


def similar_components(own: DataFrame, threshold: float, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, links): components (node, label) of sets (f, s, n) under links of that similarity, the label the smallest node; and the links (a, b) that were needed.

    Pairs that are connected already are not compared. In each round a cell's sets meet one of them only, drawn by a hash; when few pairs
    of different components still meet, or a round finds nothing, all of them are compared, so no connection is lost. A set without
    links has no row. links: some that are known to hold.
    """
    prefix = stage(_prefixes(own, threshold), "cell_prefixes")
    rows, idle, packed = prefix.count(), False, _packed(own)
    labels = None if links is None else stage(components(links, "a", "b", "alike"), "labels")
    for k in range(ROUNDS + 1):
        p = prefix.withColumn("label", F.col("f")) if labels is None else prefix.join(labels.withColumnRenamed("node", "f"), "f", "left").withColumn("label", F.coalesce("label", "f"))
        p = stage(p, "labelled")
        per = p.groupBy("cell", "label").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("cell").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("apart"))
        apart = per.agg(F.sum("apart")).first()[0] or 0.0
        if apart == 0:
            break
        last = k == ROUNDS or idle or apart / 2 <= DIRECT * rows
        left, right = (p.select("cell", *[F.col(c).alias(c + x) for c in ("f", "n", "at", "label")]) for x in "ab")
        if not last:
            right = right.groupBy("cell").agg(F.min_by(F.struct("fb", "nb", "atb", "labelb"), F.xxhash64("fb", F.lit(k))).alias("h")).select("cell", "h.*")
        # by their files' size alone, all prefixes would be broadcast
        met = left.join(right.hint("merge" if last else "shuffle_hash"), "cell").where((F.col("labela") != F.col("labelb")) & _enough(threshold)).select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()
        found = stage(_confirmed(met, packed, threshold).select("a", "b"), "alike")
        some = found.count()
        links = found if links is None else links.unionByName(found)
        if last:
            break
        idle = not some
        labels = stage(components(links, "a", "b", "alike"), "labels")
    if links is None:
        links = own.select(F.col("f").alias("a"), F.col("f").alias("b")).limit(0)
    return components(links, "a", "b", "alike"), links
