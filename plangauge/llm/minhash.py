"""Near-duplicate groups by one-permutation MinHash with optimal densification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plangauge.core.components import components
from plangauge.core.staging import stage, unstage
from plangauge.llm._bitmaps import mark
from plangauge.llm._skew import join_groups
from plangauge.llm._text import slices, texts, worker_state


@dataclass(frozen=True)
class Near:
    """Words in a shingle, least similarity in per cent, and the banding: bands x rows bins.

    At similarity 0.8 a pair shares no bucket with probability (1 - 0.8 ** rows) ** bands, 6e-5 here.
    """

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes: A-Z lowered, words between ASCII white space.

    A text of fewer words than width has the whole sequence as its one shingle; one without words has none.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(column))
    flat = words.flatten().dictionary_encode()
    full = pc.greater(pc.binary_length(flat.dictionary), 0).to_numpy(zero_copy_only=False)
    known = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_numpy(zero_copy_only=False).tolist()] or [0], np.uint64)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        c = codes[a:b]
        h = known[c[full[c]]]
        n = len(h)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        take = min(width, n)
        s = np.full(n - take + 1, take, np.uint64)
        for k in range(take):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[k : n - take + 1 + k])
        out.append(np.unique(s))
    return out


def signatures(sets: list[np.ndarray], bins: int, seed: int = 1) -> np.ndarray:
    """One row of `bins` minima for each set; an empty bin takes the value of a bin drawn by a hash of its own, again and again until one has a value."""
    sig = np.zeros((len(sets), bins), np.uint64)
    has = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = ((s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)  # non-decreasing, as s is sorted
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            sig[i, at[first]], has[i, at[first]] = s[first], True
    row, col = np.nonzero(~has & has.any(axis=1)[:, None])
    draw = 0
    while len(row):
        draw += 1
        x = _mix(col.astype(np.uint64) + np.uint64(bins) * np.uint64(draw) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        to = (x % np.uint64(bins)).astype(np.int64)
        ok = has[row, to]
        sig[row[ok], col[ok]] = sig[row[ok], to[ok]]
        row, col = row[~ok], col[~ok]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; equal keys mean the same bucket."""
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands])
    return key


def sketch(df: DataFrame, p: Near, *, id_col: str, text_col: str, row_col: str) -> DataFrame:
    """(row, id, n, hash, keys) for each row: set size, 128-bit hash of the whole set (null if empty) and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("minhash",), bool)
        for b in slices(batches, "text", 2 << 20):
            sets = shingle_sets(texts(b, "text"), p.width)
            keys = band_keys(signatures(sets, p.bands * p.rows), p.bands, p.rows).view(np.int64)
            full = np.array([len(s) > 0 for s in sets], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full * p.bands)], pa.int32()), pa.array(keys[full].ravel()))
            hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), lists], ["row", "id", "n", "hash", "keys"])

    rows = df.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {kind}, n long, hash binary, keys array<long>")


def _sets_of(rows: DataFrame, wanted: DataFrame, p: Near, text_col: str) -> DataFrame:
    """(node, hash, shingles) for the wanted _pg_row: the sets again, from the whole texts, which do not shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("minhash",), bool)
        for b in slices(batches, "text", 2 << 20):
            sets = shingle_sets(texts(b, "text"), p.width)
            hashes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in sets])], pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("_pg_row"), pa.array(hashes, pa.binary()), lists], ["node", "hash", "shingles"])

    found = mark(rows.select("_pg_row", F.col(text_col).cast("string").alias("text")), wanted, "_pg_row").where("_pg_marked")
    return found.select("_pg_row", "text").mapInArrow(run, "node long, hash binary, shingles array<long>")


#: Members of one hub that are compared with it in one place.
TOGETHER = 256


def _compared(pairs: DataFrame, sets: DataFrame, difference: bool = False) -> DataFrame:
    """The pairs (hub, node) with both set sizes and i, the size of the intersection; with `diff`, the shingles only one of them has.

    A node's set goes to its hub, and a hub's set goes once to each part of its members, about TOGETHER of them, so that a hub of any
    number of members is many keys.
    """
    sizes = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("_pg_c")).select("hub", F.ceil(F.col("_pg_c") / TOGETHER).cast("int").alias("_pg_parts"), F.col("_pg_c").alias("c"))
    sizes = stage(sizes, "hubs")
    parted = join_groups(pairs.select("hub", "node"), sizes, "hub", "c").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("_pg_parts")).cast("int").alias("_pg_part"))
    members = parted.join(sets.select("node", F.col("shingles").alias("_pg_b")), "node")
    hubs = sizes.join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("_pg_a")), "hub")
    hubs = hubs.select("hub", "_pg_a", F.explode(F.sequence(F.lit(0), F.col("_pg_parts") - 1)).alias("_pg_part"))
    both = members.join(hubs, ["hub", "_pg_part"])
    diff = [F.concat(F.array_except("_pg_b", "_pg_a"), F.array_except("_pg_a", "_pg_b")).alias("diff")] if difference else []
    return both.select("hub", "node", F.size("_pg_a").cast("long").alias("hub_n"), F.size("_pg_b").cast("long").alias("n"), F.size(F.array_intersect("_pg_a", "_pg_b")).cast("long").alias("i"), *diff)


def _missed_by_stars(tested: DataFrame, labels: DataFrame, sets: DataFrame, p: Near) -> DataFrame:
    """Pairs (hub, node) of nodes that share a star's hub B, are in different components, and may be similar enough.

    Let x differ from B by the set dx (shingles that only one of them has), r of them B's. Then |x and y| = |B| - rx - ry +
    |dx and dy|, so x and y are similar if and only if dx and dy share at least T = p (nx + ny) / (100 + p) - |B| + rx + ry. One of
    the two, say x, is not in B's component and so not similar to B, which makes T positive: every such pair shares a difference.
    With differences ordered rarest first, it shares one in the first |d| - T + 1 of both, with enough left behind it.

    Differences are made only for the members of hubs that have a member in another component.
    """
    known = labels.select("node", "label")
    m = tested.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    m = m.join(known.withColumnsRenamed({"node": "hub", "label": "hub_label"}), "hub", "left")
    m = m.select("hub", "node", "hub_n", "n", (F.col("hub_n") - F.col("i")).alias("r"), (F.col("hub_n") + F.col("n") - 2 * F.col("i")).alias("d"), "label", (F.col("label") != F.coalesce("hub_label", "hub")).alias("apart"))
    m = stage(m, "placed")
    by_hub = stage(m.groupBy("hub").agg(F.min(F.when(F.col("apart"), F.col("d"))).alias("far"), F.count(F.lit(1)).alias("c")).where("far is not null and c > 1"), "far")
    q = 100 + p.percent
    far = join_groups(m, by_hub, "hub", "c").withColumn("k", F.expr(f"{p.percent} * n - 100 * hub_n + {q} * r"))
    least = F.expr(f"greatest(1, if(apart, ceil(k / 100), ceil((k + {p.percent} * far) / {q})))")  # of T, over all partners that count
    far = stage(far.withColumn("t", least).where("d >= t").select("hub", "node", "hub_n", "n", "r", "d", "t", "label", "apart", F.monotonically_increasing_id().alias("m")), "members")
    unstage(m)
    diffs = stage(_compared(far, sets, difference=True).select("hub", "node", "diff"), "diffs")
    parts = stage(far.select("hub", "node", "m").join(diffs, ["hub", "node"]).select("m", F.explode("diff").alias("s")), "parts")
    unstage(diffs)
    often = parts.groupBy("s").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("m").orderBy("often", "s")).alias("rank")
    ranked = parts.join(often, "s").select("m", "s", rank)
    prefix = stage(ranked.join(far, "m").where("rank <= d - t + 1").drop("m", "t"), "prefix")
    unstage(parts)
    x = prefix.where("apart").select("hub", "s", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "r", "d", "label", "rank")])
    left = "least(d - rank, x_d - x_rank) + 1"
    enough = f"{q} * (hub_n - r - x_r + {left}) >= {p.percent} * (n + x_n)"
    pairs = x.join(prefix, ["hub", "s"]).where(f"label <> x_label and (not apart or node > x_node) and {enough}")
    rest = stage(pairs.select(F.least("x_node", "node").alias("hub"), F.greatest("x_node", "node").alias("node")).distinct(), "rest")
    for done in (by_hub, far, prefix):
        unstage(done)
    return rest


def groups(df: DataFrame, p: Near = Near(), *, id_col: str = "doc_id", text_col: str = "text", log=None) -> DataFrame:
    """(row, id, n, label, component) for each row of df; row is its place in the scan.

    Rows with equal sets are one node, known by the first of their rows, so that copies never meet in pairs. Each node goes to one
    bucket for each band. In a bucket the node with the most bucket mates over all bands is the hub, and each other node is a
    candidate with it alone: a star. Candidates are confirmed on the full sets. Members of one star that are not linked through its
    hub are compared further where their differences from the hub leave it possible that they are similar (_missed_by_stars), so
    that no link is lost to the stars. Components follow from the links; component is the smallest id in it, label the component's
    own number. Each table between is deleted when its last reader is done.

    Null and empty texts have no set, are linked with nothing and are their own component. Rows with equal ids are told apart by
    their places; repeated rows are one node. Long texts are taken whole; an empty table gives an empty one; other columns are not
    read. df must be a stored table, read again in the same order; where it is not, this raises an error.
    """
    rows = df.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("_pg_row"))
    sk = stage(sketch(rows, p, id_col=id_col, text_col=text_col, row_col="_pg_row"), "sketch")
    slim = stage(sk.select("row", "id", "n", "hash"), "rows")
    nodes = stage(slim.where("hash is not null").groupBy("hash").agg(F.min("id").alias("id"), F.min("row").alias("node")), "nodes")
    first = mark(sk.select(F.col("row").alias("_pg_row"), "keys"), nodes.select(F.col("node").alias("_pg_row")), "_pg_row").where("_pg_marked")
    placed = first.select(F.col("_pg_row").alias("node"), F.explode("keys").alias("key"))
    full = stage(placed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "full")
    mates = stage(join_groups(placed, full, "key", "c"), "buckets")
    unstage(sk)
    degree = mates.groupBy("node").agg(F.sum("c").alias("d"))
    ranked = stage(mates.join(degree, "node").select("key", "node", "d", "c"), "ranked")
    unstage(mates)
    hubs = stage(ranked.groupBy("key").agg(F.max(F.struct("d", "node")).alias("h"), F.count(F.lit(1)).alias("c")).select("key", F.col("h.node").alias("hub"), "c"), "hubs")
    stars = stage(join_groups(ranked.select("key", "node"), hubs, "key", "c").where("node <> hub").select("hub", "node").distinct(), "stars")
    ends = stars.select(F.col("hub").alias("node")).unionByName(stars.select("node")).distinct()
    wanted = stage(nodes.select("node", "hash").join(ends, "node"), "wanted")
    sets = stage(_sets_of(rows, wanted.select(F.col("node").alias("_pg_row")), p, text_col), "sets")
    if lost := wanted.join(sets.select("node", "hash"), ["node", "hash"], "left_anti").count():
        raise RuntimeError(f"{lost} rows were not found again: the table was not read twice in the same order")
    similar = f"100 * i >= {p.percent} * (hub_n + n - i)"
    tested = stage(_compared(stars, sets), "tested")
    links = stage(tested.where(similar).select("hub", "node"), "links")
    if log is not None:
        log(nodes=nodes.count(), bucketed=ranked.count(), stars=stars.count(), links=links.count())
    for done in (full, ranked, hubs, stars, wanted):
        unstage(done)
    linked = stage(components(links, "hub", "node"), "labels")
    rest = _missed_by_stars(tested, linked, sets, p)
    further = stage(_compared(rest, sets).where(similar).select("hub", "node"), "further")
    if log is not None:
        log(rest=rest.count(), further=further.count())
    for done in (sets, tested, rest):
        unstage(done)
    # components of the first links are one node each by now
    ends = further.join(linked.withColumnsRenamed({"node": "hub", "label": "a"}), "hub", "left").join(linked.withColumnRenamed("label", "b"), "node", "left")
    joined = stage(components(ends.select(F.coalesce("a", "hub").alias("a"), F.coalesce("b", "node").alias("b")), "a", "b"), "labels")
    again = joined.select(F.col("node").alias("label"), F.col("label").alias("_pg_label"))
    labels = linked.join(again, "label", "left").select("node", F.coalesce("_pg_label", "label").alias("label")).unionByName(joined.join(linked.select("node"), "node", "left_anti"))

    known = nodes.join(labels, "node", "left").select("hash", "id", F.coalesce("label", "node").alias("label"))
    known = stage(known, "known")
    for done in (links, linked, further, joined, nodes):
        unstage(done)
    least = known.groupBy("label").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("c"))
    by_node = stage(known.join(least, "label").select("hash", "label", "component"), "by-node")
    unstage(known)
    some = slim.where("hash is not null").join(by_node, "hash").select("row", "id", "n", "label", "component")
    none = slim.where("hash is null").select("row", "id", "n", F.lit(None).cast("long").alias("label"), F.col("id").alias("component"))
    return some.unionByName(none)


def near_dedup(df: DataFrame, p: Near = Near(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each near-duplicate group, that of the smallest id (the first such row of the table); texts without words all stay.

    What groups() says of its input holds here; the column names _pg_row and _pg_marked are reserved.
    """
    found = groups(df, p, id_col=id_col, text_col=text_col)
    some = stage(found.where("label is not null").select("row", "id", "label"), "grouped")
    best = some.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.count(F.lit(1)).alias("c")).where("c > 1")
    best = stage(best.select("label", F.col("best.row").alias("stay"), "c"), "stay")
    gone = stage(join_groups(some, best, "label", "c").where("row <> stay").select(F.col("row").alias("_pg_row")), "gone")
    unstage(some)
    unstage(best)
    return mark(df.withColumn("_pg_row", F.monotonically_increasing_id()), gone, "_pg_row").where("not _pg_marked").drop("_pg_row", "_pg_marked")
