"""How filters interact: what each removes, in every order, from additive counts of failure masks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plangauge.core.staging import stage, unstage
from plangauge.llm._bitmaps import BITMAP_BITS, bit_of, mark
from plangauge.llm._skew import join_groups
from plangauge.llm._text import slices, texts

#: The filters in the order of their bits; the last one is failed by copies of a smaller id's text.
FILTERS = "ABCDE"
COPY = 1 << 4
#: Cells that a worker gathers before it hands out a part of the sketch.
GATHERED = 4_000_000


@dataclass(frozen=True)
class Limits:
    """What texts must keep to: A words at least, B distinct words in per cent of words, C capitals A-Z in per cent of code points at most, D no symbol of these."""

    words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 3
    symbols: str = "#$%&*|"


def masks(column: pa.Array, limits: Limits) -> np.ndarray:
    """Bits 1, 2, 4 and 8 for failing A, B, C and D, one number for each text (no nulls)."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = memoryview(column.buffers()[2] or b"")
    kind = np.zeros((3, 256), np.int64)
    kind[0, ord("A") : ord("Z") + 1] = 1
    kind[1, :128] = kind[1, 192:] = 1  # bytes that begin a code point
    kind[2, [*limits.symbols.encode("ascii")]] = 1
    out = np.zeros(len(column), np.int64)
    for i, (a, b) in enumerate(itertools.pairwise(ends.tolist())):
        text = bytes(data[a:b])
        words = text.split()
        capitals, points, symbols = (kind @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()
        low = len(words) < limits.words
        poor = 100 * len(set(words)) < limits.distinct_percent * len(words)
        out[i] = low + 2 * poor + 4 * (100 * capitals > limits.capital_percent * points) + 8 * (symbols > 0)
    return out


def _flags(rows: DataFrame, limits: Limits) -> DataFrame:
    """(row, id, part, key, mask) of (row, id, part, text); key is the text's SHA-256. Texts go no further."""
    source = rows.select("row", "id", "part", F.unhex(F.sha2("text", 256)).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(masks(texts(b, "text"), limits), pa.int32())], ["row", "id", "part", "key", "mask"])

    return source.mapInArrow(run, source.drop("text").schema.add("mask", T.IntegerType()))


# ---- counting Bloom filter


def _placed(rows: DataFrame, pages: int) -> DataFrame:
    """rows plus page, c0 and c1: two different cells of one page for each key."""
    hashed = F.xxhash64("key")
    first = F.pmod(hashed, F.lit(BITMAP_BITS))
    other = F.pmod(first + 1 + F.pmod(F.shiftrightunsigned(hashed, 15), F.lit(BITMAP_BITS - 1)), F.lit(BITMAP_BITS))
    return rows.withColumns({"page": F.pmod(F.xxhash64("key", F.lit(1)), F.lit(pages)), "c0": first, "c1": other})


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch of one task's rows: for each page the cells that it counted, twice the cell's number plus one where it counted more than once."""
    held: list[np.ndarray] = []
    rows: list[np.ndarray] = []

    def emit() -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        page = cells // BITMAP_BITS
        names, first = np.unique(page, return_index=True)
        which, members = np.unique(np.concatenate(rows), return_counts=True)
        codes = ((cells % BITMAP_BITS) * 2 + (n > 1)).astype("<u4")
        bits = [c.tobytes() for c in np.split(codes, first[1:])]
        held.clear(), rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(members[np.searchsorted(which, names)], pa.int64()), pa.array(bits, pa.binary())], ["page", "n", "cells"])

    for b in batches:
        page, c0, c1 = (b.column(c).to_numpy() for c in ("page", "c0", "c1"))
        held += [page * BITMAP_BITS + c0, page * BITMAP_BITS + c1]
        rows.append(page)
        if sum(map(len, held)) > GATHERED:
            yield emit()
    if sum(map(len, held)):
        yield emit()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of sketches, sorted by page, added up: one bitmap for each page of the cells that counted twice or more. One page is held at a time."""
    now, rows, counts = None, 0, np.zeros(BITMAP_BITS, np.uint8)

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([rows], pa.int64()), pa.array([np.packbits(counts > 1, bitorder="little").tobytes()], pa.binary())], ["page", "n", "bitmap"])

    for b in batches:
        for page, n, cells in zip(*(b.column(c).to_pylist() for c in ("page", "n", "cells")), strict=True):
            if page != now:
                if now is not None:
                    yield emit()
                now, rows, counts = page, 0, np.zeros(BITMAP_BITS, np.uint8)
            codes = np.frombuffer(cells, "<u4")
            counts[codes >> 1] = np.minimum(counts[codes >> 1] + 1 + (codes & 1), 2)
            rows += n
    if now is not None:
        yield emit()


def repeat_sketch(placed: DataFrame) -> DataFrame:
    """(page, n, bitmap): which cells of a page two or more rows count in, and how many rows it has.

    Each task counts its own rows first, so what shuffles is at most the tasks' sketches: two bytes and a bit for each cell in use.
    """
    parts = placed.select("page", "c0", "c1").mapInArrow(_parts, "page long, n long, cells binary")
    return parts.repartition("page").sortWithinPartitions("page").mapInArrow(_merged, "page long, n long, bitmap binary")


def possible_repeats(rows: DataFrame, *, cells_per_row: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """rows (with a column key, staged) plus boolean `maybe`: false only where no other row has the key.

    The filter grows with the rows. It is broadcast while its size, known from the row count, is within broadcast_bytes; beyond that it
    is joined by page, pages that a hot key fills being joined where their rows are.
    """
    pages = max(1, math.ceil(rows.count() * cells_per_row / BITMAP_BITS))
    placed = _placed(rows, pages)
    sketch = stage(repeat_sketch(placed), "counting-bloom")
    found = placed.join(F.broadcast(sketch.drop("n")), "page") if pages * BITMAP_BITS // 8 <= broadcast_bytes else join_groups(placed, sketch, "page", "n")
    return found.select(*rows.columns, (bit_of("bitmap", "c0") & bit_of("bitmap", "c1")).alias("maybe"))


# ---- masks and orders


def failure_masks(docs: DataFrame, *, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", part: Column | None = None, **options) -> DataFrame:
    """(id, part, mask) of every row of docs, a stored table; mask has a bit for each filter of FILTERS that the whole text fails.

    Null texts count as empty. The last filter fails where a smaller id has the same text in the whole table; a null id neither fails it
    nor makes others fail, and rows that share their id do not make each other fail. Only texts that the counting filter cannot clear
    shuffle, and of those each task sends one record a text; the rest of the work is on rows without texts. An empty table gives an
    empty one; other columns are not read, so their names do not matter. Long texts are read whole, one at a time. The options are
    those of possible_repeats.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.lit("") if part is None else part).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    flags = stage(_flags(rows, limits), "flags")
    seen = stage(possible_repeats(flags, **options), "maybe-repeats")
    repeats = mark(rows.select("row", "id", "text"), seen.where("maybe").select("row"), "row").where("_pg_marked")
    least = repeats.groupBy("text").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = stage(least.select(F.unhex(F.sha2("text", 256)).alias("key"), "least", "n"), "repeats")
    copies = join_groups(seen.where("maybe"), groups, "key", "n")
    unstage(flags)
    return seen.where("not maybe").select("id", "part", "mask").unionByName(copies.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("least"), COPY).otherwise(0)).alias("mask")))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counts of the rows of failure_masks, labels being (id, good, toxic) with 0 or 1.

    A document with several labels is good or toxic if one of them says so; ids without documents and null ids are passed over. Rows with equal
    id, part and mask are counted before they meet their label. Both sides grow with the documents, so they are merged: files compress ids
    so well that their size would call for a broadcast of millions of rows.
    """
    known = labels.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = stage(failed.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    of = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n"))
    all_rows = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    labelled = rows.join(known.hint("merge"), "id").groupBy("part", "mask").agg(F.lit(0).cast("long").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))
    return all_rows.unionByName(labelled).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What every filter does at every step of every order, from mask_counts: a row for each part, order and step.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley, the documents that the step's filter removes, added up over
    all orders. An order is a word of the filters' letters. The table of orders is fixed in size and meets the counts by mask. Counts are
    read twice and few, so they are written.
    """
    counts = stage(counts, "mask-counts")
    bit = {f: 1 << k for k, f in enumerate(filters)}
    steps = [("".join(o), k + 1, sum(bit[f] for f in o[:k]), bit[o[k]]) for o in itertools.permutations(filters) for k in range(len(o))]
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, here int")
    orders = orders.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    fails, earlier = F.expr("mask & here <> 0"), F.expr("mask & before <> 0")
    total = lambda which, c="n": F.sum(F.when(which, F.col(c)).otherwise(0))
    done = counts.join(F.broadcast(orders), "mask").groupBy("part", "filter_order", "step", "here").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("here")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    shares = done.groupBy("part", "here").agg(F.sum("removed").alias("shapley"))
    return done.join(shares, ["part", "here"]).drop("here")
