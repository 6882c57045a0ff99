"""Periodic runs of words, found with a suffix automaton whose link tree is kept as coloured paths."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plangauge.llm._text import with_text_columns

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


class LastSeen:
    """The link tree of a suffix automaton as paths of states that were last seen at the same place.

    A path is a splay tree ordered by depth (left is nearer to the root); its root holds where the path's states were last seen
    (`seen`) and, as its parent, the state above the path. State 0 stands for none.
    """

    def __init__(self, states: int):
        self.left, self.right, self.up, self.seen = [0] * states, [0] * states, [0] * states, [-1] * states

    def splay(self, x: int) -> None:
        """Make x the root of its path."""
        left, right, up, seen = self.left, self.right, self.up, self.seen
        while True:
            p = up[x]
            if not p:
                return
            on_left = left[p] == x
            if not on_left and right[p] != x:
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                # p turns first when x lies on the same side of it as it does of g, else x turns twice
                turns = (p, x) if (left[g] == p) == on_left else (x, x)
            else:
                turns = (x,)
            for y in turns:
                q = up[y]
                h = up[q]
                if left[q] == y:
                    c = left[q] = right[y]
                    right[y] = q
                else:
                    c = right[q] = left[y]
                    left[y] = q
                if c:
                    up[c] = q
                if h and left[h] == q:
                    left[h] = y
                elif h and right[h] == q:
                    right[h] = y
                else:
                    seen[y] = seen[q]
                up[y], up[q] = h, y

    def insert_above(self, state: int, new: int) -> None:
        """Put a new state between a state and the one above it; it was last seen where the state was."""
        self.splay(state)
        above = self.left[state]
        self.left[new], self.left[state], self.up[new] = above, new, state
        if above:
            self.up[above] = new

    def access(self, state: int, place: int) -> list[tuple[int, int]]:
        """Everything from the state up to the root is seen at `place` now; before that: (where last seen, lowest state) of each stretch, from below."""
        left, right, up, seen = self.left, self.right, self.up, self.seen
        met, below, x = [], 0, state
        while x:
            self.splay(x)
            met.append((seen[x], x))
            rest = right[x]
            if rest:
                seen[rest] = seen[x]
            right[x] = below
            if below:
                up[below] = x
            below, x = x, up[x]
        seen[below] = place
        return met[1:]


def runs_of(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence: maximal stretches of their smallest period, at least twice it and `least` long.

    As each word is appended, the states above the new prefix in the link tree are met in stretches that were last seen at the same end.
    A stretch last seen at `end` shares its lowest state's length L with the new end and no more; with L at or over the distance
    p = i - end, the last L + p words have period p, which is their smallest: a shorter one would have been seen later. Such a
    repetition ends here unless the next word is the one p words before it.
    """
    n = len(words)
    size = 2 * n + 3
    link, length = [0] * size, [0] * size
    word, to = [None] * size, [0] * size  # the first transition of a state
    more: dict[int, dict[int, int]] = {}  # the other ones
    tree = LastSeen(size)
    last, count, found = 1, 1, []
    for i, w in enumerate(words):
        count += 1
        cur = count
        length[cur] = i + 1
        p = last
        while p:
            if word[p] == w or (p in more and w in more[p]):
                break
            if word[p] is None:
                word[p], to[p] = w, cur
            else:
                more.setdefault(p, {})[w] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = to[p] if word[p] == w else more[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                count += 1
                clone = count
                length[clone], link[clone], word[clone], to[clone] = length[p] + 1, link[q], word[q], to[q]
                if q in more:
                    more[clone] = dict(more[q])
                tree.insert_above(q, clone)
                while p:
                    if word[p] == w:
                        if to[p] != q:
                            break
                        to[p] = clone
                    elif p in more and more[p].get(w) == q:
                        more[p][w] = clone
                    else:
                        break
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
        tree.up[cur] = link[cur]
        for end, state in tree.access(cur, i):
            distance, common = i - end, length[state]
            if common >= distance and common + distance >= least and (i + 1 == n or words[i + 1] != words[i + 1 - distance]):
                found.append((i + 1 - distance - common, common + distance, distance))
    return found


def stretches(ids: np.ndarray, owner: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches outside which no run lies: words in a sequence of k words that occurs again in its own stretch.

    A run of length n and period q holds n - q - k + 1 > 0 such sequences from its start and again q words later, and they cover it.
    Stretches are cut again by the same rule until nothing goes; equal hashes of unequal sequences keep more than they must.
    """
    at = np.arange(len(ids))
    while len(at) >= k:
        h = owner[: len(at) - k + 1].astype(np.uint64) + np.uint64(1)
        for j in range(k):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h += ids[j : len(ids) - k + 1 + j].astype(np.uint64)
        whole = np.flatnonzero(owner[: len(at) - k + 1] == owner[k - 1 :])
        h = h[whole]
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        steps = np.zeros(len(at) + 1, np.int64)
        starts = whole[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))]
        steps[starts] += 1
        steps[starts + k] -= 1
        kept = np.cumsum(steps[:-1]) > 0
        if kept.all():
            break
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | ~kept[:-1]
        at, ids, owner = at[kept], ids[kept], np.cumsum(new)[kept]
    else:
        return []
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in itertools.pairwise([0, *cuts.tolist(), len(at)])]


def find(column: pa.Array, least: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """(the runs, the text without repeats) of each text of an array without nulls."""
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    split = [t.split() for t in column.cast(pa.binary()).to_pylist()]
    sizes = np.array([len(ws) for ws in split], np.int64)
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(split)), sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for a, b in stretches(ids, owner, (least + 1) // 2):
        text = int(owner[a])
        runs[text] += [(a - int(first[text]) + s, n, q) for s, n, q in runs_of(ids[a:b].tolist(), least)]
    out = []
    for ws, rs in zip(split, runs, strict=True):
        if rs:
            rs.sort(key=lambda r: (r[0], r[2]))
            gone = np.zeros(len(ws) + 1, np.int64)
            for s, n, q in rs:
                gone[s + q] += 1
                gone[s + n] -= 1
            ws = itertools.compress(ws, (np.cumsum(gone[:-1]) == 0).tolist())
        out.append(b" ".join(ws))
    return runs, out


def with_runs(df: DataFrame, *, text_col: str = "text", least: int = 12) -> DataFrame:
    """df plus `runs`, array of (start, length, period) in order of start and period, and `collapsed`, the words outside all repeats joined by spaces.

    A run is a stretch of words, parted by white space, with smallest period q and at least max(least, 2 q) words, that no neighbouring
    word extends. What follows a run's first q words is left out of `collapsed`, unless no run says so. Null texts count as
    empty and have no run. Input columns of those names are replaced. One pass, no shuffle: each text is read whole, a task holds a
    few megabytes of texts or one long text, and the automaton of one stretch of repeats at a time. Repeated rows are searched each,
    and an empty table gives an empty one.
    """
    def work(column: pa.Array) -> list:
        runs, texts = find(column, least)
        ends = np.cumsum([0, *map(len, runs)])
        flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=pa.list_(pa.field("element", rows.type, False))), pa.array(texts, pa.binary()).cast(pa.string())]

    return with_text_columns(df, text_col, [T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())], work, 4 << 20)
