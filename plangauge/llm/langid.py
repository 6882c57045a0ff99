"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plangauge.core.staging import stage, unstage
from plangauge.llm._text import with_text_columns, worker_state

UNKNOWN = "und"
#: Texts that are worth one step of the arrays.
LANES = 24


@dataclass(frozen=True)
class Parsing:
    """The fitted sample's bounds: distinct texts looked at for each language, and letters and other characters of those taken."""

    docs: int = 256
    lang_chars: int = 40_000


def may_learn(doc_id: Column) -> Column:
    """Whether a document may be learnt from: crc32 of its id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def fit(labelled: DataFrame, p: Parsing = Parsing(), *, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, training text) by language, from a bounded sample of labelled rows: distinct texts of the smallest hashes.

    Of each language p.docs distinct texts with letters are looked at, however often a text is repeated, in the order of their
    hashes; each is taken whole where p.lang_chars has room for it (the shortest one in any case). Languages are few; what the
    driver gets is bounded by their number times p.docs lengths and p.lang_chars characters (or one text, where all are longer).
    Rows without language or letters teach nothing; an empty table gives an empty list.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    texts = stage(rows.select("lang", "h", F.length("text").alias("size")).distinct(), "labelled")
    counts = {r.lang: r.n for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # hashes are even over 64 bits: about 4 * p.docs of a language's are under its cut, and only those are ranked
    cuts = [(lang, float((1 << 64) * min(1.0, 4 * p.docs / n) - (1 << 63))) for lang, n in counts.items()]
    seen: dict[str, list[tuple[int, int]]] = {}
    for cut in (True, False):
        some = texts.join(F.broadcast(labelled.sparkSession.createDataFrame(cuts, "lang string, cut double")), "lang").where(F.col("h").cast("double") <= F.col("cut")) if cut else texts
        least = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "size"))).where(F.col("k") <= p.docs)
        seen = {}
        for lang, h, size in least.select("lang", "h", "size").collect():
            seen.setdefault(lang, []).append((h, size))
        if all(len(seen.get(lang, ())) == min(n, p.docs) for lang, n in counts.items()):
            break
    unstage(texts)
    taken: list[tuple[str, int]] = []
    for lang, found in seen.items():
        room, none = p.lang_chars, True
        for h, size in sorted(found):
            if size <= room:
                taken.append((lang, h))
                room, none = room - size, False
        if none:
            taken.append((lang, min((size, h) for h, size in found)[1]))
    if not taken:
        return []
    some = rows.join(F.broadcast(labelled.sparkSession.createDataFrame(taken, "lang string, h long")), ["lang", "h"])
    got: dict[str, list[tuple[int, str]]] = {}
    for lang, h, text in some.select("lang", "h", "text").distinct().collect():
        got.setdefault(lang, []).append((h, text))
    return [(lang, " ".join(t for _, t in sorted(got[lang]))) for lang in sorted(got)]


def suffix_automaton(codes: list[int], alphabet: int) -> np.ndarray:
    """Transition table of the suffix automaton of a sequence, states x alphabet.

    An entry is the next state if the longer string occurs in the sequence; else the state after the symbol alone, as ~state. A
    symbol that does not occur leads to one last state, where nothing goes on: it is a phrase of its own.
    """
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                link[to] = link[new] = twin
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
        last = new
    alone = np.array([step[0].get(c, len(step)) for c in range(alphabet)], np.int32)
    table = np.empty((len(step) + 1, alphabet), np.int32)
    table[:] = ~alone
    table[0] = alone
    for s, row in enumerate(step):
        if row:
            table[s, list(row)] = list(row.values())
    return table


def codes_of(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-case letters as alphabet codes; each run of other characters is one 0. Letters outside the alphabet are 1."""
    c = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    return c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]] if len(c) else c


def _models(samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    return worker_state(("language", samples), lambda: _built(samples))


def _built(samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Built once in each worker: letter codes, the automata end to end, where each starts, and log2 of each training length."""
    letters = sorted({c for _, t in samples for c in t.lower() if c.isalpha()})
    table = np.zeros(0x110000, np.uint32)  # every code point
    table[[i for i in range(len(table)) if chr(i).isalpha()]] = 1
    table[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
    parts, starts, logs = [], [], []
    for _, t in samples:
        codes = codes_of(t, table)
        part = suffix_automaton(codes.tolist(), len(letters) + 2)
        shift = sum(map(len, parts))
        parts.append(np.where(part >= 0, part + shift, part - shift))
        starts.append(shift)
        logs.append(math.log2(max(2, len(codes))))
    return table, np.concatenate(parts).astype(np.int32), starts, np.array(logs)


def phrases(codes: list[np.ndarray], steps: np.ndarray, starts: list[int]) -> np.ndarray:
    """Texts x languages: the number of phrases in the cross-parsing of each whole text by each language's automaton.

    A phrase is the longest match from where the last one ended. All texts and languages of the batch are parsed at once, symbol by
    symbol; the ends of the longest texts, where fewer than LANES are left, one by one.
    """
    size = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-size, kind="stable")
    flat, symbols = steps.reshape(-1), np.concatenate(codes)
    width, at, sized = steps.shape[1], (np.cumsum(size) - size)[order], size[order]
    found = np.zeros((len(starts), len(size)), np.int64)
    state = np.repeat(np.array(starts, np.int64)[:, None], len(size), axis=1)
    whole = int(sized[LANES - 1]) if len(sized) >= LANES else 0
    live = np.searchsorted(-sized, -np.arange(whole), side="left")  # texts with a symbol at each place
    for k in range(whole):
        n = live[k]
        to = flat[state[:, :n] * width + symbols[at[:n] + k]]
        found[:, :n] -= to >> 31
        state[:, :n] = to ^ (to >> 31)
    step = memoryview(flat)
    for i in range(min(LANES, len(sized))):
        rest = symbols[at[i] + whole : at[i] + sized[i]].tolist()
        for lang in range(len(starts)):
            s, n = int(state[lang, i]), 0
            for c in rest:
                s = step[s * width + c]
                if s < 0:
                    s, n = ~s, n + 1
            found[lang, i] += n
    back = np.empty_like(found)
    back[:, order] = found + 1  # the phrase that is open at the end
    return back.T


def identify(df: DataFrame, samples: list[tuple[str, str]], *, text_col: str = "text") -> DataFrame:
    """df plus lang_pred and score (0 to 1): the language whose training text parses the whole text in the fewest normalised phrases.

    The normalised count, phrases times log2 of the training length, is the code length of the text in that language. The score is
    the margin to the second language, 1 - least / second (1 where only one language was learnt). Ties go to the language that
    sorts first. Null texts, texts without a letter, and any text if nothing was learnt are `und` with score 0. A long text is
    parsed whole, as one sequence; repeated rows are judged each, and an empty table gives an empty one. Input columns named
    lang_pred or score are replaced; no other column is read.
    """
    known = tuple(samples)

    def work(column: pa.Array) -> list:
        pred, score = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        if known:
            table, steps, starts, logs = _models(known)
            codes = [codes_of(t, table) for t in column.to_pylist()]
            use = np.array([bool(c.any()) for c in codes])
            if use.any():
                cost = phrases([c for c, u in zip(codes, use, strict=True) if u], steps, starts) * logs
                pred[use] = np.array([lang for lang, _ in known], object)[np.argmin(cost, axis=1)]
                cost.sort(axis=1)
                score[use] = 1 - cost[:, 0] / cost[:, 1] if len(known) > 1 else 1.0
        return [pa.array(pred, pa.string()), pa.array(score)]

    return with_text_columns(df, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], work, 4 << 20)
