"""Byte-level BPE by a rank file, as recursive DuckDB queries inside each task."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plangauge.core.columns import others
from plangauge.llm._text import Recent, ragged, trim, with_text_columns, worker_state

#: White space, a space, and white space or the end: nothing may be cut off there. Fixed value: what the \s of a pattern takes.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNCUT = f"{WHITE} (?:{WHITE}|$)"
#: Pieces and words that a worker keeps, in each of two generations; those of more characters are encoded like any other but not kept.
KEPT, KEPT_SIZE = 300_000, 256
#: Words contracted together.
TOGETHER = 20_000
#: Memory for the queries of one task.
QUERY_MEMORY = "300MB"

#: Words of fewer bytes take the first query; its rows are numbered word * WIDTH + position, positions without gaps.
WIDTH = 128
#: Contracts `tokens` (place, id) to the fixpoint. A step joins the neighbours in each word with the merges, takes the pair of smallest
#: rank, the leftmost of several, and hands on the words that had one; a word's last step is its encoding.
SHORT = f"""
WITH RECURSIVE line(place, id, step) AS (
  SELECT place, id, 0 FROM tokens
  UNION ALL
  (WITH pair AS (SELECT place, id, lead(place) OVER w AS next, lead(id) OVER w AS second FROM line WINDOW w AS (ORDER BY place)),
  least AS (SELECT place // {WIDTH} AS word, min(merged * {WIDTH} + place % {WIDTH}) AS found
    FROM pair JOIN merges ON first_second = (CAST(id AS BIGINT) << 32) + pair.second WHERE next = place + 1 GROUP BY ALL)
  SELECT CASE WHEN place % {WIDTH} > found % {WIDTH} THEN place - 1 ELSE place END, CASE WHEN place % {WIDTH} = found % {WIDTH} THEN found // {WIDTH} ELSE id END, step + 1
  FROM line JOIN least ON word = place // {WIDTH} WHERE place % {WIDTH} <> found % {WIDTH} + 1)
)
SELECT place // {WIDTH} AS word, id FROM line JOIN (SELECT place // {WIDTH} AS word, max(step) AS step FROM line GROUP BY ALL) done ON word = place // {WIDTH} AND done.step = line.step
ORDER BY place
"""
#: The same for long words, with fewer steps. Here tokens are (word, pos, id), and only rows that change are written. A step takes all
#: of a word's pairs of the smallest rank, leftmost first (a pair that shares a token with one just taken waits), up to the first whose
#: merged token makes a smaller rank with what is beside it then. A merged token stands at its left half's position; the right half is
#: marked dead.
LONG = """
WITH RECURSIVE line(word, pos, id) USING KEY (word, pos) AS (
  SELECT word, pos, id FROM tokens
  UNION
  (WITH live AS (
    SELECT word, pos, id, lag(id) OVER w AS before, lead(id) OVER w AS second, lead(pos) OVER w AS taken, lead(id, 2) OVER w AS after, lead(pos, 2) OVER w AS beyond
    FROM recurring.line SEMI JOIN (SELECT DISTINCT word FROM line) changed USING (word) WHERE id >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)),
  pair AS (SELECT word, pos, taken, beyond, before, after, m.merged FROM live JOIN merges m ON m.first = id AND m.second = live.second),
  chosen AS (SELECT p.*, coalesce(lag(p.taken) OVER (PARTITION BY p.word ORDER BY p.pos) = p.pos, FALSE) AS shares
    FROM pair p SEMI JOIN (SELECT word, min(merged) AS merged FROM pair GROUP BY word) least USING (word, merged)),
  chain AS (SELECT *, sum(CASE WHEN shares THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS chain FROM chosen),
  taking AS (SELECT * FROM chain QUALIFY row_number() OVER (PARTITION BY word, chain ORDER BY pos) % 2 = 1),
  beside AS (SELECT * REPLACE (CASE WHEN lag(beyond) OVER (PARTITION BY word ORDER BY pos) = pos THEN merged ELSE before END AS before) FROM taking),
  news AS (SELECT word, pos, merged, unnest([before, merged]) AS first, unnest([merged, after]) AS second FROM beside),
  stops AS (SELECT n.word, min(n.pos) AS pos FROM news n JOIN merges m USING (first, second) WHERE m.merged < n.merged GROUP BY n.word)
  SELECT t.word, unnest([t.pos, t.taken]), unnest([t.merged, -1]) FROM taking t LEFT JOIN stops s USING (word) WHERE t.pos <= coalesce(s.pos, t.pos))
)
SELECT word, id FROM line WHERE id >= 0 ORDER BY word, pos
"""


class Ranks:
    """A rank file in DuckDB: `vocabulary` (id, one letter up to U+00FF for each byte), `merges` (first, second, merged, and the first two as one number).

    Two tokens merge where their bytes together are a token; its rank is its id.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(pattern)
        self.known = Recent(KEPT)
        merges = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": QUERY_MEMORY, "temp_directory": "", "preserve_insertion_order": False})
        first, second, merged = np.array(merges, np.int64).reshape(-1, 3).T
        self.fill("merges", {"first": pa.array(first), "second": pa.array(second), "merged": pa.array(merged), "first_second": pa.array((first << 32) + second)})
        self.fill("vocabulary", {"id": pa.array(self.ids.values(), pa.int32()), "letters": pa.array([t.decode("latin-1") for t in self.ids])})
        self.single = np.array([self.ids.get(bytes((b,)), -1) for b in range(256)], np.int64)

    def fill(self, table: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {table} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, 4 bytes each. A word that is a token itself is that token."""
        out: list[bytes | None] = [i.to_bytes(4, "little") if (i := self.ids.get(w)) is not None else None for w in words]
        rest = [k for k, x in enumerate(out) if x is None]
        for some, query in (([k for k in rest if len(words[k]) < WIDTH], SHORT), ([k for k in rest if len(words[k]) >= WIDTH], LONG)):
            for a in range(0, len(some), TOGETHER):
                part = some[a : a + TOGETHER]
                for k, ids in zip(part, self._contract([words[k] for k in part], query), strict=True):
                    out[k] = ids
        return out

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        sizes = np.array([len(w) for w in words], np.int64)
        of = np.repeat(np.arange(len(words)), sizes)
        pos = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        if (ids < 0).any():
            raise ValueError("a byte has no token")
        where = {"place": pa.array(of * WIDTH + pos)} if query is SHORT else {"word": pa.array(of), "pos": pa.array(pos)}
        self.fill("tokens", where | {"id": pa.array(ids)})
        done = self.db.execute(query).fetchnumpy()
        ends = np.cumsum(np.bincount(done["word"], minlength=len(words))) * 4
        data = done["id"].astype("<i4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of these distinct pieces of text; words of pieces that are not known are contracted together."""
        out = [self.known.get(p) for p in pieces]
        new = [k for k, x in enumerate(out) if x is None]
        split = [self.words.findall(pieces[k]) for k in new]
        ids = {w: self.known.get(w) for ws in split for w in ws}
        fresh = [w for w, x in ids.items() if x is None]
        for w, x in zip(fresh, self.contract([w.encode() for w in fresh]), strict=True):
            ids[w] = x
            if len(w) <= KEPT_SIZE:
                self.known.put(w, x)
        for k, ws in zip(new, split, strict=True):
            out[k] = b"".join([ids[w] for w in ws])
            if len(ws) > 1 and len(pieces[k]) <= KEPT_SIZE:
                self.known.put(pieces[k], out[k])
        return out

    def encode(self, column: pa.Array) -> pa.Array:
        """The list of ids of each text.

        Texts fall into pieces before each space: no word of the pattern crosses there, unless white space is on both sides of it; a text
        with such a space is one piece. Distinct pieces are looked up once.
        """
        odd = pc.match_substring_regex(column, UNCUT)
        parts = pc.split_pattern(pc.if_else(odd, pa.scalar(""), column), " ")
        texts = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.flatnonzero(np.diff(texts, prepend=-1))
        begins, which = np.unique(codes[first], return_inverse=True)
        codes[first] = len(words) + which
        rest = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        codes[first[rest]] = len(words) + len(begins) + np.arange(len(rest))
        pieces = [" " + w for w in words] + [words[b] for b in begins] + [column[int(r)].as_py() for r in rest]
        used, codes = np.unique(codes, return_inverse=True)
        ids = self.lookup_all([pieces[u] for u in used])
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        flat = ragged(np.frombuffer(b"".join(ids), "<i4"), (np.cumsum(sizes) - sizes)[codes], sizes[codes])
        lengths = np.bincount(texts, sizes[codes], len(column)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat.astype(np.int32, copy=False)))

    def lookup_all(self, pieces: list[str]) -> list[bytes]:
        """lookup() for pieces that may be equal, as the first piece of a text and an odd text can be."""
        distinct = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct, self.lookup(distinct), strict=True))
        return [ids[p] for p in pieces]

    def decode(self, lists: pa.Array) -> pa.Array:
        """The bytes of each list of ids (no nulls): tokens joined with the vocabulary and put together in order."""
        flat = lists.flatten()
        self.fill("token", {"text": pc.list_parent_indices(lists).cast(pa.int64()), "place": pa.array(np.arange(len(flat))), "id": flat.cast(pa.int32())})
        unknown = self.db.execute("SELECT count(*) FROM token ANTI JOIN vocabulary USING (id)").fetchall()[0][0]
        if unknown:
            raise ValueError(f"{unknown} ids are not in the vocabulary")
        found = self.db.execute("SELECT text, string_agg(letters, '' ORDER BY place) AS letters FROM token JOIN vocabulary USING (id) GROUP BY text").fetchnumpy()
        out = [b""] * len(lists)
        for text, letters in zip(found["text"].tolist(), found["letters"], strict=True):
            out[text] = letters.encode("latin-1")
        return pa.array(out, pa.binary())


def _ranks(path: str, pattern: str) -> Ranks:
    return worker_state(("rank_bpe", path, pattern), lambda: Ranks(path, pattern))


def encode(df: DataFrame, path: str, pattern: str, *, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """df plus `ids` (array of int): the whole text's tokens by the rank file at `path` (on every machine), each match of pattern by itself.

    Null and empty texts have no ids; strings of special tokens are ordinary text. With decoded_col, the bytes of the ids, as decode() gives
    them, come in that column from the same workers. Input columns of those names are replaced, others stay. One pass, no shuffle; distinct words
    of a part of a batch are contracted together, and what was found lately is kept. Repeated rows are encoded each, an empty table gives
    an empty one; a long text or word takes memory in proportion to its length.
    """
    def work(column: pa.Array) -> list:
        know = _ranks(path, pattern)
        ids = know.encode(column)
        return [ids, *([_decoded(know, ids)] if decoded_col else [])]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.BinaryType())] if decoded_col else [])]
    return with_text_columns(df, text_col, fields, work, 2 << 20)


def _decoded(know: Ranks, lists: pa.Array) -> pa.Array:
    """The bytes of each list of ids, some lists at a time."""
    part = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)) >> 18
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lists)]
    return pa.concat_arrays([pa.array([], pa.binary()), *(know.decode(lists.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)])


def decode(df: DataFrame, path: str, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """df plus `decoded` (binary): the bytes that the ids stand for. Null and empty lists give no bytes; an id outside the vocabulary is an error.

    An input column `decoded` is replaced, others stay. One pass, no shuffle; repeated rows are decoded each, an empty table gives an empty one.
    """
    source = df.select(F.struct(*others(df, "decoded")).alias("_pg_rec"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_pg_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_pg_rec"), _decoded(_ranks(path, pattern), batch.column("_pg_ids"))], ["_pg_rec", "decoded"])
        trim()

    return source.mapInArrow(run, T.StructType([source.schema["_pg_rec"], T.StructField("decoded", T.BinaryType())])).select("_pg_rec.*", "decoded")
