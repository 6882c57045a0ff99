"""Lexical retrieval packing of tokenised documents into fixed windows."""

from __future__ import annotations

import functools
import math
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plangauge.core.staging import stage
from plangauge.llm._text import Recent, ragged, slices, texts, worker_state

#: Texts of these characters alone, single code points that the normaliser only lowers, are cut into words.
PLAIN = r"^[\t\n\v\f\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]*$"
#: The pattern that splits normalised text before the merges, and what it lets an apostrophe take.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pieces of texts that are not plain which a worker keeps, in each of two generations, if they are no longer than LONG; words given to the tokenizer at once.
KEPT, LONG, TOGETHER = 60_000, 256, 10_000


@dataclass(frozen=True)
class Packing:
    """Window length, end token, tokens of a shard, BM25's k1 and b, how many terms are drawn to deal a document, and bytes of text cut into words at once."""

    window: int = 4096
    end_id: int = 2
    shard_tokens: int = 2_000_000
    k1: float = 1.2
    b: float = 0.75
    draws: int = 4
    slice_bytes: int = 4 << 20


class Tokens:
    """Token ids of words and of white-space-free pieces by the tokenizers library; those of pieces are kept from batch to batch.

    The file's normaliser and splitter never join what white space separates, so a text's ids are those of its pieces end to end,
    and those of a plain text are those of its words. Words are lowered and split already, so they go to the file's model behind a
    splitter at white space alone, their bytes shown as the characters that the file's splitter shows them as.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.vocab = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.width = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        self.known = Recent(KEPT)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each) of words of plain texts, encoded together, as one word's ids end with the only token that ends a word."""
        out, sizes = [np.zeros(0, self.width)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), TOGETHER):
            some = words[a : a + TOGETHER]
            shown = _shown()[np.frombuffer(" ".join(some).encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.width)
            n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(n) != len(some):
                each = [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                ids, n = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            out.append(ids)
            sizes.append(n)
        return np.concatenate(out), np.concatenate(sizes)

    def piece(self, x: str) -> bytes:
        """The ids of a piece of any characters, as bytes of self.width."""
        found = self.known.get(x)
        if found is None:
            found = np.array(self.tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids, self.width).tobytes()
            if len(x) <= LONG:
                self.known.put(x, found)
        return found


@functools.cache
def _shown() -> np.ndarray:
    """The code point that the byte-level splitter shows each byte as; the space stays."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, "<u4")
    out[same] = same
    rest = np.setdiff1d(np.arange(256), same)
    out[rest] = 256 + np.arange(len(rest))
    out[ord(" ")] = ord(" ")
    return out


def _tokens(path: str) -> Tokens:
    return worker_state(("packing", path), lambda: Tokens(path))


def _joined(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, number of ids of each group) of groups of items: codes number the items, which have sizes of the ids; counts say how many a group has."""
    starts = np.cumsum(sizes) - sizes
    each = sizes[codes]
    return ragged(ids, starts[codes], each), np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])])


def _ids_of(column: pa.Array, know: Tokens, words: bool) -> tuple[np.ndarray, np.ndarray]:
    parts = pc.ascii_split_whitespace(column)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    if not words:
        found = [know.piece(x) if x else b"" for x in flat.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.array([len(x) for x in found], np.int64) // know.width.itemsize
        return _joined(np.frombuffer(b"".join(found), know.width), sizes, codes, counts)
    split, each = plain_words(flat.dictionary)
    split = split.dictionary_encode()
    ids, sizes = know.words(split.dictionary.to_numpy(zero_copy_only=False).tolist())
    ids, sizes = _joined(ids, sizes, split.indices.to_numpy(zero_copy_only=False), each)
    return _joined(ids, sizes, codes, counts)


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point that a PLAIN text has once it is lowered: 1 for letters, 2 for numbers, 0 for the rest."""
    kind = [unicodedata.category(chr(c))[0] for c in range(1 + max(ord(chr(c).lower()[0]) for c in range(0x250)))]
    return np.array([{"L": 1, "N": 2}.get(k, 0) for k in kind], np.int8)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the column's texts end to end, where each begins and the last ends)."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


@functools.cache
def _odd() -> np.ndarray:
    """Whether a byte may belong to a character that PLAIN lacks: control characters, and bytes that begin U+0080 to U+00BF, U+0100 to U+013F and U+0240 on."""
    out = np.zeros(256, bool)
    out[[*range(0x09), *range(0x0E, 0x20), 0x7F, 0xC2, 0xC4, *range(0xC9, 0x100)]] = True
    return out


def plain_texts(column: pa.Array, special: list[str]) -> np.ndarray:
    """Which texts have PLAIN characters alone and none of the special tokens."""
    data, bounds = _bytes(column)
    some = np.flatnonzero(np.diff(bounds))
    odd = some[np.logical_or.reduceat(_odd()[data], bounds[some])] if len(some) else some
    plain = np.ones(len(column), bool)
    plain[odd] = pc.match_substring_regex(column.take(pa.array(odd, pa.int64())), PLAIN).to_numpy(zero_copy_only=False)
    begin = os.path.commonprefix(special)
    if special and (not begin or pc.any(some := pc.match_substring(column, begin)).as_py()):
        some = np.flatnonzero(plain & some.to_numpy(zero_copy_only=False)) if begin else np.flatnonzero(plain)
        for t in special:
            plain[some] &= ~pc.match_substring(column.take(pa.array(some, pa.int64())), t).to_numpy(zero_copy_only=False)
    return plain


def plain_words(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words end to end, number of words of each piece) of pieces of PLAIN characters without white space: what PATTERN finds in them, lowered.

    Letters make one word, so does all that is neither letter nor number, and each number; an apostrophe that begins such a word takes one of
    ENDINGS from the letters behind it.
    """
    low = pc.utf8_lower(pieces)
    data, bounds = _bytes(low)
    text = data.tobytes()
    point = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
    at = np.cumsum(1 + (point > 0x7F) + (point > 0x7FF))  # where each character ends
    first = np.zeros(bounds[-1] + 1, bool)  # where a piece begins, or the text ends
    first[bounds] = True
    first = first[np.concatenate([[0], at])]
    kind = _kinds()[point]
    start = first[:-1] | (kind == 2)
    start[1:] |= kind[1:] != kind[:-1]
    open_ = np.flatnonzero(start & (point == ord("'")))
    for end in ENDINGS:
        i = open_[open_ + len(end) < len(point)]
        for k, c in enumerate(end, 1):
            i = i[(point[i + k] == ord(c)) & ~first[i + k]]
        start[i + 1] = False
        start[i[i + len(end) + 1 < len(point)] + len(end) + 1] = True
    where = np.concatenate([[0], at])[np.flatnonzero(start)]
    out = pa.Array.from_buffers(pa.string(), len(where), [None, pa.py_buffer(np.append(where, bounds[-1]).astype(np.int32)), pa.py_buffer(text)])
    return out, np.diff(np.searchsorted(where, bounds))


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, number of ids of each text). Texts of other characters than plain ones, or with a special token, are looked up by piece."""
    know = _tokens(path)
    plain = plain_texts(column, know.special)
    if plain.all() or not plain.any():
        return _ids_of(column, know, bool(plain.all()))
    where = [np.flatnonzero(plain), np.flatnonzero(~plain)]
    (ids, n), (other, m) = (_ids_of(column.take(pa.array(w)), know, words) for w, words in zip(where, (True, False), strict=True))
    sizes, starts = np.empty(len(column), np.int64), np.empty(len(column), np.int64)
    sizes[where[0]], sizes[where[1]] = n, m
    starts[where[0]], starts[where[1]] = np.cumsum(n) - n, len(ids) + np.cumsum(m) - m
    return ragged(np.concatenate([ids, other]), starts, sizes), sizes


def tokenise(df: DataFrame, path: str, p: Packing = Packing(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids): a text's ids and the end token, as little-endian 16-bit numbers (32-bit if the vocabulary needs them). Null texts are empty."""
    width = _tokens(path).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", p.slice_bytes):
            ids, n = token_ids(texts(b, "text"), path)
            ends = np.cumsum(n)
            full = np.insert(ids, ends, p.end_id).astype(width)
            bounds = np.concatenate([[0], ends + np.arange(1, len(n) + 1)]) * full.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(full)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n + 1, pa.int64()), packed], ["id", "n", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, ids binary")


def _arrays(column, width: np.dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), width) for x in column]


def document_frequencies(tokens: DataFrame, vocab: int, width: np.dtype) -> np.ndarray:
    """How many documents each token occurs in, over all documents: an array as long as the vocabulary, so bounded whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("terms",), bool)  # the tokenizer is not needed from here on
        total = np.zeros(vocab, np.int64)
        for b in batches:
            for a in _arrays(b.column("ids"), width):
                total[np.unique(a)] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["term", "n"])

    out = np.zeros(vocab, np.int64)
    for term, n in tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def draw_tables(idf: np.ndarray, found: np.ndarray, p: Packing) -> list[tuple[np.ndarray, np.ndarray]]:
    """p.draws pairs (rank of each term, term of each rank): orders of the vocabulary in which a document's first term is drawn.

    Each term has an exponential draw at the rate of its idf, by a hash of its number, so a document's first term is any one of
    its terms with a chance in proportion to its idf, and two documents have the same one with the chance of their weighted
    similarity. Terms of a single document come last, as they join it with nothing.
    """
    out = []
    for k in range(p.draws):
        x = (np.arange(len(idf), dtype=np.uint64) + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        draw = -np.log(((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-300) / idf
        order = np.lexsort((draw, found < 2)).astype(np.int32)
        rank = np.empty(len(idf), np.int32)
        rank[order] = np.arange(len(idf), dtype=np.int32)
        out.append((rank, order))
    return out


class Index:
    """BM25 inverted index of one shard's documents: postings by term, with the weight of each."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, p: Packing):
        sizes = np.array([len(d) for d in docs], np.int64)
        kind = np.int32 if len(docs) * len(idf) < 1 << 31 else np.int64
        keys = np.concatenate(docs).astype(kind)
        keys *= kind(len(docs))
        keys += np.repeat(np.arange(len(docs), dtype=kind), sizes)
        keys, tf = np.unique(keys, return_counts=True)
        self.doc, term = (keys % kind(len(docs))).astype(np.int64), keys // kind(len(docs))
        self.weight = idf[term] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * sizes[self.doc] / mean))
        order = np.argsort(self.doc, kind="stable")
        self.term = term[order]
        self.at = np.searchsorted(self.doc[order], np.arange(len(docs) + 1))
        self.n, self.alive = len(docs), np.arange(len(docs))
        self._bound(term, len(idf))

    def _bound(self, term: np.ndarray, vocab: int) -> None:
        self.first = np.searchsorted(term, np.arange(vocab + 1)).tolist()
        self.of = term

    def keep(self, unused: np.ndarray) -> None:
        """Postings of used documents go; alive holds the documents that are left, in order."""
        left = unused[self.alive]
        number = np.cumsum(left) - 1
        stay = left[self.doc]
        self.doc, self.weight = number[self.doc[stay]], self.weight[stay]
        self.alive = self.alive[left]
        self._bound(self.of[stay], len(self.first) - 1)

    def neighbours(self, seed: int) -> np.ndarray:
        """BM25 scores of the alive documents for all of the seed's terms."""
        first, terms = self.first, self.term[self.at[seed] : self.at[seed + 1]].tolist()
        doc = [self.doc[first[t] : first[t + 1]] for t in terms]
        weight = [self.weight[first[t] : first[t + 1]] for t in terms]
        return np.bincount(np.concatenate(doc), np.concatenate(weight), len(self.alive))


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, p: Packing) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard.

    The first unused document, or what is left of one that was cut, seeds a window. Its unused neighbours fill it in order of score
    (ties: the earlier) as far as they fit whole; the best that did not fit is cut to fill it to the end, and its rest seeds the
    next window. The last window's tokens go to sequences whose lengths are powers of two, which need no padding.
    """
    index = Index(docs, idf, mean, p)
    size = np.array([len(d) for d in docs], np.int64)
    unused = np.ones(len(docs), bool)
    windows: list[list[tuple[int, int, int]]] = []
    fresh, rest, left = 0, None, len(docs)
    while True:
        if rest is None:
            while fresh < len(docs) and not unused[fresh]:
                fresh += 1
            if fresh == len(docs):
                break
            rest, unused[fresh], left = (fresh, 0), False, left - 1
        seed, start = rest
        take = int(min(p.window, size[seed] - start))
        window, room, rest = [(seed, start, take)], p.window - take, (seed, start + take) if start + take < size[seed] else None
        if room and left:
            if left < 0.7 * len(index.alive):
                index.keep(unused)
            score, open_ = index.neighbours(seed), unused[index.alive]
            order = index.alive[open_]
            order = order[np.argsort(-score[open_], kind="stable")]
            sizes, at, cut = size[order], 0, -1
            while room:
                fits = sizes[at:] <= room
                step = int(fits.argmax()) if len(fits) else 0
                if not len(fits) or not fits[step]:
                    cut = at if cut < 0 and len(fits) else cut
                    break
                cut = at if cut < 0 and step else cut
                d = int(order[at + step])
                window.append((d, 0, int(size[d])))
                unused[d], left, room, at = False, left - 1, room - int(size[d]), at + step + 1
            if room and cut >= 0:
                d = int(order[cut])
                unused[d], left = False, left - 1
                window.append((d, 0, room))
                rest, room = (d, room), 0
        windows.append(window)
        if room:
            break
    out, number = [], 0
    for window in windows:
        total, ends = sum(x[2] for x in window), []
        if total == p.window:
            ends = [total]
        else:
            at = 0
            for bit in range(total.bit_length() - 1, -1, -1):
                if total >> bit & 1:
                    at += 1 << bit
                    ends.append(at)
        at, low = 0, 0
        for d, start, length in window:
            while length:
                take = min(length, ends[0] - at)
                out.append((d, start, take, number, at - low))
                start, length, at = start + take, length - take, at + take
                if at == ends[0]:
                    low, number = ends.pop(0), number + 1
    return out


def pack(df: DataFrame, path: str, p: Packing = Packing(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most p.window tokens: id, start, length, doc_tokens, sequence_id, offset and the piece's `ids` (little-endian 32-bit).

    Tokens are written once. Documents are dealt to shards of about p.shard_tokens tokens by content: each draws p.draws of its
    terms by weight (draw_tables), and the rows in order of their drawn terms, ties by a hash of the row, are cut into ranges. So
    documents that share rare terms tend to meet, copies lie side by side, and a group of any size is cut where a shard is full.
    Each shard has an inverted index, with document frequencies and mean length of the whole corpus. A range of long documents is
    several shards, one after the other. The driver gets one number for each entry of the vocabulary.

    Each id lies in exactly one piece. Null texts are the end token alone; long texts span windows; rows with equal ids and
    repeated rows are packed each; ties in score go to the row that comes first in its shard; an empty table gives no piece; other
    columns are not read.
    """
    tokens = stage(tokenise(df, path, p, id_col=id_col, text_col=text_col), "tokens")
    n, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    vocab = max(_tokens(path).vocab, p.end_id + 1)
    width = _tokens(path).width
    found = document_frequencies(tokens, vocab, width)
    idf = np.log1p((n - found + 0.5) / (found + 0.5))
    mean = (total or 0) / max(n, 1)
    found[p.end_id] = 1  # every document has it
    shared = df.sparkSession.sparkContext.broadcast((idf, draw_tables(idf, found, p)))
    kind = tokens.schema["id"].dataType.simpleString()
    keys = [f"d{k}" for k in range(p.draws)]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("terms",), bool)
        for b in batches:
            docs = _arrays(b.column("ids"), width)
            if docs:
                ids, sizes = np.concatenate(docs), np.array([len(x) for x in docs], np.int64)
                at = np.cumsum(sizes) - sizes
                terms = [pa.array(order[np.minimum.reduceat(rank[ids], at)]) for rank, order in shared.value[1]]
                yield pa.RecordBatch.from_arrays([*terms, *b.columns], [*keys, *b.schema.names])

    def packed(docs: list[np.ndarray], ids: list[pa.Array], first: int) -> pa.RecordBatch:
        pieces = np.array(pack_shard(docs, shared.value[0], mean, p), np.int64).reshape(-1, 5)
        d, start, length, sequence, offset = pieces.T
        sizes = np.array([len(x) for x in docs], np.int64)
        data = ragged(np.concatenate(docs), (np.cumsum(sizes) - sizes)[d] + start, length).astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64) * 4
        data = pa.Array.from_buffers(pa.large_binary(), len(d), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids).take(pa.array(d)), pa.array(start), pa.array(length), pa.array(sizes[d]), pa.array(sequence + first), pa.array(offset), data], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("terms",), bool)
        docs, ids, filled = [], [], 0
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            more = _arrays(b.column("ids"), width)
            at = 0
            for k, doc in enumerate(more):
                if docs and 2 * (filled + len(doc)) > 3 * p.shard_tokens:
                    yield packed(docs, [*ids, b.column("id").slice(at, k - at)], first)
                    first, docs, ids, filled, at = first + sum(map(len, docs)), [], [], 0, k
                docs.append(doc)
                filled += len(doc)
            ids.append(b.column("id").slice(at))
        if docs:
            yield packed(docs, ids, first)

    rows = tokens.select("id", "ids", F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    rows = rows.mapInArrow(drawn, f"{', '.join(f'{k} int' for k in keys)}, id {kind}, ids binary, tie long")
    rows = rows.repartitionByRange(max(1, math.ceil((total or 0) / p.shard_tokens)), *keys, "tie").sortWithinPartitions(*keys, "tie")
    return rows.select("id", "ids").mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
