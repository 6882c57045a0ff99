"""Byte-level BPE encoding with a prefix-sharing trie, and decoding."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plangauge.llm._text import Recent, ragged, with_text_columns, worker_state

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and words that a worker keeps, in each of two generations; transitions and pairs of tokens before they are found anew.
KEPT, KEPT_STEPS = 350_000, 600_000
#: Pieces and words of more characters are encoded like any other but not kept.
LONG = 256


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by rule: printable Latin-1 for itself, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, how each was merged, and the trie of token bytes.

    A token's id grows with the rank of its merge, so ids stand for ranks.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_symbols()
        ids = spec["model"]["vocab"]
        self.bytes = [b""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for t, i in ids.items():
            self.bytes[i] = bytes(byte[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.single = {self.bytes[i][0]: i for i in ids.values() if len(self.bytes[i]) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = ids[a], ids[b]
            self.merged.setdefault(pair, ids[a + b])
            self.parts.setdefault(ids[a + b], pair)
        self.by_bytes = {self.bytes[i]: i for i in ids.values() if i in self.parts or len(self.bytes[i]) == 1}
        self.begins = {t[:n] for t in self.by_bytes for n in range(len(t) + 1)}
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(t) for t in self.bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves these two tokens side by side: undo the later of their merges, step by step, and see that no merge across the seam came first."""
        first = 1 << 62  # the merge that was undone last; an earlier one across the seam would have come before it
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < first:
                return False
            la, lb = self.parts.get(a), self.parts.get(b)
            if la is None and lb is None:
                return True
            if lb is None or (la is not None and a > b):
                first, a = a, la[1]  # at equal ranks the left one was merged first, so a seam merge of the same rank loses to it
            else:
                first, b = b + 1, lb[0]


class Encoder:
    """Encodings of distinct words, by a trie whose nodes hold the last token of the encoding of their prefix.

    The encoding of a prefix is that of the prefix without its last token, and that token: so one token for each node, found from
    the nodes above it, gives the encodings of all words, and a shared prefix is worked out once. The last token is the longest
    token that ends the prefix and may follow the last token of what is before it; which tokens end a prefix is the state of an
    automaton over the vocabulary (the longest end of the prefix that begins a token), whose transitions are worked out when met.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.clear()

    def clear(self) -> None:
        self.number, self.strings = {b"": 0}, [b""]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.steps: dict[int, int] = {}
        self.adjacent: dict[int, bool] = {}

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte, entered in the table."""
        s = self.strings[state] + bytes((byte,))
        while s not in self.v.begins:
            s = s[1:]
        found = self.number.get(s)
        if found is None:
            found = self.number[s] = len(self.strings)
            self.strings.append(s)
            tails = ((n, self.v.by_bytes.get(s[len(s) - n :])) for n in range(len(s), 0, -1))
            self.ends.append([(n, t) for n, t in tails if t is not None])
        self.steps[state << 8 | byte] = found
        return found

    def add(self, words: list[bytes]) -> list[bytes]:
        """The encodings of the words, 4 bytes for each id. The words are walked depth first: in sorted order a word's trie nodes down
        to where it leaves the one before it are those on the path, and only the nodes below are new."""
        if max(len(self.steps), len(self.adjacent)) > KEPT_STEPS:
            self.clear()
        steps, ends, adjacent, follow, packed, sizes = self.steps, self.ends, self.adjacent, self.v.may_follow, self.v.packed, self.v.sizes.tolist()
        out: list[bytes] = [b""] * len(words)
        states, lasts, before = [0], [-1], b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            w = words[k]
            same = 0
            for x, y in zip(w, before, strict=False):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], lasts[same + 1 :]
            state = states[same]
            for end in range(same + 1, len(w) + 1):
                byte = w[end - 1]
                to = steps.get(state << 8 | byte)
                state = self._step(state, byte) if to is None else to
                for size, token in ends[state]:
                    if size == end:
                        break
                    pair = lasts[end - size] << 32 | token
                    ok = adjacent.get(pair)
                    if ok is None:
                        ok = adjacent[pair] = follow(lasts[end - size], token)
                    if ok:
                        break
                else:
                    raise ValueError("a byte has no token")
                states.append(state)
                lasts.append(token)
            before = w
            tokens, at = [], len(w)
            while at:
                t = lasts[at]
                tokens.append(packed[t])
                at -= sizes[t]
            tokens.reverse()
            out[k] = b"".join(tokens)
        return out


class Pieces:
    """Token ids of pieces of text, kept from batch to batch."""

    def __init__(self, v: Vocabulary):
        self.v, self.encoder, self.words = v, Encoder(v), regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, v.special))) if v.special else None
        self.known = Recent(KEPT)

    def split(self, piece: str) -> list[str | int]:
        """The pre-tokens of a piece, special tokens as ids."""
        if piece[1:].isalpha() and piece[0] == " ":
            return [piece]
        if self.special is None or not self.special.search(piece):
            return self.words.findall(piece)
        out, at = [], 0
        for m in self.special.finditer(piece):
            out += [*self.words.findall(piece[at : m.start()]), self.v.special[m.group()]]
            at = m.end()
        return out + self.words.findall(piece[at:])

    def encoded(self, split: list[list[str | int]]) -> list[bytes]:
        """The ids of each list of pre-tokens, 4 bytes each; words that are new go to the trie together."""
        get, packed = self.known.get, self.v.packed
        ids = {w: packed[w] if isinstance(w, int) else get(w) for ws in split for w in ws}
        fresh = [w for w, x in ids.items() if x is None]
        for w, x in zip(fresh, self.encoder.add([w.encode() for w in fresh]), strict=True):
            ids[w] = x
            if len(w) <= LONG:
                self.known.put(w, x)
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in split]

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. A piece that is one word is known as that word: on its own it would split into itself."""
        out = [self.known.get(p) for p in pieces]
        new = [k for k, x in enumerate(out) if x is None]
        split = [self.split(pieces[k]) for k in new]
        for k, ws, x in zip(new, split, self.encoded(split), strict=True):
            out[k] = x
            if len(ws) > 1 and len(pieces[k]) <= LONG:
                self.known.put(pieces[k], x)
        return out


def _pieces(path: str) -> Pieces:
    return worker_state(("bpe", path), lambda: Pieces(Vocabulary(path)))


def encode_batch(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, number of ids of each text).

    A text falls into pieces before each single space that a non-space follows: no pre-token crosses there. Distinct pieces are
    encoded once. Texts in which a space is followed by more white space are one piece each, never kept.
    """
    know = _pieces(path)
    odd = pc.or_(pc.match_substring_regex(column, r" \s"), pc.match_substring_regex(column, r"[\x1c-\x1f\x85\xa0  -     　]"))
    odd = odd.to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar(""), column), " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(counts) - counts
    used, firsts = np.unique(codes[first], return_inverse=True) if len(first) else (np.empty(0, np.int64), first)
    found = know.lookup([" " + w for w in words] + [words[u] for u in used])
    codes[first] = len(words) + firsts
    sizes = np.array([len(x) for x in found], np.int64) // 4
    starts = np.cumsum(sizes) - sizes
    ids = ragged(np.frombuffer(b"".join(found), "<i4"), starts[codes], sizes[codes])
    lengths = np.add.reduceat(sizes[codes], first) if len(first) else first
    if odd.any():
        cut = np.split(ids, np.cumsum(lengths)[:-1])
        for i in np.flatnonzero(odd):
            cut[i] = np.frombuffer(know.encoded([know.split(column[int(i)].as_py())])[0], "<i4")
        ids, lengths = np.concatenate(cut), np.array([len(c) for c in cut], np.int64)
    return ids.astype(np.int32), lengths


def decode_batch(ids: np.ndarray, lengths: np.ndarray, path: str) -> list[str]:
    """The texts of the ids; bytes that are not UTF-8 become U+FFFD."""
    v = _pieces(path).v
    data = ragged(v.blob, v.starts[ids], v.sizes[ids]).tobytes()
    ends = np.concatenate([[0], np.cumsum(v.sizes[ids])])[np.concatenate([[0], np.cumsum(lengths)])]
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _lists(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, path: str, *, text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """df plus `ids` (array of int): the whole text's tokens, as the vocabulary file at `path` (on every machine) gives them.

    Null texts count as empty and have no ids. With decoded_col, the ids are decoded again into that column. Input columns of
    those names are replaced. One pass, no shuffle; a worker keeps a bounded number of pieces. Repeated rows are encoded each, an
    empty table gives an empty one, and a long text or a long word takes memory in proportion to its own length.
    """
    def work(column: pa.Array) -> list:
        ids, lengths = encode_batch(column, path)
        return [_lists(ids, lengths), *([pa.array(decode_batch(ids, lengths, path), pa.string())] if decoded_col else [])]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    return with_text_columns(df, text_col, fields, work, 8 << 20)
