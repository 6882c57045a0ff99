"""Token counts under a unigram model, by dynamic programming over a trie of distinct words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plangauge.llm._text import Recent, with_text_columns, worker_state

#: Stands before each word in the vocabulary.
MARK = "▁"
#: Words that a worker keeps, in each of two generations, if they are no longer than LONG; transitions before they are found anew.
KEPT, LONG, KEPT_STEPS = 300_000, 256, 600_000


def zipf_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary with unigram scores: minus the logarithm of the piece's rank, as Zipf's law has it."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {piece: -math.log(rank + 2) for rank, piece in enumerate(plain)}


class Trie:
    """Words in a trie; each node holds the best score of its prefix and that segmentation's token count.

    best(prefix) = max over vocabulary pieces that end there of best(what is before it) + score, ties to fewer tokens. A character
    that no piece covers costs `unknown` and counts one token for each of its UTF-8 bytes. A prefix that words share is one node,
    so its score is worked out once; a word's count stands at its last node. Which pieces end a prefix is the state of an automaton
    over the vocabulary (the longest end of the prefix that begins a piece), whose transitions are worked out when met.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) * 2 - 1
        self.begins = {piece[:n] for piece in scores for n in range(len(piece) + 1)} | {""}
        self.terminal = Recent(KEPT)
        self.clear()

    def clear(self) -> None:
        self.number, self.strings = {"": 0}, [""]
        self.ends: list[list[tuple[int, float]]] = [[]]
        self.steps: dict[tuple[int, str], int] = {}

    def _step(self, state: int, char: str) -> int:
        """The state after one more character, entered in the table."""
        s = self.strings[state] + char
        while s not in self.begins:
            s = s[1:]
        found = self.number.get(s)
        if found is None:
            found = self.number[s] = len(self.strings)
            self.strings.append(s)
            self.ends.append([(n, self.scores[s[len(s) - n :]]) for n in range(1, len(s) + 1) if s[len(s) - n :] in self.scores])
        self.steps[state, char] = found
        return found

    def add(self, words: list[str]) -> list[tuple[float, int]]:
        """(score, tokens) of the words, walked depth first: in sorted order a word's nodes down to where it leaves the one before it are
        those on the path, and only the nodes below are new."""
        if len(self.steps) > KEPT_STEPS:
            self.clear()
        steps, ends, scores, unknown = self.steps, self.ends, self.scores, self.unknown
        out: list[tuple[float, int]] = [(0.0, 0)] * len(words)
        states, best, before = [0], [(0.0, 0)], ""  # counts are negative, so that the greater pair is the better one
        for k in sorted(range(len(words)), key=words.__getitem__):
            w = words[k]
            same = 0
            for x, y in zip(w, before, strict=False):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], best[same + 1 :]
            state = states[same]
            for end in range(same + 1, len(w) + 1):
                char = w[end - 1]
                to = steps.get((state, char))
                state = self._step(state, char) if to is None else to
                found = None
                if char not in scores:
                    score, count = best[end - 1]
                    found = score + unknown, count - len(char.encode())
                for size, s in ends[state]:
                    score, count = best[end - size]
                    if found is None or (score + s, count - 1) > found:
                        found = score + s, count - 1
                states.append(state)
                best.append(found)
            before = w
            out[k] = best[-1][0], -best[-1][1]
        return out

    def counted(self, words: list[str]) -> list[tuple[float, int]]:
        """(score, tokens) of each distinct word; those not seen lately go through the trie together."""
        out = [self.terminal.get(w) for w in words]
        new = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(new, self.add([words[k] for k in new]), strict=True):
            out[k] = x
            if len(words[k]) <= LONG:
                self.terminal.put(words[k], x)
        return out


def _trie(path: str) -> Trie:
    return worker_state(("token counts", path), lambda: Trie(zipf_scores(path)))


def count_tokens(df: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """df plus n_words, n_tokens (long) and log_score (double): words between ASCII white space, their tokens, and the sum of their best scores.

    `path` is a vocabulary file that every machine has. A null or empty text has zeros. Whole texts in one pass, no shuffle; equal
    words of a batch are looked up once, and a worker keeps a bounded number of words from batch to batch. Repeated rows are
    counted each, an empty table gives an empty one, and a long text or a long word takes memory in proportion to its own length.
    Input columns of the new names are replaced.
    """
    def work(column: pa.Array) -> list:
        trie = _trie(path)
        parts = pc.ascii_split_whitespace(column)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = parts.flatten().dictionary_encode()
        words = [MARK + w if w else "" for w in flat.dictionary.to_numpy(zero_copy_only=False).tolist()]
        got = np.array([(1.0, n, x) if w else (0.0, 0.0, 0.0) for w, (x, n) in zip(words, trie.counted(words), strict=True)]).reshape(-1, 3)
        sums = np.concatenate([np.zeros((1, 3)), np.cumsum(got[flat.indices.to_numpy(zero_copy_only=False)], axis=0)])
        each = sums[bounds[1:]] - sums[bounds[:-1]]
        return [pa.array(np.rint(each[:, k]).astype(np.int64)) if k < 2 else pa.array(each[:, k]) for k in range(3)]

    kinds = (("n_words", T.LongType()), ("n_tokens", T.LongType()), ("log_score", T.DoubleType()))
    return with_text_columns(df, text_col, [T.StructField(n, k) for n, k in kinds], work)
